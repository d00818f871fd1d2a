"""The five stages on a small corpus with planted cases, and on odd tables."""

import random

import pytest

import corpus_pipeline
from millrace.llm import near_dedup

from .test_near_dedup import brute


def corpus(folder, spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    r = random.Random(1)
    marked = [(d, int("scum" in (t or ""))) for d, t, *_ in rows if d is not None and d < 400 and t]
    spark.createDataFrame(marked, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(k, " ".join(f"item{k}word{r.randrange(60)}" for _ in range(30))) for k in range(5)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def documents(items):
    r, rows = random.Random(2), []
    for i in range(600):
        words = [r.choice(["the", "of", "and", "to"]) if r.random() < 0.4 else f"w{r.randrange(4000)}" for _ in range(r.randint(20, 120))]
        if i % 6 == 0:
            words[3:3] = ["scum", "trash", "scum"]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 0))
    clean = [x for x in rows if x[0] % 6]
    rows += [(1000 + i, clean[i][1], "en", "s1", 0) for i in range(30)] + [(1100 + i, clean[i][1] + " end", "en", "s2", 0) for i in range(30)]
    rows += [(1200 + k, f"{clean[k + 100][1]} {text}", "en", "s3", 0) for k, (_, text) in enumerate(items)]
    return rows


def test_stages_take_out_what_is_planted_and_keep_the_rest(spark, tmp_path):
    items = corpus(tmp_path / "items", spark, [(0, "x", "en", "s", 0)])
    rows = documents(items)
    corpus(tmp_path / "all", spark, rows)
    d, docs, kept = f"{tmp_path}/all", spark.read.parquet(f"{tmp_path}/all/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        kept.append([tuple(r) for r in docs.collect()])
    toxic = {i for i, t, *_ in rows if "scum" in t}
    assert {r[0] for r in kept[0]} == {r[0] for r in rows} - toxic
    groups = brute([(r[0], r[1]) for r in kept[0]], 80)
    assert sorted(r[0] for r in kept[1]) == sorted(set(groups.values()))
    assert {r[0] for r in kept[1]} - {r[0] for r in kept[2]} == {1200 + k for k in range(5)}
    texts = {r[0]: r for r in kept[2]}
    assert all(texts[r[0]] == r for r in kept[3]) and max(map(kept[3].count, set(kept[3]))) <= 3
    assert len(kept[4]) == len(kept[3]) and len({(r[4], r[5]) for r in kept[4]}) == len(kept[4])


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ["toxicity", "leak", "mix", "copy", "plan", "offset", "key", "chosen", "near_key", "c0", "a.b"]
    rows = [("x", "some words that are kept as they are", "s"), ("y", "other words than those of the first one", "s"), ("y", "other words than those of the first one", "s")]
    schema = "doc_id string, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, *names) for r in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("x", 0)], "doc_id string, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "a passage of the benchmark")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        got = docs.collect()
        assert docs.columns[3:] == names and all(tuple(r)[3:] == tuple(names) for r in got), name
        assert {r.doc_id for r in got} == {"x", "y"} and (name == "toxicity" or len(got) == 2), name


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(None, "a b c d e f", "x", None, 1), (5, "a b c d e f", "x", None, 1), (5, "other words in here too", None, "s", 1), (5, "a b c d e f", "x", None, 1), (6, "", "x", "s", 0)]])
def test_odd_tables(spark, tmp_path, rows):
    schema = "doc_id long, text string, toxicity string, source string, n_chars long, leak int, mix int, copy int, text_key int, shard int, class int, rep int"
    corpus(tmp_path, spark, [(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], schema)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) <= 3 * len(rows) and (not any(near_dedup.shingles(r[1]).size for r in rows) or got)
