"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from millrace.llm import alignment, decontaminate, hmm, knn, licenses, mixing, near_dedup, pii, repeats, rules, sharding, toxicity

SCHEMA = "doc_id long, text string, source string, size long, n int, label string"
LONG = " ".join(f"w{i}" for i in range(20_000))
A = " ".join(f"a{i}" for i in range(100))
ROWS = [(0, None, None), (1, "", "x"), (2, " \n", "x"), (3, A, "x"), (4, A, "y"), (5, A + " tail", "y"), (6, LONG, "y"), (6, LONG, "y"), (7, "Mail me@b.org +1 202 555 0100, Apache License", None), (None, "one two", "z")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, 5, 1, "clash") for r in ROWS], SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, none):
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    frames = [licenses.licensed(none), repeats.without_repeats(none), decontaminate.contaminated(none, bench), toxicity.scored(none, toxicity.fit(none, labels)), sharding.shard_by_bytes(none), hmm.lm_scores(none, none["doc_id"] > 0), pii.protected(none), near_dedup.near_groups(none), mixing.mixed(none)]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_repeats_equal_brute_force(docs):
    texts = [(r[0], (r[1] or "").encode()) for r in ROWS]
    seen = Counter(b[k : k + 200] for _, b in texts for k in range(len(b) - 199))
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        want.append(str((i, len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())))
    got = repeats.without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(want)


def test_periodic_text_is_removed_whole(spark):
    one = spark.createDataFrame([(1, "ab" * 300), (2, "c" * 199), (3, "d" * 200), (4, "e" * 201)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.without_repeats(one).collect()}
    assert got == {1: 600, 2: 0, 3: 0, 4: 201}


def test_near_groups(docs):
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(docs).collect()}
    assert got == {(0, 0, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (5, 3, False), (6, 6, True), (7, 7, True), (None, None, True)}


def test_near_dedup_finds_a_mass_of_variants(spark):
    words = A.split()
    rows = [(i, " ".join([*words, f"v{i}"])) for i in range(400)] + [(900, "unlike " * 7)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 400} == {0}
    assert {r.component_id for r in got if r.doc_id == 900} == {900}


def test_near_dedup_finds_variants_that_are_near_one_original_only(spark):
    r, rows = random.Random(4), []
    for i in range(800):
        words = [f"a{k}" for k in range(300)]
        for k in r.sample(range(300), 4 if i != 400 else 0):
            words[k] = f"v{i}.{k}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 0.85).collect()
    sets = [near_dedup.shingles(t) for _, t in rows]
    near = {i for i, s in enumerate(sets) if 100 * len(both := set(s) & set(sets[400])) >= 85 * (len(s) + len(sets[400]) - len(both))}
    assert len(near) > 700 and {r.component_id for r in got if r.doc_id in near} == {min(near)}


def test_language_model_keeps_every_row(docs):
    rows = hmm.lm_scores(docs, docs["doc_id"] != 3).collect()
    assert len(rows) == len(ROWS)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert all(r.score < 0 for r in rows) and {r.n_tokens for r in rows if r.doc_id == 6} == {20_001}


def test_language_model_is_trained_to_the_end(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("abcde" if i % 2 else "vwxyz") for _ in range(30)) for i in range(200)]
    seqs = [hmm._class(hmm.hashes(t)) for t in texts]
    both = [(t, bytearray(s.tobytes())) for t, s in zip(texts, seqs, strict=True)]
    got = hmm.forward(seqs, *hmm.train(spark.createDataFrame(both, "text string, seq binary"))).sum()
    assert got > hmm.forward(seqs, *hmm.start()).sum() + 0.2 * sum(map(len, seqs))


def test_mix_takes_at_most_three_times(docs):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(ROWS) and all(r.mix.taken <= 3 * r.mix["size"] for r in rows) and {r["size"] for r in rows} == {5}


def test_licenses_and_personal_data(docs):
    lic = {r.doc_id: r.license for r in licenses.licensed(docs).collect()}
    assert (lic[7].base_labels, lic[7].n_base) == ("apache", 1) and lic[0].n_words == 0 and lic[0].first_word is None
    own = {r.doc_id: r for r in pii.protected(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in own[7].base] == [("email", 5, 13), ("phone", 14, 29)]


def test_terms_that_disclose_an_entity_become_spans(spark):
    plain = [f"some plain words about rivers and hills in place number {i}" for i in range(60)]
    far = "rivers and hills " * 20
    texts = [*plain, f"Jo Nováková {far} write to jo.n@b.org", "some words and hills by jo.n@b.org"]
    texts += [f"{' '.join(plain[i : i + 3])} regards 李 Łukasz Wu sales office +1 202 555 0100 rivers" for i in range(40)]
    got = {r.doc_id: {s.value for s in r.terms} for r in pii.protected(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[60] >= {"Jo", "Nováková"} and not got[60] & {"rivers", "and", "hills"} and "hills" not in got[61]
    assert all(got[i] >= {"regards", "Łukasz", "Wu", "sales", "office"} and not got[i] & {"plain", "hills", "rivers"} for i in range(62, 102))
    assert not any(got[i] for i in range(60))


def test_text_mit_license_gets_the_method_label():
    _, base, spans = licenses.Scanner().scan("x " + licenses.TEMPLATES["mit-text"].title() + " y")
    assert not base and [s[0] for s in spans] == ["mit-text"]


def test_top_k_ties_and_bad_vectors(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 5.0]), (3, [0.5, 0.0]), (50, [1.0]), (100, None), (150, [inf, 1.0]), (None, [9.0, 9.0]), (4, [None, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in knn.top_k(v, v["vec_id"] % 50 == 0, 2).collect()]
    assert sorted(got) == [(0, 1, 1, 65536), (0, 2, 2, 65536)]


def test_paraphrased_benchmark_item_is_found(spark):
    item = [f"q{i}" for i in range(40)]
    other = [w if i % 6 else "changed" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(f"z{i}" for i in range(200)) + " " + " ".join(other)), (2, " ".join(f"z{i}" for i in range(200))), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item)), (6, ""), (7, None)], "item_id long, text string")
    got = {r.doc_id: r.leak["items"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {1: [5], 2: [], 3: []}


def test_short_benchmark_items_are_found_in_any_text(spark):
    r = random.Random(7)
    host = [f"{c}{i}" for c in "gh" for i in range(500)]
    bench = [(k, " ".join(r.choice(host) for _ in range(r.randint(15, 29)))) for k in range(100)]
    rows = []
    for k, text in bench:
        own = [w if r.random() > 0.2 else "changed" for w in text.split()] if k % 2 else text.split()
        if sum(w != "changed" for w in own) < 0.6 * len(own):
            own = text.split()
        words = [r.choice(host) for _ in range(300)]
        at = r.randrange(300)
        rows.append((k, " ".join([*words[:at], *own, *words[at:]])))
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert [x.doc_id for x in got.collect() if x.doc_id not in x.leak["items"]] == []


def test_toxicity_learns_and_handles_empty_texts(spark):
    rows = [(i, f"plain words here number {'scum ' if i % 2 else ''} {i}") for i in range(200)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxicity.score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(200) if i % 2) and got[900] == got[901]


#: Names that the operators use for columns of their own.
OWN = ["key", "chosen", "near_key", "plan", "offset", "mix", "mix_part", "toxicity", "leak", "copy", "text_key", "class", "rep", "mass", "part", "parts", "component_id", "hash", "size", "s", "edge", "spent", "c0", "q`t", "a.b", "item_id", "items", "score", "label", "license", "row"]


@pytest.fixture
def crowded(spark):
    """Text ids, repeated rows, nulls, and a column of every name above."""
    words = " ".join(f"b{i}" for i in range(60))
    rows = [("a", words, "x"), ("a", words, "x"), ("b", words + " end", "y"), ("c", words + " scum", None), ("a", "other words", "x"), (None, words, "x"), ("d", None, "y"), ("e", "item " + " ".join(f"q{i}" for i in range(30)), "y")]
    names = ", ".join(f"`{n.replace('`', '``')}` string" for n in OWN)
    return spark.createDataFrame([(*r, *OWN) for r in rows], f"doc_id string, text string, source string, {names}")


def same_columns(docs, got):
    """Every row of got has the columns of docs first, with their values."""
    n = len(docs.columns)
    assert got.columns[:n] == docs.columns
    rows = [tuple(r) for r in got.collect()]
    assert all(r[3:n] == tuple(OWN) for r in rows)
    return rows


def test_columns_of_any_name_keep_their_values(spark, crowded):
    bench = spark.createDataFrame([("i1", " ".join(f"q{i}" for i in range(30)), 1), ("i2", None, 1)], "item_id string, text string, leak int")
    labels = spark.createDataFrame([("c", 1, "z"), ("a", 0, "z"), ("b", 0, "z")], "doc_id string, toxic int, text string")
    tox = same_columns(crowded, toxicity.scored(crowded, toxicity.fit(crowded, labels)))
    assert len(tox) == 8 and {e for r in tox for e in r[-1].evidence} <= {"a", "b", "c"}
    leak = same_columns(crowded, decontaminate.contaminated(crowded, bench))
    assert {r[0]: r[-1]["items"] for r in leak if r[0] == "e"} == {"e": ["i1"]} and all(not r[-1]["items"] for r in leak if r[0] != "e")
    mix = same_columns(crowded, mixing.mixed(crowded))
    assert len(mix) == 8 and all(0 <= r[-1].copies <= 3 for r in mix)
    one = same_columns(crowded, near_dedup.one_of_each(crowded))
    assert sorted((r[0] or "", (r[1] or "")[:5]) for r in one) == [("", "b0 b1"), ("a", "b0 b1"), ("a", "other"), ("d", ""), ("e", "item ")]
    judged = same_columns(crowded, rules.judged(crowded))
    assert len(judged) == 8


def test_other_operators_take_crowded_tables(crowded):
    crowded = crowded.toDF(*[c.replace("`", "_").replace(".", "_") for c in crowded.columns])
    for found in (licenses.licensed(crowded), repeats.without_repeats(crowded), sharding.shard_by_bytes(crowded), hmm.lm_scores(crowded, crowded["doc_id"] != "a"), pii.protected(crowded), near_dedup.near_groups(crowded), alignment.aligned(crowded).documents):
        assert found.count() == 8
    assert pii.sanitised(crowded).columns == crowded.columns
