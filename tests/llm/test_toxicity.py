"""The nearest examples against all cosines, calibrated scores, and odd rows."""

import random
import tracemalloc

import numpy as np

from millrace.llm import toxicity
from millrace.llm.common import written


def corpus(n, seed):
    r = random.Random(seed)
    common, rare, bad = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(3000)], ["scum", "trash", "moron"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = [r.choice(common if r.random() < 0.6 else rare) for _ in range(r.randint(5, 120))]
        for _ in range(r.randint(1, 3) if toxic else r.random() < 0.03):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_search_equals_all_cosines(spark):
    rows, labels = corpus(900, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame(labels[:600], "doc_id long, toxic int"))
    assert len(index.ids) == 600 and index.blocks > 2 * toxicity.FIRST
    dense = np.zeros((len(index.y), len(index.words)))
    term = np.repeat(np.arange(len(index.words)), [index.end[b - 1] - index.start[a] if b > a else 0 for a, b in zip(index.first[:-1], index.first[1:], strict=True)])
    dense[index.example, term] = index.posting
    assert np.allclose(np.linalg.norm(dense, axis=1), 1, atol=1e-5)
    for words in toxicity.sequences([t for _, t in rows[600:]], toxicity.ALNUM):
        terms, counts = index.known(words)
        query = np.zeros(len(index.words))
        query[terms] = index._unit(terms, counts)
        all_ = dense @ query
        near, sims = index.search(terms, counts)
        want = np.sort(all_)[::-1][: len(near)]
        assert len(near) >= toxicity.K and np.allclose(sims, want, atol=1e-5) and np.allclose(all_[near], sims, atol=1e-5)


def test_scores_of_held_out_rows_are_calibrated(spark):
    rows, labels = corpus(1500, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame(labels[:1000], "doc_id long, toxic int"))
    got = {r.doc_id: r.toxicity.score for r in toxicity.scored(docs, index).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, y in labels[1000:]]
    share = np.mean([got[i] for i, _ in labels[1000:]])
    assert np.mean(right) > 0.95 and abs(share - 1 / 6) < 0.05


def test_odd_rows_and_clashing_names(spark):
    rows, labels = corpus(60, 3)
    rows = [(i, t, "own") for i, t in rows] + [(60, None, "own"), (61, "", "own"), (0, "other text of one id", "own"), (0, rows[0][1], "own"), (None, "scum", "own"), (62, "word " * 20000, "own")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, toxicity string"), "test")
    contrary = [*labels, (0, 0), (1, None), (None, 1)]
    index = toxicity.fit(docs, spark.createDataFrame(contrary, "doc_id long, toxic int"))
    got = toxicity.scored(docs, index).collect()
    assert len(got) == len(rows) and len(index.ids) == len(set(index.ids)) == 60
    empty = {r.toxicity.score for r in got if not (r.text or "").strip()}
    assert empty == {index.base} and all(0 <= r.toxicity.score <= 1 for r in got)
    assert toxicity.scored(docs, toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))).first().toxicity.score == 0.5


def test_fit_holds_few_bytes_for_each_word_of_an_example(spark):
    r, n = random.Random(4), 200
    rows = [(i, " ".join(f"w{k}" for k in r.sample(range(4000), 2000))) for i in range(n)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"), "test")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
    tracemalloc.start()
    try:
        index = toxicity.fit(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(index.posting) == 2000 * n and most < 70 * len(index.posting)
