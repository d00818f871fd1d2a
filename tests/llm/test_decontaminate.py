"""Leaks against the longest common subsequence of every run of every text."""

import random

import numpy as np

from millrace.llm import decontaminate
from millrace.llm.words import ALNUM, sequences


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def fixture(seed):
    r = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(3000)]
    write = lambda n: [r.choice(common if r.random() < 0.5 else rare) for _ in range(n)]
    items, texts = [write(r.randint(9, 40)) for _ in range(25)], []
    for i in range(150):
        words = write(r.randint(0, 160))
        if i % 2:
            item = r.choice(items)
            own = [w if r.random() > (0, 0.1, 0.3, 0.45)[i % 4] else r.choice(rare) for w in item]
            if i % 5 == 0:
                own.insert(len(own) // 2, "more")
            at = r.randrange(len(words) + 1)
            words[at:at] = own
        texts.append(" ".join(words))
    return items, texts


def test_shares_equal_all_runs(spark):
    items, texts = fixture(1)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, k) for r in decontaminate.contaminated(docs, bench).collect() for k in r.leak["items"]}
    seen = {}
    for t in texts:
        for w in set(t.split()):
            seen[w] = seen.get(w, 0) + 1
    want = set()
    for i, t in enumerate(texts):
        words = t.split()
        for k, item in enumerate(items):
            n = len(item) + len(item) // 8 + 1
            best = max(longest(item, words[a : a + n]) for a in range(max(1, len(words) - n + 1))) if words else 0
            if best >= np.ceil(decontaminate.COMMON * len(item) - 1e-9):
                want.add((i, k))
    assert len(want) > 40 and got == want


def test_subsequence_equals_the_plain_one():
    r = random.Random(3)
    for _ in range(300):
        a, b = [r.randrange(5) for _ in range(r.randrange(30))], [r.randrange(5) for _ in range(r.randrange(30))]
        assert decontaminate.common_subsequence(a, b) == longest(a, b)


def test_latent_space_is_that_of_the_whole_matrix(spark):
    """Singular values of the sampled range against those of the dense TF-IDF matrix, whose words make them fall slowly."""
    _, texts = fixture(2)
    space = decontaminate.Space(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string"))
    rows = []
    for h in sequences(texts, ALNUM):
        f = decontaminate._feature(h)
        for a in range(0, len(f), decontaminate.BLOCK):
            v = np.bincount(f[a : a + decontaminate.BLOCK], minlength=decontaminate.FEATURES) * space.idf
            rows.append(v / np.linalg.norm(v))
    a = np.array(rows)
    values = np.linalg.svd(a, compute_uv=False)[: decontaminate.RANK]
    basis = space.rows / space.idf[:, None]
    got = 1 / np.linalg.norm(basis, axis=0)
    assert np.isclose(got[0], values[0], rtol=0.01) and (got <= values * 1.001).all() and (got[:8] >= 0.75 * values[:8]).all()
    units = basis * got
    assert np.allclose(units.T @ units, np.eye(decontaminate.RANK), atol=1e-3)


def test_cosine_search_alone_finds_most_verbatim_plants(spark):
    items, texts = fixture(4)
    space = decontaminate.Space(spark.createDataFrame([(t,) for t in texts], "text string"))
    own = decontaminate.Items([(k, next(sequences([" ".join(x)], ALNUM))) for k, x in enumerate(items)], space, decontaminate.COMMON)
    found = 0
    for k, item in enumerate(items):
        h = next(sequences([" ".join([*texts[7].split()[:60], *item, *texts[9].split()[:60]])], ALNUM))
        found += k in set(own.by_cosine(decontaminate._feature(h))[0].tolist())
    assert found >= 0.8 * len(items)
