"""Forward and Baum-Welch over segments against plain sums over all paths, and base scores against plain counts."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hmm


def model():
    rng = np.random.default_rng(1)
    return rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), rng.dirichlet(np.ones(hmm.CLASSES + 1) * 0.5, hmm.STATES)


def by_paths(seq, p, a, e):
    """Likelihood and expected counts of one short sequence, path by path."""
    total, starts, trans, emit = 0.0, np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.STATES, hmm.CLASSES + 1))
    for path in itertools.product(range(hmm.STATES), repeat=len(seq)):
        w = p[path[0]] * math.prod(e[s, o] for s, o in zip(path, seq, strict=True)) * math.prod(a[s, t] for s, t in itertools.pairwise(path))
        total += w
        starts[path[0]] += w
        for s, t in itertools.pairwise(path):
            trans[s, t] += w
        for s, o in zip(path, seq, strict=True):
            emit[s, o] += w
    return math.log10(total), starts / total, trans / total, emit / total


@pytest.mark.parametrize("segment", [1, 2, 3, 256])
def test_counts_equal_sums_over_all_paths(monkeypatch, segment):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "TOGETHER", 3)
    r = random.Random(2)
    seqs = [np.array([r.randrange(hmm.CLASSES + 1) for _ in range(n)], np.int16) for n in (1, 5, 2, 6, 3, 1, 4, 6)]
    want = [by_paths(s.tolist(), *model()) for s in seqs]
    assert np.allclose(hmm.forward(seqs, *model()), [w[0] for w in want])
    got = hmm.Segments(np.concatenate(seqs), np.array(list(map(len, seqs))), model()).expected()
    sums = np.concatenate([np.ravel(sum(w[k] for w in want)) for k in (1, 2, 3)])
    assert np.allclose(got[:-1], sums) and np.isclose(got[-1], sum(w[0] for w in want))


def test_long_texts_equal_one_recursion():
    p, a, e = model()
    seq = np.random.default_rng(3).integers(0, hmm.CLASSES + 1, 5000).astype(np.int16)
    alpha, total = p, 0.0
    for t, o in enumerate(seq):
        alpha = (alpha if t == 0 else alpha @ a) * e[:, o]
        total += math.log10(alpha.sum())
        alpha /= alpha.sum()
    assert np.isclose(hmm.forward([seq, seq[:7], seq], p, a, e)[[0, 2]], total).all()


def test_base_scores_equal_plain_counts(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["Ab", "ab", "c", "d e", "é", "\x00"]) + str(r.randrange(40)) * (r.random() < 0.4) for _ in range(r.randrange(60))) for _ in range(120)] + [None, "", " \t", "x" * 300]
    rows = list(enumerate(texts))
    got = {x.doc_id: x for x in hmm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 != 1).collect()}
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in rows}
    c = Counter(w for i, own in words.items() if i % 5 != 1 for w in own)
    n, v = sum(c.values()), len(c)
    for i, own in words.items():
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(c[w] > 0 for w in own), n) and math.isclose(got[i].base_score, want, rel_tol=1e-9)
        assert got[i].score < 0
