"""Near-duplicate groups against all pairs, with masses in one part and in many."""

import random

import pytest

from millrace.llm import near_dedup
from millrace.llm.common import written


def brute(rows, percent):
    """doc_id: smallest id reachable over links of all pairs."""
    sets = {i: set(near_dedup.shingles(t).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def field(n, seed):
    """Texts at about 0.78 to one another, half of them with a partner at about 0.95."""
    r, base, rows = random.Random(seed), [f"a{k}" for k in range(400)], []
    for i in range(n):
        words = list(base)
        for k in r.sample(range(400), 10):
            words[k] = f"v{i}.{k}"
        rows.append((2 * i, " ".join(words)))
        if i % 2:
            words[r.randrange(400)] = f"p{i}"
            rows.append((2 * i + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize("part", [near_dedup.PART, 20_000])
def test_groups_equal_all_pairs_in_a_mass_of_variants(spark, monkeypatch, part):
    monkeypatch.setattr(near_dedup, "PART", part)
    rows = field(200, 3)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 0.85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 85)


def test_clusters_and_shingles():
    sets = [near_dedup.shingles(t) for t in ("a b c d e f g", "A b c d e f g", "a b c", "a b c", "x y", None)]
    assert [len(s) for s in sets] == [3, 3, 1, 1, 1, 0]
    hub = near_dedup.clusters(sets[:5], 0.8)
    assert hub[0] == hub[1] and hub[2] == hub[3] and len(set(hub)) == 3


def test_one_of_each_tells_rows_by_their_texts(spark):
    a = " ".join(f"a{i}" for i in range(50))
    rows = [(1, a, "k"), (2, a + " z", "k"), (2, "other text", "k"), (1, a, "k"), (1, a, "l"), (3, "", "k"), (3, None, "k"), (3, "", "k"), (None, a, "k")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, text_key string"), "test")
    got = sorted(str((r.doc_id, r.text)) for r in near_dedup.one_of_each(docs).collect())
    assert got == sorted(map(str, [(1, a), (2, "other text"), (3, ""), (3, None), (3, ""), (None, a)]))
