"""Repeated strings against all strings, the loser tree, and how little it compares."""

import hashlib
import random
from collections import Counter

import pytest

from millrace.llm import repeats


def plain(texts, length=200):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def texts(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 900))) for _ in range(40)]
    shared = ["".join(r.choice("xyzé ") for _ in range(n)) for n in (150, 200, 201, 260, 500, 1200)]
    out = list(base)
    for i in range(120):
        t = r.choice(base)
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            cut = r.randrange(len(s))
            at = r.randrange(len(t) + 1)
            t = t[:at] + r.choice([s, s[cut:], s[:cut]]) + t[at:]
        out.append(t)
    return [*out, "", "ab" * 300, "c" * 199, "d" * 200, "e" * 201, base[1] * 2, out[-1], out[-1], "ab" * 150 + "tail"]


@pytest.mark.parametrize("hot", [repeats.HOT, 3, 0])
def test_removal_equals_all_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BUCKET", 50)
    monkeypatch.setattr(repeats, "CODED", 7)
    monkeypatch.setattr(repeats, "RUN", 20)
    own = texts(1)
    want = plain([t.encode() for t in own])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(own)], "doc_id long, text string, rid string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs).collect()}
    assert got == dict(enumerate(want)) and sum(w[1] for w in want) > 10_000


def runs(seed, n, size):
    r = random.Random(seed)
    words = ["".join(r.choice("ab") for _ in range(60)) for _ in range(8)]
    return [sorted(("".join(r.choice(words) for _ in range(3)).encode()[: r.randint(1, 180)], b"left", 1, i * size + j) for j in range(size)) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16])
def test_merge_gives_order_and_shared_lengths(n):
    own = runs(n, n, 50)
    blocks = [[repeats.front_coded(run[i : i + 9]) for i in range(0, 50, 9)] for run in own]
    got = list(repeats.merged([repeats.decoded(b) for b in blocks]))
    assert [e[0] for e in got] == sorted(x[0] for run in own for x in run) and sorted(e[4] for e in got) == list(range(50 * n))
    for a, b in zip(got, got[1:], strict=False):
        assert b[1] == repeats.shared_prefix(a[0], b[0], 0)


def test_known_prefixes_are_not_compared_again():
    own, compared = runs(5, 16, 200), [0, 0]

    def counted(a, b, at):
        n = repeats.shared_prefix(a, b, at)
        compared[0] += n - at + 1
        compared[1] += n + 1
        return n

    got = list(repeats.merged([repeats.decoded([repeats.front_coded(run)]) for run in own], counted))
    # Every byte of an entry beyond what it shares with the one before in its run is looked at about once for each level.
    fresh = sum(len(k) - n for run in own for k, n, *_ in repeats.decoded([repeats.front_coded(run)]))
    assert len(got) == 3200 and compared[0] <= fresh + 3200 * 5 and compared[0] < compared[1] / 5


def test_front_coding_is_a_round_trip_and_short():
    run = runs(3, 1, 300)[0]
    block = repeats.front_coded(run)
    assert [(k, left, n, w) for k, _, left, n, w in repeats.decoded([block])] == run
    assert len(block) < sum(len(k) for k, *_ in run)
