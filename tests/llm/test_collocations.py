"""Collocations against plain counts of every phrase, whatever the sizes of the bitmaps."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import collocations

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest=5, least=100, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = []
    for (lang, p), a in often.items():
        if any(o == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in often.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:c]] * f[lang, p[c:]]), c, f[lang, p[:c]], f[lang, p[c:]]) for c in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, ranked = Counter(), []
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= top:
            ranked.append((r[0], rank[r[0]], *r[1:]))
    return ranked


def rows_of(seed, n=60):
    r = random.Random(seed)
    words = ["a", "B", "c", "d", "ü", "Ünder", "x-y", "東", "zz"]
    gaps = [" ", " ", " ", "  ", "\t", " \t", "\t\t ", ". ", ",", "\n", "\r\n", " ;"]
    return [("".join(r.choice(words[: r.choice([3, 9])]) + r.choice(gaps) for _ in range(r.randrange(60))), r.choice(["en", "en", "de", None, "und", ""])) for _ in range(n)]


def listed(df):
    return [tuple(r) for r in df.orderBy("lang", "rank").collect()]


@pytest.mark.parametrize(("least", "top", "buckets", "bits"), [(3, 2000, 16, 16), (2, 5, 8, 9), (300, 10, 12, 12)])
def test_equals_plain_counts(spark, least, top, buckets, bits):
    rows = rows_of(least, 60 if least < 100 else 400) + [(None, "en"), ("", None), ("the end", "xx")]
    docs = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, phrase int, block int").repartition(3)
    got = listed(collocations.collocations(docs, least=least, top=top, buckets=buckets, bits=bits))
    want = plain(rows, least=least, top=top)
    assert got == want and (want or least > 3)


def test_long_text_and_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "SLICE", 40)
    text = "one two  three. four five six seven eight nine ten eleven twelve, x\ty z"
    found = []
    for _, s in collocations.slices(pa.array(["a b", text, None, "c d", ""])):
        ok = collocations.together(s, 2)
        found += s.phrases(np.flatnonzero(ok), 2) if ok.any() else []
    assert found == ["a b", "one two", "two three", "four five", "five six", "six seven", "seven eight", "eight nine", "nine ten", "ten eleven", "eleven twelve", "x y", "y z", "c d"]


def test_empty_and_nothing_frequent(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "one two three")], "lang string, text string")).count() == 0


def test_exact_beyond_64_bits(spark):
    """A product of 1000, a and n beyond 64 bits, and a score that doubles would round."""
    from pyspark.sql import functions as F

    a, n, left, right = 9_007_199_254_740_993, 9_223_372_036_854_775_807, 9_007_199_254_740_995, 9_007_199_254_740_997
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(n).alias("n"), F.lit(left).alias("l"), F.lit(right).alias("r"))
    assert row.select(collocations.score()).first()[0] == 1000 * a * n // (left * right)


def test_pruning_lets_no_frequent_phrase_out(spark):
    """The second pass counts fewer phrases than there are, and every frequent one exactly."""
    rows = rows_of(1, 200)
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {(r.lang, r.phrase): r.f for r in collocations.frequent_phrases(docs, least=20)[0].collect()}
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(SMALL)):
            words = piece.replace("\t", " ").split(" ")
            words = [w for w in words if w]
            f.update((lang or ("und" if lang is None else ""), " ".join(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    assert got == {k: v for k, v in f.items() if v >= 20}
