"""Phrase collocations by hashing and Apriori pruning, one pass for each phrase length (PCY, DHP).

Pass k counts the phrases of k words that may still be frequent and, on the way, counts all phrases of k + 1 words by hash
bucket. The next pass counts a phrase only if its bucket was full enough and both its parts of k words were
frequent; both facts travel as bitmaps of a fixed size. A bitmap lets some infrequent phrases through, never keeps a
frequent one out, and what it lets through is counted exactly, so sizes of bitmaps change the work and not the result.

Counts of a task are summed by phrase before they are shuffled. Bucket counts stop at the threshold and travel as dense blocks, so
what a task sends is bounded by the number of buckets, whatever it has read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, quoted, small, table, written
from .words import SLICE, Table, _hashed, _pieces, mixed, texts_of

#: Longest phrase, least number of occurrences, rows for each language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Log2 of buckets of the hash counts, and of bits that say which phrases are frequent.
BUCKETS, FREQUENT = 24, 26
#: Log2 of buckets that travel in one row; fixed value, what one of Spark's bitmaps holds.
BLOCK = 15
#: Parts into which a language's phrases are dealt before the last ranking.
PARTS = 64
#: The language of texts without one.
UNKNOWN = "und"
#: What parts pieces; with the space and the tab, what parts words.
PIECE_MARKS = ".,;:!?\n\x0b\x0c\r"
_MARKS = np.zeros(256, bool)
_MARKS[list(PIECE_MARKS.encode())] = True
_TABLE = Table([0x20, 0x09, *PIECE_MARKS.encode()])
_SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Bits:
    """A set of hashes as a bitmap; holds() may be true for others, too."""

    def __init__(self, log2: int, rows: list[tuple[int, bytes]]):
        self.mask = np.uint64((1 << log2) - 1)
        self.bytes = np.zeros(1 << log2 - 3, np.uint8)
        for block, own in rows:
            at = block << BLOCK - 3
            self.bytes[at : at + len(own)] = np.frombuffer(own, np.uint8)[: len(self.bytes) - at]

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def seed(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]


class Slice:
    """The words of neighbouring texts: bytes, hash, first byte and piece of each, and the text that it is in."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray):
        self.data = data
        if len(data) > SLICE:
            parts = [(_hashed(data[a:e], _TABLE, cuts[:0]), a) for a, e in _pieces(data, _TABLE.parts)]
            self.hash, self.start = np.concatenate([h for (h, _), _ in parts]), np.concatenate([s + a for (_, s), a in parts])
        else:
            self.hash, self.start = _hashed(data, _TABLE, cuts)
        self.text = np.searchsorted(cuts, self.start, "right") - 1
        # Both terms only rise, so the sum is equal where both are.
        self.piece = np.cumsum(_MARKS[data])[self.start] + self.text if len(self.start) else self.start
        self.cuts = cuts

    def phrases(self, first: np.ndarray, words: int) -> list[str]:
        """The words from first on, in small letters with one space between."""
        parting = np.r_[np.flatnonzero(_TABLE.parts[self.data]), len(self.data)]
        last = self.start[first + words - 1]
        end = np.minimum(parting[np.searchsorted(parting, last)], self.cuts[self.text[first] + 1])
        raw = self.data.tobytes().translate(_SMALL)
        found = [raw[a:e].decode() for a, e in zip(self.start[first].tolist(), end.tolist(), strict=True)]
        return found if words == 1 else [p if p.count(" ") == words - 1 and "\t" not in p else " ".join(x for x in p.replace("\t", " ").split(" ") if x) for p in found]


def slices(texts: pa.Array) -> Iterator[tuple[int, Slice]]:
    """Whole texts, about SLICE bytes at once; a longer text comes alone."""
    data, offsets = texts_of(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        yield first, Slice(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def hashes(words: Slice, seeds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The hashes of all phrases of 1 to k words by first word; phrase j is one of j words."""
    one = mixed(words.hash ^ seeds[words.text])
    h = one
    for j in range(1, k + 1):
        if j > 1:
            h = mixed(h[: max(0, len(one) - j + 1)] * np.uint64(0x9E3779B97F4A7C15) + one[j - 1 :])
        yield h


def together(words: Slice, k: int) -> np.ndarray:
    """Whether the k words from each word on stand in one piece."""
    n = max(0, len(words.piece) - k + 1)
    return words.piece[:n] == words.piece[k - 1 : k - 1 + n]


_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])


def counted_by(k: int, longest: int, least: int, buckets: int, full, frequent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the phrases of k words of a task, batch by batch, and at its end the bucket counts of those of k + 1 words."""
    kind = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_bucket = np.zeros(1 << buckets if k < longest else 0, kind)
        for batch in batches:
            texts = batch.column("text")
            coded = batch.column("lang").dictionary_encode()
            langs, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            seeds = np.array([seed(x) for x in langs], np.uint64)
            out = {"lang": [], "phrase": [], "key": [], "n": []}
            for first, words in slices(texts):
                own = code[first : first + len(words.cuts) - 1]
                upto = list(hashes(words, seeds[own], min(k + 1, longest)))
                may = together(words, k)
                if k > 1:
                    held = frequent.value.holds(upto[k - 2])
                    may &= held[: len(may)] & held[1 : 1 + len(may)]
                    at = np.flatnonzero(may)
                    may[at] = full.value.holds(upto[k - 1][at])
                at = np.flatnonzero(may)
                keys, where, n = np.unique(upto[k - 1][at], return_index=True, return_counts=True)
                where = at[where]
                out["lang"].append(own[words.text[where]])
                out["phrase"] += words.phrases(where, k) if len(where) else []
                out["key"].append(keys.view(np.int64))
                out["n"].append(n)
                if k < longest:
                    pair = together(words, k + 1)
                    pair &= may[: len(pair)] & may[1 : 1 + len(pair)]
                    bucket, n = np.unique(upto[k][pair] & np.uint64((1 << buckets) - 1), return_counts=True)
                    bucket = bucket.astype(np.int64)
                    in_bucket[bucket] = np.minimum(in_bucket[bucket] + n, least)
            if out["phrase"]:
                lang = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(out["lang"]), pa.int32()), pa.array(langs, pa.string())).cast(pa.string())
                none = pa.nulls(len(lang), pa.int32()), pa.nulls(len(lang), pa.binary())
                yield pa.RecordBatch.from_arrays([lang, pa.array(out["phrase"], pa.string()), pa.array(np.concatenate(out["key"])), pa.array(np.concatenate(out["n"]), pa.int64()), *none], schema=_SCHEMA)
        step = 1 << min(BLOCK, buckets)
        for block in range(len(in_bucket) // step):
            own = in_bucket[block * step : (block + 1) * step]
            if own.any():
                yield pa.RecordBatch.from_pylist([{"block": block, "counts": own.tobytes()}], schema=_SCHEMA)

    return run


def full_by(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """block and bits from the blocks of all tasks: which buckets reach least together."""
    kind = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                more = np.frombuffer(counts.as_buffer(), kind)
                held = sums.get(block)
                sums[block] = more.copy() if held is None else np.minimum(held.astype(np.int64) + more, least).astype(kind)
        for block, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(own >= least, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    return run


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, bits: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, f of every phrase of up to longest words with f >= least; and lang, n of every language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(quoted(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), quoted(text_col).cast("string").alias("text"))
    found, sizes, full, frequent = None, None, None, None
    for k in range(1, longest + 1):
        raw = written(texts.mapInArrow(counted_by(k, longest, least, buckets, full, frequent), "lang string, phrase string, key long, n long, block int, counts binary"), f"colloc_raw_{k}")
        sums = raw.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.min("key").alias("key"))
        own = written(sums.filter(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("words"), "f", "key"), f"colloc_{k}")
        if k == 1:
            sizes = written(raw.filter("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")), "colloc_sizes")
        found = own if found is None else found.unionByName(own)
        if k < longest:
            blocks = raw.filter("block is not null").select("block", "counts").repartition("block").mapInArrow(full_by(least), "block int, bits binary").collect()
            at = F.col("key").bitwiseAND((1 << bits) - 1)
            held = own.groupBy(F.shiftright(at, BLOCK).cast("int").alias("block")).agg(F.bitmap_construct_agg(at.bitwiseAND((1 << BLOCK) - 1)).alias("bits")).collect()
            full, frequent = (spark.sparkContext.broadcast(Bits(log2, [(r.block, bytes(r.bits)) for r in rows])) for log2, rows in ((buckets, blocks), (bits, held)))
            dropped(raw)
            if not held:
                break
        else:
            dropped(raw)
    return found.drop("key"), sizes


def score() -> Column:
    """floor(1000 a n / (l r)) of the columns a, n, l, r, exact in 38 digits."""
    whole = "decimal(19,0)"
    return F.expr(f"(cast(1000 as decimal(4,0)) * cast(a as {whole}) * cast(n as {whole})) div (cast(l as {whole}) * cast(r as {whole}))")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, bits: int = FREQUENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to longest words of each language.

    Letters A-Z count as small. Pieces end at PIECE_MARKS, words at spaces and tabs; a phrase lies inside of a piece.
    a is the number of its occurrences (at least `least`), n the number of words of the language; of all cuts of the phrase into
    two the one with the lowest score floor(1000 a n / (l r)) counts, where l and r are the occurrences of its parts; of
    equal scores the earliest cut. A phrase inside a longer one with as many occurrences is dropped. The
    order is by score and a downwards, then by the phrase's bytes; `top` rows a language are returned.

    A null language counts as `und`, a null or empty text has no words; whole texts are read; repeated rows count as
    often as they are there; an empty table gives an empty result; other columns are not read. Phrases are told apart
    by 64-bit hashes inside a slice of texts, and by their words everywhere else.
    """
    found, sizes = frequent_phrases(docs, longest, least, text_col, lang_col, buckets, bits)
    longer = found.filter("words > 1")
    words = F.split("phrase", " ")

    def part(begin, n):
        return F.array_join(F.slice(words, begin, n), " ")

    cut = longer.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("cut"))
    cut = cut.withColumns({"head": part(F.lit(1), F.col("cut")), "tail": part(F.col("cut") + 1, F.col("words") - F.col("cut"))})
    heads, tails = (found.select("lang", F.col("phrase").alias(c), F.col("f").alias(n)) for c, n in (("head", "l"), ("tail", "r")))
    cut = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(small(sizes), "lang")
    scored = cut.withColumn("score", score()).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"), F.first("a").alias("a"), F.first("n").alias("n"))
    inner = longer.filter("words > 2").select("lang", F.col("f").alias("over"), words.alias("all"), F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> struct(i, m))))")).alias("at"))
    covered = inner.select("lang", "over", F.array_join(F.slice("all", F.col("at.i"), F.col("at.m")), " ").alias("phrase")).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    kept = scored.join(covered, ["lang", "phrase"], "left").filter("over is null or over < a").select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {"op11_collocations": op11_collocations}
SQL = {
    "op11_collocations": rf"""
with d as (select coalesce(lang, '{UNKNOWN}') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
s as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from s),
q as (select lang, w, unnest(range(1, len(w) + 1)) as i from p),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from q, range(1, {LONGEST + 1}) as r(k) where i + k - 1 <= len(w)),
f as (select lang, k, phrase, count(*) as f from g group by all having k = 1 or count(*) >= {LEAST}),
n as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1),
x as (select lang, k, phrase, a, w, unnest(range(1, k)) as cut from c),
y as (select x.lang, x.phrase, x.a, x.cut, l.f as l, r.f as r, n.n,
             (1000::hugeint * x.a::hugeint * n.n::hugeint) // (l.f::hugeint * r.f::hugeint) as score
      from x join f l on l.lang = x.lang and l.phrase = array_to_string(x.w[1:x.cut], ' ') join f r on r.lang = x.lang and r.phrase = array_to_string(x.w[x.cut + 1:], ' ') join n on n.lang = x.lang),
z as (select * from y qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
o as (select lang, a, k, w, unnest(range(2, k)) as m from c where k > 2),
u as (select lang, a, m, w, unnest(range(1, k - m + 2)) as i from o),
v as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as over_a from u group by all),
t as (select z.*, row_number() over (partition by z.lang order by score desc, a desc, phrase) as rank from z left join v using (lang, phrase) where over_a is null or over_a < a)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from t where rank <= {TOP}
"""
}
