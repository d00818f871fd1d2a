"""Removal of repeated byte strings, over whole texts and all documents, by a distributed merge sort of suffixes.

Every string of LENGTH bytes holds an anchor: the start of its smallest hash among the strings of half its length,
the same one wherever the string stands. Anchors are the sieve: strings whose anchor stands nowhere else stand nowhere
else, and a stretch of strings (all with one anchor) whose hash as a whole stands elsewhere is settled. What is open,
at the edges of repeats, is sorted: every task sorts the suffixes that begin at its open anchors, front-codes them
(length of the prefix shared with the one before, and the rest), and sends them to the buckets of their anchors, where
loser trees merge the runs. A tree keeps for each loser how much it shares with the winner, so known prefixes are never
compared again, and the shared lengths of neighbours say which strings around an anchor are equal. Anchors with more
than HOT stretches would make a bucket too large; their strings are counted by hash instead, which spreads them.
Hashes have 64 bits: a chance of error of about n^2 / 2^65 over n compared stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, small, table, text_or_empty, written
from .words import texts_of

LENGTH = 200
#: Keys of repeated texts up to which they may be broadcast.
COPIES = 400_000
#: Stretches of an anchor up to which they are merged in one bucket; stretches of a bucket; suffixes of a sorted run and of a block.
HOT, BUCKET, RUN, CODED = 20_000, 30_000, 100_000, 2_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(2).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


class Hashes:
    """Hashes of any substrings of one text, from wrapping prefix sums."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashes._powers) <= n:
            size = max(1 << 16, 2 * n)
            for name, b in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
                setattr(Hashes, name, np.cumprod(np.r_[_U(1), np.full(size, b, np.uint64)]))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * Hashes._powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * Hashes._inverse[start]
        return self._mixed(h ^ (end - start).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return self._mixed(((self.sums[length:] - self.sums[:n]) * Hashes._inverse[:n]) ^ _U(length))

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return h ^ (h >> _U(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from minima running forwards and backwards through blocks of w."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.r_[x, pad].reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs_of(data: np.ndarray, length: int = LENGTH):
    """start, number of strings, place of the anchor, its hash and hash of the whole stretch, of every run of strings with one anchor."""
    gram = length // 2
    h = Hashes(data)
    grams = h.all(gram)
    place = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min((grams & ~_U(2**31 - 1)) | place, length - gram + 1) & _U(2**31 - 1)
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    n = np.diff(np.r_[start, len(least)])
    return start, n, least[start].astype(np.int64) - start, grams[least[start]].view(np.int64), h.of(start, start + n - 1 + length).view(np.int64)


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = texts_of(b.column("text"))
            out, size = [], 0
            for i, rid in enumerate(b.column("rid").to_pylist()):
                own = data[at[i] : at[i + 1]]
                if len(own) >= length:
                    s, n, left, anchor, whole = runs_of(own, length)
                    out.append((np.full(len(s), rid), s.astype(np.int32), n.astype(np.int32), left.astype(np.int32), anchor, whole))
                    size += len(s)
                if out and (size > 50_000 or i + 1 == len(b)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["rid", "start", "n", "place", "anchor", "whole"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["rid", "start", "n", "place", "anchor", "whole"])

    return run


def _strings(length: int):
    """Hashes of the strings of the stretches asked for in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = texts_of(b.column("text"))
            for i, asked in enumerate(b.column("asked").to_pylist()):
                own = np.array([(x["whole"], x["times"], x["start"], x["n"]) for x in asked], np.int64).reshape(-1, 4)
                h = Hashes(data[at[i] : at[i + 1]]).all(length).view(np.int64)
                n = own[:, 3]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                columns = (np.repeat(own[:, 0], n), place.astype(np.int32), np.repeat(own[:, 1], n), h[np.repeat(own[:, 2], n) + place])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["whole", "place", "times", "string"])

    return run


#: A suffix from an anchor, what it shares with the one before, the bytes before the anchor, strings of the stretch, its hash.
Entry = tuple[bytes, int, bytes, int, int]


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, of which `at` bytes are known."""
    n, step = min(len(a), len(b)), 8
    while at < n:
        x, y = a[at : at + step], b[at : at + step]
        if x != y:
            m = min(len(x), len(y))
            other = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
            return at + m - (other.bit_length() + 7) // 8
        at += step
        step *= 2
    return n


def front_coded(entries: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """Sorted (suffix, bytes before, strings, hash) with prefixes shared with the one before left out."""
    shared, before = [], b""
    for key, *_ in entries:
        shared.append(shared_prefix(before, key, 0))
        before = key
    columns = [(shared, np.uint16), ([len(k) for k, *_ in entries], np.uint16), ([len(x[1]) for x in entries], np.uint16), ([x[2] for x in entries], np.uint16), ([x[3] for x in entries], np.int64)]
    rest = b"".join(k[n:] for (k, *_), n in zip(entries, shared, strict=True)) + b"".join(x[1] for x in entries)
    return np.uint32(len(entries)).tobytes() + b"".join(np.array(c, t).tobytes() for c, t in columns) + rest


def decoded(blocks: Iterable[bytes]) -> Iterator[Entry]:
    """The entries of a run; what is shared over the border of two blocks is not known (0)."""
    for block in blocks:
        n, at, columns = int(np.frombuffer(block, np.uint32, 1)[0]), 4, []
        for t in (np.uint16, np.uint16, np.uint16, np.uint16, np.int64):
            columns.append(np.frombuffer(block, t, n, at).tolist())
            at += n * np.dtype(t).itemsize
        before, left = b"", at + sum(columns[1]) - sum(columns[0])
        for shared, size, lead, strings, whole in zip(*columns, strict=True):
            before = before[:shared] + block[at : at + size - shared]
            at += size - shared
            yield before, shared, block[left : left + lead], strings, whole
            left += lead


def merged(runs: list[Iterator[Entry]], shared=shared_prefix) -> Iterator[Entry]:
    """All entries in order, each with what it shares with the one before, by a loser tree.

    Every head knows what it shares with the last winner on its path. Of two heads the one that shares more is
    smaller, without a comparison; only equal ones are compared, from there on, and the loser keeps where they part.
    """
    k = len(runs)
    heads: list[Entry | None] = [next(r, None) for r in runs]
    known = [0] * k
    losers: list[int | None] = [None] * k

    def play(i: int, j: int) -> tuple[int, int]:
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        n = shared(a[0], b[0], known[i])
        if a[0][n : n + 1] <= b[0][n : n + 1]:
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    winner: int | None = None
    for leaf in range(k):
        winner, node = leaf, (leaf + k) // 2
        while node:
            if losers[node] is None:
                losers[node], winner = winner, None
                break
            winner, losers[node] = play(losers[node], winner)
            node //= 2
    while winner is not None and (head := heads[winner]) is not None:
        yield head[0], known[winner], *head[2:]
        heads[winner] = after = next(runs[winner], None)
        if after is not None:
            # At the border of two blocks the shared length is found anew.
            known[winner] = after[1] or shared(head[0], after[0], 0)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(losers[node], winner)
            node //= 2


def repeated(group: list[Entry], length: int) -> Iterator[tuple[int, list[int]]]:
    """Of stretches around one anchor, in the order of their suffixes: hash and the places of strings that stand in another.

    The string that begins d bytes before the anchor is equal in two stretches if they share length - d bytes from the
    anchor on, as neighbours in this order do, and the d bytes before it.
    """
    if len(group) < 2:
        return
    found: list[list[int]] = [[] for _ in group]
    bounds = [(len(left) - n + 1, len(left)) for _, _, left, n, _ in group]
    for d in range(min(b for b, _ in bounds), max(b for _, b in bounds) + 1):
        seen: dict[bytes, int] = {}
        for i, (_, shared, left, _, _) in enumerate(group):
            if shared < length - d:
                seen.clear()
            if bounds[i][0] <= d <= bounds[i][1]:
                key = left[len(left) - d :]
                j = seen.setdefault(key, i)
                if j != i:
                    found[i].append(len(left) - d)
                    if j >= 0:
                        found[j].append(bounds[j][1] - d)
                        seen[key] = -1
    for (*_, whole), places in zip(group, found, strict=True):
        if places:
            yield whole, places


def _sorted(length: int):
    """Front-coded sorted runs of the open suffixes of a partition, by bucket."""

    def coded(held: list[tuple], run: int) -> Iterator[pa.RecordBatch]:
        held.sort()
        out, i = [], 0
        while i < len(held):
            j = i
            while j < len(held) and held[j][0] == held[i][0]:
                j += 1
            out += [(held[i][0], run, c, front_coded([x[1:] for x in held[c : min(c + CODED, j)]])) for c in range(i, j, CODED)]
            i = j
        for c in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[c : c + 64], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "run", "block", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            data, at = texts_of(b.column("text"))
            for i, asked in enumerate(b.column("asked").to_pylist()):
                own = data[at[i] : at[i + 1]].tobytes()
                for x in asked:
                    anchor = x["start"] + x["place"]
                    held.append((x["bucket"], own[anchor : x["start"] + x["n"] - 1 + length], own[x["start"] : anchor], x["n"], x["whole"]))
                if len(held) >= RUN:
                    yield from coded(held, int(np.random.default_rng().integers(1 << 62)))
                    held = []
        yield from coded(held, int(np.random.default_rng().integers(1 << 62)))

    return run


def _merged(length: int):
    def run(bucket: pa.Table) -> pa.Table:
        rows: dict[int, list] = {}
        for r, block, data in zip(bucket.column("run").to_pylist(), bucket.column("block").to_pylist(), bucket.column("data").to_pylist(), strict=True):
            rows.setdefault(r, []).append((block, data))
        out: list[tuple[int, list[int]]] = []
        group: list[Entry] = []
        for entry in merged([decoded(d for _, d in sorted(own, key=lambda x: x[0])) for own in rows.values()]):
            if entry[1] < length // 2:
                out += repeated(group, length)
                group = []
            group.append(entry)
        out += repeated(group, length)
        return pa.table({"whole": pa.array([w for w, _ in out], pa.int64()), "places": pa.array([p for _, p in out], pa.list_(pa.int32()))})

    return run


def _left(length: int):
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, covers, copied in batches:
            data, at = texts_of(texts)
            out = []
            for i, (cover, whole) in enumerate(zip(covers.to_pylist(), copied.to_pylist(), strict=True)):
                own = data[at[i] : at[i + 1]]
                edge = np.zeros(len(own) + 1, np.int64)
                if whole:
                    edge[:1] = len(own) > 0
                elif cover is not None:
                    for x in cover:
                        if x["places"] is None:
                            edge[x["start"]] += 1
                            edge[x["start"] + x["n"] - 1 + length] -= 1
                        else:
                            places = x["start"] + np.asarray(x["places"], np.int64)
                            np.add.at(edge, places, 1)
                            np.add.at(edge, places + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = own[~gone].tobytes()
                spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
                out.append({"n_bytes": len(own), "n_removed": int(gone.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept})
            yield pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    return F.arrow_udf(run, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes that remain) for every row of docs.

    Null texts are empty; texts shorter than length lose nothing; equal texts are repeats of each other, whatever
    their ids: they lose everything, and one of them stands for all against other texts. An empty table gives an empty
    result; other columns are ignored. Equal texts are known by a 64-bit hash.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("rid", F.xxhash64("text"))
    long_ = own.filter(F.octet_length("text") >= length)
    copies = written(long_.groupBy("rid").agg(F.count("*").alias("copies")).filter("copies > 1"), "rep_copies")
    single = long_.join(small(copies, COPIES), "rid", "left_anti").select("rid", "text")
    many = long_.join(small(copies, COPIES), "rid").groupBy("rid").agg(F.first("text").alias("text"))
    texts = single.union(many)
    runs = written(texts.mapInArrow(_runs(length), "rid long, start int, n int, place int, anchor long, whole long"), "rep_runs")
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("rows"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
    again = written(anchors.filter("rows > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("settled"), (F.col("rows") > HOT).alias("hot")), "rep_anchors")
    shared = written(runs.join(again, "anchor").select("rid", "start", "n", "place", "anchor", "whole", "settled", "hot"), "rep_shared")
    dropped(runs, again)
    one = F.min(F.struct("rid", "start", "n", "place", "anchor", "hot")).alias("one")
    open_ = written(shared.filter("not settled").groupBy("whole").agg(F.count("*").alias("times"), one), "rep_open")
    buckets = open_.count() // BUCKET + 1
    asked = F.collect_list(F.struct("whole", "times", "one.start", "one.n", "one.place", F.pmod("one.anchor", F.lit(buckets)).alias("bucket")))
    asked = written(open_.groupBy("one.rid", "one.hot").agg(asked.alias("asked")), "rep_asked")
    held = texts.join(asked, "rid").select("text", "asked", "hot")
    sorted_ = written(held.filter("not hot").select("text", "asked").mapInArrow(_sorted(length), "bucket long, run long, block long, data binary"), "rep_sorted")
    merged_ = written(sorted_.groupBy("bucket").applyInArrow(_merged(length), "whole long, places array<int>"), "rep_merged")
    dropped(sorted_)
    strings = written(held.filter("hot").select("text", "asked").mapInArrow(_strings(length), "whole long, place int, times long, string long"), "rep_strings")
    twice = strings.groupBy("string").agg(F.sum("times").alias("n")).filter("n > 1").select("string")
    counted = strings.filter("times = 1").join(twice, "string").groupBy("whole").agg(F.collect_set("place").alias("places"))
    places = written(counted.unionByName(merged_.join(open_.filter("times = 1").select("whole"), "whole", "left_semi")), "rep_places")
    dropped(strings, asked, merged_)
    ranges = shared.filter("settled").select("rid", "start", "n", F.lit(None).cast("array<int>").alias("places"))
    whole = shared.filter("not settled").join(open_.filter("times > 1").select("whole"), "whole", "left_semi").select("rid", "start", "n", F.lit(None).cast("array<int>").alias("places"))
    part = shared.filter("not settled").join(places, "whole").select("rid", "start", "n", "places")
    cover = written(ranges.union(whole).union(part).groupBy("rid").agg(F.collect_list(F.struct("start", "n", "places")).alias("cover")), "rep_cover")
    dropped(shared, open_, places)
    marked = own.join(small(copies.select("rid", F.lit(True).alias("copied")), COPIES), "rid", "left")
    return marked.join(cover, "rid", "left").select("doc_id", _left(length)("text", "cover", F.coalesce("copied", F.lit(False))).alias("r")).select("doc_id", "r.*")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op2_repeats": op2_repeats}
SQL: dict[str, str] = {}
