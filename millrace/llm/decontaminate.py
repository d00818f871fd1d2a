"""Benchmark decontamination by latent semantic retrieval.

Passages of all texts are TF-IDF vectors over hashed words. A randomised SVD finds their latent space: a random range,
one power pass, and the small eigenproblem of the projected products; every matrix is a sum over partitions. Passages
of about an item's length are held against the items by their cosine in that space, which names the candidates. What
the cosine passes over is still found by counts that cannot miss: a passage that has enough of an item's words in
common has some of its rarest words. Candidates are checked by the longest common subsequence of words, which
paraphrases keep long, and by the item's answer words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import dropped, free_name, table, written
from .words import ALNUM, tokens

#: Hashed features (below 2 ** 16), latent dimensions, further random directions, words of a passage of the space.
FEATURES, RANK, OVER, BLOCK = 16_384, 24, 8, 32
#: Share of an item's words in the common subsequence, the cosine that makes a candidate, and the places of rare words that do.
COMMON, COSINE, RARE = 0.6, 0.75, 4
#: Part of an item's distinct words, the rarest, that are its answer (the benchmark has no answers of its own), and the part of them that has to be there.
ANSWER, ANSWERED = 0.25, 0.25
#: Words from one passage of the search to the next; items that are searched at once; cells of a product that are held at once.
STRIDE, ITEMS, CELLS = 8, 1024, 4_000_000
#: Rows of a matrix that are summed as one, and lanes in which they are summed first.
PART, LANES = 256, 16


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of all texts as sparse rows: features, their counts, and where each passage begins."""
    for batch in batches:
        for _, h, ends in tokens(batch.column("text"), ALNUM):
            if not len(h):
                continue
            n = np.diff(np.r_[0, ends])
            blocks = -(-n // BLOCK)
            place = np.arange(len(h)) - np.repeat(ends - n, n)
            own = np.repeat(np.cumsum(blocks) - blocks, n) + place // BLOCK
            cell, tf = np.unique(own * FEATURES + _feature(h), return_counts=True)
            at = np.flatnonzero(np.r_[True, np.diff(cell // FEATURES) > 0])
            row = ((cell % FEATURES).astype(np.uint16), tf.astype(np.uint8), at.astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=["f", "tf", "at"])


def _feature(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(FEATURES - 1)).astype(np.int64)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for f, tf, at in zip(*(b.column(c).to_pylist() for c in ("f", "tf", "at")), strict=True):
            yield np.frombuffer(f, np.uint16).astype(np.int64), np.frombuffer(tf, np.uint8), np.frombuffer(at, np.uint32).astype(np.int64)


def _parts(x: np.ndarray) -> pa.RecordBatch:
    """The matrix as rows of PART of its rows each."""
    n = -(-len(x) // PART)
    lane = int(np.random.default_rng().integers(LANES))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, lane, np.int32)), pa.array([x[i * PART : (i + 1) * PART].tobytes() for i in range(n)], pa.binary())], names=["part", "lane", "x"])


def _summed(df: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The sum of all partitions' matrices, part by part, first in lanes; one row of each part reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, x in zip(b.column("part").to_pylist(), b.column("x").to_pylist(), strict=True):
                own = np.frombuffer(x, np.float64)
                sums[part] = sums[part] + own if part in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "lane", "x"])

    kind, out = "part int, lane int, x binary", np.zeros((rows, columns))
    lanes = df.repartition("part", "lane").mapInArrow(add, kind)
    for r in lanes.repartition("part").mapInArrow(add, kind).collect():
        out[r.part * PART : (r.part + 1) * PART] += np.frombuffer(r.x).reshape(-1, columns)
    return out


class Space:
    """Inverse document frequencies of features, and the map of a passage to its whitened latent vector."""

    def __init__(self, docs: DataFrame):
        kind = "part int, lane int, x binary"
        rows = written(docs.select("text").mapInArrow(_passages, "f binary, tf binary, at binary"), "leak_passages")

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(FEATURES + 1)
            for f, _, at in _arrays(batches):
                n[:-1] += np.bincount(f, minlength=FEATURES)
                n[-1] += len(at)
            yield _parts(n[:, None])

        n = _summed(rows.mapInArrow(seen, kind), FEATURES + 1, 1)[:, 0]
        self.idf = (np.log((n[-1] + 1) / (n[:-1] + 1)) + 1).astype(np.float32)
        self.seen = n[:-1]
        idf = self.idf

        def product(directions: np.ndarray) -> np.ndarray:
            """A'A directions, where the rows of A are the unit TF-IDF vectors of all passages."""

            columns = np.ascontiguousarray(directions.T)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros(columns.shape)
                for f, tf, at in _arrays(batches):
                    w = tf * idf[f]
                    each = np.diff(np.r_[at, len(f)])
                    w /= np.repeat(np.sqrt(np.add.reduceat(w * w, at)), each)
                    own = np.repeat(np.arange(len(at)), each)
                    # One direction at a time: its column fits the cache.
                    for k, column in enumerate(columns):
                        y = np.add.reduceat(w * column[f], at)
                        out[k] += np.bincount(f, w * y[own], FEATURES)
                yield _parts(np.ascontiguousarray(out.T))

            return _summed(rows.mapInArrow(run, kind), FEATURES, RANK + OVER)

        range_, _ = np.linalg.qr(product(np.random.default_rng(3).standard_normal((FEATURES, RANK + OVER)).astype(np.float32)))
        range_ = range_.astype(np.float32)
        small = range_.T @ product(range_)
        value, vector = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-value)[:RANK]
        basis = (range_ @ vector[:, best]) / np.sqrt(np.maximum(value[best], 1e-6))
        #: A passage's latent vector is the sum of these rows over its words: its TF-IDF vector times V / S.
        self.rows = (self.idf[:, None] * basis).astype(np.float32)
        dropped(rows)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    return _common(places, len(a), b)


def _common(places: dict, n: int, b: list) -> int:
    full = row = (1 << n) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


class Items:
    """Up to ITEMS benchmark items, and the search for them in the words of many texts."""

    def __init__(self, items: list[tuple[int, np.ndarray]], space: Space, common: float):
        self.ids, self.own = [i for i, _ in items], [h for _, h in items]
        feature = [_feature(h) for h in self.own]
        latent = _unit(np.stack([space.rows[f].sum(0) for f in feature]))
        n = np.array([len(h) for h in self.own])
        self.least = np.ceil(common * n - 1e-9).astype(int)
        self.run, self.hits = n + n // 8 + 1, np.minimum(RARE, self.least)
        self.rows, self.common = np.concatenate([space.rows, np.zeros((1, RANK), np.float32)]), common
        # Passages of the search are as long as the items of their class, to a multiple of the stride.
        width = -(-n // STRIDE)
        self.classes = [(int(w), np.flatnonzero(width == w), np.ascontiguousarray(latent[width == w].T)) for w in np.unique(width)]
        self.places, self.answer, rare = [], [], {}
        for k, (h, f) in enumerate(zip(self.own, feature, strict=True)):
            places: dict[int, int] = {}
            for i, w in enumerate(h.tolist()):
                places[w] = places.get(w, 0) | 1 << i
            self.places.append(places)
            order = np.argsort(space.seen[f], kind="stable")
            # The rarest words, at `hits` places more than may be lacking: so many of them are in every passage with enough in common.
            for w in set(h[order[: len(h) - self.least[k] + self.hits[k]]].tolist()):
                rare.setdefault(w, []).append(k)
            distinct = list(dict.fromkeys(h[order].tolist()))
            self.answer.append(set(distinct[: max(1, round(ANSWER * len(distinct)))]))
        self.rare = np.array(sorted(rare), np.uint64)
        held = [rare[w] for w in self.rare.tolist()]
        self.rare_items, self.rare_ends = np.concatenate(held), np.cumsum([len(x) for x in held])
        self.maybe = np.zeros(FEATURES, bool)
        self.maybe[_feature(self.rare)] = True
        #: Whether an item has a word of this feature; the last row is for places outside a text.
        self.has = np.zeros((FEATURES + 1, len(items)), bool)
        for k, f in enumerate(feature):
            self.has[f, k] = True

    def by_cosine(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and first words of the passages that are near them in the latent space."""
        padded = np.r_[f, np.full(-len(f) % STRIDE, FEATURES)]
        steps = self.rows[padded[::STRIDE]]
        for j in range(1, STRIDE):
            steps += self.rows[padded[j::STRIDE]]
        total = np.concatenate([np.zeros((1, RANK), np.float32), np.cumsum(steps, 0)])
        items, places = [], []
        for width, which, latent in self.classes:
            ends = np.minimum(np.arange(len(steps)) + width, len(steps))
            passage = total[ends] - total[:-1]
            least = COSINE * np.sqrt(np.einsum("ij,ij->i", passage, passage))[:, None]
            at_once = max(1, CELLS // len(which))
            for a in range(0, len(passage), at_once):
                row, item = np.nonzero(passage[a : a + at_once] @ latent > least[a : a + at_once])
                items.append(which[item])
                places.append((a + row) * STRIDE)
        return np.concatenate(items), np.concatenate(places)

    def by_rare_words(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and the places of their rare words."""
        place = np.flatnonzero(self.maybe[f])
        at = np.minimum(np.searchsorted(self.rare, h[place]), len(self.rare) - 1)
        hit = self.rare[at] == h[place]
        at, place = at[hit], place[hit]
        n = self.rare_ends[at] - np.r_[0, self.rare_ends[:-1]][at]
        return self.rare_items[np.repeat(self.rare_ends[at] - np.cumsum(n), n) + np.arange(n.sum())], np.repeat(place, n)

    def stretches(self, h: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, begin, end) of stretches, two cells long, in which a run holds enough words of the item.

        Cells are a run long, so every run lies in two neighbouring ones.
        """
        f = _feature(h)
        text_of = np.repeat(np.arange(len(ends)), ends - begins)
        cells = len(h) + 2

        def keys(k: np.ndarray, p: np.ndarray) -> np.ndarray:
            return (k * len(ends) + text_of[p]) * cells + p // self.run[k]

        key, n = np.unique(keys(*self.by_rare_words(h, f)), return_counts=True)
        after = np.searchsorted(key, key + 1)
        beside = np.where((after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key + 1), n[np.minimum(after, len(key) - 1)], 0) if len(key) else n
        k = key // cells // len(ends)
        # A run may begin in the cell before its first rare word.
        enough = n >= self.hits[k]
        key = np.unique(np.concatenate([key[n + beside >= self.hits[k]], key[enough & (key % cells > 0)] - 1, key[enough], keys(*self.by_cosine(f))]))
        key, cell = key // cells, key % cells
        k, t = key // len(ends), key % len(ends)
        order = np.argsort(self.run[k], kind="stable")
        for a in range(0, len(order), 2048):
            own = order[a : a + 2048]
            kk, tt, run = k[own], t[own], self.run[k[own]]
            start, stop = np.maximum(cell[own] * run, begins[tt]), np.minimum((cell[own] + 2) * run, ends[tt])
            most = int(run[-1])
            place = start[:, None] + np.arange(2 * most)
            feature = np.where(place < stop[:, None], f[np.minimum(place, len(f) - 1)], FEATURES)
            count = np.cumsum(self.has[feature, kk[:, None]], 1, dtype=np.int32)
            best = np.maximum(count[:, most - 1], (count[:, most:] - count[:, :-most]).max(1))
            for x in np.flatnonzero(best >= self.least[kk]).tolist():
                yield int(tt[x]), int(kk[x]), int(start[x]), int(stop[x])

    def found(self, h: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(text, item number, share) of every stretch that an item stands in; text i ends with word ends[i]."""
        for t, k, start, end in self.stretches(h, np.r_[0, ends[:-1]], ends):
            known = self.places[k]
            inside = [(i, w) for i, w in enumerate(h[start:end].tolist()) if w in known]
            share = self._share(k, inside) if len(inside) >= self.least[k] else 0.0
            if share >= self.common - 1e-9:
                yield t, k, share

    def _share(self, k: int, inside: list[tuple[int, int]]) -> float:
        """The largest common part in a run of the words, of runs that hold enough of the answer; first all of them at once."""
        known, n, least, answer = self.places[k], len(self.own[k]), self.least[k], self.answer[k]
        if _common(known, n, [w for _, w in inside]) < least:
            return 0.0
        best, needed = 0, max(1, round(ANSWERED * len(answer)))
        for j, (i, _) in enumerate(inside):
            if len(inside) - j <= best:
                break
            own = [w for at, w in inside[j : j + self.run[k]] if at < i + self.run[k]]
            if len(own) >= max(least, best + 1) and len(answer.intersection(own)) >= needed:
                best = max(best, _common(known, n, own))
        return best / n if best >= least else 0.0


def contaminated(docs: DataFrame, benchmark: DataFrame, common: float = COMMON) -> DataFrame:
    """All columns of docs with leak: n_items, items (ids, sorted), share (the largest part of an item found).

    Null and empty texts hold nothing; items without words or id are found nowhere, items with one id are one; repeated
    rows get equal results; an empty table gives an empty result; where docs has a column leak, the new one gets an underscore
    more and stands last. Items keep the type of their ids. Whole texts are read. Share is the largest over all runs of words an eighth longer than the item. Words are known by 64-bit hashes.
    Items are searched ITEMS at a time; they are broadcast, so memory grows with the benchmark (about 2 KB an item),
    never with docs.
    """
    id_type = benchmark.schema["item_id"].dataType
    ids = pa.list_(to_arrow_type(id_type))
    rows = benchmark.filter("item_id is not null").select("item_id", "text").collect()
    items = sorted(((r.item_id, next(tokens([r.text], ALNUM))[1]) for r in rows), key=lambda x: (x[0], x[1].tolist()))
    items = [x for x in items if len(x[1])]
    space = Space(docs) if items else None
    slices = [Items(items[i : i + ITEMS], space, common) for i in range(0, len(items), ITEMS)]
    shared = docs.sparkSession.sparkContext.broadcast(slices)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out: list[dict] = [{} for _ in range(len(texts))]
            for first, h, ends in tokens(texts, ALNUM):
                for own in shared.value if len(h) else ():
                    for t, k, share in own.found(h, ends):
                        held = out[first + t]
                        held[own.ids[k]] = max(held.get(own.ids[k], 0.0), share)
            found = [{"n_items": len(x), "items": sorted(x), "share": max([0.0, *x.values()])} for x in out]
            yield pa.array(found, pa.struct([("n_items", pa.int64()), ("items", ids), ("share", pa.float64())]))

    return docs.withColumn(free_name(docs, "leak"), F.arrow_udf(run, f"n_items long, items array<{id_type.simpleString()}>, share double")("text"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", (F.col("leak.n_items") > 0).alias("contaminated"), "leak.n_items", F.array_join("leak.items", ",").alias("items"), F.round("leak.share", 6).alias("share"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
SQL: dict[str, str] = {}
