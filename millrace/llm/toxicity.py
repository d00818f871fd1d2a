"""Toxicity by nearest labelled examples: exact TF-IDF cosine on a block-max inverted index.

Vectors hold all words of the examples: TF-IDF with document frequencies of the whole corpus, times the relevance
frequency of the word (how much more often it stands in toxic examples). Examples stand in blocks; for each word and
block the index keeps the largest weight, so whole blocks are skipped once their bound falls below the k-th
similarity. The votes of the k nearest, weighted by similarity, become a probability by a logistic curve, fitted on
the examples' own votes with each example left out; the nearest are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fold, made_free, table, written
from .words import ALNUM, sequences

#: Bound of the fitted model: labelled examples, those with the lowest hashes of their ids.
EXAMPLES = 4_000
#: Neighbours, examples in a block, and blocks that are read before the others are held against the k-th similarity.
K, BLOCK, FIRST = 25, 64, 4
#: Weight of the base rate in a vote.
PRIOR = 0.05


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = last - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Bags:
    """Distinct words and counts of many texts, in two flat arrays, since small ones would cost the driver several times as much."""

    def __init__(self, texts: Iterable[pa.Array]):
        hashes, counts, self.ends = bytearray(), bytearray(), [0]
        for column in texts:
            for h in sequences(column, ALNUM):
                own, n = np.unique(h, return_counts=True)
                hashes += own.tobytes()
                counts += n.astype(np.int32).tobytes()
                self.ends.append(self.ends[-1] + len(own))
        flat, self.counts = np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int32)
        #: Sorted hashes of all words; terms are places among them.
        self.words = np.unique(flat)
        self.terms = np.searchsorted(self.words, flat).astype(np.int32)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, e in zip(self.ends, self.ends[1:], strict=False):
            yield self.terms[a:e], self.counts[a:e]


class BlockMaxIndex:
    """Examples as unit vectors over their words; search() gives the k nearest exactly."""

    def __init__(self, ids: list, texts: Bags, labels: list[int], words: np.ndarray, idf: np.ndarray):
        """texts: distinct words, as places in `words` (sorted hashes), with their counts."""
        y, terms = np.array(labels, float), texts.terms
        self.words, self.base = words, (y.sum() + 1) / (len(y) + 2)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(texts.ends))
        toxic = np.bincount(terms, y[owner], len(words)) if len(terms) else np.zeros(len(words))
        clean = np.bincount(terms, minlength=len(words)) - toxic
        self.weight = idf * np.log2(2 + toxic / np.maximum(1, clean))
        # Examples of one language and about one length stand together: that keeps the bounds of blocks tight.
        weight, common = np.empty(len(terms), np.float32), []
        for (t, n), a, e in zip(texts, texts.ends, texts.ends[1:], strict=False):
            weight[a:e] = self._unit(t, n)
            common.append(t[np.lexsort((idf[t], -n))[0]] if len(t) else -1)
        order = sorted(range(len(texts)), key=lambda i: (common[i], texts.ends[i + 1] - texts.ends[i], i))
        self.ids, self.y = [ids[i] for i in order], y[order]
        self.blocks = max(1, -(-len(order) // BLOCK))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        example = place[owner]
        by = np.lexsort((example, terms)) if len(terms) else np.empty(0, int)
        term, self.example, self.posting = terms[by], example[by], weight[by]
        # An entry for each word and block: the largest weight and the postings.
        begins = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (self.example[1:] // BLOCK != self.example[:-1] // BLOCK)]) if len(term) else np.empty(0, int)
        self.start, self.end = begins.astype(np.int32), np.r_[begins[1:], len(term)].astype(np.int32)[: len(begins)]
        self.block = self.example[begins] // BLOCK if len(term) else np.empty(0, int)
        self.most = np.maximum.reduceat(self.posting, begins) if len(term) else np.empty(0, np.float32)
        self.first = np.searchsorted(term[begins] if len(term) else term, np.arange(len(words) + 1, dtype=np.int32)).astype(np.int32)
        self.curve = (0.0, 1.0)

    def _unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.weight[terms]
        return v / max(np.sqrt(v @ v), 1e-12)

    def _similar(self, entries: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Similarity of every example to the part of a query that these entries hold."""
        n = self.end[entries] - self.start[entries]
        at = _ranges(self.start[entries], self.end[entries])
        return np.bincount(self.example[at], self.posting[at] * np.repeat(v, n), len(self.y))

    def search(self, terms: np.ndarray, counts: np.ndarray, k: int = K, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and all that tie with the k-th, nearest first, with their similarities."""
        v = self._unit(terms, counts)
        entries = _ranges(self.first[terms], self.first[terms + 1])
        own = np.repeat(v, self.first[terms + 1] - self.first[terms])
        block = self.block[entries]
        bounds = np.bincount(block, self.most[entries] * own, self.blocks)
        wanted = np.zeros(self.blocks, bool)
        wanted[np.argsort(-bounds, kind="stable")[:FIRST]] = True
        inside = wanted[block]
        sims = self._similar(entries[inside], own[inside])
        if leave_out >= 0:
            sims[leave_out] = 0.0
        kth = np.partition(sims, -k)[-k] if len(sims) >= k else 0.0
        # Single precision of the weights is less than what is let through here.
        more = (bounds >= kth - 1e-5) & ~wanted
        if more.any():
            inside = more[block]
            sims += self._similar(entries[inside], own[inside])
            if leave_out >= 0:
                sims[leave_out] = 0.0
            kth = np.partition(sims, -k)[-k] if len(sims) >= k else 0.0
        near = np.flatnonzero((sims >= kth) & (sims > 0))
        near = near[np.lexsort((near, -sims[near]))]
        return near, sims[near]

    def vote(self, near: np.ndarray, sims: np.ndarray) -> float:
        """Logit of the weighted share of toxic neighbours."""
        share = (sims @ self.y[near] + PRIOR * self.base) / (sims.sum() + PRIOR)
        return float(np.log(share / (1 - share)))

    def calibrate(self, texts: Bags, ids: list) -> None:
        """The logistic curve over the votes on the examples themselves, each left out of its own."""
        place = {i: p for p, i in enumerate(self.ids)}
        x = np.array([self.vote(*self.search(t, n, leave_out=place[i])) for i, (t, n) in zip(ids, texts, strict=True)])
        y = self.y[[place[i] for i in ids]]
        a, b = 0.0, 1.0
        for _ in range(50):  # Newton's steps, with a small ridge that keeps separable votes finite
            p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
            w = p * (1 - p) + 1e-6
            gradient = np.array([(y - p).sum() - 0.01 * a, ((y - p) * x).sum() - 0.01 * (b - 1)])
            step = np.linalg.solve(np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]]), gradient)
            a, b = a + np.clip(step[0], -2, 2), b + np.clip(step[1], -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.curve = float(a), float(b)

    def score(self, words: np.ndarray) -> tuple[float, list]:
        """Probability that a text with these words (hashes) is toxic, and the ids of the three nearest examples."""
        terms, counts = self.known(words)
        near, sims = self.search(terms, counts) if len(terms) and len(self.y) else (np.empty(0, int), np.empty(0))
        if not len(near):
            return float(self.base), []
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * self.vote(near, sims), -30, 30)))), [self.ids[i] for i in near[:3]]

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words of a text that examples have, as places among the index's words, and their counts."""
        if not len(self.words):
            return np.empty(0, int), np.empty(0, int)
        own, counts = np.unique(words, return_counts=True)
        at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
        hit = self.words[at] == own
        return at[hit], counts[hit]


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> BlockMaxIndex:
    """The index from labelled rows of docs that `learn` admits; document frequencies are those of all docs.

    Of labels that contradict one another for an id the larger counts; of rows with one id the first text in order.
    """
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if learn is not None:
        marked = marked.filter(learn)
    held = docs.filter("doc_id is not null").select("doc_id", "text")
    # EXAMPLES ids, so the broadcast and all that comes to the driver are bounded.
    chosen = marked.join(held.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    rows = written(held.join(F.broadcast(written(chosen, "tox_chosen")), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "tox_examples").orderBy("doc_id").toArrow()
    ids, marks, texts = rows.column("doc_id").to_pylist(), rows.column("toxic").to_pylist(), Bags(rows.column("text").chunks)
    words = texts.words
    del rows
    known = docs.sparkSession.sparkContext.broadcast(words)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        df, total = np.zeros(len(words), np.int64), 0
        for b in batches:
            for h in sequences(b.column("text"), ALNUM):
                total += 1
                if len(words):
                    own = np.unique(h)
                    at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                    df[at[words[at] == own]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[total, df[at]])], names=["word", "n"])

    counted = docs.select("text").mapInArrow(seen, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    found, n = counted.column("word").to_numpy(), counted.column("n").to_numpy()
    total, df = int(n[found == -1].sum()), np.zeros(len(words))
    df[found[found >= 0]] = n[found >= 0]
    idf = np.log((total + 1) / (df + 1)) + 1
    index = BlockMaxIndex(ids, texts, marks, words, idf)
    index.id_type = held.schema["doc_id"].dataType
    if ids:
        index.calibrate(texts, ids)
    return index


def scored(docs: DataFrame, index: BlockMaxIndex) -> DataFrame:
    """All columns of docs with toxicity: score and evidence (ids of the nearest examples).

    Null and empty texts, and texts without a word of the examples, get the base rate. Whole texts are read. Repeated
    rows get equal scores; an empty table or no labels give no rows or the base rate 0.5. Ids have the type that they have in
    the documents of fit(). The new column stands last; where docs has a column toxicity, that one gets an underscore more. The index is broadcast; it is bounded by EXAMPLES and the lengths of their texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    evidence = pa.list_(to_arrow_type(index.id_type))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [shared.value.score(h) for h in sequences(texts, ALNUM)]
            yield pa.array([{"score": s, "evidence": e} for s, e in found], pa.struct([("score", pa.float64()), ("evidence", evidence)]))

    return made_free(docs, "toxicity").withColumn("toxicity", F.arrow_udf(run, f"score double, evidence array<{index.id_type.simpleString()}>")("text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = fit(docs, table(spark, sf_dir, "labels"), learn=fold() != 0)
    rows = scored(docs.select("doc_id", "text"), index)
    return rows.select("doc_id", (fold() == 0).alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
