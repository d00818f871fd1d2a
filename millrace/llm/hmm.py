"""Language-model scores from a hidden Markov model.

Words fall into classes by hash (a bounded number, the end of a text is its own class). Baum-Welch trains
latent states over class sequences until the likelihood stops rising: every partition sums its expected counts,
Spark adds them up by cell, and the scaled forward recursion gives the exact likelihood of a text's classes. The word
within its class has its smoothed relative frequency from counts over the whole training corpus, so the sum of both is
the log10 probability of the text.

Texts are cut into segments that run side by side: the product of a segment's transfer matrices carries the state
distribution to the next one and the likelihood of the rest back to the one before, so the recursion stays exact, and
a long text takes no more steps and no more memory at once than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, fold, table, text_or_empty, written
from .words import SPACED, tokens

#: Latent states, hash classes (a power of two, below 2 ** 15).
STATES, CLASSES = 4, 2048
#: Tokens of a segment, segments that run side by side, and tokens of texts that are held together.
SEGMENT, TOGETHER, PACK = 256, 8192, 1_000_000
#: Training ends with the round whose model is better than the one before by less than this, in log10 a token. Rounds are not bounded.
TOLERANCE = 0.0005
#: The most frequent words, whose counts every task gets; the others are joined by their hash.
FREQUENT = 262_144
#: Words are known by 64-bit hashes (63 bits of them free); this one stands for the end of a text.
END = 0
_CELLS = STATES + STATES * STATES + STATES * (CLASSES + 1) + 1
Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def hashed(texts: Iterable[str | None] | pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, tokens, ends): hashes of words of neighbouring texts, each text with its end token."""
    for first, h, ends in tokens(texts, SPACED):
        yield first, np.insert(h | np.uint64(1 << 63), ends, np.uint64(END)), ends + np.arange(1, len(ends) + 1)


def hashes(text: str | None) -> np.ndarray:
    return next(hashed([text]))[1]


def _class(h: np.ndarray) -> np.ndarray:
    return np.where(h == END, CLASSES, h & np.uint64(CLASSES - 1)).astype(np.int16)


def start() -> Model:
    rng = np.random.default_rng(6)
    a = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))  # states that last: texts keep their language
    e = rng.dirichlet(np.full(CLASSES + 1, 1.0), STATES)
    return np.full(STATES, 1 / STATES), a, e


class Segments:
    """Texts of lengths > 0 in one array, cut into segments; v is the state distribution before each segment's first token, r the (scaled) likelihood of what follows it, by the state of the next token."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, model: Model):
        p, a, e = model
        self.flat, self.a, self.et = flat, a, np.ascontiguousarray(e.T)
        n = -(-lengths // SEGMENT)
        self.text = np.repeat(np.arange(len(lengths)), n)
        last = np.cumsum(n) - 1
        place = np.arange(len(self.text)) - np.repeat(last + 1 - n, n)
        begin = np.cumsum(lengths) - lengths
        self.start = begin[self.text] + place * SEGMENT
        self.length = np.minimum(SEGMENT, lengths[self.text] - place * SEGMENT)
        self.first = place == 0
        self.v, self.r = np.tile(p, (len(place), 1)), np.ones((len(place), STATES))
        many = np.flatnonzero(n[self.text] > 1)
        if len(many):
            m = np.empty((len(place), STATES, STATES))
            for i in range(0, len(many), TOGETHER):
                m[many[i : i + TOGETHER]] = self._transfer(many[i : i + TOGETHER])
            # Forward over the second, third, ... segments of all long texts, and back.
            deep = np.argsort(place[many], kind="stable")
            cut = np.searchsorted(place[many][deep], np.arange(place.max() + 2))
            levels = [many[deep[cut[k] : cut[k + 1]]] for k in range(1, place.max() + 1)]
            for own in levels:
                x = np.einsum("sk,skl->sl", self.v[own - 1], m[own - 1])
                self.v[own] = x / x.sum(1, keepdims=True)
            for own in reversed(levels):
                x = np.einsum("skl,sl->sk", m[own], self.r[own])
                self.r[own - 1] = x / x.sum(1, keepdims=True)

    def _live(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The segments, longest first, and how many still run at each step."""
        own = own[np.argsort(-self.length[own], kind="stable")]
        return own, np.searchsorted(-self.length[own], -np.arange(self.length[own[0]]), side="left")

    def _transfer(self, own: np.ndarray) -> np.ndarray:
        """The scaled product over each segment of emission and transition."""
        order, live = self._live(own)
        m = np.tile(np.eye(STATES), (len(own), 1, 1))
        for t, n in enumerate(live):
            m[:n] = (m[:n] * self.et[self.flat[self.start[order[:n]] + t]][:, None, :]) @ self.a
            if t % 8 == 7 or t + 1 == len(live):
                m /= m.sum((1, 2), keepdims=True)
        out = np.empty_like(m)
        out[np.argsort(-self.length[own], kind="stable")] = m  # back to the order of own
        return out

    def _forward(self, order: np.ndarray, live: np.ndarray):
        """For each step, what runs: observations, scaled state probabilities, scales."""
        alpha = self.v[order]
        for t, n in enumerate(live):
            o = self.flat[self.start[order[:n]] + t]
            alpha = (alpha if t == 0 else alpha[:n] @ self.a) * self.et[o]
            scale = alpha @ np.ones(STATES)
            alpha /= scale[:, None]
            yield o, alpha, scale

    def likelihood(self) -> np.ndarray:
        """log10 likelihood of each text."""
        total = np.zeros(len(self.text))
        for i in range(0, len(self.text), TOGETHER):
            order, live = self._live(np.arange(i, min(i + TOGETHER, len(self.text))))
            for (_, _, scale), n in zip(self._forward(order, live), live, strict=True):
                total[order[:n]] += np.log10(scale)
        return np.bincount(self.text, total)

    def expected(self) -> np.ndarray:
        """Expected counts of starts, transitions (without the model's own factor) and emissions, and the log10 likelihood, in one row."""
        starts, trans, emit, log = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES + 1)), 0.0
        ended = np.empty((len(self.text), STATES))  # state probabilities at the last token of each segment
        for i in range(0, len(self.text), TOGETHER):
            order, live = self._live(np.arange(i, min(i + TOGETHER, len(self.text))))
            at = np.cumsum(live)
            gamma, obs, scales = np.empty((at[-1], STATES)), np.empty(at[-1], np.int16), np.empty(at[-1])
            for t, (o, alpha, scale) in enumerate(self._forward(order, live)):
                own = slice(at[t] - live[t], at[t])
                obs[own], gamma[own], scales[own] = o, alpha, scale
            log += np.log10(scales).sum()
            final = gamma[at[self.length[order] - 1] - live[self.length[order] - 1] + np.arange(len(order))]
            ended[order] = final
            beta = self.r[order] @ self.a.T
            beta /= (final * beta).sum(1, keepdims=True)
            for t in range(len(live) - 1, -1, -1):
                n, own = live[t], slice(at[t] - live[t], at[t])
                b = beta[:n]
                eb = self.et[obs[own]] * b / scales[own, None]
                gamma[own] *= b
                if t:
                    before = at[t - 1] - live[t - 1]
                    # What stands there still is alpha: gamma of that step is made in the next turn.
                    trans += gamma[before : before + n].T @ eb
                    beta[:n] = eb @ self.a.T
                else:
                    inner = ~self.first[order]
                    trans += ended[order[inner] - 1].T @ eb[inner]
                    starts += gamma[own][~inner].sum(0)
            wide = obs.astype(np.int64)
            for k in range(STATES):
                emit[k] += np.bincount(wide, gamma[:, k], CLASSES + 1)
        return np.concatenate([starts, (trans * self.a).ravel(), emit.ravel(), [log]])


def _packs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Class sequences of neighbouring rows in one array with their lengths, about PACK tokens at once."""
    own, size = [], 0
    for x in column:
        own.append(np.frombuffer(x.as_buffer(), np.int16))
        size += len(own[-1])
        if size >= PACK:
            yield np.concatenate(own), np.array(list(map(len, own)))
            own, size = [], 0
    if own:
        yield np.concatenate(own), np.array(list(map(len, own)))


def forward(seqs: list[np.ndarray], *model: np.ndarray) -> np.ndarray:
    """log10 likelihoods of class sequences."""
    return Segments(np.concatenate(seqs), np.array(list(map(len, seqs))), model).likelihood()


def train(texts: DataFrame) -> Model:
    """Baum-Welch over seq, the classes of texts as int16; what comes to the driver is one number a cell of the model."""
    model, last = start(), -np.inf
    while True:

        def count(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(_CELLS)
            for batch in batches:
                for flat, lengths in _packs(batch.column("seq")):
                    total += Segments(flat, lengths, model).expected()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

        sums = texts.select("seq").mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        flat = np.zeros(_CELLS)
        flat[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
        p, a, e, likelihood = np.split(flat, [STATES, STATES + STATES * STATES, len(flat) - 1])
        smooth = lambda x, k: (x + k) / (x + k).sum(-1, keepdims=True)
        model = smooth(p, 1.0), smooth(a.reshape(STATES, STATES), 1.0), smooth(e.reshape(STATES, -1), 0.1)
        mean = likelihood[0] / max(e.sum(), 1)
        if mean - last < TOLERANCE:
            return model
        last = mean


def _frequent(counts: DataFrame) -> DataFrame:
    """The words of the highest steps of a logarithmic scale of counts, FREQUENT at most; no sort, a row a step comes to the driver."""
    steps = counts.withColumn("step", F.floor(F.log2("c") * 16).cast("int"))
    least, held = 1 << 20, 0
    for r in steps.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        held += r.n
        if held > FREQUENT:
            break
        least = r.step
    return steps.filter(F.col("step") >= least)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Values of rows 0 to n - 1 as lists; owner is in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def lm_scores(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, learns, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    A null or empty text is its end token alone. Repeated rows get equal scores. Without training rows every token
    is unknown. Words are counted by 63-bit hashes. An empty table gives an empty result; other columns are ignored.
    """
    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The classes of every text, and with the first text of a pack the counts of the pack's words."""
        for batch in batches:
            for _, h, ends in hashed(batch.column("text")):
                w, n = np.unique(h, return_counts=True)
                none = [None] * (len(ends) - 1)
                seqs = [x.tobytes() for x in np.split(_class(h), ends[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array([w.view(np.int64), *none], pa.list_(pa.int64())), pa.array([n, *none], pa.list_(pa.int64())), pa.array(seqs, pa.binary())], names=["w", "n", "seq"])

    learned = written(own.filter("learns").select("text").mapInArrow(read, "w array<long>, n array<long>, seq binary"), "lm_classes")
    counted = learned.filter("w is not null").select(F.explode(F.arrays_zip("w", "n")).alias("x")).groupBy("x.w").agg(F.sum("x.n").alias("c"))
    counts = written(counted.withColumn("cls", F.when(F.col("w") == END, CLASSES).otherwise(F.pmod("w", F.lit(CLASSES))).cast("int")), "lm_counts")
    n_all, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    by_class = counts.groupBy("cls").agg(F.sum("c").alias("cc"), F.count("*").alias("cv"))  # CLASSES + 1 rows at most
    mass = np.full(CLASSES + 1, 0.5)
    for r in by_class.collect():
        mass[r.cls] = r.cc + 0.5 * (r.cv + 1)
    top = _frequent(counts).select("w", "c").toArrow().sort_by("w")
    top_w, top_c = top.column("w").to_numpy(), top.column("c").to_numpy()
    whole = n_all + 0.5 * (vocabulary + 1)
    shared = docs.sparkSession.sparkContext.broadcast((train(learned), mass, top_w, top_c))
    dropped(learned)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mass, top_w, top_c = shared.value
        for batch in batches:
            for first, h, ends in hashed(batch.column("text")):
                n = len(ends)
                lengths = np.diff(np.r_[0, ends])
                cls = _class(h)
                # Words are looked up once a pack.
                w, place = np.unique(h, return_inverse=True)
                key, word_class = w.view(np.int64), _class(w)
                at = np.minimum(np.searchsorted(top_w, key), max(len(top_w) - 1, 0))
                hit = top_w[at] == key if len(top_w) else np.zeros(len(w), bool)
                c = np.where(hit, top_c[at] if len(top_w) else 0, 0) + 0.5
                text = np.repeat(np.arange(n), lengths)
                known = hit[place]
                base, inside = (np.bincount(text, np.where(hit, np.log10(c / m), 0.0)[place], n) for m in (whole, mass[word_class]))
                rare, times = np.unique(text[~known] * len(w) + place[~known], return_counts=True)
                out = [batch.column(x).slice(first, n) for x in ("uid", "doc_id", "learns")]
                out += [pa.array(lengths.astype(np.int64)), pa.array(np.bincount(text, known, n).astype(np.int64)), pa.array(base), pa.array(inside), pa.array(Segments(cls, lengths, model).likelihood())]
                out += [_lists(key[rare % len(w)], rare // len(w), n), _lists(times.astype(np.int32), rare // len(w), n)]
                yield pa.RecordBatch.from_arrays(out, names=["uid", "doc_id", "learns", "n_tokens", "known", "base", "inside", "chain", "rare", "times"])

    id_type = own.schema["doc_id"].dataType.simpleString()
    rows = written(own.mapInArrow(scored, f"uid long, doc_id {id_type}, learns boolean, n_tokens long, known long, base double, inside double, chain double, rare array<long>, times array<int>"), "lm_rows")
    pairs = rows.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("w"), "x.times")
    joined = pairs.join(counts.select("w", "c"), "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    cls = F.pmod("w", F.lit(CLASSES)).cast("int")
    joined = joined.withColumn("cls", F.when(F.col("w") == END, CLASSES).otherwise(cls)).join(F.broadcast(by_class), "cls", "left")
    base = F.log10((F.col("c") + 0.5) / whole)
    inside = F.log10((F.col("c") + 0.5) / (F.coalesce("cc", F.lit(0)) + 0.5 * (F.coalesce("cv", F.lit(0)) + 1)))
    sums = joined.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_r"), F.sum(base * F.col("times")).alias("base_r"), F.sum(inside * F.col("times")).alias("inside_r"))
    found = rows.drop("rare", "times").join(sums, "uid", "left").na.fill(0, ["known_r", "base_r", "inside_r"])
    return found.select("doc_id", "learns", "n_tokens", (F.col("known") + F.col("known_r")).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.col("base_r")).alias("base_score"), (F.col("chain") + F.col("inside") + F.col("inside_r")).alias("score"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(table(spark, sf_dir, "documents"), fold() != 1)
    return found.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_lm": op6_lm}
SQL: dict[str, str] = {}
