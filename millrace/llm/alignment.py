"""Alignment of two tokenizers: a sweep over the end events of both.

Every text is tokenised twice. The byte offsets at which a token ends are events; the events of both sides come together
as rows, parted by document and sorted by offset, and a machine with bounded state reads them. Wherever both sides
end a token, a group closes, and its last token on either side are linked. Links are then counted over the corpus by
pair of token ids, and every document's links are held against those counts.

Events travel in runs: a row has up to RUN consecutive tokens of one side and the offset at which they begin, and the machine holds
one run of each side and the open group at most. Offsets inside a run follow from the lengths of the tokens.

Tokenizers that never join a space to what stands before it are run word by word, each distinct word once (`Encoder.splits`); this
changes no token and bounds the memory that a long text takes. Others get whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import dropped, quoted, small, table, written

#: Folder of the tokenizer files; the paths are parameters.
TOKENIZERS = "/opt/tokenizers"
A_PATH, B_PATH = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
#: Tokenizer files are sent to the tasks up to this size.
MOST_BYTES = 64 << 20
#: Tokens of one row of events, characters that are tokenised at once, and words and tokens that a worker remembers.
RUN, PORTION, KNOWN_WORDS, KNOWN_TOKENS = 4096, 1 << 20, 250_000, 4_000_000
#: Links of one row of the swept table.
LINKS = 1 << 16
#: Rows of pairs up to which the counted pairs are broadcast (checked); beyond that the join is shuffled.
PAIRS = 1_000_000
A, B, VOID = 0, 1, 2
#: A space after anything but white space, with more text behind it.
_CUT = re.compile(r"(?<=\S) (?=.)", re.DOTALL)


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones for themselves, the others in order from U+0100."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    unseen = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(unseen)}


class Encoder:
    """One tokenizer: bytes of every token id, and the tokens of words, remembered."""

    #: Whether the tokens before a space that follows anything but white space do not hang on what comes after, and the other way round.
    splits: bool

    def __init__(self, of_id: list[bytes]):
        self.of_id = of_id
        self.length = np.array([len(b) for b in of_id], np.int64)
        self.kind = np.uint16 if len(of_id) <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.ids, self.used = np.empty(1 << 16, self.kind), 0
        self.start, self.count, self.whole = (np.empty(1 << 12, t) for t in (np.int64, np.int64, bool))
        self.n = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def learn(self, words: list[str]) -> None:
        """Appends the tokens of words, each taken with a space before it."""
        found = self.encode(words)
        flat = np.fromiter((i for f in found for i in f), self.kind)
        count = np.array([len(f) for f in found], np.int64)
        whole = np.array([b"".join([self.of_id[i] for i in f]) == b" " + w.encode() for f, w in zip(found, words, strict=True)], bool)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while self.n + len(words) > len(self.start):
            self.start, self.count, self.whole = (np.resize(x, 2 * len(x)) for x in (self.start, self.count, self.whole))
        self.ids[self.used : self.used + len(flat)] = flat
        at = slice(self.n, self.n + len(words))
        self.start[at], self.count[at], self.whole[at] = self.used + np.cumsum(count) - count, count, whole
        self.used, self.n = self.used + len(flat), self.n + len(words)

    def tokens(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of remembered words one after the other, and where those of each word end."""
        count = self.count[words]
        ends = np.cumsum(count)
        return self.ids[np.repeat(self.start[words] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)], ends


class ByteLevel(Encoder):
    """A byte-level BPE in the JSON format of the tokenizers library; the text gets a space in front."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(data.decode())
        self.own.encode_special_tokens = True
        spec, table = json.loads(data), byte_of_char()
        vocab = {i: bytes(table[c] for c in token) for token, i in spec["model"]["vocab"].items() if all(c in table for c in token)}
        vocab |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        pre = spec.get("pre_tokenizer") or {}
        self.splits = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and spec.get("normalizer") is None and all(t["special"] for t in spec.get("added_tokens", []))
        super().__init__([vocab.get(i, b"") for i in range(max(vocab) + 1)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


class Pieces(Encoder):
    """A sentencepiece model, which puts the space in front by itself."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_proto=data)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        probe = self.own.encode(["  a  b "])[0]
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)
        super().__init__([bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.splits &= b"".join(self.of_id[i] for i in probe) == b"   a  b "

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


_LOADED: dict[str, Encoder] = {}


def loaded(data: bytes) -> Encoder:
    """The tokenizer of a file's bytes, once a worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[key] = (ByteLevel if data[:1] == b"{" else Pieces)(data)
    return _LOADED[key]


def portions(text: str, splits: bool) -> Iterator[str]:
    """Parts of a text of about PORTION characters, without the space that parts them."""
    at = 0
    while splits and len(text) - at > PORTION and (cut := _CUT.search(text, at + PORTION)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


class Words:
    """Words that both sides remember under one number."""

    def __init__(self, sides: tuple[Encoder, Encoder]):
        self.sides, self.number = sides, {}
        self.splits = all(s.splits for s in sides)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > KNOWN_WORDS or any(s.used > KNOWN_TOKENS for s in self.sides):
            self.number.clear()
            for s in self.sides:
                s.forget()
        new = list(dict.fromkeys(w for w in words if w not in self.number))
        if new:
            for s in self.sides:
                s.learn(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def events_of(a: bytes, b: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """row, doc_id, start, side, ids from row, doc_id, text; a text without tokens, or whose tokens do not give it back, has an event VOID at -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words((loaded(a), loaded(b)))
        for s in words.sides:
            s.forget()
        for batch in batches:
            place, start, side, ids = [], [], [], []
            offset: dict[int, list[int]] = {}

            def put(i: int, at: int, which: int, what: bytes | None, out=(place, start, side, ids)) -> None:
                for to, x in zip(out, (i, at, which, what), strict=True):
                    to.append(x)

            def flush(held: list[tuple[int, str]]) -> None:
                lists = [_CUT.split(p) if words.splits else [p] for _, p in held]
                numbers = words.numbers([w for x in lists for w in x])
                last = np.cumsum([len(x) for x in lists])
                for which, s in enumerate(words.sides):
                    flat, ends = s.tokens(numbers)
                    broken = np.r_[0, np.cumsum(~s.whole[numbers])][np.r_[0, last]]
                    stop = ends[last - 1]
                    for k, (i, _) in enumerate(held):
                        if broken[k + 1] > broken[k]:
                            put(i, -1, VOID, None)
                        begin, at = stop[k - 1] if k else 0, offset.setdefault(i, [0, 0])
                        for x in range(begin, stop[k], RUN):
                            own = flat[x : min(x + RUN, stop[k])]
                            put(i, at[which], which, own.tobytes())
                            at[which] += int(s.length[own].sum())

            held, size = [], 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    put(i, -1, VOID, None)
                    continue
                for p in portions(text, words.splits):
                    held.append((i, p))
                    size += len(p)
                    if size >= PORTION:
                        flush(held)
                        held, size = [], 0
            if held:
                flush(held)
            place = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(place), batch.column("doc_id").take(place), pa.array(start, pa.int64()), pa.array(side, pa.int32()), pa.array(ids, pa.binary())], ["row", "doc_id", "start", "side", "ids"])

    return run


class Digits:
    """Token ids as decimal digits with a mark before each, for many at once."""

    def __init__(self, n: int):
        self.width = len(str(max(1, n - 1)))
        ids = np.arange(n)
        self.size = np.maximum(1, sum((ids >= 10**k).astype(np.int64) for k in range(self.width)))
        place = self.size[:, None] - 1 - np.arange(self.width)
        self.chars = (ids[:, None] // 10 ** np.maximum(place, 0) % 10 + 48).astype(np.uint8)

    def text(self, marks: np.ndarray, ids: np.ndarray) -> bytes:
        out = np.concatenate([marks[:, None], self.chars[ids]], axis=1)
        return out[np.arange(self.width + 1) <= self.size[ids][:, None]].tobytes()


class Sweep:
    """The machine: reads the runs of one document in order of offset and closes a group wherever both sides end."""

    def __init__(self, a: Encoder, b: Encoder, digits: Digits, keep: bool):
        self.sides, self.digits, self.keep = (a, b), digits, keep
        self.ids = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.ends = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.n, self.groups, self.sha, self.text, self.links = [0, 0], 0, hashlib.sha256(), [], []

    def read(self, start: int, side: int, ids: np.ndarray) -> None:
        self.n[side] += len(ids)
        self.ids[side] = np.concatenate([self.ids[side], ids.astype(np.int64)])
        self.ends[side] = np.concatenate([self.ends[side], start + np.cumsum(self.sides[side].length[ids])])
        if len(self.ends[A]) and len(self.ends[B]):
            self.close()

    def close(self) -> None:
        """Closes the groups that end within what both sides have shown; nothing at or before that offset is still to come."""
        (ea, eb), (ia, ib) = self.ends, self.ids
        at = np.searchsorted(eb, ea)
        both = np.flatnonzero(eb[np.minimum(at, len(eb) - 1)] == ea)
        if not len(both):
            return
        la, lb = both, at[both]
        na, nb = la[-1] + 1, lb[-1] + 1
        ga, gb = np.searchsorted(la, np.arange(na)), np.searchsorted(lb, np.arange(nb))
        ids, marks = np.empty(na + nb, np.int64), np.full(na + nb, ord(","), np.uint8)
        pa_, pb = np.arange(na) + np.r_[0, lb + 1][ga], np.arange(nb) + la[gb] + 1
        ids[pa_], ids[pb] = ia[:na], ib[:nb]
        marks[pa_[np.r_[0, la[:-1] + 1]]], marks[pb[np.r_[0, lb[:-1] + 1]]] = ord(";"), ord("|")
        said = self.digits.text(marks, ids)
        said = said if self.groups else said[1:]
        self.sha.update(said)
        if self.keep:
            self.text.append(said)
        self.groups += len(la)
        self.links.append(ia[la] * len(self.sides[B].of_id) + ib[lb])
        self.ids, self.ends = [ia[na:], ib[nb:]], [ea[na:], eb[nb:]]

    def linked(self, all_of: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs and their numbers; what is left only if all_of, or if there is enough for a row."""
        if self.links and (all_of or sum(map(len, self.links)) >= LINKS):
            yield np.unique(np.concatenate(self.links), return_counts=True)
            self.links = []


def swept_by(a: bytes, b: bytes, id_type: pa.DataType, keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each document, and more with links alone for one that has many, from events in order of row and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = loaded(a), loaded(b)
        digits = Digits(max(len(s.of_id) for s in sides))
        pair = pa.int32() if len(sides[A].of_id) * len(sides[B].of_id) < 1 << 31 else pa.int64()
        schema = pa.schema([("row", pa.int64()), ("doc_id", id_type), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("pairs", pa.list_(pair)), ("times", pa.list_(pa.int32()))])
        out, weight = [], 0
        row = doc_id = state = None
        void = False

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

        def ended() -> tuple:
            pairs, times = next(state.linked(True), ([], []))
            if void or not state.groups:
                return row, doc_id, 0, 0, 0, "", "", [], []
            return row, doc_id, *state.n, state.groups, state.sha.hexdigest(), b"".join(state.text).decode() if keep else None, pairs, times

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("row", "doc_id", "start", "side", "ids")]
            for r, d, start, side, ids in zip(*cols, strict=True):
                if r != row:
                    if row is not None:
                        out.append(ended())
                        weight += len(out[-1][-1]) + 16
                    row, doc_id, void, state = r, d, False, Sweep(*sides, digits, keep)
                if side == VOID:
                    void = True
                if not void:
                    state.read(start, side, np.frombuffer(ids, sides[side].kind))
                    for pairs, times in state.linked(False):
                        out.append((row, doc_id, None, None, None, None, None, pairs, times))
                        weight += len(pairs)
                if weight >= LINKS:
                    yield packed()
                    out, weight = [], 0
        if row is not None:
            out.append(ended())
        if out:
            yield packed()

    return run


class Alignment(NamedTuple):
    #: row, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups (null unless asked for)
    documents: DataFrame
    #: a_id, b_id, links (of the corpus), best (no other A id has more links with this B id)
    pairs: DataFrame


def aligned(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> Alignment:
    """The groups and links of every row of docs, and all pairs of the corpus with their number of links.

    A text that is null or empty, or that either tokenizer's tokens do not give back byte by byte, has no tokens: zeros
    and an empty digest. Whole texts of any length are read. Repeated rows and ids stand apart, each with its own row,
    and count in the pairs as often as they are there; ids of any type, also null, are handed on. An empty
    table gives two empty results. Other columns of docs, whatever their names, are not read. groups holds the text that
    the digest is made of, whole, so it is kept only if asked for.
    """
    spark = docs.sparkSession
    files = []
    for path in (a_path, b_path):
        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
        with open(path, "rb") as f:
            files.append(f.read())
    n_b = len(loaded(files[1]).of_id)
    id_type = docs.select(quoted(id_col)).schema[0].dataType
    texts = docs.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    event = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    events = texts.mapInArrow(events_of(*files), event)
    pair = T.IntegerType() if len(loaded(files[0]).of_id) * n_b < 1 << 31 else T.LongType()
    swept = T.StructType([*event.fields[:2], *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")], T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(pair)), T.StructField("times", T.ArrayType(T.IntegerType()))])
    in_order = events.repartition("row").sortWithinPartitions("row", "start", F.desc("side"))
    found = written(in_order.mapInArrow(swept_by(*files, to_arrow_type(id_type), keep_groups), swept), "align_swept")
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").cast("long").alias("times"))
    counts = written(links.groupBy("pair").agg(F.sum("times").alias("links")), "align_counts")
    most = counts.groupBy((F.col("pair") % n_b).alias("b_id")).agg(F.max("links").alias("most"))
    pairs = written(counts.withColumn("b_id", F.col("pair") % n_b).join(most, "b_id").select("pair", F.floor(F.col("pair") / n_b).cast("int").alias("a_id"), "b_id", "links", (F.col("links") == F.col("most")).alias("best")), "align_pairs")
    dropped(counts)
    by_pair = links.join(small(pairs.select("pair", "links", "best"), PAIRS), "pair")
    of_row = by_pair.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    sums = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_links", "n_best", "count_sum")]
    documents = found.filter("n_a is not null").join(of_row, "row", "left").select("row", "doc_id", "n_a", "n_b", "n_groups", *sums, "groups_sha256", "groups")
    return Alignment(documents, pairs.select("a_id", "b_id", "links", "best"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents").select("doc_id", "text")).documents.drop("row", "groups")


QUERIES = {"op13_alignment": op13_alignment}
SQL: dict[str, str] = {}
