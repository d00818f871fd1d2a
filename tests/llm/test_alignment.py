"""Alignment against a plain one: whole texts, whole lists of ends, counts in a dictionary."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import alignment

TEXTS = [None, "", " ", "  ", "a", "a ", " a", "a  b \n c\t\td  ", "Straße élan naïve 東京 😀😀", "▁x", "<s> </s> <0x41> <|endoftext|>", "it's we'll x y　z", "a\x00b\x1c c\x85d", "ﬁ① é", "no" * 3000, "1234567890" * 20, "\n\n\n", "x" + " " * 500 + "y", "▁"]


def plain(rows):
    """By row: id, n_a, n_b, groups as text, links; and the counts of all pairs."""
    tok = Tokenizer.from_file(alignment.A_PATH)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)
    chars = alignment.byte_of_char()
    a_bytes = {i: bytes(chars[c] for c in t) for t, i in tok.get_vocab(with_added_tokens=False).items() if all(c in chars for c in t)}
    b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(sp.id_to_piece, range(sp.get_piece_size())))]
    out, counts = [], Counter()
    for i, text in rows:
        want = b" " + (text or "").encode()
        a, b = tok.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
        if not text or b"".join(a_bytes[x] for x in a) != want or b"".join(b_bytes[x] for x in b) != want:
            out.append((i, 0, 0, "", []))
            continue
        ends = [{}, {}]
        for to, ids, of in zip(ends, (a, b), (a_bytes, b_bytes), strict=True):
            at = 0
            for k, x in enumerate(ids):
                at += len(of[x])
                to[at] = k
        links, groups, pa, pb = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            ka, kb = ends[0][end], ends[1][end]
            links.append((a[ka], b[kb]))
            groups.append(",".join(map(str, a[pa : ka + 1])) + "|" + ",".join(map(str, b[pb : kb + 1])))
            pa, pb = ka + 1, kb + 1
        counts.update(links)
        out.append((i, len(a), len(b), ";".join(groups), links))
    return out, counts


def held(spark, rows, docs=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string") if docs is None else docs
    found = alignment.aligned(docs, keep_groups=True)
    want, counts = plain(rows)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    lines = [(i, na, nb, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if links else "", g) for i, na, nb, g, links in want]
    got = [tuple(r)[1:] for r in found.documents.collect()]
    assert sorted(map(str, got)) == sorted(map(str, lines))
    pairs = {(r.a_id, r.b_id): (r.links, r.best) for r in found.pairs.collect()}
    assert pairs == {p: (n, n == best[p[1]]) for p, n in counts.items()}


def texts(n, seed=13):
    r = random.Random(seed)
    parts = ["the", "of", " ", "  ", "\n", "\t", "word", "'s", "ünï", "東", "😀", "Z9", "...", " ", "<s>", "qxzj", "!", "​", "́", "▁"]
    return ["".join(r.choice(parts) + r.choice(["", " ", " ", "  "]) for _ in range(r.randrange(120))) for _ in range(n)]


def test_equals_a_plain_alignment(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS + texts(150))] + [(3, "a"), (3, "a"), (None, "of the of the")]
    held(spark, rows)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held(spark, [(r.doc_id, r.text) for r in docs.collect()], docs)


def test_long_text_in_many_portions_and_runs(spark, monkeypatch):
    r = random.Random(5)
    vary = " ".join("".join(r.choices("abcdefghij'.é", k=r.randrange(1, 9))) for _ in range(4000))
    rows = [(1, vary), (2, "x" * 9000), (3, vary + " ▁ " + vary)]
    a, b = (open(p, "rb").read() for p in (alignment.A_PATH, alignment.B_PATH))
    want = plain(rows)[0]
    monkeypatch.setattr(alignment, "PORTION", 300)
    monkeypatch.setattr(alignment, "RUN", 7)
    monkeypatch.setattr(alignment, "LINKS", 50)
    monkeypatch.setattr(alignment, "KNOWN_WORDS", 100)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"row": [0, 1, 2], "doc_id": [1, 2, 3], "text": [t for _, t in rows]}, pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())]))
    events = pa.Table.from_batches(alignment.events_of(a, b)(iter([batch]))).sort_by([("row", "ascending"), ("start", "ascending"), ("side", "descending")])
    assert events.num_rows > 1000
    out = pa.Table.from_batches(alignment.swept_by(a, b, pa.int64(), True)(iter(events.to_batches(max_chunksize=10)))).to_pylist()
    assert [(x["doc_id"], x["n_a"], x["n_b"], x["groups"]) for x in out if x["n_a"] is not None] == [w[:4] for w in want]
    links = Counter({(x["doc_id"], p): 0 for x in out for p in x["pairs"]})
    for x in out:
        for p, t in zip(x["pairs"], x["times"], strict=True):
            links[x["doc_id"], p] += t
    assert links == Counter((w[0], x * 32_000 + y) for w in want for x, y in w[4])


def test_empty_table_text_ids_and_clashing_columns(spark):
    schema = "doc_id string, text string, row int, ids string, start long, pairs int, n_a string"
    found = alignment.aligned(spark.createDataFrame([], schema))
    assert found.documents.count() == found.pairs.count() == 0
    found = alignment.aligned(spark.createDataFrame([("x", "some words", 1, "i", 2, 3, "c"), (None, None, 1, "i", 2, 3, "c")], schema))
    got = {r.doc_id: (r.n_groups, r.n_links, r.count_sum, r.groups_sha256 == "") for r in found.documents.collect()}
    assert got == {"x": (2, 2, 2, False), None: (0, 0, 0, True)}


def test_words_are_not_split_for_other_tokenizers():
    import json

    spec = json.load(open(alignment.A_PATH))
    spec["pre_tokenizer"]["use_regex"] = False
    assert not alignment.ByteLevel(json.dumps(spec).encode()).splits
    assert list(alignment.portions("a b " * 400_000, False)) == ["a b " * 400_000]


@pytest.mark.parametrize("n", [1, 10, 11, 50_257])
def test_digits(n):
    import numpy as np

    ids = np.unique(np.array([0, n // 2, n - 1]))
    assert alignment.Digits(n).text(np.full(len(ids), ord(","), np.uint8), ids).decode() == "".join(f",{i}" for i in ids)
