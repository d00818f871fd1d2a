"""Shards against the same law in plain Python."""

import random
import zlib

import pytest

from millrace.llm import sharding


def plain(rows, n):
    own = sorted(((zlib.crc32((t or "").encode()), len((t or "").encode()) + 8, -1 if i is None else i) for i, t in rows))
    total, upto, out, slots = sum(s for _, s, _ in own), 0, [], {}
    for crc, size, i in own:
        upto += size
        shard = min(n - 1, n * (2 * upto - size) // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        out.append((None if i < 0 else i, size, crc, shard, slots[shard]))
    return out


@pytest.mark.parametrize("n", [1, 3, 24])
def test_shards_equal_plain_prefix_sums(spark, n):
    r = random.Random(n)
    copies = ["copy " * 30, None, "", "é" * 50]
    rows = [(i, r.choice(copies) if i % 3 else "w" * r.randint(0, 400)) for i in range(500)] + [(None, copies[0])] * 200 + [(7, "x" * 9000)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, size int, shard string").repartition(6)
    got = [tuple(x) for x in sharding.shard_by_bytes(docs, n).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows, n)))
