"""Contiguous shards of near-equal bytes.

Rows are put in one total order (text checksum, size, id: equal texts stand together), range-partitioned
on it and written. Each partition's total gives a global prefix sum, and the prefix sum says, row by row,
in which equal slice of all bytes the row's middle lies. Only ids, sizes and checksums are shuffled, never
texts; a group of copies of any size is split over partitions because the id, and the place of rows that are equal in
all, are part of the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

#: Bytes that a row takes besides its text.
ROW_OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null text counts as empty text; null and repeated ids are kept (each row gets a slot of its own); an
    empty table gives an empty result; other columns of docs are ignored. A text longer than a slice of
    the bytes stays whole, so its shard is larger by at most that text.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))
    # Written, since a second sampling of the ranges could cut elsewhere. The last column parts rows that are equal.
    placed = written(rows.repartitionByRange("text_crc32", "size", "doc_id", "tie").withColumn("part", F.spark_partition_id()), "shard_order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as range partitions, which spark.sql.shuffle.partitions bounds.
    offsets = (
        placed.groupBy("part")
        .agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
        .select("part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"), F.sum("part_size").over(Window.partitionBy()).alias("total"))
    )
    inside = Window.partitionBy("part").orderBy("text_crc32", "size", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumns({"size_to": F.sum("size").over(inside), "row_to": F.count("*").over(inside)}).join(F.broadcast(offsets), "part")
    cut = summed.select("doc_id", "size", "text_crc32", F.least(F.lit(n_shards - 1), F.expr(f"({n_shards} * (2 * (size_before + size_to) - size)) div (2 * total)")).cast("int").alias("shard"), (F.col("rows_before") + F.col("row_to") - 1).alias("row"))
    starts = cut.groupBy("shard").agg(F.min("row").alias("first_row"))
    return cut.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


QUERIES = {"op5_sharding": op5_sharding}
SQL: dict[str, str] = {}
