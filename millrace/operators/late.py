"""Events that arrive late or more than once: files followed as a stream into a table of first copies.

A batch of new files adds its own first copies as a part of the table, under the number of the batch: a batch that is
run again after a crash replaces its part, so nothing is there twice. The first copy over all parts counts, whenever it
came. Parts are merged into one from time to time; a merge is written beside the table and moved in, and parts that it
holds are passed over until they are deleted, so it may die at any step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from . import history


def _numbers(spark: SparkSession, into: str, kind: str) -> list[int]:
    return sorted(int(p.rsplit("-", 1)[1]) for p in tables.files(spark, f"{into}/{kind}-*"))


def follow(spark: SparkSession, incoming: str, into: str, schema: str, key: str = "event_id", at: str = "recorded_at", files_at_once: int = 1000) -> int:
    """Takes in the Parquet files below incoming that no run has taken in yet, and gives the number of batches so far.

    What has been seen is in a checkpoint beside the table. A run takes what is there, in batches of some files, and ends.
    """
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).parquet(incoming)

    def add(batch: DataFrame, number: int) -> None:
        history.deduplicated(batch, key, at).write.mode("overwrite").parquet(f"{into}/part-{number}")

    stream = read.withColumn("file", F.col("_metadata.file_path")).writeStream.foreachBatch(add)
    running = stream.option("checkpointLocation", f"{into}/_checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return len(_numbers(spark, into, "part"))


def _parts(spark: SparkSession, into: str) -> tuple[list[str], int]:
    """The folders that hold the table, and the last batch among them."""
    merged, parts = _numbers(spark, into, "merged"), _numbers(spark, into, "part")
    upto = merged[-1] if merged else -1
    new = [n for n in parts if n > upto]
    return [f"{into}/merged-{n}" for n in merged[-1:]] + [f"{into}/part-{n}" for n in new], max([upto, *new])


def first_copies(spark: SparkSession, into: str, schema: str, key: str = "event_id", at: str = "recorded_at") -> DataFrame:
    """One row of each event that has come in so far: the copy that was recorded first, then the one of the smallest path."""
    paths, _ = _parts(spark, into)
    kinds = f"{schema}, file string"
    rows = spark.read.schema(kinds).parquet(*paths) if paths else spark.createDataFrame([], kinds)
    return history.deduplicated(rows, key, at)


def merge(spark: SparkSession, into: str, schema: str, key: str = "event_id", at: str = "recorded_at") -> None:
    """Makes one part of all; the table stays the same."""
    paths, last = _parts(spark, into)
    if len(paths) > 1 or paths and "/part-" in paths[0]:
        beside = f"{into}/_merge-{uuid.uuid4().hex}"
        first_copies(spark, into, schema, key, at).write.parquet(beside)
        tables.move(spark, beside, f"{into}/merged-{last}")
    merged = _numbers(spark, into, "merged")
    old = [f"{into}/merged-{n}" for n in merged[:-1]] + [f"{into}/part-{n}" for n in _numbers(spark, into, "part") if merged and n <= merged[-1]]
    for path in [*old, *tables.files(spark, f"{into}/_merge-*")]:
        tables.remove(spark, path)
