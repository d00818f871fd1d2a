"""A corpus from raw documents: toxicity, near-dedup, decontamination, mixing and sharding, in this order.

Stages that send whole texts to Python write their result themselves, a bounded number of rows to a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from millrace.llm.common import dropped, free_name, quoted, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below a half."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, index)
    return written(found.filter(quoted(found.columns[-1])["score"] < 0.5).select(*map(quoted, found.columns[:-1])).toDF(*docs.columns), "stage_toxicity")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, once. Rows without id or words stay."""
    return near_dedup.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return written(found.filter(quoted(found.columns[-1])["n_items"] == 0).select(*map(quoted, docs.columns)), "stage_decontamination")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    found = mixing.mixed(docs)
    times = quoted(found.columns[-1])["copies"]
    own = list(map(quoted, found.columns[:-1]))
    return found.filter(times > 0).select(*own, F.explode(F.sequence(F.lit(1), times.cast("int"))).alias(free_name(found, "copy"))).select(*own).toDF(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place in it of every row."""
    return sharding.shard_by_bytes(docs)


STAGES = [("toxicity", toxic), ("near_dedup", near_duplicates), ("decontamination", leaks), ("mixing", mix), ("sharding", shard)]
#: Nearest neighbours, minwise paths and the latent space have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of what all stages keep; a stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = docs if hasattr(docs, "millrace_path") else written(docs, f"stage_{name}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
