"""What the operators of this subpackage share: inputs, written tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a small keyed table (sources, terms, offsets) may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: Words are runs of anything but space and the ASCII controls from tab to carriage return.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Settings while a table is written.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing.

    The shuffle files that made it are deleted, since nothing reads them again; Python gets few rows at once, since
    texts may be long. Both settings hold for this write only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.millrace_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables from written(), which nothing may read any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.millrace_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The written table df with a broadcast hint if its files and rows are few; otherwise as it is, so that a shuffled (skew-split) join runs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES and len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def free_name(df: DataFrame, base: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"{base}_"
    return base


def made_free(df: DataFrame, name: str) -> DataFrame:
    """df with a column of this name, if it has one, called as free_name() says; places and values stay."""
    return df.toDF(*[free_name(df, name) if c.lower() == name.lower() else c for c in df.columns])


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """df with its columns called c0, c1 and so on, and the new names of these columns; no helper column of an operator is called so."""
    names = [c.lower() for c in df.columns]
    return df.toDF(*[f"c{i}" for i in range(len(names))]), [f"c{names.index(c.lower())}" for c in columns]


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def fold(col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % 5
