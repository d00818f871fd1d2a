"""Tables of a folder and of a lake: Parquet events, snapshots and change logs, text files, optional and meta tables."""

from __future__ import annotations

import csv
import io
import urllib.parse
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a column that are read at once, and files of one task.
BUFFER, FILES = 1 << 16, 64
#: Schemes of files that tasks open themselves.
DIRECT = {"file", "hdfs", "s3", "s3a", "s3n", "gs", "abfs", "abfss"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _fs(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def files(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match, sorted; a listing on the driver, names only."""
    fs, own = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(own) or [])


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet at path with this schema; an empty typed relation if there is no file."""
    return spark.read.schema(schema).parquet(path) if files(spark, path) else spark.createDataFrame([], schema)


def events(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """Append-only Parquet files, partitioned by day, whose columns may have grown; with the path of each row's file."""
    reader = spark.read.option("mergeSchema", True)
    return (reader.schema(schema) if schema else reader).parquet(folder).withColumn("file", F.col("_metadata.file_path"))


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Full snapshots or change logs, partitioned by day; the day is snapshot_date."""
    return spark.read.option("mergeSchema", True).parquet(folder).withColumnRenamed("dt", "snapshot_date")


def text_files(spark: SparkSession, paths: Sequence[str] | str, encoding: str) -> DataFrame:
    """file, header, place, cells, error: the rows of delimited text files in any encoding, all cells as text.

    A file is decoded and parsed as a whole in one task (place 0 is a row for the file itself, with its header);
    a file that cannot be decoded or parsed has an error and no rows. A byte order mark is no part of the header.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                try:
                    rows = [r for r in csv.reader(io.StringIO(bytes(content).decode(encoding).removeprefix("﻿"), newline=""), strict=True) if r]
                    header = rows[0] if rows else []
                    if any(len(r) != len(header) for r in rows):
                        raise ValueError("ragged")
                    out = [(path, header, i, None if i == 0 else r, None) for i, r in enumerate(rows or [[]])]
                except (UnicodeDecodeError, ValueError, csv.Error) as e:
                    out = [(path, [], 0, None, type(e).__name__)]
                yield pd.DataFrame(out, columns=["file", "header", "place", "cells", "error"])

    read = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths)
    return read.select("path", "content").mapInPandas(parsed, "file string, header array<string>, place int, cells array<string>, error string")


class EmptyFile(ValueError):
    """A file without a byte."""


def _source(path: str):
    """A file of a scheme in DIRECT, open for reading at any place."""
    import pyarrow.fs

    scheme, _, rest = path.partition(":")
    if "/" in scheme or scheme == "file":
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + (path if "/" in scheme else rest).lstrip("/"))
    fs, own = pyarrow.fs.FileSystem.from_uri(urllib.parse.quote(path.replace("s3a:", "s3:").replace("s3n:", "s3:"), safe="/:@=&?%"))
    return fs.open_input_file(own)


def parquet_in(source):
    """A Parquet file of which only the end, and then the pages that are asked for, are read."""
    import pyarrow.parquet as pq

    if not source.size():
        raise EmptyFile
    return pq.ParquetFile(source, pre_buffer=False, buffer_size=BUFFER)


def _kind(t) -> str:
    """The engine's name of an Arrow type."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_type

    if pa.types.is_null(t):
        return "null"
    # INT96 times are instants and come as nanoseconds without a zone.
    return "timestamp" if pa.types.is_timestamp(t) and t.unit == "ns" else from_arrow_type(t, prefer_timestamp_ntz=True).simpleString()


def _by_file(spark: SparkSession, paths: Sequence[str], read, schema: str) -> DataFrame:
    """What read(path, open) yields for every path, in tasks of some files each.

    Files of a scheme that tasks can open themselves are read at the places that matter and never whole. Those of any
    other store come through the engine as a whole, which bounds them to 2 GB.
    """
    if not paths:
        return spark.createDataFrame([], schema)
    names = [f.split()[0] for f in schema.split(", ")]

    def frame(rows) -> pd.DataFrame:
        return pd.DataFrame(list(rows), columns=names)

    def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from (frame(read(p, lambda p=p: _source(p))) for p in batch["path"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        for batch in batches:
            yield from (frame(read(p, lambda c=c: pa.BufferReader(bytes(c)))) for p, c in zip(batch["path"], batch["content"], strict=True))

    if any(":" in p.split("/")[0] and p.split(":")[0] not in DIRECT for p in paths):
        return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(whole, schema)
    parts = min(len(paths), max(spark.sparkContext.defaultParallelism, len(paths) // FILES))
    listed = spark.createDataFrame(spark.sparkContext.parallelize([(p,) for p in paths], parts), "path string")
    return listed.mapInPandas(direct, schema)


def footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, columns, types, error of Parquet files, by the engine's names of types, from the end of each file."""

    def read(path: str, source) -> Iterator[tuple]:
        try:
            with source() as f:
                schema = parquet_in(f).schema_arrow
            yield path, schema.names, [_kind(c.type) for c in schema], None
        except Exception as e:  # noqa: BLE001  whatever makes a file unreadable
            yield path, [], [], type(e).__name__

    return _by_file(spark, paths, read, "file string, columns array<string>, types array<string>, error string")


def heads(spark: SparkSession, paths: Sequence[str], summed, schema: str, rows: int) -> DataFrame:
    """What summed(path, batch) yields of the first rows of every Parquet file, from the first pages of its columns."""

    def read(path: str, source) -> Iterator[tuple]:
        with source() as f:
            own = parquet_in(f)
            yield from summed(path, next(own.iter_batches(batch_size=rows), own.schema_arrow.empty_table()))

    return _by_file(spark, paths, read, schema)


def seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small mapping table from CSV; empty cells are null."""
    return spark.read.option("header", True).schema(schema).csv(path)


def append(df: DataFrame, path: str) -> None:
    """Rows added to what is there, which stays."""
    df.write.mode("append").parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, own = _fs(spark, path)
    out = fs.create(own, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, own = _fs(spark, path)
    source = fs.open(own)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def stamp(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Length and time of the last change of a file; None if there is none."""
    found = next(iter(_statuses(spark, [path])), None)
    return found and found[1:]


def _statuses(spark: SparkSession, paths: Sequence[str]) -> Iterator[tuple[str, int, int]]:
    for path in paths:
        fs, own = _fs(spark, path)
        if fs.exists(own):
            status = fs.getFileStatus(own)
            yield path, status.getLen(), status.getModificationTime()


def tree(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Every file below path, and its place relative to path; none if there is no such folder."""
    fs, own = _fs(spark, path)
    if not fs.exists(own):
        return []
    root, out, it = fs.getFileStatus(own).getPath().toString(), [], fs.listFiles(own, True)
    while it.hasNext():
        found = it.next().getPath().toString()
        out.append((found, found[len(root) :].lstrip("/")))
    return sorted(out)


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, own = _fs(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(target.getParent())
    if not fs.rename(own, target):
        raise OSError(f"{path} could not be moved")


def remove(spark: SparkSession, path: str) -> None:
    fs, own = _fs(spark, path)
    fs.delete(own, True)


def swapped(spark: SparkSession, new: str, path: str) -> None:
    """Puts the folder new in the place of path. Both moves are renames; what was there goes once the new one stands."""
    fs, own = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{new}-before")
    there = fs.exists(own)
    if there and not fs.rename(own, old):
        raise OSError(f"{path} could not be moved")
    try:
        move(spark, new, path)
    except Exception:
        if there:
            fs.rename(old, own)
        raise
    if there:
        fs.delete(old, True)


def cleared(spark: SparkSession, root: str, managed: Sequence[str], overwrite: bool) -> None:
    """Makes root ready for a full run: what is there is an error, unless overwrite clears the managed folders, and only those."""
    there = [m for m in managed if files(spark, f"{root}/{m}")]
    if there and not overwrite:
        raise FileExistsError(f"{root} holds {', '.join(there)}")
    for m in there:
        remove(spark, f"{root}/{m}")
