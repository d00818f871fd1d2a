"""The landing run: files are read, held against their contract, and landed with keys or quarantined with reasons.

A file lands or is quarantined as a whole. What is said of a file names columns, checks and counts, never a value.
"""

from __future__ import annotations

import datetime
import json
import unicodedata
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, scalars
from ..operators import contracts
from ..sources import tables
from . import commits
from .datasets import DATASETS, Dataset

#: Folders of a lake that a full run may clear.
MANAGED = ("A", "B", "C", "D", "E", "reported_kpis", "quarantine", "meta")
META = {
    "landing_log": "run_id string, source string, dataset string, partition_date string, files_landed long, rows_landed long",
    "quarantine_log": "run_id string, source string, dataset string, file string, partition_date string, stage string, n_violations long, reason string, quarantined_at timestamp",
    "identity_stats": "run_id string, source string, key_method string, n_members long",
    "period": "run_id string, period_start date, period_end date",
}
Violation = tuple[str, str, int]


@dataclass
class Report:
    """What a run did: rows of the meta tables."""

    run_id: str
    landed: list[tuple] = field(default_factory=list)
    quarantined: list[tuple] = field(default_factory=list)
    identities: list[tuple] = field(default_factory=list)


def _partition(path: str, default: str) -> str:
    return next((p.split("=", 1)[1] for p in path.split("/") if p.startswith(("dt=", "month="))), default)


def _aliased(header: Sequence[str], aliases: dict[str, str]) -> tuple[list[str], list[Violation]]:
    """The declared names of a header; a name that no alias knows is a violation."""
    names = [unicodedata.normalize("NFKC", h).strip() for h in header] if aliases else list(header)
    known = {unicodedata.normalize("NFKC", k): v for k, v in aliases.items()} | {v: v for v in aliases.values()}
    unknown = [(n, "unknown_column_name", 1) for n in names if aliases and n not in known]
    return [known.get(n, n) for n in names], unknown


def _unread(paths: list[str], bad: dict, fit: list[str]) -> dict[str, tuple[str, list[Violation]]]:
    """Files of which nothing came: those without a byte."""
    return {p: ("read", [("", "EmptyFile", 0)]) for p in paths if p not in bad and p not in fit}


def _read_parquet(spark: SparkSession, ds: Dataset, paths: list[str]) -> tuple[DataFrame | None, dict[str, tuple[str, list[Violation]]]]:
    """The rows of the files whose structure fits, and by file the stage and violations of the others."""
    contract, bad, fit, extra = ds.contract(), {}, [], {}
    for r in tables.footers(spark, paths).collect():  # one row a file
        types = dict(zip(r.columns, r.types, strict=True))
        wrong = [(c, check, 0) for c, check in contracts.misfits(r.columns, contract) + contracts.mistyped(types, contract)]
        if r.error or wrong:
            bad[r.file] = ("read", [("", r.error, 0)]) if r.error else ("contract", wrong)
        else:
            fit.append(r.file)
            extra |= {c: t for c, t in types.items() if c not in contract.columns and t != "null"}
    bad |= _unread(paths, bad, fit)
    if not fit:
        return None, bad
    schema = ", ".join(f"`{c}` {t}" for c, t in (contract.types | extra).items())
    return spark.read.schema(schema).parquet(*fit).withColumn("file", F.col("_metadata.file_path")), bad


def _read_text(spark: SparkSession, ds: Dataset, paths: list[str]) -> tuple[DataFrame | None, dict[str, tuple[str, list[Violation]]]]:
    contract, bad, fit = ds.contract(), {}, []
    rows = tables.text_files(spark, paths, ds.kind)
    for r in rows.filter("place = 0").select("file", "header", "error").collect():  # one row a file
        names, wrong = _aliased(r.header, ds.aliases)
        if len(set(names)) < len(names):
            wrong.append((next(n for n in names if names.count(n) > 1), "two columns of one name", 1))
        wrong = wrong or [(c, check, 0) for c, check in contracts.misfits(names, contract)]
        if r.error or wrong:
            bad[r.file] = ("read", [("", r.error, 0)]) if r.error else ("contract", wrong)
        else:
            fit.append((r.file, names))
    bad |= _unread(paths, bad, [f for f, _ in fit])
    if not fit:
        return None, bad
    headers = spark.createDataFrame(fit, "file string, names array<string>")
    held = rows.filter("place > 0").join(F.broadcast(headers), "file").withColumn("cell", F.map_from_arrays("names", "cells"))
    # An empty cell of a nullable column is none.
    cell = {c: F.col("cell")[c] for c in contract.columns}
    own = [(F.when(v != "", v) if c in contract.nullable else v).alias(c) for c, v in cell.items()]
    return held.select(*own, "file"), bad


def _with_keys(ds: Dataset, df: DataFrame, salt: str) -> DataFrame:
    if ds.person is not None:
        email, phone, kana, guardian = ds.contact
        return identity.with_keys(df, salt, ds.source, ds.person(), email, phone, kana, guardian, ds.by_phone)
    return df.withColumn("account_key", scalars.account_key("company_name")) if ds.source == "E" else df


def land(spark: SparkSession, incoming: str, lake: str, salt: str, now: datetime.datetime, datasets: Sequence[Dataset] = DATASETS, period: tuple[datetime.date, datetime.date] | None = None) -> Report:
    """Lands or quarantines every file below incoming, which is empty of them afterwards, and appends to the meta tables.

    All of it happens or nothing: see commits. A run that died before is finished or thrown away first.
    """
    commits.recover(spark, lake)
    report, today, inputs = Report(uuid.uuid4().hex), now.date().isoformat(), []
    beside = commits.prepared(lake, report.run_id)
    for ds in datasets:
        paths = tables.files(spark, f"{incoming}/{ds.pattern}")
        if not paths:
            continue
        stamps = {p: tables.stamp(spark, p) for p in paths}
        rows, bad = (_read_parquet if ds.kind == "parquet" else _read_text)(spark, ds, paths)
        if rows is not None:
            for r in contracts.violations(rows, ds.contract(), ["file"]).collect():  # a row for each file and failed check
                bad.setdefault(r.file, ("contract", []))[1].append((r.column, r.check, r.n_rows))
            if bad.keys() < set(paths):
                _prepare(spark, ds, rows, bad, beside, salt, now, today, report)
        inputs += [_quarantined(spark, ds, p, stamps[p], *bad[p], lake, now, today, report) if p in bad else commits.Input(p, *stamps[p]) for p in paths]
    days = sorted(r[3] for r in report.landed if len(r[3]) == 10)
    if period is None and days:
        period = tuple(datetime.date.fromisoformat(d) for d in (days[0], days[-1]))
    found = {"landing_log": report.landed, "quarantine_log": report.quarantined, "identity_stats": report.identities, "period": [(report.run_id, *period)] if period else []}
    for name, own in found.items():
        if own:
            tables.append(spark.createDataFrame(own, META[name]), f"{beside}/meta/{name}")
    if inputs or period:
        commits.commit(spark, lake, report.run_id, inputs)
        commits.finish(spark, lake, report.run_id)
    return report


def _prepare(spark: SparkSession, ds: Dataset, rows: DataFrame, bad: dict, beside: str, salt: str, now: datetime.datetime, today: str, report: Report) -> None:
    """Writes the rows of the good files as they will stand in the lake, and reports them."""
    key = "month" if ds.source == "E" else "dt"
    good = rows
    if bad:  # a row a file
        good = rows.join(F.broadcast(spark.createDataFrame([(p,) for p in bad], "file string")), "file", "left_anti")
    landed = _with_keys(ds, good, salt).withColumns({"ingested_at": F.lit(now).cast("timestamp"), key: contracts.partition_of(F.col("file"), today)})
    to = f"{beside}/reported_kpis" if ds.source == "KPI" else f"{beside}/{ds.source}/{ds.name}"
    landed.withColumnRenamed("file", "landed_from").write.mode("append").partitionBy(key).parquet(to)
    own = spark.read.parquet(to)
    by_day = own.groupBy(F.col(key).cast("string").alias("day")).agg(F.countDistinct("landed_from").alias("files"), F.count("*").alias("rows"))
    report.landed += [(report.run_id, ds.source, ds.name, r.day, r.files, r.rows) for r in by_day.orderBy("day").collect()]
    if ds.person is not None:
        who = F.col("member_key") if ds.by_key else ds.person()
        last = own.groupBy(who.alias("who")).agg(F.max_by("key_method", F.struct(key, "landed_from")).alias("key_method"))
        report.identities += [(report.run_id, ds.source, r.key_method, r.n) for r in last.groupBy("key_method").agg(F.count("*").alias("n")).orderBy("key_method").collect()]


def _quarantined(spark: SparkSession, ds: Dataset, path: str, stamp: tuple[int, int], stage: str, found: list[Violation], lake: str, now: datetime.datetime, today: str, report: Report) -> commits.Input:
    """Where the file goes, with a document of the reasons; a file of that name that is there already stays."""
    day, name = _partition(path, today), path.rsplit("/", 1)[1]
    to = f"{lake}/quarantine/{ds.source}/{day}/{ds.name}__{name}"
    if tables.files(spark, to):
        to = f"{lake}/quarantine/{ds.source}/{day}/{ds.name}__{report.run_id}__{name}"
    details = [{"column": c, "check": check, "n_rows": n} for c, check, n in sorted(found)]
    document = {"source": ds.source, "dataset": ds.name, "file": name, "stage": stage, "quarantined_at": now.isoformat(), "violations": details}
    reason = "; ".join(f"{d['check']} on {d['column']}" if d["column"] else d["check"] for d in details)
    report.quarantined.append((report.run_id, ds.source, ds.name, name, day, stage, len(details), reason, now))
    return commits.Input(path, *stamp, to, json.dumps(document, ensure_ascii=False, indent=1))


def ingest(spark: SparkSession, incoming: str, lake: str, salt_variable: str, now: datetime.datetime, overwrite: bool = False, more: bool = False) -> Report:
    """A full run into an empty or cleared lake, or, with more, one that adds to it. The salt is asked for first."""
    salt = identity.salt_from(salt_variable)
    commits.recover(spark, lake)
    if not more:
        tables.cleared(spark, lake, MANAGED, overwrite)
    return land(spark, incoming, lake, salt, now)


def meta(spark: SparkSession, lake: str, name: str) -> DataFrame:
    return tables.optional_table(spark, f"{lake}/meta/{name}", META[name])
