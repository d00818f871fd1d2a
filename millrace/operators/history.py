"""Deduplication, latest state, type-2 history, survivorship and anomaly tests over keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import free_name


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; Catalyst prunes the sort with a window group limit."""
    name = free_name(df, "place")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) == 1).drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The row of each key that is last by these columns; the other columns break ties, so a rerun gives the same row."""
    rest = sorted(c for c in df.columns if c not in {*keys, *order} and not df.schema[c].dataType.simpleString().startswith("map"))
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in [*order, *rest]])


def deduplicated(events: DataFrame, key: str = "event_id", at: str = "recorded_at", file: str = "file") -> DataFrame:
    """One row of each event: the copy that was recorded first, then the one of the smallest path."""
    return first_per_key(events, [key], [F.col(at).asc_nulls_last(), F.col(file).asc_nulls_last()])


def scd2(df: DataFrame, keys: Sequence[str], tracked: Sequence[str], order: Sequence[str], at: str, op: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """A row for each change of the tracked columns, with valid_from, valid_to and is_current; carried columns go along.

    With an operation column, a delete (D) is a version of its own with is_deleted, and so is whatever follows one,
    even if it equals the deleted row. Rows without a change go before the next start is looked up, so versions adjoin.
    """
    by_time = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    state = F.struct(*tracked)
    seen = free_name(df, "seen")
    before = F.lag(F.struct(state.alias("state"), (F.col(op) if op else F.lit(None).cast("string")).alias("op"))).over(by_time)
    changed = df.withColumn(seen, before)
    new = F.col(seen).isNull() | ~F.col(f"{seen}.state").eqNullSafe(state)
    if op:
        new = new | (F.col(op) == "D") | F.coalesce(F.col(f"{seen}.op") == "D", F.lit(False))
    versions = changed.filter(new)
    following = F.lead(at).over(by_time)
    out = [*[F.col(c) for c in [*keys, *tracked, *carry]], F.col(at).alias("valid_from"), following.alias("valid_to"), following.isNull().alias("is_current")]
    return versions.select(*out, *([(F.col(op) == "D").alias("is_deleted")] if op else []))


def row_count_anomalies(daily: DataFrame, day: str, count: str, window: int = 28, z: float = 3.0) -> DataFrame:
    """day, observed, expected, kind: days whose count is over z deviations off the days before, and missing days.

    daily has one row a day with data. The window is the `window` such days before; with fewer of them, or where they
    do not differ, nothing is reported. A missing day is the first one absent after the day before, if a count of zero
    would be over z deviations off. The window over all days is one partition of one row a day.
    """
    upto = Window.orderBy(day).rowsBetween(1 - window, 0)
    stats = daily.select(F.col(day).alias("d"), F.col(count).alias("n"), F.struct(F.col(day).alias("d"), F.avg(count).over(upto).alias("mean"), F.stddev(count).over(upto).alias("sd"), F.count(count).over(upto).alias("seen")).alias("own"))
    seen = stats.withColumn("p", F.lag("own").over(Window.orderBy("d"))).filter(f"p.seen >= {window} and p.sd > 0")
    unusual = F.when(F.abs(F.col("n") - F.col("p.mean")) / F.col("p.sd") > z, F.struct(F.col("d").alias("day"), F.col("n").cast("long").alias("observed"), F.col("p.mean").alias("expected"), F.lit("unusual_count").alias("kind")))
    gone = (F.datediff("d", "p.d") > 1) & (F.col("p.mean") / F.col("p.sd") > z)
    missing = F.when(gone, F.struct(F.date_add("p.d", 1).alias("day"), F.lit(0).cast("long").alias("observed"), F.col("p.mean").alias("expected"), F.lit("missing_day").alias("kind")))
    return seen.select(F.inline(F.array_compact(F.array(unusual, missing))))
