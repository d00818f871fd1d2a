"""Governed metrics: month spine, trailing-window activity, lapse, ratio, money by month and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_spine(df: DataFrame, first: str, last: str | None = None) -> DataFrame:
    """Every month from the smallest first to the largest last date of df."""
    ends = df.agg(F.trunc(F.min(first), "MM").alias("lo"), F.trunc(F.max(last or first), "MM").alias("hi"))
    return ends.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))


def by_month_window(df: DataFrame, at: str, days: int = 30) -> DataFrame:
    """df once for each month whose last `days` days hold the date: an equality key in place of a range join."""
    day = F.to_date(at)
    months = F.transform(F.sequence(F.lit(0), F.lit(-(-days // 28) - 1)), lambda k: F.add_months(F.trunc(day, "MM"), k))
    end = F.last_day("month")
    return df.withColumn("month", F.explode(months)).filter((F.date_sub(end, days) < day) & (day <= end))


def scoped(df: DataFrame, scopes: Column) -> DataFrame:
    """df once for each of its scopes, in one pass."""
    return df.withColumn("scope", F.explode(F.array_compact(scopes)))


def scope_column(source: str, kinds: dict[str, str], members: str = "in_population") -> Column:
    """The scopes of a row: ALL, its own source, and the populations that its entity is in (a column of names)."""
    own = F.when(F.col(source).isin([p for p, k in kinds.items() if k == "source"]), F.array(source)).otherwise(F.array().cast("array<string>"))
    everyone = F.array(*[F.lit(p) for p, k in kinds.items() if k == "all"]).cast("array<string>")
    populations = F.coalesce(F.col(members), F.array().cast("array<string>")) if any(k == "population" for k in kinds.values()) else F.array().cast("array<string>")
    return F.concat(everyone, own, populations)


def with_population(df: DataFrame, entity: str, membership: DataFrame, products: Sequence[str], into: str = "in_population") -> DataFrame:
    """df with the products among these that its entity is a customer of; membership has one row for each entity and product."""
    held = membership.filter(F.col("product").isin(*products)).groupBy(entity).agg(F.collect_set("product").alias(into))
    return df.join(held, entity, "left")


def active(df: DataFrame, entity: str, at: str, scopes: Column, days: int = 30) -> DataFrame:
    """month, scope, entity, n_rows: what the active, lapsed and rows-per-active metrics share."""
    slim = scoped(df, scopes).select("scope", entity, at)
    return by_month_window(slim, at, days).groupBy("month", "scope", entity).agg(F.count("*").alias("n_rows"))


def lapsed(sets: DataFrame, entity: str) -> DataFrame:
    """Entities active in the month before and no longer, by month and scope."""
    before = sets.select(F.add_months("month", 1).alias("month"), "scope", entity)
    return before.join(sets, ["month", "scope", entity], "left_anti").groupBy("month", "scope").agg(F.count("*").alias("lapsed"))


def rows_per_active(sets: DataFrame) -> DataFrame:
    """Rows in the window for each active entity, as decimal(28,6)."""
    both = sets.groupBy("month", "scope").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("active"))
    return both.withColumn("per_active", F.round(F.col("n_rows").cast("double") / F.col("active"), 6).cast("decimal(28,6)"))


def sum_by_month(df: DataFrame, amount: str, month: Column, scopes: Column) -> DataFrame:
    return scoped(df, scopes).groupBy(month.alias("month"), "scope").agg(F.sum(amount).cast("long").alias("total"))


def on_grid(metric: DataFrame, spine: DataFrame, scopes: DataFrame, value: str, kind: str = "long") -> DataFrame:
    """The metric on all months and scopes, zero where there is nothing. Both sides of the grid are dimension sized."""
    return spine.crossJoin(scopes).join(metric, ["month", "scope"], "left").select("month", "scope", F.coalesce(F.col(value), F.lit(0)).cast(kind).alias(value))


def grid_gaps(metric: DataFrame, spine: DataFrame, scopes: DataFrame) -> DataFrame:
    """Months and scopes that the metric lacks, and rows that are outside the grid."""
    grid, own = spine.crossJoin(scopes), metric.select("month", "scope")
    return grid.join(own, ["month", "scope"], "left_anti").withColumn("problem", F.lit("missing")).union(own.join(grid, ["month", "scope"], "left_anti").withColumn("problem", F.lit("outside")))


def reconcile(reported: DataFrame, canonical: DataFrame, variants: DataFrame, keys: Sequence[str] = ("period_month", "product")) -> DataFrame:
    """Gap of what products report to the canonical value, and whether the variant of the definition explains it.

    reported has keys, reported_as and value, canonical keys and value, variants (a few rows) product, reported_as,
    expected_direction (higher, lower, any), direction_tolerance_pct, threshold_pct and comparable. explained is null
    where the variant is not comparable, false where there is no percentage, and else true if the gap is within the
    threshold and not in the wrong direction beyond the tolerance.
    """
    joined = reported.join(F.broadcast(variants), ["product", "reported_as"]).join(canonical.withColumnRenamed("value", "canonical_value"), list(keys), "left")
    diff = F.col("value") - F.col("canonical_value")
    pct = F.col("diff") * 100.0 / F.nullif(F.col("canonical_value"), F.lit(0))
    direction = F.when(F.col("expected_direction") == "higher", F.col("diff_pct") >= -F.col("direction_tolerance_pct")).when(F.col("expected_direction") == "lower", F.col("diff_pct") <= F.col("direction_tolerance_pct")).otherwise(True)
    explained = F.when(~F.col("comparable"), F.lit(None)).when(F.col("diff_pct").isNull(), False).otherwise((F.abs("diff_pct") <= F.col("threshold_pct")) & direction)
    measured = joined.withColumn("diff", diff).withColumn("diff_pct", pct).withColumn("explained", explained)
    return measured.select(*keys, "reported_as", F.col("value").alias("reported_value"), "canonical_value", "diff", "diff_pct", "expected_direction", "threshold_pct", "comparable", "explained")
