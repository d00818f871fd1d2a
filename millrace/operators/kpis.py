"""Measures by month as products report them themselves: other windows, other months, other populations.

Each gives month and value for every month of the spine; months without anything have 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics


def _on(spine: DataFrame, found: DataFrame) -> DataFrame:
    return spine.select("month").join(found, "month", "left").select("month", F.coalesce("value", F.lit(0)).cast("double").alias("value"))


def windowed_distinct(df: DataFrame, entity: str, day: str, spine: DataFrame, days: int) -> DataFrame:
    """Entities seen in the last `days` days of each month."""
    return _on(spine, metrics.by_month_window(df.select(entity, day), day, days).groupBy("month").agg(F.countDistinct(entity).alias("value")))


def month_total(df: DataFrame, amount: str | Column, day: str, spine: DataFrame) -> DataFrame:
    """Sum of the amount over the rows of each month."""
    value = F.col(amount) if isinstance(amount, str) else amount
    return _on(spine, df.groupBy(F.to_date(F.trunc(day, "MM")).alias("month")).agg(F.sum(value).alias("value")))


def month_distinct(df: DataFrame, entity: str, day: str, spine: DataFrame) -> DataFrame:
    return _on(spine, df.groupBy(F.to_date(F.trunc(day, "MM")).alias("month")).agg(F.countDistinct(entity).alias("value")))


def month_rows(df: DataFrame, day: str, spine: DataFrame) -> DataFrame:
    return month_total(df, F.lit(1), day, spine)


def ratio(over: DataFrame, under: DataFrame) -> DataFrame:
    """One measure for each unit of the other; 0 where there is no unit."""
    both = over.join(under.select("month", F.col("value").alias("units")), "month")
    return both.select("month", F.when(F.col("units") > 0, F.col("value") / F.col("units")).otherwise(0.0).alias("value"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("month", F.col("value").alias("less")), "month").select("month", (F.col("value") - F.col("less")).alias("value"))


def ever_less_recent(df: DataFrame, entity: str, day: str, spine: DataFrame, days: int = 60) -> DataFrame:
    """Entities seen by the end of each month that were not seen in its last `days` days.

    An entity is counted from the month of its first day on: a running sum over months, not over entities.
    """
    new = df.groupBy(entity).agg(F.to_date(F.trunc(F.min(day), "MM")).alias("month")).groupBy("month").agg(F.count("*").alias("new"))
    months = spine.select("month").unionByName(new.select("month")).distinct().join(new, "month", "left")
    upto = months.withColumn("value", F.sum(F.coalesce("new", F.lit(0))).over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))
    return difference(_on(spine, upto.select("month", "value")), windowed_distinct(df, entity, day, spine, days))


def _alive(df: DataFrame, start: str, end: str) -> DataFrame:
    """df with from and until: the first month at whose end a row is alive, and the first at whose end it no longer is (null: never).

    Alive at the end of a month is what has started by then and has no end, or one on that day or later.
    """
    ends = F.to_date(end)
    until = F.when(ends == F.last_day(ends), F.add_months(F.trunc(ends, "MM"), 1)).otherwise(F.to_date(F.trunc(ends, "MM")))
    held = df.withColumns({"from": F.to_date(F.trunc(start, "MM")), "until": until})
    return held.filter(F.col("from").isNotNull() & (F.col("until").isNull() | (F.col("from") < F.col("until"))))


def _swept(intervals: DataFrame, spine: DataFrame, weight: Column) -> DataFrame:
    """For each month of the spine the weight of all that is alive: a running sum over what comes and goes, two events a row."""
    event = F.explode(F.array(F.struct(F.col("from").alias("month"), weight.alias("w")), F.struct(F.col("until").alias("month"), (-weight).alias("w"))))
    change = intervals.select(event.alias("e")).select("e.*").filter("month is not null").groupBy("month").agg(F.sum("w").alias("w"))
    months = spine.select("month").distinct().join(change, "month", "full_outer")
    upto = F.sum(F.coalesce("w", F.lit(0))).over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return _on(spine, months.select("month", upto.alias("value")))


def alive_distinct(df: DataFrame, entity: str, start: str, end: str, spine: DataFrame) -> DataFrame:
    """Entities with a row that is alive on the last day of each month.

    An entity's intervals are merged first, so it comes and goes once however many overlap; rows are summed up by
    entity and first month before they are shuffled, and how long a row lives costs nothing.
    """
    far = F.lit("9999-12-01").cast("date")
    own = _alive(df.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), F.col(start).alias("start"), F.col(end).alias("end")), "start", "end")
    own = own.groupBy("entity", "from").agg(F.max(F.coalesce("until", far)).alias("until"))
    by_entity = Window.partitionBy("entity").orderBy("from")
    reached = F.max("until").over(by_entity.rowsBetween(Window.unboundedPreceding, -1))
    opens = own.withColumn("opens", F.when(F.col("from") <= reached, 0).otherwise(1))
    merged = opens.withColumn("block", F.sum("opens").over(by_entity)).groupBy("entity", "block").agg(F.min("from").alias("from"), F.nullif(F.max("until"), far).alias("until"))
    return _swept(merged, spine, F.lit(1))


def alive_total(df: DataFrame, amount: str, start: str, end: str, spine: DataFrame) -> DataFrame:
    """Sum of the amount over the rows that are alive on the last day of each month."""
    own = _alive(df.select(F.col(amount).alias("amount"), F.col(start).alias("start"), F.col(end).alias("end")), "start", "end")
    return _swept(own, spine, F.coalesce("amount", F.lit(0)))


def reported(parts: dict[tuple[str, str, str], DataFrame]) -> DataFrame:
    """product, reported_as, period_month, value, definition from measures by (product, reported_as, definition)."""
    out = None
    for (product, name, definition), measure in parts.items():
        own = measure.select(F.lit(product).alias("product"), F.lit(name).alias("reported_as"), F.col("month").alias("period_month"), "value", F.lit(definition).alias("definition"))
        out = own if out is None else out.unionByName(own)
    return out
