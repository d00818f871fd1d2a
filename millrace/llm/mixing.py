"""Mixing sources to target weights by hash thresholds, in DataFrame operations only.

Every document has a 48-bit hash of its id and text. Sizes are summed by source and hash bucket; the bucket in which a
source's budget runs out is the only one looked into again, twelve bits deeper, until the boundary is a
single hash value. A document is taken if its hash lies below that value: no sorting of documents, and
a rerun takes the same ones. A source whose target exceeds its size is taken whole as often as fits, and
the threshold decides over the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, dropped, made_free, numbered, small, table, written

#: Bits that one level of the histogram resolves, and how many levels there are.
BITS, LEVELS = 12, 4
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Times that a source, and so a document, is taken at most.
MOST = 3


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of docs with mix: size, source_size, target, taken, copies (times the row is taken).

    Size is the number of words (null text: 0). A null source is a source of its own, the last. The hash is of id and
    text (nulls count as empty), so only rows that are equal in both share one; where the budget runs out among such
    rows, as many of them are taken as come nearest to it, and since they are equal it does not matter which. A source
    without words has target 0. An empty table gives an empty result. Columns of docs keep their places and values; the
    new one is called mix and stands last, and one of docs that is called so gets an underscore more. The join with the sources is a broadcast up
    to BROADCAST_ROWS sources, and beyond that a shuffled join whose large partitions are split.
    """
    names = [*made_free(docs, "mix").columns, "mix"]
    docs, (id_col, text_col, source_col) = numbered(docs, id_col, text_col, source_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), text))
    own = docs.withColumn("mix", F.struct(F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"), F.conv(F.substring(key, 1, BITS * LEVELS // 4), 16, 10).cast("long").alias("hash")))
    slim = written(own.select(F.col(source_col).alias("source"), "mix.size", "mix.hash"), "mix_rows")
    budgets = written(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix_targets")
    state, used = budgets.select(F.col("source").alias("s"), "spare", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("spent")), []
    worded = slim.filter("size > 0")
    for level in range(LEVELS):
        above, below = BITS * (LEVELS - level), BITS * (LEVELS - level - 1)
        inside = worded.join(small(state), worded["source"].eqNullSafe(state["s"]) & (F.shiftright("hash", above) == F.col("prefix")))
        sums = inside.groupBy("s", "spare", "prefix", "spent", F.shiftright("hash", below).alias("bucket")).agg(F.sum("size").alias("in_bucket"))
        upto = F.sum("in_bucket").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) + F.col("spent")
        over = sums.withColumn("upto", upto).filter("upto > spare")
        first = over.groupBy("s", "spare").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("in_bucket")).alias("spent")), "bucket").alias("edge"))
        state = written(first.select("s", "spare", F.col("edge.bucket").alias("prefix"), F.col("edge.spent").alias("spent")), "mix_edge")
        used.append(state)
    edges = state.select("s", F.col("prefix").alias("edge"), "spent")
    plan = written(budgets.join(edges, budgets["source"].eqNullSafe(edges["s"]), "left").select(F.col("source").alias("s"), "source_size", "target", "times", "spare", "edge", "spent"), "mix_plan")
    dropped(slim, budgets, *used)
    plan = plan.select(F.struct("*").alias("plan"))
    joined = own.join(small(plan), F.col(source_col).eqNullSafe(F.col("plan.s")))
    at_edge = F.coalesce(F.col("mix.hash") == F.col("plan.edge"), F.lit(False))

    def out(rows: DataFrame, once) -> DataFrame:
        copies = F.col("plan.times") + F.when(once, 1).otherwise(0)
        mix = F.struct("mix.size", "plan.source_size", "plan.target", (F.col("mix.size") * copies).alias("taken"), copies.alias("copies"))
        return rows.withColumn("mix", mix).select(*docs.columns, "mix")

    plain = out(joined.filter(~at_edge), F.coalesce(F.col("mix.hash") < F.col("plan.edge"), F.lit(False)))
    # Equal rows at the edge are numbered by input partition and inside of it, so that no task holds all of them.
    edge = written(joined.filter(at_edge).withColumn("mix_part", F.spark_partition_id()), "mix_at_edge")
    totals = edge.groupBy(F.col("plan.s").alias("s"), F.col("mix_part").alias("part")).agg(F.sum("mix.size").alias("part_size"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(totals.select("s", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("before")).select(F.struct("*").alias("offset")), "mix_offsets")
    inside = Window.partitionBy("plan.s", "mix_part").orderBy("mix.hash").rowsBetween(Window.unboundedPreceding, 0)
    counted = edge.withColumn("mix", F.struct("mix.size", "mix.hash", F.sum("mix.size").over(inside).alias("upto"))).join(small(offsets), F.col("plan.s").eqNullSafe(F.col("offset.s")) & (F.col("mix_part") == F.col("offset.part")))
    # A row is taken if its middle is within the budget.
    upto = F.col("plan.spent") + F.col("offset.before") + F.col("mix.upto")
    return plain.unionByName(out(counted, 2 * upto - F.col("mix.size") <= 2 * F.col("plan.spare"))).toDF(*names)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target, times, spare: the total shared by weight, no target above most times its source.

    Sources in order of cap by weight: the first ones end at their caps, the others share what is left. The
    first source whose share of the rest does not exceed its cap ends the capped ones. One row a source.
    """
    array = F.array(*[F.lit(w) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sizes.withColumn("place", place).withColumn("weight", F.element_at(array, (F.col("place") - 1) % len(weights) + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    shared = ranked.withColumns({"capped": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "rest": F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)), "total": F.sum("source_size").over(Window.partitionBy())})
    each = (F.col("total") - F.col("capped")).cast("double") / F.col("rest")
    level = F.min(F.when(F.col("each") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", F.col("each").alias("each")))).over(Window.partitionBy())
    target = F.least(F.col("cap").cast("double"), F.col("level.each") * F.col("weight"))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    found = shared.withColumn("each", each).withColumn("level", level).withColumn("target", F.coalesce(target, F.lit(0.0)))
    return found.withColumn("times", times).select("source", "source_size", "target", "times", (F.col("target") - F.col("times") * F.col("source_size")).alias("spare"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "mix.size", "source", "mix.source_size", "mix.target", "mix.taken")


QUERIES = {"op10_mixing": op10_mixing}
SQL = {
    "op10_mixing": r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || chr(10) || coalesce(text, '')), 1, 12) as bigint) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as place from d group by source),
r as (select *, (place - 1) % 3 + 1 as weight, 3 * source_size as cap from s),
c as (select *,
        coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) as capped,
        sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as rest,
        sum(source_size) over () as total from r),
e as (select *, cast(total - capped as double) / cast(rest as double) as each from c),
l as (select each from e where each * weight <= cap order by cap / weight, place limit 1),
t as (select source, source_size, place, coalesce(least(cast(cap as double), (select each from l) * weight), 0.0) as target from e),
u as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as times from t),
b as (select *, target - times * source_size as spare from u),
g as (select d.*, b.source_size, b.target, b.times, b.spare, sum(d.size) over (partition by b.place order by d.h rows between unbounded preceding and current row) as upto
      from d join b on d.source is not distinct from b.source)
select doc_id, size, source, source_size, target, cast(size * (times + case when 2 * upto - size <= 2 * spare then 1 else 0 end) as bigint) as taken from g
"""
}
