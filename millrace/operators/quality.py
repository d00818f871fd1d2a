"""Quality tests: each gives the offending rows or counts, so an empty result passes. And the scan for personal data."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import tables


def not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated keys with their count; keys with a null in them are not compared."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def not_accepted(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the list with their count; null is accepted."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n_rows"))


def without_parent(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Keys of the child that the parent lacks, with their count; pre-aggregated, so a frequent key is one row in the join."""
    keys = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"))
    return keys.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def history_breaks(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose versions do not adjoin or that have not exactly one open version."""
    following = F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from", F.col("valid_to").asc_nulls_last()))
    seen = versions.withColumn("_gap", ~F.col("valid_to").eqNullSafe(following))
    return seen.groupBy(*keys).agg(F.count_if("_gap").alias("n_gaps"), F.count_if(F.col("valid_to").isNull()).alias("n_open")).filter("n_gaps > 0 or n_open <> 1")


def not_unique_together(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated combinations with their count; nulls are equal to one another here."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def not_true(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which the expression is false or null."""
    return df.filter(~F.coalesce(F.expr(expression), F.lit(False)))


def nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_rows of the columns that hold nulls; one aggregation."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_rows")) for i, c in enumerate(columns)]))).filter("n_rows > 0")


def linkable_keys(copies: Mapping[str, DataFrame], key: str, canonical: DataFrame) -> DataFrame:
    """key, problem: keys that two product roles share, and keys of a product role that are canonical ones."""
    seen = None
    for role, df in copies.items():
        own = df.select(F.col(key).alias("key"), F.lit(role).alias("role")).filter("key is not null").distinct()
        seen = own if seen is None else seen.unionByName(own)
    shared = seen.groupBy("key").agg(F.count("*").alias("roles")).filter("roles > 1").select("key", F.lit("in two roles").alias("problem"))
    known = seen.select("key").distinct().join(canonical.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
    return shared.unionByName(known.withColumn("problem", F.lit("canonical")))


def without_live_source(people: DataFrame, live: DataFrame, key: str = "member_key") -> DataFrame:
    """People without a live record in any source."""
    return people.select(key).join(live.select(key), key, "left_anti")


def left_by_deleted(rows: DataFrame, deleted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of records that were deleted in their source and should have left nothing."""
    return rows.join(deleted.select(*keys).distinct(), list(keys), "left_semi")


def known_elsewhere_only(seen: DataFrame, own: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Combinations that a product role sees and its own records do not hold."""
    return seen.select(*columns).subtract(own.select(*columns))


def freshness(df: DataFrame, at: str, now, warn_hours: int = 24, error_hours: int = 72) -> DataFrame:
    """latest, age_hours, state of the newest row: pass, warn or error; an empty table is an error."""
    latest = df.agg(F.max(F.col(at).cast("timestamp")).alias("latest"))
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("latest")) / 3600
    state = F.when(F.col("age_hours") <= warn_hours, "pass").when(F.col("age_hours") <= error_hours, "warn").otherwise("error")
    return latest.withColumn("age_hours", age).withColumn("state", state)


#: From weak to strong.
LEVELS = ("none", "quasi", "direct", "sensitive")
#: What a column's name says (fixed values of the scan): pattern, class, reason.
NAMES = (
    (r"e-?mail|メール", "direct", "e-mail name"),
    (r"phone|telephone|(^|_)tel($|_)|mobile|電話", "direct", "phone name"),
    (r"birth|(^|_)dob($|_)|生年月日", "direct", "birth date name"),
    (r"address|postal|(^|_)zip($|_)|住所|郵便", "direct", "address name"),
    (r"health|medical|condition|injur|diagnos|disease|allerg|illness|symptom|持病|病歴|けが", "sensitive", "health name"),
)
#: Parts of a name that say that it is not a person's (fixed values).
NOT_A_PERSON = {"company", "plan", "file", "event", "type", "sku", "facility", "workout", "tenant"}
#: What values look like (fixed values of the scan): pattern, digits at least, reason. A column is direct if at least SHARE of its values do.
VALUES = ((r"^\s*[\w.+-]+@[\w-]+(\.[\w-]+)+\s*$", 0, "e-mail values"), (r"^\+?[\d\-\s()]{10,}$", 10, "phone values"))
SHARE, FREE_LENGTH, FREE_WORDS = 0.5, 25, 3
#: Rows of each file that are scanned.
HEAD = 100
#: The parts of a name, and what says that a person's name is meant (fixed values of the scan).
NAME_PARTS, PERSON = r"[^a-z0-9ぁ-んァ-ヶ一-龠]+", r"(^| )(name|kana)( |$)|氏名|カナ"
_SUMS = ("n", *[f"v{k}" for k in range(len(VALUES))], "length", "words")


def class_of_name(column: str) -> tuple[str, list[str]]:
    """The strongest class that the name of a column says, and why."""
    name = unicodedata.normalize("NFKC", column).lower()
    parts = re.split(NAME_PARTS, name)
    person = () if NOT_A_PERSON.intersection(parts) else ((PERSON, "direct", "person's name"),)
    spelled = f"{name} {' '.join(parts)}"
    says = [(LEVELS.index(level), why) for text, rules in ((name, NAMES), (spelled, person)) for pattern, level, why in rules if re.search(pattern, text)]
    return LEVELS[max((rank for rank, _ in says), default=0)], [why for _, why in says]


def _sums(values: Iterable) -> tuple[int, ...]:
    """Of the texts that are not blank, NFKC: how many there are, are like each of VALUES, and have characters and words."""
    held = [unicodedata.normalize("NFKC", v) for v in values if isinstance(v, str) and v.strip()]
    like = [sum(bool(re.match(p, v)) and len(re.sub(r"\D", "", v)) >= d for v in held) for p, d, _ in VALUES]
    return len(held), *like, sum(map(len, held)), sum(len(v.split()) for v in held)


def _reasons(sums: DataFrame) -> DataFrame:
    """column and why its values are personal in any file, from the sums by file and column."""
    of = sums.filter("n > 0")
    direct = [F.when(F.col(f"v{k}") >= SHARE * F.col("n"), F.lit(why)) for k, (_, _, why) in enumerate(VALUES)]
    free = F.when((F.col("length") >= FREE_LENGTH * F.col("n")) & (F.col("words") >= FREE_WORDS * F.col("n")), F.lit("free text"))
    return of.select("column", F.explode(F.array_compact(F.array(*direct, free))).alias("why")).groupBy("column").agg(F.array_sort(F.collect_set("why")).alias("why"))


def _classed(names: DataFrame, reasons: DataFrame) -> DataFrame:
    """column, level, reasons: the stronger of what the name (of names) and what the values say."""
    why = F.coalesce("why", F.array().cast("array<string>"))
    rank = F.when(F.array_contains(why, "free text"), LEVELS.index("sensitive")).when(F.size(why) > 0, LEVELS.index("direct")).otherwise(0)
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.greatest(rank, F.col("rank")) + 1)
    return names.join(reasons, "column", "left").select("column", level.alias("level"), F.concat("reasons", why).alias("reasons"))


def _named(spark: SparkSession, columns: Iterable[str]) -> DataFrame:
    found = [(c, *class_of_name(c)) for c in columns]
    return spark.createDataFrame([(c, LEVELS.index(level), why) for c, level, why in found], "column string, rank int, reasons array<string>")


def personal_columns(df: DataFrame, file: str | None = None) -> DataFrame:
    """column, level, reasons: the strongest class of the name and the values of every column, over all rows.

    Values are NFKC and judged by each file on its own, so personal data in one of many files is found; blank texts
    do not count. Without file all rows are one file's. Every group passes through counts of its columns only.
    """
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name != file]
    names = _named(df.sparkSession, [c for c in df.columns if c != file])
    rows = df.select(F.col(file).alias("file") if file else F.lit("").alias("file"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(texts)])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums by file and column, from which the shares and means of the whole file follow."""
        for batch in batches:
            out = [(name, c, *_sums(own[f"c{i}"])) for name, own in batch.groupby("file") for i, c in enumerate(texts)]
            yield pd.DataFrame(out, columns=["file", "column", *_SUMS])

    found = rows.mapInPandas(counted, f"file string, column string, {', '.join(f'{c} long' for c in _SUMS)}")
    return _classed(names, _reasons(found.groupBy("file", "column").agg(*[F.sum(c).alias(c) for c in _SUMS])))


def personal_in_files(spark: SparkSession, paths: Sequence[str], head: int = HEAD) -> DataFrame:
    """column, level, reasons over the first rows of every Parquet file, judged by file; columns of any file count.

    The cost of a file does not hang on its size, and nothing is shuffled but a row for each file and column.
    """

    def summed(path: str, batch) -> Iterator[tuple]:
        for name in batch.schema.names:
            values = batch.column(name).to_pylist() if str(batch.schema.field(name).type) in ("string", "large_string") else ()
            yield path, name, *_sums(values)

    sums = tables.heads(spark, paths, summed, f"file string, column string, {', '.join(f'{c} long' for c in _SUMS)}", head)
    # As many rows as the files have distinct columns.
    names = _named(spark, sorted(r.column for r in sums.select("column").distinct().collect()))
    return _classed(names, _reasons(sums))


#: What is said of a column by how its declared class stands to the found one: missing, none, below it.
VERDICTS = ("undeclared", "declared none", "weaker")


def scan_verdicts(found: Mapping[str, str], declared: Mapping[str, str | None]) -> dict[str, str]:
    """Columns whose declared class is no class at all, missing, none, or weaker than found."""
    rank = {None: -1} | {level: i for i, level in enumerate(LEVELS)}
    stands = {c: (rank.get(declared.get(c)), rank[level]) for c, level in found.items()}
    return {c: "invalid" if own is None else VERDICTS[min(own + 1, 2)] for c, (own, level) in stands.items() if own is None or max(own, 0) < level}
