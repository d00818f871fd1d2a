"""Data contracts: checks of columns in one aggregation, and whole files accepted or quarantined."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A named rule of one column; fails where the value is there and the rule does not hold."""

    column: str
    name: str
    holds: Column

    @property
    def fails(self) -> Column:
        return F.col(self.column).isNotNull() & ~F.coalesce(self.holds, F.lit(False))


def at_least(column: str, low: float) -> Check:
    return Check(column, f"ge({low})", F.col(column) >= low)


def between(column: str, low: float, high: float) -> Check:
    return Check(column, f"in_range({low},{high})", F.col(column).between(low, high))


def one_of(column: str, values: Sequence) -> Check:
    return Check(column, "isin", F.col(column).isin(*values))


def matches(column: str, pattern: str) -> Check:
    """The pattern holds from the start of the value; it may end before the value does."""
    return Check(column, "str_matches", F.col(column).rlike(rf"\A(?:{pattern})"))


def contains(column: str, part: str) -> Check:
    return Check(column, f"str_contains({part})", F.col(column).contains(part))


def of_type(column: str, kind: str) -> Check:
    return Check(column, f"type({kind})", F.expr(f"try_cast(`{column}` as {kind}) is not null"))


#: Types that are coerced into one another.
FAMILIES = {"tinyint": "number", "smallint": "number", "int": "number", "bigint": "number", "float": "real", "double": "real", "timestamp": "time", "timestamp_ntz": "local time"}


@dataclass(frozen=True)
class Contract:
    """Exact columns, the nullable ones among them, checks, and column sets that are unique together."""

    columns: Sequence[str]
    nullable: Sequence[str] = ()
    checks: Sequence[Check] = ()
    unique: Sequence[Sequence[str]] = field(default_factory=tuple)
    types: Mapping[str, str] = field(default_factory=dict)
    strict: bool = True

    def rules(self) -> list[tuple[str, str, Column]]:
        nulls = [(c, "not_nullable", F.col(c).isNull()) for c in self.columns if c not in self.nullable]
        return nulls + [(c.column, c.name, c.fails) for c in self.checks]


def misfit_columns(df: DataFrame, contract: Contract) -> list[tuple[str, str]]:
    """(column, check) of missing and, if the contract is strict, undeclared columns; its rules apply only if there are none."""
    return misfits(df.columns, contract)


def misfits(columns: Sequence[str], contract: Contract) -> list[tuple[str, str]]:
    missing = [(c, "column_in_dataframe") for c in contract.columns if c not in columns]
    return missing + [(c, "column_in_schema") for c in columns if contract.strict and c not in contract.columns]


def mistyped(types: Mapping[str, str], contract: Contract) -> list[tuple[str, str]]:
    """(column, check) of columns whose type is of another family than the declared one; numbers and times are coerced inside theirs."""
    return [(c, f"dtype('{kind}')") for c, kind in contract.types.items() if c in types and types[c] != "null" and FAMILIES.get(types[c], types[c]) != FAMILIES.get(kind, kind)]


def coerced(df: DataFrame, contract: Contract) -> DataFrame:
    """df with the declared types; what does not fit them is null and counted as such by the rules."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c, kind in contract.types.items() if c in df.columns and df.schema[c].dataType.simpleString() != kind})


def violations(df: DataFrame, contract: Contract, by: Sequence[str] = ()) -> DataFrame:
    """by, column, check, n_rows of what fails: all rules in one aggregation; never a value of a cell.

    Uniqueness counts the rows of every repeated key, in a second aggregation on the key. An empty table fails nothing.
    """
    rules = contract.rules()
    counts = df.groupBy(*by).agg(*[F.count_if(bad).alias(f"_r{i}") for i, (_, _, bad) in enumerate(rules)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(n).alias("check"), F.col(f"_r{i}").alias("n_rows")) for i, (c, n, _) in enumerate(rules)])
    found = counts.select(*by, F.inline(entries)).filter("n_rows > 0")
    for keys in contract.unique:
        again = df.groupBy(*by, *[k for k in keys if k not in by]).agg(F.count("*").alias("_n")).filter("_n > 1")
        again = again.groupBy(*by).agg(F.sum("_n").alias("n_rows")).filter("n_rows > 0")
        found = found.unionByName(again.select(*by, F.lit(",".join(keys)).alias("column"), F.lit("unique").alias("check"), "n_rows"))
    return found


def split_files(df: DataFrame, contract: Contract, file: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the files without a violation, and one row for each quarantined file with its reasons.

    A single bad row quarantines its whole file. The list of bad files is a table of one row a file; the join
    with it is left to Catalyst, which broadcasts it by its measured size.
    """
    reasons = F.array_sort(F.collect_set(F.concat("check", F.lit(" on "), "column")))
    quarantined = violations(df, contract, [file]).groupBy(file).agg(reasons.alias("reasons"), F.sum("n_rows").alias("n_violations"))
    return df.join(quarantined.select(file), file, "left_anti"), quarantined


def partition_of(path: str | Column, default: str) -> Column:
    """The dt= or month= part of a path, or else the day of ingestion."""
    found = F.regexp_extract(path, r"(?:dt|month)=([^/]+)", 1)
    return F.when(found == "", F.lit(default)).otherwise(found)


def renamed_headers(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Columns by their declared names; a header that no alias names is an error, and so are two of one name."""
    names = {c: unicodedata.normalize("NFKC", c).strip() for c in df.columns}
    if unknown := sorted(n for n in names.values() if n not in aliases and n not in aliases.values()):
        raise ValueError(f"unknown_column_name: {', '.join(unknown)}")
    target = [aliases.get(names[c], names[c]) for c in df.columns]
    if len(set(target)) < len(target):
        raise ValueError("two columns of one name")
    return df.toDF(*target)
