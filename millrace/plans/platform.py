"""From a landed lake to every table, and to the copies of every role."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables
from . import access, silver, stages
from . import spec as specs
from .described import described

PLAN_SEED = str(Path(__file__).with_name("dim_plan.csv"))


def plans(spark: SparkSession, path: str = PLAN_SEED) -> DataFrame:
    """The seed as it stands in the repository, read on the driver: a few rows."""
    import csv

    with open(path, encoding="utf-8") as f:
        rows = [[v or None for v in r] for r in csv.reader(f)][1:]
    return spark.createDataFrame([(*r[:-1], int(r[-1])) for r in rows], silver.PLANS)


def graph(spec: specs.Spec | None = None) -> dict[str, stages.Model]:
    """Every silver and gold table by the tables that it is made of."""
    return silver.GRAPH | specs.graph(spec or specs.load())


def sources(spark: SparkSession, lake: str) -> dict[str, DataFrame]:
    return silver.bronze(spark, lake) | {"plan_seed": plans(spark)}


def planned(spark: SparkSession, lake: str, spec: specs.Spec | None = None) -> dict[str, DataFrame]:
    """Every table as a plan over bronze; nothing is run yet."""
    return stages.planned(graph(spec), sources(spark, lake))


def build(spark: SparkSession, lake: str, folder: str, spec: specs.Spec | None = None, wanted: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The tables written in the order in which they build on one another, each on the stored ones before it; all of them, or those wanted and what these are made of."""
    return stages.stored(spark, graph(spec), sources(spark, lake), folder, wanted)


def build_roles(models: dict[str, DataFrame], folder: str, policy: access.Policy | None = None) -> dict:
    """Writes the copies of every role, each from scratch, and returns what each may see; a reader finds a role's old copies or its new ones."""
    policy = policy or access.load()
    columns = described(models)
    allowed = access.allowlist(policy, models, columns)
    if problems := access.exposed(policy, allowed):
        raise access.PolicyError("; ".join(problems))
    spark = next(iter(models.values())).sparkSession
    beside = f"{folder}/_roles-{uuid.uuid4().hex}"
    try:
        for role in policy.roles:
            access.write_copies(access.copies(policy, role, models, columns), f"{beside}/{role.name}")
        for role in policy.roles:
            if tables.files(spark, f"{beside}/{role.name}"):
                tables.swapped(spark, f"{beside}/{role.name}", f"{folder}/{role.name}")
            else:
                tables.remove(spark, f"{folder}/{role.name}")
    finally:
        tables.remove(spark, beside)
    return allowed
