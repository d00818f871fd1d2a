"""The command line: 0 for done, 1 for problems found or a query denied, 2 for what is set up wrong."""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from pyspark.sql import SparkSession

from .operators import quality
from .plans import access, catalog, datasets, gateway, landing, platform, server, silver, stages
from .plans import spec as specs
from .plans.described import described
from .sources import tables


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("--lake", default="lake")
    p.add_argument("--warehouse", default="warehouse")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest", help="land or quarantine what has come in")
    ingest.add_argument("incoming")
    ingest.add_argument("--salt-variable", default="PLATFORM_SALT")
    ingest.add_argument("--overwrite", action="store_true")
    ingest.add_argument("--more", action="store_true")
    sub.add_parser("build", help="write every table, or the named ones and what they are made of").add_argument("tables", nargs="*")
    sub.add_parser("check-metrics", help="the specification, and reported figures that no variant names")
    sub.add_parser("scan", help="personal data in the landed files").add_argument("--declared", help="JSON: dataset: column: class")
    sub.add_parser("check-access", help="the policy, declarations, and what restricted roles would see")
    sub.add_parser("build-roles", help="write the copies of every role")
    query = sub.add_parser("query", help="one SELECT of a role")
    query.add_argument("role")
    query.add_argument("principal")
    query.add_argument("sql")
    query.add_argument("--limit", type=int, default=gateway.MOST_ROWS)
    sub.add_parser("serve-mcp", help=f"the catalog's tools over standard input and output, for the role and principal in {catalog.ROLE} and {catalog.PRINCIPAL}")
    sub.add_parser("catalog", help="the catalog as JSON").add_argument("--role")
    return p


def _models(spark: SparkSession, a: argparse.Namespace):
    return {p.rsplit("/", 1)[1]: spark.read.parquet(p) for p in tables.files(spark, f"{a.warehouse}/tables/[!_]*")}


def _scan(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    declared = json.loads(open(a.declared, encoding="utf-8").read()) if a.declared else {}
    out = []
    for ds in datasets.DATASETS:
        if ds.source == "KPI" or not tables.files(spark, f"{a.lake}/{ds.source}/{ds.name}"):
            continue
        paths = tables.files(spark, f"{a.lake}/{ds.source}/{ds.name}/*/*.parquet")
        found = {r.column: r.level for r in quality.personal_in_files(spark, paths).collect() if r.column != "landed_from"}
        out += [f"{ds.source}.{ds.name}.{c}: {v}" for c, v in quality.scan_verdicts(found, declared.get(f"{ds.source}.{ds.name}", {})).items()]
    return out


def run(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """The problems that the command found; it prints what it has to say."""
    if a.command == "ingest":
        report = landing.ingest(spark, a.incoming, a.lake, a.salt_variable, datetime.datetime.now(datetime.UTC), a.overwrite, a.more)
        print(f"landed {sum(r[4] for r in report.landed)} files, quarantined {len(report.quarantined)}")
        return []
    if a.command == "build":
        print(f"{len(platform.build(spark, a.lake, f'{a.warehouse}/tables', wanted=a.tables or None))} tables")
        return []
    if a.command == "check-metrics":
        unknown = specs.unknown_reported(specs.load(), silver.bronze(spark, a.lake)["reported_kpis"])
        return [f"{r.product}.{r.reported_as}: no variant" for r in unknown.orderBy("product", "reported_as").collect()]
    if a.command == "scan":
        return _scan(spark, a)
    models = _models(spark, a)
    columns, policy = described(models), access.load()
    allowed = access.allowlist(policy, models, columns)
    if a.command == "check-access":
        return access.undeclared(columns, models) + access.exposed(policy, allowed)
    if a.command == "build-roles":
        print(f"{sum(map(len, platform.build_roles(models, f'{a.warehouse}/roles').values()))} tables")
        return []
    if a.command == "catalog":
        full = catalog.build(models, columns, specs.load())
        print(json.dumps(catalog.of_role(full, a.role, allowed) if a.role else full, ensure_ascii=False, indent=1))
        return []
    if a.command == "serve-mcp":
        server.Server(catalog.from_environment(spark, allowed, catalog.build(models, columns, specs.load()), f"{a.warehouse}/roles", f"{a.lake}/audit")).serve(sys.stdin, sys.stdout)
        return []
    try:
        result = gateway.Gateway(spark, a.role, a.principal, allowed, f"{a.warehouse}/roles", f"{a.lake}/audit").query(a.sql, a.limit)
    except gateway.Denied as e:
        return [f"denied: {e.reason}"]
    print(json.dumps({"columns": result.columns, "rows": [[catalog.plain(v) for v in r] for r in result.rows]}, ensure_ascii=False))
    return []


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _arguments().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        problems = run(spark, a)
    except (stages.BuildError, specs.SpecError, access.PolicyError, gateway.GatewayError, RuntimeError, FileExistsError) as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return 2
    for p in problems:
        print(p, file=sys.stderr)
    return 1 if problems else 0


if __name__ == "__main__":
    sys.exit(main())
