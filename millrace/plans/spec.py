"""Metrics from their specification: validation, metric tables, reconciliation, and guards."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import metrics
from .stages import Model

KINDS = ("distinct_entities_in_window", "sum_by_month", "lapsed_between_windows", "rows_per_active")
SCOPES = ("all", "source", "population")
DIRECTIONS = ("higher", "lower", "any")
#: Columns of a metric table that no metric may be called.
RESERVED = ("period_month", "product")
NUMBER = "decimal(28,6)"
_VARIANT = "product string, reported_as string, expected_direction string, direction_tolerance_pct double, threshold_pct double, comparable boolean"


class SpecError(ValueError):
    """The specification does not say what it has to."""


@dataclass(frozen=True)
class Variant:
    product: str
    reported_as: str
    definition: str
    expected_direction: str = "any"
    direction_tolerance_pct: float = 0.0
    threshold_pct: float = 0.0
    comparable: bool = True
    note: str = ""


@dataclass(frozen=True)
class Metric:
    name: str
    kind: str
    definition: dict
    description: str = ""
    owner: str = ""
    entity: str = ""
    grain: tuple[str, ...] = ()
    scopes: dict[str, str] | None = None
    known_variants: tuple[Variant, ...] = ()

    @property
    def value_type(self) -> str:
        return NUMBER if self.kind == "rows_per_active" else "long"


@dataclass(frozen=True)
class Spec:
    metrics: tuple[Metric, ...]

    def by_name(self, name: str) -> Metric:
        found = [m for m in self.metrics if m.name == name]
        if not found:
            raise SpecError(f"no metric {name}")
        return found[0]

    def base_of(self, metric: Metric) -> Metric:
        """The window metric that a derived one builds on, or the metric itself."""
        return self.by_name(metric.definition["active_metric"]) if "active_metric" in metric.definition else metric

    def scopes_of(self, metric: Metric) -> dict[str, str]:
        scopes = self.base_of(metric).scopes
        if not scopes:
            raise SpecError(f"{metric.name}: no scopes")
        return scopes


def _require(holds: bool, message: str) -> None:
    if not holds:
        raise SpecError(message)


def _variant(raw: Mapping, metric: str) -> Variant:
    _require({"product", "reported_as", "definition"} <= raw.keys(), f"{metric}: a variant needs product, reported_as and definition")
    own = Variant(**{k: v for k, v in raw.items() if k in Variant.__dataclass_fields__})
    where = f"{metric}/{own.reported_as}"
    _require(own.expected_direction in DIRECTIONS, f"{where}: direction has to be one of {DIRECTIONS}")
    _require(not own.comparable or own.threshold_pct > 0, f"{where}: comparable without threshold_pct")
    _require(own.comparable or bool(own.note), f"{where}: not comparable without a note")
    return own


def parse(raw: Mapping) -> Spec:
    _require(raw.get("version") == 1, "version has to be 1")
    found = []
    for item in raw.get("metrics", []):
        name, kind, scopes = item.get("name", ""), item.get("kind"), item.get("scopes") or {}
        _require(bool(name), "a metric without name")
        _require(name not in RESERVED, f"{name}: reserved")
        _require(kind in KINDS, f"{name}: kind has to be one of {KINDS}")
        _require(set(scopes.values()) <= set(SCOPES), f"{name}: scopes have to be of {SCOPES}")
        _require(kind != "sum_by_month" or "population" not in scopes.values(), f"{name}: sums have no population scope")
        found.append(Metric(name, kind, dict(item.get("definition", {})), item.get("description", ""), item.get("owner", ""), item.get("entity", ""), tuple(item.get("grain", ())), scopes, tuple(_variant(v, name) for v in item.get("known_variants", []))))
    _require(len({m.name for m in found}) == len(found), "two metrics of one name")
    pairs = [(v.product, v.reported_as) for m in found for v in m.known_variants]
    _require(len(set(pairs)) == len(pairs), "a variant of two metrics")
    spec = Spec(tuple(found))
    for m in spec.metrics:
        if m.kind in KINDS[2:]:
            _require(isinstance(m.definition.get("active_metric"), str) and spec.by_name(m.definition["active_metric"]).kind == KINDS[0], f"{m.name}: active_metric has to name a window metric")
        spec.scopes_of(m)
    return spec


def load(path: str | Path = Path(__file__).with_name("metrics.yml")) -> Spec:
    return parse(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def unknown_reported(spec: Spec, reported: DataFrame) -> DataFrame:
    """Reported figures that are a variant of no metric."""
    known = [(v.product, v.reported_as) for m in spec.metrics for v in m.known_variants]
    names = reported.sparkSession.createDataFrame(known, "product string, reported_as string")
    return reported.select("product", "reported_as").distinct().join(F.broadcast(names), ["product", "reported_as"], "left_anti")


def _active(spec: Spec, metric: Metric, models: Mapping[str, DataFrame]) -> DataFrame:
    """month, scope, entity, n_rows of a window metric."""
    d, scopes = metric.definition, spec.scopes_of(metric)
    rows = models[d["model"]].filter(d["filter"]) if d.get("filter") else models[d["model"]]
    rows = rows.select(F.col(d["entity_column"]).alias("entity"), F.col(d["date_column"]).alias("day"), F.col(d["source_column"]).alias("source")).filter("entity is not null")
    populations = [p for p, k in scopes.items() if k == "population"]
    if populations:
        rows = metrics.with_population(rows, "entity", models["dim_member_product"].withColumnRenamed("member_key", "entity"), populations)
    return metrics.active(rows, "entity", "day", metrics.scope_column("source", scopes), d.get("window_days", 30))


def table(spec: Spec, metric: Metric, models: Mapping[str, DataFrame], spine: DataFrame) -> DataFrame:
    """period_month, product and the metric, on the whole grid of months and scopes."""
    d, base = metric.definition, spec.base_of(metric)
    if metric.kind == "sum_by_month":
        rows, value = models[d["model"]], "total"
        found = metrics.sum_by_month(rows, d["amount_column"], scalars.month_start(scalars.tokyo_time(d["timestamp_column"])), metrics.scope_column(d["source_column"], spec.scopes_of(metric)))
    elif metric.kind == "distinct_entities_in_window":
        found, value = _active(spec, base, models).groupBy("month", "scope").agg(F.count("*").alias("active")), "active"
    elif metric.kind == "lapsed_between_windows":
        found, value = metrics.lapsed(_active(spec, base, models), "entity"), "lapsed"
    else:
        found, value = metrics.rows_per_active(_active(spec, base, models)), "per_active"
    scopes = spine.sparkSession.createDataFrame([(p,) for p in spec.scopes_of(metric)], "scope string")
    grid = metrics.on_grid(found, spine, scopes, value, metric.value_type)
    return grid.select(F.col("month").alias("period_month"), F.col("scope").alias("product"), F.col(value).alias(metric.name))


def variants(spark: SparkSession, metric: Metric) -> DataFrame:
    return spark.createDataFrame([(v.product, v.reported_as, v.expected_direction, float(v.direction_tolerance_pct), float(v.threshold_pct), v.comparable) for v in metric.known_variants], _VARIANT)


def reconciliation(metric: Metric, own: DataFrame, reported: DataFrame) -> DataFrame:
    """What the products report beside the metric table, as decimals."""
    found = metrics.reconcile(reported.drop("definition"), own.withColumnRenamed(metric.name, "value").withColumn("value", F.col("value").cast("double")), variants(reported.sparkSession, metric))
    return found.withColumns({c: F.col(c).cast(NUMBER) for c in ("reported_value", "canonical_value", "diff", "diff_pct", "threshold_pct")})


def graph(spec: Spec) -> dict[str, Model]:
    """metric_* and recon_* for every metric, by the tables that they are made of."""
    out = {}
    for m in spec.metrics:
        base = m if m.kind == "sum_by_month" else spec.base_of(m)
        people = ("dim_member_product",) if "population" in spec.scopes_of(m).values() else ()
        out[f"metric_{m.name}"] = Model((base.definition["model"], "dim_month", *people), lambda t, m=m: table(spec, m, t, t["dim_month"]))
        out[f"recon_{m.name}"] = Model((f"metric_{m.name}", "reported_kpis"), lambda t, m=m: reconciliation(m, t[f"metric_{m.name}"], t["reported_kpis"]))
    return out
