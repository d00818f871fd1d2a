"""Staged builds on a graph of small tables."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import stages
from millrace.plans.stages import BuildError, Model


def graph(fail=False):
    def broken(t):
        if fail:
            raise ValueError("no table today")
        return t["b"].withColumn("n", F.col("n") + 1)

    return {
        "d": Model(("b", "c"), lambda t: t["b"].unionByName(t["c"])),
        "c": Model(("b",), broken),
        "b": Model(("a", "raw"), lambda t: t["a"].join(t["raw"].select("k"), "k"), passing=True),
        "a": Model(("raw",), lambda t: t["raw"].groupBy("k").agg(F.count("*").alias("n"))),
        "alone": Model(("raw",), lambda t: t["raw"].distinct()),
    }


def test_order():
    assert stages.waves(graph(), ["raw"]) == [["a", "alone"], ["b"], ["c"], ["d"]]
    assert stages.waves(graph(), ["raw"], ["c"]) == [["a"], ["b"], ["c"]]
    for bad, why in (({"a": Model(("x",), None)}, "a needs x"), ({"a": Model(("b",), None), "b": Model(("a",), None)}, "need one another"), ({"raw": Model((), None)}, "at once")):
        with pytest.raises(BuildError, match=why):
            stages.waves(bad, ["raw"])
    with pytest.raises(BuildError, match="no model z"):
        stages.waves(graph(), ["raw"], ["z"])


def test_every_table_is_written_once_from_stored_ones(spark, tmp_path):
    raw = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int")
    raw.write.parquet(f"{tmp_path}/raw")
    raw, folder, read = spark.read.parquet(f"{tmp_path}/raw"), f"{tmp_path}/tables", {}

    def spied(name, model):
        def make(t):
            df = model.make(t)
            read.setdefault(name, []).append({f.rsplit("/", 2)[1] for f in df.inputFiles()})
            return df

        return Model(model.inputs, make, model.passing)

    out = stages.stored(spark, {n: spied(n, m) for n, m in graph().items()}, {"raw": raw}, folder)
    assert read == {"a": [{"raw"}], "alone": [{"raw"}], "b": [{"a", "raw"}], "c": [{"b"}], "d": [{"b", "c"}]}
    assert sorted(map(tuple, out["d"].collect())) == [("x", 2), ("x", 2), ("x", 3), ("x", 3), ("y", 1), ("y", 2)]
    assert sorted(p.name for p in (tmp_path / "tables").iterdir()) == ["a", "alone", "c", "d"]


def test_a_build_that_fails_changes_nothing(spark, tmp_path):
    folder = f"{tmp_path}/tables"
    one, two = (spark.createDataFrame([("x", i)] * i, "k string, v int") for i in (1, 2))
    before = stages.stored(spark, graph(), {"raw": one}, folder)
    assert before["a"].first().n == 1
    with pytest.raises(ValueError, match="no table today"):
        stages.stored(spark, graph(fail=True), {"raw": two}, folder)
    assert spark.read.parquet(f"{folder}/a").first().n == 1 and sorted(p.name for p in (tmp_path / "tables").iterdir()) == ["a", "alone", "c", "d"]
    # A part of the graph leaves the other tables alone; a second build takes the place of the first.
    out = stages.stored(spark, graph(), {"raw": two}, folder, ["a"])
    assert list(out) == ["a"] and out["a"].first().n == 2
    assert spark.read.parquet(f"{folder}/c").first().n == 2 and spark.read.parquet(f"{folder}/alone").first().v == 1


def test_a_model_reads_what_it_names(spark):
    raw = spark.range(1).withColumnRenamed("id", "k")
    with pytest.raises(BuildError, match="a reads other"):
        stages.planned({"a": Model(("raw",), lambda t: t["other"])}, {"raw": raw, "other": raw})
    assert set(stages.planned(graph(), {"raw": raw})) == {"a", "alone", "c", "d"}
