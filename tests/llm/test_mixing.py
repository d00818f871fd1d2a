"""Mixes of rows that are equal or lack an id."""

from collections import defaultdict

from millrace.llm import mixing
from millrace.llm.common import written


def test_equal_rows_and_rows_without_id_are_taken_one_by_one(spark):
    ten = "w " * 10
    rows = [(None, ten, "a")] * 100 + [(7, ten, "b")] * 100 + [(i, f"x{i} " * 10, "c") for i in range(100)] + [(None, None, None), (None, "", "d")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), "test")
    got = mixing.mixed(docs).collect()
    taken = defaultdict(int)
    for r in got:
        assert r.mix.taken <= 3 * r.mix["size"] and r.mix.taken == r.mix.copies * r.mix["size"]
        taken[r.source] += r.mix.taken
    targets = {r.source: r.mix.target for r in got}
    assert len(got) == len(rows) and targets == {"a": 500.0, "b": 1000.0, "c": 1500.0, "d": 0.0, None: 0.0}
    assert taken == {"a": 500, "b": 1000, "c": 1500, "d": 0, None: 0}


def test_reruns_and_other_partitions_agree(spark):
    rows = [(i, f"t{i} " * (1 + i % 13), f"s{i % 5}", "own") for i in range(500)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, source string, mix string"), "test")
    runs = [{(r.doc_id, r.mix.taken) for r in mixing.mixed(d).collect()} for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == 500
