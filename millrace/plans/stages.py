"""Staged builds: tables that name the tables they are made of, written in that order, each once.

A table is planned on the stored form of its inputs, so no plan goes further back than one step, and what many tables
share is computed once. Everything is written beside what is there and moved into place when the whole build has
succeeded: a build that fails changes nothing, and a reader finds a table whole, the old or the new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..sources import tables

#: Tables of one wave that are written at the same time.
AT_ONCE = 4


class BuildError(RuntimeError):
    """The graph of tables is not one."""


@dataclass(frozen=True)
class Model:
    #: Names of the tables that `make` reads; it is given these and no other.
    inputs: tuple[str, ...]
    make: Callable[[Mapping[str, DataFrame]], DataFrame]
    #: A table that only other tables need; it goes when the build is done.
    passing: bool = False


Graph = Mapping[str, Model]


class _Inputs(Mapping):
    """The declared inputs of one model."""

    def __init__(self, name: str, model: Model, of: Mapping[str, DataFrame]):
        self.name, self.own = name, {i: of[i] for i in model.inputs}

    def __getitem__(self, key: str) -> DataFrame:
        if key not in self.own:
            raise BuildError(f"{self.name} reads {key}, which it does not name")
        return self.own[key]

    def __iter__(self) -> Iterator[str]:
        return iter(self.own)

    def __len__(self) -> int:
        return len(self.own)


def waves(graph: Graph, sources: Iterable[str], wanted: Iterable[str] | None = None) -> list[list[str]]:
    """The models in order, those that do not need one another together; with wanted, these and all they are made of."""
    sources = set(sources)
    if unknown := sorted({f"{n} needs {i}" for n, m in graph.items() for i in m.inputs if i not in graph and i not in sources}):
        raise BuildError(f"unknown inputs: {', '.join(unknown)}")
    if both := sorted(sources & graph.keys()):
        raise BuildError(f"sources and models at once: {', '.join(both)}")
    needed, open_ = set(), list(graph if wanted is None else wanted)
    while open_:
        name = open_.pop()
        if name not in graph:
            raise BuildError(f"no model {name}")
        if name not in needed:
            needed.add(name)
            open_ += [i for i in graph[name].inputs if i in graph]
    sorter = TopologicalSorter({n: [i for i in graph[n].inputs if i in graph] for n in needed})
    try:
        sorter.prepare()
    except CycleError as e:
        raise BuildError(f"models that need one another: {', '.join(e.args[1])}") from None
    out = []
    while sorter.is_active():
        out.append(sorted(sorter.get_ready()))
        sorter.done(*out[-1])
    return out


def planned(graph: Graph, sources: Mapping[str, DataFrame], wanted: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Every model as a plan over the sources; nothing is written."""
    out = dict(sources)
    for name in (n for wave in waves(graph, sources, wanted) for n in wave):
        out[name] = graph[name].make(_Inputs(name, graph[name], out))
    return {n: df for n, df in out.items() if n in graph and not graph[n].passing}


def stored(spark: SparkSession, graph: Graph, sources: Mapping[str, DataFrame], folder: str, wanted: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Every model as a table in folder, read again; passing ones are gone. With wanted, the other tables stay as they are."""
    beside = f"{folder}/_build-{uuid.uuid4().hex}"
    made = dict(sources)

    def write(name: str) -> DataFrame:
        df = graph[name].make(_Inputs(name, graph[name], made))
        df.write.parquet(f"{beside}/{name}")
        return spark.read.schema(df.schema).parquet(f"{beside}/{name}")

    names = []
    try:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for wave in waves(graph, sources, wanted):
                made |= zip(wave, pool.map(inheritable_thread_target(spark)(write), wave), strict=True)
                names += wave
        kept = [n for n in names if not graph[n].passing]
        for name in kept:
            tables.swapped(spark, f"{beside}/{name}", f"{folder}/{name}")
        return {n: spark.read.schema(made[n].schema).parquet(f"{folder}/{n}") for n in kept}
    finally:
        tables.remove(spark, beside)
