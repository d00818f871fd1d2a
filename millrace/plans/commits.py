"""Landing in one piece.

A run prepares everything beside the lake: the rows that land, the rows of the meta tables, and a manifest of the files
that have to go. Renaming the manifest into place commits the run. What the manifest says is then done: prepared files
move into the lake, bad files into quarantine, and landed files go. Every step looks at what is there first, so a run that
dies on the way is finished by the next one, from the manifest, and one that dies before its manifest stands has
changed nothing and is thrown away. Either way no row lands twice and none is lost. One run at a time writes a lake.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from ..sources import tables

#: The folder of runs that are not finished, and the name of a manifest.
OPEN, MANIFEST = "_landing", "manifest.json"
#: Moves and removals at the same time; they are calls to the store's directory and carry no data.
AT_ONCE = 16


@dataclass(frozen=True)
class Input:
    """A file that came in, and which one of that name it was."""

    path: str
    length: int
    changed: int
    #: Where it goes with a document of the reasons; None if it landed and goes away.
    to: str | None = None
    document: str = ""


def prepared(lake: str, run: str) -> str:
    """The folder in which a run prepares files, laid out like the lake."""
    return f"{lake}/{OPEN}/{run}/files"


def commit(spark: SparkSession, lake: str, run: str, inputs: Sequence[Input]) -> None:
    """From here on the run is finished whatever happens."""
    home = f"{lake}/{OPEN}/{run}"
    tables.write_text(spark, f"{home}/{MANIFEST}.part", json.dumps([asdict(i) for i in inputs], ensure_ascii=False))
    tables.move(spark, f"{home}/{MANIFEST}.part", f"{home}/{MANIFEST}")


def finish(spark: SparkSession, lake: str, run: str) -> None:
    """Does what is left of a committed run."""
    home, beside = f"{lake}/{OPEN}/{run}", prepared(lake, run)
    inputs = [Input(**i) for i in json.loads(tables.read_text(spark, f"{home}/{MANIFEST}"))]
    # Parquet files have names of their own, so none meets another.
    found = [(f, f"{lake}/{relative}") for f, relative in tables.tree(spark, beside) if relative.endswith(".parquet")]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(lambda m: tables.move(spark, *m), found))
        list(pool.map(lambda i: _gone(spark, i), inputs))
    tables.remove(spark, home)


def _gone(spark: SparkSession, own: Input) -> None:
    """Moves or removes an input, if it is still the file that the run read; a later one of its name stays."""
    if own.to is not None:
        tables.write_text(spark, f"{own.to}.reason.json", own.document)
    if tables.stamp(spark, own.path) == (own.length, own.changed):
        if own.to is None:
            tables.remove(spark, own.path)
        else:
            tables.move(spark, own.path, own.to)


def recover(spark: SparkSession, lake: str) -> list[str]:
    """Finishes the runs that died after their commit, throws away those that died before it, and names the finished ones."""
    done = []
    for home in tables.files(spark, f"{lake}/{OPEN}/*"):
        run = home.rsplit("/", 1)[1]
        if tables.files(spark, f"{home}/{MANIFEST}"):
            finish(spark, lake, run)
            done.append(run)
        else:
            tables.remove(spark, home)
    return done
