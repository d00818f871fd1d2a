"""Landing runs that die at every step, and what the next run makes of them."""

import json
import shutil
from pathlib import Path

import pytest

from millrace.plans import commits, landing
from millrace.plans.datasets import DATASETS
from millrace.sources import tables

from . import lake as files

OPENED = [d for d in DATASETS if d.name == "app_opened"]


class Died(Exception):
    pass


def incoming(spark, root):
    for day, who in (("02-10", "m1"), ("02-11", "m2")):
        files.parquet(spark, [(f"o{day}", files.at(day), files.at(day), who)], files.EVENT, f"{root}/A/app_opened/dt=2026-{day}/part-0.parquet")
    for day in ("02-12", "02-13"):
        Path(f"{root}/A/app_opened/dt=2026-{day}").mkdir(parents=True)
        Path(f"{root}/A/app_opened/dt=2026-{day}/part-0.parquet").write_bytes(b"no parquet")
    for d in Path(root).rglob("*.dir"):
        shutil.rmtree(d)


def land(spark, root):
    return landing.land(spark, f"{root}/in", f"{root}/lake", files.SALT, files.NOW, OPENED)


def tree(root):
    """Every file of data below root, without the parts of names that a run makes up."""
    found = [p.relative_to(root) for p in Path(root).rglob("*") if p.is_file() and not p.name.startswith(".")]
    return sorted(f"{p.parent}/{'part' if p.suffix == '.parquet' and p.name.startswith('part-') and 'in/' not in str(p) else p.name}" for p in found)


def state(spark, root):
    rows = sorted((r.event_id, str(r.dt)) for r in spark.read.parquet(f"{root}/lake/A/app_opened").collect())
    metas = {m: landing.meta(spark, f"{root}/lake", m).count() for m in ("landing_log", "quarantine_log", "period")}
    return rows, metas


@pytest.fixture(scope="module")
def committed(spark, tmp_path_factory):
    """A run that has died right after its commit, and the files of one that has not died."""
    root = tmp_path_factory.mktemp("commits")
    incoming(spark, root / "whole/in")
    shutil.copytree(root / "whole", root / "cut")
    report = land(spark, root / "whole")
    assert len(report.landed) == 2 and len(report.quarantined) == 2
    with pytest.MonkeyPatch.context() as m:
        m.setattr(commits, "finish", lambda *a: (_ for _ in ()).throw(Died))
        with pytest.raises(Died):
            land(spark, root / "cut")
    return root


def test_a_whole_run(spark, committed):
    rows, metas = state(spark, committed / "whole")
    assert rows == [("o02-10", "2026-02-10"), ("o02-11", "2026-02-11")] and metas == {"landing_log": 2, "quarantine_log": 2, "period": 1}
    assert [t for t in tree(committed / "whole") if t.startswith(("in/", "lake/_landing"))] == []
    assert len([t for t in tree(committed / "whole") if t.startswith("lake/quarantine/A/2026-02-1")]) == 4


def test_dying_at_every_step_of_the_way(spark, committed, tmp_path, monkeypatch):
    """The store's calls are cut off one later each time; the next run finishes the work, and nothing is there twice."""
    monkeypatch.setattr(commits, "AT_ONCE", 1)
    want, done, step = tree(committed / "whole"), False, 0
    while not done:
        root = tmp_path / str(step)
        shutil.copytree(committed / "cut", root)
        # Copies have other times of change.
        for manifest in root.rglob(commits.MANIFEST):
            text = manifest.read_text().replace(str(committed / "cut"), str(root))
            inputs = [i | {"changed": tables.stamp(spark, i["path"])[1]} for i in json.loads(text)]
            manifest.write_text(json.dumps(inputs))
            (manifest.parent / f".{commits.MANIFEST}.crc").unlink(missing_ok=True)
        left = [step]
        with pytest.MonkeyPatch.context() as m:
            for name in ("move", "remove", "write_text"):

                def cut(*a, call=getattr(tables, name)):
                    if left[0] == 0:
                        raise Died
                    left[0] -= 1
                    return call(*a)

                m.setattr(tables, name, cut)
            try:
                commits.recover(spark, f"{root}/lake")
                done = True
            except Died:
                pass
        commits.recover(spark, f"{root}/lake")
        assert tree(root) == want, step
        step += 1
    assert step > 10 and state(spark, root) == state(spark, committed / "whole")


def test_a_run_that_dies_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    incoming(spark, tmp_path / "in")
    before = tree(tmp_path)
    for name in ("append", "move"):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(tables, name, lambda *a: (_ for _ in ()).throw(Died))
            with pytest.raises(Died):
                land(spark, tmp_path)
        assert [t for t in tree(tmp_path) if "lake/_landing" not in t] == before
    land(spark, tmp_path)
    assert state(spark, tmp_path)[1] == {"landing_log": 2, "quarantine_log": 2, "period": 1}


def test_a_later_file_of_the_same_name_stays(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("new")
    commits._gone(spark, commits.Input(str(path), 3, 1))
    assert path.exists()
    length, changed = tables.stamp(spark, str(path))
    commits._gone(spark, commits.Input(str(path), length, changed))
    assert not path.exists() and tables.stamp(spark, str(path)) is None
