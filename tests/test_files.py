"""Footers and heads of Parquet files: what they say, and how little of a file they read."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.operators import quality
from millrace.sources import tables


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, path):
        self.file, self.read_bytes, self.closed = open(path, "rb"), 0, False

    def read(self, n=-1):
        out = self.file.read(n)
        self.read_bytes += len(out)
        return out

    def seek(self, at, whence=0):
        return self.file.seek(at, whence)

    def tell(self):
        return self.file.tell()

    def close(self):
        self.file.close()

    def readable(self):
        return True

    def seekable(self):
        return True

    def writable(self):
        return False


@pytest.fixture
def folder(tmp_path):
    pq.write_table(pa.table({"email": ["a@b.co", "c@d.co"] * 40 + ["x"] * 400, "n": list(range(480))}), tmp_path / "direct at first.parquet")
    pq.write_table(pa.table({"email": ["x"] * 100 + ["a@b.co"] * 1000, "n": list(range(1100))}), tmp_path / "later=1%2F.parquet")
    pq.write_table(pa.table({"email": pa.array([], pa.string()), "weird": pa.array([], pa.null())}), tmp_path / "none.parquet")
    return tmp_path


def test_footers(spark, folder):
    (folder / "broken.parquet").write_bytes(b"PAR1 no more")
    (folder / "empty.parquet").write_bytes(b"")
    got = {r.file.rsplit("/", 1)[1]: (r.columns, r.types, r.error) for r in tables.footers(spark, tables.files(spark, f"{folder}/*.parquet")).collect()}
    assert got == {
        "direct at first.parquet": (["email", "n"], ["string", "bigint"], None),
        "later=1%2F.parquet": (["email", "n"], ["string", "bigint"], None),
        "none.parquet": (["email", "weird"], ["string", "null"], None),
        "broken.parquet": ([], [], "ArrowInvalid"),
        "empty.parquet": ([], [], "EmptyFile"),
    }
    assert tables.footers(spark, []).count() == 0


def test_the_first_rows_of_each_file_are_judged(spark, folder):
    found = quality.personal_in_files(spark, tables.files(spark, f"{folder}/*.parquet"))
    assert {r.column: (r.level, r.reasons) for r in found.collect()} == {"email": ("direct", ["e-mail name", "e-mail values"]), "n": ("none", []), "weird": ("none", [])}
    later = quality.personal_in_files(spark, tables.files(spark, f"{folder}/later*"))
    assert {r.column: r.reasons for r in later.collect()}["email"] == ["e-mail name"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Window" not in plan


def test_other_stores_are_read_through_the_engine(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "DIRECT", set())
    got = {r.error for r in tables.footers(spark, tables.files(spark, f"{folder}/*.parquet")).collect()}
    assert got == {None}


def test_bytes_read_do_not_follow_the_size_of_a_file(tmp_path):
    r, read = np.random.default_rng(3), []
    for n in (100_000, 1_000_000):
        path = tmp_path / f"{n}.parquet"
        pq.write_table(pa.table({"v": r.random(n), "t": [f"text {x}" for x in r.integers(0, 1 << 60, n)]}), path, row_group_size=n, use_dictionary=False)
        foot, head = Counted(path), Counted(path)
        tables.parquet_in(pa.PythonFile(foot)).schema_arrow
        rows = next(tables.parquet_in(pa.PythonFile(head)).iter_batches(batch_size=100))
        assert rows.num_rows == 100
        read.append((foot.read_bytes, head.read_bytes, path.stat().st_size))
    assert read[1][2] > 9 * read[0][2] and read[1][2] > 20_000_000
    assert max(f for f, _, _ in read) < 150_000 and max(h for _, h, _ in read) < 4_000_000 and read[1][1] < 1.3 * read[0][1]
