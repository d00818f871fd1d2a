"""Late and repeated deliveries, followed as a stream, against one batch over all files."""

import datetime as dt
import random

import pytest

from millrace.operators import history, late
from millrace.sources import tables

SCHEMA = "event_id string, recorded_at timestamp, v int"


def deliveries(seed=4):
    """Three deliveries whose events overlap: some copies were recorded earlier than those that came before, some at the same time."""
    r, start = random.Random(seed), dt.datetime(2026, 1, 1)
    return [[(f"e{r.randrange(60)}", start + dt.timedelta(hours=r.randrange(20)), r.randrange(9)) for _ in range(80)] + [(None, start, n)] for n in range(3)]


def deliver(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/dt={name}/{name}.parquet")


def rows(df):
    return sorted(map(str, (tuple(r)[:3] for r in df.select("event_id", "recorded_at", "v").collect())))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_any_order_gives_the_rows_of_one_batch(spark, tmp_path, order):
    come, incoming, into = deliveries(), f"{tmp_path}/in", f"{tmp_path}/table"
    assert late.first_copies(spark, into, SCHEMA).count() == 0
    for done, n in enumerate(order):
        deliver(spark, incoming, come[n], f"d{n}")
        assert late.follow(spark, incoming, into, SCHEMA) >= (1 if done == 2 else done + 1)
        if done == 1:
            late.merge(spark, into, SCHEMA)
    assert late.follow(spark, incoming, into, SCHEMA) == 1  # nothing new, one part since the merge
    whole = tables.events(spark, incoming, SCHEMA)
    want = rows(history.deduplicated(whole))
    # Copies of one event that were recorded at the same time are told apart by their file.
    assert rows(late.first_copies(spark, into, SCHEMA)) == want and len(want) > 50
    late.merge(spark, into, SCHEMA)
    late.merge(spark, into, SCHEMA)
    assert rows(late.first_copies(spark, into, SCHEMA)) == want
    assert [p.rsplit("/", 1)[1] for p in tables.files(spark, f"{into}/[mp]*")] == ["merged-2"]


def test_a_batch_that_runs_again_and_a_merge_that_dies(spark, tmp_path):
    come, incoming, into = deliveries(), f"{tmp_path}/in", f"{tmp_path}/table"
    for n in (0, 1):
        deliver(spark, incoming, come[n], f"d{n}")
        late.follow(spark, incoming, into, SCHEMA)
    want = rows(late.first_copies(spark, into, SCHEMA))
    # The last batch was written, and its commit was lost: the next run takes its files in again.
    for f in (tmp_path / "table/_checkpoint/commits").iterdir():
        if f.name.strip(".").startswith("1"):
            f.unlink()
    late.follow(spark, incoming, into, SCHEMA)
    assert rows(late.first_copies(spark, into, SCHEMA)) == want
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tables, "remove", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            late.merge(spark, into, SCHEMA)
    assert rows(late.first_copies(spark, into, SCHEMA)) == want
    late.merge(spark, into, SCHEMA)
    assert rows(late.first_copies(spark, into, SCHEMA)) == want and tables.files(spark, f"{into}/part-*") == []
