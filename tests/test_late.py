"""Windowed sums that lose no late row, against the batch result and a plain count of late rows."""

import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from merchantry.plans.monitoring import quality_counts, quality_rates
from merchantry.sources.tables import stream_table
from merchantry.streaming import late
from tests.test_streaming import EVENTS, finish

BACKLOG = 110  # more batches than the progress log of a stream keeps


def batch_counts(events):
    hour = F.date_trunc("hour", "at").cast("timestamp_ntz").alias("h")
    return events.where(F.col("at").isNotNull()).groupBy(hour, "kind").count()


def expected_marks(batches, lateness):
    newest, out = None, []
    for times in batches:
        dated = [t for t in times if t is not None]
        behind = [t for t in dated if newest is not None and t < newest - lateness]
        newest = max([*dated, *([newest] if newest else [])], default=None)
        out.append((newest, len(dated) - len(behind), len(behind), len(times) - len(dated)))
    return out


def test_out_of_order_backlog_equals_the_batch(spark, rows, tmp_path):
    """A stream over many small files in no order of time, a third of the rows in one window."""
    random.seed(5)
    first, hot = datetime(2024, 1, 1), datetime(2024, 1, 20, 7)
    folder, state = f"{tmp_path}/in", late.activity_state(f"{tmp_path}/state", "at", "kind")
    made = []
    for _ in range(4 * BACKLOG):
        at = hot if random.random() < 0.33 else first + timedelta(minutes=random.randrange(40 * 24 * 60))
        made.append((None if random.random() < 0.02 else at, random.choice(["a", "b", None]), D(1), False))
    events = spark.createDataFrame(made, EVENTS)
    events.repartition(BACKLOG).write.parquet(folder)
    stream = stream_table(spark, folder, EVENTS, 1)
    finish(late.keep_exact(stream, state, f"{tmp_path}/checkpoint"))
    assert rows(state.windows(spark), "window_start", "kind", "changes") == rows(batch_counts(events))
    marks = state.marks(spark).orderBy("batch").collect()
    arrived = rows(state.late_rows(spark, EVENTS), "at")
    assert len(marks) == BACKLOG and sum(m["late"] for m in marks) == len(arrived) > 0
    assert sum(m["in_time"] + m["late"] + m["undated"] for m in marks) == len(made)


def batches(spark):
    at = lambda *a: datetime(2024, *a)
    parts = [
        [at(1, 10, 10), at(1, 10, 10, 30), at(2, 1)],
        [at(1, 10, 10, 59), at(1, 25), at(1, 24, 23, 59), None],
        [],
        [at(1, 10, 11), at(2, 1, 5)],
    ]
    return parts, [spark.createDataFrame([(t, "k", D(5), True) for t in p], EVENTS) for p in parts]


def test_marks_late_rows_and_retries(spark, rows, tmp_path):
    """Every batch taken in twice, as after a failure, leaves what one run leaves."""
    parts, frames = batches(spark)
    state = late.activity_state(f"{tmp_path}/s", "at", "kind")
    for i, frame in enumerate(frames):
        for _ in range(2):
            state.add(frame, i)
    found = rows(state.marks(spark).orderBy("batch"), "batch", "newest", "in_time", "late", "undated")
    assert [r[1:] for r in found] == expected_marks(parts, late.WEEK)
    whole = frames[0].unionByName(frames[1]).unionByName(frames[3])
    assert rows(state.windows(spark), "window_start", "kind", "changes") == rows(batch_counts(whole))
    assert rows(state.late_rows(spark, EVENTS), "at") == [(t,) for t in sorted([parts[1][0], parts[1][2], parts[3][0]])]


@pytest.mark.parametrize("cut", ["_put", "_forget"])
def test_a_batch_that_dies_is_taken_in_again(spark, rows, tmp_path, monkeypatch, cut):
    _, frames = batches(spark)
    state = late.activity_state(f"{tmp_path}/s", "at", "kind")
    state.add(frames[0], 0)
    state.add(frames[1], 1)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(late, cut, dies) if cut == "_put" else patch.setattr(late.WindowedState, cut, dies)
        with pytest.raises(RuntimeError):
            state.add(frames[3], 2)
    state.add(frames[3], 2)
    whole = frames[0].unionByName(frames[1]).unionByName(frames[3])
    assert rows(state.windows(spark), "window_start", "kind", "changes") == rows(batch_counts(whole))


def test_only_touched_days_are_read_and_old_versions_go(spark, tmp_path):
    state = late.activity_state(f"{tmp_path}/s", "at", "kind")
    for i in range(6):
        day = datetime(2024, 1, 1) if i == 0 else datetime(2024, 1, 2)
        state.add(spark.createDataFrame([(day, "k", D(1), False)], EVENTS), i)
    left = sorted(p.parent.name for p in (tmp_path / "s" / "state").glob("*/day=2024-01-02"))
    assert left == ["batch=4", "batch=5"]
    assert (tmp_path / "s" / "state" / "batch=0" / "day=2024-01-01").exists()


def test_quality_and_nothing(spark, rows, tmp_path):
    _, frames = batches(spark)
    state = late.quality_state(f"{tmp_path}/q", "at", 4)
    with pytest.raises(ValueError):
        state.windows(spark)
    for i, frame in enumerate(frames):
        state.add(frame, i)
    whole = frames[0].unionByName(frames[1]).unionByName(frames[3]).where("at is not null")
    hour = F.date_trunc("hour", "at").cast("timestamp_ntz").alias("window_start")
    wanted = whole.groupBy(hour).agg(*quality_counts(4)).select("window_start", *quality_rates())
    assert rows(late.running_quality(state, spark)) == rows(wanted)
    empty = late.activity_state(f"{tmp_path}/e", "at", "kind")
    empty.add(frames[2], 0)
    assert empty.late_rows(spark, EVENTS).count() == 0 and empty.marks(spark).first()["newest"] is None
