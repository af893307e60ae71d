"""Streaming jobs with keyed state against their batch twins, micro-batch by micro-batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import health, stateful

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def streams(spark):
    before = spark.conf.get(stateful.STORE[0], None)
    spark.conf.set(*stateful.STORE)
    yield spark
    spark.conf.set(stateful.STORE[0], before) if before else spark.conf.unset(stateful.STORE[0])


def source(spark, path, schema, batches):
    """A stream of files, one a micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/b{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)


def ran(df, spark, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query, [tuple(r) for r in spark.table(name).collect()]


OBSERVED = "stream_id string, event_id long, sequence long, event_time timestamp, received_at timestamp"


def test_event_faults_equal_the_batch_twin_and_touch_their_own_rows_only(streams, tmp_path):
    rng, batches, at = random.Random(1), [], 0
    for b in range(4):
        rows = []
        for _ in range(60):
            at += 1
            e = rng.randrange(at) if rng.random() < 0.1 else at
            rows.append((f"s{e % 3}", e, max(1, e // 3 + rng.choice([0, 0, 0, 1, -1])), T0, T0 + dt.timedelta(seconds=at)))
        batches.append(rows)
    df = source(streams, str(tmp_path / "in"), OBSERVED, batches)
    streams.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a job with processing-time timers has no last batch
    try:
        query, got = ran(stateful.event_faults(df), streams, tmp_path, "faults")
    finally:
        streams.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    whole = health.with_faults(streams.createDataFrame([r for b in batches for r in b], OBSERVED))
    want = [tuple(r) for r in whole.select("stream_id", "event_id", "sequence", "fault").collect()]
    key = lambda r: (r[0], r[1], r[2], r[3] or "")
    assert sorted(got, key=key) == sorted(want, key=key) and {r[3] for r in got} >= {"duplicate", "gap", "out_of_order", None}
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert len(updated) == 4 and updated[-1] <= updated[0] + 20  # history does not count


FILL = "order_id string, sequence long, event_id long, event_time timestamp, quantity long, ordered long"


def fill_events(rng):
    rows, event = [], 0
    for o in range(12):
        n, ordered = rng.randrange(1, 9), rng.choice([20, 1000])
        for s in range(1, n + 1):
            if o % 4 == 3 and s == 3:
                continue  # a gap that never closes
            event += 1
            rows.append((f"o{o}", s, event, T0 + dt.timedelta(seconds=event), rng.randrange(1, 9), ordered))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_the_batch_result(streams, tmp_path, seed):
    rows = fill_events(random.Random(5))
    twin = [tuple(r) for r in stateful.contiguous_fills(streams.createDataFrame(rows, FILL)).collect()]
    random.Random(seed).shuffle(rows)
    closing = [("end", 1, 9_999, T0 + dt.timedelta(days=2), 1, 5)]  # carries the watermark past every wait
    batches = [rows[:20], rows[20:40], rows[40:], closing, [("end", 2, 10_000, T0 + dt.timedelta(days=3), 1, 5)]]
    _, got = ran(stateful.ordered_fills(source(streams, str(tmp_path / "in"), FILL, batches)), streams, tmp_path, f"fills{seed}")
    assert sorted(map(str, (r for r in got if r[0] != "end"))) == sorted(map(str, twin))
    assert {r[3] for r in got} == {"accepted", "over_fill", "frozen"}


def test_duplicate_sequences_and_overfill(streams, tmp_path):
    t = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("a", 1, 1, t(1), 5, 10), ("a", 1, 2, t(2), 5, 10), ("a", 2, 3, t(3), 6, 10), ("a", 3, 4, t(4), 1, 10), ("b", 2, 5, t(5), 1, 10)]
    want = [("a", 1, 1, "accepted", 5), ("a", 1, 2, "duplicate", None), ("a", 2, 3, "over_fill", 5), ("a", 3, 4, "frozen", None), ("b", 2, 5, "frozen", None)]
    assert sorted(map(str, (tuple(r) for r in stateful.contiguous_fills(streams.createDataFrame(rows, FILL)).collect()))) == sorted(map(str, want))
    _, got = ran(stateful.ordered_fills(source(streams, str(tmp_path / "in"), FILL, [rows])), streams, tmp_path, "overfill")
    assert sorted(map(str, got)) == sorted(map(str, want[:4]))  # b still waits


BEATS = "component string, event_time timestamp, kind string"


def test_staleness_is_told_without_a_new_row_and_starts_are_counted(streams, tmp_path):
    t = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[("a", t(0), "start"), ("a", t(10), "start"), ("a", t(20), "start"), ("b", t(5), "beat")], [("b", t(400), "beat"), ("a", t(30), "start")], [("b", t(900), "beat")], [("b", t(1000), "beat"), ("a", t(1001), "start")], [("b", t(1001), "beat")]]
    _, got = ran(stateful.component_watch(source(streams, str(tmp_path / "in"), BEATS, batches), 300, 60, 2, "1 second"), streams, tmp_path, "watch")
    starts = sorted(r[1:] for r in got if r[2] == "start")
    assert [(r[0], r[3]) for r in starts] == [(t(0), True), (t(10), True), (t(20), False), (t(30), False), (t(1001), True)]
    assert sorted((r[0], r[1]) for r in got if r[2] == "stale") == [("a", t(330)), ("b", t(305)), ("b", t(700))]


def test_late_rows_are_routed_and_a_replay_writes_nothing_twice(streams, tmp_path):
    schema = "id long, event_time timestamp"
    t = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[(1, t(100)), (2, t(1))], [(3, t(95)), (4, t(90)), (5, None)], [(6, t(500)), (7, t(89))], [(8, t(100)), (9, t(495))]]
    df = source(streams, str(tmp_path / "in"), schema, batches)
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    stateful.route_late(df, out, at, 10).trigger(availableNow=True).start().awaitTermination()
    read = lambda name: sorted(r.id for r in streams.read.schema(schema).parquet(f"{out}/{name}").collect())
    assert (read("on_time"), read("late")) == ([1, 2, 3, 6, 9], [4, 5, 7, 8])
    # The commit of the last batch is lost: it is run again over what it wrote.
    commits = tmp_path / "at" / "commits"
    for f in [*commits.glob("3*"), *commits.glob(".3*")]:
        f.unlink()
    stateful.route_late(df, out, at, 10).trigger(availableNow=True).start().awaitTermination()
    assert (read("on_time"), read("late")) == ([1, 2, 3, 6, 9], [4, 5, 7, 8])
