"""Sessions with state and timers: late rows are left out, sessions end once, open ones stay in the state."""

import datetime

import pytest

from lumengrid.streaming import images as stream
from lumengrid.streaming import stateful

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def test_sessions_merge_by_gap():
    assert stateful.merge_sessions([(10, 10, 1, 1.0), (0, 0, 1, 2.0), (4, 4, 1, 3.0), (16, 20, 2, 1.0)], 6) == [(0, 4, 2, 5.0), (10, 10, 1, 1.0), (16, 20, 2, 1.0)]
    assert stateful.merge_sessions([(0, 9, 3, 1.0), (2, 4, 1, 1.0)], 5) == [(0, 9, 4, 2.0)] and stateful.merge_sessions([], 5) == []


def test_late_rows_and_expired_state(spark, tmp_path):
    batches = [
        [(1, at(0), 1.0), (1, at(1), 2.0), (2, at(0.5), 5.0), (None, at(1), 9.0), (2, None, 9.0), (2, at(0.6), None)],
        [(1, at(10), 4.0), (2, at(1), 7.0)],  # the watermark is still before the start
        [(1, at(0.9), 100.0), (2, at(9), 3.0)],  # one row behind the watermark of 8 h, one before its time but not late
    ]
    for rows in batches:
        spark.createDataFrame(rows, "user_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    schema = spark.read.parquet(f"file://{tmp_path}/in").schema
    name, provider = stateful.PROVIDER
    spark.conf.set(name, provider)
    try:
        arriving = stream.stream_images(spark, f"file://{tmp_path}/in", schema, 1)
        query = stream.write(stateful.closed_sessions(arriving, 6 * 3_600_000), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        query.awaitTermination()
    finally:
        spark.conf.unset(name)
    ms = lambda hours: int(at(hours).timestamp() * 1000)
    got = sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").select("user_id", "start", "end", "n", "v").collect())
    # Users 1 and 2 close their first sessions; those of 9 h and 10 h are still open at the last watermark of 8 h.
    assert got == [(1, ms(0), ms(1), 2, 3.0), (2, ms(0.5), ms(1), 2, 12.0)]
    assert sum(p["numInputRows"] for p in query.recentProgress) == 10


@pytest.mark.parametrize("gap", [1, 3])
def test_a_session_is_emitted_once(spark, tmp_path, gap):
    for k in range(3):
        spark.createDataFrame([(7, at(5 * k), 1.0), (7, at(5 * k + gap * 0.5), 1.0)], "user_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    spark.conf.set(*stateful.PROVIDER)
    try:
        arriving = stream.stream_images(spark, f"file://{tmp_path}/in", spark.read.parquet(f"file://{tmp_path}/in").schema, 1)
        stream.write(stateful.closed_sessions(arriving, gap * 3_600_000, "0 seconds"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    finally:
        spark.conf.unset(stateful.PROVIDER[0])
    assert sorted((r.start, r.n) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [(int(at(5 * k).timestamp() * 1000), 2) for k in range(2)]
