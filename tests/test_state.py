"""Keyed state of the newest rows."""

import datetime as dt
import random
import time

from chatloom.operators import retain
from chatloom.sources import live as sources
from chatloom.streaming import state
from tests.conftest import rows

SCHEMA = "channel string, msg_key int, ts timestamp, message string"


def lot(seed, n):
    rng = random.Random(seed)
    start = dt.datetime(2025, 1, 1)
    hot = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
    return [(hot(), seed * 1000 + i, start + dt.timedelta(seconds=rng.randint(0, 500)) if rng.random() > 0.05 else None, f"m{i}") for i in range(n)]


def test_buffers_equal_the_batch_after_each_batch_and_restart(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    data = []
    for seed in range(3):
        fresh = lot(seed, 40)
        data += fresh
        spark.createDataFrame(fresh, SCHEMA).write.mode("append").parquet(landing)
        stream = sources.landing_stream(spark, landing, SCHEMA, "parquet")
        state.start_buffers(stream, out, checkpoint, n=6).awaitTermination()  # goes on from its state
        want = retain.last_n_per(spark.createDataFrame(data, SCHEMA), "channel", 6)
        assert rows(state.read_buffers(spark, out)) == rows(want)


def test_an_idle_channel_is_forgotten(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    at = dt.datetime(2025, 1, 1)

    def run(data, until):
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        stream = sources.landing_stream(spark, landing, SCHEMA, "parquet")
        query = state.start_buffers(stream, out, checkpoint, n=5, idle_seconds=2, every="500 milliseconds")
        started = time.monotonic()  # timers keep a query busy, so it never says that all is done
        while time.monotonic() < started + 60 and not any(p["numInputRows"] for p in query.recentProgress):
            time.sleep(0.2)
        time.sleep(until)
        query.stop()

    run([("a", 1, at, "x"), ("b", 2, at, "x")], 5)
    run([("a", 3, at, "x")], 0)
    got = sorted((r["channel"], r["msg_key"]) for r in state.read_buffers(spark, out).collect())
    assert got == [("a", 3), ("b", 2)]  # the buffer of "a" began anew, that of "b" is still there to read


def test_parts_keep_no_more_than_the_newest(spark):
    df = spark.createDataFrame(lot(1, 200), SCHEMA).coalesce(1)
    kept = state.trimmed(df, "channel", ("ts", "msg_key"), 4)
    assert rows(kept) == rows(retain.last_n_per(df, "channel", 4))
    assert state.trimmed(df.limit(0), "channel", ("ts", "msg_key"), 4).count() == 0
