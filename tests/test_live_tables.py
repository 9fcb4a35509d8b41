"""Id memory, live trend, capped source, counts in flight, hot keys of comparisons."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatloom.operators import compare, report
from chatloom.sources import capped
from chatloom.sources import live as sources
from chatloom.streaming import ids, live, measured, trend
from tests.conftest import rows


# --- memory of ids ----------------------------------------------------------------


def test_runs_cover_all_batches_and_grow_with_the_logarithm():
    fan_in = 4
    found = {0: set()}
    for batch in range(1000):
        found[0].add(batch)
        level = 1
        while (batch + 1) % fan_in**level == 0:
            found.setdefault(level, set()).add(batch)
            level += 1
        runs = ids.runs_before(found, batch + 1, fan_in)
        covered = sorted(b for level, last in runs for b in range(last + 1 - fan_in**level, last + 1))
        assert covered == list(range(batch + 1)) and len(runs) <= (fan_in - 1) * len(found)
    # an unfinished merge falls back on its inputs, a batch that let nothing through has no run
    assert ids.runs_before({0: {0, 1, 2, 3, 5}, 1: set()}, 6, 4) == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 5)]
    assert ids.runs_before({0: {0, 1, 2, 3, 4}, 1: {3}}, 3, 4) == [(0, 0), (0, 1), (0, 2)]


def test_reads_do_not_grow_over_two_hundred_batches(spark, tmp_path):
    memory = ids.IdMemory(spark, str(tmp_path / "ids"), "msg_id", buckets=2, fan_in=4)
    seen, most = set(), 0
    rng = random.Random(3)
    for batch in range(200):
        memory.remember(spark.range(batch, batch + 1).select(F.col("id").cast("string").alias("msg_id")).coalesce(1), batch)
        seen.add(str(batch))
        most = max(most, len(memory.runs(batch + 1)))
        if batch % 40 == 39:
            asked = [str(x) for x in rng.sample(range(-50, batch + 50), 60)]
            frame = spark.createDataFrame([(x,) for x in asked], "msg_id string")
            assert {r[0] for r in memory.unseen(frame, batch + 1).collect()} == {x for x in asked if x not in seen}
            # the batch before may run again and must see what it saw
            before = {str(x) for x in range(batch)}
            assert {r[0] for r in memory.unseen(frame, batch).collect()} == {x for x in asked if x not in before}
    assert most <= 3 * 4  # a fan-in of four: three runs a level, four levels
    assert sorted(int(r[0]) for r in memory.known(200).select("_id").collect()) == list(range(200))
    files = memory.known(200).inputFiles()
    assert len(files) <= 2 * 12


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    memory = ids.IdMemory(spark, str(tmp_path / "ids"), "msg_id", buckets=16)
    memory.remember(spark.range(500).select(F.col("id").alias("msg_id")), 0)
    plan = memory.unseen(spark.range(3, 4).select(F.col("id").alias("msg_id")), 1)._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters:") :].split("]")[0]
    assert filters.count("_bucket") >= 1 and "IN (" not in filters.split("PushedFilters")[0].replace("isnotnull", "")
    assert memory.unseen(spark.range(3, 4).select(F.col("id").alias("msg_id")), 1).count() == 0


def test_ids_are_let_through_once_over_restarts_and_merges(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rng, want = random.Random(5), set()
    for lot in range(10):  # more lots than a merge takes
        found = [f"i{rng.randint(0, 60)}" for _ in range(30)]
        want |= set(found)
        spark.createDataFrame([(i, lot) for i in [*found, None, ""]], "msg_id string, ts int").coalesce(1).write.mode("append").parquet(landing)
        live.start_once(sources.landing_stream(spark, landing, "msg_id string, ts int", "parquet"), out, checkpoint).awaitTermination()
    got = Counter(r["msg_id"] for r in live.read_batches(spark, out).collect())
    assert {i for i in got if i} == want and all(n == 1 for i, n in got.items() if i)
    assert got[None] == got[""] == 10
    # a replayed batch gives the same rows
    memory = ids.IdMemory(spark, f"{out}/_ids", "msg_id")
    last = spark.read.parquet(f"{out}/batch=9")
    assert rows(live.unseen(last, memory, 9, ["ts"])) == rows(last)


# --- live trend -------------------------------------------------------------------


def events(n, seed):
    rng = random.Random(seed)
    start = dt.datetime(2025, 1, 1)
    out = []
    for i in range(n):
        late = rng.random() < 0.2
        at = start + dt.timedelta(minutes=i * 2 - (rng.randint(60, 600) if late else rng.randint(0, 20)))
        out.append((at if rng.random() > 0.02 else None, rng.choice(["positive", "negative", None])))
    return out


def test_trend_equals_the_batch_and_closed_periods_leave(spark, tmp_path):
    data = events(400, 1)
    schema = "ts timestamp, sentiment string"
    table = trend.TrendTable(spark, str(tmp_path / "t"), "hour", "30 minutes", fold_every=3)
    size = 40
    for batch in range(len(data) // size):
        lot = spark.createDataFrame(data[batch * size : (batch + 1) * size], schema)
        for _ in range(2 if batch % 4 == 0 else 1):  # some batches run twice
            table.add(lot, batch, "ts", "sentiment")
        upto = spark.createDataFrame(data[: (batch + 1) * size], schema)
        want = upto.groupBy(F.date_trunc("hour", "ts").alias("period"), F.col("sentiment").alias("label")).agg(F.count("*").alias("n"))
        assert rows(table.counts()) == rows(want)
        assert table.open_periods().select("period").distinct().count() <= 4
    assert table.corrections().count() > 0
    assert sum(r["n"] for r in table.counts().collect()) == 400
    with pytest.raises(ValueError, match="period"):
        trend.TrendTable(spark, str(tmp_path / "x"), "week")


def test_trend_of_a_stream(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    data, schema = events(90, 2), "ts timestamp, sentiment string"
    for lot in range(3):
        spark.createDataFrame(data[lot::3], schema).write.mode("append").parquet(landing)
        stream = sources.landing_stream(spark, landing, schema, "parquet")
        trend.start_trend(stream, out, checkpoint, period="hour", delay="1 hour").awaitTermination()
    got = trend.TrendTable(spark, out, "hour").counts().where("period is not null and label is not null")
    table = got.groupBy("period").pivot("label", ["positive", "negative"]).agg(F.sum("n")).na.fill(0)
    want = report.trend(spark.createDataFrame(data, schema).where("ts is not null"), labels=("positive", "negative"), period="hour")
    assert rows(table) == rows(want)


# --- cap of rows ------------------------------------------------------------------


def test_no_batch_is_above_the_cap_and_a_restart_goes_on(spark, tmp_path):
    landing, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    (landing / "sub").mkdir(parents=True)
    (landing / "_hidden").write_text('{"id": 99}\n')
    (landing / "1.json").write_text("".join(json.dumps({"id": i, "text": f"é{i}"}) + "\n" for i in range(25)))
    (landing / "sub" / "2.json").write_text("\n".join(["", *(json.dumps({"id": i}) for i in range(25, 38)), "{broken"]))  # no end of line

    def run():
        query = live.start_append_batches(capped.capped_stream(spark, str(landing), "id int, text string", cap=7), out, checkpoint)
        query.processAllAvailable()
        query.stop()

    run()
    (landing / "3.json").write_text("".join(json.dumps({"id": i}) + "\n" for i in range(38, 50)))
    run()
    got = live.read_batches(spark, out)
    assert sorted(r["id"] for r in got.where("id is not null").collect()) == list(range(50))
    sizes = [r["count"] for r in got.groupBy("batch").count().collect()]
    assert max(sizes) == 7 and sum(sizes) == 51  # the broken line is a row of nulls
    assert got.where("text = 'é3'").count() == 1


def test_a_batch_that_runs_again_has_the_same_lines(tmp_path):
    (tmp_path / "a.json").write_text("\n".join(f"line {i} " + "x" * i for i in range(300)) + "\n")
    (tmp_path / "b.json").write_text("last")
    reader, at, seen = capped.LineReader(str(tmp_path), 13), None, []
    at = reader.initialOffset()
    while True:
        lines, end = reader.read(at)
        lines = list(lines)
        if not lines:
            assert end == at
            break
        assert list(reader.readBetweenOffsets(at, end)) == lines and len(lines) <= 13
        seen += [x for (x,) in lines]
        at = json.loads(json.dumps(end))
    assert seen == [f"line {i} " + "x" * i for i in range(300)] + ["last"]
    assert capped.LineReader(str(tmp_path / "none"), 5).read(reader.initialOffset())[1] == reader.initialOffset()


def test_shares_have_every_line_once_in_runs_of_the_cap(tmp_path):
    (tmp_path / "a.json").write_text("\n".join(f"line {i}" for i in range(95)) + "\n")
    (tmp_path / "b.json").write_text("\n\n".join(f"line {i}" for i in range(95, 133)))
    seen = []
    for share in range(3):
        reader = capped.LineReader(str(tmp_path), 10, share, 3)
        at = reader.initialOffset()
        while True:
            lines, end = reader.read(at)
            lines = [x for (x,) in lines]
            if not lines:
                assert end == at
                break
            assert [x for (x,) in reader.readBetweenOffsets(at, end)] == lines
            seen.append(lines)
            at = json.loads(json.dumps(end))
    assert sorted(map(len, seen)) == [3] + [10] * 13
    assert sorted(x for lines in seen for x in lines) == sorted(f"line {i}" for i in range(133))
    for lines in seen:
        first = int(lines[0].split()[1])
        assert first % 10 == 0 and lines == [f"line {first + i}" for i in range(len(lines))]
    with pytest.raises(ValueError, match="share"):
        capped.LineReader(str(tmp_path), 10, 3, 3)


def test_shares_go_on_with_lines_that_land_later(spark, tmp_path):
    landing, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    landing.mkdir()
    for name, first, last in (("1", 0, 25), ("2", 25, 61)):
        (landing / f"{name}.json").write_text("".join(json.dumps({"id": i}) + "\n" for i in range(first, last)))
        live.drain_shares([capped.capped_stream(spark, str(landing), "id int", cap=7, share=i, shares=3) for i in range(3)], out, checkpoint)
    got = live.read_shares(spark, out, 3)
    assert sorted(r["id"] for r in got.collect()) == list(range(61))
    assert max(r["count"] for r in got.groupBy("share", "batch").count().collect()) == 7
    assert got.select("share").distinct().count() == 3


# --- counts in flight -------------------------------------------------------------


def test_counts_in_flight_equal_the_batch(spark, tmp_path):
    landing, schema = str(tmp_path / "in"), "timestamp string, ts timestamp, reason string"
    data = [("t", None, None), ("t", dt.datetime(2025, 1, 1), "empty"), (None, None, None), ("t", None, "type")]
    watcher = measured.watch(spark, "seen")
    try:
        for _ in range(3):
            spark.createDataFrame(data, schema).write.mode("append").parquet(landing)
            stream = measured.measured(sources.landing_stream(spark, landing, schema, "parquet"), "seen")
            live.start_append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        totals = watcher.settled_totals(3)
    finally:
        spark.streams.removeListener(watcher)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert totals == written.agg(*(c.alias(n) for n, c in measured.event_measures().items())).first().asDict()
    assert totals == {"n_rows": 12, "rejected": 6, "unread_times": 6}


def test_rows_are_stamped_once(spark):
    df = spark.createDataFrame([(1, dt.datetime(2025, 1, 1)), (2, None)], "id int, received_at timestamp")
    got = {r["id"]: r["received_at"] for r in sources.stamped(df).collect()}
    assert got[1] == dt.datetime(2025, 1, 1) and got[2].year >= 2025 and got[2] != got[1]
    assert "received_at" in sources.stamped(df.select("id")).columns


# --- hot keys ---------------------------------------------------------------------


def test_a_hot_key_is_made_in_pieces_of_equal_size(spark):
    p = spark.range(300).select(F.lit("t").alias("timestamp"), F.lit("u").alias("username"), F.lit("m").alias("message_text"), F.lit("a").alias("predicted_label"))
    p = p.unionAll(spark.range(50).select(F.col("id").cast("string"), F.lit("u"), F.lit(None).cast("string"), F.lit("b")))
    a = p.withColumnRenamed("predicted_label", "actual_label").where("actual_label = 'b'").unionAll(
        spark.range(200).select(F.lit(" t"), F.lit("u "), F.lit("m"), F.when(F.col("id") % 2 == 0, "a").otherwise("c")))
    got = compare.matched_pairs(p, a, piece_rows=1000)
    assert rows(got.groupBy("predicted_label", "actual_label").count()) == [("a", "a", 30_000), ("a", "c", 30_000), ("b", "b", 50)]
    assert rows(got) == rows(compare.matched_pairs(p.repartition(5), a.repartition(3)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        sizes = [r["count"] for r in compare.matched_pairs(p, a, piece_rows=1000).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and max(sizes) <= 3 * sorted(sizes)[4]
