import datetime as dt
import json

from pyspark.sql import functions as F

from chatloom.functions import fixed
from chatloom.operators import retain, webhook
from chatloom.operators.sentiment import with_valence
from chatloom.sources import live as sources
from chatloom.streaming import live, retained
from tests.conftest import rows

LEXICON = {"good": 2.0, "bad": -2.0}


def drop_json(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records) + "\n")


def envelope(i, content="good", event_type=fixed.CHAT_EVENT, at="2025-01-01T10:00:00"):
    body = content if content.startswith("{") else json.dumps({"content": content, "sender": {"username": f"u{i}"}})
    headers = {fixed.H_SIGNATURE: "s", fixed.H_MESSAGE_ID: f"m{i}", fixed.H_TIMESTAMP: at, fixed.H_EVENT_TYPE: event_type}
    return {"headers": headers, "body": body, "received_at": f"2025-01-01T10:00:{i % 60:02d}"}


def test_scored_stream_equals_batch_and_never_stops_on_bad_events(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    drop_json(landing, "1.json", [envelope(1), envelope(2, "bad"), envelope(3, "{broken")])
    drop_json(landing, "2.json", [envelope(4, "so so"), envelope(5, event_type="other")])
    for _ in range(2):  # the second run finds nothing new
        stream = sources.webhook_stream(spark, str(landing), max_files=1)
        live.start_scored(stream, lambda df: live.score_events(df, LEXICON), out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 2
    assert rows(got.groupBy("outcome").count()) == [("rejected", 2), ("scored", 3)]
    batch = live.score_events(spark.read.schema(sources.ENVELOPE_SCHEMA).json(str(landing)), LEXICON).filter("reason IS NULL")
    columns = ["msg_key", "sentiment", "sentiment_score"]
    assert rows(got.filter("outcome = 'scored'").select(columns)) == rows(batch.select(columns))


def test_bot_stream(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    drop_json(landing, "1.json", [{"timestamp": "2025-01-01T10:00:00", "username": "u", "message": "good", "channel": "c"}, {"timestamp": "t", "message": "x", "channel": "c", "echo": True}, {"message": "x", "channel": "c"}])
    live.start_scored(sources.bot_stream(spark, str(landing)), lambda df: live.score_bot_messages(df, LEXICON), out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out)
    assert rows(got.select("channel", "sentiment", "outcome")) == [("c", "neutral", "rejected"), ("c", "positive", "scored")]


def feed(spark, lo, hi):
    base = dt.datetime(2025, 1, 1)
    data = [(f"c{i % 3}", i, base + dt.timedelta(seconds=i), "u", f"m{i}", "positive", 1.0) for i in range(lo, hi)]
    return spark.createDataFrame(data, "channel string, msg_key int, ts timestamp, username string, message string, sentiment string, sentiment_score double")


def test_retained_table_folds_and_ignores_replays(spark, tmp_path):
    base = str(tmp_path / "kept")
    keep = retained.retain_batches(base, "channel", n=4, fold_every=2)
    for batch_id in range(5):
        keep(feed(spark, batch_id * 10, batch_id * 10 + 10), batch_id)
        expect = rows(retain.last_n_per(feed(spark, 0, batch_id * 10 + 10), "channel", 4))
        assert rows(retained.read_retained(spark, base, "channel", 4)) == expect
    keep(feed(spark, 40, 50), 4)
    assert rows(retained.read_retained(spark, base, "channel", 4)) == expect
    assert live.rolling_summary(spark, base, n=4).count() == 3


def test_retained_stream(spark, tmp_path):
    landing = str(tmp_path / "in")
    for lo in (0, 20):
        feed(spark, lo, lo + 20).coalesce(1).write.mode("append").parquet(landing)
    stream = sources.landing_stream(spark, landing, feed(spark, 0, 1).schema, "parquet", max_files=1)
    live.start_retained(stream, str(tmp_path / "out"), str(tmp_path / "cp"), n=5).awaitTermination()
    got = retained.read_retained(spark, str(tmp_path / "out"), "channel", 5)
    assert rows(got) == rows(retain.last_n_per(feed(spark, 0, 40), "channel", 5))


def test_counters_over_batches(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    for name, records in (("1.json", [envelope(1), envelope(2, "a test")]), ("2.json", [envelope(3), envelope(4, "{x", "")])):
        drop_json(landing, name, records)
        live.start_counters(sources.webhook_stream(spark, str(landing), max_files=1), out, str(tmp_path / "cp")).awaitTermination()
    frame = spark.read.schema(sources.ENVELOPE_SCHEMA).json(str(landing))
    assert rows(live.latest_counters(spark, out)) == rows(webhook.webhook_counters(webhook.normalise_envelopes(frame)))
    increases = [r.increase for r in live.counters_increase(spark, out).orderBy("batch").collect()]
    assert sum(increases) == 2


def test_ids_once_and_drain_to_log(spark, tmp_path):
    landing = tmp_path / "in"
    record = lambda i: {"msg_id": f"i{i}", "ts": f"2025-01-01T10:00:{i:02d}", "timestamp": f"t{i}", "username": "u", "content": "x", "channel": "room 1"}
    drop_json(landing, "1.json", [record(1), record(2), record(1)])
    drop_json(landing, "2.json", [record(2), record(3)])
    schema = "msg_id string, ts timestamp, timestamp string, username string, content string, channel string"
    stream = sources.landing_stream(spark, str(landing), schema, max_files=1)
    assert live.drain_to_log(stream, str(tmp_path / "stage"), str(tmp_path / "log"), str(tmp_path / "cp")) == []
    log = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert sorted(r.timestamp for r in log.collect()) == ["t1", "t2", "t3"]


def test_messages_without_an_id_are_all_drained(spark, tmp_path):
    landing = tmp_path / "in"
    record = lambda i, msg_id: {"msg_id": msg_id, "ts": f"2025-01-01T10:00:{i:02d}", "timestamp": f"t{i}", "username": "u", "content": "x", "channel": "c"}
    drop_json(landing, "1.json", [record(1, None), record(2, None), record(3, ""), record(4, ""), record(5, "a"), record(6, "a")])
    drop_json(landing, "2.json", [record(7, None), record(8, ""), record(9, ""), record(10, "a"), record(11, "b")])
    schema = "msg_id string, ts timestamp, timestamp string, username string, content string, channel string"
    stream = sources.landing_stream(spark, str(landing), schema, max_files=1)
    assert live.drain_to_log(stream, str(tmp_path / "stage"), str(tmp_path / "log"), str(tmp_path / "cp")) == []
    log = spark.read.option("header", True).csv(str(tmp_path / "log"))
    times = sorted(int(r.timestamp[1:]) for r in log.collect())
    # Files may come in either order, and the batch that comes first has the id "a".
    assert [t for t in times if t not in (5, 10)] == [1, 2, 3, 4, 7, 8, 9, 11] and len(times) == 9


def test_routed_events_audit_and_bounded_run(spark, tmp_path):
    landing = tmp_path / "in"
    drop_json(landing, "1.json", [{"type": "message", "message": {"username": "u", "content": "c"}}, {"type": "error", "data": "404"}, {"type": "status", "data": "ok"}])
    events = sources.landing_stream(spark, str(landing), sources.TYPED_EVENT_SCHEMA)
    query = live.start_routed(events, str(tmp_path / "routes"), str(tmp_path / "cp1"))
    assert live.run_for(query, 120)
    got = spark.read.parquet(str(tmp_path / "routes"))
    assert rows(got.select("route", "is_critical")) == [("error", True), ("message", False), ("status", False)]
    drop_json(tmp_path / "web", "1.json", [envelope(1), envelope(2, "{broken")])
    query = live.start_audit(sources.webhook_stream(spark, str(tmp_path / "web")), str(tmp_path / "audit"), str(tmp_path / "cp2"), every="1 second")
    query.processAllAvailable()
    assert not live.run_for(query, 1)
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


def test_monitor(spark):
    old = spark.createDataFrame([("a", "t0", False)], "id string, timestamp string, is_test boolean")
    now = spark.createDataFrame([("a", "t0", False), ("b", "t1", True), ("c", "t2", False), ("c", "t2", False)], "id string, timestamp string, is_test boolean")
    assert tuple(live.monitor(now, old).first()) == (1, 2, 1, 1)


def test_scoring_inside_a_stream_is_the_batch_function(spark, tmp_path):
    drop_json(tmp_path / "in", "1.json", [{"msg_key": "1", "message": "good"}])
    stream = with_valence(sources.landing_stream(spark, str(tmp_path / "in"), "msg_key string, message string"), LEXICON)
    assert stream.isStreaming
    live.start_append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select(F.col("sentiment")).first()[0] == "positive"
