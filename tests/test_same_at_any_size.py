"""Results must not depend on the size of a table, the order of arrival or an unfinished write."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chatloom.functions import fixed, lookup
from chatloom.operators import cleaning, compare, dedupe, dictionary, report, topics, webhook
from chatloom.operators.sentiment import with_polarity, with_valence
from chatloom.plans import given
from chatloom.sources import chat_csv, sinks
from chatloom.sources import live as sources
from chatloom.streaming import live, retained
from chatloom.streaming.finished import finished
from tests.conftest import rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(params=["literal", "join"])
def route(request, monkeypatch):
    """Both ways to read a word table."""
    if request.param == "join":
        monkeypatch.setattr(lookup.attach_values, "__defaults__", (lookup.attach_values.__defaults__[0], 0))
        monkeypatch.setattr(lookup.bounded_entries, "__defaults__", (0,))
    return request.param


MESSAGES = [("k", "good bad"), ("k", "bad bad good"), (None, "good unknown good"), ("e", ""), ("n", None), ("x", "nothing known")]


def test_repeated_keys_keep_their_own_words(spark, route):
    df = spark.createDataFrame(MESSAGES, "msg_key string, message string")
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "word string, weight double")
    got = rows(with_polarity(df, lexicon).select("message", F.round("sentiment_score", 3)))
    assert got == sorted([("good bad", 0.0), ("bad bad good", -0.333), ("good unknown good", 1.0), ("", 0.0), (None, 0.0), ("nothing known", 0.0)], key=repr)


def test_a_word_listed_twice_has_its_greatest_weight(spark, route):
    df = spark.createDataFrame([("1", "good bad")], "msg_key string, message string")
    twice = spark.createDataFrame([("good", 1.0), ("good", 3.0), ("bad", -2.0), (None, 9.0)], "word string, weight double")
    once = {"good": 3.0, "bad": -2.0}
    assert rows(with_valence(df, twice)) == rows(with_valence(df, once))


def test_stop_words_and_lemmas_by_both_routes(spark, route):
    df = spark.createDataFrame([("k", "alpha beta alpha"), ("k", "beta gamma")], "msg_key string, message string")
    stops = spark.createDataFrame([("beta",), ("beta",)], "word string")
    lemmas = spark.createDataFrame([("alpha", "omega")], "surface string, lemma string")
    got = rows(cleaning.with_tokens(df, stop_words=stops, lemmas=lemmas).select(F.array_join("tokens", " ")))
    assert got == [("gamma",), ("omega omega",)]


def drop(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records) + "\n")


def test_scored_stream_with_any_size_of_lexicon(spark, tmp_path, route):
    headers = {fixed.H_SIGNATURE: "s", fixed.H_MESSAGE_ID: "m", fixed.H_TIMESTAMP: "2025-01-01T10:00:00", fixed.H_EVENT_TYPE: fixed.CHAT_EVENT}
    for i, text in enumerate(("good", "bad good bad")):
        drop(tmp_path / "in", f"{i}.json", [{"headers": headers, "body": json.dumps({"content": text, "sender": {"username": "u"}})}])
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "word string, weight double")
    out = str(tmp_path / "out")
    live.start_scored(sources.webhook_stream(spark, str(tmp_path / "in"), max_files=1), lambda b: live.score_events(b, lexicon), out, str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(out).select("message", "sentiment")) == [("bad good bad", "negative"), ("good", "positive")]


def test_late_messages_are_kept_once(spark, tmp_path):
    schema = "msg_id string, ts timestamp, n int"
    at = dt.datetime(2025, 1, 1, 12)
    batches = [[("a", at, 1), ("b", at, 1)], [("c", at - dt.timedelta(hours=1), 2), ("a", at + dt.timedelta(hours=9), 2)], [("d", at - dt.timedelta(days=3), 3), ("c", at, 3), ("d", at - dt.timedelta(days=3), 4)]]
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):
        live.start_once(sources.landing_stream(spark, str(tmp_path / "in"), schema, "parquet", max_files=1), out, str(tmp_path / "cp")).awaitTermination()
    got = live.read_batches(spark, out)
    assert sorted(r.msg_id for r in got.collect()) == ["a", "b", "c", "d"]
    assert {r.msg_id: r.n for r in got.collect()}["d"] == 3  # equal times: the least row


def test_a_replayed_batch_gives_the_same_rows(spark, tmp_path):
    out = str(tmp_path / "once")
    at = dt.datetime(2025, 1, 1)
    one = spark.createDataFrame([("a", at), ("b", at)], "msg_id string, ts timestamp")
    two = spark.createDataFrame([("b", at), ("c", at)], "msg_id string, ts timestamp")
    for batch_id, batch in ((0, one), (1, two), (1, two)):
        live.write_once(batch, out, batch_id, "msg_id", ("ts",))
    assert sorted(r.msg_id for r in live.read_batches(spark, out).collect()) == ["a", "b", "c"]


def feed(spark, lo, hi):
    base = dt.datetime(2025, 1, 1)
    data = [(f"c{i % 3}", i, base + dt.timedelta(seconds=i), "u", f"m{i}", "positive", 1.0) for i in range(lo, hi)]
    return spark.createDataFrame(data, "channel string, msg_key int, ts timestamp, username string, message string, sentiment string, sentiment_score double")


def test_an_unfinished_fold_is_not_read_and_old_folders_go(spark, tmp_path):
    base = str(tmp_path / "kept")
    keep = retained.retain_batches(base, "channel", n=4, fold_every=2)
    for batch_id in range(7):
        keep(feed(spark, batch_id * 10, batch_id * 10 + 10), batch_id)
    before = rows(retained.read_retained(spark, base, "channel", 4))
    assert min(finished(spark, f"{base}/kind=piece")) > 2 and len(finished(spark, f"{base}/kind=folded")) == 2
    half = tmp_path / "kept" / "kind=folded" / "batch=9"
    feed(spark, 900, 905).write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    assert rows(retained.read_retained(spark, base, "channel", 4)) == before
    assert all("batch=9" not in f for f in retained.live_folders(spark, base))


def test_monitor_counts_each_check(spark, tmp_path):
    schema = "msg_id string, ts timestamp, is_test boolean"
    at = dt.datetime(2025, 1, 1)
    for part in ([("a", at, False), ("", at, False)], [("a", at, False), ("b", at, True)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = sources.landing_stream(spark, str(tmp_path / "in"), schema, "parquet", max_files=1)
    live.start_monitor(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(tuple(r) for r in live.read_batches(spark, str(tmp_path / "out") + "/checks").collect())
    assert [g[0] for g in got] == [1, 2] and sum(g[1] for g in got) == 2 and sum(g[3] for g in got) == 1


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_do_not_run_the_parse_again(spark):
    envelopes = given.conversation_envelopes(spark, SMALL)
    normal = webhook.normalise_envelopes(envelopes)
    plan = plan_of(webhook.stored_messages(normal))
    assert plan.count("try_parse_json") + plan.count("parseJson") + plan.count("ParseJson") <= 2
    assert len(plan) < 60_000
    strict = plan_of(webhook.accepted(webhook.chat_events(envelopes)))
    assert strict.count("from_json") <= 2


def test_trend_without_labels_and_with_strange_ones(spark):
    at = dt.datetime(2025, 1, 1, 10)
    df = spark.createDataFrame([(at, "positive"), (at, None), (at + dt.timedelta(minutes=1), None)], "ts timestamp, sentiment string")
    got = report.trend(df)
    assert rows(got.select("positive", "negative")) == [(1, 0)]
    assert plan_of(got).count("Aggregate") == 1
    with pytest.raises(Exception, match="outside the list"):
        report.trend(df.unionByName(spark.createDataFrame([(at, "odd")], "ts timestamp, sentiment string"))).collect()


def test_a_dictionary_is_whole_or_an_error(spark):
    df = spark.createDataFrame([(["a", "b"],), (["b", "c"],)], "tokens array<string>")
    assert rows(dictionary.indexed_vocabulary(df)) == [("a", 1, 1, 0), ("b", 2, 2, 1), ("c", 1, 1, 2)]
    with pytest.raises(ValueError, match="3 words"):
        dictionary.indexed_vocabulary(df, limit=2)
    assert topics.update_plan(10_000, 10, 100) == (0.01, 1000)


def test_ties_of_an_id_are_settled_by_the_row(spark):
    at = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([("a", at, "z"), ("a", at, "b"), ("a", at, "m")], "msg_id string, ts timestamp, text string")
    for parts in (1, 3):
        assert dedupe.first_per_id(df.repartition(parts)).first()["text"] == "b"


def test_hot_pair_keys_multiply(spark):
    key = ("t", "u", "m")
    predicted = spark.createDataFrame([(*key, "positive")] * 30 + [(*key, None)], "timestamp string, username string, message_text string, predicted_label string")
    actual = spark.createDataFrame([(*key, "positive")] * 20 + [(*key, "negative")] * 5, "timestamp string, username string, message_text string, actual_label string")
    got = compare.matched_pairs(predicted, actual).groupBy("predicted_label", "actual_label").count()
    assert rows(got) == sorted([("positive", "positive", 600), ("positive", "negative", 150), (None, "positive", 20), (None, "negative", 5)], key=repr)


def test_cleared_table_keeps_its_layout(spark, tmp_path):
    out = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, day string")
    df.write.partitionBy("day").parquet(out)
    sinks.clear_stored(spark, out)
    df.write.mode("append").partitionBy("day").parquet(out)
    assert rows(spark.read.schema("id int, day string").parquet(out)) == [(1, "a"), (2, "b")]


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i}.csv").write_text(("﻿" if i == 3 else "") + ("message,label\n" if i % 2 else "user,content,label\n") + ("hi,positive\n" if i % 2 else "u,yo,negative\n"))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    tracker, group = spark.sparkContext.statusTracker(), "headers"
    spark.sparkContext.setJobGroup(group, "headers")
    frame = chat_csv.read_labelled(spark, str(tmp_path))
    assert len(tracker.getJobIdsForGroup(group)) <= 4  # stages of one adaptive query, not one job per file
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows(frame.groupBy("text", "label").count()) == [("hi", "positive", 6), ("yo", "negative", 6)]
