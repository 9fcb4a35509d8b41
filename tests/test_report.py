import datetime as dt

from pyspark.sql import functions as F

from chatloom.functions import fixed
from chatloom.operators import cleaning, compare, dedupe, report, retain
from chatloom.plans.analysis import compare_labels
from tests.conftest import rows


def labelled(spark, pairs):
    return spark.createDataFrame(pairs, "sentiment string, message string")


def test_distribution_drops_null_and_breaks_ties_by_name(spark):
    df = labelled(spark, [("b", ""), ("a", ""), ("b", ""), ("a", ""), (None, ""), ("c", "")])
    assert [tuple(r) for r in report.distribution(df).collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert report.overall_label(df).first()[0] == "a"
    assert report.overall_label(df.filter("sentiment IS NULL")).first()[0] is None


def test_trend_has_no_empty_minutes_and_sums_to_all_rows(spark):
    times = ["2025-01-01 10:00:05", "2025-01-01 10:00:59", "2025-01-01 10:03:00", "bad time"]
    df = spark.createDataFrame([(t, s) for t, s in zip(times, ["positive", "negative", "unknown", "neutral"])], "t string, sentiment string")
    table = report.trend(df.withColumn("ts", F.try_to_timestamp("t")))
    got = table.orderBy("period").collect()
    assert len(got) == 3 and got[0].period is None and got[0].neutral == 1
    assert sum(r[x] for r in got for x in fixed.LABELS) == 4
    assert set(table.columns) == {"period", *fixed.LABELS}


def test_suggestions(spark):
    df = labelled(spark, [("negative", "lag lag boring stream"), ("negative", "lag boring"), ("positive", "nice")])
    topics = spark.createDataFrame([(0, 0, "zero", 0.5, 1.0), (1, 1, "b", 0.1, 9.0), (1, 0, "a", 0.2, 9.0)], "topic int, rank int, word string, weight double, mass double")
    scored = cleaning.with_tokens(df)
    got = [tuple(r) for r in report.suggestions(scored, topics).collect()]
    assert [g[0] for g in got] == [1, 2, 3]
    assert got[0][2] == fixed.MOOD_TEXT["negative"]
    assert "a, b" in got[1][2]
    assert "lag, boring, stream" in got[2][2]
    quiet = [tuple(r)[2] for r in report.suggestions(scored.filter("sentiment = 'positive'")).collect()]
    assert quiet == [fixed.MOOD_TEXT["positive"], fixed.NO_TOPIC_TEXT]
    empty = [tuple(r)[2] for r in report.suggestions(scored.filter("sentiment = 'x'"), topics).collect()]
    assert empty == [fixed.NO_DATA_TEXT]


def test_preview_and_result_columns(spark):
    df = spark.createDataFrame([(str(i), f"m{i}", "positive") for i in range(9)], "timestamp string, message string, sentiment string")
    assert report.preview(df).columns == ["timestamp", "message"]
    assert report.preview(df).count() == 5
    assert report.result_rows(df).columns == ["timestamp", "message", "sentiment"]


def test_vocabulary_counts(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, [])], "msg_key int, tokens array<string>")
    assert rows(cleaning.vocabulary(df)) == [("a", 2, 3), ("b", 1, 1)]
    assert rows(cleaning.bag_of_words(df)) == [(1, "a", 2), (1, "b", 1), (2, "a", 1)]


# --- comparison -------------------------------------------------------------------


def pair_tables(spark):
    p = [("t1", "u", " hi ", "positive"), ("t1", "u", "hi", "NEGATIVE"), (None, "u", "x", "neutral"), ("t2", "u", "y", None), ("t3", "v", "z", "neutral"), ("t4", "v", "q", "negative")]
    a = [("t1", "u\t", "hi\n", "positive"), ("t1", "u", "hi", "negative"), (None, "u", "x", "neutral"), ("t2", "u", "y", None), ("t3", "v", "z", None), ("", "u", "x", "positive")]
    return (
        spark.createDataFrame(p, "timestamp string, username string, message_text string, predicted_label string"),
        spark.createDataFrame(a, "timestamp string, username string, message_text string, actual_label string"),
    )


def test_join_multiplies_duplicates_and_matches_null_keys(spark):
    predicted, actual = pair_tables(spark)
    pairs = compare.matched_pairs(predicted, actual)
    assert pairs.count() == 7
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    different = rows(compare.differences(pairs).select("predicted_label", "actual_label"))
    assert different == [("NEGATIVE", "positive"), ("neutral", None), ("positive", "negative")]


def test_folded_counts_equal_the_join(spark):
    predicted, actual = pair_tables(spark)
    pairs = compare.matched_pairs(predicted, actual)
    direct = rows(pairs.groupBy("predicted_label", "actual_label").count())
    for layout in (1, 7):
        assert rows(compare.pair_counts(predicted.repartition(layout), actual)) == direct


def test_comparison_reports(spark):
    predicted, actual = pair_tables(spark)
    result = compare_labels(predicted, actual)
    assert rows(result.overlap) == [("actual_rows", 6), ("differing_rows", 3), ("matched_rows", 7), ("predicted_rows", 6)]
    assert rows(result.confusion) == [("negative", "positive", 1), ("positive", "NEGATIVE", 1)]
    assert (("predicted", None, 1) in rows(result.label_counts)) and (("matched_actual", None, 2) in rows(result.label_counts))
    assert result.accuracy.first().n == 5
    assert tuple(result.repeated_keys.first()) == (1, 2)


def test_hot_key_stays_small_in_counts(spark):
    n = 3000
    hot = spark.range(n).select(F.lit("t").alias("timestamp"), F.lit("u").alias("username"), F.lit("merhaba").alias("message_text"))
    counts = compare.pair_counts(hot.withColumn("predicted_label", F.lit("positive")), hot.withColumn("actual_label", F.lit("negative")))
    assert rows(counts) == [("positive", "negative", n * n)]


# --- retention, dedupe ------------------------------------------------------------


def test_last_n_with_ties_and_a_hot_group(spark):
    base = dt.datetime(2025, 1, 1)
    data = [("hot", i, base + dt.timedelta(seconds=i // 3)) for i in range(500)] + [("cold", 1000 + i, base) for i in range(3)]
    df = spark.createDataFrame(data, "channel string, msg_key int, ts timestamp")
    for layout in (1, 7):
        kept = retain.last_n_per(df.repartition(layout), "channel", 10)
        assert sorted(r.msg_key for r in kept.filter("channel = 'hot'").collect()) == list(range(490, 500))
        assert kept.filter("channel = 'cold'").count() == 3
    assert [r.msg_key for r in retain.last_n(df, 2).collect()] == [499, 498]
    plan = retain.last_n_per(df, "channel", 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_summary(spark):
    base = dt.datetime(2025, 1, 1)
    data = [("c", i, base + dt.timedelta(seconds=i), "u", f"m{i}", "positive" if i % 2 else "negative", float(i)) for i in range(7)]
    df = spark.createDataFrame(data, "channel string, msg_key int, ts timestamp, username string, message string, sentiment string, sentiment_score double")
    row = retain.retained_summary(retain.last_n_per(df, "channel", 6), "channel").first()
    assert (row.total_messages_stored, row.average_sentiment_score, row.positive_messages, row.negative_messages, row.neutral_messages) == (6, 3.5, 3, 3, 0)
    assert [m.message for m in row.last_messages] == ["m2", "m3", "m4", "m5", "m6"]


def test_dedupe_is_idempotent_and_new_ids_only(spark):
    data = [("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("", 1, "e"), (None, 1, "n")]
    df = spark.createDataFrame(data, "msg_id string, ts int, body string")
    once = dedupe.first_per_id(df.filter("msg_id IN ('a', 'b')"))
    assert rows(once) == [("a", 1, "y"), ("b", 2, "z")]
    assert rows(dedupe.first_per_id(once)) == rows(once)
    seen = spark.createDataFrame([("b",), ("b",)], "msg_id string")
    fresh = dedupe.new_messages(df, seen)
    assert rows(fresh.select("msg_id", "ts")) == [("a", 1)]
    counters = dedupe.monitor_counters(fresh.withColumn("is_test", F.lit(True)), 3).first()
    assert tuple(counters) == (3, 1, 0, 1)


def test_exact_lookup(spark):
    messages = spark.createDataFrame([("hello",), ("hello",), ("bye",)], "message string")
    wanted = spark.createDataFrame([("hello",), ("Hello",)], "message string")
    assert rows(dedupe.exact_lookup(messages, wanted)) == [("Hello", False), ("hello", True)]
    assert dedupe.received_messages(messages, wanted).count() == 2
