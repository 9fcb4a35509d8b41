import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from chatloom.operators import coherence, sentiment, topics, training
from chatloom.plans.analysis import analyse_chat
from tests.conftest import rows


def small_docs(seed=3, n=20, longest=40):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "e", "f", "g"]
    return [[rng.choice(words) for _ in range(rng.randint(0, longest))] for _ in range(n)]


def brute_windows(docs, size):
    for doc in docs:
        if not doc:
            continue
        for s in range(max(len(doc) - size + 1, 1)):
            yield set(doc[s : s + size])


@pytest.mark.parametrize("size", [1, 5, 110])
def test_window_counts_equal_brute_force(spark, size):
    docs = small_docs()
    wanted = [(0, "a"), (0, "b"), (0, "c"), (1, "c"), (1, "d"), (1, "zzz")]
    pairs = {("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")}
    expect = {("", ""): 0}
    for seen in brute_windows(docs, size):
        expect[("", "")] += 1
        for w in "abcd":
            if w in seen:
                expect[(w, w)] = expect.get((w, w), 0) + 1
        for a, b in pairs:
            if a in seen and b in seen:
                expect[(a, b)] = expect.get((a, b), 0) + 1
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "msg_key int, tokens array<string>")
    for layout in (1, 7):
        got = {(r.word_a, r.word_b): r.n for r in coherence.window_counts(df.repartition(layout), wanted, window=size).collect()}
        assert got == expect


def test_window_counts_of_odd_messages_in_blocks(spark, monkeypatch):
    """Null and empty lists have no window, null tokens a place; the counts are made outside of the rows' expressions."""
    monkeypatch.setattr(coherence, "BLOCK_TOKENS", 3)
    df = spark.createDataFrame([(None,), ([],), ([None, "a"],), (["b", None, "a", "a", "x"],), (["b"],)], "tokens array<string>").coalesce(1)
    counted = coherence.window_counts(df, [(0, "a"), (0, "b"), (1, "x"), (1, "never")], window=2)
    assert rows(counted) == [("", "", 6), ("a", "a", 4), ("b", "b", 2), ("x", "x", 1)]
    wide = coherence.window_counts(df, [(0, "a"), (0, "b")], window=3)
    assert rows(wide) == [("", "", 5), ("a", "a", 4), ("a", "b", 1), ("b", "b", 2)]
    assert rows(coherence.window_counts(df, [], window=2)) == [("", "", 6)]
    assert rows(coherence.window_counts(df.limit(0), [(0, "a")])) == []
    assert "MapInArrow" in counted._jdf.queryExecution().executedPlan().toString()


def brute_coherence(docs, words, size, eps=1e-12):
    windows = list(brute_windows(docs, size))
    p = lambda *ws: sum(all(w in s for w in ws) for s in windows) / len(windows)
    npmi = {}
    for a, b in itertools.product(words, words):
        both = p(a, b) + eps
        npmi[a, b] = math.log(both / (p(a) * p(b))) / -math.log(both)
    total = [sum(npmi[a, b] for a in words) for b in words]
    cosines = []
    for a in words:
        v = [npmi[a, b] for b in words]
        dot = sum(x * y for x, y in zip(v, total))
        cosines.append(dot / math.sqrt(sum(x * x for x in v)) / math.sqrt(sum(x * x for x in total)))
    return sum(cosines) / len(cosines)


def test_coherence_equals_brute_force(spark):
    docs = small_docs(5)
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "msg_key int, tokens array<string>")
    lists = {0: ["a", "b", "c"], 1: ["c", "d", "e", "f"]}
    got = {r.topic: r.coherence for r in coherence.topic_coherence(df, [(t, w) for t, ws in lists.items() for w in ws], window=4).collect()}
    for topic, words in lists.items():
        assert got[topic] == pytest.approx(brute_coherence(docs, words, 4), abs=1e-9)


def test_topic_model_repeats_and_survives_empty_input(spark):
    docs = [(i, ["game", "play", "win"] * 3 if i % 2 else ["song", "music", "sing"] * 3) for i in range(30)] + [(99, [])]
    df = spark.createDataFrame(docs, "msg_key int, tokens array<string>")
    first = topics.model_topics(df, num_topics=2, num_words=3, passes=5)
    again = topics.model_topics(df.repartition(3), num_topics=2, num_words=3, passes=5, with_coherence=False)
    assert rows(topics.topic_table(first.topics)) == rows(topics.topic_table(again.topics))
    assert first.topics.count() == 6 and first.coherence.count() == 2 and first.seconds > 0
    assert sum({r.topic: r.mass for r in first.topics.collect()}.values()) == pytest.approx(30, abs=1e-3)
    none = topics.model_topics(df.filter("msg_key = 99"))
    assert none.model is None and none.topics.count() == 0
    assert topics.update_plan(10**9, 10, None) == (1.0, 10)
    assert topics.update_plan(50, 10, 100) == (1.0, 10)
    assert topics.update_plan(1000, 10, 100) == (0.1, 100)
    assert topics.update_plan(100_000, 10, 100) == (0.001, 10_000)  # as many updates as ten passes need


def test_cloud_sums_rounded_weights(spark):
    df = spark.createDataFrame([(0, 0, "a", 0.1234), (1, 0, "a", 0.2), (1, 1, "b", 0.0004)], "topic int, rank int, word string, weight double")
    assert [tuple(r) for r in topics.cloud_weights(df).collect()] == [("a", 0.323), ("b", 0.0)]
    assert topics.topic_table(df).first().weight == "0.123"


def examples(spark):
    words = {"positive": "great lovely stream", "negative": "awful boring stream", "neutral": "stream starts now"}
    data = [(f"{words[label]} number {i}", label) for i in range(60) for label in words]
    return spark.createDataFrame(data, "text string, label string")


def test_classifier_round_trip(spark, tmp_path):
    df = examples(spark)
    train, test = training.split_examples(df)
    sizes = training.split_sizes(df).first()
    assert (sizes.train, sizes.test) == (train.count(), test.count()) and sizes.total == 180
    assert rows(training.split_examples(df.repartition(7))[1]) == rows(test)
    trained = training.fit_classifier(df, penalties=(0.01, 0.1), max_iter=10, features=1 << 10)
    assert max(a for _, a in trained.accuracies) == training.evaluate_predictions(trained.test_predictions).first().accuracy > 0.9
    training.save_model(trained.model, str(tmp_path / "m"))
    model = training.load_model(str(tmp_path / "m"))
    chat = spark.createDataFrame([(1, "great lovely stream"), (2, " "), (3, None), (4, "awful boring stream")], "msg_key int, message string")
    got = {r.msg_key: r.sentiment for r in sentiment.run_sentiment(chat, "custom_kick_bert", model=model).collect()}
    assert got == {1: "positive", 2: "unknown", 3: "unknown", 4: "negative"}
    two = sentiment.run_sentiment(spark.createDataFrame([(1, "stream starts now")], "msg_key int, message string"), "bert", model=model)
    assert two.first().sentiment == "unknown" and two.columns == ["msg_key", "message", "sentiment"]


def test_label_ids_are_alphabetical(spark):
    encoded, model = training.encode_labels(examples(spark))
    assert list(model.labels) == ["negative", "neutral", "positive"]
    assert rows(training.class_counts(encoded)) == [("negative", 0.0, 60), ("neutral", 1.0, 60), ("positive", 2.0, 60)]


def test_whole_analysis(spark):
    texts = ["great game", "awful lag again", "great music today", None, "!command", "awful awful lag"]
    chat = spark.createDataFrame([(i, f"2025-01-01 10:0{i}:00", "u", t) for i, t in enumerate(texts)], "msg_key int, timestamp string, username string, message string")
    chat = chat.withColumn("ts", F.try_to_timestamp("timestamp"))
    result = analyse_chat(chat, "textblob", lexicon={"great": 0.8, "awful": -0.9}, num_topics=2, num_words=2)
    assert rows(result.distribution) == [("negative", 2), ("neutral", 2), ("positive", 2)]
    assert result.trend.count() == 6 and result.scored.count() == 6
    assert result.topics.topics.count() == 4 and result.suggestions.count() == 3
