"""The topic model and its dictionary against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.operators import dictionary, lda, topics
from tests.conftest import rows


def corpus_rows(n=60, seed=1):
    rng = random.Random(seed)
    themes = [["game", "play", "win", "team"], ["song", "music", "sing"], ["food", "cook", "eat", "çay"]]
    return [(i, [rng.choice(themes[i % 3] + ["the"]) for _ in range(rng.randint(0, 25))]) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "msg_key int, tokens array<string>")


def plain_digamma(x):
    out = 0.0
    while x < 20:
        out, x = out - 1 / x, x + 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def plain_lda(docs, k, passes, seed):
    """The same updates, a document and a word at a time."""
    words = sorted({w for d in docs for w in d})
    first = lda.drawn(0, k, seed)
    weights = {w: list(first[i]) for i, w in enumerate(words)}
    docs = [d for d in docs if d]
    for t in range(1, passes + 2):
        totals = [sum(weights[w][j] for w in words) for j in range(k)]
        beta = {w: [math.exp(plain_digamma(weights[w][j]) - plain_digamma(totals[j])) for j in range(k)] for w in words}
        seen, mass = {w: [0.0] * k for w in words}, [0.0] * k
        for doc in docs:
            counts = {w: doc.count(w) for w in sorted(set(doc))}
            gamma = [1 / k + len(doc) / k] * k
            for _ in range(lda.ROUNDS):
                theta = [math.exp(plain_digamma(g) - plain_digamma(sum(gamma))) for g in gamma]
                new = [1 / k] * k
                for w, n in counts.items():
                    mixed = [theta[j] * beta[w][j] for j in range(k)]
                    new = [new[j] + n * mixed[j] / sum(mixed) for j in range(k)]
                change = sum(abs(a - b) for a, b in zip(new, gamma)) / k
                gamma = new
                if change < lda.TOLERANCE:
                    break
            theta = [math.exp(plain_digamma(g) - plain_digamma(sum(gamma))) for g in gamma]
            for w, n in counts.items():
                mixed = [theta[j] * beta[w][j] for j in range(k)]
                seen[w] = [seen[w][j] + n * mixed[j] / sum(mixed) for j in range(k)]
            mass = [m + g / sum(gamma) for m, g in zip(mass, gamma)]
        if t == passes + 1:
            return weights, mass
        rate = (1 + t) ** -lda.DECAY
        weights = {w: [(1 - rate) * weights[w][j] + rate * (1 / k + seen[w][j]) for j in range(k)] for w in words}


def test_model_equals_a_plain_one_for_any_layout(spark, monkeypatch):
    data = corpus_rows()
    want, want_mass = plain_lda([d for _, d in data], 3, 4, 7)
    monkeypatch.setattr(lda, "CHUNK_CELLS", 40)
    for parts in (1, 6):
        corpus = lda.chunked_corpus(frame(spark, data).repartition(parts), "tokens", "msg_key")
        model, mass = lda.fit(corpus, 3, 4, 7)
        named = model.weights.join(model.dictionary, "word_id").collect()
        assert len(named) == len(want)
        for r in named:
            assert [r["w0"], r["w1"], r["w2"]] == pytest.approx(want[r["token"]], rel=2e-4)
        assert mass == pytest.approx(want_mass, rel=2e-3)
        top = {(r["topic"], r["rank"]): r["word"] for r in model.top_words(2).collect()}
        for k in range(3):
            total = sorted(want, key=lambda w: (-want[w][k], w))
            assert [top[k, 0], top[k, 1]] == total[:2]
        shares = {r["key"]: r["shares"] for r in lda.topic_shares(corpus, model).collect()}
        assert set(shares) == {i for i, d in data if d} and all(sum(s) == pytest.approx(1) for s in shares.values())
        assert np.sum(list(shares.values()), axis=0) == pytest.approx(mass, rel=1e-4)
        corpus.drop()


def test_documents_of_a_bucket_do_not_move_in_an_update(spark):
    corpus = lda.chunked_corpus(frame(spark, corpus_rows()).repartition(4), "tokens", "msg_key")
    weights = lda.first_weights(corpus.dictionary, 2, 1)
    seen = lda._seen(corpus, weights, ["w0", "w1"], np.array([9.0, 9.0]), 0.5, 1.0, 0)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("FlatMapCoGroupsInArrow"):]
    scan = side[: side.index("FileScan")]
    assert "Exchange" not in scan and "Bucketed: true" in plan
    corpus.drop()


def test_word_lists_and_weights_do_not_move_in_an_update(spark):
    """Only the weights on their way to the chunks are shuffled, and the sums on their way back hold no weights."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        corpus = lda.chunked_corpus(frame(spark, corpus_rows()).repartition(4), "tokens", "msg_key")
        weights, _ = corpus.by_word(lda.first_weights(corpus.dictionary, 2, 1).repartition(corpus.buckets, "word_id"), "lda-weights")
        seen = lda._seen(corpus, weights, ["w0", "w1"], np.array([9.0, 9.0]), 0.5, 1.0, 0)
        assert seen.columns == ["word_id", "s0", "s1"]
        plan = seen._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 3
        corpus.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_document_longer_than_a_block_is_inferred_alone(monkeypatch):
    monkeypatch.setattr(lda, "BLOCK_CELLS", 4)
    assert list(lda._blocks(np.array([0, 2, 4, 11, 12, 13]))) == [(0, 2), (2, 3), (3, 5)]
    assert list(lda._blocks(np.array([0]))) == []


def test_no_word_of_the_corpus_is_needed_on_the_driver(spark):
    """Odd documents: null and empty lists, null tokens, repeated and null keys."""
    data = [(1, ["a", None, "b", "a"]), (1, ["b"]), (None, ["c"]), (2, []), (3, None), (4, [None])]
    corpus = lda.chunked_corpus(frame(spark, data), "tokens", "msg_key")
    assert (corpus.n_docs, corpus.n_words) == (3, 3)
    assert rows(corpus.dictionary.select("token", "doc_freq", "term_freq", "word_id")) == [("a", 1, 2, 0), ("b", 2, 2, 1), ("c", 1, 1, 2)]
    corpus.drop()
    result = topics.model_topics(frame(spark, data), num_topics=2, num_words=2, passes=2, chunk=2, with_coherence=False)
    assert result.topics.count() == 4 and rows(result.topics) == rows(topics.model_topics(frame(spark, data), num_topics=2, num_words=2, passes=2, chunk=2, with_coherence=False).topics)
    assert topics.model_topics(frame(spark, data).limit(0)).topics.count() == 0


def test_mini_batches_find_the_themes(spark):
    result = topics.model_topics(frame(spark, corpus_rows(300)), num_topics=3, num_words=3, passes=10, chunk=60)
    per_topic = [r["coherence"] for r in result.coherence.collect()]
    assert topics.coherence_score(result).first()[0] == pytest.approx(sum(per_topic) / 3)
    words = [set(r["w"]) - {"the"} for r in result.topics.groupBy("topic").agg(F.collect_set("word").alias("w")).collect()]
    themes = [{"game", "play", "win", "team"}, {"song", "music", "sing"}, {"food", "cook", "eat", "çay"}]
    assert all(sum(bool(w) and w <= t for w in words) == 1 for t in themes)
    again = topics.model_topics(frame(spark, corpus_rows(300)).repartition(7), num_topics=3, num_words=3, passes=10, chunk=60, with_coherence=False)
    assert rows(topics.topic_table(again.topics)) == rows(topics.topic_table(result.topics))


def test_digamma():
    x = np.array([1e-3, 0.25, 0.5, 1, 2, 5.9, 6, 30, 1e6])
    assert lda.digamma(x) == pytest.approx([plain_digamma(v) for v in x], abs=1e-8)


def test_numbers_are_dense_in_order_for_any_layout(spark):
    data = [(f"t{i % 700:03d}é",) for i in range(2000)]
    df = spark.createDataFrame(data, "token string").distinct()
    want = [(t, i) for i, t in enumerate(sorted({t for (t,) in data}, key=str.encode))]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for coalesce in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            assert rows(dictionary.numbered(df.repartition(7), "token", "word_id").select("token", "word_id")) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert dictionary.numbered(df.limit(0), "token", "word_id").count() == 0
