"""What lets the topic model grow: packed rows, documents of a width together, texts cleaned in batches."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatloom.functions import batches
from chatloom.operators import cleaning, lda
from tests.conftest import rows


def test_an_update_moves_a_row_for_many_words(spark):
    """Before, an update shuffled and grouped a row for each chunk and word."""
    data = [(i, [f"w{(i * 7 + j * 13) % 400:03d}" for j in range(60)]) for i in range(40)]
    corpus = lda.chunked_corpus(spark.createDataFrame(data, "msg_key int, tokens array<string>").repartition(2), "tokens", "msg_key")
    weights = lda.first_weights(corpus.dictionary, 2, 1)
    found = lda._seen(corpus, weights, ["w0", "w1"], np.array([400.0, 400.0]), 0.5, 1.0, 0).collect()
    assert len(found) <= 2 * 2 * corpus.buckets
    sums = {}
    for r in found:
        for k in range(2):
            for word, n in zip(r["word_id"], lda._whole_of(bytes(r[f"s{k}"]), len(r["word_id"]))):
                sums[word] = sums.get(word, 0) + n / (1 << lda.PRECISION)
    assert sums.pop(lda.SHARES) == pytest.approx(40, abs=1e-3)
    assert sums == {r["word_id"]: pytest.approx(r["term_freq"], abs=1e-3) for r in corpus.dictionary.collect()}
    corpus.drop()


@pytest.mark.parametrize("kind", [np.int32, np.uint32, np.int64, np.float32, np.float64])
def test_packed_numbers_come_back(kind):
    for n in (0, 1, 2, 1000):
        x = (np.random.default_rng(n).random(n) * 1e9).astype(kind)
        assert (lda._unpacked(lda._packed(x), n, kind) == x).all()


def test_large_sums_and_places_come_back():
    for x in (np.array([0, 7, (1 << 32) - 1]), np.array([1 << 32, 5])):
        assert (lda._whole_of(lda._whole(x), len(x)) == x).all()
    sizes, places = np.array([3, 1, 2]), np.array([4, 9, 10, 2, 0, 7], np.int32)
    assert (lda._summed_steps(lda._steps(places, np.array([0, 3, 4])), sizes) == places).all()


def test_a_document_is_inferred_alike_in_any_company():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 90, 200)
    places, counts = rng.integers(0, 500, sizes.sum()), rng.integers(1, 6, sizes.sum())
    by_topic, starts = rng.gamma(1.0, 0.01, (4, 500)), np.cumsum(sizes) - sizes
    together = np.empty((200, 4))
    for mine, gamma, _, taken in lda._inferred(sizes, places, counts, by_topic, 0.25):
        together[mine] = gamma
        assert taken.sum() == pytest.approx(sum(counts[starts[i] : starts[i] + sizes[i]].sum() for i in mine))
    for i in range(0, 200, 17):
        own = slice(starts[i], starts[i] + sizes[i])
        [(_, gamma, _, _)] = lda._inferred(sizes[i : i + 1], places[own], counts[own], by_topic, 0.25)
        assert (gamma[0] == together[i]).all()


def test_words_of_batches_are_those_of_the_expressions(spark):
    rng = random.Random(5)
    pieces = [
        "http", "http ", "http!", "!", "!http", " ", "\t", "\n", "\x1c", "\x85", " ", " ", "　", "https://x.y/z", "cannot", " cannot ", "gonna", "lemme",
        "gimme ", "GOTTA", "the", "Straße", "İstanbul", "ΑΣ", "ΣΑΣ ", "éé", "çok", "12", "x1y", "_", "__a", "'", "don't", ".", "abc", "defg", "日本語", "٣", "Ⅷ", "½", "𝒳yz", "​",
    ]
    texts = [None, "", " ", "!", *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(5000))]
    texts += [f"ab{chr(c)}cd xy{chr(c)}zwv" for c in [*range(0x20, 0x3000, 7), *range(0x80, 0x900), *range(0x10000, 0x32400, 61)]]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_key int, message string")
    for stops in (cleaning.combined_stop_words(), ["abc"], []):
        want = cleaning.with_tokens(df, stop_words=stops).select("msg_key", "tokens")
        assert rows(cleaning.with_tokens(df, stop_words=stops, in_batches=True).select("msg_key", "tokens")) == rows(want)
    assert rows(cleaning.with_tokens(df, in_batches=True, lemmas={"abc": "x"}).select("tokens")) == rows(cleaning.with_tokens(df, lemmas={"abc": "x"}).select("tokens"))


def test_a_filter_does_not_clean_twice(spark):
    df = spark.createDataFrame([(1, "some words here"), (2, "")], "msg_key int, message string")
    kept = cleaning.with_tokens(df, in_batches=True).where(F.size("tokens") > 0)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.tokens for r in kept.collect()] == [["words"]]


def test_a_text_larger_than_a_part_is_cleaned(spark, monkeypatch):
    monkeypatch.setattr(batches, "PART", 10)
    parts = [p.to_pylist() for p in batches._parts(pa.array(["abc", "a" * 30, "", "defghij", "klm"]))]
    assert parts == [["abc"], ["a" * 30], ["", "defghij", "klm"]]
    assert [p.to_pylist() for p in batches._parts(pa.array([], pa.string()))] == [[]]


def test_vocabulary_counts_odd_lists(spark, monkeypatch):
    data = [(["a", None, "b", "a"],), (["b"],), ([],), (None,), ([None],), (["a"] * 5,)]
    monkeypatch.setattr(cleaning, "COUNTED", 3)
    assert rows(cleaning.vocabulary(spark.createDataFrame(data, "tokens array<string>"))) == [("a", 2, 7), ("b", 2, 2)]
    assert cleaning.vocabulary(spark.createDataFrame([], "tokens array<string>")).count() == 0
