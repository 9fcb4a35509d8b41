import math
import re

import pytest
from pyspark.sql import functions as F

from chatloom.functions import fixed, lookup, text
from chatloom.operators import cleaning, sentiment
from tests.conftest import rows

STOPS = {"the", "and", "not", "can"}


def python_clean(value, stops):
    """The contract, written once more in plain Python for comparison."""
    low = re.sub(r"http\S+", "", ("" if value is None else value).lower())
    if low.strip().startswith("!"):
        return []
    low = re.sub(r"\d+", "", re.sub(r"[^\w\s]", "", low))
    parts = dict(fixed.CONTRACTIONS)
    tokens = " ".join(parts.get(w, w) for w in low.split()).split()
    return [t for t in tokens if t not in stops and len(t) >= 3]


EDGES = [
    None, "", "   ", "!command now", "http://x !command", "  !late", "İYİ YAYIN", "ığüşöç ĞÜŞ", "a_b under_score",
    "½ cup ½½½", "no break space", "gonna cannot cannot gimme", "null", "NA", "nan", "ab abc abcd",
    "the the cat AND the dog", "see https://a.b/c?d=e now", "x1y2z3 12345", "line\x0bone\x1ctwo\x85three four",
    "éclair café", "Ⅷ roman ²³¹", "cannot!", "wanna-be", "don't stop", "😀 smile😀face",
]


def test_cleaning_equals_the_contract(spark):
    df = spark.createDataFrame(list(enumerate(EDGES)), "msg_key int, message string")
    got = {r.msg_key: r.tokens for r in cleaning.with_tokens(df, stop_words=STOPS).collect()}
    assert got == {i: python_clean(v, STOPS) for i, v in enumerate(EDGES)}


def test_default_stop_words_hold_all_three_lists(spark):
    words = cleaning.combined_stop_words()
    assert {"the", "acaba", "kekw"} <= words


def test_lemmas_come_last_and_are_not_checked_again(spark):
    df = spark.createDataFrame([(1, "running dogs the")], "msg_key int, message string")
    got = cleaning.with_tokens(df, stop_words=STOPS, lemmas={"running": "the", "dogs": "x"}).first().tokens
    assert got == ["the", "x"]


@pytest.mark.parametrize("parts", [1, 7])
def test_big_word_tables_give_the_same_result_by_join(spark, parts, monkeypatch):
    df = spark.createDataFrame(list(enumerate(EDGES + ["cat dog cat"])), "msg_key int, message string").repartition(parts)
    lexicon = {"cat": 1.0, "dog": -0.5, "yayin": 0.25, "stop": -1.0}
    table = spark.createDataFrame(list(lexicon.items()), "word string, weight double")
    stops = spark.createDataFrame([(w,) for w in STOPS], "word string")
    small = (
        rows(sentiment.with_polarity(df, lexicon)),
        rows(sentiment.with_polarity(df, table)),
        rows(sentiment.with_valence(df, table)),
        rows(cleaning.with_tokens(df, stop_words=stops)),
    )
    assert small[0] == small[1]
    monkeypatch.setattr(lookup.bounded_entries, "__defaults__", (1,))
    monkeypatch.setattr(lookup.attach_values, "__defaults__", (lookup.attach_values.__defaults__[0], 1))
    plan = sentiment.with_polarity(df, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan
    big = (
        rows(sentiment.with_polarity(df, lexicon)),
        rows(sentiment.with_polarity(df, table)),
        rows(sentiment.with_valence(df, table)),
        rows(cleaning.with_tokens(df, stop_words=stops)),
    )
    assert big == small


def test_small_names(spark):
    df = spark.createDataFrame([("my chan-ğ1",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(text.safe_name(F.col("c"))).collect()] == ["my_chan_ğ1", "unknown_kick_channel", "unknown_kick_channel"]
    assert [r[0] for r in df.select(text.short_id(F.col("c"))).collect()] == ["han-ğ1", "", "N/A"]
    name = df.limit(1).select(text.log_name(F.col("c"), F.lit("2025-05-07 18:12:20").cast("timestamp"))).first()[0]
    assert name == "live-kick-data-my_chan_ğ1-20250507-181220"


def test_times_weights_and_blanks(spark):
    df = spark.createDataFrame([("2025-05-07T22:23:13.151683",), ("2025-04-25 10:00:00",), ("soon",), (None,)], "t string")
    got = [r[0] for r in df.select(text.parse_time(F.col("t"))).collect()]
    assert got[0].microsecond == 151683 and got[1].hour == 10 and got[2:] == [None, None]
    assert spark.range(1).select(text.weight_text(F.lit(0.12))).first()[0] == "0.120"
    blank = spark.createDataFrame([(None,), ("",), (" \t ",), ("x",)], "t string").select(text.is_blank(F.col("t")))
    assert [r[0] for r in blank.collect()] == [True, True, True, False]


# --- sentiment --------------------------------------------------------------------

LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1, "love": 3.2, "no": -1.2}


def python_valence(value):
    words = []
    for w in (value or "").split():
        bare = w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        words.append(w if len(bare) <= 2 else bare)
    low = [w.lower() for w in words]
    caps = [w.isupper() for w in words]
    shouted = any(caps) and not all(caps)
    total = 0.0
    for i, w in enumerate(low):
        if w not in LEXICON or w in fixed.BOOSTERS_UP + fixed.BOOSTERS_DOWN:
            continue
        v = LEXICON[w]
        if caps[i] and shouted:
            v += 0.733 if v > 0 else -0.733
        for d, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i < d or low[i - d] in LEXICON:
                continue
            b = low[i - d]
            s = 0.293 if b in fixed.BOOSTERS_UP else -0.293 if b in fixed.BOOSTERS_DOWN else 0.0
            s = -s if v < 0 else s
            if s and caps[i - d] and shouted:
                s += 0.733 if v > 0 else -0.733
            v += s * damp
            if b.replace("'", "") in fixed.NEGATIONS or "n't" in b:
                v *= -0.74
        if "but" in low:
            at = low.index("but")
            v *= 0.5 if i < at else 1.5 if i > at else 1.0
        total += v
    text_ = value or ""
    marks = min(text_.count("!"), 4) * 0.292
    q = text_.count("?")
    marks += 0.0 if q <= 1 else q * 0.18 if q <= 3 else 0.96
    total = total + marks if total > 0 else total - marks if total < 0 else total
    return round(total / math.sqrt(total * total + 15), 4)


VALENCE_TEXTS = [
    None, "", "good", "not good", "don't love it", "very good", "VERY good", "this is GREAT", "ALL GREAT", "good but bad",
    "bad but very good!!!", "extremely really very good", "good????", "good??", "good!!!!!!!", "hardly good",
    "no good", "never was it so great", "GOOD, bad; 'great'", "neutral words only", "not very bad", "bad! bad? bad.",
    "without any love", ":) good", "is it good? or bad?", "but good", "good but",
]


def test_valence_equals_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(VALENCE_TEXTS)), "msg_key int, message string")
    for layout in (1, 7):
        scored = sentiment.with_valence(df.repartition(layout), LEXICON)
        got = {r.msg_key: r.sentiment_score for r in scored.collect()}
        assert got == {i: python_valence(v) for i, v in enumerate(VALENCE_TEXTS)}


def test_labels_follow_thresholds(spark):
    df = spark.createDataFrame([(0.1,), (0.11,), (-0.1,), (-0.11,), (0.05,), (-0.05,), (0.0,)], "s double")
    strict = [r[0] for r in df.select(sentiment.label_of(F.col("s"), 0.1, False)).collect()]
    assert strict == ["neutral", "positive", "neutral", "negative", "neutral", "neutral", "neutral"]
    wide = [r[0] for r in df.select(sentiment.label_of(F.col("s"), 0.05, True)).collect()]
    assert wide == ["positive", "positive", "negative", "negative", "positive", "negative", "neutral"]


def test_polarity_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "good bad"), (2, None), (3, "good, GOOD"), (4, "x")], "msg_key int, message string")
    got = {r.msg_key: (r.sentiment_score, r.sentiment) for r in sentiment.with_polarity(df, {"good": 0.5, "bad": -0.25}).collect()}
    assert got == {1: (0.125, "positive"), 2: (0.0, "neutral"), 3: (0.5, "positive"), 4: (0.0, "neutral")}


def test_dispatch_rejects_unknown_names(spark):
    df = spark.createDataFrame([(1, "good")], "msg_key int, message string")
    with pytest.raises(ValueError):
        sentiment.run_sentiment(df, "oracle")
    with pytest.raises(ValueError):
        sentiment.run_sentiment(df, "vader")
    with pytest.raises(ValueError):
        sentiment.run_sentiment(df, "bert")
    assert sentiment.run_sentiment(df, "vader", lexicon=LEXICON).first().sentiment == "positive"


def test_model_label_names(spark):
    df = spark.createDataFrame([("LABEL_0",), ("1",), ("LABEL_2",), ("positive",), ("LABEL_9",), (None,)], "l string")
    got = [r[0] for r in df.select(sentiment.model_label_name(F.col("l"))).collect()]
    assert got == ["negative", "neutral", "positive", "positive", "unknown", "unknown"]
    two = [r[0] for r in df.select(sentiment.model_label_name(F.col("l"), ("positive", "negative"))).collect()]
    assert two == ["negative", "unknown", "positive", "positive", "unknown", "unknown"]


def test_user_model_gets_batches_without_blanks(spark):
    def make():
        def predict(texts):
            import numpy as np

            assert all(str(t).strip() for t in texts)
            return np.array(["LABEL_2" if "good" in str(t) else "LABEL_0" for t in texts])

        return predict

    df = spark.createDataFrame([(1, "good"), (2, " "), (3, "so"), (4, None)], "msg_key int, message string")
    got = {r.msg_key: r.sentiment for r in sentiment.with_batch_model_label(df, make).collect()}
    assert got == {1: "positive", 2: "unknown", 3: "negative", 4: "unknown"}


def test_scoring_has_no_shuffle(spark):
    df = spark.createDataFrame([(1, "good")], "msg_key int, message string")
    for frame in (sentiment.with_polarity(df, LEXICON), sentiment.with_valence(df, LEXICON), cleaning.with_tokens(df)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
