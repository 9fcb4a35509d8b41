"""Sentiment of messages: word polarity, rule-based valence, trained model, dispatch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from chatloom.functions import fixed, lookup, text

WordWeights = Mapping[str, float] | DataFrame


def label_of(score: Column, threshold: float, inclusive: bool) -> Column:
    up = score >= threshold if inclusive else score > threshold
    down = score <= -threshold if inclusive else score < -threshold
    return F.when(up, "positive").when(down, "negative").otherwise("neutral")


# --- polarity: mean weight of the known words -------------------------------------


def with_polarity(
    df: DataFrame,
    lexicon: WordWeights,
    text_col: str = "message",
    key: str = "msg_key",
    threshold: float = fixed.POLARITY_THRESHOLD,
) -> DataFrame:
    """Add `sentiment_score` (mean weight of lexicon words, 0 without any) and `sentiment`."""
    words = df.withColumn("_words", text.lower_words(F.col(text_col)))
    weighed = lookup.attach_values(words, key, "_words", "_weights", lexicon, "double")
    hits = F.filter("_weights", lambda w: w.isNotNull())
    mean = F.aggregate(
        hits,
        F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n")),
        lambda a, w: F.struct((a["total"] + w).alias("total"), (a["n"] + 1).alias("n")),
        lambda a: F.when(a["n"] > 0, a["total"] / a["n"]).otherwise(0.0),
    )
    return (
        weighed.withColumn("sentiment_score", mean)
        .withColumn("sentiment", label_of(F.col("sentiment_score"), threshold, inclusive=False))
        .drop("_words", "_weights")
    )


# --- valence: known words corrected by their neighbours ---------------------------


@dataclass(frozen=True)
class ValenceWords:
    """Function words of the valence rules."""

    negations: Sequence[str] = fixed.NEGATIONS
    boosters_up: Sequence[str] = fixed.BOOSTERS_UP
    boosters_down: Sequence[str] = fixed.BOOSTERS_DOWN
    contrast: str = "but"


def with_valence(
    df: DataFrame,
    lexicon: WordWeights,
    text_col: str = "message",
    key: str = "msg_key",
    threshold: float = fixed.VALENCE_THRESHOLD,
    rules: ValenceWords = ValenceWords(),
) -> DataFrame:
    """Add `sentiment_score` in [-1, 1] and `sentiment`.

    Every word carries its three predecessors, so boosters, negations and capitals are
    resolved inside the row: no window and no shuffle.
    """
    words = df.withColumn("_words", text.raw_words(F.col(text_col))).withColumn("_low", F.transform("_words", F.lower))
    weighed = lookup.attach_values(words, key, "_low", "_weights", lexicon, "double")
    facts = F.transform(
        F.arrays_zip(F.col("_words").alias("word"), F.col("_low").alias("low"), F.col("_weights").alias("weight")),
        lambda z, i: F.struct(z["word"], z["low"], z["weight"], (i + 1).alias("at")),
    )
    shouted = F.exists("_facts", _is_caps) & ~F.forall("_facts", _is_caps)
    contrast_at = F.array_position("_low", rules.contrast)
    raw = F.coalesce(F.col(text_col), F.lit(""))
    # One column per step: each is read several times by the next one and must not be worked out again.
    return (
        weighed.withColumn("_facts", facts)
        .withColumn("_sum", _valence_sum(F.col("_facts"), shouted, contrast_at, rules))
        .withColumn("_total", _emphasised(F.col("_sum"), raw))
        .withColumn("sentiment_score", F.round(F.col("_total") / F.sqrt(F.col("_total") ** 2 + fixed.NORMALISER), 4))
        .withColumn("sentiment", label_of(F.col("sentiment_score"), threshold, inclusive=True))
        .drop("_words", "_low", "_weights", "_facts", "_sum", "_total")
    )


def _is_caps(fact: Column) -> Column:
    return (fact["word"] != fact["low"]) & text.is_upper(fact["word"])


def _boost(word: Column, rules: ValenceWords) -> Column:
    return (
        F.when(word.isin(*rules.boosters_up), fixed.BOOST)
        .when(word.isin(*rules.boosters_down), -fixed.BOOST)
        .otherwise(0.0)
    )


def _negates(word: Column, rules: ValenceWords) -> Column:
    return F.replace(word, F.lit("'"), F.lit("")).isin(*rules.negations) | F.contains(word, F.lit("n't"))


def _valence_sum(facts: Column, shouted: Column, contrast_at: Column, rules: ValenceWords) -> Column:
    none = F.array(F.lit(None).cast("struct<word:string,low:string,weight:double,at:int>"))
    zipped = F.arrays_zip(
        facts.alias("here"),
        F.concat(none, facts).alias("back1"),
        F.concat(none, none, facts).alias("back2"),
        F.concat(none, none, none, facts).alias("back3"),
    )
    # Only words that carry a weight and are not boosters themselves can add to the sum; the
    # rules about the words in front are worked out for these alone.
    boosters = sorted({*rules.boosters_up, *rules.boosters_down})
    carriers = F.filter(zipped, lambda z: z["here"]["weight"].isNotNull() & ~z["here"]["low"].isin(boosters))

    # The facts about the whole message ride in the state: named inside the lambda they would
    # be worked out again for every word.
    def state(total: Column, caps: Column, at: Column) -> Column:
        return F.struct(total.alias("total"), caps.alias("shouted"), at.alias("contrast_at"))

    return F.aggregate(
        carriers,
        state(F.lit(0.0), shouted, contrast_at),
        lambda s, z: state(
            s["total"] + _word_valence(z, s["shouted"], s["contrast_at"], rules), s["shouted"], s["contrast_at"]
        ),
        lambda s: s["total"],
    )


def _word_valence(z: Column, shouted: Column, contrast_at: Column, rules: ValenceWords) -> Column:
    here = z["here"]
    emphasis = F.when(here["weight"] > 0, fixed.CAPS_EMPHASIS).otherwise(-fixed.CAPS_EMPHASIS)
    start = here["weight"] + F.when(shouted & _is_caps(here), emphasis).otherwise(0.0)
    steps = F.array(
        *[
            F.struct(
                z[f"back{i + 1}"].alias("b"),
                _boost(z[f"back{i + 1}"]["low"], rules).alias("boost"),
                F.lit(damp).alias("damp"),
            )
            for i, damp in enumerate(fixed.BOOST_DAMPING)
        ]
    )

    def step(valence: Column, s: Column) -> Column:
        signed = F.when(valence < 0, -s["boost"]).otherwise(s["boost"])
        caps = F.when(
            shouted & (s["boost"] != 0.0) & _is_caps(s["b"]),
            F.when(valence > 0, fixed.CAPS_EMPHASIS).otherwise(-fixed.CAPS_EMPHASIS),
        ).otherwise(0.0)
        moved = valence + (signed + caps) * s["damp"]
        factor = F.when(_negates(s["b"]["low"], rules), fixed.NEGATION_FACTOR).otherwise(1.0)
        # A known word in front is scored on its own and does not change this one.
        return F.when(s["b"].isNotNull() & s["b"]["weight"].isNull(), moved * factor).otherwise(valence)

    side = (
        F.when(contrast_at == 0, 1.0)
        .when(here["at"] < contrast_at, fixed.BEFORE_BUT)
        .when(here["at"] > contrast_at, fixed.AFTER_BUT)
        .otherwise(1.0)
    )
    return F.aggregate(steps, start, step) * side


def _emphasised(total: Column, raw: Column) -> Column:
    exclamations = F.length(raw) - F.length(F.replace(raw, F.lit("!"), F.lit("")))
    questions = F.length(raw) - F.length(F.replace(raw, F.lit("?"), F.lit("")))
    marks = F.least(exclamations, F.lit(fixed.EXCLAMATION_MAX)) * fixed.EXCLAMATION_STEP + (
        F.when(questions <= 1, 0.0).when(questions <= 3, questions * fixed.QUESTION_STEP).otherwise(fixed.QUESTION_FULL)
    )
    return F.when(total > 0, total + marks).when(total < 0, total - marks).otherwise(total)


# --- trained model ----------------------------------------------------------------


def with_model_label(
    df: DataFrame,
    model: PipelineModel,
    text_col: str = "message",
    two_class: bool = False,
    model_text: str = "text",
) -> DataFrame:
    """Label by a fitted pipeline that writes `predicted_name`; blank text stays `unknown`.

    Row-local, over whole texts.
    """
    kept = df.columns
    scored = model.transform(df.withColumn(model_text, F.coalesce(F.col(text_col), F.lit(""))))
    allowed = ("positive", "negative") if two_class else ("positive", "negative", "neutral")
    named = model_label_name(F.col("predicted_name"), allowed)
    sentiment = F.when(text.is_blank(F.col(text_col)), "unknown").otherwise(named)
    return scored.select(*kept, sentiment.alias("sentiment"))


def model_label_name(raw: Column, allowed: tuple[str, ...] = fixed.LABELS[:3]) -> Column:
    """`LABEL_n` / `n` / the name itself -> name; anything else is `unknown`."""
    chain = F.when(raw.isin(*allowed), raw)
    for label, name in fixed.MODEL_LABEL_NAMES.items():
        if name in allowed:
            chain = chain.when(raw == label, name)
    return chain.otherwise("unknown")


def with_batch_model_label(df: DataFrame, make_predict_fn: Callable, text_col: str = "message", batch_size: int = 256) -> DataFrame:
    """Label by a user's own model, called with Arrow batches and loaded once per Python worker.

    `make_predict_fn()` returns a function from an array of texts to an array of labels.
    """
    def make() -> Callable:
        answer = make_predict_fn()

        def predict_some(texts: np.ndarray) -> np.ndarray:
            given = texts != ""
            out = np.full(len(texts), "unknown", object)
            if given.any():
                out[given] = answer(texts[given])
            return out

        return predict_some

    predict = predict_batch_udf(make, return_type=StringType(), batch_size=batch_size)
    # One read of the input; a blank text becomes empty here and never reaches the model.
    said = F.when(text.is_blank(F.col(text_col)), "").otherwise(F.col(text_col))
    named = model_label_name(predict(said))
    return df.withColumn("sentiment", F.when(text.is_blank(F.col(text_col)), "unknown").otherwise(named))


# --- dispatch ---------------------------------------------------------------------

METHODS = ("textblob", "bert", "vader", "custom_kick_bert")


def run_sentiment(
    df: DataFrame,
    method: str = "bert",
    *,
    lexicon: WordWeights | None = None,
    model: PipelineModel | None = None,
    text_col: str = "message",
    key: str = "msg_key",
    rules: ValenceWords = ValenceWords(),
) -> DataFrame:
    """Add `sentiment` by method name; the lexicon or fitted model comes from the caller.

    An unknown name is an error, not a table full of `neutral`.
    """
    if method not in METHODS:
        raise ValueError(f"unknown sentiment method {method!r}; expected one of {', '.join(METHODS)}")
    if method in ("textblob", "vader"):
        if lexicon is None:
            raise ValueError(f"method {method!r} needs a lexicon")
        if method == "textblob":
            return with_polarity(df, lexicon, text_col, key)
        return with_valence(df, lexicon, text_col, key, rules=rules)
    if model is None:
        raise ValueError(f"method {method!r} needs a fitted model")
    return with_model_label(df, model, text_col, two_class=method == "bert")
