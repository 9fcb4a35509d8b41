"""Whole jobs: chat-log analysis, label comparison, captured pages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from chatloom.functions.captured import EntryMarks
from chatloom.operators import capture, cleaning, compare, dedupe, report, topics
from chatloom.operators.sentiment import WordWeights, run_sentiment
from chatloom.session import materialise


@dataclass
class ChatReport:
    scored: DataFrame
    preview: DataFrame
    distribution: DataFrame
    trend: DataFrame
    topics: topics.TopicResult
    suggestions: DataFrame


def analyse_chat(
    chat: DataFrame,
    method: str = "bert",
    *,
    lexicon: WordWeights | None = None,
    model: PipelineModel | None = None,
    stop_words: Iterable[str] | DataFrame | None = None,
    lemmas: Mapping[str, str] | DataFrame | None = None,
    num_topics: int = 4,
    num_words: int = 5,
    period: str = "minute",
) -> ChatReport:
    """Label, count, chart, model topics and advise.

    Scoring and cleaning are row-local and run once: five consumers read the written table.
    """
    scored = run_sentiment(chat, method, lexicon=lexicon, model=model)
    scored = materialise(cleaning.with_tokens(scored, stop_words=stop_words, lemmas=lemmas), "scored-chat")
    modelled = topics.model_topics(scored, num_topics=num_topics, num_words=num_words)
    return ChatReport(
        scored=scored,
        preview=report.preview(scored, ("ts", "msg_key")),
        distribution=report.distribution(scored),
        trend=report.trend(scored, period=period),
        topics=modelled,
        suggestions=report.suggestions(scored, modelled.topics),
    )


@dataclass
class Comparison:
    label_counts: DataFrame
    overlap: DataFrame
    confusion: DataFrame
    differences: DataFrame
    accuracy: DataFrame
    repeated_keys: DataFrame


def compare_labels(predicted: DataFrame, actual: DataFrame, keys: tuple[str, ...] | None = None) -> Comparison:
    """Counts come from the folded join; only `differences` builds the row-level join."""
    if keys is None:
        both_have_id = "msg_id" in predicted.columns and "msg_id" in actual.columns
        keys = ("msg_id",) if both_have_id else compare.KEYS
    # Four readers of a table of labels x labels rows.
    counts = materialise(compare.pair_counts(predicted, actual, keys), "pair-counts")
    return Comparison(
        label_counts=compare.all_label_counts(predicted, actual, counts),
        overlap=compare.overlap_report(predicted, actual, counts),
        confusion=compare.confusion_counts(counts),
        differences=compare.differences(compare.matched_pairs(predicted, actual, keys)),
        accuracy=compare.accuracy(counts),
        repeated_keys=compare.duplicate_keys(predicted, keys),
    )


def captured_messages(pages: DataFrame, marks: EntryMarks = EntryMarks()) -> DataFrame:
    """Every chat message of the captured pages once, from its first page."""
    return dedupe.first_per_id(capture.page_entries(pages, marks=marks), "msg_id", ("page_id", "entry_pos"))
