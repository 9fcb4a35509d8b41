"""Chat entries from captured pages and routing of typed capture events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from chatloom.functions import bodies, captured, fixed
from chatloom.functions.captured import EntryMarks


def page_states(pages: DataFrame, html: str = "html", marks: EntryMarks = EntryMarks()) -> DataFrame:
    return pages.withColumn("page_state", captured.page_state(F.col(html), marks))


def page_entries(pages: DataFrame, page_key: str = "page_id", html: str = "html", marks: EntryMarks = EntryMarks()) -> DataFrame:
    """One row per chat entry of every readable page, `entry_pos` giving the page order.

    Error and security pages yield nothing, history breakers are skipped. Row-local.
    """
    readable = page_states(pages, html, marks).filter(F.col("page_state") == "entries")
    entries = readable.select(
        page_key, F.posexplode_outer(captured.entry_parts(F.col(html), marks)).alias("entry_pos", "entry")
    ).filter(~F.contains("entry", F.lit(marks.breaker)))
    entry = F.col("entry")
    return entries.withColumn("user_id", captured.entry_user_id(entry, marks)).select(
        page_key,
        "entry_pos",
        captured.entry_user_name(entry, F.col("user_id"), marks).alias("username"),
        captured.entry_content(entry, marks).alias("content"),
        captured.entry_id(entry).alias("msg_id"),
        "user_id",
    )


def newest_first(entries: DataFrame, page_key: str = "page_id") -> DataFrame:
    """The last entry of a page comes first. The entries of a page lie in one partition, where they are ordered: no shuffle."""
    return entries.sortWithinPartitions(page_key, F.col("entry_pos").desc())


ROUTES = ("message", "status", "error", "warning")


def route_events(events: DataFrame, critical: Iterable[str] = fixed.CRITICAL_ERRORS) -> DataFrame:
    """Add `route` and `is_critical` to `(type, data, …)`; an unlisted type is routed `other`."""
    kind = F.col("type")
    return events.withColumn("route", F.when(kind.isin(*ROUTES), kind).otherwise("other")).withColumn(
        "is_critical", F.coalesce((kind == "error") & bodies.mentions(F.col("data"), critical), F.lit(False))
    )
