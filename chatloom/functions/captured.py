"""Captured chat pages: entry split, tag stripping, delimiter extraction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from chatloom.functions import fixed
from chatloom.functions.text import strip


@dataclass(frozen=True)
class EntryMarks:
    """Delimiters of one chat entry; the defaults are those of the live chat page."""

    entry: str = fixed.ENTRY_MARK
    content: str = fixed.CONTENT_MARK
    content_end: str = fixed.CONTENT_END
    user_id: str = fixed.USER_ID_MARK
    name_end: str = fixed.NAME_END
    breaker: str = fixed.BREAKER_MARK


def strip_tags(html: Column) -> Column:
    """Drop every `<…>`, an unclosed `<…` tail and stray `>`; entities stay encoded."""
    return F.replace(F.regexp_replace(html, r"<[^>]*(>|\z)", ""), F.lit(">"), F.lit(""))


def page_state(html: Column, marks: EntryMarks = EntryMarks()) -> Column:
    """`error`, `security_check`, `no_entries` or `entries`."""
    return (
        F.when(F.contains(html, F.lit(fixed.ERROR_PAGE_TEXT)), "error")
        .when(F.contains(html, F.lit(fixed.SECURITY_PAGE_TEXT)), "security_check")
        .when(F.contains(html, F.lit(marks.entry)), "entries")
        .otherwise("no_entries")
    )


def entry_parts(html: Column, marks: EntryMarks = EntryMarks()) -> Column:
    """The pieces after each entry mark; what stands before the first one is dropped."""
    pieces = F.split(html, rf"\Q{marks.entry}\E")
    return F.slice(pieces, F.lit(2), F.size(pieces))


def before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def entry_id(entry: Column) -> Column:
    return before(entry, '"')


def entry_content(entry: Column, marks: EntryMarks = EntryMarks()) -> Column:
    inner = before(F.split_part(entry, F.lit(marks.content), F.lit(2)), marks.content_end)
    return F.when(F.contains(entry, F.lit(marks.content)), strip(strip_tags(inner))).otherwise("")


def entry_user_id(entry: Column, marks: EntryMarks = EntryMarks()) -> Column:
    found = before(F.split_part(entry, F.lit(marks.user_id), F.lit(2)), '"')
    return F.when(F.contains(entry, F.lit(marks.user_id)), found).otherwise(fixed.NO_USER_ID)


def entry_user_name(entry: Column, user_id: Column, marks: EntryMarks = EntryMarks()) -> Column:
    """Text after `id="<user id>" style="…">` up to the closing mark."""
    label = F.concat(F.lit('id="'), user_id, F.lit('" style="'))
    styled = F.split_part(entry, label, F.lit(2))
    end = F.locate('">', styled)
    name = strip(before(F.substring(styled, end + 2, F.length(styled)), marks.name_end))
    return F.when(F.contains(entry, label) & (end > 0), name).otherwise(fixed.NO_USER_NAME)


def snippet(entry: Column) -> Column:
    return F.left(entry, F.lit(fixed.SNIPPET_LENGTH))
