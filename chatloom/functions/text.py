"""Text cleaning as built-in column expressions.

The classes below mean the same in Java regex and in RE2, and follow Unicode word
characters without combining marks (`[letter, number, _]`) and Unicode white space.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from chatloom.functions import fixed

SPACE = r"\t\n\x0B\f\r\x1C-\x1F\x20\x85\p{Z}"
SPACES = f"[{SPACE}]+"
EDGE_SPACES = f"^[{SPACE}]+|[{SPACE}]+$"  # as a pattern, for SQL
# Every character of the class above, for trimming without a pattern.
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
URL = f"http[^{SPACE}]+"
PUNCTUATION = rf"[^\p{{L}}\p{{N}}_{SPACE}]"
DIGITS = r"\p{Nd}+"
# Punctuation and digits in one class: what is no letter, no other number, no `_`, no space.
NOISE = rf"[^\p{{L}}\p{{Nl}}\p{{No}}_{SPACE}]+"
COMMAND = rf"(?s)\A[{SPACE}]*!.*"
NOT_WORD = r"[^\p{L}\p{N}_']+"
PUNCTUATION_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]+"  # the same marks as a class, for SQL
EDGE_PUNCTUATION = f"^{ASCII_PUNCTUATION}|{ASCII_PUNCTUATION}$"
CASED_UPPER = r"\p{Lu}"
CASED_LOWER = r"\p{Ll}"


def strip(col: Column) -> Column:
    """Trim every kind of white space on both ends, not only blanks."""
    return F.btrim(col, F.lit(SPACE_CHARACTERS))


def is_blank(col: Column) -> Column:
    """Null, empty or white space only."""
    return strip(F.coalesce(col, F.lit(""))) == ""


def remove_urls(col: Column) -> Column:
    return F.regexp_replace(col, URL, "")


def remove_punctuation(col: Column) -> Column:
    return F.regexp_replace(col, PUNCTUATION, "")


def remove_digits(col: Column) -> Column:
    return F.regexp_replace(col, DIGITS, "")


def is_command(col: Column) -> Column:
    """A bot command: the first non-blank character after URL removal is `!`."""
    return remove_urls(F.lower(F.coalesce(col, F.lit("")))).rlike(COMMAND)


def plain_text(col: Column) -> Column:
    """Lower-case text without URLs, punctuation and digits; a command becomes empty."""
    bare = remove_urls(F.lower(F.coalesce(col, F.lit(""))))
    # The command rule is a replacement, not a branch, so that `bare` is worked out once.
    return F.regexp_replace(F.regexp_replace(bare, COMMAND, ""), NOISE, "")


def split_words(col: Column) -> Column:
    """White-space words of a plain text, contractions split; may hold empty words at the ends."""
    # Two blanks between words so that neighbouring contractions do not share one.
    spaced = F.concat(F.lit(" "), F.regexp_replace(col, SPACES, "  "), F.lit(" "))
    suspect = F.lit(False)
    for word, parts in fixed.CONTRACTIONS:
        spaced = F.replace(spaced, F.lit(f" {word} "), F.lit(f" {parts} "))
        suspect = suspect | F.contains(col, F.lit(word))
    return F.when(suspect, F.split(spaced, " +")).otherwise(F.split(col, SPACES))


def keep_words(words: Column, stop_words: Iterable[str], min_length: int = fixed.MIN_WORD_LENGTH) -> Column:
    """Drop stop words and short words; repeated words stay, unlike `array_except`."""
    stops = sorted(set(stop_words))
    long_enough = lambda w: F.length(w) >= max(min_length, 1)
    if not stops:
        return F.filter(words, long_enough)
    return F.filter(words, lambda w: long_enough(w) & ~w.isin(stops))


def clean_words(col: Column, stop_words: Iterable[str], min_length: int = fixed.MIN_WORD_LENGTH) -> Column:
    """Words of a plain text without stop words and short words, before the lemma lookup."""
    return keep_words(split_words(col), stop_words, min_length)


def lower_words(col: Column) -> Column:
    """Lower-case words of the raw text, used by the polarity score."""
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), NOT_WORD), lambda w: w != "")


def raw_words(col: Column) -> Column:
    """Words with their case, outer punctuation stripped unless that leaves 2 characters or less."""
    words = F.filter(F.split(F.coalesce(col, F.lit("")), SPACES), lambda w: w != "")

    pairs = F.transform(
        words, lambda w: F.struct(w.alias("word"), F.btrim(w, F.lit(PUNCTUATION_MARKS)).alias("bare"))
    )
    return F.transform(pairs, lambda p: F.when(F.length(p["bare"]) <= 2, p["word"]).otherwise(p["bare"]))


def is_upper(word: Column) -> Column:
    """At least one upper-case letter and no lower-case letter."""
    return word.rlike(CASED_UPPER) & ~word.rlike(CASED_LOWER)


def safe_name(col: Column, default: str = fixed.UNKNOWN_CHANNEL) -> Column:
    """Every character that is neither letter nor number becomes `_`; empty gets the default."""
    named = F.regexp_replace(F.coalesce(col, F.lit("")), r"[^\p{L}\p{N}]", "_")
    return F.when(named == "", default).otherwise(named)


def log_name(channel: Column, at: Column, prefix: str = fixed.LOG_NAME_PREFIX) -> Column:
    """`<prefix>-<channel>-<yyyyMMdd-HHmmss>`."""
    return F.concat_ws("-", F.lit(prefix), safe_name(channel), F.date_format(at, "yyyyMMdd-HHmmss"))


def short_id(col: Column) -> Column:
    return F.right(F.coalesce(col, F.lit("N/A")), F.lit(6))


def parse_time(col: Column) -> Column:
    """Timestamp of a text in ISO or `yyyy-MM-dd HH:mm:ss` form; null when it is neither."""
    return F.try_to_timestamp(col)


def weight_text(col: Column) -> Column:
    """A weight with exactly three decimals, for display."""
    return F.format_string("%.3f", col)
