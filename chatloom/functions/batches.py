"""The words of `text.clean_words` for many texts at once, in Arrow.

The same rules, a word at a time: no rule looks across white space but that for commands. So the distinct words of a batch are
cleaned once, and the texts are put together from them. Texts come in lower case, as Spark makes it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from chatloom.functions import fixed

# Letters and numbers that came after Unicode 13, the version of Java 17: its patterns take them for noise, RE2's for letters.
LATER = """
    870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7D0-A7D1 A7D3 A7D5-A7D9
    A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC
    10780-10785 10787-107B0 107B2-107BA 10F70-10F81 11071-11072 11075 1123F-11240 11740-11746 11AB0-11ABF 11F02
    11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 16A70-16ABE 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE
    1B11F-1B122 1B132 1B155 1D2C0-1D2D3 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E7E0-1E7E6
    1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF
""".split()
# Letters, numbers that are no decimal digits, and `_` stay.
NOISE = r"(?:[^\p{L}\p{Nl}\p{No}_]|[" + "".join("-".join(r"\x{%s}" % c for c in run.split("-")) for run in LATER) + "])+"
URL = r"(?s)http.+"
# Characters of texts that are cleaned together.
PART = 16_000_000


def clean_words(col: Column, stop_words: Iterable[str], min_length: int = fixed.MIN_WORD_LENGTH) -> Column:
    """`text.clean_words(text.plain_text(col), …)`, by a function over Arrow batches: it pays for long texts."""
    stops, shortest = sorted(set(stop_words)), max(min_length, 1)

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([cleaned(part, stops, shortest) for part in _parts(texts)])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # called so, as a filter on the words would otherwise work them out a second time
    return F.arrow_udf(run, "array<string>").asNondeterministic()(F.lower(F.coalesce(col, F.lit(""))))


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of at most PART bytes, or of one text; one run at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts) or not at:
        to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + PART, "right")))
        yield texts.slice(at, to - at)
        at = to


def cleaned(texts: pa.Array, stop_words: list[str], min_length: int) -> pa.ListArray:
    """Lists of the words of each lower-case text."""
    split = pc.utf8_split_whitespace(texts)
    flat = split.flatten()
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    seen = flat.dictionary_encode()
    bare = pc.replace_substring_regex(seen.dictionary, URL, "")
    codes = seen.indices.to_numpy()

    # a text is a command if the first word that the URLs leave begins with a mark of exclamation
    left = np.flatnonzero(pc.not_equal(bare, "").to_numpy(zero_copy_only=False)[codes])
    calls = pc.starts_with(bare, "!").to_numpy(zero_copy_only=False)
    first = np.searchsorted(left, starts)
    has = first < len(left)
    at = left[np.minimum(first, max(len(left) - 1, 0))] if len(left) else np.zeros(len(starts), np.int64)
    has &= at < starts + sizes
    command = np.zeros(len(starts), bool)
    command[has] = calls[codes[at[has]]]

    words = pc.replace_substring_regex(bare, NOISE, "")
    pairs = [pair for _, parts in fixed.CONTRACTIONS for pair in parts.split()]
    known = pa.concat_arrays([words, pa.array(pairs, words.type)])
    good = pc.and_(pc.greater_equal(pc.utf8_length(known), min_length), pc.invert(pc.is_in(known, pa.array(stop_words, known.type)))).to_numpy(zero_copy_only=False)
    parts = pc.index_in(words, pa.array([word for word, _ in fixed.CONTRACTIONS], words.type))
    whole = parts.is_null().to_numpy(zero_copy_only=False)
    one = np.arange(len(words))
    one[~whole] = len(words) + 2 * parts.drop_null().to_numpy()
    two = np.where(whole, -1, one + 1)  # the second word of a contraction
    one[~good[one]] = -1
    two[~good[two] & (two >= 0)] = -1

    of = np.stack([one[codes], two[codes]], 1) if (two >= 0).any() else one[codes][:, None]
    of[np.repeat(command, sizes)] = -1
    kept = of >= 0
    counts = np.append(0, np.cumsum(kept.sum(1)))
    offsets = counts[np.append(starts, len(codes))]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), known.take(pa.array(of[kept])))
