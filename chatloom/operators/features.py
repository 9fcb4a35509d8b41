"""Hashed counts of the words and word pairs of a text, as a stage of a Spark ML pipeline.

The same places and counts as Spark ML's word splitter, pairs and `HashingTF` (murmur3, seed 42) one after another, but no row is
taken apart into strings: numpy marks the words of many lower-case texts at once and hashes their ranges.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import RegexTokenizer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasNumFeatures, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from chatloom.functions.text import NOT_WORD

SEED = np.uint32(42)
# Bytes of text that are hashed at once; a longer text is taken alone.
BLOCK_BYTES = 1 << 20
VECTOR = pa.struct([
    pa.field("type", pa.int8(), False), pa.field("size", pa.int32()), pa.field("indices", pa.list_(pa.field("element", pa.int32(), False))),
    pa.field("values", pa.list_(pa.field("element", pa.float64(), False))),
])


@lru_cache(maxsize=1)
def word_marks(spark: SparkSession) -> np.ndarray:
    """For every code point whether it is of a word, as Java's patterns see it; eight to a byte."""
    points = spark.range(0x110000).where("id < 55296 or id > 57343")
    letter = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    found = points.where(~letter.rlike(NOT_WORD)).toArrow()["id"].to_numpy()
    marks = np.zeros(0x110000, bool)
    marks[found] = True
    return np.packbits(marks)


def word_bytes(data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For every byte of UTF-8 text whether its character is of a word."""
    word = marks[:256][data]
    high = np.flatnonzero(data >= 0xC0)  # first bytes of longer characters
    if len(high):
        first = data[high].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | data[high[more] + k] & 0x3F
        found = marks[point]
        for k in range(4):
            more = size > k
            word[high[more] + k] = found[more]
    return word


def _mixed(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(0xCC9E2D51)
    return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)


def murmur3(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Signed 32-bit hashes of the ranges of `data`, which has four bytes to spare behind the last one."""
    quads = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))  # the four bytes from every place on
    h = np.full(len(starts), SEED, np.uint32)
    blocks, going, k = sizes >> 2, np.flatnonzero(sizes >= 4), 0
    while len(going):
        x = h[going] ^ _mixed(quads[starts[going] + 4 * k])
        h[going] = (x << np.uint32(13) | x >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
        k += 1
        going = going[blocks[going] > k]
    rest = ((np.uint64(1) << (8 * (sizes & 3)).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    h ^= _mixed(quads[starts + 4 * blocks] & rest)
    h ^= sizes.astype(np.uint32)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h.view(np.int32)


def counted(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text (bytes `offsets[i]` to `offsets[i + 1]`) how many places it has; the places in ascending order, and their counts."""
    texts, ends_at = len(offsets) - 1, offsets[1:] - offsets[0]
    data = data[offsets[0] : offsets[-1]]
    word = word_bytes(data, marks)
    # of the bytes between two words the first stays, as a blank; texts stand side by side: a word that runs over the end of one is two
    before = np.concatenate([[False], word[:-1]])
    cuts = ends_at[:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    kept = np.flatnonzero(word | before)
    held = np.zeros(len(kept) + 4, np.uint8)
    held[:-4] = np.where(word[kept], data[kept], 32)
    word = np.concatenate([[False], word[kept], [False]])
    begins = np.flatnonzero(word[1:] & ~word[:-1])
    ends = np.flatnonzero(word[:-1] & ~word[1:])
    until = np.searchsorted(kept, ends_at)  # the texts' ends among the bytes that stay
    cuts = np.unique(np.searchsorted(kept, cuts))
    cuts = cuts[word[cuts] & word[cuts + 1]]
    begins, ends = np.sort(np.concatenate([begins, cuts])), np.sort(np.concatenate([ends, cuts]))
    owner = np.searchsorted(until, begins, "right")
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    starts = np.concatenate([begins, begins[pair]])
    sizes = np.concatenate([ends, ends[pair + 1]]) - starts
    place = murmur3(held, starts, sizes).astype(np.int64) % features
    place[len(begins) :] += features
    keys, counts = np.unique(np.concatenate([owner, owner[pair]]) * (2 * features) + place, return_counts=True)
    return np.bincount(keys // (2 * features), minlength=texts), keys % (2 * features), counts


def blocks_of(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together, or of one text."""
    found, a = [], 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        found.append((a, b))
        a = b
    return found


def vectors(texts: pa.Array, marks: np.ndarray, features: int, most: int | None = None) -> pa.Array:
    """Lower-case texts as sparse vectors; a null text has no words."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    none = np.zeros(0, np.int64)
    parts = [counted(data, offsets[a : b + 1], marks, features) for a, b in blocks_of(offsets, most or BLOCK_BYTES)]
    sizes, indices, counts = (np.concatenate([none, *x]) for x in zip(*parts)) if parts else (none, none, none)
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    n = len(texts)
    return pa.StructArray.from_arrays([
        pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, 2 * features, np.int32)),
        pa.ListArray.from_arrays(ends, pa.array(indices.astype(np.int32)), type=VECTOR.field("indices").type),
        pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.float64)), type=VECTOR.field("values").type),
    ], fields=list(VECTOR))


class HashedWords(Transformer, HasInputCol, HasOutputCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """Counts of words at the places 0 to numFeatures, of word pairs behind them."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, numFeatures: int = 1 << 16):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, packed = self.getNumFeatures(), word_marks(dataset.sparkSession)

        @F.arrow_udf(returnType=VectorUDT())
        def hashed(texts: pa.Array) -> pa.Array:
            return vectors(texts, np.unpackbits(packed).view(bool), features)

        # The splitter with the whole text as its only word: SQL's `lower` has another rule for the last sigma of a word.
        whole = RegexTokenizer(inputCol=self.getInputCol(), outputCol="_whole", pattern="(?s).+", gaps=False, minTokenLength=1)
        return whole.transform(dataset).withColumn(self.getOutputCol(), hashed(F.get("_whole", 0))).drop("_whole")
