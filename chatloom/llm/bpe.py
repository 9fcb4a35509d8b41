"""Byte-level BPE in numpy: the symbols of many words lie in one flat array and are merged in rounds.

In each round every word merges its pair of lowest rank; pairs are looked up by binary search over the sorted pair keys.
A merge never makes a pair of lower rank than its own, so merging all places of the lowest pair at once is the same as
merging them one by one. Words are remembered in each Python worker, in a table of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from chatloom.llm.common import Query, table, with_columns

VOCABULARY = "byte_bpe_50k.json"
# Words remembered by a worker before it starts anew.
REMEMBERED = 350_000
# The public word pattern of this kind of vocabulary, white space spelt out as the Unicode property.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable Latin-1, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}
    return [letters[b] for b in range(256)]


class BytePairs:
    """A vocabulary file: encoding of whole texts and its reverse."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        listed = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, listed))) if listed else None
        self.known: dict[str, bytes] = {}

    def merge(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        never = len(self.ranks)
        rank = np.full(len(symbols), never, np.int64)
        fresh = np.arange(len(symbols))  # where the pair with the next symbol is new
        while len(symbols):
            fresh = fresh[fresh < len(symbols) - 1]
            key = symbols[fresh] << 32 | symbols[fresh + 1]
            at = np.minimum(np.searchsorted(self.keys, key), never - 1)
            rank[fresh] = np.where((self.keys[at] == key) & (owner[fresh] == owner[fresh + 1]), self.ranks[at], never)
            rank[-1] = never
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(rank, first)
            own = np.repeat(lowest, np.diff(first, append=len(owner)))
            ready = own == never
            if ready.any():
                done.append((owner[ready], symbols[ready]))
            places = np.flatnonzero((rank == own) & ~ready)
            if not len(places):
                break
            # In a run of one symbol the pairs overlap: from the left, every other one is merged.
            new_run = np.diff(places, prepend=-2) != 1
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))
            places = places[(places - places[start]) % 2 == 0]
            symbols[places] = self.merged[rank[places]]
            keep = ~ready
            keep[places + 1] = False
            moved = np.cumsum(keep) - 1
            fresh = moved[places]
            fresh = np.unique(np.concatenate([fresh, fresh[fresh > 0] - 1]))
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        if not done:
            return [b""] * len(words)
        owners, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owners, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(owners, minlength=len(words)))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _parts(self, text: str) -> list[str]:
        """Words of a text; special tokens stand between as words of their own."""
        if self.cut is None or not self.cut.search(text):
            return PATTERN.findall(text)
        parts, last = [], 0
        for m in self.cut.finditer(text):
            parts += PATTERN.findall(text[last : m.start()])
            parts.append(m.group())
            last = m.end()
        return parts + PATTERN.findall(text[last:])

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text; null has none."""
        split = [self._parts(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if not self.known:
            self.known.update((t, i.to_bytes(4, "little")) for t, i in self.special.items())
        found = [list(map(self.known.get, parts)) for parts in split]
        open_rows = [i for i, ids in enumerate(found) if None in ids]
        fresh = list({w for i in open_rows for w, ids in zip(split[i], found[i]) if ids is None})
        if fresh:
            self.known.update(zip(fresh, self.merge([w.encode() for w in fresh])))
        for i in open_rows:
            found[i] = map(self.known.__getitem__, split[i])
        return [b"".join(ids) for ids in found]

    def decode(self, ids: bytes | None) -> str:
        """Text of ids; what isn't UTF-8 becomes U+FFFD."""
        numbers = np.frombuffer(ids or b"", "<u4").tolist()
        return b"".join(map(self.pieces.__getitem__, numbers)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> BytePairs:
    """One per worker and file."""
    return BytePairs(path)


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """`docs` with the ids of each whole text as binary, little-endian unsigned 32-bit.

    Null and empty texts have no ids. `path` is a vocabulary file that every worker can read. Rows stay where they are; a
    column named `out` is replaced.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        words = vocabulary(path)
        return lambda texts: [pa.array(words.encode(texts.to_pylist()), pa.binary())]

    return with_columns(docs.drop(out) if out != text_col else docs, [text_col], [(out, "binary")], make)


def decode(docs: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """`docs` with the text of the ids; null ids give an empty text. A column named `out` is replaced."""
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        words = vocabulary(path)
        return lambda ids: [pa.array([words.decode(i.as_py()) for i in ids], pa.string())]

    return with_columns(docs.drop(out), [ids_col], [(out, "string")], make)


def round_trip(
    docs: DataFrame, text_col: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None
) -> DataFrame:
    """`encode` and `decode` in one pass: `docs` with the ids of each text and the text that these ids give."""
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        words = vocabulary(path)

        def work(texts):
            found = words.encode(texts.to_pylist())
            return [pa.array(found, pa.binary()), pa.array([words.decode(i) for i in found], pa.string())]

        return work

    return with_columns(docs.drop(*({ids, decoded} - {text_col})), [text_col], [(ids, "binary"), (decoded, "string")], make)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded texts of all rows as digests."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return round_trip(rows, "_text", "_ids", "_decoded").select(
        "doc_id", (F.octet_length("_ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op6_bpe": Query(op6_bpe)}
