"""Alignment of two tokenizers over the same bytes, in Arrow.

The ids of many texts lie in one flat list; its parents say which text each is in, and a cumulative sum of token lengths that
starts anew with every text gives the byte where each token ends. A join of both sides on (text, end) leaves one row for every
byte at which a token ends; a row is the overlap of one token of each side, and where both sides are present both end. Counts of
linked ids are taken per text and per chunk of texts by grouping, merged by Spark, and brought back to the chunks that need them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from chatloom.llm.bpe import BytePairs, byte_letters
from chatloom.llm.common import Query, hand_back, slices, table
from chatloom.session import materialise

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Bytes of text aligned at a time; a longer text is encoded in pieces of about this many characters.
STEP_BYTES = 1_000_000
# Different (text, pair) rows after which a chunk is closed.
CHUNK_ROWS = 1_000_000
# Words beyond this many bytes take the encoder whose time grows in proportion to the word.
LONG_RUN = 1_000
# Where a text may be cut without changing a token of either side: a single space between two plain letters.
CUT = regex.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
SEPARATORS = ",|;"


class Sides:
    """Both vocabularies: encoding, and the bytes of every id."""

    def __init__(self, byte_path: str, piece_path: str):
        with open(byte_path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        of = {c: b for b, c in enumerate(byte_letters())}
        tokens = {t: i for t, i in vocab.items() if all(c in of for c in t)}
        first = [b""] * (max(vocab.values()) + 1)
        for token, i in tokens.items():
            first[i] = bytes(of[c] for c in token)
        special = {i for t, i in vocab.items() if t.startswith("<|") and t.endswith("|>")}
        ranks = {first[i]: i for i in tokens.values() if i not in special}
        self.quick = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.steady = BytePairs(byte_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        second = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            second.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes = pa.array(first, pa.large_binary()), pa.array(second, pa.large_binary())
        self.lengths = tuple(pc.binary_length(b).cast(pa.int64()) for b in self.bytes)
        ids = range(max(len(first), len(second)))
        self.decimals = pa.array([f"{i}{s}" for i in ids for s in SEPARATORS], pa.large_string())

    def first_ids(self, text: str, long: bool) -> list[int]:
        return np.frombuffer(self.steady.encode([text])[0], "<u4").tolist() if long else self.quick.encode_ordinary(text)

    def second_ids(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1) if texts else []


@lru_cache(maxsize=2)
def sides(byte_path: str, piece_path: str) -> Sides:
    return Sides(byte_path, piece_path)


def pieces_of(text: str, size: int = STEP_BYTES) -> list[str]:
    """A long text in pieces that encode as they do inside the text; the space between two of them belongs to the second."""
    out, at = [], 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def longest_run(data: np.ndarray) -> int:
    """Bytes of the longest run with or without white space."""
    edges = np.flatnonzero(np.diff(data <= 32, prepend=False, append=False))
    return int(np.diff(edges, prepend=0, append=len(data)).max(initial=0))


def lists(ids: list[list[int]], parents: list[int], n: int) -> pa.LargeListArray:
    """Ids of pieces as one list for each of n texts."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.array(i, np.int32) for i in ids]) if ids else np.zeros(0, np.int32)
    ends = np.cumsum(np.bincount(np.array(parents, np.int64), lengths, n).astype(np.int64))
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(flat))


def segmented_ends(ids: pa.LargeListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Flat ids, the text of each, and the byte of the text at which it ends."""
    flat, parents = pc.list_flatten(ids), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(lengths.take(flat))
    before = pc.fill_null(pa.concat_arrays([pa.array([0], pa.int64()), total]).take(ids.offsets[:-1]), 0)
    return flat, parents, pc.subtract(total, before.take(parents))


def same_bytes(ids: pa.LargeListArray, of: pa.Array, lengths: pa.Array, want: list[bytes]) -> np.ndarray:
    """For each text, whether its tokens' bytes joined are those of the text."""
    offsets = ids.offsets.to_numpy()
    total = np.concatenate([[0], np.cumsum(lengths.take(ids.values).to_numpy())])
    at = total[offsets]
    sizes = np.fromiter(map(len, want), np.int64, len(want))
    good = np.diff(at) == sizes
    joined = of.take(ids.values).buffers()[2]
    data = joined.to_pybytes()[: int(at[-1])] if joined is not None else b""
    if good.all() and data == b"".join(want):
        return good
    return np.array([bool(g) and data[a:b] == w for g, a, b, w in zip(good, at[:-1], at[1:], want)], bool)


DOC_BITS = 40  # of a key: bytes of a text below, number of the text in its step above


class Aligned:
    """The overlaps of some texts: a row for each byte where a token ends, in order."""

    def __init__(self, both: Sides, texts: list[str | None]):
        n = len(texts)
        spaced, owner = [], []
        for i, text in enumerate(texts):
            found = pieces_of(text) if text else []
            spaced += found
            owner += [i] * len(found)
        want = [(" " + t).encode() if t else b"" for t in texts]
        long = longest_run(np.frombuffer(b"".join(want), np.uint8)) > LONG_RUN
        runs = [long and longest_run(np.frombuffer((" " + p).encode(), np.uint8)) > LONG_RUN for p in spaced]
        first = lists([both.first_ids(" " + p, r) for p, r in zip(spaced, runs)], owner, n)
        second = lists(both.second_ids(spaced), owner, n)
        good = same_bytes(first, both.bytes[0], both.lengths[0], want) & same_bytes(second, both.bytes[1], both.lengths[1], want)
        if not good.all():
            first, second = (pc.if_else(pa.array(good), x, pa.scalar([], x.type)) for x in (first, second))
        ends = []
        for name, ids, lengths in (("a", first, both.lengths[0]), ("b", second, both.lengths[1])):
            flat, parents, end = segmented_ends(ids, lengths)
            key = pc.add(pc.shift_left(parents.cast(pa.int64()), pa.scalar(DOC_BITS, pa.int64())), end)
            ends.append(pa.table({"key": key, f"{name}_at": pa.array(np.arange(len(flat))), name: flat}))
        rows = ends[0].join(ends[1], "key", join_type="full outer", use_threads=False).combine_chunks().sort_by("key")
        self.n = n
        self.doc = pc.shift_right(rows["key"], pa.scalar(DOC_BITS, pa.int64())).to_numpy()
        self.ends = [pc.is_valid(rows[f"{s}_at"]).to_numpy() for s in "ab"]
        # the token that covers a row is the next one of its side that ends
        self.ids = [pc.fill_null_backward(rows[s]).to_numpy().astype(np.int64) for s in "ab"]
        self.tokens = [np.bincount(self.doc[e], minlength=n) for e in self.ends]
        self.links = np.bincount(self.doc, minlength=n)
        self.common = self.ends[0] & self.ends[1]
        self.groups = np.bincount(self.doc[self.common], minlength=n)

    def groups_text(self, both: Sides) -> list[memoryview]:
        """The groups of each text in decimal: first ids `,` between them, `|`, second ids, `;` between groups."""
        group = np.cumsum(self.common) - self.common
        own = [group[e] for e in self.ends]
        codes = [ids[e] * len(SEPARATORS) for ids, e in zip(self.ids, self.ends)]
        last = [np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in own]
        for code, closed, mark in zip(codes, last, (1, 2)):
            code += mark * closed
        size = int(self.groups.sum())
        sizes = [np.bincount(g, minlength=size) for g in own]
        ends = [np.cumsum(s) for s in sizes]
        placed = np.empty(len(own[0]) + len(own[1]), np.int64)
        placed[np.arange(len(own[0])) + (ends[1] - sizes[1])[own[0]]] = codes[0]
        placed[np.arange(len(own[1])) + ends[0][own[1]]] = codes[1]
        text = both.decimals.take(pa.array(placed))
        offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(placed) + 1] if len(placed) else np.zeros(1, np.int64)
        data = memoryview(text.buffers()[2]) if len(placed) else memoryview(b"")
        at = offsets[np.concatenate([[0], np.cumsum(self.tokens[0] + self.tokens[1])])]
        return [data[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, pairs of linked ids and how many links each has in the text; ordered by text."""
        pair = (self.ids[0] << 32) | self.ids[1]
        found = pa.table({"doc": self.doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        doc, pair, n = (found[c].to_numpy() for c in ("doc", "pair", "count_all"))
        order = np.argsort(doc, kind="stable")
        return doc[order], pair[order], n[order]


PAIR_FIELDS = (("chunk", T.LongType()), ("total", T.BooleanType()), ("pairs", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType())))
COUNT_FIELDS = ("n_a", "n_b", "n_groups", "n_links")


def _long_lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64)))


def aligned(docs: DataFrame, text_col: str, groups: str, digest: bool, byte_path: str, piece_path: str) -> DataFrame:
    """`docs` without `text_col`, with counts, groups and the linked pairs of each text, and a row of totals for each chunk.

    A chunk is a run of texts of one task with about CHUNK_ROWS different (text, pair) rows.
    """
    others = [i for i, c in enumerate(docs.columns) if c != text_col]
    kept = [f for f in docs.schema.fields if f.name != text_col]
    counts = [T.StructField(c, T.LongType()) for c in COUNT_FIELDS]
    fields = [*(T.StructField(f.name, f.dataType) for f in kept), *counts, T.StructField(groups, T.StringType())]
    schema = T.StructType([*fields, *(T.StructField(f"_{n}", k) for n, k in PAIR_FIELDS)])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(byte_path, piece_path)
        chunk, held, parts = TaskContext.get().partitionId() << 32, 0, []
        arrow = None

        def totals() -> pa.RecordBatch:
            found = pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("n", "sum")])
            pairs, n = found["pair"].to_numpy(), found["n_sum"].to_numpy()
            ends = np.array([0, len(pairs)])
            made = {"_chunk": pa.array([chunk]), "_total": pa.array([True]), "_pairs": _long_lists(ends, pairs), "_times": _long_lists(ends, n)}
            return pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(1, f.type)) for f in arrow], schema=arrow)

        for batch in batches:
            for part in slices(batch, at, STEP_BYTES):
                found = Aligned(both, part.column(at).to_pylist())
                texts = found.groups_text(both)
                if digest:
                    texts = [hashlib.sha256(t).hexdigest() if len(t) else "" for t in texts]
                else:
                    texts = [str(t, "ascii") for t in texts]
                doc, pair, n = found.pairs()
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=found.n))])
                rows = found.n
                own = [part.column(i) for i in others]
                counted = [pa.array(x.astype(np.int64)) for x in (*found.tokens, found.groups, found.links)]
                made = [pa.array(np.full(rows, chunk)), pa.array(np.zeros(rows, bool)), _long_lists(ends, pair), _long_lists(ends, n)]
                out = pa.RecordBatch.from_arrays([*own, *counted, pa.array(texts, pa.string()), *made], names=schema.names)
                arrow = out.schema
                yield out
                parts.append(pa.table({"pair": pair, "n": n.astype(np.int64)}).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"]))
                held += len(pair)
                if held >= CHUNK_ROWS:
                    yield totals()
                    chunk, held, parts = chunk + 1, 0, []
        if parts:
            yield totals()
        hand_back()

    return docs.mapInArrow(run, schema)


def pair_counts(totals: DataFrame) -> DataFrame:
    """How many links each pair of ids has over all texts, and whether no pair with the same second id has more."""
    counts = materialise(totals.groupBy("_pair").agg(F.sum("_n").alias("_count")), "align-counts")
    second = F.col("_pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(second.alias("_second")).agg(F.max("_count").alias("_most"))
    return counts.join(most, second == F.col("_second")).select("_pair", "_count", (F.col("_count") == F.col("_most")).alias("_best"))


def align(
    docs: DataFrame, text_col: str = "text", groups: str = "groups", digest: bool = False, byte_path: str | None = None, piece_path: str | None = None
) -> DataFrame:
    """`docs` without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum and the groups of both tokenizers' ids.

    The groups are text (`a1,a2|b1;a3|b2,b3`) or, with `digest`, their SHA-256. Null and empty texts, and texts that one side
    doesn't give back byte by byte, have zeros and no groups. Rows stay rows: repeated ids and texts each count. Columns
    that are made replace others of these names; other names may clash with nothing made inside. An empty table gives an empty table.
    """
    made = {*COUNT_FIELDS, "n_best", "count_sum", groups}
    columns = [c for c in docs.columns if c not in made and c != text_col]
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in columns]
    rows = docs.select(F.struct(*quoted, F.lit(0).alias("_none")).alias("_row"), F.col(text_col).alias("_text"))
    found = aligned(
        rows, "_text", groups, digest, byte_path or public_tokenizers.path(BYTE_VOCABULARY), piece_path or public_tokenizers.path(PIECE_VOCABULARY)
    )
    found = materialise(found, "align-links")
    totals = found.where("_total").select("_chunk", F.explode(F.arrays_zip("_pairs", "_times")).alias("_z"))
    totals = totals.select("_chunk", F.col("_z._pairs").alias("_pair"), F.col("_z._times").alias("_n"))
    known = totals.join(materialise(pair_counts(totals), "align-best"), "_pair").select(F.col("_chunk").alias("_of"), "_pair", "_count", "_best")
    texts = found.where(~F.col("_total")).drop("_total")
    own = [f for f in texts.schema.fields if f.name not in ("_chunk", "_pairs", "_times")]
    schema = T.StructType([*own, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = right["_pair"].to_numpy()
        order = np.argsort(pairs)
        pairs, counts, best = pairs[order], right["_count"].to_numpy()[order], right["_best"].to_numpy()[order]
        lists_ = left["_pairs"].combine_chunks()
        times = left["_times"].combine_chunks().flatten().to_numpy()
        at = np.searchsorted(pairs, lists_.flatten().to_numpy())
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists_).to_numpy())])
        out = left.select([f.name for f in own])
        for name, value in (("n_best", best), ("count_sum", counts)):
            total = np.concatenate([[0], np.cumsum(times * value[at].astype(np.int64) if len(at) else times)])
            out = out.append_column(name, pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
        return out

    out = texts.groupBy("_chunk").cogroup(known.groupBy("_of")).applyInArrow(looked_up, schema)
    restored = [F.col("_row.`" + c.replace("`", "``") + "`").alias(c) for c in columns]
    return out.select(*restored, *COUNT_FIELDS, "n_best", "count_sum", groups)


def op12_arrow_join(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = align(docs, "text", "groups_sha256", digest=True)
    return out.select("doc_id", *COUNT_FIELDS, "n_best", "count_sum", "groups_sha256")


QUERIES = {"op12_arrow_join": Query(op12_arrow_join)}
