"""Compression of vectors to codes: a codebook for each part of the dimensions, trained and applied over a trie of parts.

Components are whole numbers (floor of SCALE times the value). Each task puts the distinct parts of its rows in lexicographic
order, which is a trie: a node is a common prefix of dimensions. The trie is walked depth first; a node adds its own dimension
to the distances that its parent accumulated to every entry, so parts with a common prefix share that work, and a leaf takes
the nearest entry and adds its weight and weighted components to the entry's sums. Only these sums leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chatloom.llm.common import Query, hand_back, table
from chatloom.session import materialise

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Whole components stay below this, so that distances summed over a vector stay below 2 ** 63.
GREATEST = 1 << 27
# Sibling nodes walked together, and numbers of a batch held at once.
NODES = 512
NUMBERS = 1 << 21


def finite(vector: Column) -> Column:
    """Whether a vector is there and has only finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad), F.lit(False))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component; SCALE is a power of two, so the product is exact."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= GREATEST:
        raise ValueError(f"components must lie within {GREATEST // SCALE} of zero")
    return scaled.astype(np.int64)


@dataclass(frozen=True)
class Trie:
    """Distinct parts in lexicographic order; `starts[j]` are the first rows of the nodes of j + 1 dimensions."""

    parts: np.ndarray
    weight: np.ndarray
    inverse: np.ndarray
    starts: list[np.ndarray]


def trie_of(parts: np.ndarray) -> Trie:
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    # a row starts a node wherever one of the node's dimensions changes
    changed = np.ones((len(parts), parts.shape[1]), bool)
    changed[1:] = np.logical_or.accumulate(ordered[1:] != ordered[:-1], axis=1)
    first = np.flatnonzero(changed[:, -1])
    inverse = np.empty(len(parts), np.int64)
    inverse[order] = np.cumsum(changed[:, -1]) - 1
    weight = np.diff(np.append(first, len(parts)))
    return Trie(ordered[first], weight, inverse, [np.flatnonzero(changed[first, j]) for j in range(parts.shape[1])])


def nearest(trie: Trie, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each distinct part, of equal ones the first, and the squared distance."""
    n, dims = trie.parts.shape
    index, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def walk(level: int, low: int, high: int, above: np.ndarray, parent: int) -> None:
        """Nodes low to high of a level. `above` holds the distances of their parents, from node `parent` on."""
        starts = trie.starts[level]
        for at in range(low, high, NODES):
            to = min(at + NODES, high)
            rows = starts[at:to]
            owner = np.searchsorted(trie.starts[level - 1], rows, "right") - 1 - parent if level else np.zeros(to - at, np.int64)
            here = above[owner] + (trie.parts[rows, level, None] - book[:, level]) ** 2
            if level == dims - 1:
                index[rows] = here.argmin(1)
                distance[rows] = here.min(1)
            else:
                end = starts[to] if to < len(starts) else n
                walk(level + 1, *np.searchsorted(trie.starts[level + 1], [starts[at], end]), here, at)

    if n:
        walk(0, 0, len(trie.starts[0]), np.zeros((1, len(book)), np.int64), 0)
    return index, distance


def entry_sums(trie: Trie, index: np.ndarray, entries: int) -> np.ndarray:
    """For each entry the weights and the weighted components of its parts, as whole numbers."""
    out = np.zeros((entries, 1 + trie.parts.shape[1]), np.int64)
    order = np.argsort(index, kind="stable")
    used, at = np.unique(index[order], return_index=True)
    if len(used):
        weighted = np.column_stack([trie.weight, trie.weight[:, None] * trie.parts])
        out[used] = np.add.reduceat(weighted[order], at)
    return out


def _matrices(batch: pa.RecordBatch, column: int, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """The whole vectors of a batch, some rows at a time, each with the number of its first row."""
    step = max(1, NUMBERS // dims)
    for at in range(0, batch.num_rows, step):
        values = batch.column(column).slice(at, step).flatten()
        yield at, whole(values.to_numpy(zero_copy_only=False)).reshape(-1, dims)


def kept_vectors(vectors: DataFrame, vector_col: str, dims: int) -> DataFrame:
    return vectors.where(finite(F.col(vector_col)) & (F.size(vector_col) == dims))


def first_entries(vectors: DataFrame, id_col: str, vector_col: str, parts: int, entries: int) -> np.ndarray | None:
    """The vectors of the least ids in ascending order, equal ids by components; None if there are none.

    The ids are found first, so that vectors beyond them are not read for it. The least id's vector says how many dimensions all
    have; a vector of another length has no place in the codebooks.
    """
    vector = F.col(vector_col)
    fit = vectors.where(finite(vector) & (F.size(vector) > 0) & (F.size(vector) % parts == 0)).where(F.col(id_col).isNotNull())
    size = F.size(vector).alias("_size")
    least = fit.select(id_col, size).orderBy(id_col, "_size").limit(1).collect()
    if not least:
        return None
    fit = fit.where(F.size(vector) == least[0]["_size"])
    ids = fit.select(id_col).orderBy(id_col).limit(entries).collect()
    first = fit.where(F.col(id_col) <= ids[-1][0]).select(id_col, vector.alias("_v")).orderBy(id_col, "_v").limit(entries).collect()
    return whole(np.array([r["_v"] for r in first], float))


def trained_books(vectors: DataFrame, id_col: str, vector_col: str, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """A codebook of whole numbers for each part position; no books without vectors."""
    first = first_entries(vectors.select(id_col, vector_col), id_col, vector_col, parts, entries)
    if first is None:
        return []
    dims = first.shape[1]
    width = dims // parts
    books = [first[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    rows = kept_vectors(vectors.select(F.col(vector_col).alias("_v")), "_v", dims)

    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, len(books[0]), 1 + width), np.int64)
            for batch in batches:
                for _, found in _matrices(batch, 0, dims):
                    for p, book in enumerate(books):
                        trie = trie_of(found[:, p * width : (p + 1) * width])
                        total[p] += entry_sums(trie, nearest(trie, book)[0], len(book))
            part, entry, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(total[part, entry, place])],
                names=["part", "entry", "place", "value"],
            )
            hand_back()

        sums = rows.mapInArrow(run, "part int, entry int, place int, value long")
        total = np.zeros((parts, len(books[0]), 1 + width), np.int64)
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect():
            total[r["part"], r["entry"], r["place"]] = r["value"]
        n = total[:, :, :1]
        books = [np.where(n[p] > 0, total[p, :, 1:] // np.maximum(n[p], 1), book) for p, book in enumerate(books)]
    return books


def with_codes(vectors: DataFrame, books: list[np.ndarray], vector_col: str, code: str = "code", error: str = "error") -> DataFrame:
    """The rows with a finite vector of the books' dimensions, with their codes (two hex digits a part) and squared distances."""
    parts = len(books)
    width = books[0].shape[1] if books else 0
    rows = kept_vectors(vectors, vector_col, parts * width)
    at = rows.columns.index(vector_col)
    digits = np.array([f"{i:02x}" for i in range(256)], "S2")
    names = [*rows.columns, code, error]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, found in _matrices(batch, at, parts * width):
                text, total = np.empty((len(found), parts), "S2"), np.zeros(len(found), np.int64)
                for p, book in enumerate(books):
                    trie = trie_of(found[:, p * width : (p + 1) * width])
                    index, distance = nearest(trie, book)
                    text[:, p] = digits[index][trie.inverse]
                    total += distance[trie.inverse]
                codes = pa.array(text.view(f"S{2 * parts}")[:, 0].astype(str), pa.string())
                part = batch.slice(low, len(found))
                yield pa.RecordBatch.from_arrays([*part.columns, codes, pa.array(total)], names=names)
        hand_back()

    return rows.mapInArrow(run, rows.select("*", F.lit("").alias(code), F.lit(0).cast("long").alias(error)).schema)


def books_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(x)) for book in books for x in book.ravel())


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """`id_col`, code, error, label_error and codebooks_sha256 of every vector that is there and finite.

    Null ids have codes but are no first entries; of repeated ids each row counts; equal ids are ordered by components. With
    fewer vectors than entries the books are shorter. A vector whose length differs from that of the least id's vector (or that
    can't be cut into `parts`) is left out as a null one is. Rows without a label are one label. An empty table gives an empty
    table; other columns are not read. Codes need at most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes of two hex digits need 1 to 256 entries")
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_v"))
    books = trained_books(rows, "_id", "_v", parts, entries, rounds)
    if books:
        coded = with_codes(rows, books, "_v", "code", "error").select("_id", "_label", "code", "error")
    else:
        coded = rows.limit(0).select("_id", "_label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    coded = materialise(coded, "codes")
    sums = materialise(coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error")), "code-errors")
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return coded.join(sums, F.col("_label").eqNullSafe(F.col("_of"))).select(
        F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def op13_trie_codes(spark, sf_dir: str) -> DataFrame:
    """All embeddings."""
    return compress(table(spark, sf_dir, "embeddings"))


def _assigned(books: str) -> str:
    """Nearest entry of each part: the least pair of distance and entry over all entries."""
    distance = "list_sum(list_transform(list_zip(x.part, y.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return (
        f"SELECT vec, p, any_value(part) AS part, min(pair)[1] AS d, min(pair)[2] AS e FROM (SELECT x.vec, x.p, x.part, "
        f"[CAST({distance} AS BIGINT), y.e] AS pair FROM parts x JOIN {books} y ON x.p = y.p) GROUP BY vec, p"
    )


def _means(assigned: str, books: str) -> str:
    return (
        f"SELECT b.p, b.e, coalesce(m.part, b.part) AS part FROM {books} b LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS part FROM (SELECT p, e, i, "
        f"CAST(floor(sum(v)::DOUBLE / count(*)) AS BIGINT) AS v FROM (SELECT p, e, unnest(part) AS v, generate_subscripts(part, 1) AS i FROM {assigned}) "
        "GROUP BY p, e, i) GROUP BY p, e) m ON b.p = m.p AND b.e = m.e"
    )


SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS vec, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS part FROM kept, range({PARTS}) AS r(p)
), b0 AS MATERIALIZED (SELECT p, vec AS e, part FROM parts WHERE vec < {ENTRIES}),
a0 AS MATERIALIZED ({_assigned("b0")}),
b1 AS MATERIALIZED ({_means("a0", "b0")}),
a1 AS MATERIALIZED ({_assigned("b1")}),
b2 AS MATERIALIZED ({_means("a1", "b1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
coded AS (
  SELECT vec, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec
), digest AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(part) AS v, generate_subscripts(part, 1) AS i FROM b2)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (vec) CROSS JOIN digest
"""

QUERIES = {"op13_trie_codes": Query(op13_trie_codes, SQL)}
