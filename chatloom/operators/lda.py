"""Latent Dirichlet allocation by variational updates, the words of the model in a table.

A corpus is kept in chunks: runs of documents with their own short list of distinct words, so a document is a list of places in
that list with counts. The model is a table of one row per word with a weight for each topic. An update joins the chunks' word lists with
that table (both lie bucketed by word and don't move), brings the weights to their chunks (whose documents lie in a table bucketed by chunk and
don't move), infers the documents of a chunk in numpy, and adds up what each word saw by bucket. So an update moves, for each
chunk and word of it, the weights there and the sums back; chunks are large, as a word that many documents share then travels once for all of them.
What moves is packed: a row holds the words that a chunk and a bucket share, their numbers as compressed bytes, so Spark handles a row for
hundreds of words and not one for each. Nothing of the size of the dictionary or of the corpus is held by the driver or by one task: the
driver sees sums over all words, a number for each topic.

Sums travel as whole numbers of 2 ** -PRECISION, rounded per document and word, so the model is the same for any layout. The words' expected
weights travel with 24 bits, sixteen times finer than that; the model itself is kept in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chatloom.operators import dictionary as words
from chatloom.session import materialise, scratch_dir

# Different (document, word) cells after which a chunk is closed: 8 bytes each in the task that infers it.
CHUNK_CELLS = 4_000_000
# Tokens that are counted, and cells that are inferred together.
BLOCK_CELLS = 100_000
# Rows of the chunks' word lists that share a bucket.
BUCKET_ROWS = 200_000
# Buckets for each chunk: chunks are dealt by hash, and few should meet in a task.
CHUNK_BUCKETS = 4
# Words on their way that a task packs or adds up together.
PACKED = 1_000_000
# Widths of documents that are inferred together, for each doubling.
WIDTHS = 4
PRECISION = 20
# Rounds of inference for a document at most, and the mean change of its weights that ends them.
ROUNDS = 50
TOLERANCE = 1e-3
DECAY = 0.51
# Rows beside those of the words: the documents' topic shares, and what the words of a bucket saw in all.
SHARES, TOTAL = -1, -2
# Words whose first weights are drawn together.
DRAWN = 4096
DRAW = 2  # column of a document's draw, behind key and tokens


# --- the corpus -------------------------------------------------------------------


@dataclass
class Corpus:
    """`docs`: (chunk, at, key, draw, sizes, places, counts), a row for a block of documents, bucketed by chunk; `listed`: (word_id, chunks), in
    `buckets` by word; `dictionary`: (token, word_id, …). A chunk's places count its words in the order of their numbers."""

    docs: DataFrame
    listed: DataFrame
    dictionary: DataFrame
    n_docs: int
    n_words: int
    buckets: int
    tables: list[str]

    def by_word(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """`df` written in the buckets of the word lists, and the folder of its files."""
        table, path = bucketed(df, "word_id", self.buckets, name)
        self.tables.append(table)
        return df.sparkSession.table(table), path

    def drop(self) -> None:
        """Forget the bucketed tables' names; their files stay in the shared folder like all written tables."""
        for table in self.tables:
            self.docs.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()


def bucketed(df: DataFrame, by: str, buckets: int, name: str) -> tuple[str, str]:
    """Name and folder of a table of `df`, whose rows lie together by the column `by` in as many parts, in `buckets`."""
    table, path = f"chatloom_lda_{uuid.uuid4().hex}", scratch_dir(df.sparkSession, name)
    df.write.bucketBy(buckets, by).format("parquet").option("path", path).saveAsTable(table)
    return table, path


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the first bytes of all, then the second ones, compressed."""
    x = np.ascontiguousarray(x)
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(packed, n * size, codec="zstd"), np.uint8)
    return flat.reshape(size, n).T.flatten().view(dtype)


def _steps(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each number less the one before it; those at `starts` stay."""
    out = np.diff(x, prepend=x.dtype.type(0))
    out[starts] = x[starts]
    return out


def _summed_steps(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of runs of `sizes` whose `_steps` are given."""
    out, starts = np.cumsum(steps, dtype=np.int64), np.cumsum(sizes) - sizes
    return out - np.repeat(out[starts] - steps[starts], sizes)


def _cells(batch: pa.RecordBatch, key: int, tokens: int) -> tuple[list[pa.Array], np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Keys and draws, ends, words and counts of the documents with a token: each document's distinct words in alphabetical order."""
    lists = batch.column(tokens)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    given = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    encoded = flat.filter(pa.array(given)).dictionary_encode()
    order = pc.array_sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    cell = parents[given].astype(np.int64) * max(len(order), 1) + rank[encoded.indices.to_numpy()]
    cell, counts = np.unique(cell, return_counts=True)
    doc, word = np.divmod(cell, max(len(order), 1))
    present, sizes = np.unique(doc, return_counts=True)
    return [batch.column(i).take(pa.array(present)) for i in (key, DRAW)], np.cumsum(sizes), encoded.dictionary.take(pa.array(order)), word, counts


def _parts(batch: pa.RecordBatch, tokens: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of documents of at most BLOCK_CELLS tokens, or of one document."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(tokens)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + min(BLOCK_CELLS, CHUNK_CELLS), "right")))
        yield batch.slice(at, to - at)
        at = to


def _chunked(key: int, tokens: int, schema: pa.Schema):
    """Blocks of documents as they come, and at the end of each chunk a row for each of its words."""

    def row(**given: object) -> pa.RecordBatch:
        n = max(len(x) for x in given.values())
        return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

    def block(chunk: int, at: int, keys: list[pa.Array], sizes: np.ndarray, places: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        whole = pa.array([0, len(sizes)], pa.int32())
        return row(
            chunk=pa.array([chunk]), at=pa.array([at], pa.int32()), n_docs=pa.array([len(sizes)], pa.int32()), cells=pa.array([len(places)], pa.int32()),
            key=pa.ListArray.from_arrays(whole, keys[0]), draw=pa.ListArray.from_arrays(whole, keys[1]), sizes=pa.array([_packed(sizes.astype(np.int32))]),
            places=pa.array([_packed(_steps(places, np.cumsum(sizes) - sizes))]), counts=pa.array([_packed(counts.astype(np.int32))]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, kept = TaskContext.get().partitionId() << 32, 0, []

        def closed() -> Iterator[pa.RecordBatch]:
            listed = pa.concat_arrays([w for _, _, w, _, _ in kept]).dictionary_encode()
            order = pc.array_sort_indices(listed.dictionary).to_numpy()
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            place = place[listed.indices.to_numpy()]
            size = len(order)
            docs_with, times, low = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
            for i, (keys, ends, w, at, counts) in enumerate(kept):
                mine = place[low : low + len(w)][at]
                low += len(w)
                np.add.at(docs_with, mine, 1)
                np.add.at(times, mine, counts)
                yield block(chunk, i, keys, np.diff(ends, prepend=0), mine, counts)
            named = listed.dictionary.take(pa.array(order))
            for low in range(0, size, BLOCK_CELLS):
                mine = slice(low, low + BLOCK_CELLS)
                n = len(named[mine])
                yield row(chunk=pa.array(np.full(n, chunk)), at=pa.array(np.arange(low, low + n, dtype=np.int32)), token=named[mine], times=pa.array(times[mine]), docs_with=pa.array(docs_with[mine]))

        for batch in batches:
            for part in _parts(batch, tokens):
                found = _cells(part, key, tokens)
                if not len(found[1]):
                    continue
                kept.append(found)
                held += len(found[3])
                if held >= CHUNK_CELLS:
                    yield from closed()
                    chunk, held, kept = chunk + 1, 0, []
        if kept:
            yield from closed()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (token, chunk, documents, times) in the order of their tokens as a row for each token, with its chunks."""
    names = ["token", "doc_freq", "term_freq", "chunks"]

    def folded(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        token, chunk, docs, times = (c.combine_chunks() for c in rows.columns)
        sums = [pa.array(np.add.reduceat(c.to_numpy(), starts)) for c in (docs, times)]
        chunks = pa.ListArray.from_arrays(pa.array(np.append(starts, len(token)).astype(np.int32)), chunk)
        return pa.RecordBatch.from_arrays([token.take(pa.array(starts)), *sums, chunks], names=names)

    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not held.num_rows or held["token"][0].as_py() == held["token"][-1].as_py():
            continue
        starts = _starts(held["token"].combine_chunks())
        yield folded(held[: starts[-1]], starts[:-1])
        held = held[starts[-1] :].combine_chunks()  # more rows of its last token may follow
    if held is not None and held.num_rows:
        yield folded(held, np.zeros(1, np.int64))


def _starts(x: pa.Array) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)))


def _bucket(word: Column, buckets: int) -> Column:
    """The bucket of a word in a table that is bucketed by its number."""
    return F.pmod(F.hash(word), F.lit(buckets))


def chunked_corpus(df: DataFrame, tokens: str, key: str, limit: int | None = None) -> Corpus:
    """The documents with at least one token. They are read once; null tokens don't count; a null or repeated key is a document."""
    spark = df.sparkSession
    fields = [("chunk", T.LongType()), ("at", T.IntegerType()), ("n_docs", T.IntegerType()), ("cells", T.IntegerType()), ("key", T.ArrayType(df.schema[key].dataType)), ("draw", T.ArrayType(T.LongType()))]
    fields += [(c, T.BinaryType()) for c in ("sizes", "places", "counts")] + [("token", T.StringType()), ("times", T.LongType()), ("docs_with", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    rows = df.select(F.col(key).alias("key"), F.col(tokens).alias("tokens"), F.xxhash64(key, tokens).alias("draw"))
    found = materialise(rows.mapInArrow(_chunked(0, 1, to_arrow_schema(schema)), schema), "lda-corpus")
    listed = found.where("token is not null").select("token", "chunk", "docs_with", "times")
    counted = listed.repartition("token").sortWithinPartitions("token").mapInArrow(_counted, "token string, doc_freq long, term_freq long, chunks array<long>")
    known = words.bounded(words.numbered(materialise(counted, "lda-lists"), "token", "word_id"), limit)
    # each chunk has a first word
    n_docs, n_chunks, n_listed = found.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.count_if(F.col("token").isNotNull() & (F.col("at") == 0)), F.count("token")).first()
    docs = found.where("token is null").select("chunk", "at", "n_docs", "cells", "key", "draw", "sizes", "places", "counts")
    parts = min(max(1, n_chunks * CHUNK_BUCKETS), 50_000)
    by_chunk, _ = bucketed(docs.repartition(parts, "chunk"), "chunk", parts, "lda-docs")
    buckets = min(max(1, -(-n_listed // BUCKET_ROWS)), 50_000)
    by_word, _ = bucketed(known.select("word_id", "chunks").repartition(buckets, "word_id"), "word_id", buckets, "lda-words")
    return Corpus(spark.table(by_chunk), spark.table(by_word), known.drop("chunks"), n_docs, known.count(), buckets, [by_chunk, by_word])


# --- inference --------------------------------------------------------------------


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function, for positive numbers: six steps of the recurrence, then its series."""
    x = np.asarray(x, float)
    pair = x * (x + 5)  # 1 / x + 1 / (x + 5), then the two pairs between them
    steps = (2 * x + 5) * (1 / pair + 1 / (pair + 4) + 1 / (pair + 6))
    x = x + 6
    square = 1 / (x * x)
    series = square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    return np.log(x) - 0.5 / x - series - steps


def expected(weights: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """exp of the expected logarithm of a Dirichlet's shares."""
    return np.exp(digamma(weights) - digamma(totals))


def infer(seen: np.ndarray, times: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of each document, and for each of its words the share of its count that each topic takes.

    `seen` has the expected weights of each document's words, (documents, topics, words), and `times` their counts, (documents, words); a count of 0
    fills up. A document ends when its weights change by less than TOLERANCE in the mean, whatever the other documents do.
    """
    topics = seen.shape[1]
    gamma = np.repeat(alpha + times.sum(1, keepdims=True) / topics, topics, axis=1)
    active, going, mine, counts, now, ones = np.arange(len(seen)), np.ones(len(seen), bool), seen, times, gamma.copy(), np.ones(topics)
    for _ in range(ROUNDS):
        # a document's weights add up to the same in every round, so the digamma of their sum divides out
        theta = np.exp(digamma(now))
        new = alpha + theta * np.matmul(mine, _split(mine, theta, counts)[:, :, None])[:, :, 0]
        still = going & (np.abs(new - now) @ ones >= TOLERANCE * topics)
        ended = going & ~still
        gamma[active[ended]] = new[ended]
        now, going = new, still
        if not going.any():
            break
        if going.mean() < 0.8:  # drop the documents that have ended
            active, mine, counts, now = active[going], mine[going], counts[going], now[going]
            going = np.ones(len(active), bool)
    gamma[active[going]] = now[going]
    theta = np.exp(digamma(gamma))
    return gamma, seen * theta[:, :, None] * _split(seen, theta, times)[:, None, :]


def _split(seen: np.ndarray, theta: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The count of each word by its weight in its document: over all topics, the sum of the document's share times the word's."""
    mixed = np.matmul(theta[:, None, :], seen)[:, 0]
    return np.divide(times, np.maximum(mixed, 1e-100, out=mixed), out=mixed)


def _share_of(draws: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each document, another one for each salt."""
    h = (draws.view(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).astype(float) / 2.0**64


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.rint(x * (1 << PRECISION)).astype(np.int64)


def _chunk_of(left: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, places and counts of a chunk's documents, blocks in their order."""
    sizes, places, counts = [], [], []
    for n, cells, s, p, c in zip(*(left[x].to_pylist() for x in ("n_docs", "cells", "sizes", "places", "counts"))):
        sizes.append(_unpacked(s, n, np.int32))
        places.append(_summed_steps(_unpacked(p, cells, np.int32), sizes[-1]).astype(np.int32))
        counts.append(_unpacked(c, cells, np.int32))
    return tuple(map(np.concatenate, (sizes, places, counts)))


def _sent(columns: list[str], totals: np.ndarray):
    """Rows of (bucket, word, chunks, weights) as rows of a chunk's words in a bucket: their numbers and packed expected weights."""
    names = ["of", "word_id", *columns]

    def packed(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(kept).combine_chunks()
        of, word = rows["chunks"].combine_chunks().flatten().to_numpy(), pc.list_parent_indices(rows["chunks"]).to_numpy()
        bucket = rows["bucket"].to_numpy()[word]
        order = np.lexsort((bucket, of))
        of, bucket, word = of[order], bucket[order], word[order]
        starts = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])))
        ends = np.append(starts[1:], len(of))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(of)).astype(np.int32)), pa.array(rows["word_id"].to_numpy()[word]))
        weights = [expected(rows[c].to_numpy(), total).astype(np.float32)[word] for c, total in zip(columns, totals)]
        blobs = [pa.array([_packed(w[a:b]) for a, b in zip(starts, ends)], pa.binary()) for w in weights]
        return pa.RecordBatch.from_arrays([pa.array(of[starts]), lists, *blobs], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = 0, []
        for batch in batches:
            kept.append(batch)
            held += len(batch.column("chunks").flatten())
            if held >= PACKED:
                yield packed(kept)
                held, kept = 0, []
        if held:
            yield packed(kept)

    return run


def _needed(corpus: Corpus, weights: DataFrame, columns: list[str], totals: np.ndarray) -> DataFrame:
    """`(of, word_id, columns…)`: the words of each chunk with their packed expected weights."""
    rows = corpus.listed.join(weights.hint("shuffle_hash"), "word_id")
    rows = rows.select(_bucket(F.col("word_id"), corpus.buckets).alias("bucket"), "word_id", "chunks", *columns)
    return rows.mapInArrow(_sent(columns, totals), "of long, word_id array<long>, " + ", ".join(f"{c} binary" for c in columns))


def _word_weights(right: pa.Table, columns: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Word ids as they were sent, the place of each, and the expected weights of all by topic in the order of their places, which is that of their numbers."""
    lists = right["word_id"].combine_chunks()
    ids, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
    order = np.argsort(ids)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    by_topic = np.empty((len(columns), len(ids)))
    for k, c in enumerate(columns):
        by_topic[k] = np.concatenate([_unpacked(b, n, np.float32) for b, n in zip(right[c].to_pylist(), sizes)])[order]
    ends = np.cumsum(sizes)[:-1]
    return np.split(ids, ends), place, by_topic


# --- the model --------------------------------------------------------------------


@dataclass
class TopicModel:
    """`weights`: (word_id, w0, w1, …), a row for each word; `totals` are the sums of its columns."""

    weights: DataFrame
    totals: np.ndarray
    dictionary: DataFrame
    alpha: float

    @property
    def columns(self) -> list[str]:
        return [f"w{k}" for k in range(len(self.totals))]

    def top_words(self, n: int) -> DataFrame:
        """`(topic, rank, word, weight)`: the `n` heaviest words of each topic by their share of it; equal ones by name."""
        # topic by topic the words are cut to n in every task, before they meet; their numbers are in the order of their names
        best = None
        for k, (c, t) in enumerate(zip(self.columns, self.totals)):
            rows = self.weights.select(F.lit(k).alias("topic"), "word_id", (F.col(c) / float(t)).alias("weight"))
            rows = rows.orderBy(F.col("weight").desc(), "word_id").limit(n)
            best = rows if best is None else best.unionAll(rows)
        named = self.dictionary.select("word_id", F.col("token").alias("word")).join(F.broadcast(best), "word_id")
        held = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("_w"), "word", "weight")))
        return named.groupBy("topic").agg(held.alias("l")).select("topic", F.posexplode("l").alias("rank", "z")).select("topic", "rank", "z.word", "z.weight")


def first_weights(dictionary: DataFrame, topics: int, seed: int) -> DataFrame:
    """Gamma(100, 1/100) weights that follow from seed and word number, whatever the layout."""
    names = ["word_id", *(f"w{k}" for k in range(topics))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            out = np.empty((len(ids), topics))
            for block in np.unique(ids // DRAWN):
                mine = ids // DRAWN == block
                out[mine] = drawn(int(block), topics, seed)[ids[mine] % DRAWN]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.T)], names=names)

    return dictionary.select("word_id").mapInArrow(run, "word_id long, " + ", ".join(f"{n} double" for n in names[1:]))


def drawn(block: int, topics: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, block]).gamma(100.0, 0.01, (DRAWN, topics))


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most BLOCK_CELLS cells, or of one document."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_CELLS, "right")) - 1)
        yield at, to
        at = to


def _inferred(sizes: np.ndarray, places: np.ndarray, counts: np.ndarray, by_topic: np.ndarray, alpha: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of documents, their topic weights, places of their words and shares of the words' counts by topic, for documents of a width at a time.

    Documents are filled up to the next width, which follows from their own size, so their results don't depend on the others.
    """
    ends = np.cumsum(sizes)
    widths = np.ceil(2.0 ** (np.ceil(np.log2(np.maximum(sizes, 1)) * WIDTHS) / WIDTHS)).astype(np.int64)
    order = np.argsort(widths, kind="stable")
    of, starts = np.unique(widths[order], return_index=True)
    for width, docs in zip(of, np.split(order, starts[1:])):
        for at, to in _blocks(np.arange(len(docs) + 1) * width):
            mine = docs[at:to]
            filled = np.arange(width) < sizes[mine, None]
            cells = np.minimum((ends - sizes)[mine, None] + np.arange(width), ends[mine, None] - 1)
            times, words_ = np.where(filled, counts[cells], 0.0), places[cells]
            seen = np.empty((len(mine), len(by_topic), width))
            for k, w in enumerate(by_topic):
                seen[:, k] = w[words_]
            gamma, taken = infer(seen, times, alpha)
            yield mine, gamma, words_[filled], np.stack([taken[:, k][filled] for k in range(len(by_topic))])


def _seen(corpus: Corpus, weights: DataFrame, columns: list[str], totals: np.ndarray, alpha: float, share: float, salt: int) -> DataFrame:
    """For each chunk's words what its documents of this update gave each topic, and a row SHARES with their topic shares.

    A row has the words of a chunk in a bucket and their packed sums. `share` of the documents take part, drawn by a hash of key and tokens.
    """
    names = ["word_id", *(f"s{k}" for k in range(len(columns)))]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("at")
        ids, place, by_topic = _word_weights(right, columns)
        sizes, places, counts = _chunk_of(left)
        if share < 1:
            used = _share_of(pc.list_flatten(left["draw"]).to_numpy(), salt) < share
            cells = np.repeat(used, sizes)
            sizes, places, counts = sizes[used], places[cells], counts[cells]
        sums = np.zeros((len(columns), len(place) + 1), np.int64)
        for _, gamma, mine, taken in _inferred(sizes, places, counts, by_topic, alpha):
            for total, column in zip(sums, taken):
                np.add.at(total, mine, _rounded(column))
            sums[:, -1] += _rounded(gamma / gamma.sum(1, keepdims=True)).sum(0)
        lists = [*ids, np.array([SHARES])]
        ends = np.cumsum([len(x) for x in lists])
        sums = sums[:, np.append(place, -1)]
        blobs = [pa.array([_whole(x) for x in np.split(s, ends[:-1])], pa.binary()) for s in sums]
        return pa.Table.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(lists))), *blobs], names=names)

    schema = "word_id array<long>, " + ", ".join(f"{s} binary" for s in names[1:])
    return corpus.docs.groupBy("chunk").cogroup(_needed(corpus, weights, columns, totals).groupBy("of")).applyInArrow(run, schema)


def _whole(x: np.ndarray) -> bytes:
    """Whole numbers from 0, packed in as many bytes as the largest needs: 4 or 8."""
    return (b"4" if x.max() < 1 << 32 else b"8") + _packed(x.astype(np.uint32) if x.max() < 1 << 32 else x)


def _whole_of(packed: bytes, n: int) -> np.ndarray:
    return _unpacked(packed[1:], n, np.uint32 if packed[:1] == b"4" else np.int64).astype(np.int64)


def _merged(ids: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each number once, and what was given for it."""
    if not ids:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    ids, sums = np.concatenate(ids), np.concatenate(sums, 1)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[starts], np.add.reduceat(sums[:, order], starts, axis=1)


def _packed_weights(columns: list[str]):
    """Rows of (bucket, word, weights) as rows of a bucket's words: their numbers and packed weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, ids, *weights = (c.to_numpy() for c in batch.columns)
            order = np.argsort(bucket, kind="stable")
            of, starts = np.unique(bucket[order], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids[order]))
            blobs = [pa.array([_packed(x) for x in np.split(w[order], starts[1:])], pa.binary()) for w in weights]
            yield pa.RecordBatch.from_arrays([pa.array(of), lists, *blobs], names=["bucket", "word_id", *columns])

    return run


def _taking_part(corpus: Corpus, share: float, salt: int) -> int:
    """The number of documents of an update."""
    if share >= 1:
        return corpus.n_docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int((_share_of(batch.column(0).flatten().to_numpy(), salt) < share).sum())])], names=["n"])

    return corpus.docs.select("draw").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _moved(corpus: Corpus, seen: DataFrame, weights: DataFrame, columns: list[str], rate: float, scale: float, eta: float) -> DataFrame:
    """`(word_id, weights…, sums…)`: each word's weights moved by `rate` towards what all chunks saw of it; rows SHARES and TOTAL with sums.

    The sums come to the words' buckets, and so do the weights. The new ones are worked out in numpy: as columns with these numbers
    in them they would be new code to compile in every update.
    """
    n, sums = len(columns), [f"s{k}" for k in range(len(columns))]
    names = ["word_id", *columns, *sums]
    bucket = _bucket(F.col("word_id"), corpus.buckets).alias("bucket")
    held = weights.select(bucket, "word_id", *columns).mapInArrow(_packed_weights(columns), "bucket int, word_id array<long>, " + ", ".join(f"{c} binary" for c in columns))
    rows = seen.withColumn("bucket", _bucket(F.col("word_id")[0], corpus.buckets)).unionByName(held, allowMissingColumns=True)
    rows = rows.select("bucket", "word_id", *sums, *columns).repartitionById(corpus.buckets, F.col("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, known, weights_, size = [], [], [], [], 0
        for batch in batches:
            lists = batch.column(1)
            starts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
            flat = lists.flatten().to_numpy()
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                if batch.column(2)[i].is_valid:
                    ids.append(flat[a:b])
                    found.append(np.stack([_whole_of(batch.column(2 + k)[i].as_py(), b - a) for k in range(n)]))
                    size += b - a
                else:
                    known.append(flat[a:b])
                    weights_.append(np.stack([_unpacked(batch.column(2 + n + k)[i].as_py(), b - a, np.float64) for k in range(n)]))
            if size >= PACKED:
                (ids, found), size = ([x] for x in _merged(ids, found)), 0
        ids, found = _merged(ids, found)
        if not len(ids):
            return
        if ids[0] < 0:
            yield kind(SHARES, found[:, 0])
            ids, found = ids[1:], found[:, 1:]
        if not len(ids):
            return
        yield kind(TOTAL, found.sum(1))
        known = np.concatenate(known)
        order = np.argsort(known)
        assert np.array_equal(known[order], ids)  # every word is seen by a chunk and has weights
        new = np.concatenate(weights_, 1)[:, order] * (1 - rate) + (found * scale + eta) * rate
        for a in range(0, len(ids), BLOCK_CELLS):
            mine = slice(a, a + BLOCK_CELLS)
            nothing = pa.nulls(len(ids[mine]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), *(pa.array(w[mine]) for w in new), *[nothing] * n], names=names)

    def kind(number: int, of: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.nulls(1, pa.float64())] * n, *(pa.array([x]) for x in of)], names=names)

    schema = "word_id long, " + ", ".join([*(f"{c} double" for c in columns), *(f"{s} long" for s in sums)])
    return rows.mapInArrow(run, schema)


def fit(
    corpus: Corpus, topics: int, passes: int, seed: int, share: float = 1.0, updates: int | None = None,
    alpha: float | None = None, eta: float | None = None,
) -> tuple[TopicModel, np.ndarray]:
    """The model after `updates` updates (as many as `passes`, if not given) and the documents' weight for each topic.

    Update t (from 1) moves the weights by (1 + t) ** -DECAY towards what the documents say; with a `share` of them, what they say is scaled up
    to all. Priors are one by the number of topics.
    """
    alpha, eta = (1.0 / topics if x is None else x for x in (alpha, eta))
    columns, seen_columns = [f"w{k}" for k in range(topics)], [f"s{k}" for k in range(topics)]
    of_words = lambda df: df.where(F.col("word_id") >= 0).select("word_id", *columns)
    weights, path = corpus.by_word(first_weights(corpus.dictionary, topics, seed).repartition(corpus.buckets, "word_id"), "lda-weights")
    whole = [F.sum(F.round(F.col(c) * float(1 << PRECISION)).cast("long")).alias(c) for c in columns]
    totals = np.array([float(x) for x in weights.agg(*whole).first()]) / (1 << PRECISION)
    for t in range(passes if updates is None else updates):
        rate, scale = (2.0 + t) ** -DECAY, corpus.n_docs / max(_taking_part(corpus, share, seed + t), 1) / (1 << PRECISION)
        # a chunk has a word once, so nothing can be added up before the sums move to the buckets of their words
        seen = _seen(corpus, of_words(weights), columns, totals, alpha, share, seed + t)
        weights, path = corpus.by_word(_moved(corpus, seen, of_words(weights), columns, rate, scale, eta), "lda-weights")
        found = weights.where(F.col("word_id") == TOTAL).agg(*(F.sum(c) for c in seen_columns)).first()
        totals = totals * (1 - rate) + rate * (eta * corpus.n_words + scale * np.array([float(x) for x in found]))
    last = _seen(corpus, of_words(weights), columns, totals, alpha, 1.0, 0).where(F.col("word_id")[0] == SHARES).select(*seen_columns).collect()
    mass = np.sum([[_whole_of(bytes(x), 1)[0] for x in r] for r in last], axis=0) / (1 << PRECISION)
    # the model outlives the names of the corpus's tables
    return TopicModel(of_words(corpus.docs.sparkSession.read.parquet(path)), totals, corpus.dictionary, alpha), mass


def topic_shares(corpus: Corpus, model: TopicModel, key: str = "key") -> DataFrame:
    """`(key, shares)`: the topics' shares of each document of the corpus."""
    columns, totals, alpha = model.columns, model.totals, model.alpha
    needed = _needed(corpus, model.weights, columns, totals)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("at")
        _, _, by_topic = _word_weights(right, columns)
        sizes, places, counts = _chunk_of(left)
        gamma = np.empty((len(sizes), len(columns)))
        for mine, found, _, _ in _inferred(sizes, places, counts, by_topic, alpha):
            gamma[mine] = found
        shares = pa.ListArray.from_arrays(pa.array(np.arange(0, gamma.size + 1, len(columns), dtype=np.int32)), pa.array((gamma / gamma.sum(1, keepdims=True)).ravel()))
        return pa.table({key: pc.list_flatten(left["key"]), "shares": shares})

    schema = T.StructType([T.StructField(key, corpus.docs.schema["key"].dataType.elementType), T.StructField("shares", T.ArrayType(T.DoubleType()))])
    return corpus.docs.groupBy("chunk").cogroup(needed.groupBy("of")).applyInArrow(run, schema)
