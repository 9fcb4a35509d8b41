"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network in numpy.

A word has a sparse index vector drawn from its hash: MARKS places of DIMS hold 1 or -1. Its context vector is the sum of the
index vectors of all words up to REACH places away (and its own) over the whole corpus. Context vectors are kept in a table of
2 ** ROW_BITS rows addressed by the hash, so every word of every text counts, whatever the size of the vocabulary, and tables
of different tasks are added up. A document is the weighted mean and the spread of its words' vectors and the mean product of
neighbours' vectors; the network reads nothing else. Its logits are divided by a temperature fitted on labelled rows that the network didn't learn from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from chatloom.llm.common import KEY, Query, hand_back, pinned, slices, table, text_key, with_columns
from chatloom.session import materialise

DIMS = 64
ROW_BITS = 15
MARKS = 4
REACH = 2
# Words of share FREQUENT count half in the mean.
FREQUENT = 1e-3
SEED = 11
# Labelled rows that the driver fits on: those whose ids have the least hashes, at 4 * FEATURES bytes each.
FIT_ROWS = 20_000
CALIBRATION_SHARE = 0.2
HIDDEN = 32
EPOCHS, BATCH, RATE, DECAY = 40, 128, 3e-3, 1e-4
ACCEPTED = 0.3
FEATURES = 3 * DIMS
# Rows of the word table that travel together; tasks added up by one task of the first round.
BLOCK = 1024
FAN_IN = 64
# Words whose vectors a task holds at once.
WORDS_AT_ONCE = 1 << 15

SPACE, LETTER, DIGIT, MARK = range(4)
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
INVERSE = pow(BASE, -1, 1 << 64)


def _kinds() -> np.ndarray:
    kinds = np.full(256, MARK, np.uint8)
    kinds[:33] = kinds[127] = SPACE
    kinds[128:] = LETTER
    for c in range(128):
        kinds[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else kinds[c]
    return kinds


KINDS = _kinds()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a finaliser of xor shifts and products)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Cuts texts into words (runs of letters, of digits or of marks) and hashes each, all at once."""

    def __init__(self):
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.powers, self.inverses = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in a row, and the number of the text that each is in. Null texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(at[0]), int(at[-1])
        if first == last:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        data, at = np.frombuffer(texts.buffers()[2], np.uint8)[first:last], at - first
        kinds = KINDS[data]
        edge = np.empty(len(data), bool)
        edge[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
        edge[at[:-1][at[:-1] < len(data)]] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(data))
        words = kinds[starts] != SPACE
        starts, ends = starts[words], ends[words]
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.inverses[starts])
        return hashes, np.searchsorted(at, starts, "right") - 1


def rows_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - ROW_BITS)).astype(np.int64)


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors: arrays of MARKS columns."""
    h = mixed(hashes ^ np.uint64(SEED))
    shift = np.arange(MARKS, dtype=np.uint64) * np.uint64(8)
    bits = h[:, None] >> shift
    return (bits % np.uint64(DIMS)).astype(np.int64), 1.0 - 2.0 * ((bits >> np.uint64(7)) & np.uint64(1)).astype(float)


def add_contexts(sums: np.ndarray, hashes: np.ndarray, parents: np.ndarray) -> None:
    """Add what the words of some texts see to `sums`: DIMS columns of context and one of counts."""
    rows = rows_of(hashes)
    sums[:, DIMS] += np.bincount(rows, minlength=len(sums)).astype(np.int64)
    for low in range(0, len(rows), 1 << 17):
        to = min(len(rows), low + (1 << 17))
        from_, until = max(0, low - REACH), min(len(rows), to + REACH)
        places, signs = index_vectors(hashes[from_:until])
        flat, weight = [], []
        for off in range(-REACH, REACH + 1):
            i = np.arange(max(low, -off), min(to, len(rows) - off))
            i = i[parents[i] == parents[i + off]]
            flat.append((rows[i, None] * DIMS + places[i + off - from_]).ravel())
            weight.append(signs[i + off - from_].ravel())
        found = np.bincount(np.concatenate(flat), np.concatenate(weight), len(sums) * DIMS)
        sums[:, :DIMS] += found.astype(np.int64).reshape(-1, DIMS)


def _pack(part: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(part.tobytes(), asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    size = BLOCK * (DIMS + 1)
    return np.frombuffer(pa.Codec("zstd").decompress(blob, size * 8), np.int64).reshape(BLOCK, DIMS + 1)


SUMS = "block int, lane int, sums binary"


def _emit(found: dict[int, np.ndarray], lane: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.int32()), pa.array([lane] * len(found), pa.int32()), pa.array(map(_pack, found.values()), pa.binary())],
        names=["block", "lane", "sums"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of this task's rows, each added up."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column(0).to_pylist(), batch.column(2)):
            part = _unpack(sums.as_py())
            found[block] = found[block] + part if block in found else part
    yield _emit(found, 0)


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context sums and counts of all words of all texts: 2 ** ROW_BITS rows of DIMS + 1 whole numbers, 17 MB at any size.

    Every task adds up its own texts. The tasks' tables are added block by block, FAN_IN of them in a task first, so that no
    task reads a table of every task.
    """
    blocks = (1 << ROW_BITS) // BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = Words(), np.zeros((1 << ROW_BITS, DIMS + 1), np.int64)
        for batch in batches:
            for part in slices(batch, 0, 2_000_000):
                add_contexts(sums, *words(part.column(0)))
        parts = {b: sums[b * BLOCK : (b + 1) * BLOCK] for b in range(blocks)}
        yield _emit({b: p for b, p in parts.items() if p.any()}, TaskContext.get().partitionId() // FAN_IN)
        del words, sums, parts
        hand_back()

    texts = docs.select(F.col(text_col).alias("_text"))
    tables = materialise(texts.mapInArrow(run, SUMS), "classifier-contexts")
    lanes = (tables.agg(F.max("lane")).first()[0] or 0) + 1
    if lanes > 1:
        tables = tables.repartition(blocks * min(lanes, 64), "block", "lane").mapInArrow(_added, SUMS)
    out = np.zeros((1 << ROW_BITS, DIMS + 1), np.int64)
    for row in tables.repartition(blocks, "block").mapInArrow(_added, SUMS).collect():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = _unpack(row["sums"])
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors of length one, and in the last column the weight of the row's words in a mean."""
    context, n = sums[:, :DIMS].astype(float), sums[:, DIMS].astype(float)
    length = np.sqrt((context**2).sum(1))
    weight = FREQUENT / (FREQUENT + n / max(n.sum(), 1.0))
    return np.column_stack([context / np.maximum(length, 1e-9)[:, None], weight]).astype(np.float32)


def pooled(vectors: np.ndarray, hashes: np.ndarray, parents: np.ndarray, texts: int) -> np.ndarray:
    """A row for each text: weighted mean and standard deviation of its words' vectors, and the mean product of each word's
    vector with that of the word before it (which is how alike neighbours are). Zeros without words."""
    total, first, second, before = np.zeros(texts), np.zeros((texts, DIMS)), np.zeros((texts, DIMS)), np.zeros((texts, DIMS))
    rows = rows_of(hashes)
    for low in range(0, len(rows), WORDS_AT_ONCE):
        to = min(len(rows), low + WORDS_AT_ONCE)
        back = max(low - 1, 0)  # the word before the first of this run
        found = vectors[rows[back:to]]
        v, w, p = found[low - back :, :DIMS], found[low - back :, DIMS:], parents[low:to]
        at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        vw = v * w
        total[p[at]] += np.add.reduceat(w[:, 0], at, dtype=float)
        first[p[at]] += np.add.reduceat(vw, at)
        second[p[at]] += np.add.reduceat(vw * v, at)
        pairs = found[1:, :DIMS] * found[:-1, :DIMS]
        pairs[parents[back + 1 : to] != parents[back : to - 1]] = 0
        if low == back:  # the first word of all has none before it
            pairs = np.vstack([np.zeros((1, DIMS), pairs.dtype), pairs])
        before[p[at]] += np.add.reduceat(pairs, at)
    some = np.maximum(total, 1e-12)[:, None]
    mean = first / some
    words = np.bincount(parents, minlength=texts)[:, None]
    spread = np.sqrt(np.maximum(second / some - mean**2, 0.0))
    return np.hstack([mean, spread, before / np.maximum(words, 1)]).astype(np.float32)


def with_features(docs: DataFrame, vectors: np.ndarray, text_col: str = "text", out: str = "features") -> DataFrame:
    """`docs` with FEATURES numbers (little-endian float32, binary) for each whole text. A column `out` is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def make():
        words = Words()

        def work(texts):
            found = pooled(held.value, *words(texts), len(texts))
            return [pa.array([row.tobytes() for row in found], pa.binary())]

        return work

    return with_columns(docs.drop(out) if out != text_col else docs, [text_col], [(out, "binary")], make)


@dataclass
class Network:
    """Two layers over standardised features; `temperature` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.weights[0] + self.weights[1])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.weights[2] + self.weights[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.logits(x) / self.temperature)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean log loss by each array of weights."""
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ self.weights[0] + self.weights[1])
        error = (logistic(h @ self.weights[2] + self.weights[3][0]) - y) / len(y)
        back = error[:, None] * self.weights[2] * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ error, np.array([error.sum()])]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.mean(np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-12, 1)))) if len(y) else 0.0


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on shuffled batches, then the temperature on the rows that were held back, by golden section.

    Without rows of both kinds the network says the share of good rows, a half if there are no rows.
    """
    x, y = np.asarray(x, float).reshape(-1, FEATURES), np.asarray(y, float)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    kept = len(x) - int(CALIBRATION_SHARE * len(x))
    fit, held = order[:kept], order[kept:]
    share = (y.sum() + 0.5) / (len(y) + 1)
    weights = [rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(share / (1 - share))])]
    net = Network(x.mean(0) if len(x) else np.zeros(FEATURES), np.maximum(x.std(0), 1e-6) if len(x) else np.ones(FEATURES), weights)
    if len(set(y[fit])) < 2:
        return net
    weights[2] += rng.normal(0, HIDDEN**-0.5, HIDDEN)
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    steps = EPOCHS * -(-len(fit) // BATCH)
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for low in range(0, len(fit), BATCH):
            picked = fit[low : low + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            for w, g, m, v in zip(weights, net.gradients(x[picked], y[picked]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * w)
    net.temperature = fitted_temperature(net.logits(x[held]), y[held])
    return net


def fitted_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature from 1/8 to 8 with the least log loss; 1 without rows."""
    if not len(y):
        return 1.0
    loss = lambda t: log_loss(logistic(logits / np.exp(t)), y)
    low, high, ratio = np.log(1 / 8), np.log(8), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(features: DataFrame, labels: DataFrame, id_col: str, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `rows` labelled ids that aren't held out: those with the least hashes.

    An id that is labelled both ways has no label; one that is labelled twice the same way counts once; ids that aren't
    in `features`, null ids and null labels teach nothing; of rows that share an id one is taken. The ids are picked before
    the join, so at most `rows` of them travel, and no row of `features` is shuffled.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_label_id"))
    known = known.agg(F.min("quality").alias("_low"), F.max("quality").alias("_high")).where("_low = _high")
    known = known.where(~held_out(F.col("_label_id")))
    range_ = 1 << 40
    known = known.select("_label_id", (F.col("_low") == 1).cast("int").alias("_y"), F.pmod(F.xxhash64(F.lit(SEED), "_label_id"), F.lit(range_)).alias("_at"))
    known = materialise(known, "classifier-labels")
    n = known.count()
    if n > 2 * rows:  # about half as many again stay under the bound, so that few rows are put in order
        known = known.where(F.col("_at") < int(range_ * 1.5 * rows / n))
    picked = known.orderBy("_at", "_label_id").limit(rows)
    joined = features.join(F.broadcast(picked), F.col(id_col) == F.col("_label_id"))
    first = joined.groupBy("_at", "_label_id").agg(F.min(F.struct(*KEY, "_features", "_y")).alias("_row")).collect()
    first = [r["_row"] for r in sorted(first, key=lambda r: (r["_at"], r["_label_id"]))]
    x = np.frombuffer(b"".join(bytes(r["_features"]) for r in first), "<f4").reshape(-1, FEATURES)
    return x, np.array([r["_y"] for r in first], float)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `id_col`, held_out, score, predicted.

    Word vectors come from all texts, labelled or not. Null, empty and wordless texts have zero features and get the network's
    score for them; equal texts get equal scores; rows with a null id are scored and teach nothing. Empty tables give empty
    tables; without labels every score is a half. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    vectors = word_vectors(context_sums(texts, "_text"))
    keyed = pinned(texts, "_id", "_text", **dict(zip(KEY, text_key(F.col("_text")))))
    features = materialise(with_features(keyed, vectors, "_text", "_features").drop("_text"), "classifier-features")
    network = train(*labelled_sample(features, labels, "_id"))

    def make():
        def work(rows):
            x = np.frombuffer(b"".join(r.as_py() for r in rows), "<f4").reshape(-1, FEATURES)
            return [pa.array(network.scores(x.astype(float)), pa.float64())]

        return work

    out = with_columns(features.select("_features", "_id"), ["_features"], [("score", "double")], make)
    return out.select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score",
        (F.col("score") >= ACCEPTED).cast("int").alias("predicted"),
    )


def op11_random_indexing(spark, sf_dir: str) -> DataFrame:
    """All documents, fitted on the labels of rows that aren't held out."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_random_indexing": Query(op11_random_indexing)}
