"""Language-model scoring: corpus counts, a gated recurrent model (see `gru`) and the log-likelihood of whole texts.

Counts cover every training text and grow with the corpus. The model is trained on every training text, in two rounds; in each
round every task trains a copy on its own texts, and the copies are averaged by the tokens they have learnt from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chatloom.llm import gru
from chatloom.llm.common import Query, table, with_columns
from chatloom.llm.langid import held_out, most_frequent
from chatloom.session import materialise

# Words that the model tells apart; rarer words share a class and are told apart by their counts.
HEAD, LEAST_COUNT = 100_000, 3
# Classes whose words the network learns: at least so many, and the root of the vocabulary where that is more.
LEARNT_CLASSES, CLASS_WORDS = 16, 64
# Classes by counts: one row of bands per topic. A text's topic is its most frequent word, of the most common such words.
TOPICS, BANDS = 16, 2
# Sixteenths of the training texts per round.
ROUNDS = ((0, 2), (2, 16))
HELD_COUNTS = 500_000
TRAIN_TOKENS = 2_000_000
SCORE_TOKENS, SCORE_BYTES = 4_000_000, 32_000_000
END = b""
FIXED_POINT = 1 << 24
# Weights of a copy in one row of the table that is averaged.
BLOCK = 4096
EMPTY = pa.array([], pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))


def tokens(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, then the end."""
    found = text.encode().lower().split() if text else []
    found.append(END)
    return found


def topic_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """word, topic, n over all rows."""

    def emit(counts: dict[bytes, Counter]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([w for c in counts.values() for w in c], pa.binary()),
            pa.array([t for t, c in counts.items() for _ in c], pa.binary()),
            pa.array([n for c in counts.values() for n in c.values()], pa.int64()),
        ], names=["word", "topic", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, Counter] = {}
        held = 0
        for batch in batches:
            for text in batch.column(0):
                words = tokens(text.as_py())
                own = Counter(words)
                kept = counts.setdefault(max(own, key=own.get), Counter())
                held -= len(kept)
                kept.update(words)
                held += len(kept)
                if held > HELD_COUNTS:
                    yield emit(counts)
                    counts, held = {}, 0
        yield emit(counts)

    counted = docs.select(text_col).mapInArrow(run, "word binary, topic binary, n bigint")
    return counted.groupBy("word", "topic").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageModel:
    vocabulary: dict[bytes, int]
    counts: np.ndarray  # of the vocabulary
    total: int
    kinds: int
    layout: gru.Layout
    params: dict[str, np.ndarray]

    @property
    def rare_total(self) -> int:
        """Denominator of the rare words' own distribution: their tokens, kinds, and one unseen word."""
        return self.total - int(self.counts.sum()) + self.kinds - len(self.counts) + 1

    @property
    def base_total(self) -> int:
        return self.total + self.kinds + 1

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(len(self.counts))), np.int32, len(words))


def lay_out(words: list[bytes], counts: np.ndarray, topic: np.ndarray, total: int) -> gru.Layout:
    """Classes of the vocabulary, most frequent words first: learnt classes, then bands of equal mass per topic, then the rare class."""
    n = len(words)
    learnt = min(n, max(LEARNT_CLASSES, math.isqrt(n)) * CLASS_WORDS)
    classes = -(-learnt // CLASS_WORDS)
    word_class, place = np.zeros(n + 1, np.int64), np.full(n + 1, -1)
    read_as, within = np.zeros(n + 1, np.int64), np.zeros(n + 1)
    word_class[:learnt], place[:learnt] = np.divmod(np.arange(learnt), CLASS_WORDS)
    read_as[:learnt] = np.arange(learnt)
    next_class = classes
    for t in range(TOPICS + 1):
        own = learnt + np.flatnonzero(topic[learnt:] == t)
        if not len(own):
            continue
        mass = np.cumsum(counts[own]) - counts[own]
        band = np.minimum(BANDS * mass // counts[own].sum(), BANDS - 1)
        _, band = np.unique(band, return_inverse=True)
        word_class[own] = next_class + band
        sums = np.bincount(band, counts[own])
        within[own] = np.log(counts[own] / sums[band])
        next_class += int(band.max()) + 1
    word_class[n] = next_class
    read_as[learnt:] = learnt + word_class[learnt:] - classes
    mass = np.bincount(word_class[:n], counts, minlength=next_class + 1)
    mass[next_class] = total - counts.sum()
    bias = np.full((max(classes, 1), CLASS_WORDS), -30.0)
    if learnt:
        bias[word_class[:learnt], place[:learnt]] = np.log(counts[:learnt])
    return gru.Layout(read_as, word_class, place, within, classes, CLASS_WORDS, np.log((mass + 1) / (mass + 1).sum()), bias)


def mean_block(copies: pa.Table) -> pa.Table:
    """Mean of the copies of one block; sums of whole numbers, so that it does not depend on the order of the tasks."""
    weight = copies["weight"].to_numpy()
    x = np.stack([row.values.to_numpy() for row in copies["x"]]).astype(np.float64)
    high, low = np.divmod(np.round(x * FIXED_POINT).astype(np.int64), 1 << 15)  # so that no sum leaves 64 bits
    mean = ((weight @ high).astype(np.float64) * (1 << 15) + weight @ low) / weight.sum() / FIXED_POINT
    return pa.table({"start": copies["start"][:1], "x": pa.array([mean], pa.list_(pa.float64()))})


def trained(rows: DataFrame, text_col: str, model: LanguageModel) -> LanguageModel:
    """The model after one round over `rows`; without rows, the model itself."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        trainer = gru.Trainer(held.params, held.layout)
        waiting, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                waiting.append(held.ids(tokens(text.as_py())))
                size += len(waiting[-1])
                if size >= TRAIN_TOKENS:
                    trainer.learn(waiting)
                    waiting, size = [], 0
        trainer.learn(waiting)
        if trainer.weight:
            flat = gru.pack(trainer.p)
            starts = np.arange(0, len(flat), BLOCK)
            offsets = np.append(starts, len(flat)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(starts, pa.int64()), pa.array(np.full(len(starts), trainer.weight), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["start", "weight", "x"],
            )

    copies = rows.select(text_col).mapInArrow(run, "start bigint, weight bigint, x array<float>")
    mean = copies.groupBy("start").applyInArrow(mean_block, "start bigint, x array<double>").toArrow()
    if not mean.num_rows:
        return model
    flat = np.concatenate([x.values.to_numpy() for x in mean.sort_by("start")["x"]])
    return LanguageModel(model.vocabulary, model.counts, model.total, model.kinds, model.layout, gru.unpack(flat, model.params))


def fit(docs: DataFrame, id_col: str, text_col: str) -> tuple[LanguageModel, DataFrame]:
    """The model and the counts (word, n) of all training tokens. What reaches the driver is bounded by HEAD and TOPICS."""
    by_topic = materialise(topic_counts(docs, text_col), "lm-topics")
    counts = materialise(by_topic.groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # A word seen once or twice stays rare: what the model learns of rare words is what it knows of unseen ones.
    frequent = counts.where(F.col("n") >= LEAST_COUNT).withColumnRenamed("word", "item")
    head = materialise(most_frequent(frequent, HEAD), "lm-head")
    rows = head.select("item", "n").toArrow().sort_by([("n", "descending"), ("item", "ascending")])
    words, n = rows["item"].to_pylist(), rows["n"].to_numpy().astype(np.float64)
    vocabulary = {w: i for i, w in enumerate(words)}
    topics = by_topic.groupBy("topic").agg(F.sum("n").alias("mass")).orderBy(F.col("mass").desc(), "topic").limit(TOPICS)
    topics = [(r["topic"], r["mass"]) for r in topics.collect()]
    share = np.zeros((len(words), TOPICS + 1))
    if topics:
        wanted = by_topic.join(head.select(F.col("item").alias("word")), "word").where(F.col("topic").isin([bytes(t) for t, _ in topics]))
        found = wanted.toArrow()
        at = {bytes(t): j for j, (t, _) in enumerate(topics)}
        i = np.array([vocabulary[w] for w in found["word"].to_pylist()], np.int64)
        j = np.array([at[t] for t in found["topic"].to_pylist()], np.int64)
        mass = np.array([m for _, m in topics], np.float64)
        share[i, j] = found["n"].to_numpy() / mass[j]
    topic = np.where(share.any(1), share.argmax(1), TOPICS)
    layout = lay_out(words, n, topic, total)
    model = LanguageModel(vocabulary, n, total, kinds, layout, gru.initial(layout))
    sixteenth = F.pmod(F.xxhash64(F.lit(3), id_col, text_col), F.lit(16))
    for a, b in ROUNDS:
        model = trained(docs.where((sixteenth >= a) & (sixteenth < b)), text_col, model)
    return model, counts


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, rest: int = 2) -> DataFrame:
    """One row per row of `docs`: `id_col`, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out (crc32 of the id as text, `parts` and `rest`; a null id counts as the empty text).
    `score` is the log10 probability of the whole text and its end under the model, over the same events as the base:
    every word seen in training, and one unseen word. A null text is empty and has the end alone. If nothing can be learnt
    from, both scores are those of one unseen word per token. Equal texts get equal scores; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("held_out", held_out("_id", parts, rest))
    model, counts = fit(rows.where(~F.col("held_out")), "_id", "_text")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        held = shared.value
        rare = len(held.counts)
        base = np.append(np.log10(held.counts + 1), 0.0)

        def work(texts):
            n_tokens, n_frequent, frequent, scores, lists = [], [], [], [], [EMPTY]
            waiting, missing, size = [], [], 0

            def settle() -> None:
                nonlocal waiting, missing, size
                scores.extend((gru.score(held.params, held.layout, waiting) / math.log(10)).tolist())
                items = pa.StructArray.from_arrays(
                    [pa.array([w for m in missing for w in m], pa.binary()), pa.array([n for m in missing for n in m.values()], pa.int64())],
                    names=["word", "times"],
                )
                offsets = np.concatenate([[0], np.cumsum([len(m) for m in missing])]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), items))
                waiting, missing, size = [], [], 0

            for text in texts:
                words = tokens(text.as_py())
                ids = held.ids(words)
                seldom = np.flatnonzero(ids == rare)
                n_tokens.append(len(ids))
                n_frequent.append(len(ids) - len(seldom))
                frequent.append(float(base[ids].sum()))
                missing.append(Counter([words[i] for i in seldom.tolist()]))
                waiting.append(ids)
                size += len(ids)
                if size >= SCORE_TOKENS:
                    settle()
            settle()
            return [
                pa.array(n_tokens, pa.int64()), pa.array(n_frequent, pa.int64()), pa.array(frequent, pa.float64()),
                pa.array(scores, pa.float64()), pa.concat_arrays(lists),
            ]

        return work

    fields = [("n_tokens", "bigint"), ("_frequent", "bigint"), ("_base", "double"), ("_score", "double"),
              ("_rare", "array<struct<word: binary, times: bigint>>")]
    scored = with_columns(rows, ["_text"], fields, make, SCORE_BYTES).drop("_text")
    # written with a number for each row, as ids may be null or repeated
    scored = materialise(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("_row", F.inline("_rare")).join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("_logs"),
    )
    logs, seldom = F.coalesce("_logs", F.lit(0.0)), F.col("n_tokens") - F.col("_frequent")
    base = F.col("_base") + logs - F.col("n_tokens") * F.lit(math.log10(model.base_total))
    return scored.drop("_rare").join(rare, "_row", "left").select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", (F.col("_frequent") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"), base.alias("base_score"),
        (F.col("_score") + logs - seldom * F.lit(math.log10(model.rare_total))).alias("score"),
    )


def op4_gru(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op4_gru": Query(op4_gru)}
