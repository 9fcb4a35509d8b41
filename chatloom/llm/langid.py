"""Language ID, word first: known words by their log frequency per language, unseen words by ever shorter character grams.

The logs of all words and grams stay in tables. Every task holds those of the most frequent ones, which is a matter of speed alone: a
word that it doesn't hold is listed once for a chunk of texts, all such words are looked up (or, if they are unseen, put
together from grams) once each, and what they say is brought back to the chunks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from chatloom.llm.common import KEY, Query, hand_back, quoted, slices, table, text_key, unused
from chatloom.session import materialise

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4
# Words and grams that every task holds; the others are looked up by joins.
MAX_WORDS = 100_000
MAX_GRAMS = 100_000
# Different words to be looked up after which a chunk of texts is closed.
CHUNK_WORDS = 100_000
STEP_BYTES = 2_000_000
# Rows that a counting task keeps before it hands them on.
HELD_COUNTS = 300_000
SMOOTHING = 0.5
UNKNOWN = "und"


def letter_words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _emit(counts: dict[str, Counter]) -> pa.RecordBatch:
    langs = [lang for lang, c in counts.items() for _ in c]
    items = [w for c in counts.values() for w in c]
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(items, pa.string()), pa.array([n for c in counts.values() for n in c.values()], pa.int64())],
        names=["lang", "item", "n"],
    )


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, item, n over all rows: counted within each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(*batch.columns):
                own = counts.setdefault(lang.as_py(), Counter())
                own.update(letter_words(text.as_py()))
                if sum(map(len, counts.values())) > HELD_COUNTS:
                    yield _emit(counts)
                    counts = {}
        yield _emit(counts)

    plain = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    return plain.mapInArrow(run, "lang string, item string, n bigint").groupBy("lang", "item").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, item, n of the character grams of one to four characters, from the table of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = counts.setdefault(lang, Counter())
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        own[g] += n
                if sum(map(len, counts.values())) > HELD_COUNTS:
                    yield _emit(counts)
                    counts = {}
        yield _emit(counts)

    return words.mapInArrow(run, "lang string, item string, n bigint").groupBy("lang", "item").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of the items with the highest totals, at most `limit` items; items of equal total stay or go together."""
    totals = counts.groupBy("item").agg(F.sum("n").alias("total"))
    sizes = totals.groupBy("total").agg(F.count("*").alias("items"))
    # one row per different total: far fewer than items, and only sums pass through one task
    above = Window.partitionBy(F.lit(0)).orderBy(F.col("total").desc())
    cut = sizes.select("total", F.sum("items").over(above).alias("so_far")).where(F.col("so_far") <= limit).agg(F.min("total")).first()[0]
    if cut is None:
        return counts.limit(0)
    return counts.join(totals.where(F.col("total") >= cut).select("item"), "item")


def log_table(counts: DataFrame, langs: list[str], sums: dict[str, float], kinds: int) -> DataFrame:
    """item, logs: log((n + a) / (N + a * kinds)) for each language, in the order of `langs`."""
    seen = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{j}") for j, lang in enumerate(langs)]
    base = [float(np.log(sums[lang] + SMOOTHING * max(kinds, 1))) for lang in langs]
    logs = F.array(*(F.log(F.col(f"n{j}") + SMOOTHING) - b for j, b in enumerate(base))) if langs else F.array().cast("array<double>")
    return counts.groupBy("item").agg(*seen, F.count("*").alias("_n")).select("item", logs.alias("logs"))


def _held(logs: DataFrame, frequent: DataFrame, langs: int) -> tuple[dict[str, int], np.ndarray]:
    """Index of the frequent items and their logs, a row each: at most as many as `most_frequent` gives."""
    rows = logs.join(frequent.select("item").distinct(), "item").toArrow()
    values = rows["logs"].combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0)
    return {w: i for i, w in enumerate(rows["item"].to_pylist())}, values.reshape(rows.num_rows, langs)


def back_off(word: str, known: Mapping[str, object]) -> list[str]:
    """Known grams that cover an unseen word: an unknown gram is replaced by its two shorter parts."""
    todo, found = grams(word, min(LONGEST, len(word) + 2)), []
    while todo:
        shorter: dict[str, None] = {}
        for g in todo:
            if g in known:
                found.append(g)
            elif len(g) > 1:
                shorter[g[:-1]] = shorter[g[1:]] = None
        todo = list(shorter)
    return found


def parts_of(word: str) -> list[str]:
    """All grams that `back_off` may ask for."""
    return list(dict.fromkeys(g for n in range(1, min(LONGEST, len(word) + 2) + 1) for g in grams(word, n)))


@dataclass(frozen=True)
class LanguageModel:
    """`words` and `grams` are what every task holds; the tables (item, logs) hold all."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray


@dataclass(frozen=True)
class Fitted:
    model: LanguageModel
    word_table: DataFrame
    gram_table: DataFrame


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Fitted:
    """Model from all rows of `docs` that have a text and a language. The most frequent items of two tables reach the driver."""
    words = materialise(word_counts(docs, text_col, lang_col), "language-words")
    pieces = materialise(gram_counts(words), "language-grams")
    tables, held, langs = [], [], []
    for counts, limit in ((words, max_words), (pieces, max_grams)):
        sums = {r["lang"]: (float(r["total"]), r["kinds"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).collect()}
        langs = langs or sorted(sums)  # a language without words has no grams
        kinds = max((k for _, k in sums.values()), default=1)
        tables.append(materialise(log_table(counts, langs, {k: sums.get(k, (0.0, 0))[0] for k in langs}, kinds), "language-logs"))
        held += _held(tables[-1], most_frequent(counts, limit), len(langs))
    return Fitted(LanguageModel(langs, *held), *tables)


# --- what the tasks don't hold ------------------------------------------------------


def unseen_logs(words: DataFrame, fitted: Fitted) -> DataFrame:
    """item, logs of unseen words: the mean of the grams that cover each; zeros where there are none."""
    model, langs = fitted.model, len(fitted.model.langs)
    held = words.sparkSession.sparkContext.broadcast((model.grams, model.gram_logs))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value[0]
        for batch in batches:
            items, wanted = [], []
            for w in batch.column(0).to_pylist():
                missing = [g for g in parts_of(w) if g not in known]
                items += [w] * len(missing)
                wanted += missing
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(wanted, pa.string())], names=["item", "gram"])

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = held.value
        for batch in batches:
            out = np.zeros((batch.num_rows, langs))
            for i, (w, more) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own = {m["gram"]: m["logs"] for m in more or ()}
                found = back_off(w, _Both(known, own))
                if found:
                    out[i] = np.mean([own[g] if g in own else logs[known[g]] for g in found], axis=0)
            ends = pa.array(np.arange(0, out.size + 1, max(langs, 1), dtype=np.int32)) if langs else pa.array(np.zeros(batch.num_rows + 1, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["item", "logs"])

    words = materialise(words, "language-unseen")
    rare = words.mapInArrow(asked, "item string, gram string").join(fitted.gram_table.withColumnRenamed("item", "gram"), "gram")
    # at most four grams for each character of a word
    rare = rare.groupBy("item").agg(F.collect_list(F.struct("gram", "logs")).alias("more"))
    return words.join(rare, "item", "left").select("item", "more").mapInArrow(covered, "item string, logs array<double>")


class _Both(dict):
    """Two mappings asked for a key one after the other."""

    def __init__(self, first: Mapping[str, object], second: Mapping[str, object]):
        self.first, self.second = first, second

    def __contains__(self, key: object) -> bool:
        return key in self.first or key in self.second


# --- prediction ---------------------------------------------------------------------


def _evidence(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """`rows` (their last column is the text) without it: number of words, what the held words say, and places and counts of the
    others in the list of their chunk; at the end of a chunk a row with that list."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    own = rows.schema.fields[:-1]
    schema = T.StructType([
        *(T.StructField(f.name, f.dataType) for f in own), T.StructField("_n", T.LongType()), T.StructField("_said", T.ArrayType(T.DoubleType())),
        T.StructField("_places", T.ArrayType(T.IntegerType())), T.StructField("_times", T.ArrayType(T.LongType())),
        T.StructField("_chunk", T.LongType()), T.StructField("_listed", T.ArrayType(T.StringType())),
    ])
    text_at = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, chunk, listed, kinds = held.value, TaskContext.get().partitionId() << 32, {}, None
        langs = len(model.langs)

        def closing() -> pa.RecordBatch:
            made = {"_chunk": pa.array([chunk]), "_listed": pa.array([list(listed)], pa.list_(pa.string()))}
            return pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(1, f.type)) for f in kinds], schema=kinds)

        for batch in batches:
            for part in slices(batch, text_at, STEP_BYTES):
                n, said, places, times, ends = [], np.zeros((part.num_rows, langs)), [], [], [0]
                for i, text in enumerate(part.column(text_at)):
                    text = text.as_py()
                    words = letter_words(text) if text else []
                    if not any(c.isalpha() for w in words for c in w):
                        words = []
                    n.append(len(words))
                    counts = Counter(words)
                    found = list(map(model.words.get, counts))
                    known = [(j, m) for j, m in zip(found, counts.values()) if j is not None]
                    if known:
                        at, weight = np.array(known).T
                        said[i] = weight.astype(np.float64) @ model.word_logs[at]
                    if len(known) < len(found):
                        for word, j in zip(counts, found):
                            if j is None:
                                places.append(listed.setdefault(word, len(listed)))
                                times.append(counts[word])
                    ends.append(len(places))
                rows_ = part.num_rows
                step = pa.array(np.arange(0, said.size + 1, langs, dtype=np.int32) if langs else np.zeros(rows_ + 1, np.int32))
                offsets = pa.array(ends, pa.int32())
                out = pa.RecordBatch.from_arrays([
                    *part.columns[:text_at], pa.array(n, pa.int64()), pa.ListArray.from_arrays(step, pa.array(said.ravel())),
                    pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                    pa.array(np.full(rows_, chunk)), pa.nulls(rows_, pa.list_(pa.string())),
                ], names=schema.names)
                kinds = out.schema
                yield out
                if len(listed) >= CHUNK_WORDS:
                    yield closing()
                    chunk, listed = chunk + 1, {}
        if kinds is not None:
            yield closing()
        hand_back()

    return rows.mapInArrow(run, schema)


def with_language(docs: DataFrame, fitted: Fitted, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` without its text, with the predicted language and its probability; reads nothing but the text.

    The likeliest language, the evidence being divided by the root of the number of words; of equal languages the first in the
    alphabet. `und` with 0 without a letter or without a language.
    """
    langs = fitted.model.langs
    others = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others, F.lit(0).alias("_none")).alias("_row"), F.col(text_col).alias("_text"))
    found = materialise(_evidence(rows, fitted.model), "language-evidence")
    listed = found.where("_listed is not null").select("_chunk", F.posexplode("_listed").alias("_place", "item"))
    distinct = listed.select("item").distinct()
    looked = distinct.join(fitted.word_table, "item", "left")
    looked = materialise(looked, "language-looked")
    known = looked.where("logs is not null").unionByName(unseen_logs(looked.where("logs is null").select("item"), fitted))
    brought = listed.join(known, "item").select(F.col("_chunk").alias("_of"), "_place", "logs")
    texts = found.where("_listed is null").drop("_listed")
    schema = T.StructType([texts.schema["_row"], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def decide(left: pa.Table, right: pa.Table) -> pa.Table:
        n, k = left["_n"].to_numpy(), len(langs)
        pred, score = [UNKNOWN] * len(n), np.zeros(len(n))
        if k:
            total = left["_said"].combine_chunks().flatten().to_numpy().reshape(len(n), k).copy()
            logs = np.zeros((right.num_rows, k))
            if right.num_rows:
                logs[right["_place"].to_numpy()] = right["logs"].combine_chunks().flatten().to_numpy().reshape(-1, k)
            places, times = left["_places"].combine_chunks(), left["_times"].combine_chunks().flatten().to_numpy()
            owner = pc.list_parent_indices(places).to_numpy()
            at = places.flatten().to_numpy()
            for j in range(k):
                total[:, j] += np.bincount(owner, times * logs[at, j] if len(at) else times, len(n))
            scaled = np.exp((total - total.max(1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None])
            best = scaled.argmax(1)
            share = scaled[np.arange(len(n)), best] / scaled.sum(1)
            pred = [langs[b] if c else UNKNOWN for b, c in zip(best.tolist(), n.tolist())]
            score = np.where(n > 0, share, 0.0)
        return pa.table({"_row": left["_row"], names[0]: pa.array(pred, pa.string()), names[1]: pa.array(score)})

    out = texts.groupBy("_chunk").cogroup(brought.groupBy("_of")).applyInArrow(decide, schema)
    return out.select(*(F.col("_row.`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns if c != text_col), *names)


def held_out(id_col: str, parts: int = 4, rest: int = 2) -> F.Column:
    """Whether crc32 of the id as text leaves `rest`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == rest


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of `docs`: `id_col`, held_out, lang_pred, score.

    Learns from the rows that are not held out and have text and language. A text that is null or has no letter, and every
    text when nothing could be learnt, is `und` with score 0. Rows with equal texts get equal answers; other columns are
    not read.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")
    ).withColumn("held_out", held_out("_id"))
    fitted = fit_languages(rows.where(~F.col("held_out")), "_text", "_lang")
    out = with_language(rows.select("_id", "held_out", "_text"), fitted, "_text")
    return out.select(F.col("_id").alias(id_col), "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is known with at least `min_score`, with their columns.

    Null texts and texts without a letter go, repeated rows stay or go together, an empty table gives an empty one. Each
    different text is judged once; the rejected ones, few as a rule, are written and the rows met with them.
    """
    fitted = fit_languages(docs.where(~held_out(id_col)), text_col, lang_col)
    texts = docs.select(*text_key(F.col(text_col)), F.col(text_col).alias("_text"))
    found = with_language(texts, fitted, "_text", ("_pred", "_score"))
    bad = materialise(found.where((F.col("_pred") == UNKNOWN) | (F.col("_score") < min_score)).select(*KEY).distinct(), "language-rejected")
    own = [unused(docs, n) for n in ("text_1", "text_2")]
    keyed = docs.withColumns(dict(zip(own, text_key(F.col(text_col)))))
    return keyed.join(bad, (keyed[own[0]] == bad[KEY[0]]) & (keyed[own[1]] == bad[KEY[1]]), "left_anti").select(*quoted(docs.columns))


def op2_words(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op2_words": Query(op2_words)}
