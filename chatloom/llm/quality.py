"""Quality rules: rule statistics of every whole text, base rules, and an isolation forest over the statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chatloom.llm.common import KEY, Query, quoted, table, text_key, unused, with_columns
from chatloom.session import materialise

SYMBOLS = "#*$%&|<>"
SPAN = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# The method's own settings: every tree sees 256 rows, so the sample that is fitted is bounded by these two.
TREES = 100
TREE_ROWS = 256
# A share counts as 0 up to twice this quantile of the labelled good texts, and a hundredth more.
TOLERATED = 0.99
# Largest share of labelled good texts that the calibrated threshold may reject.
MAX_GOOD_REJECTED = 0.01
SEED = 7

BASE = (("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"))
# What the forest sees: by how much each share exceeds what labelled good texts show. Repeated lines and windows are the base
# rules' matter, and digits or long words also mark good texts.
SHARES = ("symbol_share", "upper_share", "mark_share", "run_share")


def split_words(text: str) -> list[str]:
    """Words `[^\\x20\\x09-\\x0D]+`."""
    for mark in "\t\n\v\f\r":
        text = text.replace(mark, " ")
    return [w for w in text.split(" ") if w]


def repeated_words(words: list[str]) -> int:
    """Words inside windows of eight words that the text holds twice or more."""
    n = len(words) - SPAN + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for j in range(SPAN):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0  # equal windows have equal hashes
    suspects = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    seen: dict[tuple[str, ...], list[int]] = {}
    for i in suspects.tolist():
        seen.setdefault(tuple(words[i : i + SPAN]), []).append(i)
    edges = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            edges[places] += 1
            edges[np.asarray(places) + SPAN] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple:
    """The base statistics and the shares of one text; null and wordless texts have zeros."""
    text = text or ""
    words = split_words(text)
    n = len(words)
    if not n:
        return (0,) * len(BASE) + (0.0,) * len(SHARES)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = int((points != low).sum()) if len(points) == len(low) else sum(map(str.isupper, text))
    runs = sum(map(str.__eq__, words, words[1:]))
    shares = symbols / chars, upper / chars, (text.count("!") + text.count("?")) / chars, runs / n
    return n, chars, symbols, dup_lines, repeat, *shares


def rule_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the statistics of each whole text; columns of these names are replaced."""
    fields = [*BASE, *((s, "double") for s in SHARES)]
    kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(SHARES)

    def make():
        def work(texts):
            rows = [statistics(t.as_py()) for t in texts]
            return [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]

        return work

    return with_columns(docs.drop(*(n for n, _ in fields if n != text_col)), [text_col], fields, make)


@dataclass(frozen=True)
class Forest:
    """Trees as heaps: node i has the children 2i + 1 and 2i + 2; `feature` is -1 in a leaf, `length` the path that ends there."""

    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): towards 1 the shorter the paths."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, split, length in zip(self.feature, self.split, self.length):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[at]
                step = 2 * at + 1 + (x[every, np.maximum(f, 0)] >= split[at])
                at = np.where(f >= 0, step, at)
            total += length[at]
        return np.exp2(-total / len(self.feature) / max(expected_path(self.rows), 1e-9))


def expected_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """Random splits between the least and the greatest value of a random feature, down to log2(rows) levels."""
    rng = np.random.default_rng(seed)
    rows = max(1, min(rows, len(sample)))
    depth = max(1, int(np.ceil(np.log2(rows)))) if rows > 1 else 1
    size = 2 ** (depth + 1) - 1
    feature, split, length = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        picked = sample[rng.choice(len(sample), rows, replace=False)] if len(sample) else np.zeros((1, sample.shape[1]))
        todo = [(0, 0, picked)]
        while todo:
            i, level, part = todo.pop()
            low, high = part.min(0), part.max(0)
            free = np.flatnonzero(high > low)
            if level == depth or len(part) < 2 or not len(free):
                length[t, i] = level + expected_path(len(part))
                continue
            f = rng.choice(free)
            at = rng.uniform(low[f], high[f])
            right = part[:, f] >= at
            if right.all():  # the split fell on the least value
                at = np.nextafter(low[f], high[f])
                right = part[:, f] >= at
            feature[t, i], split[t, i] = f, at
            todo += [(2 * i + 1, level + 1, part[~right]), (2 * i + 2, level + 1, part[right])]
    return Forest(feature, split, length, rows)


@dataclass(frozen=True)
class QualityModel:
    tolerated: np.ndarray
    forest: Forest
    threshold: float

    def anomaly(self, shares: np.ndarray) -> np.ndarray:
        return self.forest.scores(np.maximum(shares - self.tolerated, 0.0)) if len(shares) else np.zeros(0)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_anomaly(stats: DataFrame, model: QualityModel) -> DataFrame:
    def make():
        def work(*shares):
            return [pa.array(model.anomaly(np.column_stack([s.to_numpy(zero_copy_only=False) for s in shares])), pa.float64())]

        return work

    return with_columns(stats.drop("anomaly"), list(SHARES), [("anomaly", "double")], make)


def fit_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> QualityModel:
    """Forest and threshold.

    `stats` has `id_col`, the statistics and the text's key. The forest is grown from at most TREES * TREE_ROWS rows, taken by
    a hash of key and id; the threshold counts every labelled row that passes the base rules. It is the one with the best
    difference of hit rates that rejects at most MAX_GOOD_REJECTED of the good rows, of equal ones the most lenient.
    Without labelled rows of both kinds nothing is rejected by the forest.
    """
    sample = sampled_shares(stats.where(~base_failed()), id_col, TREES * TREE_ROWS, seed)
    known = labels.select(F.col("doc_id").alias("_label_id"), "quality").where("quality is not null")
    judged = stats.where(~base_failed()).join(known, F.col(id_col) == F.col("_label_id")).select("quality", *SHARES)
    judged = materialise(judged, "quality-labelled")
    # thousandths: exact quantiles of at most a thousand different values
    limits = judged.where("quality = 1").agg(*(F.percentile(F.round(s, 3), F.lit(TOLERATED)) for s in SHARES)).first()
    tolerated = np.array([2 * (x or 0.0) + 0.01 for x in limits])
    model = QualityModel(tolerated, grow(np.maximum(sample - tolerated, 0.0), seed=seed), 2.0)
    # at most a thousand bins, whatever the number of labelled rows
    bins = with_anomaly(judged, model).groupBy(F.round("anomaly", 3).alias("bin")).agg(
        F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.count(F.when(F.col("quality") != 1, 1)).alias("bad")
    )
    below = Window.partitionBy(F.lit(0)).orderBy(F.col("bin").desc())
    every = Window.partitionBy(F.lit(0))
    bins = bins.select(
        "bin", (F.sum("good").over(below) / F.sum("good").over(every)).alias("good"),
        (F.sum("bad").over(below) / F.sum("bad").over(every)).alias("bad"),
    ).where(F.col("good") <= MAX_GOOD_REJECTED)
    best = bins.orderBy((F.col("bad") - F.col("good")).desc_nulls_last(), F.col("bin").desc()).where("bad > good").first()
    return replace(model, threshold=best["bin"] - 0.0005) if best else model


def sampled_shares(rows: DataFrame, id_col: str, size: int, seed: int) -> np.ndarray:
    """The shares of the `size` rows with the least hashes of key and id, or of all rows if there are fewer.

    Every task hands on the rows below a hash that about half as many again stay under, so what reaches the driver is bounded
    by `size`; rows that agree in key and id count once.
    """
    range_ = 1 << 40
    n = rows.count()
    under = range_ if n <= 2 * size else int(range_ * min(1.0, 1.5 * size / n))
    placed = F.pmod(F.xxhash64(F.lit(seed), *KEY, id_col), F.lit(range_)).alias("_at")
    found = rows.select(placed, *SHARES).where(F.col("_at") < under).distinct().collect()
    first = sorted(tuple(r) for r in found)[:size]
    return np.array([r[1:] for r in first], float).reshape(-1, len(SHARES))


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumns(dict(zip(KEY, text_key(F.col(text_col)))))


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `id_col`, the statistics, base_failed, anomaly, kept.

    Null, empty and wordless texts have zeros and fail the base rules. Equal texts get equal verdicts. An empty table
    gives an empty table; other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    stats = materialise(rule_statistics(keyed(texts, "_text"), "_text").drop("_text"), "quality-statistics")
    model = fit_quality(stats, labels, "_id")
    out = with_anomaly(stats, model).withColumn("base_failed", base_failed())
    return out.select(
        F.col("_id").alias(id_col), *(n for n, _ in BASE), "base_failed",
        (~F.col("base_failed") & (F.col("anomaly") <= model.threshold)).alias("kept"), "anomaly", *SHARES,
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with their columns. The texts are read twice and never shuffled."""
    texts = keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    stats = materialise(rule_statistics(texts, "_text").drop("_text"), "quality-statistics")
    model = fit_quality(stats, labels, "_id")

    def make():
        def work(texts):
            rows = np.array([statistics(t.as_py()) for t in texts], float).reshape(-1, len(BASE) + len(SHARES))
            n, repeat = rows[:, 0], rows[:, len(BASE) - 1]
            good = (n >= MIN_WORDS) & (100 * repeat <= MAX_REPEAT_PERCENT * n)
            return [pa.array(good & (model.anomaly(rows[:, len(BASE) :]) <= model.threshold), pa.bool_())]

        return work

    flag = unused(docs, "quality_kept")
    return with_columns(docs, [text_col], [(flag, "boolean")], make).where(F.col(flag)).select(*quoted(docs.columns))


def op1_forest(spark, sf_dir: str) -> DataFrame:
    """All documents, calibrated on all labels."""
    out = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *(n for n, _ in BASE), "base_failed", "kept")


QUERIES = {"op1_forest": Query(op1_forest)}
