"""Predicted against actual labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.functions.text import strip

KEYS = ("timestamp", "username", "message_text")
# Rows of the join that one piece of a hot key makes.
PIECE_ROWS = 10_000


def trimmed_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.withColumns({k: strip(F.col(k)) for k in keys})


def matched_pairs(predicted: DataFrame, actual: DataFrame, keys: Sequence[str] = KEYS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Inner equi-join on trimmed keys; null keys match each other, duplicate keys multiply.

    `keys` may be `("msg_id",)` when both sides have a unique id. Both sides are folded to one row per key and label with its count
    before they meet on a digest of the keys, so a key that holds a third of both sides is a few rows there, and how many rows
    it will make is known exactly. Only then are they made: as pieces of at most `piece_rows`, as many as the key needs, dealt to
    all tasks. Nothing is drawn by chance, so a task that runs again makes the same rows. The multiplied rows are the contract
    here; the counts below never build them.
    """
    p = trimmed_keys(predicted, keys).groupBy(*keys, "predicted_label").agg(F.count("*").alias("_p"))
    a = _folded(actual, "actual_label", keys).withColumnRenamed("n", "_a")
    pairs = p.withColumn("_key", key_digest(keys)).join(a, "_key").withColumn("_rows", F.col("_p") * F.col("_a"))
    whole, rest = F.floor(F.col("_rows") / piece_rows), F.col("_rows") % piece_rows
    single = pairs.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), whole)))
    pieces = single.withColumn("_size", F.when(F.col("_piece") < whole, piece_rows).otherwise(rest).cast("int")).where("_size > 0")
    made = [*keys, "predicted_label", "actual_label"]
    # pieces of a key differ in their number, so they are dealt apart; the small ones go with their digest
    dealt = pieces.repartition("_key", "predicted_label", "actual_label", "_piece")
    return dealt.select(*made, F.explode(F.array_repeat(F.lit(0), F.col("_size"))).alias("_copy")).select(*made)


def differs() -> Column:
    """Case-insensitive; a null label counts as the text `nan` on either side."""
    p = F.lower(F.coalesce(F.col("predicted_label"), F.lit("nan")))
    a = F.lower(F.coalesce(F.col("actual_label"), F.lit("nan")))
    return p != a


def differences(pairs: DataFrame) -> DataFrame:
    return pairs.filter(differs())


def pair_counts(predicted: DataFrame, actual: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """`(predicted_label, actual_label, n)` of the join, without building the join.

    Each side is folded to `(keys, label, n)` first, so a key repeated a million times on both
    sides is one row per label instead of 10^12 pairs. The long text is replaced by the hash
    of all keys before the shuffle.
    """
    p = _folded(predicted, "predicted_label", keys).withColumnRenamed("n", "n_predicted")
    a = _folded(actual, "actual_label", keys).withColumnRenamed("n", "n_actual")
    return (
        p.join(a, "_key")
        .groupBy("predicted_label", "actual_label")
        .agg(F.sum(F.col("n_predicted") * F.col("n_actual")).cast("bigint").alias("n"))
    )


def key_digest(keys: Sequence[str]) -> Column:
    """Sha-256 of all trimmed keys; the JSON form keeps null apart from empty text."""
    trimmed = F.struct(*[strip(F.col(k)).alias(k) for k in keys])
    return F.sha2(F.to_json(trimmed, {"ignoreNullFields": "false"}), 256)


def _folded(df: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    return df.select(key_digest(keys).alias("_key"), label).groupBy("_key", label).agg(F.count("*").alias("n"))


def confusion_counts(counts: DataFrame) -> DataFrame:
    """`(actual, predicted, n)` of the differing pairs; null labels dropped, case kept."""
    return counts.filter(
        differs() & F.col("actual_label").isNotNull() & F.col("predicted_label").isNotNull()
    ).select("actual_label", "predicted_label", "n")


def label_counts(df: DataFrame, label: str, side: str) -> DataFrame:
    """`(side, label, n)`, null label included."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "label", "n")


def all_label_counts(predicted: DataFrame, actual: DataFrame, counts: DataFrame) -> DataFrame:
    """Label counts of each side before and after the join."""
    def after(label: str, side: str) -> DataFrame:
        folded = counts.groupBy(F.col(label).alias("label")).agg(F.sum("n").cast("bigint").alias("n"))
        return folded.select(F.lit(side).alias("side"), "label", "n")

    return (
        label_counts(predicted, "predicted_label", "predicted")
        .unionByName(label_counts(actual, "actual_label", "actual"))
        .unionByName(after("predicted_label", "matched_predicted"))
        .unionByName(after("actual_label", "matched_actual"))
    )


def overlap_report(predicted: DataFrame, actual: DataFrame, counts: DataFrame) -> DataFrame:
    """`(measure, n)`: rows left, right, matched, differing."""
    left = predicted.agg(F.count("*").alias("n")).select(F.lit("predicted_rows").alias("measure"), "n")
    right = actual.agg(F.count("*").alias("n")).select(F.lit("actual_rows").alias("measure"), "n")
    joined = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("matched_rows"),
        F.coalesce(F.sum(F.when(differs(), F.col("n"))), F.lit(0)).cast("bigint").alias("differing_rows"),
    ).select(F.expr("stack(2, 'matched_rows', matched_rows, 'differing_rows', differing_rows) AS (measure, n)"))
    return left.unionByName(right).unionByName(joined)


def duplicate_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """`(keys, rows)` with repeated join keys: how far the key is from unique."""
    repeated = df.groupBy(key_digest(keys).alias("_key")).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return repeated.agg(F.count("*").alias("repeated_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"))


def accuracy(counts: DataFrame) -> DataFrame:
    """Share of exact hits among pairs with both labels, from pair counts."""
    both = counts.filter(F.col("predicted_label").isNotNull() & F.col("actual_label").isNotNull())
    hit = F.when(F.col("predicted_label") == F.col("actual_label"), F.col("n")).otherwise(0)
    return both.agg(F.sum("n").cast("bigint").alias("n"), (F.sum(hit) / F.sum("n")).alias("accuracy"))
