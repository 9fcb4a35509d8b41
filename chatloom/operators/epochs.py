"""Classifiers trained in epochs: mini-batch descent with weight decay, a falling learning rate and the best epoch kept.

The examples are turned into hashed word features once and written by batch. A step reads the files of its batch: every task sums
the gradient of its rows, Spark adds the sums by feature, and the driver moves the weights (features x classes, bounded by the
hash) and sends them out again. Sums travel as whole numbers, rounded per row and feature, so any layout gives the same model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import IndexToString, Normalizer
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatloom.functions import fixed
from chatloom.operators import training
from chatloom.session import materialise, scratch_dir

EPOCHS = 3
# Steps of an epoch; a batch holds that share of the training rows.
BATCHES = 8
RATE = 8.0
WEIGHT_DECAY = 1e-4
MOMENTUM = 0.9
PRECISION = 24
# Of a hundred texts these calibrate a two-class model; they neither train nor test it.
CALIBRATION_PERCENT = 10
TEST, CALIBRATION = -1, -2
BINS = 10
# Feature vectors of length one: long texts pull no harder than short ones.
UNIT = "unit_features"


@dataclass
class EpochClassifier:
    """`epochs` has a row per epoch; `test_predictions` are the held-out rows under the kept one."""

    model: PipelineModel
    epochs: list[tuple[int, float, float, float]]
    best_epoch: int
    test_predictions: DataFrame
    classes: list[str]


# --- rows of numbers --------------------------------------------------------------


def text_place(text: Column) -> Column:
    """0 to 99 from the text alone: stable under any layout, equal texts stay together."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint") % 100


def part_of(text: Column, batches: int, percent: int = fixed.TEST_PERCENT, calibration: int = 0) -> Column:
    """The batch of a training text, or TEST or CALIBRATION."""
    place = text_place(text)
    batch = F.conv(F.substring(F.md5(text), 9, 7), 16, 10).cast("bigint") % batches
    return F.when(place < percent, TEST).when(place < percent + calibration, CALIBRATION).otherwise(batch).cast("int")


# What a step reads of a row.
NUMBERS = ("label_id", "places", "numbers")
ROWS = "label_id int, places array<int>, numbers array<double>, {keep}part int"


def number_rows(vectors: DataFrame, features: str = "features", keep: str = "") -> DataFrame:
    """Sparse feature vectors as lists of places and numbers; `keep` columns (`name type, …`) go along."""
    names = ["label_id", "places", "numbers", *(c.split()[0] for c in keep.split(",") if c.strip()), "part"]
    others = names[3:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column(0)
            ids, places, numbers = batch.column(1), vector.field("indices"), vector.field("values")
            if vector.null_count or places.null_count:
                raise ValueError("features must be sparse vectors")
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int32()), places, numbers, *(batch.column(2 + i) for i in range(len(others))), batch.column(2 + len(others))], names=names)

    rows = vectors.select(features, F.col("label_id").cast("int").alias("label_id"), *others, "part")
    return rows.mapInArrow(run, ROWS.format(keep=keep))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, the row of each number, its place, and the number."""
    places, numbers = batch.column(1), batch.column(2)
    parents = pc.list_parent_indices(places).to_numpy()
    return batch.column(0).to_numpy(), parents, places.flatten().to_numpy(), numbers.flatten().to_numpy()


def logits_of(weights: np.ndarray, bias: np.ndarray, rows: int, parents: np.ndarray, places: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    out = np.empty((rows, len(bias)))
    for c in range(len(bias)):
        out[:, c] = np.bincount(parents, numbers * weights[places, c], rows) + bias[c]
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


# --- descent ----------------------------------------------------------------------


def gradient(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Sums over the rows of the gradient of the log loss by weights and bias, the number of rows and the loss."""
    classes = len(bias)
    held = rows.sparkSession.sparkContext.broadcast((weights, bias))
    names = ["place", *(f"g{c}" for c in range(classes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        total = np.zeros((len(weights) + 2, classes), np.int64)  # then the bias, then rows and loss
        for batch in batches:
            labels, parents, places, numbers = _flat(batch)
            n = len(labels)
            shares = softmax(logits_of(weights, bias, n, parents, places, numbers))
            error = shares.copy()
            error[np.arange(n), labels] -= 1
            for c in range(classes):
                parts = np.rint(numbers * error[parents, c] * (1 << PRECISION))
                total[:-2, c] += np.bincount(places, parts, len(weights)).astype(np.int64)
                total[-2, c] += int(np.rint(error[:, c] * (1 << PRECISION)).sum())
            loss = -np.log(np.maximum(shares[np.arange(n), labels], 1e-300))
            total[-1, :2] += [n, int(np.rint(loss * (1 << PRECISION)).sum())]
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *map(pa.array, total[used].T)], names=names)

    sums = rows.select(*NUMBERS).mapInArrow(run, "place long, " + ", ".join(f"g{c} long" for c in range(classes)))
    found = sums.groupBy("place").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()
    held.destroy()
    total = np.zeros((len(weights) + 2, classes))
    total[found["place"].to_numpy()] = np.column_stack([found[c].to_numpy() for c in names[1:]])
    scale = 1 << PRECISION
    return total[:-2] / scale, total[-2] / scale, int(total[-1, 0]), total[-1, 1] / scale


def with_prediction(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """`rows` without their numbers, with the class of the greatest logit and, of two classes, the margin of the second."""
    kept = [f for f in rows.schema.fields if f.name not in ("places", "numbers")]
    names = [*(f.name for f in kept), "predicted_id", "margin"]
    at = [rows.columns.index(f.name) for f in kept]
    held = rows.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, parents, places, numbers = _flat(batch)
            logits = logits_of(*held.value, len(labels), parents, places, numbers)
            margin = logits[:, 1] - logits[:, 0] if logits.shape[1] == 2 else np.sort(logits, 1)[:, -1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(logits.argmax(1).astype(np.int32)), pa.array(margin)], names=names)

    schema = rows.select(*(f.name for f in kept), F.lit(0).alias("predicted_id"), F.lit(0.0).alias("margin")).schema
    return rows.mapInArrow(run, schema)


@dataclass
class Descent:
    """Descent with momentum, a rate that falls to zero over `steps`, and weight decay beside the gradient."""

    shapes: Sequence[tuple[int, ...]]
    steps: int
    rate: float = RATE
    decay: float = WEIGHT_DECAY
    step: int = 0

    def __post_init__(self) -> None:
        self.speed = [np.zeros(s) for s in self.shapes]

    def current_rate(self) -> float:
        return self.rate * (1 - self.step / self.steps)

    def move(self, values: Sequence[np.ndarray], gradients: Sequence[np.ndarray]) -> None:
        rate = self.current_rate()
        self.step += 1
        for value, g, speed in zip(values, gradients, self.speed):
            speed *= MOMENTUM
            speed += g
            # the step looks ahead along the new speed; a bias doesn't decay
            value -= rate * (g + MOMENTUM * speed + (self.decay * value if value.ndim > 1 else 0))


def descend(
    batches: Sequence[DataFrame], test: DataFrame, features: int, classes: int, epochs: int = EPOCHS, rate: float = RATE, decay: float = WEIGHT_DECAY
) -> tuple[np.ndarray, np.ndarray, list[tuple[int, float, float, float]], int]:
    """Weights and bias of the best epoch (by held-out accuracy, of equal ones the first), a row per epoch, and its number.

    An epoch's row: number, rate of its last step, mean loss of its batches as they came, held-out accuracy.
    """
    weights, bias = np.zeros((features, classes)), np.zeros(classes)
    descent = Descent((weights.shape, bias.shape), epochs * len(batches), rate, decay)
    rows, best = [], None
    for epoch in range(1, epochs + 1):
        seen, lost, last = 0, 0.0, 0.0
        for batch in batches:
            by_weight, by_bias, n, loss = gradient(batch, weights, bias)
            last = descent.current_rate()
            descent.move((weights, bias), (by_weight / max(n, 1), by_bias / max(n, 1)))
            seen, lost = seen + n, lost + loss
        hit = with_prediction(test.select(*NUMBERS), weights, bias).agg(F.avg((F.col("predicted_id") == F.col("label_id")).cast("double"))).first()[0]
        rows.append((epoch, float(last), float(lost) / max(seen, 1), float(hit or 0.0)))
        if best is None or rows[-1][3] > rows[best[2] - 1][3]:
            best = weights.copy(), bias.copy(), epoch
    return best[0], best[1], rows, best[2]


def as_stage(spark: SparkSession, weights: np.ndarray, bias: np.ndarray) -> LogisticRegressionModel:
    """Weights and bias as a stage of a Spark ML pipeline, which can be saved and loaded."""
    jvm, sc = spark._jvm, spark.sparkContext
    matrix = DenseMatrix(weights.shape[1], weights.shape[0], weights.T.ravel().tolist(), True)
    java = jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"epochs_{zlib.crc32(weights.tobytes()):08x}", _py2java(sc, matrix), _py2java(sc, DenseVector(bias)), len(bias), True
    )
    return LogisticRegressionModel(java).setFeaturesCol(UNIT)


def _prepared(df: DataFrame, text: str, label: str, features: int, batches: int, calibration: int):
    """Labels and feature stages, and the rows of numbers in a folder for each part."""
    df = df.select(text, label).where(F.col(text).isNotNull() & F.col(label).isNotNull())
    encoded, indexer = training.encode_labels(df, label)
    parted = encoded.withColumn("part", part_of(F.col(text), batches, calibration=calibration))
    unit = Normalizer(inputCol="features", outputCol=UNIT)
    stages = Pipeline(stages=[*training.feature_stages(text, features), unit]).fit(parted.where("part >= 0"))
    path = scratch_dir(df.sparkSession, "epochs-rows")
    keep = f"{text} string, {label} {df.schema[label].dataType.simpleString()}, "
    # the texts of the other parts are not read again
    said = F.when(F.col("part") == TEST, F.col(text)).alias(text)
    rows = stages.transform(parted).select(said, label, "label_id", UNIT, "part")
    number_rows(rows, UNIT, keep=keep).write.partitionBy("part").parquet(path)
    spark = df.sparkSession

    def part(number: int) -> DataFrame:
        return spark.read.parquet(path).where(F.col("part") == number).drop("part")

    return stages, list(indexer.labels), part


def train_epochs(
    df: DataFrame, text: str = "text", label: str = "label", epochs: int = EPOCHS, batches: int = BATCHES, rate: float = RATE,
    decay: float = WEIGHT_DECAY, features: int = training.HASH_FEATURES,
) -> EpochClassifier:
    """Train on the train side, score the test side after each epoch, keep the best epoch.

    Rows without text or label teach nothing. The model maps `text` to `predicted_name` and holds no label stage. The features
    of a text are worked out once, for training and test alike.
    """
    spark = df.sparkSession
    stages, classes, part = _prepared(df, text, label, features, batches, 0)
    test = part(TEST)
    weights, bias, rows, best = descend([part(b) for b in range(batches)], test, 2 * features, len(classes), epochs, rate, decay)
    namer = IndexToString(inputCol="prediction", outputCol="predicted_name", labels=classes)
    model = PipelineModel(stages=[*stages.stages, as_stage(spark, weights, bias), namer])
    return EpochClassifier(model, rows, best, _named(with_prediction(test, weights, bias), classes, text, label), classes)


def _named(predicted: DataFrame, classes: list[str], text: str, label: str) -> DataFrame:
    names = F.array(*map(F.lit, classes))
    return predicted.select(text, label, F.get(names, F.col("predicted_id")).alias("predicted_name"), "margin")


def epoch_table(spark: SparkSession, trained: EpochClassifier) -> DataFrame:
    """`(epoch, learning_rate, train_loss, accuracy, kept)`."""
    rows = [(*r, r[0] == trained.best_epoch) for r in trained.epochs]
    return spark.createDataFrame(rows, "epoch int, learning_rate double, train_loss double, accuracy double, kept boolean")


# --- two classes ------------------------------------------------------------------


@dataclass
class TwoClassModel:
    """A fitted pipeline whose probabilities are calibrated: `1 / (1 + exp(-(slope * margin + offset)))` of the second class."""

    model: PipelineModel
    slope: float
    offset: float
    test: DataFrame
    epochs: list[tuple[int, float, float, float]]


def calibrate(rows: DataFrame, margin: str = "margin", second: str = "second", rounds: int = 25) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, class) rows, by Newton's method on five sums per round.

    Targets are drawn in from 0 and 1 by the counts of both classes, so a margin that parts them all still has an end. Without rows of
    both classes the margin stays as it is.
    """
    is_second = F.col(second)
    counts = rows.agg(F.count_if(is_second), F.count_if(~is_second)).first()
    if not counts[0] or not counts[1]:
        return 1.0, 0.0
    high, low = (counts[0] + 1) / (counts[0] + 2), 1 / (counts[1] + 2)
    slope, offset = 0.0, float(np.log((counts[0] + 1) / (counts[1] + 1)))
    m, target = F.col(margin), F.when(is_second, high).otherwise(low)
    for _ in range(rounds):
        z = m * slope + offset
        p = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
        error, spread = p - target, p * (1 - p)
        g_slope, g_offset, h_ss, h_so, h_oo = rows.agg(
            F.sum(error * m), F.sum(error), F.sum(spread * m * m), F.sum(spread * m), F.sum(spread)
        ).first()
        h_ss, h_oo = h_ss + 1e-9, h_oo + 1e-9
        det = h_ss * h_oo - h_so * h_so
        step = (h_oo * g_slope - h_so * g_offset) / det, (h_ss * g_offset - h_so * g_slope) / det
        # a long step is shortened: far out the curve is flat and Newton's method leaps
        size = max(1.0, abs(step[0]) / 2, abs(step[1]) / 2)
        slope, offset = slope - step[0] / size, offset - step[1] / size
        if max(map(abs, step)) < 1e-8:
            break
    return slope, offset


def train_two_class(
    df: DataFrame, text: str = "text", label: str = "label", classes: tuple[str, str] = ("negative", "positive"), epochs: int = EPOCHS,
    batches: int = BATCHES, features: int = training.HASH_FEATURES,
) -> TwoClassModel:
    """A learner of two classes (other rows teach nothing), calibrated on held-out rows that neither train nor test it."""
    spark = df.sparkSession
    stages, found, part = _prepared(df.where(F.col(label).isin(*classes)), text, label, features, batches, CALIBRATION_PERCENT)
    if len(found) != 2:
        raise ValueError(f"rows of both classes are needed, there are {found}")
    weights, bias, rows, _ = descend([part(b) for b in range(batches)], part(TEST), 2 * features, 2, epochs)
    margins = materialise(with_prediction(part(CALIBRATION).select(*NUMBERS), weights, bias).select("margin", (F.col("label_id") == 1).alias("second")), "two-class-margins")
    slope, offset = calibrate(margins)
    # the difference of both logits becomes slope * margin + offset
    stage = as_stage(spark, weights * slope, bias * slope + np.array([-offset / 2, offset / 2]))
    namer = IndexToString(inputCol="prediction", outputCol="predicted_name", labels=found)
    test = with_prediction(part(TEST), weights, bias)
    z = F.col("margin") * slope + offset
    test = _named(test, found, text, label).withColumn("probability", 1 / (1 + F.exp(-z))).withColumn("second", F.col(label) == found[1])
    return TwoClassModel(PipelineModel(stages=[*stages.stages, stage, namer]), slope, offset, test, rows)


def calibration_table(scored: DataFrame, probability: str = "probability", second: str = "second", bins: int = BINS) -> DataFrame:
    """`(bin, n, mean_probability, share)`: how often the second class is right where the model says so."""
    place = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(place.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(probability).alias("mean_probability"), F.avg(F.col(second).cast("double")).alias("share")
    )
