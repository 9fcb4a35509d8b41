"""Labelled examples to a saved sentiment classifier (Spark ML)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatloom.functions import fixed
from chatloom.operators.features import HashedWords

# One candidate per training pass, each with a stronger penalty.
PENALTIES = (0.001, 0.01, 0.1)
HASH_FEATURES = 1 << 16
MAX_ITERATIONS = 10


@dataclass
class TrainedClassifier:
    model: PipelineModel
    accuracies: list[tuple[float, float]]
    test_predictions: DataFrame


def encode_labels(df: DataFrame, label: str = "label", out: str = "label_id") -> tuple[DataFrame, StringIndexerModel]:
    """Classes in ascending order become 0..n-1. Only the class list reaches the driver."""
    indexer = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="error")
    fitted = indexer.fit(df)
    return fitted.transform(df), fitted


def class_counts(encoded: DataFrame, label: str = "label", label_id: str = "label_id") -> DataFrame:
    """`(label, label_id, n)`."""
    return encoded.groupBy(label, label_id).agg(F.count("*").alias("n"))


def is_test_text(text: Column, percent: int = fixed.TEST_PERCENT) -> Column:
    """Hash split: stable under any layout, and equal texts stay on one side."""
    digits = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")
    return digits % 100 < percent


def split_examples(df: DataFrame, text: str = "text", percent: int = fixed.TEST_PERCENT) -> tuple[DataFrame, DataFrame]:
    test = is_test_text(F.col(text), percent)
    return df.filter(~test), df.filter(test)


def split_sizes(df: DataFrame, text: str = "text", percent: int = fixed.TEST_PERCENT) -> DataFrame:
    test = is_test_text(F.col(text), percent)
    return df.agg(
        F.count("*").alias("total"), F.count_if(~test).alias("train"), F.count_if(test).alias("test")
    )


def feature_stages(text: str = "text", features: int = HASH_FEATURES) -> list:
    """Hashed one- and two-word counts with inverse document frequency."""
    return [
        HashedWords(inputCol=text, outputCol="_h", numFeatures=features),
        IDF(inputCol="_h", outputCol="features", minDocFreq=1),
    ]


def fit_classifier(
    df: DataFrame,
    text: str = "text",
    label: str = "label",
    penalties: Sequence[float] = PENALTIES,
    max_iter: int = MAX_ITERATIONS,
    features: int = HASH_FEATURES,
) -> TrainedClassifier:
    """Fit on the train side, keep the candidate with the best accuracy on the test side.

    The returned model maps `text` to `predicted_name`; it holds no label stage, so it scores
    unlabelled messages.
    """
    encoded, indexer = encode_labels(df.select(text, label))
    train, test = split_examples(encoded, text)
    prepared = Pipeline(stages=feature_stages(text, features)).fit(train)
    wanted = ("label_id", "features")
    # Three fits read the train side; a lost block is recomputed from its source.
    train_set = prepared.transform(train).select(*wanted).persist(StorageLevel.MEMORY_AND_DISK)
    test_set = prepared.transform(test).select(*wanted).persist(StorageLevel.MEMORY_AND_DISK)
    evaluator = MulticlassClassificationEvaluator(labelCol="label_id", predictionCol="prediction", metricName="accuracy")
    learner = LogisticRegression(featuresCol="features", labelCol="label_id", maxIter=max_iter)
    fitted = [(p, learner.copy({learner.regParam: p}).fit(train_set)) for p in penalties]
    scored = [(p, model, evaluator.evaluate(model.transform(test_set))) for p, model in fitted]
    _, best, _ = max(scored, key=lambda s: s[2])
    namer = IndexToString(inputCol="prediction", outputCol="predicted_name", labels=list(indexer.labels))
    pipeline = PipelineModel(stages=[*prepared.stages, best, namer])
    predictions = pipeline.transform(test).select(text, label, "predicted_name")
    train_set.unpersist()
    test_set.unpersist()
    return TrainedClassifier(pipeline, [(p, a) for p, _, a in scored], predictions)


def evaluate_predictions(predictions: DataFrame, label: str = "label", predicted: str = "predicted_name") -> DataFrame:
    """`(n, accuracy)`."""
    hit = F.when(F.col(predicted) == F.col(label), 1.0).otherwise(0.0)
    return predictions.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def candidate_table(spark: SparkSession, trained: TrainedClassifier) -> DataFrame:
    """`(penalty, accuracy)` of every candidate; one row per training pass."""
    return spark.createDataFrame(trained.accuracies, "penalty double, accuracy double")


def held_out_confusion(predictions: DataFrame, label: str = "label", predicted: str = "predicted_name") -> DataFrame:
    """`(label, predicted, n)` of the test side."""
    return predictions.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
