"""Training in epochs and the calibrated two-class model."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.sql import functions as F

from chatloom.functions.text import NOT_WORD
from chatloom.operators import epochs, features, sentiment, training
from tests.conftest import rows

WORDS = {"positive": "great lovely", "negative": "awful boring", "neutral": "starts now"}


def examples(spark, n=80, noise=0.0, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        for label in WORDS:
            said = rng.choice(list(WORDS)) if rng.random() < noise else label
            data.append((f"{WORDS[said]} stream number {i} {rng.randint(0, 9)}", label))
    return spark.createDataFrame([*data, (None, "positive"), ("text", None)], "text string, label string")


def number_frame(spark, n=30, features=12, classes=3, seed=2):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        places = sorted(rng.sample(range(features), rng.randint(0, 5)))
        data.append((rng.randrange(classes), places, [rng.uniform(0.5, 3) for _ in places], f"t{i}"))
    return spark.createDataFrame(data, "label_id int, places array<int>, numbers array<double>, text string")


def plain_loss(data, weights, bias):
    total = 0.0
    for r in data:
        logits = [bias[c] + sum(x * weights[p, c] for p, x in zip(r["places"], r["numbers"])) for c in range(len(bias))]
        top = max(logits)
        total += math.log(sum(math.exp(z - top) for z in logits)) + top - logits[r["label_id"]]
    return total


@pytest.mark.parametrize("size", [1 << 16, 1000])
def test_hashed_words_equal_the_stages_of_spark(spark, monkeypatch, size):
    """Texts of any letters and lengths, in blocks of a few texts; no row is cut into strings by the JVM."""
    monkeypatch.setattr(features, "BLOCK_BYTES", 100)
    rng = random.Random(5)
    letters = "abcXYZ \t\n._-'0123ÀéİıΣςσß中文字٣½\u00a0\u0301😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["", " ", "...", "a", "ΑΣ ΑΣΑ. ΣΑΣ", "x" * 3000, "word " * 500, "end", "begin again"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    plain = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_w", pattern=NOT_WORD, minTokenLength=1), NGram(inputCol="_w", outputCol="_w2", n=2),
        HashingTF(inputCol="_w", outputCol="_h1", numFeatures=size), HashingTF(inputCol="_w2", outputCol="_h2", numFeatures=size),
        VectorAssembler(inputCols=["_h1", "_h2"], outputCol="want"),
    ]).fit(frame).transform(frame).select("id", "text", "want")
    got = features.HashedWords(inputCol="text", outputCol="got", numFeatures=size).transform(plain)
    for r in got.collect():
        assert r["got"] == r["want"] and r["got"].size == 2 * size, r["text"]
    stages = training.feature_stages("text", size)
    assert not any(isinstance(s, (RegexTokenizer, NGram, HashingTF)) for s in stages)


def test_steps_read_no_text(spark):
    read = []
    frame = number_frame(spark).withColumn("text", F.udf(lambda t: read.append(t) or 1 / 0)("text"))
    assert epochs.gradient(frame, np.zeros((12, 3)), np.zeros(3))[2] == 30


def test_gradients_equal_differences_of_the_loss_for_any_layout(spark):
    rng = np.random.default_rng(0)
    weights, bias = rng.normal(size=(12, 3)), rng.normal(size=3)
    frame = number_frame(spark)
    data = frame.collect()
    by_weight, by_bias, n, loss = epochs.gradient(frame.repartition(1), weights, bias)
    assert n == 30 and loss == pytest.approx(plain_loss(data, weights, bias), abs=1e-4)
    for array, found in ((weights, by_weight), (bias, by_bias)):
        for at in np.ndindex(array.shape):
            keep, step, sides = array[at], 1e-5, []
            for d in (step, -step):
                array[at] = keep + d
                sides.append(plain_loss(data, weights, bias))
            array[at] = keep
            assert found[at] == pytest.approx((sides[0] - sides[1]) / (2 * step), abs=1e-4)
    again = epochs.gradient(frame.repartition(7), weights, bias)
    assert (again[0] == by_weight).all() and (again[1] == by_bias).all() and again[3] == loss
    nothing = epochs.gradient(frame.limit(0), weights, bias)
    assert nothing[2] == 0 and not nothing[0].any()


def test_rate_falls_and_weights_decay():
    descent = epochs.Descent(((1, 1), (1,)), 10, rate=0.5, decay=0.2)
    values = [np.ones((1, 1)), np.ones(1)]
    rates = []
    for _ in range(10):
        rates.append(descent.current_rate())
        descent.move(values, [np.zeros((1, 1)), np.zeros(1)])
    assert rates[0] == 0.5 and rates[-1] == pytest.approx(0.05) and sorted(rates, reverse=True) == rates
    assert values[0][0, 0] == pytest.approx(np.prod([1 - r * 0.2 for r in rates])) and values[1][0] == 1


def test_best_epoch_is_kept_and_the_model_repeats(spark, tmp_path):
    df = examples(spark, noise=0.2)
    trained = epochs.train_epochs(df, epochs=3, batches=4, features=1 << 8)
    again = epochs.train_epochs(df.repartition(5), epochs=3, batches=4, features=1 << 8)
    assert trained.epochs == again.epochs and len(trained.epochs) == 3
    table = epochs.epoch_table(spark, trained).collect()
    assert sum(r["kept"] for r in table) == 1
    assert max(r["accuracy"] for r in table) == next(r["accuracy"] for r in table if r["kept"])
    assert table[-1]["train_loss"] < table[0]["train_loss"] and table[0]["learning_rate"] > table[-1]["learning_rate"]
    held = training.evaluate_predictions(trained.test_predictions).first()
    assert held["accuracy"] == trained.epochs[trained.best_epoch - 1][3] > 0.6
    # the held-out rows are those of the hash split, and the saved pipeline says what the epochs said
    _, test = training.split_examples(df.na.drop())
    assert held["n"] == test.count()
    training.save_model(trained.model, str(tmp_path / "m"))
    scored = training.load_model(str(tmp_path / "m")).transform(test).select("text", "label", "predicted_name")
    assert rows(scored) == rows(trained.test_predictions.select("text", "label", "predicted_name"))


def test_calibration_finds_the_curve(spark):
    rng = random.Random(4)
    data = []
    for _ in range(4000):
        margin = rng.uniform(-6, 6)
        data.append((margin, rng.random() < 1 / (1 + math.exp(-(0.5 * margin + 0.7)))))
    frame = spark.createDataFrame(data, "margin double, second boolean").cache()
    slope, offset = epochs.calibrate(frame)
    assert slope == pytest.approx(0.5, abs=0.06) and offset == pytest.approx(0.7, abs=0.12)
    table = epochs.calibration_table(frame.withColumn("probability", 1 / (1 + F.exp(-(F.col("margin") * slope + offset)))))
    for r in table.where("n > 200").collect():
        assert r["mean_probability"] == pytest.approx(r["share"], abs=0.08)
    # parted margins still have an end, one class alone has no curve
    assert 0 < epochs.calibrate(spark.createDataFrame([(-1.0, False), (1.0, True)], "margin double, second boolean"))[0] < 50
    assert epochs.calibrate(frame.where("second")) == (1.0, 0.0)


def test_two_class_model_is_saved_loaded_and_scores(spark, tmp_path):
    df = examples(spark, n=200, noise=0.3)
    fitted = epochs.train_two_class(df, epochs=2, batches=3, features=1 << 8)
    training.save_model(fitted.model, str(tmp_path / "two"))
    model = training.load_model(str(tmp_path / "two"))
    chat = spark.createDataFrame([(1, "great lovely stream"), (2, " "), (3, None), (4, "awful boring stream")], "msg_key int, message string")
    got = {r["msg_key"]: r["sentiment"] for r in sentiment.run_sentiment(chat, "bert", model=model).collect()}
    assert got == {1: "positive", 2: "unknown", 3: "unknown", 4: "negative"}
    # the pipeline's probability is the calibrated one
    scored = model.transform(fitted.test.select("text", F.col("probability").alias("said"))).select("said", F.col("probability").alias("vector")).collect()
    assert scored and all(r["vector"][1] == pytest.approx(r["said"], abs=1e-9) for r in scored)
    table = epochs.calibration_table(fitted.test).collect()
    assert sum(r["n"] for r in table) == fitted.test.count() and 0 < fitted.slope
    with pytest.raises(ValueError, match="both classes"):
        epochs.train_two_class(df.where("label = 'positive'"))
