"""Multinomial boosting against its definition, and against one model per class."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabloom import load_model, predict, save_model, train_model
from tabloom.plans import boosting

PARAMS = {"n_estimators": 12, "learning_rate": 0.3, "max_depth": 3, "subsample": 1.0}


@pytest.fixture(scope="module")
def points(spark):
    """Three classes that two of four features tell apart, up to some noise."""
    random = np.random.default_rng(7)
    x = random.normal(size=(900, 4))
    label = np.where(x[:, 0] + 0.1 * random.normal(size=900) > 0.5, 2, np.where(x[:, 1] > 0, 1, 0))
    rows = [(int(c), *map(float, v)) for c, v in zip(label, x)]
    return spark.createDataFrame(rows, "kind int, a double, b double, c double, d double").repartition(4).persist()


@pytest.fixture(scope="module")
def matrix(points):
    return points.select(F.col("kind").cast("double").alias("_label"), array_to_vector(F.array("a", "b", "c", "d")).alias("_features"))


def plain_rounds(x, label, edges, rounds, rate):
    """The same boosting on one machine: splits searched one by one, leaves by the Newton step."""
    k = int(label.max()) + 1
    codes = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
    prior = np.bincount(label, minlength=k) / len(label)
    scores = np.tile(np.log(prior), (len(x), 1))
    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        step = np.zeros_like(scores)
        for c in range(k):
            g = (label == c) - p[:, c]
            parts = [np.arange(len(x))]
            for _ in range(3):
                split = []
                for rows in parts:
                    best, cut = 1e-12, None
                    for j in range(x.shape[1]):
                        for b in range(len(edges[j])):
                            left = codes[j, rows] <= b
                            n = left.sum()
                            if 0 < n < len(rows):
                                gain = g[rows[left]].sum() ** 2 / n + g[rows[~left]].sum() ** 2 / (len(rows) - n) - g[rows].sum() ** 2 / len(rows)
                                if gain > best + 1e-12:
                                    best, cut = gain, left
                    split += [rows, rows[:0]] if cut is None else [rows[cut], rows[~cut]]
                parts = split
            for rows in parts:
                h = (np.abs(g[rows]) * (1 - np.abs(g[rows]))).sum()
                if h > 1e-12:
                    step[rows, c] = (k - 1) / k * g[rows].sum() / h
        scores += rate * step
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_against_plain_rounds(matrix, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    monkeypatch.setattr(boosting, "CHUNK", 100)
    model = boosting.fit(matrix, 3, 900, PARAMS | {"n_estimators": 5, "max_bins": 8}, 1)
    rows = matrix.select("_label", vector_to_array("_features").alias("x"), model.probabilities("_features").alias("p")).collect()
    x, label = np.array([r.x for r in rows]), np.array([int(r["_label"]) for r in rows])
    want = plain_rounds(x, label, model.edges, 5, 0.3)
    assert np.abs(np.array([r.p for r in rows]) - want).max() < 1e-8
    assert model.featureImportances.toArray().sum() == pytest.approx(1.0)
    assert set(model.featureImportances.toArray().argsort()[-2:]) == {0, 1}


def test_log_loss_is_not_above_one_model_per_class(matrix):
    model = boosting.fit(matrix, 3, 900, PARAMS, 1)
    shared = matrix.select(F.avg(-F.log(F.element_at(model.probabilities("_features"), F.col("_label").cast("int") + 1)))).first()[0]
    each = matrix
    for c in range(3):
        own = matrix.withColumn("_label", (F.col("_label") == c).cast("double"))
        one = GBTClassifier(maxIter=12, stepSize=0.3, maxDepth=3, labelCol="_label", featuresCol="_features", seed=1).fit(own)
        one = one.setPredictionCol(f"q{c}").setRawPredictionCol(f"r{c}").setProbabilityCol(f"p{c}")
        each = one.transform(each)
    each = each.withColumn("p", F.array(*[vector_to_array(f"p{c}")[1] for c in range(3)]))
    own = F.element_at("p", F.col("_label").cast("int") + 1) / F.aggregate("p", F.lit(0.0), lambda a, b: a + b)
    assert shared < math.log(3) and shared <= each.select(F.avg(-F.log(own))).first()[0]


def test_training_saving_and_scoring(spark, points, tmp_path):
    result = train_model(points, "kind", algorithm="gradient_boosting", params={"n_estimators": 6}, cv_folds=2)
    assert result.metrics["accuracy"] > 0.85 and result.metrics["roc_auc"] > 0.9
    assert len(result.cv_scores["cv_scores"]) == 2 and result.feature_importance[0][0] in ("a", "b")
    model, _ = load_model(spark, save_model(spark, result, str(tmp_path / "m")))
    scored = predict(model, points.withColumn("id", F.monotonically_increasing_id()), "id")
    assert scored.where("abs(probability_0 + probability_1 + probability_2 - 1) > 1e-9").count() == 0
    again = predict(result.model, points.withColumn("id", F.monotonically_increasing_id()), "id")
    assert scored.exceptAll(again).count() == 0


def test_parameters(matrix):
    some = boosting.fit(matrix, 3, 900, PARAMS | {"n_estimators": 2, "subsample": 0.5, "max_features": "sqrt", "min_samples_leaf": 400}, 3)
    # With leaves of 400 rows of 900 a node is split at most once on its way down.
    assert all((t.bin < 255).sum(axis=1).max() <= 1 for t in some.rounds)
    unseen = boosting.fit(matrix, 4, 900, PARAMS | {"n_estimators": 1}, 3)
    p = np.array(matrix.limit(5).select(unseen.probabilities("_features")).collect()).reshape(5, 4)
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-12 and p[:, 3].max() < 1e-3
