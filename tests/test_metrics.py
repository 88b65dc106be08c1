from __future__ import annotations

import math
import random

import pytest

from tabloom import compute_metrics
from tabloom.errors import EvaluationError
from tabloom.operators import metrics as M


def frame(spark, actual, prediction, *scores):
    names = ["actual", "prediction", *[f"s{i}" for i in range(len(scores))]]
    return spark.createDataFrame([tuple(r) for r in zip(actual, prediction, *scores)], names)


def values(df):
    return {r.metric: r.value for r in df.collect()}


def test_perfect_classes(spark):
    df = frame(spark, [0, 1, 0, 1], [0, 1, 0, 1])
    assert values(compute_metrics(df, "classification")) == {
        "accuracy": 1.0, "precision": 1.0, "recall": 1.0, "f1": 1.0
    }
    matrix = {(r.actual, r.predicted): r.n for r in M.confusion_matrix(df, "actual", "prediction").collect()}
    assert matrix == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_probabilities(spark):
    df = frame(spark, [0, 1, 0, 1], [0, 1, 1, 1], [0.1, 0.8, 0.6, 0.9])
    got = values(compute_metrics(df, "classification", probabilities={1: "s0", 0: "s0"}))
    assert got["roc_auc"] == 1.0 and got["precision"] == 0.6667 and got["recall"] == 1.0


def test_unseen_label_counts_as_an_error(spark):
    df = frame(spark, ["a", "b", "new"], ["a", "b", "a"])
    got = values(compute_metrics(df, "classification", classes=["a", "b"]))
    assert got["accuracy"] == 0.6667 and got["recall"] == 1.0  # still binary, for "b"


def test_auc_against_all_pairs(spark):
    random.seed(2)
    actual = [random.choice("abc") for _ in range(400)]
    scores = [[round(random.random(), 1) + (0.2 if y == c else 0) for y in actual] for c in "abc"]
    df = frame(spark, actual, actual, *scores)

    def brute(label, s):
        pos = [v for y, v in zip(actual, s) if y == label]
        neg = [v for y, v in zip(actual, s) if y != label]
        return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))

    each = [brute(c, s) for c, s in zip("abc", scores)]
    for rows in (None, 3):
        one = M.roc_auc(df, "actual", "s0", positive="a", rows_per_bucket=rows).first()[0]
        assert one == pytest.approx(each[0], abs=1e-4)
        names = {c: f"s{i}" for i, c in enumerate("abc")}
        mean = M.roc_auc_ovr(df, "actual", names, rows_per_bucket=rows).first()[0]
        assert mean == pytest.approx(sum(each) / 3, abs=1e-4)
        points = M.roc_curve(df, "actual", "s0", positive="a", rows_per_bucket=rows).orderBy("fpr", "tpr").collect()
        area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(points, points[1:]))
        assert area == pytest.approx(each[0], abs=1e-9)


def test_one_class_has_no_auc(spark):
    df = frame(spark, ["a", "a"], ["a", "a"], [0.1, 0.2])
    assert M.roc_auc(df, "actual", "s0", positive="a").first()[0] is None


def test_regression(spark):
    df = spark.createDataFrame([(float(v), float(v)) for v in (1, 2, 3)], "actual double, prediction double")
    assert values(compute_metrics(df, "regression")) == {"mae": 0.0, "mse": 0.0, "rmse": 0.0, "r2": 1.0}
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 8.0)], "actual double, prediction double")
    got = values(compute_metrics(df, "regression"))
    assert got["mae"] == 1.0 and got["rmse"] == 2.0 and got["r2"] == -2.2


def test_unknown_task(spark):
    with pytest.raises(EvaluationError):
        compute_metrics(frame(spark, [1], [1]), "bogus")
    with pytest.raises(EvaluationError):
        M.task_metrics("bogus")
    assert (M.task_metrics("classification").scoring, M.task_metrics("regression").scoring) == ("roc_auc_ovr", "r2")


def test_cv_summary_uses_the_population_deviation(spark):
    row = M.cv_summary(spark.createDataFrame([(0.0,), (1.0,)], "score double")).first()
    assert (row.cv_mean, row.cv_std, row.folds) == (0.5, 0.5, 2)


def test_binned_residuals_hold_every_row(spark):
    df = spark.range(100).selectExpr("id * 1.0d as actual", "id * 2.0d as prediction")
    assert M.binned_residuals(df, "actual", "prediction").agg({"n": "sum"}).first()[0] == 100


def test_dense_matrix_in_blocks_and_sparse_one(spark, monkeypatch):
    monkeypatch.setattr(M, "LABEL_BLOCK", 3)
    random.seed(5)
    actual = [random.choice("abcdefgh") for _ in range(60)] + [None]
    prediction = [random.choice("abcdxy") for _ in range(60)] + ["a"]
    df = spark.createDataFrame(list(zip(actual, prediction)), "actual string, prediction string")
    want = {(a, p): 0 for a in {*actual, *prediction} for p in {*actual, *prediction}}
    for pair in zip(actual, prediction):
        want[pair] += 1
    dense = M.confusion_matrix(df, "actual", "prediction")
    assert {(r.actual, r.predicted): r.n for r in dense.collect()} == want and dense.count() == len(want)
    sparse = M.confusion_matrix(df, "actual", "prediction", dense=False)
    assert {(r.actual, r.predicted): r.n for r in sparse.collect()} == {k: n for k, n in want.items() if n}


def test_many_labels_need_no_list(spark):
    df = spark.range(100_000).selectExpr("id as actual", "if(id % 10 = 0, id + 1, id) as prediction")
    sparse = M.confusion_matrix(df, "actual", "prediction", dense=False)
    plan = sparse._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
    assert sparse.count() == 100_000
    assert M.classification_metrics(df, "actual", "prediction").first().accuracy == 0.9


def test_scorers(spark):
    random.seed(8)
    actual = [random.choice(["no", "yes"]) for _ in range(300)]
    p = [min(1.0, max(0.0, round(random.gauss(0.65 if y == "yes" else 0.4, 0.25), 2))) for y in actual]
    prediction = ["yes" if v > 0.5 else "no" for v in p]
    df = spark.createDataFrame(list(zip(actual, prediction, p, [1 - v for v in p])), "actual string, prediction string, py double, pn double")
    value = lambda name: M.score(df, name, classes=["no", "yes"], probabilities={"no": "pn", "yes": "py"})

    def recall(label):
        return sum(a == q == label for a, q in zip(actual, prediction)) / actual.count(label)

    def precision(label):
        return sum(a == q == label for a, q in zip(actual, prediction)) / prediction.count(label)

    share = {c: actual.count(c) / 300 for c in ("no", "yes")}
    assert value("recall") == pytest.approx(recall("yes"), abs=1e-4)
    assert value("balanced_accuracy") == pytest.approx((recall("yes") + recall("no")) / 2, abs=1e-4)
    assert value("recall_weighted") == value("accuracy")
    assert value("precision_weighted") == pytest.approx(sum(share[c] * precision(c) for c in share), abs=1e-4)
    own = [min(max(v if y == "yes" else 1 - v, M.HAIR), 1 - M.HAIR) for y, v in zip(actual, p)]
    assert value("neg_log_loss") == pytest.approx(sum(math.log(v) for v in own) / 300, abs=1e-4)
    ap, recalled, total = 0.0, 0, actual.count("yes")
    for t in sorted(set(p), reverse=True):
        above = [y for y, v in zip(actual, p) if v >= t]
        hits = above.count("yes")
        ap += (hits - recalled) / total * hits / len(above)
        recalled = hits
    assert value("average_precision") == pytest.approx(ap, abs=1e-4)


def test_balanced_accuracy_leaves_out_labels_that_are_only_predicted(spark):
    df = frame(spark, ["a", "a", "b", "b"], ["a", "c", "b", "b"])
    assert M.score(df, "balanced_accuracy", classes=["a", "b", "c"]) == 0.75
    assert M.score(df, "recall_macro", classes=["a", "b", "c"]) == 0.5


def test_regression_scorers(spark):
    y, q = [1.0, 2.0, 4.0, 8.0, 16.0], [1.5, 2.0, 3.0, 9.0, 13.0]
    df = frame(spark, y, q)
    e = [a - b for a, b in zip(y, q)]
    mean = sum(e) / 5
    m = sum(y) / 5
    want = 1 - sum((v - mean) ** 2 for v in e) / sum((v - m) ** 2 for v in y)
    assert M.score(df, "explained_variance") == pytest.approx(want, abs=1e-4)
    assert M.score(df, "neg_median_absolute_error") == -1.0
    assert M.score(df, "neg_mean_absolute_error") == -1.1
    for name, classes in (("bogus", None), ("f1", ["a", "b", "c"]), ("r2", ["a", "b"])):
        with pytest.raises(EvaluationError):
            M.check_scorer(name, "classification", classes)


def test_average_precision_of_more_classes_and_of_none(spark):
    df = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.2, 0.8), ("c", 0.5, 0.5)], "actual string, s0 double, s1 double")
    assert M.average_precision(df, "actual", "s0", positive="a").first()[0] == 1.0
    assert M.average_precision(df, "actual", "s0", positive="x").first()[0] is None
    assert M.score(df.withColumn("prediction", df.actual), "average_precision", classes=["a", "b", "c"], probabilities={"a": "s0", "b": "s1", "c": "s0"}) == pytest.approx((1 + 1 + 0.5) / 3, abs=1e-4)
