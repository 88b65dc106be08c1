from __future__ import annotations

import json
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom import (
    available_models,
    compare_models,
    create_model,
    evaluate,
    evaluation_tables,
    eda_tables,
    load_model,
    predict,
    report_rows,
    save_model,
    train_model,
)
from tabloom.errors import DataError, EvaluationError, ModelError
from tabloom.plans import training as T
from tabloom.plans.registry import model_defaults

FEW = {"n_estimators": 8}


def test_names():
    assert available_models("classification") == ["logistic_regression", "random_forest", "gradient_boosting"]
    assert available_models("regression")[0] == "ridge" and len(available_models()) == 4
    for args in (("bogus", "classification"), ("ridge", "classification"), ("ridge", "bogus")):
        with pytest.raises(ModelError):
            create_model(*args)


def test_parameters(spark):
    plan = create_model("random_forest", "classification", {"n_estimators": 7})
    est = plan.estimator(rows=10)
    assert est.getNumTrees() == 7 and est.getFeatureSubsetStrategy() == "sqrt" and est.getMaxDepth() == 30
    assert create_model("random_forest", "regression", {"max_depth": 9}).estimator(rows=1).getMaxDepth() == 9
    with pytest.raises(ModelError, match="at most 30"):
        create_model("random_forest", "regression", {"max_depth": 99})
    with pytest.warns(UserWarning, match="n_jobs, solver"):
        create_model("logistic_regression", "classification", {"solver": "liblinear", "n_jobs": 2})
    with pytest.warns(UserWarning, match="n_estimators"):
        plan = create_model("ridge", "regression", {"n_estimators": 5})
    assert plan.params == model_defaults("ridge")


@pytest.fixture(scope="module")
def forest(customers):
    return train_model(customers, "churn", params=FEW, id_column="customer_id", cv_folds=2)


def test_forest(forest):
    assert forest.metrics["accuracy"] > 0.6 and forest.cv_scores["cv_mean"] > 0.5
    assert len(forest.cv_scores["cv_scores"]) == 2
    assert (forest.n_train, forest.n_validation) == (1350, 150)
    assert sum(forest.class_distribution.values()) == 150
    assert forest.feature_importance[0][0] == "tenure"


def test_save_load_predict_evaluate(spark, customers, forest, tmp_path):
    path = save_model(spark, forest, str(tmp_path / "model"))
    with pytest.raises(ModelError, match="exists already"):
        save_model(spark, forest, path)
    model, meta = load_model(spark, path)
    assert meta["classes"] == [0, 1] and meta["version"] == 1
    scored = predict(model, customers.drop("churn"), "customer_id")
    assert scored.columns == ["customer_id", "prediction", "prediction_index", "probability_0", "probability_1"]
    assert scored.count() == customers.count()
    assert scored.where("abs(probability_0 + probability_1 - 1) > 1e-9").count() == 0
    assert scored.exceptAll(predict(forest.model, customers, "customer_id")).count() == 0
    assert evaluate(model, customers)["accuracy"] > 0.6
    with pytest.raises(DataError, match="target"):
        evaluate(model, customers.drop("churn"))
    with pytest.raises(ModelError):
        load_model(spark, str(tmp_path / "none"))
    assert "Algorithm" in {r.item for r in report_rows(customers, model=meta).collect()}


def test_external_validation(customers):
    train, validation = customers.where("tenure > 10"), customers.where("tenure <= 10")
    result = train_model(
        train, "churn", algorithm="logistic_regression", validation_df=validation, id_column="customer_id", cv_folds=0
    )
    assert result.n_train + result.n_validation == 1500 and result.n_validation == validation.count()


def test_regression_models(prices):
    results, board = compare_models(
        prices, "price", params={"random_forest": FEW, "gradient_boosting": FEW}, id_column="customer_id", cv_folds=0
    )
    rows = board.collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and rows[0].model == "ridge" and rows[0].r2 > 0.5
    assert len(results) == 3
    with pytest.raises(ModelError):
        compare_models(prices, "price", algorithms=["logistic_regression"])


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    model = T.fit_model(df, "y", create_model("ridge", "regression", {"alpha": 30.0}), scale_numerical=False)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 30.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.models[0].coefficients.toArray(), want, atol=1e-6)


def test_logistic_solves_its_objective(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, y int")
    plan = create_model("logistic_regression", "classification", {"C": 0.1, "tol": 1e-10})
    m = T.fit_model(df, "y", plan, classes=[0, 1], scale_numerical=False).models[0]
    w, b = m.coefficients.toArray(), m.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(w + 0.1 * x.T @ (p - y)).max() < 1e-3 and abs((p - y).sum()) < 1e-2


def test_boosting_with_three_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(float(v), ["low", "mid", "top"][int(v // 10)]) for v in rng.uniform(0, 30, 300)]
    df = spark.createDataFrame(rows, "v double, y string")
    result = train_model(df, "y", algorithm="gradient_boosting", params={"n_estimators": 3}, cv_folds=0)
    assert result.metrics["accuracy"] > 0.9
    scored = predict(result.model, df)
    assert {r[0] for r in scored.select("prediction").distinct().collect()} == {"low", "mid", "top"}
    total = F.col("probability_low") + F.col("probability_mid") + F.col("probability_top")
    assert scored.where(F.abs(total - 1) > 1e-9).count() == 0


def test_rows_without_target(customers):
    holed = customers.withColumn("churn", F.when(F.col("tenure") < 70, F.col("churn")))
    result = train_model(holed, "churn", algorithm="logistic_regression", id_column="customer_id", cv_folds=0)
    assert result.rows_without_target == customers.where("tenure >= 70").count()


def test_scoring_names(customers):
    with pytest.raises(EvaluationError, match="scoring"):
        train_model(customers, "churn", scoring="bogus", id_column="customer_id", cv_folds=0)


def test_tables_that_apply(spark, customers, forest):
    tables = eda_tables(customers, "churn")
    assert set(tables) == {"warnings", "describe", "correlation", "feature_histograms", "target_distribution"}
    only_text = spark.createDataFrame([("a",), ("b",)], "s string")
    assert set(eda_tables(only_text)) == {"warnings"}
    scored = T.evaluation_table(forest.model, customers)
    assert set(evaluation_tables(scored, "classification", classes=[0, 1], probabilities=forest.model.probability_columns)) == {
        "confusion_matrix", "roc_curve"
    }


def test_macro_scoring_on_two_classes(customers):
    """Each scorer has its own averaging: macro and binary scores differ on unequal classes."""
    data = T.prepare_data(customers, "churn", id_column="customer_id", cv_folds=2)
    plan = create_model("logistic_regression", "classification", {"max_iter": 20})
    scores = {
        s: T.cross_validate(data.folded, "churn", plan, classes=data.classes, fold="_fold", exclude=data.exclude, scoring=s)
        for s in ("f1", "f1_macro", "recall_macro", "balanced_accuracy")
    }
    assert scores["f1"] != scores["f1_macro"] and scores["recall_macro"] == scores["balanced_accuracy"]
    with pytest.raises(EvaluationError, match="two classes"):
        T.cross_validate(data.folded, "churn", plan, classes=[0, 1, 2], fold="_fold", scoring="f1")


def test_classes_of_any_type_are_stored(spark):
    for classes in ([Decimal("1.50"), Decimal("2.00")], [date(2020, 1, 1), date(2021, 1, 1)], ["a", "b"], [0, 1]):
        assert T._classes_from_text(spark, json.loads(json.dumps(T._classes_as_text(classes)))) == classes


def test_memory_of_a_forest_pass_follows_the_session(spark):
    # 8 GB over 8 cores, of which a task takes a quarter; never below the estimators' default.
    assert T.tree_memory_mb(spark) == 256
    plan = create_model("random_forest", "regression", FEW)
    est = plan.estimator(rows=10, memory_mb=700)
    assert est.getMaxMemoryInMB() == 700 and est.getCacheNodeIds() and est.getCheckpointInterval() == 10


def test_training_keeps_the_confusion_matrix(spark, customers, forest):
    counts = {(r.actual, r.predicted): r.n for r in forest.confusion.collect()}
    assert sum(counts.values()) == forest.n_validation
    right = sum(n for (a, p), n in counts.items() if a == p)
    assert round(right / forest.n_validation, 4) == forest.metrics["accuracy"]
    whole = T.evaluation(forest.model, customers)
    assert whole.confusion.agg(F.sum("n")).first()[0] == 1500 and whole.metrics == evaluate(forest.model, customers)


def test_the_forest_query_trains_the_whole_default_forest(spark, tmp_path, monkeypatch):
    """200 trees and five folds, not ten trees and none."""
    from tabloom.catalog import modelling

    rows = [(i, "ring", f"Brand#{i % 3}", "LARGE", i % 7, 900 + i % 40 / 10) for i in range(120)]
    schema = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    results, train = [], T.train_model
    monkeypatch.setattr(T, "train_model", lambda *a, **k: results.append(train(*a, **k)) or results[-1])
    found = {(r.part, r.metric): r.value for r in modelling.train_rf_regressor(spark, str(tmp_path)).collect()}
    (result,) = results
    assert result.params == model_defaults("random_forest") and len(result.model.models[0].trees) == 200
    assert len(result.cv_scores["cv_scores"]) == 5 and found["check", "folds"] == 5
    assert found["rows", "train"] == 108 and found["rows", "validation"] == 12


def test_a_large_forest_grows_in_blocks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(300, 2))
    data = [(*map(float, v), float(v[0] + 3 * v[1])) for v in x]
    df = spark.createDataFrame(data, "a double, b double, y double").coalesce(1).persist()
    plan = create_model("random_forest", "regression", {"n_estimators": 24, "max_depth": 4})
    assert [p.params["n_estimators"] for p in T._blocks(plan, 300, 1)] == [24]
    whole = T.fit_model(df, "y", plan).models[0]
    monkeypatch.setattr(T, "BLOCK_ROWS", 3000)
    blocks = T._blocks(plan, 300, 1)
    assert [p.params["n_estimators"] for p in blocks] == [10, 10, 4]
    assert len({p.params["random_state"] for p in blocks}) == 3 and blocks[0].params["random_state"] == 1
    model = T.fit_model(df, "y", plan)
    (forest,) = model.models
    trees = forest.trees
    assert forest.getNumTrees == len(trees) == whole.getNumTrees == 24
    assert len({t.toDebugString.split("\n", 1)[1] for t in trees}) == 24
    vectors = model.preprocessor.with_vector(df, "_features").select("_features").collect()
    for r in vectors[:20]:
        assert forest.predict(r[0]) == pytest.approx(sum(t.predict(r[0]) for t in trees) / 24)
    # Blocks change which rows are drawn, not what the forest learns.
    assert abs(T.evaluate(model, df)["r2"] - T.evaluate(T.FittedModel("random_forest", "regression", "y", model.preprocessor, [whole]), df)["r2"]) < 0.05
    result = T.TrainingResult(model)
    stored, _ = load_model(spark, save_model(spark, result, str(tmp_path / "model")))
    assert stored.models[0].getNumTrees == 24
    assert predict(stored, df, "a").exceptAll(predict(model, df, "a")).count() == 0
    assert sum(forest.featureImportances.toArray()) == pytest.approx(1.0)
    # Ten trees are one block, as before.
    few = create_model("random_forest", "regression", {"n_estimators": 10})
    assert T._blocks(few, 10**9, 1)[0].params["n_estimators"] == 10 and len(T._blocks(few, 10**9, 1)) == 1
