from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.errors import DataError, EvaluationError, ValidationError
from tabloom.functions.quantiles import quantiles
from tabloom.operators import profile as P
from tabloom.operators import validate as V


def test_summary_of_three_rows(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "x"), (None, "y")], "a double, b string")
    row = P.dataset_summary(df).first()
    assert (row.rows, row.columns, row.missing_values, row.duplicate_rows) == (3, 2, 1, 0)
    assert row.missing_pct == 16.67 and row.numeric_columns == 1


def test_boolean_is_categorical_here(spark):
    df = spark.createDataFrame([(True, 1)], "a boolean, b int")
    assert P.select_numeric(df).columns == ["b"] and P.select_categorical(df).columns == ["a"]


def test_nested_columns_are_refused(spark):
    df = spark.createDataFrame([([1.0],)], "v array<double>")
    with pytest.raises(DataError, match="nested"):
        P.column_profile(df)


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, None), (1, "q")], "`a.b` int, `c d` string")
    assert [tuple(r)[1:] for r in P.column_profile(df).orderBy("position").collect()] == [
        ("a.b", "int", 2, 1),
        ("c d", "string", 1, 1),
    ]


def test_approximate_profile(spark):
    df = spark.range(1000).select("id", F.lit(None).cast("string").alias("e"))
    found = {r["column"]: r["distinct"] for r in P.column_profile(df, approx=True).collect()}
    assert abs(found["id"] - 1000) < 150 and found["e"] == 0


def test_describe_and_correlation_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "b": rng.integers(0, 9, 300), "k": 7})
    pdf["c"] = pdf["a"] * 2 + rng.normal(size=300)
    pdf.loc[:40, "c"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b int, k int, c double")
    want = pdf.describe().T.round(4)
    for r in P.numeric_describe(df).collect():
        for ours, theirs in zip(("mean", "std", "min", "p25", "p50", "p75", "max"), want.columns[1:]):
            assert r[ours] == pytest.approx(want.loc[r["column"], theirs], abs=1.01e-4)
    corr = pdf.corr()
    for r in P.correlation_matrix(df).collect():
        expected = corr.loc[r["column"], r["other"]]
        assert (r.correlation is None and math.isnan(expected)) or r.correlation == pytest.approx(expected, abs=1e-4)
    with pytest.raises(EvaluationError):
        P.correlation_matrix(df.select("a"))


@pytest.mark.parametrize("bracket", [10, 200, 10**6])
def test_quantiles_by_narrowing_are_exact(spark, bracket):
    random.seed(5)
    rows = [
        (
            random.choice([1.0, 5.0, 5.0, random.random() * 10, None]),
            random.gauss(0, 1) if random.random() < 0.9 else math.inf,
            random.choice([0, 0, 0, 3]),
        )
        for _ in range(8000)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c int").withColumn("d", F.lit(None).cast("double"))
    columns, shares = ["a", "b", "c", "d"], [0.0, 0.1, 0.101, 0.5, 0.75, 1.0]
    want = quantiles(df, columns, shares)
    assert quantiles(df, columns, shares, small_cells=0, small_bracket=bracket) == want
    assert want["a"][3] == float(np.quantile([r[0] for r in rows if r[0] is not None], 0.5))


def test_histograms_keep_empty_bins(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 1), (10.0, 1), (None, 1)], "a double, k int")
    bins = {(r["column"], r["bin"]): r.n for r in P.feature_histograms(df).collect()}
    assert len(bins) == 60 and bins["a", 0] == 2 and bins["a", 29] == 1
    assert sum(n for (c, _), n in bins.items() if c == "a") == 3
    assert bins["k", 15] == 4


def test_target_distribution_form(spark):
    many = spark.range(100).select(F.col("id").cast("double").alias("y"))
    assert "bin" in P.target_distribution(many, "y").columns
    few = spark.range(100).select((F.col("id") % 3).alias("y"))
    assert P.target_distribution(few, "y").count() == 3


def test_validation(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "a int, b int")
    report = V.validate(df, required_columns=["a"])
    assert report.is_valid() and report.errors() == []
    found = {(r.check, r["column"], r.value) for r in report.findings.collect()}
    assert found == {("duplicates", None, 1.0), ("constant", "a", 1.0)}
    bad = V.validate(df, required_columns=["target"])
    assert not bad.is_valid() and "target" in bad.errors()[0]


def test_validation_of_an_empty_dataset(spark):
    report = V.validate(spark.createDataFrame([], "a int"))
    assert len(report.errors()) == 1 and report.warnings() == []


def test_missing_share_levels(spark):
    df = spark.range(100).select(
        F.when(F.col("id") >= 60, F.col("id")).alias("a"), F.when(F.col("id") >= 4, F.col("id")).alias("b")
    )
    found = {(r.severity, r["column"]) for r in V.validate(df, max_missing_share=0.5).findings.where("check = 'missing'").collect()}
    assert found == {("error", "a")}
    found = {(r.severity, r["column"]) for r in V.validate(df).findings.where("check = 'missing'").collect()}
    assert found == {("warning", "a")}


def test_task_inference(spark):
    task = lambda values, kind: V.infer_task(
        spark.createDataFrame([(v,) for v in values], f"y {kind}"), "y"
    )
    assert task([0, 1, 0, 1, 1, 0] * 5, "bigint") == "classification"
    assert task([float(v) for v in np.linspace(0, 100, 100)], "double") == "regression"
    assert task(["cat", "dog"] * 10, "string") == "classification"
    assert task([True, False] * 10, "boolean") == "classification"
    df = spark.createDataFrame([(1, None)], "y int, z int")
    for target, text in [(None, "no target"), ("nope", "no column"), ("y", "same value"), ("z", "no value")]:
        with pytest.raises(ValidationError, match=text):
            V.infer_task(df, target)


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("z",)], "y string")
    labels = [r.label for r in V.label_table(df.where("y <> 'z'"), "y").orderBy("label_index").collect()]
    assert labels == ["a", "b"]
    coded = {r.y: r.label_index for r in V.encode_labels(df, "y", labels).collect()}
    assert coded == {"a": 0, "b": 1, None: -1, "z": -1}
    wide = [f"l{i}" for i in range(200)] + ["a"]
    assert V.encode_labels(df, "y", wide).where("y = 'a'").first().label_index == 200


def test_correlation_of_pairs_with_holes(spark):
    """Missing cells leave out a pair's rows only; the plan makes no row of its own for a pair."""
    import numpy as np

    random = np.random.default_rng(4)
    x = random.normal(size=(500, 5)) + 1e9
    x[:, 1] = x[:, 0] * 2 + random.normal(size=500)
    x[:, 4] = 7.1
    x[random.random(x.shape) < 0.3] = np.nan
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(5))).repartition(6)
    out = P.correlation_matrix(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Scan") == 1
    found = {(r["column"], r.other): r.correlation for r in out.collect()}
    assert len(found) == 25
    for i in range(5):
        for j in range(5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 4 in (i, j):
                assert found[f"c{i}", f"c{j}"] is None
            else:
                want = np.corrcoef(x[both, i] - 1e9, x[both, j] - 1e9)[0, 1]
                assert found[f"c{i}", f"c{j}"] == pytest.approx(want, abs=1e-4)


def test_target_facts_stop_at_the_limit(spark):
    df = spark.range(5000).selectExpr(
        "id * 0.37 as many", "id % 20 as twenty", "id % 21 as more", "id % 2 as two", "cast(null as int) as none",
        "cast(id as string) as words", "if(id < 3000, 1, null) as one", "id % 41 as forty",
    )
    facts = {c: V.target_facts(df, c) for c in df.columns}
    assert [facts[c].classes for c in df.columns] == [21, 20, 21, 2, 0, 21, 1, 21]
    assert [facts[c].task for c in df.columns] == ["regression", "classification", "regression", "classification", None, "classification", None, "regression"]
    assert facts["two"].binary and not facts["twenty"].binary and facts["one"].present == 3000
    for c in df.columns:
        exact = V.target_profile(df, c).first()
        assert (exact.rows, exact.present, exact.task, exact["binary"]) == (facts[c].rows, facts[c].present, facts[c].task, facts[c]["binary"])
