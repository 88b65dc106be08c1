from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabloom import CleanerModel, clean_dataframe
from tabloom.errors import ConfigError
from tabloom.operators import clean as C


def test_duplicates_and_mean(spark):
    df = spark.createDataFrame([(1.0, "x"), (1.0, "x"), (None, "y"), (4.0, "z")], "a double, b string")
    out, report, _ = clean_dataframe(df)
    r = report.first()
    assert (r.duplicates_dropped, r.rows_after, r.missing_imputed) == (1, 3, 1)
    assert out.where("b = 'y'").first().a == 2.5


def test_drop_strategy(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "a double")
    out, report, _ = clean_dataframe(df, missing_strategy="drop")
    assert out.count() == 2 and report.first().rows_dropped_missing == 1


def test_sparse_column(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (2.0, None, 4.0)], "a double, b double, c double")
    out, report, _ = clean_dataframe(df, drop_high_missing_threshold=0.5)
    assert out.columns == ["a", "c"] and report.first().columns_dropped == ["b"]


def test_iqr_cap(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 100.0)], "a double")
    out, report, _ = clean_dataframe(df, outlier_method="iqr")
    assert report.first().outliers_capped == 1 and out.agg(F.max("a")).first()[0] == 10.0


def test_caps_keep_missing_and_whole_types(spark):
    df = spark.createDataFrame([(i, i, None) for i in range(20)] + [(10**6, 5, None)], "a int, b int, c double")
    out = C.cap_outliers(df, "iqr", 3.0)
    assert dict(out.dtypes) == {"a": "double", "b": "int", "c": "double"}
    assert out.where("c is null").count() == 21
    assert C.cap_outliers(df, None) is df
    one = spark.createDataFrame([(1.0,)], "a double")
    assert C.cap_outliers(one, "zscore").first().a == 1.0


def test_numeric_text(spark):
    df = spark.createDataFrame([("1,000", "1d", " 4 2 "), ("2,000", "2", ".5"), ("3,000", "x", None)], "a string, b string, c string")
    kinds = C.fit_coercion(df)
    assert kinds == {"a": "bigint", "c": "double"}
    assert [tuple(r) for r in C.coerce_columns(df, kinds).collect()] == [
        (1000, "1d", 42.0),
        (2000, "2", 0.5),
        (3000, "x", None),
    ]


def test_mostly_numeric_text(spark):
    df = spark.createDataFrame([(str(i),) for i in range(19)] + [("junk",)], "a string")
    assert C.fit_coercion(df) == {}
    assert C.fit_coercion(df, min_share=0.9) == {"a": "double"}
    assert C.fit_coercion(df, min_share=0.9, exclude=["a"]) == {}
    _, report, _ = C.clean_dataframe(df, coerce_share=0.9, drop_duplicates=False)
    row = report.first()
    assert row["columns_coerced"] == ["a"] and row["cells_lost"] == 1
    assert [tuple(c) for c in row["cells_lost_by_column"]] == [("a", 1)]


def test_excluded_columns_stay(spark):
    df = spark.createDataFrame([(f"{i:05d}", None, "1") for i in range(20)], "id string, empty string, n string")
    cleaned, _, model = C.clean_dataframe(df, exclude=["id", "empty"])
    assert sorted(r["id"] for r in cleaned.collect())[:2] == ["00000", "00001"] and "empty" in cleaned.columns
    assert model.coerce == {"n": "bigint"} and model.dropped == []


def test_other_strategies(spark):
    df = spark.createDataFrame(
        [(1, "b", None), (3, "a", True), (None, None, True), (8, "b", False)], "n int, s string, f boolean"
    )
    median = C.impute(df, "median").collect()
    assert [r.n for r in median] == [1, 3, 3, 8] and median[2].s is None
    mode = C.impute(df, "most_frequent").collect()
    assert (mode[2].n, mode[2].s, mode[0].f) == (1, "b", True)
    constant = C.impute(df, "constant", 0).collect()
    assert (constant[2].n, constant[2].s, constant[0].f) == (0, "0", False)
    fractional = C.impute(spark.createDataFrame([(1,), (2,), (None,)], "n int"), "mean")
    assert fractional.where("n = 1.5").count() == 1


def test_excluded_columns_are_left_alone(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (1000000, 2.0)], "id int, v double")
    _, _, model = clean_dataframe(df, outlier_method="zscore", outlier_threshold=0.5, exclude=["id"])
    assert "id" not in model.caps and "v" in model.fill


def test_bad_options(spark):
    df = spark.createDataFrame([(1,)], "a int")
    for bad in ({"missing_strategy": "bogus"}, {"outlier_method": "bogus"}):
        with pytest.raises(ConfigError):
            clean_dataframe(df, **bad)


def test_saved_step_gives_the_same_rows(spark, tmp_path):
    df = spark.createDataFrame([("1", 1.0, None), ("2", None, "x"), ("3", 50.0, "y")], "t string, v double, s string")
    out, _, model = clean_dataframe(df, missing_strategy="most_frequent", outlier_method="iqr", drop_duplicates=False)
    model.save(spark, str(tmp_path / "step"))
    again = CleanerModel.load(spark, str(tmp_path / "step"))
    assert sorted(again.transform(df).collect()) == sorted(out.collect())


def test_hot_row_is_combined_before_the_shuffle(spark):
    df = spark.range(300_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(-1).alias("a"))
    out, report, _ = clean_dataframe(df)
    assert report.first().duplicates_dropped == 99_999 and out.count() == 200_001
