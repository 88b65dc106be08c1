from __future__ import annotations

from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabloom import feature_spec, fit_preprocessor, holdout, kfold, split
from tabloom.errors import ConfigError, DataError
from tabloom.functions import ordering as O
from tabloom.operators.features import FeatureSpec, PreprocessorModel


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(1.0, 10.0, "a", "x", 0), (2.0, 20.0, "b", "x", 1), (3.0, 30.0, "a", "y", 0), (4.0, 40.0, "c", "z", 1)]
    return spark.createDataFrame(rows, "num1 double, num2 double, cat1 string, cat2 string, target int")


def test_spec(spark, sample):
    spec = feature_spec(sample, exclude=["target"])
    assert spec.numeric_columns == ["num1", "num2"] and spec.categorical_columns == ["cat1", "cat2"]
    df = spark.createDataFrame([(1.0, None, "x", True), (1.0, None, "y", False), (1.0, None, "z", True)],
                               "a double, b double, c string, d boolean")
    spec = feature_spec(df)
    assert spec.dropped_columns == ["a", "b"] and spec.feature_columns == ["d", "c"]


def test_too_many_categories(spark):
    df = spark.range(200).select(*[(F.col("id") % n).cast("string").alias(f"c{n}") for n in (50, 51, 150)])
    spec = feature_spec(df)
    assert spec.categorical_columns == ["c50"] and spec.dropped_columns == ["c51", "c150"]


def test_widths_names_and_vector(sample):
    onehot = fit_preprocessor(sample, exclude=["target"])
    flat = onehot.transform(sample)
    assert len(flat.columns) == 2 + 3 + 3 and flat.columns == onehot.feature_names
    assert flat.columns[2:5] == ["cat1_a", "cat1_b", "cat1_c"]
    vectors = [list(r.features) for r in onehot.with_vector(sample).collect()]
    assert vectors == [list(r) for r in flat.collect()]
    ordinal = fit_preprocessor(sample, exclude=["target"], categorical_encoding="ordinal")
    assert len(ordinal.transform(sample).columns) == 4


def test_new_data(spark, sample, tmp_path):
    model = fit_preprocessor(sample, exclude=["target"])
    new = spark.createDataFrame([(9.0, None, "zzz", None)], "num1 double, num2 double, cat1 string, cat2 string")
    row = model.transform(new).first()
    assert row.num2 == 0.0 and (row.cat1_a, row.cat1_b, row.cat1_c) == (0.0, 0.0, 0.0) and row.cat2_x == 1.0
    assert list(model.with_vector(new).first().features)[2:5] == [0.0, 0.0, 0.0]
    strict = fit_preprocessor(sample, exclude=["target"], handle_unknown="error")
    with pytest.raises(PySparkException, match="zzz"):
        strict.transform(new).collect()
    model.save(spark, str(tmp_path / "m"))
    assert PreprocessorModel.load(spark, str(tmp_path / "m")) == model


def test_bad_options(sample):
    for bad in ({"scaler": "bogus"}, {"categorical_encoding": "bogus"}, {"handle_unknown": "bogus"}):
        with pytest.raises(ConfigError):
            fit_preprocessor(sample, **bad)


# --------------------------------------------------------------------------- splits
def parts(df, column="split"):
    return dict(Counter(r[column] for r in df.select(column).collect()))


def test_exact_sizes_whatever_the_partitioning(spark):
    df = spark.range(1003).withColumn("y", F.col("id") % 3)
    one = split(df, key=["id"], stratify="y")
    two = split(df.repartition(7), key=["id"], stratify="y")
    assert parts(one) == {"test": 201, "validation": 101, "train": 701}
    assert one.exceptAll(two).count() == 0 and one.count() == 1003
    other = split(df, key=["id"], stratify="y", seed=1)
    assert other.exceptAll(one).count() > 100


def test_class_shares(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") < 50, "rare").otherwise("common"))
    counts = split(df, key=["id"], stratify="y").groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in counts} == {
        ("rare", "test"): 10, ("rare", "validation"): 5, ("rare", "train"): 35,
        ("common", "test"): 190, ("common", "validation"): 95, ("common", "train"): 665,
    }


def test_class_too_small_to_stratify(spark):
    df = spark.range(100).withColumn("y", F.when(F.col("id") == 0, "one").otherwise("rest"))
    assert parts(split(df, key=["id"], stratify="y")) == {"test": 20, "validation": 10, "train": 70}


def test_missing_class_is_a_class(spark):
    df = spark.range(100).withColumn("y", F.when(F.col("id") < 50, "a"))
    assert parts(split(df, key=["id"], stratify="y")) == {"test": 20, "validation": 10, "train": 70}


def test_rows_without_a_key(spark, monkeypatch):
    # Two thirds of the rows are copies of one row; slices of 100 stand for very many copies.
    monkeypatch.setattr(O.number_copies, "__kwdefaults__", {"slice_rows": 100})
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("a"))
    out = split(df)
    assert parts(out) == {"test": 600, "validation": 300, "train": 2100}
    assert out.columns == ["a", "split"]
    assert out.select("a").exceptAll(df).count() == 0 and out.count() == 3000
    hot = parts(out.where("a = -1"))
    assert 300 < hot["test"] < 500  # copies are spread like any other rows


def test_numbered_copies(spark):
    df = spark.createDataFrame([("a",)] * 7 + [("b",)] + [(None,)] * 3, "v string")
    got = Counter((r.v, r._copy) for r in O.number_copies(df, slice_rows=3).collect())
    assert got == Counter([("a", i) for i in range(7)] + [("b", 0)] + [(None, i) for i in range(3)])


def test_one_key_for_all_rows_is_torn_apart(spark):
    df = spark.range(100).withColumn("k", F.lit(1))
    out = split(df, key=["k"])
    assert parts(out) == {"test": 20, "validation": 10, "train": 70}
    assert out.columns == ["id", "k", "split"] and out.select("id").distinct().count() == 100


@pytest.mark.parametrize("local", [100_000, 0])
def test_parts_of_repeated_keys_are_exact_and_repeatable(spark, monkeypatch, local):
    monkeypatch.setattr(O, "MAX_LOCAL_GROUPS", local)
    # Keys of 1 to 40 rows, among them equal rows; one key has a third of all.
    df = spark.range(600).select(
        F.when(F.col("id") < 200, -1).otherwise(F.floor(F.sqrt("id"))).alias("k"), (F.col("id") % 7).alias("v"),
        F.when(F.col("id") % 5 > 0, F.lit("a")).alias("kind"),
    )
    out = split(df, key=["k"])
    assert parts(out) == {"test": 120, "validation": 60, "train": 420}
    again = split(df.repartition(7), key=["k"])
    assert out.exceptAll(again).count() == 0
    # At most one key for each of the two range ends is in several parts.
    assert out.groupBy("k").agg(F.count_distinct("split").alias("n")).where("n > 1").count() <= 2
    by_kind = split(df, key=["k"], stratify="kind")
    assert parts(by_kind) == {"test": 120, "validation": 60, "train": 420}
    assert parts(by_kind.where("kind = 'a'")) == {"test": 96, "validation": 48, "train": 336}
    folds = kfold(df, folds=4, key=["k"])
    assert {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()} == {i: 150 for i in range(4)}


def test_size_checks(spark):
    df = spark.range(10)
    for bad in ({"test_size": 1.0}, {"validation_size": 1.0}, {"test_size": 0.6, "validation_size": 0.4}):
        with pytest.raises(DataError):
            split(df, key=["id"], **bad)


def test_holdout(spark):
    assert parts(holdout(spark.range(95), key=["id"])) == {"validation": 10, "train": 85}


def test_folds(spark):
    df = spark.range(103).withColumn("y", F.when(F.col("id") < 23, "a").otherwise("b"))
    plain = parts(kfold(df, key=["id"]), "fold")
    assert sorted(plain.values()) == [20, 20, 21, 21, 21] and set(plain) == set(range(5))
    mixed = kfold(df, key=["id"], stratify="y")
    assert sorted(parts(mixed, "fold").values()) == [20, 20, 21, 21, 21]
    rare = parts(mixed.where("y = 'a'"), "fold")
    assert sorted(rare.values()) == [4, 4, 5, 5, 5]
    assert set(parts(kfold(df, key=["id"], folds=1), "fold")) == {0, 1}


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_in_buckets(spark, descending):
    df = spark.range(500).select((F.col("id") * 7 % 500).cast("double").alias("x"), (F.col("id") % 5).alias("n"))
    bounds = O.range_bounds(df, "x", 500, rows_per_bucket=40)
    assert len(bounds) > 5
    plain = O.running_totals(df, "x", ["n"], descending=descending)
    split_up = O.running_totals(df, "x", ["n"], bounds=bounds, descending=descending)
    assert sorted(plain.collect()) == sorted(split_up.collect())


def test_given_spec_bounds_the_levels(spark):
    wide = spark.range(300).select(F.concat(F.lit("v"), "id").alias("c"), F.col("id").cast("double").alias("x"))
    spec = FeatureSpec(numeric_columns=["x"], categorical_columns=["c"])
    assert len(fit_preprocessor(wide, spec).levels["c"]) == 300
    with pytest.raises(DataError, match="more than 100 levels"):
        fit_preprocessor(wide, spec, max_given_levels=100)


def test_a_row_of_many_levels_is_short(spark):
    """100 columns of 50 levels make 5,000 places, of which a row holds 100."""
    columns = [(F.col("id") * (i + 1) % 50).cast("string").alias(f"c{i}") for i in range(100)]
    df = spark.range(150).select(F.col("id").cast("double").alias("n"), *columns)
    spec = FeatureSpec(["n"], [f"c{i}" for i in range(100)])
    levels = {f"c{i}": sorted(str(v) for v in range(50)) for i in range(100)}
    model = PreprocessorModel(spec, "onehot", "ignore", {"n": 1.0}, {}, {}, {c: "0" for c in levels}, levels)
    vectors = [r.features for r in model.with_vector(df).select("features").where("n > 0").collect()]
    assert {len(v) for v in vectors} == {5001} and {len(v.indices) for v in vectors} == {101}
    new = spark.createDataFrame([(2.0, *["nowhere"] * 100)], df.schema)
    (row,) = model.with_vector(new).collect()
    assert row.features.indices.tolist() == [0] and row.features.values.tolist() == [2.0]
