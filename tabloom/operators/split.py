"""Seeded splits and folds with exact sizes, whatever the partitioning of the table.

A split is a set of rank ranges in a seeded order. :func:`label_by_rank` turns the ranges into
digest limits, so the rows themselves are labelled by a projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.errors import DataError
from tabloom.functions.columns import col
from tabloom.functions.ordering import label_by_rank

SPLITS = ["test", "validation", "train"]


def check_sizes(test_size: float, validation_size: float) -> None:
    if not 0 <= test_size < 1 or not 0 <= validation_size < 1:
        raise DataError("test_size and validation_size must each be below 1.")
    if test_size + validation_size >= 1:
        raise DataError("test_size + validation_size must stay below 1.")


def _share(count: Column, part: Column, total: Column) -> Column:
    """Proportional part of a class, unrounded."""
    return F.try_divide(count.cast("double") * part.cast("double"), total.cast("double"))


def allocate(groups: DataFrame, count: str, part: str, output: str) -> DataFrame:
    """Whole numbers proportional to ``count`` adding up to ``part``: largest remainder first.

    The table has one row per class.
    """
    everything = Window.partitionBy()
    share = F.coalesce(_share(col(count), col(part), F.sum(count).over(everything)), F.lit(0.0))
    order = Window.orderBy(F.desc("_rest"), F.asc("_g"))
    return (
        groups.withColumn("_share", share)
        .withColumn("_floor", F.floor("_share").cast("bigint"))
        .withColumn("_rest", F.round(F.col("_share") - F.col("_floor"), 9))
        .withColumn("_left", col(part) - F.sum("_floor").over(everything))
        .withColumn(
            output,
            F.col("_floor") + (F.row_number().over(order) <= F.col("_left")).cast("bigint"),
        )
        .drop("_share", "_floor", "_rest", "_left")
    )


def _class_counts(df: DataFrame, by: str) -> tuple[DataFrame, int, int, int]:
    """Class table with its number of classes, smallest class and number of rows."""
    counted = df.groupBy(col(by).alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.limit(100_001).collect()
    if len(rows) <= 100_000:
        # Small enough to become a local table: the counting scan is not repeated.
        counted = df.sparkSession.createDataFrame(rows, counted.schema) if rows else counted
        sizes = [r["n"] for r in rows]
        return counted, len(sizes), min(sizes, default=0), sum(sizes)
    row = counted.agg(F.count(F.lit(1)), F.min("n"), F.sum("n")).first()
    return counted, row[0], row[1], row[2]


def _ranged(df, groups, labels, total, classes, key, seed, by, output) -> DataFrame:
    return label_by_rank(
        df,
        groups,
        labels,
        total=total,
        group_count=classes,
        key=key,
        seed=seed,
        by=by,
        output=output,
    )


def split(
    df: DataFrame,
    *,
    test_size: float = 0.2,
    validation_size: float = 0.1,
    stratify: str | None = None,
    key: list[str] | None = None,
    seed: int = 42,
    output: str = "split",
) -> DataFrame:
    """Add a column with test, validation or train.

    The test part is ``ceil(test_size * n)`` rows; validation is the share of the rest that makes
    it ``validation_size`` of the whole. With ``stratify`` each part keeps the class proportions,
    provided there are two classes and each has two rows; else the split is a plain one.
    """
    check_sizes(test_size, validation_size)
    share = validation_size / (1.0 - test_size)
    spark = df.sparkSession
    if stratify:
        groups, classes, smallest, total = _class_counts(df, stratify)
        if classes < 2 or smallest < 2:
            stratify = None
    else:
        total = df.count()
    tests = math.ceil(round(total * test_size, 9))
    validations = math.ceil(round((total - tests) * share, 9))
    if not stratify:
        one = spark.createDataFrame([(0, tests, tests + validations)], "_g int, end_0 bigint, end_1 bigint")
        return _ranged(df, one, SPLITS, total, 1, key, seed, None, output)
    first = allocate(groups.withColumn("_part", F.lit(tests)), "n", "_part", "end_0")
    second = allocate(
        first.withColumn("_rest_n", F.col("n") - F.col("end_0")).withColumn("_part", F.lit(validations)),
        "_rest_n",
        "_part",
        "_val",
    )
    ranges = second.select("_g", "end_0", (F.col("end_0") + F.col("_val")).alias("end_1"))
    return _ranged(df, ranges, SPLITS, total, classes, key, seed, stratify, output)


def holdout(
    df: DataFrame,
    *,
    size: float = 0.1,
    stratify: str | None = None,
    key: list[str] | None = None,
    seed: int = 42,
    output: str = "split",
) -> DataFrame:
    """Two parts, validation and train, as carved out when a model is trained without its own."""
    named = split(
        df, test_size=size, validation_size=0.0, stratify=stratify, key=key, seed=seed, output=output
    )
    return named.withColumn(
        output, F.when(col(output) == "test", F.lit("validation")).otherwise(col(output))
    )


def kfold(
    df: DataFrame,
    *,
    folds: int = 5,
    stratify: str | None = None,
    key: list[str] | None = None,
    seed: int = 42,
    output: str = "fold",
) -> DataFrame:
    """Add a fold number from 0; fold sizes differ by at most one.

    With ``stratify`` (used when every class has a row for every fold) classes are dealt out in
    turn over the rows sorted by class, so each fold gets its share of every class.
    """
    k = max(2, folds)
    spark = df.sparkSession
    names = [str(i) for i in range(k)]
    if stratify:
        groups, classes, smallest, total = _class_counts(df, stratify)
        if classes < 2 or smallest < k:
            stratify = None
    else:
        total = df.count()
    if not stratify:
        sizes = [total // k + (1 if i < total % k else 0) for i in range(k)]
        ends = [sum(sizes[: i + 1]) for i in range(k - 1)]
        one = spark.createDataFrame(
            [(0, *ends)], "_g int, " + ", ".join(f"end_{i} bigint" for i in range(k - 1))
        )
        labelled = _ranged(df, one, names, total, 1, key, seed, None, output)
        return labelled.withColumn(output, col(output).cast("int"))
    # Sorted by class, a class covers places start .. start + n - 1, and place p goes to fold p % k.
    start = F.coalesce(
        F.sum("n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = groups.withColumn("_start", start)
    ends = []
    for i in range(k - 1):
        # Places p in [start, start + n) with p % k <= i.
        upto = [f"(_start + n + {k - 1 - j}) div {k} - (_start + {k - 1 - j}) div {k}" for j in range(i + 1)]
        ends.append(F.expr(" + ".join(f"({u})" for u in upto)).cast("bigint").alias(f"end_{i}"))
    labelled = _ranged(df, placed.select("_g", *ends), names, total, classes, key, seed, stratify, output)
    return labelled.withColumn(output, col(output).cast("int"))
