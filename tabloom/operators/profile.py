"""Profiling and exploratory statistics. Every function returns a small DataFrame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.errors import EvaluationError
from tabloom.functions.columns import (
    categorical_columns,
    col,
    equal_width_bin,
    is_numeric,
    missing_count,
    numeric_columns,
    ratio_or_zero,
    require_flat,
)
from tabloom.functions.longform import distinct_counts
from tabloom.functions.quantiles import quantiles

HISTOGRAM_BINS = 30
MAX_HISTOGRAMS = 16
DISCRETE_LIMIT = 20


def one_pass(df: DataFrame, per_column: dict[str, dict[str, Column]], key: str = "column") -> DataFrame:
    """Aggregate all columns in one scan and return one row per column.

    ``per_column`` maps a column to its named aggregates; the names are the same for every column.
    """
    rows = [
        F.struct(F.lit(name).alias(key), *[agg.alias(a) for a, agg in aggs.items()])
        for name, aggs in per_column.items()
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in numeric_columns(df)])


def select_categorical(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in categorical_columns(df)])


def row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row; missing cells count, zeros of either sign are equal.

    Hashing skips missing values, so which cells are missing is hashed as well.
    """
    cells = [col(c) for c in df.columns]
    holes = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells]) if cells else F.lit("")
    return [F.xxhash64(holes, *cells), F.xxhash64(F.lit(7), *reversed(cells), holes)]


def grouped_rows(df: DataFrame) -> DataFrame:
    """Distinct rows, known by their digest, with their number of copies ``n`` and missing cells ``nulls``.

    Only digests are shuffled, whatever the rows hold, and copies are combined before: a row repeated
    any number of times costs one short record per task.
    """
    require_flat(df)
    nulls = sum((col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    first, second = row_digest(df)
    return (
        df.select(first.alias("_first"), second.alias("_second"), nulls.alias("_nulls"))
        .groupBy("_first", "_second", "_nulls")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_n", "_nulls")
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: shape, column kinds, missing cells and duplicate rows, from a single scan."""
    width = len(df.columns)
    cells = F.col("rows") * width
    return (
        grouped_rows(df)
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("kinds"),
            F.coalesce(F.sum(F.col("_n") * F.col("_nulls")), F.lit(0)).alias("missing_values"),
        )
        .select(
            "rows",
            F.lit(width).alias("columns"),
            F.lit(len(numeric_columns(df))).alias("numeric_columns"),
            F.lit(len(categorical_columns(df))).alias("categorical_columns"),
            "missing_values",
            F.round(100 * ratio_or_zero(F.col("missing_values"), cells), 2).alias("missing_pct"),
            (F.col("rows") - F.col("kinds")).alias("duplicate_rows"),
        )
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier one; missing equals missing."""
    return grouped_rows(df).agg(
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_rows")
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    stats = {
        c: {"missing": missing_count(c), "rows": F.count(F.lit(1))} for c in df.columns
    }
    return one_pass(df, stats).select(
        "column", "missing", F.round(ratio_or_zero(F.col("missing"), F.col("rows")), 4).alias("missing_share")
    )


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value; min and max decide, no distinct count is needed."""
    require_flat(df)
    stats = {
        c: {"constant": F.min(col(c)).eqNullSafe(F.max(col(c)))} for c in df.columns
    }
    return one_pass(df, stats).where("constant").select("column")


def column_profile(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """Position, name, type, non-missing count and distinct count of every column.

    ``approx`` takes the distinct counts from sketches: one scan and no shuffle of values.
    """
    require_flat(df)
    stats = {
        f.name: {
            "position": F.lit(i),
            "dtype": F.lit(f.dataType.simpleString()),
            "non_null": F.count(col(f.name)),
        }
        for i, f in enumerate(df.schema, start=1)
    }
    return (
        one_pass(df, stats)
        .join(distinct_counts(df, df.columns, approx=approx), "column", "left")
        .select(
            "position",
            "column",
            "dtype",
            "non_null",
            F.coalesce("distinct", F.lit(0)).cast("bigint").alias("distinct"),
        )
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Class balance: values with their counts, most frequent first, missing left out."""
    return (
        df.where(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def stratify_check(df: DataFrame, column: str) -> DataFrame:
    """Number of classes, smallest class, and whether stratifying by the column is possible."""
    return (
        value_counts(df, column)
        .agg(
            F.count(F.lit(1)).alias("classes"),
            F.coalesce(F.min("n"), F.lit(0)).alias("smallest"),
        )
        .withColumn("can_stratify", (F.col("classes") >= 2) & (F.col("smallest") >= 2))
    )


def numeric_describe(df: DataFrame, *, exact: bool = True) -> DataFrame:
    """count, mean, std (n - 1), min, quartiles and max of each numeric column, to 4 places."""
    names = numeric_columns(df)
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame(
            [], "column string, count bigint, mean double, std double, min double, p25 double, "
            "p50 double, p75 double, max double"
        )
    aggs = []
    for i, c in enumerate(names):
        v = col(c).cast("double")
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
        ]
    row = df.agg(*aggs).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(names)}
    quart = quantiles(df, names, [0.25, 0.5, 0.75], counts=counts, exact=exact)
    data = [
        (c, counts[c], row[f"mean{i}"], row[f"std{i}"], row[f"min{i}"], *quart[c], row[f"max{i}"])
        for i, c in enumerate(names)
    ]
    frame = spark.createDataFrame(
        data,
        "column string, count bigint, mean double, std double, min double, p25 double, "
        "p50 double, p75 double, max double",
    )
    return frame.select(
        "column",
        "count",
        *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")],
    )


def _pair_moments(x: np.ndarray) -> np.ndarray:
    """(count, means and squares and cross products about them) of each pair of columns, over rows having both.

    Values are first taken relative to one of their own, so equal values have no spread to the last digit,
    and then to their mean.
    """
    there = ~np.isnan(x)
    some = np.array([c[m][0] if m.any() else 0.0 for c, m in zip(x.T, there.T)])
    apart = np.where(there, x - some, 0.0)
    middle = apart.sum(axis=0) / np.maximum(there.sum(axis=0), 1)
    apart = np.where(there, apart - middle, 0.0)
    mask = there.astype(float)
    n = mask.T @ mask
    size = np.maximum(n, 1)
    total = apart.T @ mask
    mean = (some + middle)[:, None] + total / size
    square = (apart**2).T @ mask - total**2 / size
    cross = apart.T @ apart - total * total.T / size
    return np.stack([n, mean, mean.T, square, square.T, cross])


def _merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together; each is (count, two means, two squares, cross product) by pair."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy, both = b[1] - a[1], b[2] - a[2], a[0] * share
    none = a[0] == 0
    return np.stack(
        [
            n,
            np.where(none, b[1], a[1] + dx * share),
            np.where(none, b[2], a[2] + dy * share),
            a[3] + b[3] + dx**2 * both,
            a[4] + b[4] + dy**2 * both,
            a[5] + b[5] + dx * dy * both,
        ]
    )


def correlation_matrix(df: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, over the rows having both.

    One scan over wide rows: tasks add up the products of whole blocks of rows as matrices, and give one
    row of moments for each column, which are merged by column. Missing without spread or common rows.
    """
    names = numeric_columns(df)
    if len(names) < 2:
        raise EvaluationError("A correlation matrix needs at least two numeric columns.")
    width = len(names)

    def blocks(batches):
        total = None
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            if len(x):
                own = _pair_moments(x)
                total = own if total is None else _merged_moments(total, own)
        if total is not None:
            rows = [np.ascontiguousarray(total[:, i]).tobytes() for i in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(rows, pa.binary())], names=["at", "moments"])

    def correlations(found: pa.Table) -> pa.Table:
        at, total = found["at"][0].as_py(), None
        for raw in found["moments"]:
            own = np.frombuffer(raw.as_py()).reshape(6, width)
            total = own if total is None else _merged_moments(total, own)
        spread = total[3] * total[4]
        r = [float(c / v**0.5) if v > 0 else None for c, v in zip(total[5], spread)]
        return pa.table([pa.array([names[at]] * width), pa.array(names), pa.array(r, pa.float64())], names=["column", "other", "r"])

    wide = df.select(F.array(*[col(c).cast("double") for c in names]).alias("x"))
    moments = wide.mapInArrow(blocks, "at int, moments binary")
    found = moments.groupBy("at").applyInArrow(correlations, "column string, other string, r double")
    return found.select("column", "other", F.round("r", 4).alias("correlation"))


def top_variance_columns(df: DataFrame, k: int = MAX_HISTOGRAMS) -> DataFrame:
    """Numeric columns by sample variance, largest first."""
    stats = {c: {"variance": F.var_samp(col(c).cast("double"))} for c in numeric_columns(df)}
    return (
        one_pass(df, stats)
        .select("column", F.round("variance", 4).alias("variance"))
        .orderBy(F.desc_nulls_last("variance"), "column")
        .limit(k)
    )


def histograms(df: DataFrame, columns: list[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins per column, the last one closed; empty bins are present with 0.

    A column with one value gets a range of width 1 around it.
    """
    spark = df.sparkSession
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(col(c).cast("double")).alias(f"l{i}"), F.max(col(c).cast("double")).alias(f"h{i}")]
    row = df.agg(*aggs).first()
    ranges = {}
    for i, c in enumerate(columns):
        low, high = row[f"l{i}"], row[f"h{i}"]
        if low is None:
            continue
        ranges[c] = (low - 0.5, high + 0.5) if low == high else (low, high)
    schema = "column string, bin int, low double, high double"
    edges = spark.createDataFrame(
        [
            (c, b, low + (high - low) * b / bins, low + (high - low) * (b + 1) / bins)
            for c, (low, high) in ranges.items()
            for b in range(bins)
        ],
        schema,
    )
    if not ranges:
        return edges.withColumn("n", F.lit(0).cast("bigint"))
    binned = df.select(
        *[
            equal_width_bin(col(c).cast("double"), low, high, bins).alias(c)
            for c, (low, high) in ranges.items()
        ]
    )
    if len(ranges) == 1:
        (only,) = ranges
        long = binned.select(F.lit(only).alias("column"), col(only).alias("bin"))
    else:
        long = binned.unpivot([], [col(c) for c in ranges], "column", "bin")
    counted = long.where("bin is not null").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    return edges.join(counted, ["column", "bin"], "left").select(
        "column", "bin", "low", "high", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def feature_histograms(df: DataFrame, max_features: int = MAX_HISTOGRAMS, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Histograms of the numeric columns that vary most."""
    if not numeric_columns(df):
        raise EvaluationError("There is no numeric column to draw a histogram of.")
    names = [r["column"] for r in top_variance_columns(df, max_features).collect()]
    return histograms(df, names, bins)


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Histogram of a numeric target with many values, else its value counts as text labels."""
    if is_numeric(df.schema[target].dataType, include_boolean=True):
        # Only whether there are more than DISCRETE_LIMIT values matters.
        few = df.select(col(target)).where(col(target).isNotNull()).distinct().limit(DISCRETE_LIMIT + 1)
        if few.count() > DISCRETE_LIMIT:
            return histograms(df, [target])
    return value_counts(df, target).select(F.col("value").cast("string").alias("value"), "n")

