"""Cleaning: coerce, de-duplicate, drop sparse columns, impute, cap outliers - in that order.

Fitting takes a few aggregates and yields a small set of parameters; applying them is one
projection, which also runs on a stream.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.errors import ConfigError
from tabloom.functions.columns import (
    clip,
    col,
    is_numeric,
    missing_count,
    numeric_columns,
    require_flat,
    text_to_double,
    text_to_long,
)
from tabloom.functions.longform import modes
from tabloom.functions.quantiles import quantiles
from tabloom.functions.storage import staged

MISSING_STRATEGIES = ("mean", "median", "most_frequent", "constant", "drop")
OUTLIER_METHODS = (None, "iqr", "zscore")
BLANK_CELL = r"^[,\s]*$"


@dataclass
class CleanerModel:
    """Parameters of a fitted cleaning step, all of them plain values per column."""

    coerce: dict[str, str] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    drop_rows: bool = False
    fill: dict[str, object] = field(default_factory=dict)
    caps: dict[str, tuple[float, float]] = field(default_factory=dict)
    untouched: list[str] = field(default_factory=list)

    def coerced(self, df: DataFrame) -> DataFrame:
        return coerce_columns(df, self.coerce)

    def imputed(self, df: DataFrame) -> DataFrame:
        """Sparse columns dropped and missing cells handled, on already coerced columns."""
        kept = [f for f in df.schema if f.name not in self.dropped]
        out = df.select(*[self._filled(f) for f in kept])
        return out.na.drop("any") if self.drop_rows else out

    def capped(self, df: DataFrame) -> DataFrame:
        """Values moved to their column's bounds.

        A whole-number column becomes fractional only if the fit data had values to move;
        otherwise the bounds are narrowed to whole numbers, so later data keeps the type too.
        """
        if not self.caps:
            return df
        return df.select(*[self._capped(f) for f in df.schema])

    def _capped(self, f: T.StructField) -> Column:
        if f.name not in self.caps:
            return col(f.name)
        low, high = self.caps[f.name]
        if f.name in self.untouched and isinstance(f.dataType, T.IntegralType):
            c = col(f.name)
            bound = clip(c.cast("bigint"), math.ceil(low), math.floor(high))
            return bound.cast(f.dataType).alias(f.name)
        return clip(col(f.name).cast("double"), low, high).alias(f.name)

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply the fitted step to any frame with the same columns; rows are not de-duplicated."""
        return self.capped(self.imputed(self.coerced(df)))

    def _filled(self, f: T.StructField) -> Column:
        if f.name not in self.fill:
            return col(f.name)
        value = self.fill[f.name]
        kind = f.dataType
        if isinstance(value, float) and is_numeric(kind) and not value.is_integer():
            kind = T.DoubleType()  # a fractional mean or median makes a whole column fractional
        return F.coalesce(col(f.name).cast(kind), F.lit(value).cast(kind)).alias(f.name)

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self), default=str),)], "params string").write.mode(
            "errorifexists"
        ).parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "CleanerModel":
        data = json.loads(spark.read.parquet(path).first()["params"])
        data["caps"] = {k: tuple(v) for k, v in data["caps"].items()}
        return cls(**data)


def _check_options(missing_strategy: str, outlier_method: str | None) -> None:
    if missing_strategy not in MISSING_STRATEGIES:
        raise ConfigError(
            f"missing_strategy '{missing_strategy}' is none of {', '.join(MISSING_STRATEGIES)}."
        )
    if outlier_method not in OUTLIER_METHODS:
        raise ConfigError(f"outlier_method '{outlier_method}' is none of iqr, zscore, None.")


def fit_coercion(df: DataFrame, *, min_share: float = 1.0, exclude: list[str] | None = None) -> dict[str, str]:
    """Text columns that hold numbers, with the type they convert to; ``exclude`` leaves columns as they are.

    Decided over all values. By default one that is neither number nor blank rules a column out. A
    smaller ``min_share`` lets that share of the non-missing values decide; the other cells are then
    lost, and :func:`lost_cells` counts them.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in (exclude or [])]
    if not names:
        return {}
    aggs = []
    for i, c in enumerate(names):
        aggs += [
            F.count(col(c)).alias(f"n{i}"),
            F.count(text_to_double(col(c))).alias(f"d{i}"),
            F.count(text_to_long(col(c))).alias(f"l{i}"),
            F.count_if(col(c).rlike(BLANK_CELL)).alias(f"b{i}"),
        ]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    chosen = {}
    for i, c in enumerate(names):
        present, numbers, whole, blank = (row[f"{k}{i}"] for k in "ndlb")
        enough = numbers + blank == present if min_share >= 1 else numbers >= min_share * present
        if not numbers or not enough:
            continue
        chosen[c] = "bigint" if whole == row["rows"] else "double"
    return chosen


def lost_cells(df: DataFrame, kinds: dict[str, str]) -> Column:
    """Aggregate: how many cells of coerced columns are neither number nor blank, by column, none left out."""
    counts = []
    for c in kinds:
        lost = F.count_if(col(c).isNotNull() & text_to_double(col(c)).isNull() & ~col(c).rlike(BLANK_CELL))
        counts.append(F.struct(F.lit(c).alias("column"), lost.alias("cells")))
    return F.array(*counts).cast("array<struct<column:string,cells:bigint>>")


def coerce_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    if not kinds:
        return df
    parse = {"bigint": text_to_long, "double": text_to_double}
    return df.select(
        *[
            parse[kinds[f.name]](col(f.name)).alias(f.name)
            if f.name in kinds and isinstance(f.dataType, T.StringType)
            else col(f.name)
            for f in df.schema
        ]
    )


def fit_cleaner(
    df: DataFrame,
    *,
    missing_strategy: str = "mean",
    missing_constant: float = 0.0,
    drop_high_missing_threshold: float = 0.8,
    outlier_method: str | None = None,
    outlier_threshold: float = 3.0,
    exclude: list[str] | None = None,
    coerce: dict[str, str] | None = None,
    exact: bool = True,
) -> CleanerModel:
    """Fit on coerced and, if wanted, de-duplicated rows (see :func:`clean_dataframe`).

    ``exclude`` keeps columns such as ids and targets from being dropped, imputed or capped.
    """
    _check_options(missing_strategy, outlier_method)
    require_flat(df)
    model = CleanerModel(coerce=dict(coerce or {}))
    names = df.columns
    numeric = numeric_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        aggs.append(missing_count(c).alias(f"m{i}"))
        if c in numeric:
            aggs.append(F.avg(col(c).cast("double")).alias(f"a{i}"))
    row = df.agg(*aggs).first()
    rows = row["rows"]
    if not rows:
        return model
    missing = {c: row[f"m{i}"] for i, c in enumerate(names)}
    sparse = [c for c in names if missing[c] / rows >= drop_high_missing_threshold]
    model.dropped = [c for c in sparse if c not in (exclude or [])]
    kept = [c for c in names if c not in model.dropped]
    touch = [c for c in kept if c not in (exclude or [])]
    holes = [c for c in touch if missing[c]]

    if missing_strategy == "drop":
        model.drop_rows = True
    elif missing_strategy == "mean":
        model.fill = {c: row[f"a{names.index(c)}"] for c in holes if c in numeric}
    elif missing_strategy == "median":
        wanted = [c for c in holes if c in numeric]
        present = {c: rows - missing[c] for c in wanted}
        middle = quantiles(df, wanted, [0.5], counts=present, exact=exact)
        model.fill = {c: v[0] for c, v in middle.items()}
    elif missing_strategy == "most_frequent":
        best = modes(df, holes)
        # A text column without any value is filled with the empty text.
        model.fill = {
            c: best.get(c, "") for c in holes if c in best or isinstance(df.schema[c].dataType, T.StringType)
        }
    else:
        # The constant takes each column's type; a type it cannot become (a date) is left alone.
        plain = int(missing_constant) if float(missing_constant).is_integer() else missing_constant
        for c in holes:
            kind = df.schema[c].dataType
            if is_numeric(kind):
                model.fill[c] = float(missing_constant)
            elif isinstance(kind, T.StringType):
                model.fill[c] = str(plain)
            elif isinstance(kind, T.BooleanType):
                model.fill[c] = bool(missing_constant)
    model.fill = {c: v for c, v in model.fill.items() if v is not None}

    if outlier_method:
        filled = model.imputed(df)
        wanted = [c for c in touch if c in numeric]
        _fit_caps(model, filled, wanted, outlier_method, outlier_threshold, exact)
    return model


def _fit_caps(model, df, columns, method, threshold, exact) -> CleanerModel:
    """Bounds per column; a column without spread gets none."""
    if not columns:
        return model
    aggs = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        if method == "zscore":
            aggs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    if method == "iqr":
        counts = {c: row[f"n{i}"] for i, c in enumerate(columns)}
        quartiles = quantiles(df, columns, [0.25, 0.75], counts=counts, exact=exact)
    for i, c in enumerate(columns):
        if method == "iqr":
            low, high = quartiles[c]
            spread = None if low is None else high - low
        else:
            low = high = row[f"m{i}"]
            spread = row[f"s{i}"]
        if not spread:
            continue
        low, high = low - threshold * spread, high + threshold * spread
        model.caps[c] = (low, high)
        if row[f"lo{i}"] >= low and row[f"hi{i}"] <= high:
            model.untouched.append(c)
    return model


def drop_sparse_columns(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Without the columns whose missing share reaches the threshold."""
    model = fit_cleaner(df, missing_strategy="constant", drop_high_missing_threshold=threshold)
    return df.drop(*model.dropped)


def impute(df: DataFrame, strategy: str, constant: float = 0.0, **options) -> DataFrame:
    """Only the missing-value step."""
    model = fit_cleaner(
        df, missing_strategy=strategy, missing_constant=constant, drop_high_missing_threshold=2.0, **options
    )
    return model.transform(df)


def cap_outliers(df: DataFrame, method: str | None, threshold: float = 3.0, **options) -> DataFrame:
    """Only the capping step."""
    _check_options("mean", method)
    if method is None:
        return df
    exclude = options.pop("exclude", None) or []
    wanted = [c for c in numeric_columns(df) if c not in exclude]
    model = _fit_caps(CleanerModel(), df, wanted, method, threshold, options.pop("exact", True))
    return model.capped(df)


def clean_dataframe(
    df: DataFrame,
    *,
    drop_duplicates: bool = True,
    missing_strategy: str = "mean",
    missing_constant: float = 0.0,
    drop_high_missing_threshold: float = 0.8,
    outlier_method: str | None = None,
    outlier_threshold: float = 3.0,
    exclude: list[str] | None = None,
    coerce_share: float = 1.0,
    exact: bool = True,
) -> tuple[DataFrame, DataFrame, CleanerModel]:
    """Clean a dataset; returns the rows, a one-row report of counters, and the fitted step.

    ``exclude`` names columns that no step changes or drops. ``coerce_share`` below 1 lets text columns
    become numbers although some cells are none; the report counts the cells lost that way.
    """
    _check_options(missing_strategy, outlier_method)
    require_flat(df)
    kinds = fit_coercion(df, min_share=coerce_share, exclude=exclude)
    coerced = coerce_columns(df, kinds)
    # De-duplication is the one shuffle of whole rows: done once, then read by every later scan.
    base = staged(coerced.distinct(), "deduplicated") if drop_duplicates else coerced
    model = fit_cleaner(
        base,
        missing_strategy=missing_strategy,
        missing_constant=missing_constant,
        drop_high_missing_threshold=drop_high_missing_threshold,
        outlier_method=outlier_method,
        outlier_threshold=outlier_threshold,
        exclude=exclude,
        coerce=kinds,
        exact=exact,
    )
    filled = model.imputed(base)
    cleaned = model.capped(filled)
    return cleaned, _report(df, base, filled, model), model


def _report(source: DataFrame, base: DataFrame, filled: DataFrame, model: CleanerModel) -> DataFrame:
    lost = lost_cells(source, model.coerce)
    before = source.agg(F.count(F.lit(1)).alias("rows_before"), lost.alias("cells_lost"))
    cells = [F.count_if(col(c).isNull()) for c in model.fill]
    middle = base.agg(
        F.count(F.lit(1)).alias("rows_unique"),
        (sum(cells, F.lit(0))).cast("bigint").alias("missing_imputed"),
    )
    out = [F.count_if((col(c) < F.lit(lo)) | (col(c) > F.lit(hi))) for c, (lo, hi) in model.caps.items()]
    after = filled.agg(
        F.count(F.lit(1)).alias("rows_after"),
        sum(out, F.lit(0)).cast("bigint").alias("outliers_capped"),
    )
    # Three one-row tables become one row without a join.
    names = ["rows_before", "cells_lost", "rows_unique", "missing_imputed", "rows_after", "outliers_capped"]
    return (
        before.unionByName(middle, allowMissingColumns=True)
        .unionByName(after, allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in names])
        .select(
            "rows_before",
            "rows_after",
            F.lit(len(source.columns)).alias("columns_before"),
            F.lit(len(filled.columns)).alias("columns_after"),
            (F.col("rows_before") - F.col("rows_unique")).alias("duplicates_dropped"),
            F.array(*[F.lit(c) for c in model.dropped]).cast("array<string>").alias("columns_dropped"),
            "missing_imputed",
            (F.col("rows_unique") - F.col("rows_after")).alias("rows_dropped_missing"),
            "outliers_capped",
            F.array(*[F.lit(c) for c in model.coerce]).cast("array<string>").alias("columns_coerced"),
            F.aggregate("cells_lost", F.lit(0).cast("bigint"), lambda n, c: n + c["cells"]).alias("cells_lost"),
            F.filter("cells_lost", lambda c: c["cells"] > 0).alias("cells_lost_by_column"),
        )
    )
