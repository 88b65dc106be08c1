"""Wide tables as (column, value) rows, one frame per value type.

Statistics that need a grouping per value (distinct counts, modes, category levels) are taken
from this form: one scan and one shuffle for all columns of a type, with map-side combining, in
place of one distinct aggregate per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import col

_GROUPS = (
    ("bigint", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)),
    ("double", (T.FloatType, T.DoubleType)),
    ("string", (T.StringType,)),
    ("boolean", (T.BooleanType,)),
    ("date", (T.DateType,)),
    ("timestamp", (T.TimestampType,)),
    ("timestamp_ntz", (T.TimestampNTZType,)),
)


def group_type(data_type: T.DataType) -> str:
    for name, members in _GROUPS:
        if isinstance(data_type, members):
            return name
    return data_type.simpleString()  # each decimal type is a group of its own


def typed_long(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """Map from group type to a frame ``(column, value)`` without missing values."""
    members: dict[str, list[str]] = {}
    for c in columns:
        members.setdefault(group_type(df.schema[c].dataType), []).append(c)
    result = {}
    for kind, names in members.items():
        cast = df.select(*[col(c).cast(kind).alias(c) for c in names])
        if len(names) == 1:
            frame = cast.select(F.lit(names[0]).alias("column"), col(names[0]).alias("value"))
        else:
            frame = cast.unpivot([], [col(c) for c in names], "column", "value")
        result[kind] = frame.where(F.col("value").isNotNull())
    return result


def value_counts(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """Map from group type to ``(column, value, n)``."""
    return {
        kind: frame.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        for kind, frame in typed_long(df, columns).items()
    }


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def distinct_counts(df: DataFrame, columns: list[str], *, approx: bool = False) -> DataFrame:
    """``(column, distinct)``; a column without any value has no row."""
    if approx:
        stats = [
            F.struct(
                F.lit(c).alias("column"), F.approx_count_distinct(col(c)).alias("distinct")
            )
            for c in columns
        ]
        return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    counted = [
        frame.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
        for frame in value_counts(df, columns).values()
    ]
    return union_all(counted)


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column as text, ties to the smallest value.

    The winner is the minimum of (-n, value), a reducible aggregate, so no task ever holds the
    value table of a column (the built-in ``mode`` does).
    """
    if not columns:
        return {}
    best = [
        frame.groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("value"))).alias("best"))
        .select("column", F.col("best.value").cast("string").alias("value"))
        for frame in value_counts(df, columns).values()
    ]
    return {r["column"]: r["value"] for r in union_all(best).collect()}
