"""Column predicates and scalar expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.errors import DataError

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)
FLAT_TYPES = NUMERIC_TYPES + (
    T.BooleanType,
    T.StringType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
)

# Fixed value: the text forms accepted as a number once commas and blanks are gone.
NUMBER_PATTERN = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))$"
WHOLE_PATTERN = r"^[+-]?\d+$"


def col(name: str) -> Column:
    """A column reference that survives dots and back-ticks in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(data_type: T.DataType, *, include_boolean: bool = False) -> bool:
    if include_boolean and isinstance(data_type, T.BooleanType):
        return True
    return isinstance(data_type, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, *, include_boolean: bool = False) -> list[str]:
    """Numeric columns in schema order.

    Booleans are categorical for profiling and cleaning, but numeric for target inference and
    feature building; callers choose with ``include_boolean``.
    """
    return [f.name for f in df.schema if is_numeric(f.dataType, include_boolean=include_boolean)]


def categorical_columns(df: DataFrame, *, include_boolean: bool = True) -> list[str]:
    return [
        f.name
        for f in df.schema
        if not is_numeric(f.dataType, include_boolean=not include_boolean)
    ]


def require_flat(df: DataFrame) -> None:
    """Reject nested and binary columns, which no operator here can compare or count."""
    bad = [f.name for f in df.schema if not isinstance(f.dataType, FLAT_TYPES)]
    if bad:
        raise DataError(
            f"Columns of nested or binary type are not supported: {', '.join(bad)}. "
            "Select or flatten the columns first."
        )


def missing_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL, so that one kind of missing value is left."""
    floating = {
        f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floating:
        return df
    return df.select(
        *[
            F.nanvl(col(c), F.lit(None).cast(df.schema[c].dataType)).alias(c)
            if c in floating
            else col(c)
            for c in df.columns
        ]
    )


def missing_count(name: str) -> Column:
    """Aggregate: number of NULL cells of a column."""
    return F.count_if(col(name).isNull())


def squeeze(c: Column) -> Column:
    """Text without commas and white space."""
    return F.regexp_replace(c, r"[,\s]", "")


def text_to_double(c: Column) -> Column:
    """Number held by a text cell, NULL where it holds none.

    The pattern guards against forms that the JVM parser alone would accept, such as ``1d``.
    """
    s = squeeze(c)
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def text_to_long(c: Column) -> Column:
    s = squeeze(c)
    return F.when(s.rlike(WHOLE_PATTERN), s.try_cast("bigint"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, NULL for a zero denominator (plain ``/`` raises in ANSI mode)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def clip(c: Column, low, high) -> Column:
    """Values outside [low, high] moved to the bound; NULL stays NULL.

    ``least``/``greatest`` are not used here: they skip NULL and would fill missing cells.
    """
    return F.when(c < F.lit(low), F.lit(low)).when(c > F.lit(high), F.lit(high)).otherwise(c)


def equal_width_bin(c: Column, low: float, high: float, bins: int) -> Column:
    """Bin number from 0, the last bin closed; NULL stays NULL (``least`` alone would skip it)."""
    place = F.floor((c - F.lit(low)) * bins / F.lit(high - low))
    return F.when(place < bins, place).when(place.isNotNull(), bins - 1).cast("int")

