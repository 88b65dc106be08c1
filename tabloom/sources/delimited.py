"""Delimited text with separator, encoding, quoting and types found from the data.

Two scans find everything: one over raw lines (header, encoding and quoted line breaks of each
file), one over text cells (ragged rows, column types). The returned frame is then an ordinary lazy
CSV scan with a cast per column, one for each form that files have. Files are read whole-file
(``multiLine``) only where a quoted cell really holds a line break, so large files stay splittable
in either encoding.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.errors import DataError
from tabloom.functions.columns import col

# Separators in order of preference.
SEPARATORS = [",", ";", "\t", "|"]

# Cell texts that mean "missing".
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

LONG_CELL = r"^\s*[+-]?\d+\s*$"
DOUBLE_CELL = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))\s*$"
OVERFLOW = "_tabloom_overflow"


def detect_separator(first_line: str) -> str:
    """The separator seen most often; the earlier one wins a tie, a comma if there is none."""
    counts = [first_line.count(s) for s in SEPARATORS]
    return SEPARATORS[counts.index(max(counts))] if max(counts) else SEPARATORS[0]


@dataclass
class FileForm:
    """Files of one header, encoding and quoting, which one scan can read."""

    header: str
    encoding: str
    spanning: bool
    files: list[str]


def file_forms(spark: SparkSession, path: str) -> list[FileForm]:
    """The forms among the files of a path, from one scan of raw lines, the most frequent form first.

    A file with bytes that are not UTF-8 is taken as Latin-1; others beside it keep their own encoding.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
    )
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    each = lines.groupBy("file").agg(
        # The first line is the first one read of the block at the file's beginning.
        F.min_by(text, "place").alias("header"),
        F.min(F.is_valid_utf8("value")).alias("utf8"),
        F.max(quotes % 2 == 1).alias("spanning"),
    )
    rows = each.groupBy("header", "utf8", "spanning").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    if not rows:
        raise DataError(f"Dataset '{path}' has no rows.")
    forms = [
        FileForm(r["header"].lstrip("﻿"), "UTF-8" if r["utf8"] else "ISO-8859-1", r["spanning"], [unquote(f) for f in r["files"]])
        for r in rows
    ]
    return sorted(forms, key=lambda f: (-len(f.files), f.files[0]))


def _reader(spark, sep, encoding, spanning):
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", spanning)
        .option("nullValue", "")
        .option("emptyValue", "")
    )


def _header(spark, path, sep, encoding, spanning) -> list[str]:
    # Without inference only the first record is read.
    return _reader(spark, sep, encoding, spanning).csv(path, inferSchema=False).columns


def _cells(spark, path, names, sep, encoding, spanning) -> DataFrame:
    """Text cells, and in one more column the first cell beyond the header's width."""
    fields = [T.StructField(n, T.StringType()) for n in [*names, OVERFLOW]]
    return _reader(spark, sep, encoding, spanning).schema(T.StructType(fields)).csv(path)


def _present(name: str) -> Column:
    """The cell, or NULL if its text means missing."""
    return F.when(~F.coalesce(col(name), F.lit("")).isin(MISSING_TOKENS), col(name))


def read_delimited(
    spark: SparkSession,
    path: str,
    *,
    schema: str | T.StructType | None = None,
    sep: str | None = None,
    encoding: str | None = None,
) -> DataFrame:
    """Read CSV or TSV with a header; separator, encoding and types are found unless given."""
    forms = file_forms(spark, path)
    first = sep or detect_separator(forms[0].header)
    tried = []
    for candidate in [None] if sep else [None, *[s for s in SEPARATORS if s != first]]:
        cells, names = _all_cells(spark, path, forms, sep or candidate, encoding)
        if schema is not None:
            kinds = _declared(names, schema)
            if cells.where(col(OVERFLOW).isNotNull()).isEmpty():
                return _typed(cells, names, kinds)
        else:
            kinds = _infer(cells, names)
            if kinds is not None:
                return _typed(cells, names, kinds)
        tried.append(repr(candidate or first))
    raise DataError(
        f"'{path}' is not a table: rows have more cells than the header with separator {', '.join(tried)}."
    )


def _all_cells(spark, path, forms, sep, encoding) -> tuple[DataFrame, list[str]]:
    """Text cells of all files, each form read by its own header, and the column names of the first form.

    Without ``sep`` each form has the separator its header suggests. Columns go by name, so files may
    order them differently; files with other names cannot be one table.
    """
    parts, names = [], None
    for form in forms:
        use = sep or detect_separator(form.header)
        charset = encoding or form.encoding
        own = _header(spark, form.files[0], use, charset, form.spanning)
        if names is None:
            names = own
        elif sorted(own) != sorted(names):
            raise DataError(f"'{path}' holds files with different columns: {', '.join(names)} and {', '.join(own)}.")
        source = path if len(forms) == 1 else form.files
        parts.append(_cells(spark, source, own, use, charset, form.spanning).select(*[col(n) for n in [*names, OVERFLOW]]))
    return reduce(DataFrame.unionAll, parts), names


def _declared(names, schema) -> dict[str, str]:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    given = {f.name: f.dataType.simpleString() for f in schema}
    return {n: given.get(n, "string") for n in names}


def _infer(cells: DataFrame, names: list[str]) -> dict[str, str] | None:
    """Type per column from one aggregate; None when some row is longer than the header."""
    aggs = [F.count(col(OVERFLOW)).alias("over")]
    for i, n in enumerate(names):
        v = _present(n)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count(F.when(v.rlike(LONG_CELL), F.trim(v).try_cast("bigint"))).alias(f"l{i}"),
            F.count_if(v.rlike(DOUBLE_CELL)).alias(f"d{i}"),
            F.count_if(v.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"b{i}"),
        ]
    row = cells.agg(*aggs).first()
    if row["over"]:
        return None
    kinds = {}
    for i, n in enumerate(names):
        present = row[f"n{i}"]
        if present == row[f"l{i}"] and present:
            kinds[n] = "bigint"
        elif present == row[f"d{i}"]:
            kinds[n] = "double"  # also a column without any value
        elif present == row[f"b{i}"]:
            kinds[n] = "boolean"
        else:
            kinds[n] = "string"
    return kinds


def _typed(cells: DataFrame, names: list[str], kinds: dict[str, str]) -> DataFrame:
    out = []
    for n in names:
        v = _present(n)
        kind = kinds[n]
        out.append((v if kind == "string" else F.trim(v).try_cast(kind)).alias(n))
    return cells.select(*out)
