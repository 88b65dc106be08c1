"""Reading and writing tables and result documents."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.errors import DataError
from tabloom.functions.columns import missing_to_null
from tabloom.sources.delimited import read_delimited

# File suffix -> format.
FORMATS = {
    ".csv": "csv",
    ".tsv": "csv",
    ".parquet": "parquet",
    ".json": "json",
    ".jsonl": "jsonl",
    ".ndjson": "jsonl",
}


def format_of(path: str, fmt: str | None = None) -> str:
    if fmt:
        if fmt not in FORMATS.values():
            raise DataError(f"Unsupported dataset format '{fmt}': use {', '.join(sorted(set(FORMATS.values())))}.")
        return fmt
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in FORMATS:
        raise DataError(f"Unsupported dataset format '{suffix}': use {', '.join(sorted(FORMATS))}.")
    return FORMATS[suffix]


#: How a document begins that holds values by row number under each column.
_BY_COLUMN = r'^\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\{\s*"\d+"\s*:'


def load_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    *,
    schema: str | T.StructType | None = None,
    allow_empty: bool = False,
    **options,
) -> DataFrame:
    """Read a file, folder or glob; the format follows from the suffix unless given.

    NaN becomes NULL, and a table without rows is refused. A ``schema`` skips the scans that type
    inference needs.
    """
    fmt = format_of(path, fmt)
    try:
        if fmt == "parquet":
            df = spark.read.parquet(path)
        elif fmt == "csv":
            df = read_delimited(spark, path, schema=schema, **options)
        else:
            df = _read_json(spark, path, fmt == "json", schema)
        df = missing_to_null(df)
        if not allow_empty and df.isEmpty():
            raise DataError(f"Dataset '{path}' has no rows.")
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise DataError(f"Dataset '{path}' not found.") from exc
        raise DataError(f"Dataset '{path}' cannot be read: {exc}") from exc
    except PySparkException as exc:
        raise DataError(f"Dataset '{path}' cannot be read: {exc}") from exc
    return df


def _read_json(spark: SparkSession, path: str, document: bool, schema) -> DataFrame:
    if document and schema is None:
        first = spark.read.text(path, wholetext=True).select(F.col("value").rlike(_BY_COLUMN)).first()
        if first and first[0]:
            return _read_json_columns(spark, path)
    reader = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path, multiLine=document)


def _read_json_columns(spark: SparkSession, path: str) -> DataFrame:
    """Documents that hold, under each column, values by row number.

    Each is read as maps of cells, which are dealt out by row and put together again, so a row's width is the
    number of columns and no schema grows with the rows. Types are those that all cells of a column share.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    cells = F.from_json("value", "map<string,map<string,variant>>", {"mode": "FAILFAST"})
    names = text.select(F.map_keys(cells).alias("names"))
    order = [r[0] for r in names.select(F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]
    long = text.select("file", F.explode(cells).alias("name", "cells")).select("file", "name", F.explode("cells").alias("row", "cell"))
    kinds = dict(long.groupBy("name").agg(F.schema_of_variant_agg("cell")).collect())
    known = {"BIGINT": "bigint", "BOOLEAN": "boolean", "DOUBLE": "double", "STRING": "string", "VOID": "string"}
    kind = {n: "double" if kinds.get(n, "VOID").startswith("DECIMAL") else known.get(kinds.get(n, "VOID"), "string") for n in order}
    found = [F.max(F.when(F.col("name") == n, F.try_variant_get("cell", "$", kind[n]))).alias(n) for n in order]
    rows = long.groupBy("file", F.col("row").cast("bigint").alias("row")).agg(*found)
    return rows.select(*[F.col(_quote(n)) for n in order])


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def save_table(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    *,
    overwrite: bool = False,
    partition_by: list[str] | None = None,
) -> str:
    """Write a folder of part files; an existing one is refused unless ``overwrite``."""
    if fmt is None:
        fmt = format_of(path) if os.path.splitext(path)[1] else "parquet"
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        if fmt == "csv":
            sep = "\t" if path.lower().endswith(".tsv") else ","
            writer.csv(path, header=True, sep=sep, escape='"', emptyValue='""')
        elif fmt in ("json", "jsonl"):
            writer.json(path, ignoreNullFields=False)
        else:
            writer.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_ALREADY_EXISTS":
            raise DataError(f"'{path}' exists already; pass overwrite=True to replace it.") from exc
        raise
    return path


def save_splits(df: DataFrame, path: str, column: str = "split", *, overwrite: bool = False) -> str:
    """All parts of a split in one write, one sub-folder per part."""
    return save_table(df, path, "parquet", overwrite=overwrite, partition_by=[column])


def save_document(df: DataFrame, path: str, *, overwrite: bool = False) -> str:
    """Metric or comparison tables as JSON records."""
    return save_table(df, path, "jsonl", overwrite=overwrite)


def dataset_size_mb(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored size of a dataset: the sizes of its distinct files, in MiB."""
    files = spark.read.format(fmt).load(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")
    )
    return (
        files.groupBy("file")
        .agg(F.max("size").alias("size"))
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.round(F.sum("size") / F.lit(1024.0 * 1024.0), 2).alias("size_mb"),
        )
    )
