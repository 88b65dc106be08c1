"""Arrow batches inside tasks: slices balanced by bytes, and results beside their keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at a time in a task. One longer text still makes a slice of its own.
SLICE_BYTES = 8 << 20
#: Bytes of an Arrow batch that a session without a bound of its own gets.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session has a bound; long texts else make large ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def texts(column: pa.Array) -> pa.Array:
    """The column as strings with 64-bit offsets; a missing text is empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_bytes(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column.cast(pa.large_binary())).to_numpy(zero_copy_only=False).astype(np.int64)


def by_bytes(batches, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Slices of about ``limit`` text bytes each: the rows, their texts and the bytes of each text."""
    for batch in batches:
        column = texts(batch.column(batch.schema.get_field_index(text)))
        size = text_bytes(column)
        ends = np.cumsum(size)
        start = 0
        while start < len(batch):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start), column.slice(start, stop - start), size[start:stop]
            start = stop


def add_columns(
    rows: DataFrame,
    keys: Sequence[str],
    text: str,
    added: str,
    make: Callable[[], Callable[[pa.Array, np.ndarray], Sequence]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """The key columns and, beside them, what ``make()`` computes of each slice of texts.

    ``make`` runs once in each task and returns a function of (texts, bytes of each) that gives one
    sequence for each column of the schema string ``added``. Other columns of ``rows`` are not read.
    """
    new = T.StructType.fromDDL(added)
    taken = {n.lower() for n in keys}
    if clash := [f.name for f in new if f.name.lower() in taken]:
        raise ValueError(f"key columns {clash} have the names of results; rename them first")
    schema = T.StructType([rows.schema[k] for k in keys] + list(new))
    source = rows.select(*[F.col(_quoted(k)) for k in keys], F.col(_quoted(text)).cast("string").alias("~text"))
    count = len(keys)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        fn, types = make(), [to_arrow_schema(T.StructType([f])).field(0).type for f in new]
        for rows_, column, size in by_bytes(batches, "~text", limit):
            values = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(fn(column, size), types)]
            yield pa.RecordBatch.from_arrays([rows_.column(i) for i in range(count)] + values, names=schema.names)

    return source.mapInArrow(run, schema)


def map_rows(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` that keeps the columns, whatever they are called: within, they are named by place."""
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(rows.schema)])
    return rows.toDF(*schema.names).mapInArrow(run, schema).toDF(*rows.columns)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
