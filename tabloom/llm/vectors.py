"""Vectors in Arrow batches: checked, as bytes of doubles, and back as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.storage import staged


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def usable(embedding: str):
    """Whether a vector takes part: present, not zero, every component present and finite."""
    v = F.col(embedding)
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, sound) & F.exists(v, lambda x: x != 0), F.lit(False))


def numbered(rows: DataFrame, key: str, embedding: str) -> DataFrame:
    """(row, id, vector): vectors as bytes of doubles, nothing for one that takes no part. Stored."""
    ok = usable(embedding)
    source = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("id"),
        F.when(ok, F.col(embedding).cast("array<double>")).alias("v"),
    )

    def run(batches):
        for batch in batches:
            vectors = batch.column(2)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            raw, at, out = flat.tobytes(), 0, []
            for n in vectors.value_lengths().to_pylist():
                out.append(raw[at : at + 8 * n] if n is not None else None)
                at += 8 * (n or 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["row", "id", "vector"])

    kind = source.schema["id"].dataType.simpleString()
    return staged(source.mapInArrow(run, f"row long, id {kind}, vector binary"), "vectors")
