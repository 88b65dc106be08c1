"""Centroid clustering (k-means in whole numbers) over dictionaries of subvectors.

Vectors become whole numbers, ``floor(scale * x)``, and are stored in chunks. A chunk cuts the dimensions
into blocks and keeps, for each block, a dictionary of its distinct subvectors and one code a vector: no
value is lost. Blocks start one dimension wide, and neighbours are joined for as long as all dictionaries
together hold at most ``FILL`` of the subvectors of the chunk, so repetitive vectors get wide blocks.

In a round each distinct subvector's squared distance to its part of every centroid is computed once a
chunk; a vector's distance is the sum of those by its codes. New centroids come from how often each code
occurs in a cluster, so vectors are never decoded. A round moves one sum for each cluster, dimension and
task; centroids, whose number is a parameter, are all that reaches the driver. All sums are exact.

Defined results: vectors of another length than ``dim``, missing ones, and those with a missing or
non-finite component take no part and give no row. Repeated rows count each. A row without id takes part;
as a start it comes after all others. Fewer vectors than clusters give fewer clusters. An empty table
gives no rows. Only the id and the vector are read. A vector with ``|scale * x|`` of ``LARGEST`` or more
ends the run with an error, as its distances might not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.storage import staged
from tabloom.llm.batches import _quoted

#: Vectors of a chunk at most; their codes fit two bytes.
CHUNK = 16_384
#: Subvectors that dictionaries may hold, as a share of all of a chunk, for blocks to be joined.
FILL = 0.25
LARGEST = 1 << 27


def sound(v: Column, dim: int) -> Column:
    """Whether a vector has exactly ``dim`` components, all present and finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & fine, F.lit(False))


@dataclass
class Chunk:
    """Blocks of ``width`` dimensions: for each its distinct subvectors, and the code of each vector."""

    words: list[np.ndarray]
    codes: np.ndarray  # (blocks, vectors)

    @classmethod
    def of(cls, x: np.ndarray) -> Chunk:
        pairs = [np.unique(column, return_inverse=True) for column in x.T]
        words, codes = [w[:, None] for w, _ in pairs], [c for _, c in pairs]
        while len(words) > 1:
            wider_words, wider_codes, room = [], [], FILL * len(x) * (len(words) // 2 + len(words) % 2)
            for i in range(0, len(words) - 1, 2):
                both, code = np.unique(codes[i] * len(words[i + 1]) + codes[i + 1], return_inverse=True)
                first, second = np.divmod(both, len(words[i + 1]))
                wider_words.append(np.concatenate([words[i][first], words[i + 1][second]], axis=1))
                wider_codes.append(code)
                room -= len(both)
                if room < 0:
                    break
            if len(words) % 2:
                wider_words.append(words[-1])
                wider_codes.append(codes[-1])
                room -= len(words[-1])
            if room < 0:
                break
            words, codes = wider_words, wider_codes
        return cls(words, np.array(codes, np.uint16))

    def packed(self) -> tuple[list[list[int]], bytes, bytes]:
        return [list(w.shape) for w in self.words], b"".join(w.astype(np.int32).tobytes() for w in self.words), self.codes.tobytes()

    @classmethod
    def unpacked(cls, shapes: list[list[int]], words: bytes, codes: bytes) -> Chunk:
        flat, out, at = np.frombuffer(words, np.int32), [], 0
        for rows, width in shapes:
            out.append(flat[at : at + rows * width].reshape(rows, width).astype(np.int64))
            at += rows * width
        return cls(out, np.frombuffer(codes, np.uint16).reshape(len(out), -1))

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """(vectors, centroids) squared distances, summed by code from those of the distinct subvectors."""
        total, at = np.zeros((self.codes.shape[1], len(centroids)), np.int64), 0
        for words, code in zip(self.words, self.codes):
            part = centroids[:, at : at + words.shape[1]]
            total += ((words[:, None, :] - part[None, :, :]) ** 2).sum(axis=2)[code]
            at += words.shape[1]
        return total

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """(clusters, dimensions) sums, from how often each code occurs in each cluster."""
        parts = []
        for words, code in zip(self.words, self.codes):
            times = np.bincount(cluster * len(words) + code, minlength=k * len(words)).reshape(k, len(words))
            parts.append(times @ words)
        return np.concatenate(parts, axis=1)


def encode(rows: DataFrame, *, key: str, embedding: str, dim: int, scale: float) -> DataFrame:
    """Chunks of encoded vectors with the ids of their rows. Stored."""
    vector = F.col(_quoted(embedding))
    source = rows.where(sound(vector, dim)).select(F.col(_quoted(key)).alias("id"), vector.cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                x = np.floor(scale * part.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
                if np.abs(x).max() >= LARGEST:
                    raise ValueError(f"a component times {scale:g} is {np.abs(x).max():g}; {LARGEST} or more is too large")
                shapes, words, codes = Chunk.of(x.astype(np.int64)).packed()
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([shapes], pa.list_(pa.list_(pa.int32()))), pa.array([words], pa.binary()), pa.array([codes], pa.binary())],
                    names=["ids", "shapes", "words", "codes"],
                )

    kind = source.schema["id"].dataType.simpleString()
    return staged(source.mapInArrow(run, f"ids array<{kind}>, shapes array<array<int>>, words binary, codes binary"), "subvectors")


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Chunk]]:
    for i in range(len(batch)):
        yield batch.column(0).slice(i, 1).flatten(), Chunk.unpacked(*(batch.column(c)[i].as_py() for c in (1, 2, 3)))


def _nearest(chunk: Chunk, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = chunk.distances(centroids)
    cluster = apart.argmin(axis=1)  # the first of equal ones, which has the smaller number
    return cluster, apart[np.arange(len(apart)), cluster]


def gathered(encoded: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cluster: its number of vectors, their componentwise sums and the sum of their distances."""
    k, dim = centroids.shape

    def run(batches):
        total = np.zeros((k, dim + 2), object)
        for batch in batches:
            for _, chunk in _chunks(batch):
                cluster, apart = _nearest(chunk, centroids)
                inertia = [int(apart[cluster == c].sum()) for c in range(k)]
                count = np.bincount(cluster, minlength=k)
                total += np.concatenate([count[:, None], np.array(inertia, object)[:, None], chunk.sums(cluster, k)], axis=1).astype(object)
        place = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place[0], pa.int32()), pa.array(place[1], pa.int32()), pa.array([int(v) for v in total.ravel()], pa.int64())],
            names=["cluster", "what", "value"],
        )

    # One row for each cluster and component, of which the parameters give the number.
    sums = encoded.mapInArrow(run, "cluster int, what int, value long").groupBy("cluster", "what").agg(F.sum("value").alias("value"))
    out = np.zeros((k, dim + 2), object)
    for r in sums.collect():
        out[r.cluster, r.what] = r.value
    return out[:, 0], out[:, 2:], out[:, 1]


def starts(rows: DataFrame, k: int, *, key: str, embedding: str, dim: int, scale: float, salt: str) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest digests, in that order."""
    vector, name = F.col(_quoted(embedding)), F.col(_quoted(key)).cast("string")
    v = vector.cast("array<double>")
    first = (
        rows.where(sound(vector, dim))
        .select(F.sha2(F.concat(F.lit(salt), name).cast("binary"), 256).alias("digest"), v.alias("v"))
        .orderBy(F.col("digest").asc_nulls_last(), "v")
        .limit(k)
        .collect()
    )
    return np.floor(scale * np.array([r.v for r in first]).reshape(-1, dim)).astype(np.int64)


def fit(
    rows: DataFrame, k: int = 8, rounds: int = 10, *, key: str = "vec_id", embedding: str = "embedding", dim: int = 64,
    scale: float = 1024.0, salt: str = "3:",
) -> tuple[DataFrame, np.ndarray]:
    """The encoded vectors and the centroids after ``rounds`` rounds."""
    kept = dict(key=key, embedding=embedding, dim=dim, scale=scale)
    encoded = encode(rows, **kept)
    centroids = starts(rows, k, salt=salt, **kept)
    for _ in range(rounds if len(centroids) else 0):
        count, sums, _ = gathered(encoded, centroids)
        # Whole-number division rounds down, also below zero; a cluster without vectors stays where it is.
        moved = [[int(s) // int(n) for s in row] if n else old for n, row, old in zip(count, sums, centroids.tolist())]
        centroids = np.array(moved, np.int64)
    return encoded, centroids


def assign(encoded: DataFrame, centroids: np.ndarray, key: str = "vec_id") -> DataFrame:
    """For each vector its key, the number of its nearest centroid and the squared distance."""

    def run(batches):
        for batch in batches:
            for ids, chunk in _chunks(batch):
                cluster, apart = _nearest(chunk, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(apart)], names=["id", "cluster", "distance"])

    kind = encoded.schema["ids"].dataType.elementType.simpleString()
    if not len(centroids):
        return encoded.sparkSession.createDataFrame([], f"{key} {kind}, cluster int, distance long")
    return encoded.mapInArrow(run, f"id {kind}, cluster int, distance long").withColumnRenamed("id", key)


def cluster(rows: DataFrame, *, key: str = "vec_id", embedding: str = "embedding", **options) -> DataFrame:
    """Assignments after the last round, with the inertia of each cluster and of all, and centroid digests."""
    encoded, centroids = fit(rows, key=key, embedding=embedding, **options)
    inertia = [int(v) for v in gathered(encoded, centroids)[2]] if len(centroids) else [0]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()] or [""]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return assign(encoded, centroids, key).select(
        key, "cluster", "distance",
        of(inertia, "long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
    )


def cluster_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The same clustering in SQL, one pair of subqueries a round."""
    nearest = """
a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, arg_min(c, (d, c)) AS c, min(d) AS d, any_value(x) AS x FROM (
    SELECT v.r, v.vec_id, v.x, c.c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)])::BIGINT AS d
    FROM v CROSS JOIN c{i} AS c) GROUP BY r),"""
    moved = """
m{i} AS (
  SELECT c, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY j) AS x FROM (
    SELECT c, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, range(1, {dim} + 1) AS t(j) GROUP BY c, j) GROUP BY c),
c{j} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c{i} AS o LEFT JOIN m{i} AS m USING (c)),"""
    steps = "".join(nearest.format(i=i) + moved.format(i=i, j=i + 1, dim=dim) for i in range(rounds)) + nearest.format(i=rounds)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * y::DOUBLE) AS BIGINT) FOR y IN embedding] AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len([y FOR y IN embedding IF y IS NOT NULL AND isfinite(y)]) = {dim}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < {k}
),{steps}
f AS (SELECT c, sum(d) AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(cluster_inertia AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia, sha256(array_to_string(z.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN f USING (c) JOIN c{rounds} AS z USING (c)
"""
