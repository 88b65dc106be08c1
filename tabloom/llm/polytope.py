"""Near copies among embeddings: cross-polytope hashing after fast Hadamard rotations.

A hash turns a vector by three rounds of random signs and Hadamard transform and takes the axis, with
its sign, that the result lies nearest to. ``HASHES`` of them make a bucket of one of ``TABLES`` tables.
Besides its own bucket a vector also probes the ``PROBES - 1`` whose axes are the next nearest. Two
vectors are candidates if they meet in a bucket; their cosine is then computed from the whole vectors.

1. Equal vectors become one class. Buckets with one member go before any vector moves.
2. Within a bucket, members with a cosine of the threshold or more are connected; tasks give spanning
   links only. Connected components of these are the near-copy classes.
3. Within a class, cut into blocks where it is large, all pairs are compared once more to count each
   vector's links, which also finds links that no bucket has shown.

Defined results: a vector that is missing or zero, or has a missing or non-finite component, links with
nothing, as do vectors of different lengths with each other. Repeated rows are copies, linked with each
other. A missing id is never a class's id if it has another. An empty table gives no rows. Only the id
and the vector are read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.storage import staged
from tabloom.llm.groups import Union, blocks, components, pair_blocks
from tabloom.llm.vectors import matrix, numbered

THRESHOLD = 0.95
TABLES, HASHES, PROBES = 10, 3, 6
#: Axes of each hash that probing may take.
AXES = 4
BLOCK = 1024
_CHOICES = np.array(list(itertools.product(range(AXES), repeat=HASHES)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, whose length is a power of two, scaled to keep lengths."""
    n, dim = x.shape
    half = 1
    while half < dim:
        pairs = x.reshape(n, dim // (2 * half), 2, half)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, dim)
        half *= 2
    return x / np.sqrt(dim)


def _signs(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).choice([-1.0, 1.0], size=(TABLES, HASHES, 3, dim))


def buckets(vectors: np.ndarray) -> np.ndarray:
    """Bucket numbers of each vector: its own and the probed ones of every table."""
    n, length = vectors.shape
    dim = max(AXES, 1 << (length - 1).bit_length())
    x = np.zeros((n, dim))
    x[:, :length] = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for table, signs in enumerate(_signs(dim)):
        loss = np.zeros((n, len(_CHOICES)))
        code = np.full((n, len(_CHOICES)), length * 1000 + table, np.int64)
        for h in range(HASHES):
            y = x
            for sign in signs[h]:
                y = hadamard(y * sign)
            size = np.abs(y)
            near = np.argsort(-size, axis=1, kind="stable")[:, :AXES]
            own = np.take_along_axis(size, near, 1)
            axis = 2 * near + (np.take_along_axis(y, near, 1) < 0)
            loss += (own[:, :1] - own)[:, _CHOICES[:, h]] ** 2
            code = code * (2 * dim + 1) + axis[:, _CHOICES[:, h]]
        best = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        out.append(np.take_along_axis(code, best, 1))
    return np.concatenate(out, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashed(classes: DataFrame) -> DataFrame:
    """(rep, bucket) of every class."""

    def run(batches):
        for batch in batches:
            raw = batch.column(1)
            sizes = np.array([len(v) for v in raw.to_pylist()])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                for at in range(0, len(own), 2048):
                    some = pa.array(own[at : at + 2048])
                    found = buckets(matrix(raw.take(some), size // 8))
                    rep = np.repeat(batch.column(0).take(some).to_numpy(), found.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(found.ravel())], names=["rep", "bucket"])

    return classes.select("rep", "vector").mapInArrow(run, "rep long, bucket long")


def near_links(classes: DataFrame, threshold: float) -> DataFrame:
    """Spanning links (a, b) of classes that meet in a bucket and have the cosine."""
    member = staged(hashed(classes), "buckets")
    sizes = member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    member = member.join(sizes, "bucket").join(classes.select("rep", "vector"), "rep")

    def run(batches):
        for block in blocks(batches, ["bucket", "p", "q"]):
            rep, part, x = block["rep"].to_numpy(), block["part"].to_numpy(), _same_length(block["vector"])
            if x is None:
                continue
            x = _unit(x)
            across = block["p"][0].as_py() != block["q"][0].as_py()
            a, b = [], []
            free = np.arange(len(x))
            while len(free):
                queue, free = [int(free[0])], free[1:]
                while queue and len(free):
                    one = queue.pop()
                    near = x[free] @ x[one] >= threshold
                    if across:
                        near &= part[free] != part[one]
                    if near.any():
                        found = free[near].tolist()
                        a += [one] * len(found)
                        b += found
                        queue += found
                        free = free[~near]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])

    return pair_blocks(member, "bucket", "rep", "size", BLOCK).mapInArrow(run, "a long, b long")


def _same_length(column: pa.ChunkedArray) -> np.ndarray | None:
    """The vectors of a block; none if their lengths differ, which only a chance equality of buckets can cause."""
    raw = column.combine_chunks()
    sizes = {len(v) for v in raw.to_pylist()}
    return matrix(raw, sizes.pop() // 8) if len(sizes) == 1 else None


def counted(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, links): the vectors linked to each class in its blocks."""

    def run(batches):
        for block in blocks(batches, ["component", "p", "q"]):
            rep, part, copies = (block[c].to_numpy() for c in ("rep", "part", "copies"))
            x = _unit(_same_length(block["vector"]))
            p, q = block["p"][0].as_py(), block["q"][0].as_py()
            left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
            near = x[left] @ x[right].T >= threshold
            links = np.zeros(len(rep), np.int64)
            if p == q:
                near = np.triu(near, 1)
            links[left] += near @ copies[right]
            links[right] += copies[left] @ near
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links)], names=["rep", "links"])

    return pair_blocks(members, "component", "rep", "size", BLOCK).mapInArrow(run, "rep long, links long")


def link(rows: DataFrame, *, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each vector: its key, n_links, component_id and kept (key = component_id)."""
    vectors = numbered(rows, key, embedding)
    digest = F.when(F.col("vector").isNotNull(), F.sha2("vector", 256))
    vectors = vectors.withColumn("digest", digest)
    named = vectors.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("row").alias("rep"), F.count("*").alias("copies"), F.min("id").alias("head")
    )
    named = staged(named, "classes")
    classes = staged(vectors.select(F.col("row").alias("rep"), "vector").join(named.select("rep", "copies"), "rep"), "representatives")
    linked = components(near_links(classes, threshold), "near")
    sizes = linked.groupBy("component").agg(F.count("*").alias("size"))
    members = linked.join(sizes, "component").withColumnRenamed("node", "rep").join(classes, "rep")
    links = counted(members, threshold).groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        named.join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .join(links, "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    heads = known.groupBy("component").agg(F.min("head").alias("first"))
    known = known.join(heads, "component").select("digest", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = vectors.select("id", "digest").join(known, "digest", "left")
    component = F.coalesce("first", "id")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
