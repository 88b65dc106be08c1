"""Nearest neighbours by inner product from balanced posting lists.

Largest inner products are smallest distances once each vector x of length at most M gets a further
component ``sqrt(M^2 - |x|^2)``, and a query 0 there.

* Centroids come from a sample of about ``SAMPLE`` vectors, chosen by hash of the row: halved along the
  axis of its two means, at the median, until the halves are as many as the lists wanted. So the lists
  are balanced whatever the data. One list is meant for each ``LIST`` vectors, up to ``MOST_LISTS``.
* Centroids form a graph, each tied to its nearest; a search walks it from a few entry points, many
  vectors at a time, keeping the best ``WIDTH`` seen. The graph's size is bounded by the parameters.
* Every vector is indexed: in its nearest list and, near a boundary, in up to ``COPIES`` lists whose
  distance is within a ratio of the nearest.
* A query takes the lists whose distance is within ``PROBE_RATIO`` of its nearest, ``PROBES`` at most,
  and the ``LEAST_PROBES`` whose centroids have the largest inner product with it: a tight cluster with a
  long centroid may be farther than loose lists with short ones, and yet hold the best.
* A list that is long or asked for often is searched in blocks of (part of the list, part of its
  queries). Tasks return the best of each query, which are then ranked over all blocks.

Scores are inner products of the original vectors in double precision, summed in the same order
wherever a vector stands, so equal vectors tie and go by id.

Defined results: vectors that are missing, zero, or hold missing or non-finite components, and those of
another length than most, take no part. Repeated rows are candidates each. A row without id is a
candidate with a missing id, behind others of the same score, and no query. An id must be a whole number. An
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.functions.storage import staged
from tabloom.llm.groups import blocks
from tabloom.llm.vectors import matrix, numbered

SAMPLE = 20_000
LIST, MOST_LISTS = 200, 8192
DEGREE, ENTRIES, WIDTH = 24, 16, 128
COPIES, COPY_RATIO = 4, 1.1
PROBES, PROBE_RATIO, LEAST_PROBES = 64, 1.15, 16
LIST_PART, QUERY_PART = 4096, 1024


def halved(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` parts of the sample that differ in size by a factor of two at most."""
    parts = [sample]
    while len(parts) < lists:
        parts.sort(key=len)
        rows = parts.pop()
        if len(rows) < 2:
            parts.append(rows)
            break
        a, b = rows[0], rows[np.argmin(rows @ rows[0])]
        for _ in range(4):
            side = rows @ (a - b)
            near = side > np.median(side)
            if not near.any() or near.all():
                break
            a, b = rows[near].mean(axis=0), rows[~near].mean(axis=0)
        order = np.argsort(rows @ (a - b), kind="stable")
        parts += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return np.array([p.mean(axis=0) for p in parts])


@dataclass
class CentroidGraph:
    """Centroids, and for each the numbers of its nearest ones."""

    centroids: np.ndarray
    ties: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> CentroidGraph:
        n, square = len(centroids), (centroids**2).sum(axis=1)
        degree = min(DEGREE, n)
        ties = np.empty((n, degree), np.int64)
        for at in range(0, n, 1024):
            apart = square[None, :] - 2 * centroids[at : at + 1024] @ centroids.T
            ties[at : at + 1024] = np.argsort(apart, axis=1, kind="stable")[:, :degree]
        # A ring over all centroids keeps the graph connected.
        ring = (np.arange(n)[:, None] + np.array([1, -1])) % n
        return cls(centroids, np.concatenate([ties, ring], axis=1))

    def search(self, vectors: np.ndarray, width: int = WIDTH, product: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found for each vector, nearest first, and their distances.

        With ``product`` those of the largest inner products, and no distances in particular.
        """
        found = [self._search(vectors[at : at + 512], width, product) for at in range(0, len(vectors), 512)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _search(self, x: np.ndarray, width: int, product: bool) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(self.centroids), np.arange(len(x))[:, None]
        square = (self.centroids**2).sum(axis=1) * (not product)
        apart = np.full((len(x), n), np.inf)
        opened = np.zeros((len(x), n), bool)

        def look(nodes: np.ndarray) -> None:
            new = np.isinf(apart[rows, nodes])
            r, c = np.nonzero(new)
            node = nodes[r, c]
            apart[r, node] = square[node] - 2 * np.einsum("ij,ij->i", x[r], self.centroids[node])

        look(np.broadcast_to(np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int64)), (len(x), min(ENTRIES, n))))
        keep = min(width, n)
        while True:
            best = np.argpartition(apart, keep - 1, axis=1)[:, :keep]
            value = np.where(opened[rows, best], np.inf, apart[rows, best])
            if np.isinf(value).all():
                break
            nearest = np.argpartition(value, min(8, keep) - 1, axis=1)[:, : min(8, keep)]
            r, c = np.nonzero(np.isfinite(np.take_along_axis(value, nearest, 1)))
            nodes = best[r, nearest[r, c]]
            opened[r, nodes] = True
            live = np.unique(r)
            # Nodes opened by each vector, with its own first one where it opens fewer.
            first = best[np.arange(len(x)), value.argmin(axis=1)]
            table = np.repeat(first[:, None], min(8, keep), axis=1)
            table[r, c] = nodes
            sub = self.ties[table].reshape(len(x), -1)
            idle = np.setdiff1d(np.arange(len(x)), live)
            sub[idle] = best[idle, :1]
            look(sub)
        order = np.take_along_axis(best, np.argsort(apart[rows, best], axis=1, kind="stable"), 1)
        distance = apart[rows, order] + (x**2).sum(axis=1)[:, None]
        return order, np.sqrt(np.maximum(distance, 0))


def _chosen(graph: CentroidGraph, x: np.ndarray, most: int, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, list) within a ratio of each vector's nearest list, or among its ``least`` largest products."""
    order, apart = graph.search(x)
    order, apart = order[:, :most], apart[:, :most]
    r, c = np.nonzero(np.isfinite(apart) & (apart <= ratio * apart[:, :1]))
    chosen = r * len(graph.centroids) + order[r, c]
    if least:
        more = graph.search(x, product=True)[0][:, :least]
        chosen = np.union1d(chosen, (np.arange(len(x))[:, None] * len(graph.centroids) + more).ravel())
    return chosen // len(graph.centroids), chosen % len(graph.centroids)


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes their lengths equal."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(1 - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def build(vectors: DataFrame, count: int, dim: int) -> tuple[CentroidGraph, float]:
    """The centroid graph of a bounded sample, and the greatest length of all vectors."""

    def lengths(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array([float(np.linalg.norm(matrix(batch.column(0), dim), axis=1).max())])], names=["m"])

    longest = vectors.select("vector").mapInArrow(lengths, "m double").agg(F.max("m")).first()[0]
    drawn = vectors.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / count)))
    rows = drawn.select("row", "vector").toArrow().sort_by("row")
    if not len(rows):
        rows = vectors.select("row", "vector").limit(1).toArrow()
    lists = max(1, min(MOST_LISTS, -(-count // LIST)))
    sample = augmented(matrix(rows["vector"].combine_chunks(), dim), longest)
    return CentroidGraph.of(halved(sample, min(lists, len(sample)))), longest


def _lists(rows: DataFrame, graph: CentroidGraph, longest: float, dim: int, query: bool) -> DataFrame:
    """(list, row, id, vector) for each list of each vector, as postings or as queries."""
    shared = rows.sparkSession.sparkContext.broadcast(graph)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                x = matrix(part.column(2), dim)
                if query:
                    y = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)
                    r, c = _chosen(shared.value, y, PROBES, PROBE_RATIO, LEAST_PROBES)
                else:
                    r, c = _chosen(shared.value, augmented(x, longest), COPIES, COPY_RATIO, 0)
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32()), *(part.column(i).take(take) for i in range(3))], names=["list", "row", "id", "vector"]
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("row", "id", "vector").mapInArrow(run, f"list int, row long, id {kind}, vector binary")


def _best(query: np.ndarray, asked: np.ndarray, row: np.ndarray, place: np.ndarray, x: np.ndarray, k: int):
    """(query number, posting number, score) of the k best of a block for each query, own rows left out.

    A fast product finds what may be among the best; those are summed again in a fixed order.
    """
    rough = query @ x.T
    rough[asked[:, None] == row[None, :]] = -np.inf
    if rough.shape[1] > k:
        slack = 1e-9 * (np.linalg.norm(query, axis=1) * np.linalg.norm(x, axis=1).max())
        least = np.partition(rough, -k, axis=1)[:, -k] - slack
        i, j = np.nonzero((rough >= least[:, None]) & np.isfinite(rough))
    else:
        i, j = np.nonzero(np.isfinite(rough))
    score = (query[i] * x[j]).sum(axis=1)
    order = np.lexsort((place[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, np.arange(len(query)))
    keep = np.arange(len(i)) - first[i] < k
    return i[keep], j[keep], score[keep]


def search(
    rows: DataFrame, asked: Column, *, key: str = "vec_id", embedding: str = "embedding", k: int = 20
) -> DataFrame:
    """For rows where ``asked`` holds of the key ``id``: query_id, rank, the key of a neighbour, and score."""
    vectors = numbered(rows, key, embedding).where(F.col("vector").isNotNull())
    kind = vectors.schema["id"].dataType.simpleString()
    empty = rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")
    widths = vectors.groupBy(F.octet_length("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if widths is None:
        return empty
    size, count = widths
    dim = size // 8
    vectors = vectors.where(F.octet_length("vector") == size)
    graph, longest = build(vectors, count, dim)
    postings = staged(_lists(vectors, graph, longest, dim, False), "postings")
    queries = staged(_lists(vectors.where(asked & F.col("id").isNotNull()), graph, longest, dim, True), "queries")
    # One row for each list, of which there are MOST_LISTS at most.
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / LIST_PART).cast("int").alias("ps"))
    sizes = sizes.join(queries.groupBy("list").agg(F.ceil(F.count("*") / QUERY_PART).cast("int").alias("qs")), "list")
    sizes = F.broadcast(sizes)
    lot = lambda n: F.pmod(F.hash("row", F.lit(3)), F.col(n))
    left = postings.join(sizes, "list").select(
        "list", lot("ps").alias("p"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), F.lit(1).alias("kind"), "row", "id", "vector"
    )
    right = queries.join(sizes, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), lot("qs").alias("q"), F.lit(0).alias("kind"), "row", "id", "vector"
    )
    dealt = left.unionByName(right).repartition("list", "p", "q").sortWithinPartitions("list", "p", "q", "kind", F.col("id").asc_nulls_last(), "row")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def merged():
            """The best of each query over the blocks held."""
            table = pa.Table.from_batches(held).combine_chunks()
            keys = ("place", "absent", "score", "query")
            place, absent, score, query = (table[c].to_numpy(zero_copy_only=False) for c in keys)
            order = np.lexsort((place, absent, -score, query))
            query, row = query[order], table["row"].to_numpy()[order]
            _, once = np.unique(np.stack([query, row]), axis=1, return_index=True)
            order = order[np.sort(once)]
            query = table["query"].to_numpy()[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            return table.take(pa.array(order[rank < k])).to_batches()

        size = 0
        for block in blocks(batches, ["list", "p", "q"]):
            block = block.combine_chunks()
            ask = int((block["kind"].to_numpy() == 0).sum())
            if not ask or ask == len(block):
                continue
            x, row = matrix(block["vector"].combine_chunks(), dim), block["row"].to_numpy()
            i, j, score = _best(x[:ask], row[:ask], row[ask:], np.arange(len(block) - ask), x[ask:], k)
            near, who = pa.array(j + ask), pa.array(i)
            near_id = block["id"].combine_chunks().take(near)
            # Ids decide between equal scores of different blocks; a missing one comes last.
            place = near_id.cast(pa.int64()).fill_null(0)
            held.append(
                pa.RecordBatch.from_arrays(
                    [pa.array(row[i]), block["id"].combine_chunks().take(who), pa.array(row[j + ask]), near_id, pa.array(score), place, near_id.is_null()],
                    names=["query", "query_id", "row", "id", "score", "place", "absent"],
                )
            )
            size += len(i)
            if size > 400_000:
                held = merged()
                size = sum(map(len, held))
                if size > 200_000:
                    yield from held
                    held, size = [], 0
        if held:
            yield from merged()

    best = dealt.mapInArrow(run, f"query long, query_id {kind}, row long, id {kind}, score double, place long, absent boolean")
    # A vector may be found in several lists.
    once = best.groupBy("query", "row").agg(*[F.first(c).alias(c) for c in ("query_id", "id", "score")])
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
    ranked = once.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
