"""Groups that tasks compare in blocks, and connected components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.storage import staged

#: Rows of (number, number) that are broadcast at most; they are counted first.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """The frame, to be broadcast if it has few rows and joined by shuffle otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def pair_blocks(members: DataFrame, group: str, member: str, size: str, block: int) -> DataFrame:
    """Rows dealt out so that every two members of a group meet in exactly one block.

    A group of up to ``block`` members is one block. A larger one is cut into parts by a hash of the
    member, and each two parts form a block (``p``, ``q``); ``part`` tells a row's own part. Rows of a
    block are together, in order, in one task, so a hot group is spread over many tasks.
    """
    parts = F.ceil(F.col(size) / block).cast("int")
    dealt = members.withColumn("part", F.pmod(F.hash(F.col(member), F.lit(7)), parts))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other")).drop("other", size)
    return dealt.repartition(group, "p", "q").sortWithinPartitions(group, "p", "q", member)


def blocks(batches, keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each block from sorted batches; a block may reach over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        change = np.zeros(len(batch), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0].item() for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if held and a > 0:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1].item() for c in columns)
    if held:
        yield pa.Table.from_batches(held)


class Union:
    """Classes of places 0 to n-1, each known by its smallest place."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for the nodes of links (a, b): the smallest node reachable. Stored.

    Alternates two steps until nothing changes. One ties every larger neighbour of a node to the node's
    smallest neighbour, the other every smaller neighbour. Each round is written to the shared folder.
    Smallest neighbours are found by a grouping that combines in each task, so a node with very many
    links is not gathered anywhere.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    now = staged(links.where("a <> b").select(u.alias("u"), v.alias("v")).distinct(), name)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, state[0], name)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = staged(large.where("u <> v").distinct(), name)
        least = _least(large, state[0], name)
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return staged(now.unionByName(roots).distinct().select(F.col("u").alias("node"), F.col("v").alias("component")), name)


def _least(edges: DataFrame, bound: int, name: str) -> DataFrame:
    found = edges.groupBy("u").agg(F.min("v").alias("m"))
    return F.broadcast(found) if 2 * bound <= BROADCAST_ROWS else staged(found, name)


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of links and a sum of their hashes, which tell whether a round changed anything."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
