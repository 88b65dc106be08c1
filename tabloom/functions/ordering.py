"""Global order without a single task: running totals and seeded rank ranges."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import col
from tabloom.functions.storage import staged

ROWS_PER_BUCKET = 1_000_000
MAX_LOCAL_GROUPS = 100_000
COPIES_PER_SLICE = 100_000


# --------------------------------------------------------------------------- running totals
def range_bounds(
    df: DataFrame, order: str, rows: int, *, rows_per_bucket: int = ROWS_PER_BUCKET
) -> list[float]:
    """Inner bucket bounds for a running total over ``order``.

    ``rows`` bounds the number of distinct values; up to one bucket's worth needs no bound.
    """
    buckets = min(10_000, math.ceil(rows / rows_per_bucket))
    if buckets <= 1:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(col(order), shares, 4 * buckets)).first()[0]
    return sorted({float(v) for v in found or []})


def running_totals(
    df: DataFrame,
    order: str,
    sums: list[str],
    *,
    by: list[str] | None = None,
    bounds: list[float] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add ``upto_<name>`` running sums along ``order``, which is unique within ``by``.

    Values are put into range buckets, each bucket is summed in its own task, and the totals of
    earlier buckets are added from a table of one row per bucket.
    """
    by = by or []
    sort = col(order).desc() if descending else col(order).asc()
    if not bounds:
        w = Window.partitionBy(*by).orderBy(sort)
        return df.select(
            "*", *[F.sum(col(s)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"upto_{s}") for s in sums]
        )
    bucketed = Bucketizer(
        splits=[-math.inf, *bounds, math.inf], inputCol=order, outputCol="_bucket"
    ).transform(df)
    rank = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    earlier = Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*by, "_bucket")
        .agg(*[F.sum(col(s)).alias(f"_t_{s}") for s in sums])
        .select(
            *by,
            "_bucket",
            *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        )
    )
    within = (
        Window.partitionBy(*by, "_bucket").orderBy(sort).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        bucketed.select("*", *[F.sum(col(s)).over(within).alias(f"_w_{s}") for s in sums])
        .join(offsets, [*by, "_bucket"])
        .select(
            *[col(c) for c in df.columns],
            *[(F.col(f"_w_{s}") + F.col(f"_o_{s}")).alias(f"upto_{s}") for s in sums],
        )
    )


# --------------------------------------------------------------------------- seeded ranks
def order_hash(key: list[str], seed: int) -> Column:
    """Hex digest that shuffles rows the same way however the table is partitioned."""
    parts = []
    for k in key:
        # Each value's length goes before it, so that different rows cannot spell the same text.
        text = col(k).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat_ws("-", *parts, F.lit(str(seed))))


def number_copies(df: DataFrame, *, slice_rows: int = COPIES_PER_SLICE) -> DataFrame:
    """The same rows with ``_copy``, a number from 0 among equal rows.

    Equal rows are counted, combined before the shuffle, and written out again. A row with very
    many copies is first cut into slices that are spread over tasks.
    """
    whole = F.lit(0).cast("bigint")
    counted = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    names = [col(c) for c in df.columns]
    few = counted.where(F.col("_n") <= slice_rows).select(
        *names, F.explode(F.sequence(whole, F.col("_n") - 1)).alias("_copy")
    )
    sliced = (
        counted.where(F.col("_n") > slice_rows)
        .withColumn("_slice", F.explode(F.sequence(whole, F.expr(f"(_n - 1) div {slice_rows}"))))
        .repartition("_slice", *names)
    )
    start = F.col("_slice") * slice_rows
    many = sliced.select(
        *names,
        F.explode(F.sequence(start, F.least(start + slice_rows, F.col("_n")) - 1)).alias("_copy"),
    )
    return few.unionByName(many)


def label_by_rank(
    df: DataFrame,
    groups: DataFrame,
    labels: list[str],
    *,
    total: int,
    group_count: int,
    key: list[str] | None,
    seed: int,
    by: str | None = None,
    output: str = "split",
) -> DataFrame:
    """Label rows by ranges of their seeded rank, within ``by`` if given.

    ``groups`` has one row per group with ``end_0 .. end_(k-2)``: the last rank (from 1) of every
    label but the final one. Ranks themselves are never computed. The digest at each range end is
    selected (counts per digest prefix, then only the rows of the prefix holding the end), and
    labelling is a comparison with those digests: a projection without a shuffle of the table.

    Rows with equal ``key`` stay together, but for keys whose rows lie on both sides of a range end. Those
    rows are ranked among themselves in a second round, by content and copy number, so parts have their
    exact sizes however often a key repeats. Without ``key`` every row is ranked that way at once.
    """
    spark = df.sparkSession
    columns = df.columns
    if key:
        base = df.withColumn("_h", order_hash(key, seed))
    else:
        # Numbering shuffles the table, so it is done once, and the digests are kept with it.
        numbered = number_copies(df)
        base = staged(numbered.withColumn("_h", order_hash(numbered.columns, seed)), "numbered")
    group = (col(by) if by else F.lit(0)).alias("_g")
    slim = base.select(group, "_h")

    ends = [f"end_{i}" for i in range(len(labels) - 1)]
    wanted = groups.select(
        F.col("_g"), F.posexplode(F.array(*[F.col(e).cast("bigint") for e in ends])).alias("cut", "end")
    ).where("end > 0")

    digits = max(3, math.ceil(math.log(max(total, 1) / ROWS_PER_BUCKET, 16))) if total else 3
    prefix = F.substring("_h", 1, digits)
    through = Window.partitionBy("_g").orderBy("_p")
    table = (
        slim.groupBy("_g", prefix.alias("_p"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(through))
    )
    small = group_count <= MAX_LOCAL_GROUPS
    hint = F.broadcast if small else (lambda frame: frame)
    edge = (
        table.alias("t")
        .join(hint(wanted).alias("w"), F.col("t._g").eqNullSafe(F.col("w._g")))
        .where("end > upto - n and end <= upto")
        .select("w._g", "_p", "cut", (F.col("end") - F.col("upto") + F.col("n")).alias("local"))
    )
    in_edge = (
        slim.withColumn("_p", prefix)
        .alias("s")
        .join(
            hint(edge).alias("e"),
            F.col("s._g").eqNullSafe(F.col("e._g")) & (F.col("s._p") == F.col("e._p")),
        )
        .groupBy("e._g", "cut", "local", "_h")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    inner = Window.partitionBy("_g", "cut").orderBy("_h")
    cuts = (
        in_edge.withColumn("seen", F.sum("copies").over(inner))
        .where("local <= seen and local > seen - copies")
        .select("_g", "cut", "_h", "copies", (F.col("local") - F.col("seen") + F.col("copies")).alias("take"))
    )
    if small:
        rows = cuts.collect()
        cuts = spark.createDataFrame(rows, cuts.schema)
        torn = [r for r in rows if r["take"] < r["copies"]]
    else:
        cuts = staged(cuts, "cuts")
        torn = cuts.where("take < copies").take(1)
    if torn:
        return _torn_apart(base, cuts, groups, labels, columns, group=group, seed=seed, output=output, by=by, key=key)

    limits = groups.select("_g").join(
        hint(
            cuts.groupBy("_g").agg(
                *[F.max(F.when(F.col("cut") == i, F.col("_h"))).alias(f"_c{i}") for i in range(len(ends))]
            )
        ).withColumnRenamed("_g", "_g2"),
        F.col("_g").eqNullSafe(F.col("_g2")),
        "left",
    ).drop("_g2")

    label = None
    for i, name in enumerate(labels[:-1]):
        test = F.col("_h") <= F.col(f"_c{i}")  # an empty range has a NULL end, so nothing matches
        label = F.when(test, F.lit(name)) if label is None else label.when(test, F.lit(name))
    label = F.lit(labels[-1]) if label is None else label.otherwise(F.lit(labels[-1]))

    names = [col(c) for c in columns]
    if by is None and small:
        # One group: the digests become literals, so no join is planned at all.
        firm = {r["cut"]: r["_h"] for r in rows}
        expr = None
        for i, name in enumerate(labels[:-1]):
            if i in firm:
                test = F.col("_h") <= F.lit(firm[i])
                expr = F.when(test, F.lit(name)) if expr is None else expr.when(test, F.lit(name))
        expr = F.lit(labels[-1]) if expr is None else expr.otherwise(F.lit(labels[-1]))
        plain = base.select(*names, "_h", F.lit(0).alias("_g"), expr.alias(output))
    else:
        plain = (
            base.withColumn("_b", group)
            .join(hint(limits), F.col("_b").eqNullSafe(F.col("_g")))
            .select(*names, "_h", "_g", label.alias(output))
        )
    return plain.select(*names, output)


def _torn_apart(base, cuts, groups, labels, columns, *, group, seed, output, by, key) -> DataFrame:
    """Label rows whose key's rows lie on both sides of a range end, and apart from them all others.

    ``cuts`` holds, for each group and range end, the digest there, how many rows have it and how many of
    them are to come before the end. There are at most as many such digests as range ends.
    """
    ends = len(labels) - 1
    torn = cuts.where("take < copies").groupBy("_g", "_h").agg(F.max("copies").alias("copies"))
    at = [F.max(F.when(F.col("c.cut") == i, F.struct("c._h", "c.take"))).alias(f"_e{i}") for i in range(ends)]
    ranged = (
        torn.alias("t")
        .join(cuts.alias("c"), F.col("t._g").eqNullSafe(F.col("c._g")))
        .groupBy("t._g", "t._h", "t.copies")
        .agg(*at)
    )
    # Of a digest's rows those before a range end: all if the end lies further on, none if it lies before.
    upto = [
        F.when(F.col(f"_e{i}._h") == F.col("_h"), F.col(f"_e{i}.take"))
        .when(F.col(f"_e{i}._h") > F.col("_h"), F.col("copies"))
        .otherwise(F.lit(0))
        .alias(f"end_{i}")
        for i in range(ends)
    ]
    # A group's number is part of the name of a digest within it.
    name = lambda g, h: F.concat(F.coalesce(g.cast("string"), F.lit("")), F.lit(":"), h)
    second = staged(ranged.select(name(F.col("_g"), F.col("_h")).alias("_g"), *upto), "torn")
    few = second.count()
    marked = base.withColumn("_key", name(group, F.col("_h")))
    one = second.select(F.col("_g").alias("_torn"))
    if few <= MAX_LOCAL_GROUPS:
        one = F.broadcast(one)
    mixed = marked.join(one, F.col("_key") == F.col("_torn"), "left_semi").select(*[col(c) for c in columns], "_key")
    mixed = staged(mixed, "torn")
    inside = label_by_rank(
        mixed, second, labels, total=mixed.count(), group_count=few, key=None, seed=seed, by="_key", output=output
    )
    others = marked.join(one, F.col("_key") == F.col("_torn"), "left_anti").select(*[col(c) for c in columns])
    # Without those rows every end lies between two keys: what comes before it is one digest shorter.
    lost = staged(
        ranged.select("_g", *upto).groupBy("_g").agg(*[F.sum(f"end_{i}").alias(f"_in{i}") for i in range(ends)]), "torn"
    )
    rest = groups.alias("g").join(lost.alias("l"), F.col("g._g").eqNullSafe(F.col("l._g")), "left").select(
        "g._g", *[(F.col(f"end_{i}") - F.coalesce(F.col(f"_in{i}"), F.lit(0))).alias(f"end_{i}") for i in range(ends)]
    )
    rest = staged(rest, "groups")
    outside = label_by_rank(
        others, rest, labels, total=others.count(), group_count=rest.count(), key=key, seed=seed, by=by, output=output
    )
    return outside.unionByName(inside.drop("_key"))
