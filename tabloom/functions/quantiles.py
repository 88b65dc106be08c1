"""Exact quantiles (linear interpolation) that do not depend on one task holding a column.

A small input uses the built-in ``percentile`` aggregate, whose state is a value -> count map per
column; its size is checked from the row count first. Beyond that, order statistics are selected
by narrowing. A sketch proposes a bracket around each wanted rank; one scan counts the values
between the brackets and, once few enough rows are left, lists those inside; a running count then
says which value has the rank. Each step is one scan whose result is combined before the shuffle.
Counting makes the answer exact whatever the sketch's error: a rank that a bracket missed is
looked for again in the interval that holds it.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import clip, col

SMALL_CELLS = 400_000
SMALL_BRACKET = 1_000_000
SKETCH_SIZE = 4_000
SKETCH_MARGIN = 0.002


def quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    *,
    counts: dict[str, int] | None = None,
    exact: bool = True,
    small_cells: int = SMALL_CELLS,
    small_bracket: int = SMALL_BRACKET,
) -> dict[str, list[float | None]]:
    """Quantiles of numeric columns, ignoring missing values.

    ``counts`` are the non-missing counts per column when the caller has them already. With
    ``exact=False`` one sketch pass answers.
    """
    if not columns:
        return {}
    if not exact:
        return _one_aggregate(
            df, columns, lambda v: F.percentile_approx(v, probabilities, 10_000), len(probabilities)
        )
    if counts is None:
        row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        counts = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    if sum(counts[c] for c in columns) <= small_cells:
        return _one_aggregate(df, columns, lambda v: F.percentile(v, probabilities), len(probabilities))

    places = {
        c: [p * (counts[c] - 1) for p in probabilities] if counts[c] else [] for c in columns
    }
    wanted = {
        c: sorted({f(x) for x in xs for f in (math.floor, math.ceil)}) for c, xs in places.items()
    }
    found = select_ranks(df, wanted, counts, small_bracket=small_bracket)
    result: dict[str, list[float | None]] = {}
    for c in columns:
        result[c] = [] if counts[c] else [None] * len(probabilities)
        for x in places[c]:
            low, high = found[c, math.floor(x)], found[c, math.ceil(x)]
            between = (math.ceil(x) - x) * low + (x - math.floor(x)) * high
            result[c].append(low if low == high else between)
    return result


def _one_aggregate(df, columns, make, width) -> dict[str, list[float | None]]:
    row = df.agg(*[make(col(c).cast("double")).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return {c: list(row[f"q{i}"] or [None] * width) for i, c in enumerate(columns)}


@dataclass
class _Search:
    """Ranks of a column known to lie in an open interval of its values."""

    column: str
    places: list[int]
    low: float | None
    high: float | None
    below: int
    size: int

    def value(self) -> Column:
        """The cell if it lies in the interval, else NULL."""
        # Bucket bounds must be finite, so infinities stand in as the largest finite numbers.
        c = clip(col(self.column).cast("double"), -sys.float_info.max, sys.float_info.max)
        test = c.isNotNull()
        if self.low is not None:
            test = test & (c > F.lit(self.low))
        if self.high is not None:
            test = test & (c < F.lit(self.high))
        return F.when(test, c)

    def shares(self) -> list[float]:
        near = []
        for p in self.places:
            share = (p - self.below) / self.size
            near += [max(0.0, share - SKETCH_MARGIN), min(1.0, share + 1 / self.size + SKETCH_MARGIN)]
        return near


def select_ranks(
    df: DataFrame,
    wanted: dict[str, list[int]],
    counts: dict[str, int],
    *,
    small_bracket: int = SMALL_BRACKET,
) -> dict[tuple[str, int], float]:
    """Exact values at 0-based ranks of numeric columns: ``{(column, rank): value}``."""
    found: dict[tuple[str, int], float] = {}
    open_ = [_Search(c, ps, None, None, 0, counts[c]) for c, ps in wanted.items() if ps]
    while open_:
        open_ = _narrow(df, open_, small_bracket, found)
    return {k: math.copysign(math.inf, v) if abs(v) == sys.float_info.max else v for k, v in found.items()}


def _narrow(df, searches, small_bracket, found) -> list[_Search]:
    """One sketch scan and one counting scan; fills ``found`` and returns what is still open."""
    values = df.select(*[s.value().alias(f"v{i}") for i, s in enumerate(searches)])
    sketches = values.agg(
        *[
            F.kll_sketch_get_quantile_double(
                F.kll_sketch_agg_double(f"v{i}", F.lit(SKETCH_SIZE)),
                F.array(*[F.lit(x) for x in s.shares()]),
            ).alias(f"v{i}")
            for i, s in enumerate(searches)
        ]
    ).first()
    splits, kept = [], []
    for i, s in enumerate(searches):
        marks = sketches[f"v{i}"]
        brackets = list(zip(marks[0::2], marks[1::2]))
        # Each bracket end is a bucket of its own, so the open part between loses both every time.
        inner = {e for m in marks for e in (m, math.nextafter(m, math.inf))}
        edges = [-math.inf, *sorted(inner - {math.inf}), math.inf]
        splits.append(edges)
        few = 2 * SKETCH_MARGIN * s.size * len(s.places) <= small_bracket or s.size <= small_bracket
        kept.append(
            [b for b, e in enumerate(edges[:-1]) if few and any(lo <= e <= hi for lo, hi in brackets)]
        )
    names = [f"v{i}" for i in range(len(searches))]
    bucketed = Bucketizer(
        inputCols=names,
        outputCols=[f"b{i}" for i in range(len(searches))],
        splitsArray=splits,
        handleInvalid="keep",
    ).transform(values)
    cells = []
    for i in range(len(searches)):
        bucket, v = F.col(f"b{i}"), F.col(f"v{i}")
        cells += [
            F.lit(i),
            F.when(v.isNotNull(), bucket.cast("int")),
            F.when(bucket.isin(kept[i]), v) if kept[i] else F.lit(None).cast("double"),
        ]
    long = bucketed.select(F.stack(F.lit(len(searches)), *cells).alias("tag", "bucket", "value"))
    running = Window.partitionBy("tag").orderBy("bucket", "value")
    counted = (
        long.where("bucket is not null")
        .groupBy("tag", "bucket", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(running))
    )
    asked = df.sparkSession.createDataFrame(
        [(i, p, p - s.below) for i, s in enumerate(searches) for p in s.places],
        "tag int, place bigint, local bigint",
    )
    hits = (
        counted.join(F.broadcast(asked), "tag")
        .where((F.col("upto") > F.col("local")) & (F.col("upto") - F.col("n") <= F.col("local")))
        .collect()
    )
    again: dict[tuple[int, int], _Search] = {}
    for r in hits:
        s, edges = searches[r["tag"]], splits[r["tag"]]
        if r["value"] is not None:
            found[s.column, r["place"]] = r["value"]
            continue
        start, end = edges[r["bucket"]], edges[r["bucket"] + 1]
        if math.nextafter(start, math.inf) == end:
            found[s.column, r["place"]] = start
            continue
        low = s.low if start == -math.inf else math.nextafter(start, -math.inf)
        high = s.high if end == math.inf else end
        known = again.setdefault(
            (r["tag"], r["bucket"]),
            _Search(s.column, [], low, high, s.below + r["upto"] - r["n"], r["n"]),
        )
        known.places.append(r["place"])
    return list(again.values())
