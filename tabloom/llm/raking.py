"""Mixing by iterative proportional fitting: rake token weights to marginals, then sample documents.

Documents are summed into cells, one for each combination of levels. Each sweep scales the cells'
factors so that the weighted tokens of every level of one dimension meet their target, dimension after
dimension, until all marginals hold. A document's probability is its cell's factor over the largest
factor, so no probability is cut off and expected tokens have the target marginals. A digest of the key
decides, so the choice does not depend on partitions. Only DataFrame functions are used.

The cell table is the only thing the sweeps touch. It is joined to the documents by broadcast while it
has at most ``BROADCAST_CELLS`` rows, which are counted, and by shuffle beyond.

Defined results: a missing level is the level ``(none)``. A text that is missing or empty has no tokens
and no influence on the factors, and follows its cell. A cell without tokens keeps the factor its
levels give it. A level without a target keeps its share, one without tokens is left out. Repeated
rows are decided alike, a missing key counts as an empty one, and an empty table gives no rows.
Targets that no weights can meet (a level that is the only one of another's documents, with a smaller
share) are an error where the caller gives them; where they are tempered, the last sweep's factors are
used. ``mix_departure`` tells how far a level's tokens were from their target, at most, before the last sweep.
Columns added have a ``mix_`` prefix; other columns stay.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.storage import remove, staged

BROADCAST_CELLS = 100_000
#: Sweeps go on until no level departs further from its target, as a share of it ...
TOLERANCE = 1e-10
#: ... or, where targets contradict each other or nearly do, until departures fall by less than 1% in ten sweeps,
#: and for this many sweeps at most.
SWEEPS = 150
#: Departure from which targets given by the caller count as impossible.
IMPOSSIBLE = 1e-3


def words(text: str = "text") -> Column:
    """Words between single spaces; 0 for a missing or empty text."""
    value = F.coalesce(F.col(text), F.lit(""))
    return F.when(value == "", 0).otherwise(F.length(value) - F.length(F.replace(value, F.lit(" "), F.lit(""))) + 1).cast("long")


def form(text: str = "text", tokens: str = "mix_tokens") -> Column:
    """A topic for tables without one: the form that a text has, by rule."""
    value, n = F.coalesce(F.col(text), F.lit("")), F.col(tokens)
    marks = F.length(value) - F.length(F.replace(value, F.lit("|"), F.lit("")))
    lines = F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit("")))
    return (
        F.when(marks * 4 > n, "table")
        .when(lines * 8 > n, "lines")
        .when(n < 60, "note")
        .when(n < 800, "article")
        .otherwise("book")
    )


def cells_of(rows: DataFrame, dims: Sequence[str], tokens: str) -> DataFrame:
    """Tokens and documents of each combination of levels; summed in each task before the shuffle."""
    return rows.groupBy(*[_level(d).alias(d) for d in dims]).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("docs"))


def _level(dim: str) -> Column:
    return F.coalesce(F.col(dim).cast("string"), F.lit("(none)"))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of a dimension (level, share): the shares of its tokens to a power, scaled to 1."""
    sums = cells.groupBy(F.col(dim).alias("level")).agg(F.sum("tokens").alias("t")).where("t > 0")
    raised = sums.withColumn("p", F.pow(F.col("t").cast("double"), F.lit(power)))
    total = raised.agg(F.sum("p")).first()[0] or 1.0
    return raised.select("level", (F.col("p") / F.lit(total)).alias("share"))


def rake(
    cells: DataFrame, targets: Mapping[str, DataFrame], *, sweeps: int = SWEEPS, tolerance: float = TOLERANCE
) -> tuple[DataFrame, float]:
    """The cells with ``factor``, and the largest departure left; ``targets`` maps a dimension to (level, share).

    Each sweep is written to the shared folder, which cuts the lineage, and its largest departure from a
    target before scaling ends the sweeps when it is within ``tolerance`` or no longer falls.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    aims = {
        d: staged(t.select(F.col("level").alias(d), (F.col("share") * total).alias("aim")).coalesce(1), "aims")
        for d, t in targets.items()
    }
    now = now_stored = staged(cells.withColumn("factor", F.lit(1.0)), "cells")
    worst, past = 0.0, []
    for _ in range(sweeps):
        apart = F.lit(0.0)
        for dim, aim in aims.items():
            held = now.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("factor")).alias("held"))
            scale = held.join(aim, dim).where("held > 0").select(dim, (F.col("aim") / F.col("held")).alias("scale"))
            now = now.join(scale, dim, "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
            apart = F.greatest(apart, F.abs(F.col("scale") - 1))
            now = now.withColumn("factor", F.col("factor") * F.col("scale")).withColumn("apart", apart).drop("scale")
            apart = F.col("apart")
        before, after = now_stored, staged(now, "cells")
        remove(before)
        worst = after.agg(F.max("apart")).first()[0] or 0.0
        now_stored, now = after, after.drop("apart")
        past.append(worst)
        if worst <= tolerance or len(past) > 10 and worst > 0.99 * past[-11]:
            break
    return now, worst


def uniform(key: Column, seed: str) -> Column:
    """A number from 0 up to 1 from the digest of a key, 52 bits of it."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(
    rows: DataFrame,
    dims: Sequence[str],
    *,
    tokens: str,
    key: str = "doc_id",
    power: float | Mapping[str, float] = 0.7,
    targets: Mapping[str, DataFrame] | None = None,
    seed: str = "mix",
) -> DataFrame:
    """The rows with mix_weight (calibrated factor), mix_departure, mix_probability and mix_kept.

    ``targets`` gives (level, share) of each dimension; without it, shares are tempered by ``power``.
    """
    cells = staged(cells_of(rows, dims, tokens), "cells")
    power = power if isinstance(power, Mapping) else dict.fromkeys(dims, power)
    raked, departure = rake(cells, targets or {d: tempered(cells, d, power[d]) for d in dims})
    if targets and departure > IMPOSSIBLE:
        raise ValueError(f"no weights meet the targets: a level stays off by {departure:.2g} of its target")
    top = raked.where("tokens > 0").agg(F.max("factor")).first()[0] or 1.0
    side = raked.select(*[F.col(d).alias(f"~{d}") for d in dims], F.col("factor").alias("mix_weight"), F.lit(float(departure)).alias("mix_departure"))
    side = F.broadcast(side) if raked.count() <= BROADCAST_CELLS else side
    on = [_level(d) == F.col(f"~{d}") for d in dims]
    joined = rows.join(side, on, "left").drop(*[f"~{d}" for d in dims])
    chance = F.least(F.lit(1.0), F.col("mix_weight") / F.lit(float(top)))
    return joined.withColumn("mix_probability", chance).withColumn(
        "mix_kept", uniform(F.col(key), seed) < F.col("mix_probability")
    )


def sweep_sql(dims: Sequence[str], sweeps: int) -> str:
    """SQL for the factors, from ``cells`` (dimensions, tokens) and ``aims`` (dim, level, aim): one step a time.

    ``sweeps`` must be enough for the factors to settle."""
    steps = ["f0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS factor FROM cells)"]
    for i in range(sweeps * len(dims)):
        d = dims[i % len(dims)]
        steps.append(
            f"f{i + 1} AS MATERIALIZED (SELECT f.* REPLACE (f.factor * coalesce(a.aim / nullif(h.held, 0), 1.0) AS factor) FROM f{i} f"
            f" LEFT JOIN (SELECT {d} AS l, sum(tokens * factor) AS held FROM f{i} GROUP BY 1) h ON h.l = f.{d}"
            f" LEFT JOIN aims a ON a.dim = '{d}' AND a.level = f.{d})"
        )
    return ",\n".join(steps) + f",\nraked AS (SELECT * FROM f{sweeps * len(dims)})"
