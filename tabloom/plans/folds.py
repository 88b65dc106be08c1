"""Cross-validation of ridge models from the sufficient statistics of each fold.

Preprocessing and least squares are both linear in a *raw design*: for each row a one, for each numeric
column its value (0 where missing) and whether it is missing, and for each categorical column one place a
level and one for missing. Imputing, scaling and encoding, fitted on any rows, are a matrix applied to that
design. So one scan adds up the products of the design, and of the target, for every fold; what a fold is
trained on is the sum of the others, and what it is measured on is its own. No fold scans rows again.

Scans: one for facts by fold, one for levels by fold, one for the products; and for columns with missing
numbers one selection of medians a fold.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import col, is_numeric
from tabloom.functions.quantiles import quantiles
from tabloom.operators.features import MAX_CATEGORIES

#: Scorers that follow from sums of squares.
SCORERS = ("r2", "neg_mean_squared_error", "neg_root_mean_squared_error")
#: Places of the raw design. The products, a square of this for each fold, are held by the driver.
MOST_PLACES = 1_500


def ridge_scores(
    df: DataFrame, target: str, alpha: float, *, fold: str, scoring: str, exclude: list[str] | None = None,
    fit_intercept: bool = True, max_categories: int = MAX_CATEGORIES, scale_numerical: bool = True, scaler: str = "standard",
    categorical_encoding: str = "onehot", handle_unknown: str = "ignore", exact: bool = True, **_,
) -> list[float] | None:
    """Scores of the folds in order; nothing where they do not follow from the products alone.

    That is so for other scorers and scalers, ordinal codes, refused levels, and very wide designs.
    """
    if scoring not in SCORERS or scaler not in ("standard", "minmax") or categorical_encoding != "onehot" or handle_unknown != "ignore":
        return None
    df = df.where(col(target).isNotNull())
    fields = [f for f in df.schema if f.name not in {target, fold, *(exclude or [])}]
    numeric = [f.name for f in fields if is_numeric(f.dataType, include_boolean=True)]
    text = [f.name for f in fields if f.name not in numeric]
    facts = _facts(df, target, fold, numeric, text)
    folds = sorted(facts)
    text = [c for i, c in enumerate(text) if max(facts[f][f"d{i}"] for f in folds) <= 2 * max_categories + 20]
    counts = _levels(df, fold, text)
    levels = {c: sorted({v for (_, n, v) in counts if n == c}) for c in text}
    if 1 + 2 * len(numeric) + sum(len(v) + 1 for v in levels.values()) > MOST_PLACES:
        return None
    centre = {}
    for i, c in enumerate(numeric):
        n = sum(facts[f][f"n{i}"] for f in folds)
        centre[c] = sum(facts[f][f"n{i}"] * (facts[f][f"a{i}"] or 0.0) for f in folds) / n if n else 0.0
    # About its mean the target's squares keep their digits; without an intercept it stays where it is.
    middle = sum(facts[f]["rows"] * facts[f]["y"] for f in folds) / sum(facts[f]["rows"] for f in folds) if fit_intercept else 0.0
    products = _products(df, target, fold, numeric, centre, levels, middle)
    medians = _medians(df, fold, folds, numeric, facts, exact)
    out = []
    for f in folds:
        others = [g for g in folds if g != f]
        train = sum(products[g] for g in others)
        design = _design(train, others, facts, counts, numeric, centre, levels, medians[f], max_categories, scale_numerical, scaler)
        weights = _solved(train, design, alpha, fit_intercept)
        out.append(_score(products[f], design @ weights, scoring))
    return out


def _facts(df, target, fold, numeric, text) -> dict:
    aggs = [F.count(F.lit(1)).alias("rows"), F.avg(col(target).cast("double")).alias("y")]
    for i, c in enumerate(numeric):
        v = col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    aggs += [F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(text)]
    return {r["_f"]: r for r in df.groupBy(col(fold).alias("_f")).agg(*aggs).collect()}


def _levels(df, fold, text) -> dict[tuple, int]:
    """Rows by (fold, column, level) of columns with few levels."""
    if not text:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in text])
    long = df.select(col(fold).alias("_f"), F.inline(cells)).where("value is not null")
    return {(r["_f"], r["column"], r["value"]): r["n"] for r in long.groupBy("_f", "column", "value").agg(F.count("*").alias("n")).collect()}


def _medians(df, fold, folds, numeric, facts, exact) -> dict:
    holed = [c for i, c in enumerate(numeric) if any(facts[f][f"n{i}"] < facts[f]["rows"] for f in folds)]
    if not holed:
        return {f: {} for f in folds}
    return {f: {c: v[0] for c, v in quantiles(df.where(col(fold) != f), holed, [0.5], exact=exact).items()} for f in folds}


def _products(df, target, fold, numeric, centre, levels, middle) -> dict[int, np.ndarray]:
    """For each fold the products of the raw design with itself and with the target, which comes last."""
    values = [F.coalesce(col(c).cast("double") - F.lit(centre[c]), F.lit(0.0)) for c in numeric]
    holes = [col(c).isNull().cast("double") for c in numeric]
    # A level's place from 0; the last place of a column stands for missing.
    codes = [
        F.coalesce(F.array_position(F.array(*[F.lit(v) for v in levels[c]]), col(c).cast("string")) - 1, F.lit(len(levels[c]))).cast("int")
        for c in levels
    ]
    none = F.array().cast("array<int>")
    wide = df.select(
        col(fold).cast("int").alias("fold"), F.array(*values, *holes, col(target).cast("double") - F.lit(middle)).alias("x"), (F.array(*codes) if codes else none).alias("codes")
    )
    p, first = len(numeric), 1 + 2 * len(numeric)
    offsets = first + np.cumsum([0, *[len(v) + 1 for v in levels.values()]])[:-1]
    size = first + sum(len(v) + 1 for v in levels.values()) + 1

    def run(batches):
        total = defaultdict(lambda: np.zeros((size, size)))
        for batch in batches:
            n = len(batch)
            x = batch.column(1).flatten().to_numpy().reshape(n, 2 * p + 1)
            z = np.zeros((n, size))
            z[:, 0], z[:, 1:first], z[:, -1] = 1.0, x[:, :-1], x[:, -1]
            code = batch.column(2).flatten().to_numpy().reshape(n, len(offsets))
            z[np.arange(n)[:, None], offsets + code] = 1.0
            of = batch.column(0).to_numpy()
            for f in np.unique(of):
                own = z[of == f]
                total[int(f)] += own.T @ own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], names=["fold", "products"]
        )

    def added(found: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(raw.as_py()) for raw in found["products"])
        return pa.table([found["fold"][:1].combine_chunks(), pa.array([total.tobytes()], pa.binary())], names=["fold", "products"])

    summed = wide.mapInArrow(run, "fold int, products binary").groupBy("fold").applyInArrow(added, "fold int, products binary")
    return {r.fold: np.frombuffer(bytes(r.products)).reshape(size, size) for r in summed.collect()}


def _design(train, others, facts, counts, numeric, centre, levels, medians, max_categories, scale, scaler) -> np.ndarray:
    """The matrix from the raw design to the features that preprocessing fitted on the other folds would give.

    Its first column is the one of the intercept.
    """
    size, n = len(train) - 1, train[0, 0]
    one = np.zeros(size)
    one[0] = 1.0
    columns = [one]
    for i, c in enumerate(numeric):
        there = [facts[g] for g in others if facts[g][f"n{i}"]]
        if not there or min(g[f"lo{i}"] for g in there) == max(g[f"hi{i}"] for g in there):
            continue
        t = np.zeros(size)
        t[1 + i], t[1 + len(numeric) + i] = 1.0, medians.get(c, centre[c]) - centre[c]
        if scale and scaler == "minmax":
            low, high = min(g[f"lo{i}"] for g in there), max(g[f"hi{i}"] for g in there)
            t[0] = -(low - centre[c])
            t = t / (high - low)
        elif scale:
            mean = train[0, :size] @ t / n
            spread = t @ train[:size, :size] @ t / n - mean**2
            t[0] -= mean
            t = t / (max(spread, 0.0) ** 0.5 or 1.0)
        columns.append(t)
    at = 1 + 2 * len(numeric)
    for c, held in levels.items():
        seen = {v: sum(counts.get((g, c, v), 0) for g in others) for v in held}
        known = [v for v in held if seen[v]]
        if 1 < len(known) <= max_categories:
            mode = min(known, key=lambda v: (-seen[v], v))
            for v in known:
                t = np.zeros(size)
                t[at + held.index(v)] = 1.0
                if v == mode:
                    t[at + len(held)] = 1.0
                columns.append(t)
        at += len(held) + 1
    return np.array(columns).T


def _solved(train: np.ndarray, design: np.ndarray, alpha: float, intercept: bool) -> np.ndarray:
    gram, along = design.T @ train[:-1, :-1] @ design, design.T @ train[:-1, -1]
    penalty = alpha * np.eye(len(gram))
    penalty[0, 0] = 0.0
    if intercept:
        return np.linalg.solve(gram + penalty, along)
    return np.concatenate([[0.0], np.linalg.solve((gram + penalty)[1:, 1:], along[1:])])


def _score(held: np.ndarray, weights: np.ndarray, scoring: str) -> float:
    n, y, yy = held[0, 0], held[0, -1], held[-1, -1]
    error = max(0.0, yy - 2 * weights @ held[:-1, -1] + weights @ held[:-1, :-1] @ weights)
    if scoring == "r2":
        total = yy - y * y / n
        return round(float(1 - error / total if total > 0 else error == 0), 4)
    return -round(float(error / n if scoring == "neg_mean_squared_error" else (error / n) ** 0.5), 4)
