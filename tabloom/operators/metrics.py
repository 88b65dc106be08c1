"""Evaluation metrics over a predictions table.

All of them are aggregates that combine before the shuffle; none collects rows. Rank metrics
first reduce to one row per distinct score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.errors import EvaluationError
from tabloom.functions.columns import col, equal_width_bin, ratio, ratio_or_zero
from tabloom.functions.longform import union_all
from tabloom.functions.ordering import range_bounds, running_totals
from tabloom.functions.quantiles import quantiles
from tabloom.functions.storage import staged

AVERAGES = ("binary", "macro", "weighted")
#: Labels of a block of a dense confusion matrix.
LABEL_BLOCK = 256
#: The smallest difference from 1 of a double, which keeps logarithms finite.
HAIR = 2.0**-52

# Display names of the metrics.
METRIC_LABELS = {
    "accuracy": "Accuracy",
    "precision": "Precision",
    "recall": "Recall",
    "f1": "F1 Score",
    "roc_auc": "ROC-AUC",
    "mae": "MAE",
    "mse": "MSE",
    "rmse": "RMSE",
    "r2": "R²",
}


@dataclass(frozen=True)
class TaskMetrics:
    """What a task's models are scored, ranked and listed by."""

    scoring: str
    ranking: str
    beside: str


TASK_METRICS = {
    "classification": TaskMetrics("roc_auc_ovr", "accuracy", "f1"),
    "regression": TaskMetrics("r2", "r2", "rmse"),
}


def task_metrics(task: str) -> TaskMetrics:
    try:
        return TASK_METRICS[task]
    except KeyError:
        raise EvaluationError(f"No metrics for task '{task}'; tasks are {', '.join(TASK_METRICS)}.") from None


def pair_counts(df: DataFrame, actual: str, prediction: str) -> DataFrame:
    """Sparse confusion matrix: one row per pair that occurs."""
    return df.groupBy(col(actual).alias("actual"), col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, actual: str, prediction: str, *, dense: bool = True) -> DataFrame:
    """Counts by pair of labels: of every pair of labels (of either side), zero included, if ``dense``.

    The sparse form has one row for each pair that occurs. The dense one puts labels into blocks of about
    ``LABEL_BLOCK`` and joins every label to the blocks, so no list of all labels is held anywhere.
    """
    pairs = pair_counts(df, actual, prediction)
    if not dense:
        return pairs.select("actual", "predicted", col("n").cast("bigint").alias("n"))
    pairs = staged(pairs, "pairs")
    labels = pairs.select(F.explode(F.array("actual", "predicted")).alias("v")).distinct()
    blocks = max(1, math.ceil(labels.count() / LABEL_BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    gathered = labels.groupBy(block("v").alias("block")).agg(F.collect_list("v").alias("held"), F.count_if(F.col("v").isNull()).alias("empty"))
    # A list leaves missing labels out; at most one block has one.
    held = F.when(F.col("empty") > 0, F.concat("held", F.array(F.lit(None)))).otherwise(F.col("held"))
    grid = (
        labels.select(F.col("v").alias("actual"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        .join(gathered.select("block", held.alias("held")), "block")
        .select("actual", F.explode("held").alias("predicted"))
    )
    same = F.col("g.actual").eqNullSafe(F.col("p.actual")) & F.col("g.predicted").eqNullSafe(F.col("p.predicted"))
    return grid.alias("g").join(pairs.alias("p"), same, "left").select(
        "g.actual", "g.predicted", F.coalesce("p.n", F.lit(0)).cast("bigint").alias("n")
    )


def per_label_counts(df: DataFrame, actual: str, prediction: str) -> DataFrame:
    """``(label, hits, actual_n, predicted_n)`` over the labels of either side."""
    pairs = pair_counts(df, actual, prediction)
    sides = F.array(
        F.struct(
            F.col("actual").alias("label"),
            F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits"),
            F.col("n").alias("actual_n"),
            F.lit(0).cast("bigint").alias("predicted_n"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            F.lit(0).cast("bigint").alias("hits"),
            F.lit(0).cast("bigint").alias("actual_n"),
            F.col("n").alias("predicted_n"),
        ),
    )
    return (
        pairs.select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("hits", "actual_n", "predicted_n")])
    )


def classification_metrics(
    df: DataFrame,
    actual: str,
    prediction: str,
    *,
    average: str = "macro",
    positive=None,
    balanced_accuracy: bool = False,
) -> DataFrame:
    """One row: accuracy, precision, recall and F1, to 4 places; a zero division counts as 0.

    ``average="binary"`` scores the ``positive`` label alone, ``"macro"`` is the plain mean over
    the labels of either side, ``"weighted"`` the mean by how often each is the actual one.
    """
    if average not in AVERAGES:
        raise EvaluationError(f"average '{average}' is none of {', '.join(AVERAGES)}.")
    scored = (
        per_label_counts(df, actual, prediction)
        .withColumn("p", ratio_or_zero(F.col("hits"), F.col("predicted_n")))
        .withColumn("r", ratio_or_zero(F.col("hits"), F.col("actual_n")))
        .withColumn("f", ratio_or_zero(2 * F.col("hits"), F.col("actual_n") + F.col("predicted_n")))
    )
    if average == "binary":
        if positive is None:
            raise EvaluationError("Binary averaging needs the positive label.")
        chosen = F.col("label") == F.lit(positive)
        p, r, f = (F.coalesce(F.max(F.when(chosen, F.col(c))), F.lit(0.0)) for c in "prf")
    elif average == "weighted":
        p, r, f = (ratio_or_zero(F.sum(F.col(c) * F.col("actual_n")), F.sum("actual_n")) for c in "prf")
    else:
        p, r, f = (F.avg(c) for c in "prf")
    # The mean recall of labels that do occur: one that is only predicted has no recall.
    balanced = F.avg(F.when(F.col("actual_n") > 0, F.col("r")))
    return scored.agg(
        F.round(ratio(F.sum("hits"), F.sum("actual_n")), 4).alias("accuracy"),
        F.round(p, 4).alias("precision"),
        F.round(r, 4).alias("recall"),
        F.round(f, 4).alias("f1"),
        *([F.round(balanced, 4).alias("balanced_accuracy")] if balanced_accuracy else []),
    )


def class_distribution(df: DataFrame, actual: str, labels: list) -> DataFrame:
    """Rows per known label; labels without a row are present with 0."""
    kind = df.schema[actual].dataType
    counts = [F.count_if(col(actual) == F.lit(v).cast(kind)) for v in labels]
    if len(labels) <= 100:
        rows = [
            F.struct(F.lit(str(v)).alias("label"), n.alias("n")) for v, n in zip(labels, counts)
        ]
        return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    known = df.sparkSession.createDataFrame([(v,) for v in labels], T.StructType([T.StructField("v", kind)]))
    seen = df.groupBy(col(actual).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(seen, "v", "left").select(
        F.col("v").cast("string").alias("label"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


# --------------------------------------------------------------------------- rank metrics
def _per_score(long: DataFrame, by: list[str]) -> DataFrame:
    return long.groupBy(*by, "score").agg(
        F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg")
    )


def _size_and_bounds(long: DataFrame, by: list[str], rows_per_bucket: int | None) -> list[float]:
    """Bucket bounds from the number of distinct scores, which a sketch bounds from the raw rows."""
    row = long.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("score").alias("d")).first()
    distinct = min(row["n"], int(1.3 * row["d"]) + 1)
    if by:
        distinct = row["n"]
    options = {} if rows_per_bucket is None else {"rows_per_bucket": rows_per_bucket}
    return range_bounds(long, "score", distinct, **options)


def _auc(long: DataFrame, by: list[str], rows_per_bucket: int | None = None) -> DataFrame:
    """Tie-correct area under the ROC curve of ``(by, score, pos)`` rows.

    Each positive counts the negatives below it, and half of those with its own score. Counts are
    taken as doubles: their products exceed a long on large tables.
    """
    bounds = _size_and_bounds(long, by, rows_per_bucket)
    ranked = running_totals(_per_score(long, by), "score", ["neg"], by=by, bounds=bounds)
    won = F.col("pos").cast("double") * (F.col("upto_neg") - F.col("neg") / 2.0)
    return ranked.groupBy(*by).agg(
        F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )


def _scored(df: DataFrame, actual: str, score: str, positive) -> DataFrame:
    return df.select(
        col(score).cast("double").alias("score"),
        (col(actual) == F.lit(positive)).cast("bigint").alias("pos"),
    ).where("score is not null and pos is not null")


def roc_auc(df: DataFrame, actual: str, score: str, *, positive, rows_per_bucket: int | None = None) -> DataFrame:
    """Exact binary ROC-AUC as one row, NULL when one of the classes is absent."""
    return _auc(_scored(df, actual, score, positive), [], rows_per_bucket).select(
        F.round("auc", 4).alias("roc_auc")
    )


def roc_auc_ovr(
    df: DataFrame, actual: str, scores: dict, *, macro: bool = True, rows_per_bucket: int | None = None
) -> DataFrame:
    """One-vs-rest ROC-AUC: the plain mean over classes, or one row per class.

    ``scores`` maps each label to its probability column.
    """
    rows = [
        F.struct(
            F.lit(str(label)).alias("label"),
            col(name).cast("double").alias("score"),
            (col(actual) == F.lit(label)).cast("bigint").alias("pos"),
        )
        for label, name in scores.items()
    ]
    long = df.select(F.inline(F.array(*rows))).where("score is not null and pos is not null")
    per_class = _auc(long, ["label"], rows_per_bucket)
    if not macro:
        return per_class.select("label", F.round("auc", 4).alias("roc_auc"))
    return per_class.agg(F.round(F.avg("auc"), 4).alias("roc_auc"))


def roc_curve(df: DataFrame, actual: str, score: str, *, positive, rows_per_bucket: int | None = None) -> DataFrame:
    """Points of the ROC curve by falling threshold, from (0, 0), one per distinct score."""
    long = _scored(df, actual, score, positive)
    bounds = _size_and_bounds(long, [], rows_per_bucket)
    totals = long.agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("q")).first()
    p, q = float(totals["p"] or 0), float(totals["q"] or 0)
    ranked = running_totals(
        _per_score(long, []), "score", ["pos", "neg"], bounds=bounds, descending=True
    )
    points = ranked.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("upto_neg").cast("double"), F.lit(q)).alias("fpr"),
        F.try_divide(F.col("upto_pos").cast("double"), F.lit(p)).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame(
        [(None, 0.0, 0.0)], "threshold double, fpr double, tpr double"
    )
    return origin.unionByName(points)


# --------------------------------------------------------------------------- regression
def regression_metrics(df: DataFrame, actual: str, prediction: str) -> DataFrame:
    """MAE, MSE, RMSE and R² in one aggregate, to 4 places.

    The total sum of squares is the population variance times n: the variance aggregate is merged
    from centred moments, so no cancellation occurs and the mean needs no scan of its own.
    """
    y, e = col(actual).cast("double"), (col(actual) - col(prediction)).cast("double")
    return (
        df.where(col(actual).isNotNull() & col(prediction).isNotNull())
        .agg(
            F.avg(F.abs(e)).alias("mae"),
            F.avg(e * e).alias("mse"),
            F.var_pop(y).alias("var"),
        )
        .select(
            F.round("mae", 4).alias("mae"),
            F.round("mse", 4).alias("mse"),
            F.round(F.sqrt("mse"), 4).alias("rmse"),
            F.round(
                F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).when(
                    F.col("var") == 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
                ),
                4,
            ).alias("r2"),
        )
    )


def residuals(df: DataFrame, actual: str, prediction: str, keep: list[str] | None = None) -> DataFrame:
    return df.select(
        *[col(c) for c in keep or []],
        col(prediction).alias("predicted"),
        (col(actual) - col(prediction)).alias("residual"),
    )


def binned_residuals(df: DataFrame, actual: str, prediction: str, bins: int = 30) -> DataFrame:
    """Residuals summarised over equal-width bins of the prediction, for a plot of a large table."""
    res = residuals(df, actual, prediction)
    edge = res.agg(F.min("predicted").alias("lo"), F.max("predicted").alias("hi")).first()
    if edge["lo"] is None or edge["lo"] == edge["hi"]:
        place = F.lit(0)
    else:
        place = equal_width_bin(F.col("predicted"), float(edge["lo"]), float(edge["hi"]), bins)
    return res.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("predicted").alias("predicted"),
        F.avg("residual").alias("mean"),
        F.min("residual").alias("low"),
        F.max("residual").alias("high"),
    )


# --------------------------------------------------------------------------- scorers
def log_loss(df: DataFrame, actual: str, probabilities: dict) -> DataFrame:
    """Mean negative logarithm of the probability of the actual label.

    Probabilities are kept a hair away from 0 and 1, and a label without one counts as improbable as can be.
    """
    own = F.lit(None).cast("double")
    for label, name in probabilities.items():
        own = F.when(col(actual) == F.lit(label), col(name).cast("double")).otherwise(own)
    kept = F.least(F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(HAIR)), F.lit(1.0 - HAIR))
    return df.where(col(actual).isNotNull()).agg(F.round(F.avg(-F.log(kept)), 4).alias("log_loss"))


def average_precision(df: DataFrame, actual: str, score: str, *, positive, rows_per_bucket: int | None = None) -> DataFrame:
    """Precision at each falling threshold, weighted by the recall gained there; missing without a positive."""
    long = _scored(df, actual, score, positive)
    bounds = _size_and_bounds(long, [], rows_per_bucket)
    ranked = running_totals(_per_score(long, []), "score", ["pos", "neg"], bounds=bounds, descending=True)
    precision = F.col("upto_pos").cast("double") / (F.col("upto_pos") + F.col("upto_neg"))
    gained = F.sum(F.when(F.col("pos") > 0, F.col("pos") * precision).otherwise(0.0))
    return ranked.agg(F.round(F.try_divide(gained, F.sum("pos").cast("double")), 4).alias("average_precision"))


def explained_variance(df: DataFrame, actual: str, prediction: str) -> DataFrame:
    """Share of the variance that is not in the errors; errors that are all alike count as none."""
    y, e = col(actual).cast("double"), (col(actual) - col(prediction)).cast("double")
    known = df.where(y.isNotNull() & e.isNotNull())
    row = known.agg(F.var_pop(e).alias("e"), F.var_pop(y).alias("y"))
    value = F.when(F.col("y") > 0, 1 - F.col("e") / F.col("y")).when(F.col("y") == 0, F.when(F.col("e") == 0, 1.0).otherwise(0.0))
    return row.select(F.round(value, 4).alias("explained_variance"))


def median_absolute_error(df: DataFrame, actual: str, prediction: str) -> DataFrame:
    """The exact median of the absolute errors."""
    errors = df.select(F.abs(col(actual) - col(prediction)).cast("double").alias("e"))
    (value,) = quantiles(errors, ["e"], [0.5])["e"]
    return df.sparkSession.createDataFrame([(None if value is None else round(value, 4),)], "median_absolute_error double")


def _averaged(which: str, average: str):
    def run(df, classes, _):
        positive = classes[-1] if average == "binary" else None
        return classification_metrics(df, "actual", "prediction", average=average, positive=positive).select(which)

    return run


def _ranked(binary, each):
    """A rank metric of the positive class of two, or its mean over classes of more."""

    def run(df, classes, probabilities):
        if len(classes) == 2:
            return binary(df, "actual", probabilities[classes[1]], positive=classes[1])
        return each(df, "actual", probabilities)

    return run


def _mean_average_precision(df: DataFrame, actual: str, probabilities: dict) -> DataFrame:
    found = [average_precision(df, actual, name, positive=label) for label, name in probabilities.items()]
    return union_all(found).agg(F.round(F.avg("average_precision"), 4).alias("average_precision"))


def _regression(which: str):
    return lambda df, _, __: regression_metrics(df, "actual", "prediction").select(which)


#: Scorer -> task, sign and one-row table of (predictions, classes, probability columns).
SCORERS = {
    "roc_auc": ("classification", 1, _ranked(roc_auc, roc_auc_ovr)),
    "roc_auc_ovr": ("classification", 1, _ranked(roc_auc, roc_auc_ovr)),
    "average_precision": ("classification", 1, _ranked(average_precision, _mean_average_precision)),
    "neg_log_loss": ("classification", -1, lambda df, _, p: log_loss(df, "actual", p)),
    "accuracy": ("classification", 1, _averaged("accuracy", "macro")),
    "balanced_accuracy": (
        "classification",
        1,
        lambda df, _, __: classification_metrics(df, "actual", "prediction", balanced_accuracy=True).select("balanced_accuracy"),
    ),
    **{
        metric + ("" if average == "binary" else f"_{average}"): ("classification", 1, _averaged(metric, average))
        for average in ("binary", "macro", "weighted")
        for metric in ("precision", "recall", "f1")
    },
    "r2": ("regression", 1, _regression("r2")),
    "explained_variance": ("regression", 1, lambda df, _, __: explained_variance(df, "actual", "prediction")),
    "neg_mean_absolute_error": ("regression", -1, _regression("mae")),
    "neg_mean_squared_error": ("regression", -1, _regression("mse")),
    "neg_root_mean_squared_error": ("regression", -1, _regression("rmse")),
    "neg_median_absolute_error": ("regression", -1, lambda df, _, __: median_absolute_error(df, "actual", "prediction")),
}


def check_scorer(name: str, task: str, classes: list | None) -> None:
    """Raise where a scorer is unknown or does not fit the task or the number of classes."""
    if name not in SCORERS:
        raise EvaluationError(f"Unknown scoring '{name}'; there are {', '.join(SCORERS)}.")
    if SCORERS[name][0] != task:
        raise EvaluationError(f"Scoring '{name}' is for {SCORERS[name][0]}, not for {task}.")
    if name in ("precision", "recall", "f1") and len(classes or []) != 2:
        raise EvaluationError(f"Scoring '{name}' needs two classes; {name}_macro takes more.")


def score(df: DataFrame, name: str, *, classes: list | None = None, probabilities: dict | None = None) -> float | None:
    """A scorer's value for a table of ``actual`` and ``prediction``: the larger, the better."""
    task, sign, metric = SCORERS[name]
    check_scorer(name, task, classes)
    value = metric(df, classes or [], probabilities or {}).first()[0]
    return None if value is None else sign * value


# --------------------------------------------------------------------------- dispatch
def compute_metrics(
    df: DataFrame,
    task: str,
    *,
    actual: str = "actual",
    prediction: str = "prediction",
    classes: list | None = None,
    probabilities: dict | None = None,
    positive=None,
    average: str | None = None,
) -> DataFrame:
    """Metrics of a predictions table as ``(metric, value)`` rows.

    Two training classes give binary averages for the larger label (or ``positive``), more give
    macro averages, unless ``average`` says which. Labels not seen in training stay in the table as errors.
    """
    if task == "regression":
        return long_metrics(regression_metrics(df, actual, prediction))
    if task != "classification":
        raise EvaluationError(f"Unknown task '{task}': use classification or regression.")
    if classes is None:
        seen = df.select(col(actual).alias("v")).where("v is not null").distinct().orderBy("v")
        classes = [r["v"] for r in seen.limit(3).collect()]
    binary = len(classes) == 2
    if positive is None and binary:
        positive = classes[1]
    parts = [
        long_metrics(
            classification_metrics(
                df,
                actual,
                prediction,
                average=average or ("binary" if binary else "macro"),
                positive=positive if binary and average != "macro" else None,
            )
        )
    ]
    if probabilities:
        area = (
            roc_auc(df, actual, probabilities[positive], positive=positive)
            if binary
            else roc_auc_ovr(df, actual, probabilities)
        )
        parts.append(long_metrics(area).where("value is not null"))
    return union_all(parts)


def long_metrics(row: DataFrame) -> DataFrame:
    """A one-row table of numbers as ``(metric, value)``."""
    cells = [F.struct(F.lit(c).alias("metric"), col(c).alias("value")) for c in row.columns]
    return row.select(F.inline(F.array(*cells)))


def cv_summary(folds: DataFrame, score: str = "score") -> DataFrame:
    """Mean and population standard deviation over the folds, to 4 places."""
    return folds.agg(
        F.round(F.avg(score), 4).alias("cv_mean"),
        F.round(F.stddev_pop(score), 4).alias("cv_std"),
        F.count(score).alias("folds"),
    )
