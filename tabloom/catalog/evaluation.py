"""Queries: metrics over rule-made predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog.common import BINARY_SCORES, CLASS_SCORES, VALUE_SCORES, derived, duck, query, table
from tabloom.functions.longform import union_all
from tabloom.operators import metrics as M
from tabloom.plans.training import leaderboard

BINARY, CLASSES, VALUES = duck(BINARY_SCORES), duck(CLASS_SCORES), duck(VALUE_SCORES)


@query(
    "confusion_matrix",
    f"""
WITH p AS ({CLASSES}), l AS (SELECT actual AS v FROM p UNION SELECT prediction FROM p)
SELECT a.v AS actual, b.v AS predicted, count(p.actual) AS n
FROM l a CROSS JOIN l b LEFT JOIN p ON p.actual = a.v AND p.prediction = b.v GROUP BY 1, 2""",
)
def confusion_matrix(spark, d):
    return M.confusion_matrix(derived(spark, d, CLASS_SCORES), "actual", "prediction")


_PER_LABEL = """
l AS (SELECT actual AS v FROM p UNION SELECT prediction FROM p),
c AS (SELECT v, (SELECT count(*) FROM p WHERE actual = v AND prediction = v) AS hit,
             (SELECT count(*) FROM p WHERE actual = v) AS a, (SELECT count(*) FROM p WHERE prediction = v) AS b FROM l),
r AS (SELECT v, coalesce(hit / nullif(b, 0), 0) AS precision, coalesce(hit / nullif(a, 0), 0) AS recall,
             coalesce(2 * hit / nullif(a + b, 0), 0) AS f1 FROM c)
"""
_ACCURACY = "(SELECT round(avg(CASE WHEN actual = prediction THEN 1.0e0 ELSE 0.0e0 END), 4) FROM p) AS accuracy"


@query(
    "classification_metrics",
    f"WITH p AS ({BINARY}), {_PER_LABEL} SELECT {_ACCURACY}, round(precision, 4) AS precision, "
    "round(recall, 4) AS recall, round(f1, 4) AS f1 FROM r WHERE v = 'O'",
)
def classification_metrics(spark, d):
    df = derived(spark, d, BINARY_SCORES)
    return M.classification_metrics(df, "actual", "prediction", average="binary", positive="O")


@query(
    "classification_metrics_macro",
    f"WITH p AS ({CLASSES}), {_PER_LABEL} SELECT {_ACCURACY}, round(avg(precision), 4) AS precision, "
    "round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM r",
)
def classification_metrics_macro(spark, d):
    return M.classification_metrics(derived(spark, d, CLASS_SCORES), "actual", "prediction")


@query(
    "class_distribution",
    "SELECT v AS label, (SELECT count(*) FROM lineitem WHERE l_returnflag = v) AS n "
    "FROM (VALUES ('A'), ('N'), ('R'), ('X')) AS t(v)",
)
def class_distribution(spark, d):
    return M.class_distribution(table(spark, d, "lineitem"), "l_returnflag", ["A", "N", "R", "X"])


def _auc_sql(score, label):
    return f"""
(WITH s AS (SELECT {score} AS score, sum(CASE WHEN actual = '{label}' THEN 1 ELSE 0 END) AS pos,
                   sum(CASE WHEN actual = '{label}' THEN 0 ELSE 1 END) AS neg FROM p GROUP BY 1),
 c AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg / 2 AS below FROM s)
 SELECT sum(pos * below) / (cast(sum(pos) AS double) * sum(neg)) FROM c)"""


@query("roc_auc", f"WITH p AS ({BINARY}) SELECT round({_auc_sql('score', 'O')}, 4) AS roc_auc")
def roc_auc(spark, d):
    return M.roc_auc(derived(spark, d, BINARY_SCORES), "actual", "score", positive="O")


@query(
    "roc_auc_ovr",
    f"WITH p AS ({CLASSES}) SELECT round(({_auc_sql('score_a', 'A')} + {_auc_sql('score_n', 'N')} "
    f"+ {_auc_sql('score_r', 'R')}) / 3, 4) AS roc_auc",
)
def roc_auc_ovr(spark, d):
    df = derived(spark, d, CLASS_SCORES)
    return M.roc_auc_ovr(df, "actual", {"A": "score_a", "N": "score_n", "R": "score_r"})


@query(
    "roc_curve",
    f"""
WITH p AS ({BINARY}),
s AS (SELECT score, sum(CASE WHEN actual = 'O' THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN actual = 'O' THEN 0 ELSE 1 END) AS neg FROM p GROUP BY 1),
t AS (SELECT cast(sum(pos) AS double) AS p, cast(sum(neg) AS double) AS q FROM s)
SELECT score AS threshold, round(sum(neg) OVER (ORDER BY score DESC) / q, 6) AS fpr,
       round(sum(pos) OVER (ORDER BY score DESC) / p, 6) AS tpr FROM s, t
UNION ALL SELECT NULL, 0.0e0, 0.0e0""",
)
def roc_curve(spark, d):
    points = M.roc_curve(derived(spark, d, BINARY_SCORES), "actual", "score", positive="O")
    return points.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(
    "regression_metrics",
    f"""
WITH p AS ({VALUES}), e AS (SELECT actual, actual - prediction AS r, avg(actual) OVER () AS m FROM p)
SELECT round(avg(abs(r)), 4) AS mae, round(avg(r * r), 4) AS mse, round(sqrt(avg(r * r)), 4) AS rmse,
       round(1 - sum(r * r) / sum((actual - m) * (actual - m)), 4) AS r2 FROM e""",
)
def regression_metrics(spark, d):
    return M.regression_metrics(derived(spark, d, VALUE_SCORES), "actual", "prediction")


@query(
    "residuals",
    f"SELECT round(prediction, 6) AS predicted, round(actual - prediction, 6) AS residual FROM ({VALUES})",
)
def residuals(spark, d):
    res = M.residuals(derived(spark, d, VALUE_SCORES), "actual", "prediction")
    return res.select(F.round("predicted", 6).alias("predicted"), F.round("residual", 6).alias("residual"))


@query(
    "cv_summary",
    "SELECT round(avg(score), 4) AS cv_mean, round(stddev_pop(score), 4) AS cv_std, count(*) AS folds FROM "
    "(SELECT o_orderpriority, avg(CASE WHEN o_totalprice > 250000 THEN 1.0e0 ELSE 0.0e0 END) AS score FROM orders GROUP BY 1)",
)
def cv_summary(spark, d):
    hit = F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(0.0)
    folds = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg(hit).alias("score"))
    return M.cv_summary(folds)


_LABELS = {"A": "score_a", "N": "score_n", "R": "score_r"}
_CLASS_SCORERS = [f"{m}_{a}" for m in ("precision", "recall", "f1") for a in ("macro", "weighted")]
_CLASS_SCORERS += ["accuracy", "balanced_accuracy", "neg_log_loss"]
_BINARY_SCORERS = ["precision", "recall", "f1", "average_precision", "neg_log_loss"]
_VALUE_SCORERS = ["r2", "explained_variance", "neg_median_absolute_error", "neg_root_mean_squared_error"]
_KEPT = "least(greatest({}, pow(2, -52)), 1 - pow(2, -52))"


def _scorer_rows(name: str, scorers: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS predictions, '{k}' AS scoring, cast(({v}) AS double) AS value FROM {source}" for k, v in scorers.items()
    )


_SCORING = f"""
WITH p AS ({CLASSES}), {_PER_LABEL}, w AS (SELECT r.*, c.a, c.hit FROM r JOIN c USING (v)),
b AS ({BINARY}), y AS ({VALUES}),
bt AS (SELECT score, sum(CASE WHEN actual = 'O' THEN 1 ELSE 0 END) AS pos, count(*) AS n FROM b GROUP BY 1),
bc AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS hits, sum(n) OVER (ORDER BY score DESC) AS above FROM bt)
""" + " UNION ALL ".join(
    [
        _scorer_rows(
            "classes",
            {
                **{f"{m}_macro": f"round(avg({m}), 4)" for m in ("precision", "recall", "f1")},
                **{f"{m}_weighted": f"round(sum({m} * a) / sum(a), 4)" for m in ("precision", "recall", "f1")},
                "accuracy": "round(sum(hit) / sum(a), 4)",
                "balanced_accuracy": "round(avg(recall) FILTER (a > 0), 4)",
            },
            "w",
        ),
        _scorer_rows(
            "classes",
            {
                "neg_log_loss": "round(avg(ln("
                + _KEPT.format("CASE actual WHEN 'A' THEN score_a WHEN 'N' THEN score_n WHEN 'R' THEN score_r END")
                + ")), 4)"
            },
            "p",
        ),
        _scorer_rows(
            "binary",
            {
                "precision": "round(count(*) FILTER (actual = 'O' AND prediction = 'O') / count(*) FILTER (prediction = 'O'), 4)",
                "recall": "round(count(*) FILTER (actual = 'O' AND prediction = 'O') / count(*) FILTER (actual = 'O'), 4)",
                "f1": "round(2 * count(*) FILTER (actual = 'O' AND prediction = 'O') / (count(*) FILTER (actual = 'O') + count(*) FILTER (prediction = 'O')), 4)",
                "neg_log_loss": "round(avg(ln(" + _KEPT.format("CASE actual WHEN 'O' THEN score ELSE 1 - score END") + ")), 4)",
            },
            "b",
        ),
        _scorer_rows("binary", {"average_precision": "round(sum(pos * hits / above) / sum(pos), 4)"}, "bc"),
        _scorer_rows(
            "values",
            {
                "r2": "round(1 - avg((actual - prediction) * (actual - prediction)) / var_pop(actual), 4)",
                "explained_variance": "round(1 - var_pop(actual - prediction) / var_pop(actual), 4)",
                "neg_median_absolute_error": "-round(quantile_cont(abs(actual - prediction), 0.5), 4)",
                "neg_root_mean_squared_error": "-round(sqrt(avg((actual - prediction) * (actual - prediction))), 4)",
            },
            "y",
        ),
    ]
)


@query("scoring_table", _SCORING)
def scoring_table(spark, d):
    """Scorers by name over three tables of predictions."""
    cases = [
        ("classes", CLASS_SCORES, _CLASS_SCORERS, ["A", "N", "R"], _LABELS),
        ("binary", BINARY_SCORES, _BINARY_SCORERS, ["F", "O"], {"O": "score", "F": "other"}),
        ("values", VALUE_SCORES, _VALUE_SCORERS, None, None),
    ]
    rows = []
    for name, sql, scorers, classes, columns in cases:
        df = derived(spark, d, sql)
        if name == "binary":
            df = df.withColumn("other", 1 - F.col("score"))
        rows += [(name, s, M.score(df, s, classes=classes, probabilities=columns)) for s in scorers]
    return spark.createDataFrame(rows, "predictions string, scoring string, value double")


_RULES = {"by_quantity": "l_quantity > 25", "by_discount": "l_discount > 0.055", "by_tax": "l_tax > 0.035"}


@query(
    "model_leaderboard",
    "SELECT *, cast(row_number() OVER (ORDER BY accuracy DESC, model) AS integer) AS rank FROM ("
    + " UNION ALL ".join(
        f"""
SELECT '{name}' AS model, round(avg(CASE WHEN (l_linestatus = 'O') = ({rule}) THEN 1.0e0 ELSE 0.0e0 END), 4) AS accuracy,
  round(2.0e0 * sum(CASE WHEN l_linestatus = 'O' AND {rule} THEN 1 ELSE 0 END)
    / (sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) + sum(CASE WHEN {rule} THEN 1 ELSE 0 END)), 4) AS f1 FROM lineitem"""
        for name, rule in _RULES.items()
    )
    + ")",
)
def model_leaderboard(spark, d):
    df = table(spark, d, "lineitem")
    rows = []
    for name, rule in _RULES.items():
        scored = df.select(
            F.col("l_linestatus").alias("actual"), F.expr(f"if({rule}, 'O', 'F')").alias("prediction")
        )
        row = M.classification_metrics(scored, "actual", "prediction", average="binary", positive="O")
        rows.append(row.select(F.lit(name).alias("model"), "accuracy", "f1"))
    return leaderboard(union_all(rows), "classification")
