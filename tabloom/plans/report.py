"""Tables behind the exploratory figures, the evaluation figures and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.errors import EvaluationError
from tabloom.functions.columns import col, numeric_columns
from tabloom.functions.longform import union_all
from tabloom.operators import metrics as M
from tabloom.operators import profile as P
from tabloom.operators.validate import validate

TOP_FEATURES = 15
REPORT = "section string, item string, value string"


def eda_tables(df: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """Every exploratory table that applies to the dataset; the others are left out."""
    report = validate(df, required_columns=[target] if target else None)
    tables = {"warnings": report.findings}
    if numeric_columns(df):
        tables["describe"] = P.numeric_describe(df)
        tables["feature_histograms"] = P.feature_histograms(df)
    if len(numeric_columns(df)) >= 2:
        tables["correlation"] = P.correlation_matrix(df)
    if target and target in df.columns:
        tables["target_distribution"] = P.target_distribution(df, target)
    return tables


def evaluation_tables(
    scored: DataFrame,
    task: str,
    *,
    actual: str = "actual",
    prediction: str = "prediction",
    classes: list | None = None,
    probabilities: dict | None = None,
    importance: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables for the figures of an evaluated model, as far as they apply."""
    if task not in ("classification", "regression"):
        raise EvaluationError(f"Unknown task '{task}': use classification or regression.")
    tables: dict[str, DataFrame] = {}
    if task == "classification":
        tables["confusion_matrix"] = M.confusion_matrix(scored, actual, prediction)
        if probabilities and classes and len(classes) == 2:
            tables["roc_curve"] = M.roc_curve(scored, actual, probabilities[classes[1]], positive=classes[1])
    else:
        tables["residuals"] = M.residuals(scored, actual, prediction)
    if importance is not None:
        tables["feature_importance"] = importance
    return tables


def metric_label(name: str) -> Column:
    """A metric's display name; one without a fixed name is spelled out from its words."""
    known = F.create_map(*[F.lit(x) for pair in M.METRIC_LABELS.items() for x in pair])
    return F.coalesce(known[col(name)], F.initcap(F.translate(name, "_", " ")))


def report_rows(
    df: DataFrame,
    *,
    source: str | None = None,
    target: str | None = None,
    model: dict | None = None,
) -> DataFrame:
    """The report as ``(section, item, value)`` rows: dataset, problems, model, metrics, features.

    ``model`` is the metadata of a saved model.
    """
    spark = df.sparkSession
    facts = P.dataset_summary(df)
    names = {
        "rows": "Rows",
        "columns": "Columns",
        "missing_values": "Missing values",
        "missing_pct": "Missing %",
        "duplicate_rows": "Duplicate rows",
    }
    cells = [
        F.struct(F.lit("dataset").alias("section"), F.lit(label).alias("item"), col(c).cast("string").alias("value"))
        for c, label in names.items()
    ]
    parts = [facts.select(F.inline(F.array(*cells)))]
    findings = validate(df, required_columns=[target] if target else None).findings
    parts.append(
        findings.where("severity = 'error'").select(
            F.lit("problems").alias("section"),
            F.coalesce("column", "check").alias("item"),
            F.col("message").alias("value"),
        )
    )
    extra = [("dataset", "Source", source)] if source else []
    if model:
        extra += [("model", k.title(), str(model[k])) for k in ("algorithm", "task", "target")]
        measured = [(k, f"{v:.4f}") for k, v in model.get("metrics", {}).items()]
        if measured:
            table = spark.createDataFrame(measured, "metric string, value string")
            parts.append(table.select(F.lit("metrics").alias("section"), metric_label("metric").alias("item"), "value"))
        cv = model.get("cv_scores") or {}
        extra += [("cross-validation", k, str(cv[k])) for k in ("cv_mean", "cv_std") if k in cv]
        extra += [("features", n, str(v)) for n, v in (model.get("feature_importance") or [])[:TOP_FEATURES]]
    if extra:
        parts.append(spark.createDataFrame(extra, REPORT))
    return union_all(parts)
