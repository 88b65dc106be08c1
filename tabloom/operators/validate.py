"""Dataset expectations, target checks and label encoding."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tabloom.errors import ValidationError
from tabloom.functions.columns import col, is_numeric, missing_count, require_flat
from tabloom.functions.longform import union_all
from tabloom.operators.profile import grouped_rows, one_pass

WARN_MISSING_SHARE = 0.05
CLASS_LIMIT = 20
CLASS_SHARE = 0.5
MAX_BROADCAST_LABELS = 100_000

FINDINGS = "severity string, check string, column string, value double, message string"


@dataclass
class ValidationReport:
    """Findings of one validation, and the numbers needed to combine several reports."""

    findings: DataFrame
    facts: DataFrame
    required_missing: list[str] = field(default_factory=list)

    def is_valid(self) -> bool:
        return self.findings.where("severity = 'error'").isEmpty()

    def errors(self) -> list[str]:
        return [r["message"] for r in self.findings.where("severity = 'error'").collect()]

    def warnings(self) -> list[str]:
        return [r["message"] for r in self.findings.where("severity = 'warning'").collect()]


def dataset_facts(df: DataFrame) -> DataFrame:
    """Long table ``(check, column, value, total)`` of rows, columns, duplicates, missing, constants.

    ``total`` repeats the row count, so that shares need no join.
    """
    require_flat(df)
    per_column = one_pass(
        df,
        {
            c: {
                "missing": missing_count(c),
                "constant": F.min(col(c)).eqNullSafe(F.max(col(c))),
                "total": F.count(F.lit(1)),
            }
            for c in df.columns
        },
    )
    by_column = per_column.select(
        "total",
        F.inline(
            F.array(
                F.struct(F.lit("missing").alias("check"), F.col("column"), F.col("missing").alias("value")),
                F.struct(
                    F.lit("constant").alias("check"), F.col("column"), F.col("constant").cast("bigint").alias("value")
                ),
            )
        )
    ).where("value > 0")
    none = F.lit(None).cast("string")
    whole = (
        grouped_rows(df)
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("kinds"))
        .select(
            F.col("rows").alias("total"),
            F.inline(
                F.array(
                    F.struct(F.lit("rows").alias("check"), none.alias("column"), F.col("rows").alias("value")),
                    F.struct(
                        F.lit("columns").alias("check"),
                        none.alias("column"),
                        F.lit(len(df.columns)).cast("bigint").alias("value"),
                    ),
                    F.struct(
                        F.lit("duplicates").alias("check"),
                        none.alias("column"),
                        (F.col("rows") - F.col("kinds")).alias("value"),
                    ),
                )
            )
        )
    )
    return union_all([whole, by_column])


def findings_of(
    facts: DataFrame,
    available: list[str],
    *,
    required_columns: list[str] | None = None,
    min_rows: int = 1,
    max_missing_share: float = 1.0,
) -> DataFrame:
    """Errors and warnings that follow from the facts, one row per finding.

    ``value`` is the row count, the missing share, the number of duplicates, or 1 for a flag.
    """
    spark = facts.sparkSession
    share = F.try_divide(F.col("value").cast("double"), F.col("total").cast("double"))
    some = F.col("total") > 0
    severity = (
        F.when((F.col("check") == "rows") & (F.col("value") < min_rows), "error")
        .when(some & (F.col("check") == "missing") & (share > max_missing_share), "error")
        .when(some & (F.col("check") == "missing") & (share > WARN_MISSING_SHARE), "warning")
        .when(some & (F.col("check") == "duplicates") & (F.col("value") > 0), "warning")
        .when(some & (F.col("check") == "constant"), "warning")
    )
    value = F.when(F.col("check") == "missing", F.round(share, 4)).otherwise(F.col("value").cast("double"))
    message = (
        F.when(
            F.col("check") == "rows",
            F.format_string(f"The dataset has %d rows, fewer than the {min_rows} required.", F.col("value")),
        )
        .when(
            F.col("check") == "missing",
            F.format_string("Column '%s': %.1f%% of cells missing (%d rows).", F.col("column"), share * 100, F.col("value")),
        )
        .when(F.col("check") == "duplicates", F.format_string("%d duplicate rows.", F.col("value")))
        .otherwise(F.format_string("Column '%s' holds a single value.", F.col("column")))
    )
    found = facts.select(
        severity.alias("severity"), "check", "column", value.alias("value"), message.alias("message")
    ).where("severity is not null")
    absent = list(dict.fromkeys(c for c in required_columns or [] if c not in available))
    if absent:
        extra = spark.createDataFrame(
            [
                ("error", "required", c, 1.0, f"Required column '{c}' is absent; there are: {', '.join(available)}.")
                for c in absent
            ],
            FINDINGS,
        )
        found = found.unionByName(extra)
    return found


def validate(
    df: DataFrame,
    *,
    required_columns: list[str] | None = None,
    min_rows: int = 1,
    max_missing_share: float = 1.0,
) -> ValidationReport:
    """Check a dataset; problems are returned as rows, never raised."""
    facts = dataset_facts(df)
    return ValidationReport(
        findings=findings_of(
            facts,
            df.columns,
            required_columns=required_columns,
            min_rows=min_rows,
            max_missing_share=max_missing_share,
        ),
        facts=facts,
        required_missing=[c for c in required_columns or [] if c not in df.columns],
    )


def merge_facts(*facts: DataFrame) -> DataFrame:
    """Combine the facts of several datasets, such as train and test.

    Rows and duplicates add up, columns take the maximum, a column's missing count comes from the
    last dataset that has one, and constant columns are listed together.
    """
    tagged = union_all([f.withColumn("_no", F.lit(i)) for i, f in enumerate(facts)])

    def combined(name: str):
        return (
            F.when(F.col("check").isin("rows", "duplicates"), F.sum(name))
            .when(F.col("check") == "missing", F.max_by(name, "_no"))
            .otherwise(F.max(name))
            .alias(name)
        )

    return tagged.groupBy("check", "column").agg(combined("value"), combined("total"))


def merge_reports(*reports: ValidationReport) -> ValidationReport:
    """Findings joined, facts combined, absent columns listed in order."""
    return ValidationReport(
        findings=union_all([r.findings for r in reports]).distinct(),
        facts=merge_facts(*[r.facts for r in reports]),
        required_missing=[c for r in reports for c in r.required_missing],
    )


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """One row: counts of the target and the task they imply (NULL when no model can be fitted)."""
    numeric = is_numeric(df.schema[target].dataType, include_boolean=True)
    counts = (
        df.groupBy(col(target).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("present"),
            F.count("v").alias("classes"),
        )
    )
    if numeric:
        few = (F.col("classes") <= CLASS_LIMIT) & (
            F.try_divide(F.col("classes").cast("double"), F.col("rows").cast("double")) < CLASS_SHARE
        )
        task = F.when(few, "classification").otherwise("regression")
    else:
        task = F.lit("classification")
    return counts.select(
        "rows",
        "present",
        "classes",
        F.when(F.col("classes") > 1, task).alias("task"),
        (F.col("classes") == 2).alias("binary"),
    )


def target_facts(df: DataFrame, target: str, limit: int = CLASS_LIMIT) -> Row:
    """The same as :func:`target_profile`, but for ``classes``, which ends at ``limit`` + 1: there are more.

    A sketch of constant size decides whether values are grouped at all. With so few distinct values it cannot
    be too high by half, so what is grouped, and shuffled, is a few dozen values a task at most.
    """
    numeric = is_numeric(df.schema[target].dataType, include_boolean=True)
    v = col(target)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("present"), F.approx_count_distinct(v).alias("about")
    ).first()
    classes = limit + 1
    if row["about"] <= 2 * limit:
        classes = min(classes, df.select(v.alias("v")).where("v is not null").distinct().limit(classes).count())
    few = not numeric or (classes <= limit and row["rows"] > 0 and classes / row["rows"] < CLASS_SHARE)
    task = ("classification" if few else "regression") if classes > 1 else None
    return Row(rows=row["rows"], present=row["present"], classes=classes, task=task, binary=classes == 2)


def target_problem(row, target: str) -> str | None:
    """Why a target's profile row leaves nothing to learn, if it does."""
    distinct = {0: "no value at all", 1: "the same value in every row that has one"}
    if row["classes"] in distinct:
        return f"'{target}' cannot be learned: it has {distinct[row['classes']]}."
    return None


def check_target(df: DataFrame, target: str | None):
    """The target's profile row; raises when the target cannot be learned."""
    if target not in df.columns:
        named = f"there is no column '{target}'" if target else "no target is named"
        raise ValidationError(f"Nothing to learn: {named}; columns are {', '.join(df.columns)}.")
    row = target_facts(df, target)
    if problem := target_problem(row, target):
        raise ValidationError(problem)
    return row


def infer_task(df: DataFrame, target: str | None) -> str:
    """``classification`` or ``regression``."""
    return check_target(df, target)["task"]


def label_table(df: DataFrame, target: str) -> DataFrame:
    """Distinct labels with their index from 0, in ascending order (NULL has none)."""
    distinct = df.select(col(target).alias("label")).where(F.col("label").isNotNull()).distinct()
    # One row per class, not per record.
    return distinct.withColumn("label_index", F.row_number().over(Window.orderBy("label")) - 1)


def encode_labels(df: DataFrame, target: str, labels: list, output: str = "label_index") -> DataFrame:
    """Index of each row's label in ``labels``; -1 for a label not seen in training.

    The labels are a driver list bounded by the classes a model can have.
    """
    spark = df.sparkSession
    if len(labels) <= 100:
        expr = F.lit(-1)
        for i, label in reversed(list(enumerate(labels))):
            expr = F.when(col(target) == F.lit(label), F.lit(i)).otherwise(expr)
        return df.withColumn(output, expr.cast("int"))
    kind = df.schema[target].dataType.simpleString()
    table = spark.createDataFrame([(v, i) for i, v in enumerate(labels)], f"_label {kind}, _ix int")
    if len(labels) <= MAX_BROADCAST_LABELS:
        table = F.broadcast(table)
    return (
        df.join(table, col(target) == F.col("_label"), "left")
        .withColumn(output, F.coalesce("_ix", F.lit(-1)))
        .drop("_label", "_ix")
    )
