"""A table of recorded runs: appended rows, with deletions as rows of their own.

Both parts are Parquet folders, so records survive the session and can be written by several
drivers. Nothing is rewritten in place.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.errors import RunError

RUN_SCHEMA = (
    "id string, timestamp timestamp, model string, task string, dataset string, "
    "hyperparameters map<string,string>, metrics map<string,double>, "
    "cv_scores struct<cv_mean:double,cv_std:double,cv_scores:array<double>>, "
    "training_duration double, model_path string, target string, n_train bigint, "
    "n_validation bigint, note string"
)
# ``seq`` keeps the order of records within one second.
STORED_SCHEMA = RUN_SCHEMA + ", seq bigint"
PRIMARY = {"classification": "accuracy", "regression": "r2"}


def decode_runs(df: DataFrame) -> DataFrame:
    """Parse JSON text columns of imported run records; bad or absent text gives an empty value."""
    kinds = {
        "hyperparameters": ("map<string,string>", "map()"),
        "metrics": ("map<string,double>", "map()"),
        "cv_scores": (
            "struct<cv_mean:double,cv_std:double,cv_scores:array<double>>",
            "named_struct('cv_mean', null, 'cv_std', null, 'cv_scores', array())",
        ),
    }
    out = []
    for c in df.columns:
        if c in kinds:
            kind, empty = kinds[c]
            # A broken document parses to NULL, or to a struct of NULLs.
            parsed = F.from_json(F.col(c), kind)
            if c == "cv_scores":
                parsed = F.when(parsed["cv_scores"].isNotNull(), parsed)
            out.append(F.coalesce(parsed, F.expr(empty).cast(kind)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def newest_runs(df: DataFrame, limit: int | None = 50) -> DataFrame:
    """Most recent first, later records first within one time."""
    ordered = df.orderBy(F.desc("timestamp"), F.desc("seq"))
    return ordered if limit is None else ordered.limit(limit)


def without_deleted(runs: DataFrame, deleted: DataFrame) -> DataFrame:
    return runs.join(deleted, "id", "left_anti")


def with_primary_metric(df: DataFrame) -> DataFrame:
    """Add the headline metric of each run's task and its value, NULL where it was not measured."""
    name = F.when(F.col("task") == "classification", PRIMARY["classification"]).otherwise(PRIMARY["regression"])
    value = F.try_element_at("metrics", name)
    return df.withColumn("primary_metric", F.when(value.isNotNull(), name)).withColumn("primary_value", value)


def display_time(c) -> Column:
    """Time of a run to the minute."""
    return F.date_format(c, "yyyy-MM-dd HH:mm")


class RunTable:
    """Runs stored under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _part(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise RunError(f"The runs in '{self.path}' cannot be read: {exc}") from exc
            return self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        """All runs that were not deleted."""
        return without_deleted(
            self._part("runs", STORED_SCHEMA), self._part("deleted", "id string").distinct()
        )

    def record(
        self,
        *,
        model: str,
        task: str,
        dataset: str | None = None,
        hyperparameters: dict | None = None,
        metrics: dict | None = None,
        cv_scores: dict | None = None,
        training_duration: float | None = None,
        model_path: str | None = None,
        target: str | None = None,
        n_train: int | None = None,
        n_validation: int | None = None,
        note: str | None = None,
    ) -> str:
        """Append a run and return its id."""
        run_id = uuid.uuid4().hex[:12]
        cv = cv_scores or {}
        row = (
            run_id,
            datetime.now(timezone.utc).replace(microsecond=0),
            model,
            task,
            dataset,
            {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in (hyperparameters or {}).items()},
            {k: float(v) for k, v in (metrics or {}).items() if isinstance(v, (int, float))},
            (cv.get("cv_mean"), cv.get("cv_std"), cv.get("cv_scores") or []),
            training_duration,
            model_path,
            target,
            n_train,
            n_validation,
            note,
            time.time_ns(),
        )
        self.append(self.spark.createDataFrame([row], STORED_SCHEMA).coalesce(1))
        return run_id

    def append(self, runs: DataFrame) -> None:
        """Append run rows in bulk, such as an imported history."""
        runs.write.mode("append").parquet(f"{self.path}/runs")

    def list(self, limit: int | None = 50) -> DataFrame:
        return newest_runs(self.runs(), limit)

    def get(self, run_id: str):
        row = self.runs().where(F.col("id") == run_id).first()
        if row is None:
            raise RunError(f"Run '{run_id}' not found.")
        return row

    def delete(self, run_id: str) -> None:
        self.get(run_id)
        frame = self.spark.createDataFrame([(run_id,)], "id string").coalesce(1)
        frame.write.mode("append").parquet(f"{self.path}/deleted")

    def count(self) -> int:
        return self.runs().count()

    def export(self, path: str, *, overwrite: bool = False) -> str:
        """All runs, newest first, as JSON records."""
        out = newest_runs(self.runs(), None).drop("seq")
        try:
            out.write.mode("overwrite" if overwrite else "errorifexists").json(path, ignoreNullFields=False)
        except AnalysisException as exc:
            raise RunError(f"'{path}' exists already; pass overwrite=True to replace it.") from exc
        return path


def record_training(table: RunTable, result, *, dataset: str | None = None, note: str | None = None, model_path: str | None = None) -> str:
    """Record a training result."""
    return table.record(
        model=result.model.algorithm,
        task=result.model.task,
        dataset=dataset,
        hyperparameters=result.params,
        metrics=result.metrics,
        cv_scores=result.cv_scores,
        training_duration=result.duration_seconds,
        model_path=model_path,
        target=result.model.target,
        n_train=result.n_train,
        n_validation=result.n_validation,
        note=note,
    )
