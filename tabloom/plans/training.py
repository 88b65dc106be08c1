"""Training, cross-validation, comparison, scoring and persistence of models."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from decimal import Decimal
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.errors import DataError, EvaluationError, ModelError
from tabloom.functions.columns import col
from tabloom.functions.storage import ensure_checkpoint_dir, spread, staged
from tabloom.operators.features import PreprocessorModel, fit_preprocessor
from tabloom.operators.metrics import (
    check_scorer,
    class_distribution,
    compute_metrics,
    pair_counts,
    residuals,
    score,
    task_metrics,
)
from tabloom.operators.split import holdout, kfold
from tabloom.operators.validate import check_target, encode_labels
from tabloom.plans.boosting import BoostedClasses
from tabloom.plans.boosting import fit as fit_boosted
from tabloom.plans.folds import ridge_scores
from tabloom.plans.registry import ModelPlan, available_models, create_model

MAX_CLASSES = 10_000
#: A regression forest grows in blocks whose trees draw so many rows in all, or of so many trees where that is more.
BLOCK_ROWS, BLOCK_TREES = 50_000, 10
_MODEL_CLASSES = {
    c.__name__: c
    for c in (
        LogisticRegressionModel,
        RandomForestClassificationModel,
        GBTClassificationModel,
        LinearRegressionModel,
        RandomForestRegressionModel,
        GBTRegressionModel,
        BoostedClasses,
    )
}


@dataclass
class FittedModel:
    """Preprocessing and estimator together; applies to any frame with the training columns."""

    algorithm: str
    task: str
    target: str
    preprocessor: PreprocessorModel
    models: list
    classes: list | None = None

    @property
    def probability_columns(self) -> dict:
        return {c: f"probability_{c}" for c in self.classes or []}

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and, for classes, ``prediction_index`` and one probability per class."""
        out = self.preprocessor.with_vector(df, "_features")
        names = [col(c) for c in df.columns]
        (m,) = self.models
        if isinstance(m, BoostedClasses):
            shares = m.probabilities("_features")
            out = out.select(*names, shares.alias("_shares"))
            index = F.array_position("_shares", F.array_max("_shares")) - 1
            return self._labelled(out.withColumn("prediction_index", index.cast("int")), names)
        m = m.copy().setFeaturesCol("_features").setPredictionCol("_prediction")
        if self.task == "regression":
            return m.transform(out).select(*names, F.col("_prediction").alias("prediction"))
        out = m.setRawPredictionCol("_raw").setProbabilityCol("_probability").transform(out)
        shares, index = vector_to_array("_probability"), F.col("_prediction").cast("int")
        return self._labelled(out.select(*names, shares.alias("_shares"), index.alias("prediction_index")), names)

    def _labelled(self, scored: DataFrame, names: list) -> DataFrame:
        labels = F.array(*[F.lit(c) for c in self.classes])
        return scored.select(
            *names,
            F.element_at(labels, F.col("prediction_index") + 1).alias("prediction"),
            "prediction_index",
            *[F.col("_shares")[i].alias(n) for i, n in enumerate(self.probability_columns.values())],
        )


@dataclass
class TrainingResult:
    model: FittedModel
    metrics: dict = field(default_factory=dict)
    train_metrics: dict = field(default_factory=dict)
    class_distribution: dict = field(default_factory=dict)
    confusion: DataFrame | None = None
    cv_scores: dict = field(default_factory=dict)
    feature_importance: list = field(default_factory=list)
    params: dict = field(default_factory=dict)
    n_train: int = 0
    n_validation: int = 0
    rows_without_target: int = 0
    duration_seconds: float = 0.0

    @property
    def feature_names(self) -> list[str]:
        return self.model.preprocessor.feature_names


# --------------------------------------------------------------------------- fitting
def class_list(df: DataFrame, target: str) -> list:
    """Labels in ascending order; the last of two is the positive one."""
    seen = df.select(col(target).alias("v")).where("v is not null").distinct()
    rows = seen.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ModelError(f"Target '{target}' has more than {MAX_CLASSES} classes.")
    return sorted(r["v"] for r in rows)


def fit_model(
    df: DataFrame,
    target: str,
    plan: ModelPlan,
    *,
    classes: list | None = None,
    exclude: list[str] | None = None,
    seed: int = 42,
    **feature_options,
) -> FittedModel:
    """Fit preprocessing and estimator on the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    pre = fit_preprocessor(df, exclude=[target, *(exclude or [])], **feature_options)
    if not pre.feature_names:
        raise ModelError("No usable feature column is left.")
    if plan.task == "classification":
        labelled = encode_labels(df, target, classes, "_label").withColumn(
            "_label", F.col("_label").cast("double")
        )
    else:
        labelled = df.withColumn("_label", col(target).cast("double"))
    columns = [col(c) for c in ["_label", *pre.spec.feature_columns]]
    matrix = pre.with_vector(spread(labelled.select(*columns), pre.rows), "_features")
    matrix = matrix.select("_label", "_features").persist()
    try:
        row = matrix.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_label").alias("s")).first()
        k = len(classes) if classes else 0
        if plan.algorithm == "gradient_boosting" and k > 2:
            models = [fit_boosted(matrix, k, row["n"], plan.params, plan.params.get("random_state", seed))]
        else:
            own = matrix
            if k:
                own = matrix.select("_features", F.col("_label").alias("_label", metadata=_nominal_meta(k)))
            models = [_fit_one(plan, own, row, k, seed)]
    finally:
        matrix.unpersist()
    return FittedModel(plan.algorithm, plan.task, target, pre, models, classes)


def _nominal_meta(k: int) -> dict:
    """Tells the estimator the number of classes, whichever occur in the fit rows."""
    return {"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(k)], "name": "_label"}}


def _fit_one(plan, matrix, row, classes, seed):
    spark = matrix.sparkSession
    memory = tree_memory_mb(spark)

    def fit(part):
        est = part.estimator(rows=row["n"], label_std=row["s"] or 1.0, classes=classes, seed=seed, memory_mb=memory)
        return est.setFeaturesCol("_features").setLabelCol("_label").fit(matrix)

    if plan.algorithm != "random_forest" or classes:
        return fit(plan)
    # The nodes of a level are shuffled whole, and the driver keeps them while they grow, so blocks bound both; a
    # matrix of fewer tasks than cores has as many blocks side by side as fill them.
    blocks = _blocks(plan, row["n"], seed)
    if len(blocks) == 1:
        return fit(plan)
    at_once = max(1, spark.sparkContext.defaultParallelism // max(matrix.rdd.getNumPartitions(), 1))
    with ThreadPool(min(at_once, len(blocks))) as pool:
        return _joined(pool.map(inheritable_thread_target(spark)(fit), blocks, chunksize=1))


def _blocks(plan: ModelPlan, rows: int, seed: int) -> list[ModelPlan]:
    """A forest's plan cut into plans of fewer trees, which have seeds, and so draws of rows and bins, of their own."""
    trees, seed = plan.params["n_estimators"], plan.params.get("random_state", seed)
    size = max(BLOCK_TREES, BLOCK_ROWS // max(rows, 1))
    # Rows are drawn by the seed plus the number of the task, so the seeds of blocks lie far apart.
    return [
        replace(plan, params=plan.params | {"n_estimators": min(size, trees - i), "random_state": seed + i * 1_000_003})
        for i in range(0, trees, size)
    ]


def _joined(models: list[RandomForestRegressionModel]) -> RandomForestRegressionModel:
    """One forest of the trees of several."""
    first, context = models[0], SparkSession.active().sparkContext
    trees = [t for m in models for t in m._java_obj.trees()]
    ml = context._jvm.org.apache.spark.ml.regression
    array = context._gateway.new_array(ml.DecisionTreeRegressionModel, len(trees))
    for i, t in enumerate(trees):
        array[i] = t
    joined = first._copyValues(RandomForestRegressionModel(ml.RandomForestRegressionModel(first.uid, array, first.numFeatures)))
    joined._set(numTrees=len(trees))._transfer_params_to_java()
    return joined


def tree_memory_mb(spark: SparkSession) -> int:
    """What a task may take for the statistics of tree nodes: a quarter of its share of an executor's memory.

    In a local session the driver is the executor. The share lies between the estimators' default and 2 GB.
    """
    context = spark.sparkContext
    local = context.master.startswith("local") and not context.master.startswith("local-cluster")
    text = context.getConf().get("spark.driver.memory" if local else "spark.executor.memory", "1g").lower()
    digits, unit = text.rstrip("kmgtb"), text.lstrip("0123456789").rstrip("b")
    megabytes = int(digits) * {"k": 2**-10, "": 2**-20, "m": 1, "g": 2**10, "t": 2**20}[unit]
    cores = context.defaultParallelism if local else int(context.getConf().get("spark.executor.cores", "1"))
    return int(min(2048, max(256, megabytes / max(cores, 1) / 4)))


# --------------------------------------------------------------------------- evaluation
@dataclass
class Evaluation:
    """Metrics, and for classes the confusion matrix: a stored table with a row for each pair that occurs."""

    metrics: dict[str, float]
    confusion: DataFrame | None = None


def scored_table(model: FittedModel, df: DataFrame, *, rows: int | None = None, with_scores: bool = True) -> DataFrame:
    """Predictions and probabilities beside the labels of rows that have one."""
    if model.target not in df.columns:
        raise DataError(f"The dataset lacks the target column '{model.target}' of the model.")
    needed = [col(c) for c in [model.target, *model.preprocessor.spec.feature_columns]]
    labelled = df.where(col(model.target).isNotNull()).select(*needed)
    scored = model.transform(labelled if rows is None else spread(labelled, rows))
    keep = [col(model.target).alias("actual"), col("prediction")]
    return scored.select(*keep, *[col(c) for c in (model.probability_columns if with_scores else {}).values()])


def evaluation(
    model: FittedModel,
    df: DataFrame,
    *,
    with_scores: bool = True,
    rows: int | None = None,
    average: str | None = None,
    confusion: bool = True,
) -> Evaluation:
    """Metrics of a model on labelled rows with its confusion matrix; labels unknown to it count as errors.

    ``average`` is binary, macro or weighted where the default for the number of classes is not wanted.
    ``with_scores=False`` leaves out the metrics that need class probabilities. ``rows``, where
    the caller knows it, lets a small table use all cores.
    """
    table = scored_table(model, df, rows=rows, with_scores=with_scores).persist()
    try:
        found = compute_metrics(
            table,
            model.task,
            classes=model.classes,
            probabilities=(model.probability_columns if with_scores else None) or None,
            average=average,
        ).collect()
        matrix = None
        if confusion and model.task == "classification":
            matrix = staged(pair_counts(table, "actual", "prediction"), "confusion")
        return Evaluation({r["metric"]: r["value"] for r in found}, matrix)
    finally:
        table.unpersist()


def evaluate(model: FittedModel, df: DataFrame, **options) -> dict[str, float]:
    """The metrics of :func:`evaluation` alone."""
    return evaluation(model, df, **options, confusion=False).metrics


def score_model(model: FittedModel, df: DataFrame, scoring: str, *, rows: int | None = None) -> float | None:
    """A scorer's value on labelled rows."""
    check_scorer(scoring, model.task, model.classes)
    table = scored_table(model, df, rows=rows).persist()
    try:
        return score(table, scoring, classes=model.classes, probabilities=model.probability_columns)
    finally:
        table.unpersist()


def predict(model: FittedModel, df: DataFrame, id_column: str | None = None) -> DataFrame:
    """Id, predicted label and class probabilities for new rows.

    Without an id column each row gets a number of its own, which depends on the partitioning. Rows of a
    stream get a random id.
    """
    if id_column and id_column in df.columns:
        ident = col(id_column)
    else:
        ident = (F.uuid() if df.isStreaming else F.monotonically_increasing_id()).alias("id")
    keep = [ident, F.col("prediction")]
    if model.task == "classification":
        keep.append(F.col("prediction_index"))
        keep += [col(c) for c in model.probability_columns.values()]
    return model.transform(df).select(*keep)


def predict_preview(scored: DataFrame, key: str, rows: int = 10) -> DataFrame:
    return scored.orderBy(key).limit(rows)


def feature_importance(model: FittedModel) -> list[tuple[str, float]]:
    """Features by importance, or by mean absolute coefficient, to 4 places."""
    names = model.preprocessor.feature_names
    totals: list[float] | None = None
    for m in model.models:
        if hasattr(m, "featureImportances"):
            values = [float(v) for v in m.featureImportances.toArray()]
        elif model.task == "classification" and hasattr(m, "coefficientMatrix"):
            rows = abs(m.coefficientMatrix.toArray())
            values = [float(v) for v in rows.mean(axis=0)]
        elif hasattr(m, "coefficients"):
            values = [abs(float(v)) for v in m.coefficients]
        else:
            return []
        totals = values if totals is None else [a + b for a, b in zip(totals, values)]
    if totals is None or len(totals) != len(names):
        return []
    ranked = [(n, v / len(model.models)) for n, v in zip(names, totals)]
    return [(n, round(v, 4)) for n, v in sorted(ranked, key=lambda t: (-t[1], t[0]))]


def importance_table(spark: SparkSession, ranked: list[tuple[str, float]], top: int | None = None) -> DataFrame:
    rows = [(i + 1, n, v) for i, (n, v) in enumerate(ranked[:top])]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


# --------------------------------------------------------------------------- cross-validation
def cross_validate(
    df: DataFrame,
    target: str,
    plan: ModelPlan,
    *,
    classes: list | None = None,
    fold: str = "fold",
    scoring: str | None = None,
    exclude: list[str] | None = None,
    seed: int = 42,
    parallelism: int = 1,
    **feature_options,
) -> list[float]:
    """One score per fold of a frame with a fold column; preprocessing is fitted anew per fold.

    Ridge models are scored from sums of products by fold, as many scans as for one fold.

    ``parallelism`` folds run at a time, each keeping its feature matrix.
    """
    scoring = scoring or task_metrics(plan.task).scoring
    check_scorer(scoring, plan.task, classes)
    if plan.algorithm == "ridge":
        scores = ridge_scores(
            df, target, plan.params["alpha"], fold=fold, scoring=scoring, exclude=exclude,
            fit_intercept=plan.params.get("fit_intercept", True), **feature_options,
        )
        if scores is not None:
            return scores
    numbers = sorted(r[0] for r in df.select(fold).distinct().collect())

    def of_fold(i) -> float:
        model = fit_model(
            df.where(col(fold) != i).drop(fold),
            target,
            plan,
            classes=classes,
            exclude=exclude,
            seed=seed,
            **feature_options,
        )
        held = model.preprocessor.rows // (len(numbers) - 1)
        value = score_model(model, df.where(col(fold) == i).drop(fold), scoring, rows=held)
        if value is None:
            raise EvaluationError(f"Scoring '{scoring}' does not apply to fold {i}.")
        return value

    if parallelism <= 1:
        return [of_fold(i) for i in numbers]
    ensure_checkpoint_dir(df.sparkSession)
    with ThreadPool(min(parallelism, len(numbers))) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(of_fold), numbers)


def summarise_cv(scores: list[float]) -> dict:
    """Mean and population standard deviation over the folds."""
    mean = sum(scores) / len(scores)
    std = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5
    return {"cv_mean": round(mean, 4), "cv_std": round(std, 4), "cv_scores": [round(s, 4) for s in scores]}


# --------------------------------------------------------------------------- training
@dataclass
class TrainingData:
    """Parts of one dataset, prepared once and shared by every model trained on it."""

    task: str
    target: str
    train: DataFrame
    validation: DataFrame
    folded: DataFrame | None
    classes: list | None
    exclude: list[str]
    n_train: int
    n_validation: int
    rows_without_target: int
    seed: int


def prepare_data(
    df: DataFrame,
    target: str,
    *,
    task: str | None = None,
    validation_df: DataFrame | None = None,
    id_column: str | None = None,
    drop_columns: list[str] | None = None,
    key: list[str] | None = None,
    validation_size: float = 0.1,
    stratify: bool = True,
    cv_folds: int = 5,
    seed: int = 42,
    facts=None,
) -> TrainingData:
    """Hold-out and folds of a dataset, each written once.

    ``key`` names the columns that identify a row for the seeded parts; without it (or
    ``id_column``) the whole row does. ``cv_folds=0`` leaves the folds out. ``facts`` is the
    target's profile row where the caller has it.
    """
    facts = facts or check_target(df, target)
    task = task or facts["task"]
    key = key or ([id_column] if id_column else None)
    by_class = target if stratify and task == "classification" else None
    usable = df.where(col(target).isNotNull())
    if validation_df is None:
        parted = staged(
            holdout(usable, size=validation_size, stratify=by_class, key=key, seed=seed, output="_part"),
            "holdout",
            parts="_part",
        )
        train = parted.where("_part = 'train'").drop("_part")
        validation = parted.where("_part = 'validation'").drop("_part")
    else:
        check_target(validation_df, target)
        train, validation = usable, validation_df.where(col(target).isNotNull())
    folded = None
    if cv_folds:
        folded = staged(
            kfold(train, folds=cv_folds, stratify=by_class, key=key, seed=seed, output="_fold"),
            "folds",
            parts="_fold",
        )
        train = folded.drop("_fold")
    return TrainingData(
        task=task,
        target=target,
        train=train,
        validation=validation,
        folded=folded,
        classes=class_list(train, target) if task == "classification" else None,
        exclude=[c for c in [id_column, *(drop_columns or [])] if c],
        n_train=train.count(),
        n_validation=validation.count(),
        rows_without_target=facts["rows"] - facts["present"],
        seed=seed,
    )


def train_prepared(
    data: TrainingData,
    algorithm: str = "random_forest",
    params: dict | None = None,
    *,
    scoring: str | None = None,
    parallelism: int = 1,
    **feature_options,
) -> TrainingResult:
    """Cross-validate, fit on the training part, and measure on both parts.

    ``parallelism`` is the number of folds worked on at a time.
    """
    plan = create_model(algorithm, data.task, params)
    if scoring is not None:
        check_scorer(scoring, data.task, data.classes)
    began = time.monotonic()
    options = {"classes": data.classes, "exclude": data.exclude, "seed": data.seed, **feature_options}
    cv_scores = {}
    if data.folded is not None:
        cv_scores = summarise_cv(
            cross_validate(
                data.folded,
                data.target,
                plan,
                fold="_fold",
                scoring=scoring,
                parallelism=parallelism,
                **options,
            )
        )
    model = fit_model(data.train, data.target, plan, **options)
    shares = {}
    if data.task == "classification":
        rows = class_distribution(data.validation, data.target, data.classes).collect()
        shares = {r["label"]: r["n"] for r in rows}
    held_out = evaluation(model, data.validation, rows=data.n_validation)
    return TrainingResult(
        model=model,
        metrics=held_out.metrics,
        confusion=held_out.confusion,
        train_metrics=evaluate(model, data.train, with_scores=False, rows=data.n_train),
        class_distribution=shares,
        cv_scores=cv_scores,
        feature_importance=feature_importance(model),
        params=plan.params,
        n_train=data.n_train,
        n_validation=data.n_validation,
        rows_without_target=data.rows_without_target,
        duration_seconds=round(time.monotonic() - began, 2),
    )


_DATA_OPTIONS = (
    "task",
    "validation_df",
    "id_column",
    "drop_columns",
    "key",
    "validation_size",
    "stratify",
    "cv_folds",
    "seed",
)


def _divide(options: dict) -> tuple[dict, dict]:
    data = {k: v for k, v in options.items() if k in _DATA_OPTIONS}
    return data, {k: v for k, v in options.items() if k not in _DATA_OPTIONS}


def train_model(
    df: DataFrame,
    target: str,
    *,
    algorithm: str = "random_forest",
    params: dict | None = None,
    **options,
) -> TrainingResult:
    """Train end to end; options are those of :func:`prepare_data`, the scoring, and the features'."""
    data_options, fit_options = _divide(options)
    facts = check_target(df, target)
    data_options["task"] = data_options.get("task") or facts["task"]
    create_model(algorithm, data_options["task"], params)  # refuse a bad name before any work
    data = prepare_data(df, target, facts=facts, **data_options)
    return train_prepared(data, algorithm, params, **fit_options)


def leaderboard(scores: DataFrame, task: str) -> DataFrame:
    """Models by accuracy or R², best first, from rows ``(model, <metrics>)``."""
    order = [F.desc_nulls_last(task_metrics(task).ranking), F.asc("model")]
    # One row per model.
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(*order))).orderBy("rank")


def compare_models(
    df: DataFrame,
    target: str,
    *,
    algorithms: list[str] | None = None,
    task: str | None = None,
    params: dict[str, dict] | None = None,
    **options,
) -> tuple[list[TrainingResult], DataFrame]:
    """Train several models on the same parts; returns the results and their ranking."""
    facts = check_target(df, target)
    task = task or facts["task"]
    names = algorithms or available_models(task)
    for n in names:
        if n not in available_models(task):
            raise ModelError(f"Model '{n}' is not available for {task}; there are {', '.join(available_models(task))}.")
    data_options, fit_options = _divide(options)
    data = prepare_data(df, target, task=task, facts=facts, **data_options)
    results = [train_prepared(data, n, (params or {}).get(n), **fit_options) for n in names]
    first, second = task_metrics(task).ranking, task_metrics(task).beside
    rows = [
        (r.model.algorithm, r.metrics.get(first), r.metrics.get(second), r.cv_scores.get("cv_mean"), r.duration_seconds)
        for r in results
    ]
    table = df.sparkSession.createDataFrame(
        rows, f"model string, {first} double, {second} double, cv_mean double, seconds double"
    )
    return results, leaderboard(table, task)


# --------------------------------------------------------------------------- persistence
_TEXT_TYPES = {Decimal: "decimal(38,18)", datetime: "timestamp", date: "date"}


def _classes_as_text(classes: list | None) -> dict:
    """Classes as JSON can hold them, and the type of those that it holds as text."""
    kind = _TEXT_TYPES.get(type(classes[0])) if classes else None
    return {"classes": [str(c) for c in classes] if kind else classes, "class_type": kind}


def _classes_from_text(spark: SparkSession, meta: dict) -> list | None:
    kind, classes = meta.get("class_type"), meta["classes"]
    if not kind:
        return classes
    cast = [F.lit(c).cast(kind).alias(f"c{i}") for i, c in enumerate(classes)]
    return list(spark.range(1).select(*cast).first())


def save_model(spark: SparkSession, result: TrainingResult, path: str, *, overwrite: bool = False) -> str:
    """Estimators, preprocessing parameters and metadata under one folder."""
    m = result.model
    meta = {
        "version": 1,
        "algorithm": m.algorithm,
        "task": m.task,
        "target": m.target,
        **_classes_as_text(m.classes),
        "feature_names": result.feature_names,
        "metrics": result.metrics,
        "cv_scores": result.cv_scores,
        "feature_importance": result.feature_importance,
        "confusion_matrix": result.confusion is not None,
        "estimators": [type(e).__name__ for e in m.models],
        "preprocessor": m.preprocessor.to_json(),
    }
    mode = "overwrite" if overwrite else "errorifexists"
    frame = spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1)
    try:
        frame.write.mode(mode).text(f"{path}/metadata")
    except AnalysisException as exc:
        raise ModelError(f"A model exists already in '{path}'; pass overwrite=True to replace it.") from exc
    if result.confusion is not None:
        result.confusion.write.mode(mode).parquet(f"{path}/confusion")
    for i, e in enumerate(m.models):
        if isinstance(e, BoostedClasses):
            e.save(spark, f"{path}/estimator_{i}", overwrite=overwrite)
            continue
        writer = e.write().overwrite() if overwrite else e.write()
        writer.save(f"{path}/estimator_{i}")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[FittedModel, dict]:
    try:
        text = spark.read.text(f"{path}/metadata", wholetext=True).first()
    except AnalysisException as exc:
        raise ModelError(f"No model metadata in '{path}'; only a saved model can be loaded.") from exc
    try:
        meta = json.loads(text["value"])
    except (TypeError, ValueError) as exc:
        raise ModelError(f"The model metadata in '{path}' cannot be read.") from exc
    models = [
        _MODEL_CLASSES[name].load(f"{path}/estimator_{i}") for i, name in enumerate(meta["estimators"])
    ]
    if meta.get("confusion_matrix"):
        meta["confusion_matrix"] = spark.read.parquet(f"{path}/confusion")
    model = FittedModel(
        meta["algorithm"],
        meta["task"],
        meta["target"],
        PreprocessorModel.from_json(meta["preprocessor"]),
        models,
        _classes_from_text(spark, meta),
    )
    return model, meta


def evaluation_table(model: FittedModel, df: DataFrame) -> DataFrame:
    """Predictions beside the truth, the input of the metric and figure tables."""
    scored = model.transform(df)
    keep = [col(model.target).alias("actual"), F.col("prediction")]
    if model.task == "regression":
        return residuals(scored.select(*keep), "actual", "prediction", ["actual", "prediction"])
    return scored.select(*keep, *[col(c) for c in model.probability_columns.values()])
