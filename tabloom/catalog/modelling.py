"""Queries: models trained, compared, stored and applied."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog.common import query, table
from tabloom.functions.storage import scratch_path
from tabloom.operators.metrics import task_metrics
from tabloom.plans import training as T
from tabloom.plans.registry import create_model
from tabloom.sources.tables import load_table, save_table

# Ten trees or rounds where the default of 200 takes minutes for each fit; README has the figures.
TREES = {"n_estimators": 10}


def documents(spark, d):
    """All documents with text measures that tell good from bad; those without a label have no quality."""
    words = F.split("text", r"\s+")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\s]", ""))
    return (
        table(spark, d, "documents")
        .join(table(spark, d, "labels"), "doc_id", "left")
        .select(
            "doc_id",
            "lang",
            "source",
            "n_chars",
            (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_words"),
            F.try_divide(F.length("text") - letters, F.length("text")).alias("non_letters"),
            "quality",
        )
    )


def parts(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        (F.col("p_partkey") % 1000).alias("serial"),
        "p_brand",
        "p_type",
        "p_size",
        F.col("p_retailprice").alias("price"),
    )


def lines(spark, d):
    return table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_returnflag"
    )


def _metrics(spark, result):
    rows = [("validation", k, v) for k, v in result.metrics.items()]
    rows += [("train", k, v) for k, v in result.train_metrics.items()]
    rows += [("cross-validation", k, result.cv_scores[k]) for k in ("cv_mean", "cv_std") if result.cv_scores]
    rows += [("rows", "train", float(result.n_train)), ("rows", "validation", float(result.n_validation))]
    return spark.createDataFrame(rows, "part string, metric string, value double")


def _checked(spark, result, floor):
    """What must hold of a training, for any model: exact part sizes, folds, and a hold-out score above a floor."""
    score = result.metrics[task_metrics(result.model.task).ranking]
    scores = result.cv_scores.get("cv_scores", [])
    rows = [
        ("rows", "train", float(result.n_train)),
        ("rows", "validation", float(result.n_validation)),
        ("check", "folds", float(len(scores))),
        ("check", "score above floor", float(score > floor)),
        ("check", "score of folds above floor", float(all(s > floor for s in scores))),
    ]
    return spark.createDataFrame(rows, "part string, metric string, value double")


def _expected(source, folds):
    """The same from the table: a tenth of the rows, rounded up, is held out."""
    n = f"(SELECT count(*) FROM {source})"
    return f"""
SELECT 'rows' AS part, 'train' AS metric, cast({n} - ceil({n} / 10) AS double) AS value
UNION ALL SELECT 'rows', 'validation', cast(ceil({n} / 10) AS double)
UNION ALL SELECT 'check', 'folds', {folds}.0e0
UNION ALL SELECT 'check', 'score above floor', 1.0e0
UNION ALL SELECT 'check', 'score of folds above floor', 1.0e0"""


_LABELLED = "documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL"


def _quality(spark, d, algorithm, params=None, **options):
    return T.train_model(
        documents(spark, d), "quality", algorithm=algorithm, params=params, id_column="doc_id", **options
    )


def _price(spark, d, algorithm, params=None, **options):
    return T.train_model(
        parts(spark, d), "price", algorithm=algorithm, params=params, id_column="p_partkey", **options
    )


@query("train_logistic", _expected("lineitem", 0))
def train_logistic(spark, d):
    """Three classes over all lines, which have no key: equal rows are numbered."""
    result = T.train_model(lines(spark, d), "l_returnflag", algorithm="logistic_regression", cv_folds=0)
    return _checked(spark, result, 0.3)


@query("train_ridge", _expected("part", 5))
def train_ridge(spark, d):
    return _checked(spark, _price(spark, d, "ridge", parallelism=5), 0.5)


@query("train_rf_classifier", _expected(_LABELLED, 0))
def train_rf_classifier(spark, d):
    return _checked(spark, _quality(spark, d, "random_forest", cv_folds=0), 0.5)


@query("train_rf_regressor", _expected("part", 5))
def train_rf_regressor(spark, d):
    """The default forest with its folds, which README has figures of."""
    return _checked(spark, _price(spark, d, "random_forest", parallelism=2), 0.5)


@query("train_gbt_classifier", _expected(_LABELLED, 0))
def train_gbt_classifier(spark, d):
    return _checked(spark, _quality(spark, d, "gradient_boosting", TREES, cv_folds=0), 0.5)


@query("train_gbt_regressor", _expected("part", 0))
def train_gbt_regressor(spark, d):
    return _checked(spark, _price(spark, d, "gradient_boosting", TREES, cv_folds=0), 0.5)


@query("train_gbt_multiclass", _expected("lineitem", 0))
def train_gbt_multiclass(spark, d):
    """Three classes over all lines by one boosting of shared scores."""
    result = T.train_model(lines(spark, d), "l_returnflag", algorithm="gradient_boosting", params=TREES, cv_folds=0)
    return _checked(spark, result, 0.3)


@query("cross_validate", "SELECT cast(range AS integer) AS fold, true AS above_floor FROM range(5)")
def cross_validate(spark, d):
    df = documents(spark, d)
    data = T.prepare_data(df, "quality", id_column="doc_id")
    scores = T.cross_validate(
        data.folded,
        "quality",
        create_model("logistic_regression", "classification"),
        fold="_fold",
        classes=data.classes,
        exclude=data.exclude,
        parallelism=5,
    )
    return spark.createDataFrame([(i, s > 0.5) for i, s in enumerate(scores)], "fold int, above_floor boolean")


@query("train_result")
def train_result(spark, d):
    return _metrics(spark, _price(spark, d, "ridge", parallelism=5))


@query("feature_importance")
def feature_importance(spark, d):
    result = _price(spark, d, "random_forest", TREES, cv_folds=0)
    return T.importance_table(spark, result.feature_importance, 20)


@query("compare_models")
def compare_models(spark, d):
    _, board = T.compare_models(
        parts(spark, d),
        "price",
        params={"random_forest": TREES, "gradient_boosting": TREES},
        id_column="p_partkey",
        cv_folds=2,
        parallelism=2,
    )
    return board.drop("seconds")


def _stored(spark, d):
    result = _price(spark, d, "ridge")
    return T.load_model(spark, T.save_model(spark, result, scratch_path(spark, "model")))


@query(
    "model_roundtrip",
    """
SELECT 'ridge' AS algorithm, 'regression' AS task, 'price' AS target, feature FROM (
  SELECT 'serial' AS feature UNION ALL SELECT 'p_size'
  UNION ALL SELECT DISTINCT concat('p_brand_', p_brand) FROM part
  UNION ALL SELECT DISTINCT concat('p_type_', p_type) FROM part)""",
)
def model_roundtrip(spark, d):
    model, meta = _stored(spark, d)
    rows = [(model.algorithm, model.task, model.target, f) for f in meta["feature_names"]]
    return spark.createDataFrame(rows, "algorithm string, task string, target string, feature string")


_BAND = "CASE WHEN p_size <= 15 THEN 'small' WHEN p_size <= 35 THEN 'medium' ELSE 'large' END"


@query("evaluate_confusion", f"SELECT {_BAND} AS actual, {_BAND} AS predicted, count(*) AS n FROM part GROUP BY 1, 2")
def evaluate_confusion(spark, d):
    """Confusion matrix of a stored model of three bands of size, which one feature tells apart without error."""
    df = parts(spark, d).withColumn("band", F.expr(_BAND))
    params = {"n_estimators": 5, "max_bins": 64}
    result = T.train_model(df, "band", algorithm="gradient_boosting", params=params, id_column="p_partkey", cv_folds=2)
    model, meta = T.load_model(spark, T.save_model(spark, result, scratch_path(spark, "model")))
    held_out = meta["confusion_matrix"].agg(F.sum("n")).first()[0]
    if held_out != result.n_validation:
        raise AssertionError(f"the stored matrix counts {held_out} rows of {result.n_validation}")
    return T.evaluation(model, df).confusion


@query("model_roundtrip_scores", "SELECT p_partkey, true AS same FROM part")
def model_roundtrip_scores(spark, d):
    """Predictions of every part by a model and by the same one stored and read again."""
    result = _price(spark, d, "ridge")
    stored, _ = T.load_model(spark, T.save_model(spark, result, scratch_path(spark, "model")))
    rows = parts(spark, d).drop("price")
    first, second = (T.predict(m, rows, "p_partkey").select("p_partkey", "prediction") for m in (result.model, stored))
    both = first.withColumnRenamed("prediction", "before").join(second, "p_partkey")
    return both.select("p_partkey", F.col("before").eqNullSafe(F.col("prediction")).alias("same"))


_RIDGE = """
WITH p AS (SELECT p_partkey % 1000 AS a, p_size AS b, p_retailprice + (p_partkey * 7919) % 97 AS y,
    md5(concat(length(cast(p_partkey AS varchar)), ':', cast(p_partkey AS varchar), '-42')) AS h FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY h) AS rn, cast(ceil(count(*) OVER () / 10) AS bigint) AS held, count(*) OVER () AS rows FROM p),
k AS (SELECT a, b, y, rn - held AS rn, rows - held AS rows, (rows - held) // 5 AS q, (rows - held) % 5 AS x FROM r),
d AS (SELECT a, b, y, CASE WHEN rn < 1 THEN -1 WHEN rn <= x * (q + 1) THEN (rn - 1) // (q + 1) ELSE x + (rn - 1 - x * (q + 1)) // q END AS fold FROM k),
-- Part -1 is held out of the whole training, parts 0 to 4 are the folds within it.
t AS (SELECT f, a, b, y FROM d, range(-1, 5) AS u(f) WHERE d.fold >= 0 AND d.fold <> f),
s AS (SELECT f, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(y) AS my FROM t GROUP BY f),
z AS (SELECT f, (a - ma) / sa AS a, (b - mb) / sb AS b, y - my AS y FROM t JOIN s USING (f)),
g AS (SELECT f, sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS ay, sum(b * y) AS yb FROM z GROUP BY f),
w AS (SELECT f, (bb * ay - ab * yb) / (aa * bb - ab * ab) AS wa, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS wb FROM g),
e AS (SELECT s.f, d.y, my + wa * (a - ma) / sa + wb * (b - mb) / sb AS q FROM d JOIN s ON d.fold = s.f JOIN w ON w.f = s.f),
m AS (SELECT f, avg(abs(y - q)) AS mae, avg((y - q) * (y - q)) AS mse, var_pop(y) AS v FROM e GROUP BY f)
SELECT 'hold-out' AS part, 'mae' AS metric, round(mae, 4) AS value FROM m WHERE f = -1
UNION ALL SELECT 'hold-out', 'mse', round(mse, 4) FROM m WHERE f = -1
UNION ALL SELECT 'hold-out', 'rmse', round(sqrt(mse), 4) FROM m WHERE f = -1
UNION ALL SELECT 'hold-out', 'r2', round(1 - mse / v, 4) FROM m WHERE f = -1
UNION ALL SELECT 'fold', cast(f AS varchar), round(1 - mse / v, 4) FROM m WHERE f >= 0
"""


@query("evaluate_ridge", _RIDGE)
def evaluate_ridge(spark, d):
    """Scores of a ridge model of two numbers and of its folds, which SQL has from the normal equations."""
    df = parts(spark, d).select(
        "p_partkey", "serial", "p_size", (F.col("price") + F.col("p_partkey") * 7919 % 97).alias("price")
    )
    result = T.train_model(df, "price", algorithm="ridge", id_column="p_partkey")
    rows = [("hold-out", k, v) for k, v in result.metrics.items()]
    rows += [("fold", str(i), v) for i, v in enumerate(result.cv_scores["cv_scores"])]
    return spark.createDataFrame(rows, "part string, metric string, value double")


@query("evaluate_model")
def evaluate_model(spark, d):
    model, _ = _stored(spark, d)
    metrics = T.evaluate(model, parts(spark, d))
    return spark.createDataFrame(list(metrics.items()), "metric string, value double")


@query("predict_scores", "SELECT doc_id, true AS known_label, 1.0e0 AS total_probability FROM documents")
def predict_scores(spark, d):
    """Every document, labelled or not, with what must hold of any prediction."""
    model = _quality(spark, d, "logistic_regression", cv_folds=0).model
    scored = T.predict(model, documents(spark, d).drop("quality"), "doc_id")
    shares = sum((F.col(c) for c in model.probability_columns.values()), F.lit(0.0))
    return scored.select(
        "doc_id",
        F.col("prediction").isin(model.classes).alias("known_label"),
        F.round(shares, 6).alias("total_probability"),
    )


@query("predict_sink", "SELECT p_partkey, true AS has_prediction FROM part")
def predict_sink(spark, d):
    """Predictions of every part written as text and read back."""
    model = _price(spark, d, "ridge").model
    scored = T.predict(model, parts(spark, d).drop("price"), "p_partkey")
    back = load_table(spark, save_table(scored, scratch_path(spark, "predictions"), "csv"), "csv")
    return back.select("p_partkey", F.col("prediction").isNotNull().alias("has_prediction"))


@query("predict_preview")
def predict_preview(spark, d):
    model = _price(spark, d, "ridge").model
    return T.predict_preview(T.predict(model, parts(spark, d).drop("price"), "p_partkey"), "p_partkey")
