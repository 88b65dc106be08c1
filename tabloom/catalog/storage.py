"""Queries: files written and read back, generated data, run records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tabloom.catalog.common import RUN_RECORDS, VALUE_SCORES, derived, duck, query, table
from tabloom.functions.storage import scratch_path
from tabloom.operators import metrics as M
from tabloom.plans import runs as R
from tabloom.sources.generated import CHURN, PRICE, customers_for
from tabloom.sources.tables import dataset_size_mb, load_table, save_document, save_table

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _orders(spark, d):
    return table(spark, d, "orders")


def _dated(df):
    """Text formats hold times as text; they come back as such."""
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


@query("csv_roundtrip", f"SELECT {ORDER_COLUMNS} FROM orders")
def csv_roundtrip(spark, d):
    path = save_table(_orders(spark, d), scratch_path(spark, "csv"), "csv")
    return _dated(load_table(spark, path, "csv"))


@query(
    "csv_folder_mixed",
    "SELECT s_suppkey, concat('é ', s_name) AS name, cast(s_nationkey AS bigint) AS s_nationkey, s_acctbal FROM supplier",
)
def csv_folder_mixed(spark, d):
    """One folder of files in two column orders and two encodings."""
    path = scratch_path(spark, "csv")
    df = table(spark, d, "supplier").withColumn("name", F.concat(F.lit("é "), "s_name"))
    first = df.where("s_suppkey % 3 = 0").select("s_suppkey", "name", "s_nationkey", "s_acctbal")
    other = df.where("s_suppkey % 3 <> 0").select("s_acctbal", "s_suppkey", "name", "s_nationkey")
    first.write.csv(path, header=True)
    other.write.mode("append").csv(path, header=True, encoding="ISO-8859-1")
    return load_table(spark, path, "csv").select("s_suppkey", "name", "s_nationkey", "s_acctbal")


@query("csv_autosep", "SELECT conv_id, turn, role, text FROM conversations")
def csv_autosep(spark, d):
    """Whole texts, with commas, quotes and line breaks, in a semicolon-separated file."""
    path = scratch_path(spark, "csv")
    df = table(spark, d, "conversations")
    df.write.csv(path, header=True, sep=";", escape='"', quoteAll=True, lineSep="\n")
    return load_table(spark, path, "csv")


@query("csv_encoding", "SELECT s_suppkey, concat('é ', s_name) AS name, s_acctbal FROM supplier")
def csv_encoding(spark, d):
    path = scratch_path(spark, "csv")
    df = table(spark, d, "supplier").select(
        "s_suppkey", F.concat(F.lit("é "), "s_name").alias("name"), "s_acctbal"
    )
    df.write.csv(path, header=True, encoding="ISO-8859-1")
    return load_table(spark, path, "csv")


@query(
    "csv_na_infer",
    """
SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN NULL ELSE cast(c_nationkey AS bigint) END AS nation,
       CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, c_acctbal > 5000 AS rich,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment FROM customer""",
)
def csv_na_infer(spark, d):
    path = scratch_path(spark, "csv")
    df = table(spark, d, "customer").selectExpr(
        "c_custkey",
        "if(c_nationkey < 5, 'NA', cast(c_nationkey as string)) as nation",
        "if(c_acctbal < 0, 'n/a', cast(c_acctbal as string)) as balance",
        "if(c_acctbal > 5000, 'True', 'False') as rich",
        "if(c_mktsegment = 'BUILDING', 'null', c_mktsegment) as segment",
    )
    df.write.csv(path, header=True)
    return load_table(spark, path, "csv")


def _array_writer():
    """Lines of one JSON array per task; records stream through batch by batch.

    Made here rather than at module level, so that tasks get the function itself and need not
    import this package.
    """

    def lines(batches):
        first = True
        for batch in batches:
            head = pd.Series([","] * len(batch), index=batch.index)
            if first and len(batch):
                head.iloc[0], first = "[", False
            yield pd.DataFrame({"value": head + batch["value"]})
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    return lines


@query("json_roundtrip", f"SELECT {ORDER_COLUMNS} FROM orders")
def json_roundtrip(spark, d):
    """One document per task, each an array of records."""
    path = scratch_path(spark, "json")
    df = _orders(spark, d)
    records = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    records.mapInPandas(_array_writer(), "value string").write.text(path)
    return _dated(load_table(spark, path, "json")).select(*df.columns)


@query("json_columns", "SELECT n_nationkey, n_name, cast(n_regionkey AS bigint) AS n_regionkey, n_nationkey / 4 AS quarter FROM nation")
def json_columns(spark, d):
    """One document that holds the 25 nations column by column, values by row number."""
    df = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey", (F.col("n_nationkey") / 4).alias("quarter"))
    cells = lambda c: F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.col(c))))
    document = df.agg(*[cells(c).alias(c) for c in df.columns]).select(F.to_json(F.struct(*df.columns)).alias("value"))
    path = scratch_path(spark, "json")
    document.coalesce(1).write.text(path)
    return load_table(spark, path, "json")


@query("jsonl_roundtrip", f"SELECT {ORDER_COLUMNS} FROM orders")
def jsonl_roundtrip(spark, d):
    df = _orders(spark, d)
    path = save_table(df, scratch_path(spark, "jsonl"), "jsonl")
    return _dated(load_table(spark, path, "jsonl")).select(*df.columns)


@query(
    "metrics_json",
    """
WITH p AS (SELECT l_extendedprice / 1000.0e0 AS a, l_quantity * 2.1e0 AS b FROM lineitem)
SELECT round(avg(abs(a - b)), 4) AS mae, round(avg((a - b) * (a - b)), 4) AS mse,
       round(sqrt(avg((a - b) * (a - b))), 4) AS rmse,
       round(1 - avg((a - b) * (a - b)) / var_pop(a), 4) AS r2, 'lineitem' AS dataset FROM p""",
)
def metrics_json(spark, d):
    scored = derived(spark, d, VALUE_SCORES)
    row = M.regression_metrics(scored, "actual", "prediction").withColumn("dataset", F.lit("lineitem"))
    path = save_document(row, scratch_path(spark, "metrics"))
    return load_table(spark, path, "jsonl").select(*row.columns)


@query("dataset_size_mb")
def dataset_size(spark, d):
    return dataset_size_mb(spark, f"{d}/lineitem.parquet")


# --------------------------------------------------------------------------- generated data
def _u(name, seed=42):
    digest = f"md5(concat('{seed}-{name}-', cast(c_custkey AS varchar)))"
    return f"((cast('0x' || substring({digest}, 1, 12) AS bigint) + 0.5e0) / 281474976710656.0e0)"


def _normal(name):
    return f"(sqrt(-2.0e0 * ln({_u(name + '/r')})) * cos(2 * pi() * {_u(name + '/a')}))"


_GENERATED = f"""
WITH b AS (
  SELECT format('CUST-{{:05d}}', c_custkey) AS customer_id,
    cast(floor({_u('tenure')} * 72) + 1 AS integer) AS tenure,
    round(20 + 100 * {_u('monthly_charges')}, 2) AS charges,
    cast(floor({_u('age')} * 64) + 18 AS integer) AS age,
    floor({_u('support_calls')} * 10) AS calls,
    least(greatest(round(60000 + 25000 * {_normal('income')}, 0), 15000), 250000) AS income,
    CASE WHEN {_u('gender')} < 0.5e0 THEN 'Male' ELSE 'Female' END AS gender,
    CASE WHEN {_u('contract')} < 0.55e0 THEN 'Month-to-month' WHEN {_u('contract')} < 0.8e0 THEN 'One year' ELSE 'Two year' END AS contract,
    CASE WHEN {_u('payment_method')} < 0.25e0 THEN 'Credit card' WHEN {_u('payment_method')} < 0.5e0 THEN 'Bank transfer'
         WHEN {_u('payment_method')} < 0.75e0 THEN 'Electronic check' ELSE 'Mailed check' END AS payment_method,
    {_normal('target')} AS noise, {_u('churn')} AS draw,
    {_u('missing/monthly_charges')} < 0.03e0 AS hole1, {_u('missing/support_calls')} < 0.02e0 AS hole2
  FROM customer)
SELECT customer_id, tenure, CASE WHEN NOT hole1 THEN charges END AS monthly_charges, age,
       CASE WHEN NOT hole2 THEN calls END AS support_calls, income, gender, contract, payment_method, """


@query(
    "demo_classification",
    _GENERATED
    + f"""CASE WHEN draw < 1 / (1 + exp(-({CHURN['tenure']}e0 * tenure + {CHURN['monthly_charges']}e0 * charges
  + {CHURN['support_calls']}e0 * calls + CASE WHEN contract = 'Month-to-month' THEN {CHURN['month_to_month']}e0 ELSE 0 END
  + CASE WHEN contract = 'Two year' THEN {CHURN['two_year']}e0 ELSE 0 END
  + CASE WHEN gender = 'Male' THEN {CHURN['male']}e0 ELSE 0 END + {CHURN['base']}e0 + {CHURN['noise']}e0 * noise)))
  THEN 1 ELSE 0 END AS churn FROM b""",
)
def demo_classification(spark, d):
    return customers_for(table(spark, d, "customer"), "c_custkey")


@query(
    "demo_regression",
    _GENERATED
    + f"""greatest(round({PRICE['base']}e0 + {PRICE['tenure']}e0 * tenure + {PRICE['monthly_charges']}e0 * charges
  + {PRICE['support_calls']}e0 * calls + {PRICE['income']}e0 * income
  + CASE WHEN contract = 'One year' THEN {PRICE['one_year']}e0 ELSE 0 END
  + CASE WHEN contract = 'Two year' THEN {PRICE['two_year']}e0 ELSE 0 END + {PRICE['noise']}e0 * noise, 0), 0) AS price FROM b""",
)
def demo_regression(spark, d):
    return customers_for(table(spark, d, "customer"), "c_custkey", task="regression")


# --------------------------------------------------------------------------- run records
_RUNS = duck(RUN_RECORDS)
_DECODED = f"""
WITH r AS ({_RUNS}),
d AS (SELECT *, CASE WHEN task = 'regression' OR metrics LIKE '%}}' THEN
    cast(regexp_extract(metrics, '0\\.[0-9]+', 0) AS double) END AS value FROM r)
"""


def _records(spark, d):
    return derived(spark, d, RUN_RECORDS)


def _decoded(spark, d):
    return R.decode_runs(_records(spark, d))


@query(
    "experiments_decode",
    _DECODED
    + """SELECT id, task, regexp_extract(hyperparameters, '[0-9]+', 0) AS depth,
         CASE WHEN value IS NULL THEN 0 ELSE 1 END AS metric_count, value FROM d""",
)
def experiments_decode(spark, d):
    df = _decoded(spark, d)
    return df.select(
        "id",
        "task",
        F.try_element_at("hyperparameters", F.lit("depth")).alias("depth"),
        F.size("metrics").alias("metric_count"),
        F.coalesce(
            F.try_element_at("metrics", F.lit("accuracy")), F.try_element_at("metrics", F.lit("r2"))
        ).alias("value"),
    )


@query(
    "experiments_primary",
    _DECODED
    + """SELECT id, CASE WHEN value IS NOT NULL THEN CASE WHEN task = 'regression' THEN 'r2' ELSE 'accuracy' END END
         AS primary_metric, value AS primary_value FROM d""",
)
def experiments_primary(spark, d):
    return R.with_primary_metric(_decoded(spark, d)).select("id", "primary_metric", "primary_value")


@query(
    "experiments_list",
    f"SELECT id, model, task, strftime(timestamp, '%Y-%m-%d %H:%M') AS time, seq FROM ({_RUNS}) "
    "ORDER BY timestamp DESC, seq DESC LIMIT 50",
)
def experiments_list(spark, d):
    newest = R.newest_runs(_records(spark, d), 50)
    return newest.select("id", "model", "task", R.display_time("timestamp").alias("time"), "seq")


@query("experiments_count", f"SELECT count(*) AS runs FROM ({_RUNS})")
def experiments_count(spark, d):
    return _records(spark, d).agg(F.count(F.lit(1)).alias("runs"))


def _stored(spark, d) -> R.RunTable:
    """All records appended to a run table in one write."""
    rows = _decoded(spark, d).select(
        "id",
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        "model",
        "task",
        F.lit("orders").alias("dataset"),
        "hyperparameters",
        "metrics",
        "n_train",
        "seq",
    )
    store = R.RunTable(spark, scratch_path(spark, "runs"))
    store.append(rows)
    return store


@query(
    "experiments_record",
    _DECODED + "SELECT model, task, count(*) AS runs, cast(sum(n_train) AS bigint) AS rows, count(value) AS measured FROM d GROUP BY 1, 2",
)
def experiments_record(spark, d):
    runs = _stored(spark, d).runs()
    return runs.groupBy("model", "task").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("n_train").alias("rows"),
        F.count_if(F.size("metrics") > 0).alias("measured"),
    )


@query("experiments_get", f"SELECT id, model, task, seq FROM ({_RUNS}) WHERE seq = 7")
def experiments_get(spark, d):
    store = _stored(spark, d)
    wanted = spark.sql("SELECT substring(md5('7'), 1, 12) AS id").first()["id"]
    store.get(wanted)
    return store.runs().where(F.col("id") == wanted).select("id", "model", "task", "seq")


@query("experiments_delete", f"SELECT id, model FROM ({_RUNS}) WHERE model <> '5-LOW'")
def experiments_delete(spark, d):
    df = _records(spark, d)
    deleted = df.where("model = '5-LOW'").select("id")
    return R.without_deleted(df, deleted).select("id", "model")


@query("experiments_delete_stored", f"SELECT id, model FROM ({_RUNS}) WHERE seq <> 7")
def experiments_delete_stored(spark, d):
    """One run deleted from the stored table."""
    store = _stored(spark, d)
    store.delete(spark.sql("SELECT substring(md5('7'), 1, 12) AS id").first()["id"])
    return store.runs().select("id", "model")


@query("experiments_export", _DECODED + "SELECT id, model, task, value FROM d")
def experiments_export(spark, d):
    path = _stored(spark, d).export(scratch_path(spark, "export"))
    back = spark.read.schema("id string, model string, task string, metrics map<string,double>").json(path)
    value = F.coalesce(
        F.try_element_at("metrics", F.lit("accuracy")), F.try_element_at("metrics", F.lit("r2"))
    )
    return back.select("id", "model", "task", value.alias("value"))
