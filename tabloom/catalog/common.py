"""Registration of queries with their SQL counterparts, and inputs shared by them.

Inputs with defects are derived from whole tables by SQL text that both engines run as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", "parquet", allow_empty=True)


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run shared SQL text over the tables it names."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace("{text}", "string"), **used)


def duck(sql: str) -> str:
    """The same text for the other engine, where the tables are views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("{text}", "varchar").replace("{{", "{").replace("}}", "}")


# Customers with missing numbers, missing text and a column that is mostly empty.
DIRTY_CUSTOMER = """
SELECT c_custkey,
       c_nationkey,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance,
       CASE WHEN c_nationkey < 3 THEN NULL ELSE c_mktsegment END AS segment,
       CASE WHEN c_acctbal > 9000 THEN c_acctbal END AS sparse,
       'retail' AS channel
FROM {customer}
"""

# Lines without a key: many equal rows, missing cells, outliers and a sparse column.
DIRTY_LINES = """
SELECT l_returnflag AS flag,
       CASE WHEN l_linestatus = 'F' AND l_quantity < 5 THEN NULL ELSE l_linestatus END AS status,
       CASE WHEN l_tax > 0.075 THEN NULL ELSE l_quantity END AS quantity,
       CASE WHEN l_quantity > 49 AND l_discount > 0.095 THEN l_discount * 100 ELSE l_discount END AS discount,
       l_linenumber AS line,
       CASE WHEN l_quantity > 45 THEN l_quantity END AS sparse
FROM {lineitem}
"""

# A table of facts without a key, most rows of which occur many times.
LINE_FACTS = "SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_linenumber FROM {lineitem}"

# Rule-made predictions, so that every metric has an exact counterpart.
BINARY_SCORES = """
SELECT l_linestatus AS actual,
       CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END AS prediction,
       l_quantity / 50.0e0 AS score
FROM {lineitem}
"""
CLASS_SCORES = """
SELECT l_returnflag AS actual,
       CASE WHEN l_discount < 0.035 THEN 'A' WHEN l_quantity > 20 THEN 'N' ELSE 'R' END AS prediction,
       l_discount * 10 AS score_a,
       l_quantity / 50.0e0 AS score_n,
       l_tax * 12.5e0 AS score_r
FROM {lineitem}
"""
VALUE_SCORES = """
SELECT l_extendedprice / 1000.0e0 AS actual, l_quantity * 2.1e0 AS prediction FROM {lineitem}
"""
# Run records derived from orders; one metrics text in three is broken.
RUN_RECORDS = """
SELECT substring(md5(cast(o_orderkey AS {text})), 1, 12) AS id,
       o_orderdate AS timestamp,
       o_orderpriority AS model,
       CASE WHEN o_orderstatus = 'F' THEN 'regression' ELSE 'classification' END AS task,
       concat('{{"depth": "', cast(o_custkey AS {text}), '"}}') AS hyperparameters,
       CASE WHEN o_orderstatus = 'P' THEN '{{"accuracy": '
            WHEN o_orderstatus = 'F' THEN concat('{{"r2": 0.', cast(o_custkey AS {text}), '}}')
            ELSE concat('{{"accuracy": 0.', cast(o_custkey AS {text}), '}}') END AS metrics,
       o_custkey AS n_train,
       o_orderkey AS seq
FROM {orders}
"""
