"""Queries: loading, profiling, validation and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog.common import DIRTY_CUSTOMER, LINE_FACTS, derived, duck, query, table
from tabloom.functions.longform import union_all
from tabloom.operators import profile as P
from tabloom.operators import validate as V
from tabloom.plans.report import report_rows
from tabloom.sources.tables import load_table

CUSTOMER = [
    ("c_custkey", "bigint"),
    ("c_name", "string"),
    ("c_nationkey", "int"),
    ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
]
LINEITEM = [
    ("l_orderkey", "bigint"),
    ("l_partkey", "bigint"),
    ("l_suppkey", "bigint"),
    ("l_linenumber", "int"),
    ("l_quantity", "double"),
    ("l_extendedprice", "double"),
    ("l_discount", "double"),
    ("l_tax", "double"),
    ("l_returnflag", "string"),
    ("l_linestatus", "string"),
    ("l_shipdate", "timestamp_ntz"),
]
NUMBERS = [c for c, kind in LINEITEM if kind in ("bigint", "int", "double")]
DIRTY = duck(DIRTY_CUSTOMER)
DIRTY_NAMES = ["c_custkey", "c_nationkey", "balance", "segment", "sparse", "channel"]


def stacked(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


@query("load_parquet", "SELECT * FROM customer")
def load_parquet(spark, d):
    return load_table(spark, f"{d}/customer.parquet")


@query("select_numeric", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_numeric(spark, d):
    return P.select_numeric(table(spark, d, "customer"))


@query(
    "dataset_summary",
    f"""
WITH d AS ({DIRTY}),
u AS (SELECT count(*) AS kinds FROM (SELECT DISTINCT * FROM d)),
m AS (SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in DIRTY_NAMES)} AS holes FROM d)
SELECT n AS rows, 6 AS columns, 4 AS numeric_columns, 2 AS categorical_columns,
       cast(holes AS bigint) AS missing_values, round(100.0e0 * holes / (n * 6), 2) AS missing_pct,
       n - kinds AS duplicate_rows
FROM m, u""",
)
def dataset_summary(spark, d):
    return P.dataset_summary(derived(spark, d, DIRTY_CUSTOMER))


def _profile_sql(name, columns):
    return stacked(
        [
            f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS dtype, count({c}) AS non_null, "
            f"count(DISTINCT {c}) AS \"distinct\" FROM {name}"
            for i, (c, kind) in enumerate(columns, start=1)
        ]
    )


@query("column_profile", _profile_sql("lineitem", LINEITEM))
def column_profile(spark, d):
    return P.column_profile(table(spark, d, "lineitem"))


@query(
    "missing_by_column",
    f"WITH d AS ({DIRTY}) "
    + stacked(
        [
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
            f"round((count(*) - count({c})) / cast(count(*) AS double), 4) AS missing_share FROM d"
            for c in DIRTY_NAMES
        ]
    ),
)
def missing_by_column(spark, d):
    return P.missing_by_column(derived(spark, d, DIRTY_CUSTOMER))


@query(
    "duplicate_count",
    f"WITH d AS ({duck(LINE_FACTS)}) SELECT (SELECT count(*) FROM d) - "
    "(SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows",
)
def duplicate_count(spark, d):
    return P.duplicate_count(derived(spark, d, LINE_FACTS))


@query(
    "constant_columns",
    f"WITH d AS ({DIRTY}) SELECT \"column\" FROM ("
    + stacked([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS k FROM d" for c in DIRTY_NAMES])
    + ") WHERE k <= 1",
)
def constant_columns(spark, d):
    return P.constant_columns(derived(spark, d, DIRTY_CUSTOMER))


@query(
    "class_balance",
    f"WITH d AS ({DIRTY}) SELECT segment AS value, count(*) AS n FROM d WHERE segment IS NOT NULL GROUP BY 1",
)
def class_balance(spark, d):
    return P.value_counts(derived(spark, d, DIRTY_CUSTOMER), "segment")


@query(
    "stratify_check",
    "SELECT count(*) AS classes, min(n) AS smallest, count(*) >= 2 AND min(n) >= 2 AS can_stratify "
    "FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)",
)
def stratify_check(spark, d):
    return P.stratify_check(table(spark, d, "lineitem"), "l_returnflag")


@query(
    "numeric_describe",
    stacked(
        [
            f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg(v), 4) AS mean, "
            f"round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, "
            f"round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, "
            f"round(quantile_cont(v, 0.75), 4) AS p75, round(max(v), 4) AS max "
            f"FROM (SELECT {c}, cast({c} AS double) AS v FROM lineitem)"
            for c in NUMBERS
        ]
    ),
)
def numeric_describe(spark, d):
    return P.numeric_describe(table(spark, d, "lineitem"))


@query(
    "correlation_matrix",
    stacked(
        [
            f"SELECT '{a}' AS \"column\", '{b}' AS other, "
            f"round(corr(cast({a} AS double), cast({b} AS double)), 4) AS correlation FROM lineitem"
            for a in NUMBERS
            for b in NUMBERS
        ]
    ),
)
def correlation_matrix(spark, d):
    return P.correlation_matrix(table(spark, d, "lineitem"))


_VARIANCES = stacked(
    [
        f"SELECT '{c}' AS \"column\", round(var_samp(cast({c} AS double)), 2) AS variance FROM lineitem"
        for c in NUMBERS
    ]
)


@query("top_variance_columns", f"SELECT * FROM ({_VARIANCES}) ORDER BY variance DESC LIMIT 16")
def top_variance_columns(spark, d):
    top = P.top_variance_columns(table(spark, d, "lineitem"))
    return top.withColumn("variance", F.round("variance", 2))


def _histogram_sql(name, columns, source=None):
    head = f"WITH src AS ({source})" if source else "WITH src AS (SELECT * FROM " + name + ")"
    parts = []
    for c in columns:
        parts.append(
            f"""
SELECT '{c}' AS "column", cast(b.bin AS integer) AS bin,
       round(r.lo + (r.hi - r.lo) * b.bin / 30, 4) AS low,
       round(r.lo + (r.hi - r.lo) * (b.bin + 1) / 30, 4) AS high,
       coalesce(h.n, 0) AS n
FROM (SELECT min(cast({c} AS double)) AS lo, max(cast({c} AS double)) AS hi FROM src) r
CROSS JOIN (SELECT range AS bin FROM range(30)) b
LEFT JOIN (
  SELECT least(floor((cast({c} AS double) - lo) * 30 / (hi - lo)), 29) AS bin, count(*) AS n
  FROM src, (SELECT min(cast({c} AS double)) AS lo, max(cast({c} AS double)) AS hi FROM src)
  WHERE {c} IS NOT NULL GROUP BY 1
) h ON h.bin = b.bin"""
        )
    return head + stacked(parts)


def _rounded(df):
    return df.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query("feature_histograms", _histogram_sql("lineitem", NUMBERS))
def feature_histograms(spark, d):
    return _rounded(P.feature_histograms(table(spark, d, "lineitem")))


@query("target_distribution_num", _histogram_sql("orders", ["o_totalprice"]))
def target_distribution_num(spark, d):
    return _rounded(P.target_distribution(table(spark, d, "orders"), "o_totalprice"))


@query(
    "target_distribution_cat",
    "SELECT cast(l_linenumber AS varchar) AS value, count(*) AS n FROM lineitem GROUP BY 1",
)
def target_distribution_cat(spark, d):
    return P.target_distribution(table(spark, d, "lineitem"), "l_linenumber")


_FINDINGS = (
    f"WITH d AS ({DIRTY}), "
    + "p AS ("
    + stacked(
        [
            f"SELECT '{c}' AS \"column\", (count(*) - count({c})) / cast(count(*) AS double) AS share, "
            f"count(DISTINCT {c}) AS k FROM d"
            for c in DIRTY_NAMES
        ]
    )
    + ")"
)


@query(
    "validate_report",
    _FINDINGS
    + """
SELECT CASE WHEN share > 0.5 THEN 'error' ELSE 'warning' END AS severity, 'missing' AS "check", "column",
       round(share, 4) AS value FROM p WHERE share > 0.05
UNION ALL SELECT 'warning', 'constant', "column", 1.0e0 FROM p WHERE k <= 1
UNION ALL SELECT 'error', 'required', 'region', 1.0e0
UNION ALL SELECT 'error', 'rows', NULL, cast(count(*) AS double) FROM d HAVING count(*) < 1000000000000""",
)
def validate_report(spark, d):
    report = V.validate(
        derived(spark, d, DIRTY_CUSTOMER),
        required_columns=["c_custkey", "region"],
        min_rows=1_000_000_000_000,
        max_missing_share=0.5,
    )
    return report.findings.drop("message")


@query(
    "validate_merge",
    f"""
WITH a AS ({DIRTY}), b AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer),
f AS ({duck(LINE_FACTS)})
SELECT 'rows' AS "check", cast(NULL AS varchar) AS "column",
       (SELECT count(*) FROM a) + (SELECT count(*) FROM b) + (SELECT count(*) FROM f) AS value
UNION ALL SELECT 'columns', NULL, 6
UNION ALL SELECT 'duplicates', NULL, (SELECT count(*) FROM f) - (SELECT count(*) FROM (SELECT DISTINCT * FROM f))
UNION ALL SELECT 'missing', 'balance', count(*) - count(balance) FROM a
UNION ALL SELECT 'missing', 'segment', count(*) - count(segment) FROM a
UNION ALL SELECT 'missing', 'sparse', count(*) - count(sparse) FROM a
UNION ALL SELECT 'constant', 'channel', 1""",
)
def validate_merge(spark, d):
    reports = [
        V.validate(derived(spark, d, DIRTY_CUSTOMER)),
        V.validate(derived(spark, d, "SELECT c_custkey, c_nationkey, c_mktsegment FROM {customer}")),
        V.validate(derived(spark, d, LINE_FACTS)),
    ]
    return V.merge_reports(*reports).facts.drop("total")


_TARGETS = [("l_returnflag", False), ("l_linestatus", False), ("l_linenumber", True), ("l_quantity", True), ("l_extendedprice", True)]


@query(
    "infer_task",
    stacked(
        [
            f"SELECT '{c}' AS target, count(*) AS rows, count({c}) AS present, count(DISTINCT {c}) AS classes, "
            + (
                f"CASE WHEN count(DISTINCT {c}) <= 20 AND count(DISTINCT {c}) < 0.5 * count(*) "
                "THEN 'classification' ELSE 'regression' END"
                if numeric
                else "'classification'"
            )
            + f" AS task, count(DISTINCT {c}) = 2 AS \"binary\" FROM lineitem"
            for c, numeric in _TARGETS
        ]
    ),
)
def infer_task(spark, d):
    df = table(spark, d, "lineitem")
    return union_all([V.target_profile(df, c).withColumn("target", F.lit(c)) for c, _ in _TARGETS])


@query(
    "label_encode",
    "SELECT o_orderkey, cast(CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '3-MEDIUM' THEN 1 "
    "WHEN '4-NOT SPECIFIED' THEN 2 WHEN '5-LOW' THEN 3 ELSE -1 END AS integer) AS label_index FROM orders",
)
def label_encode(spark, d):
    df = table(spark, d, "orders")
    seen = V.label_table(df.where("o_orderpriority <> '1-URGENT'"), "o_orderpriority")
    labels = [r["label"] for r in seen.orderBy("label_index").collect()]
    return V.encode_labels(df.select("o_orderkey", "o_orderpriority"), "o_orderpriority", labels).drop(
        "o_orderpriority"
    )


@query(
    "report_rows",
    _FINDINGS.replace("WITH d", "WITH d")
    + f"""
, s AS (SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in DIRTY_NAMES)} AS holes FROM d)
SELECT 'dataset' AS section, 'Rows' AS item, cast(n AS varchar) AS value FROM s
UNION ALL SELECT 'dataset', 'Columns', '6'
UNION ALL SELECT 'dataset', 'Missing values', cast(cast(holes AS bigint) AS varchar) FROM s
UNION ALL SELECT 'dataset', 'Missing %', cast(round(100.0e0 * holes / (n * 6), 2) AS varchar) FROM s
UNION ALL SELECT 'dataset', 'Duplicate rows', '0'
UNION ALL SELECT 'dataset', 'Source', 'customer'
UNION ALL SELECT 'problems', 'churn',
  'Required column ''churn'' is absent; there are: {", ".join(DIRTY_NAMES)}.'""",
)
def report(spark, d):
    return report_rows(derived(spark, d, DIRTY_CUSTOMER), source="customer", target="churn")
