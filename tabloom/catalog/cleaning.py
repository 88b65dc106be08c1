"""Queries: cleaning steps and the whole cleaning run."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog.common import DIRTY_CUSTOMER, DIRTY_LINES, LINE_FACTS, derived, duck, query, table
from tabloom.operators import clean as C

DIRTY = duck(DIRTY_CUSTOMER)
LINES = duck(DIRTY_LINES)


def _rounded(df, *names, places=6):
    return df.withColumns({c: F.round(c, places) for c in names})


@query("clean_dedupe", f"SELECT DISTINCT * FROM ({duck(LINE_FACTS)})")
def clean_dedupe(spark, d):
    return derived(spark, d, LINE_FACTS).distinct()


@query("clean_drop_sparse_cols", f"SELECT c_custkey, c_nationkey, balance, segment, channel FROM ({DIRTY})")
def clean_drop_sparse_cols(spark, d):
    return C.drop_sparse_columns(derived(spark, d, DIRTY_CUSTOMER), 0.8)


@query(
    "clean_drop_rows",
    f"SELECT c_custkey, balance, segment FROM ({DIRTY}) WHERE balance IS NOT NULL AND segment IS NOT NULL",
)
def clean_drop_rows(spark, d):
    df = derived(spark, d, DIRTY_CUSTOMER).select("c_custkey", "balance", "segment")
    return C.impute(df, "drop")


@query(
    "clean_coerce_numeric",
    "SELECT o_orderkey, cast(round_even(o_totalprice, 0) AS bigint) AS amount, o_orderpriority FROM orders",
)
def clean_coerce_numeric(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey", F.format_number("o_totalprice", 0).alias("amount"), "o_orderpriority"
    )
    return C.coerce_columns(df, C.fit_coercion(df))


_JUNK = """
SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'unknown' ELSE cast(c_nationkey AS {text}) END AS code,
       cast(c_nationkey AS {text}) AS nation
FROM {customer}"""


@query("clean_coerce_junk", f"SELECT c_custkey, code, cast(nation AS bigint) AS nation FROM ({duck(_JUNK)})")
def clean_coerce_junk(spark, d):
    """A column with one word in twenty cells stays text; one of numbers alone becomes numeric."""
    df = derived(spark, d, _JUNK)
    return C.coerce_columns(df, C.fit_coercion(df))


_PADDED = "SELECT lpad(cast(c_custkey AS {text}), 8, '0') AS id, cast(c_nationkey AS {text}) AS nation FROM {customer}"


@query("clean_exclude", f"SELECT id, cast(nation AS bigint) AS nation FROM ({duck(_PADDED)})")
def clean_exclude(spark, d):
    """Zero-padded ids stay as they are where the caller excludes them."""
    cleaned, _, _ = C.clean_dataframe(derived(spark, d, _PADDED), exclude=["id"])
    return cleaned


_FEW = "SELECT c_custkey, balance, segment FROM (" + DIRTY + ")"


def _few(spark, d):
    return derived(spark, d, DIRTY_CUSTOMER).select("c_custkey", "balance", "segment")


@query(
    "clean_impute_mean",
    f"WITH d AS ({_FEW}) SELECT c_custkey, round(coalesce(balance, (SELECT avg(balance) FROM d)), 6) AS balance, segment FROM d",
)
def clean_impute_mean(spark, d):
    return _rounded(C.impute(_few(spark, d), "mean"), "balance")


@query(
    "clean_impute_median",
    f"WITH d AS ({_FEW}) SELECT c_custkey, "
    "round(coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM d)), 6) AS balance, segment FROM d",
)
def clean_impute_median(spark, d):
    return _rounded(C.impute(_few(spark, d), "median"), "balance")


@query(
    "clean_impute_mode",
    f"""
WITH d AS ({_FEW})
SELECT c_custkey,
       coalesce(balance, (SELECT balance FROM d WHERE balance IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS balance,
       coalesce(segment, (SELECT segment FROM d WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS segment
FROM d""",
)
def clean_impute_mode(spark, d):
    return C.impute(_few(spark, d), "most_frequent")


@query(
    "clean_impute_constant",
    f"SELECT c_custkey, coalesce(balance, -1.0e0) AS balance, coalesce(segment, '-1') AS segment FROM ({_FEW})",
)
def clean_impute_constant(spark, d):
    return C.impute(_few(spark, d), "constant", -1)


_PRICES = """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_quantity > 49 AND l_tax > 0.065 THEN l_extendedprice * 100 ELSE l_extendedprice END AS price
FROM {lineitem}
"""
_CAPPED = """
SELECT p.l_orderkey, p.l_linenumber, p.l_partkey,
       round(CASE WHEN price < lo THEN lo WHEN price > hi THEN hi ELSE price END, 4) AS price FROM p, b"""


@query(
    "clean_cap_iqr",
    f"""
WITH p AS ({duck(_PRICES)}),
q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM p),
b AS (SELECT q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM q){_CAPPED}""",
)
def clean_cap_iqr(spark, d):
    df = derived(spark, d, _PRICES)
    return _rounded(C.cap_outliers(df, "iqr", 1.5), "price", places=4)


@query(
    "clean_cap_zscore",
    f"""
WITH p AS ({duck(_PRICES)}),
b AS (SELECT avg(price) - 3 * stddev_samp(price) AS lo, avg(price) + 3 * stddev_samp(price) AS hi FROM p){_CAPPED}""",
)
def clean_cap_zscore(spark, d):
    df = derived(spark, d, _PRICES)
    return _rounded(C.cap_outliers(df, "zscore", 3.0), "price", places=4)


_FULL = f"""
WITH raw AS ({LINES}),
d AS (SELECT DISTINCT * FROM raw),
f AS (SELECT flag, status, coalesce(quantity, (SELECT avg(quantity) FROM d)) AS quantity, discount, line,
             CASE WHEN quantity IS NULL THEN 1 ELSE 0 END AS filled FROM d),
q AS (SELECT quantile_cont(quantity, 0.25) AS a1, quantile_cont(quantity, 0.75) AS a3,
             quantile_cont(discount, 0.25) AS b1, quantile_cont(discount, 0.75) AS b3,
             quantile_cont(cast(line AS double), 0.25) AS c1, quantile_cont(cast(line AS double), 0.75) AS c3 FROM f),
b AS (SELECT a1 - 3 * (a3 - a1) AS alo, a3 + 3 * (a3 - a1) AS ahi, b1 - 3 * (b3 - b1) AS blo,
             b3 + 3 * (b3 - b1) AS bhi, c1 - 3 * (c3 - c1) AS clo, c3 + 3 * (c3 - c1) AS chi FROM q)
"""


def _full(spark, d):
    return C.clean_dataframe(
        derived(spark, d, DIRTY_LINES), missing_strategy="mean", outlier_method="iqr", outlier_threshold=3.0
    )


@query(
    "clean_full",
    _FULL
    + """
SELECT flag, status, line,
       round(CASE WHEN quantity < alo THEN alo WHEN quantity > ahi THEN ahi ELSE quantity END, 6) AS quantity,
       round(CASE WHEN discount < blo THEN blo WHEN discount > bhi THEN bhi ELSE discount END, 6) AS discount
FROM f, b""",
)
def clean_full(spark, d):
    cleaned, _, _ = _full(spark, d)
    return _rounded(cleaned, "quantity", "discount")


@query(
    "clean_report",
    _FULL
    + """
SELECT (SELECT count(*) FROM raw) AS rows_before, count(*) AS rows_after, 6 AS columns_before, 5 AS columns_after,
       (SELECT count(*) FROM raw) - count(*) AS duplicates_dropped, 'sparse' AS columns_dropped,
       cast(sum(filled) AS bigint) AS missing_imputed, cast(0 AS bigint) AS rows_dropped_missing,
       cast(sum(CASE WHEN quantity < alo OR quantity > ahi THEN 1 ELSE 0 END
          + CASE WHEN discount < blo OR discount > bhi THEN 1 ELSE 0 END
          + CASE WHEN line < clo OR line > chi THEN 1 ELSE 0 END) AS bigint) AS outliers_capped
FROM f, b""",
)
def clean_report(spark, d):
    _, report, _ = _full(spark, d)
    report = report.drop("columns_coerced", "cells_lost", "cells_lost_by_column")
    return report.withColumn("columns_dropped", F.array_join("columns_dropped", ","))
