"""Queries: feature preprocessing, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog.common import DIRTY_CUSTOMER, ORACLES, derived, duck, query, table
from tabloom.functions.storage import scratch_path
from tabloom.operators import features as X
from tabloom.operators import split as S
from tabloom.sources.tables import load_table, save_splits, save_table

# Parts with missing sizes and brands; p_name has more levels than a category may have.
PARTS = """
SELECT p_partkey, p_name, p_type, p_size > 25 AS large,
       CASE WHEN p_retailprice > 1800 THEN NULL ELSE p_size END AS size,
       CASE WHEN p_size < 4 THEN NULL ELSE p_brand END AS brand,
       p_retailprice AS price,
       cast(NULL AS double) AS empty, 1 AS one
FROM {part}
"""
P_SQL = duck(PARTS)


def _parts(spark, d):
    return derived(spark, d, PARTS)


@query(
    "feature_spec",
    f"""
WITH p AS ({P_SQL})
SELECT c AS "column", CASE
    WHEN n = 0 OR k <= 1 THEN 'dropped'
    WHEN number THEN 'numeric'
    WHEN k > 50 THEN 'dropped' ELSE 'categorical' END AS role
FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS c, count({c}) AS n, count(DISTINCT {c}) AS k, {number} AS number FROM p"
        for c, number in [
            ("p_name", "false"),
            ("p_type", "false"),
            ("large", "true"),
            ("size", "true"),
            ("brand", "false"),
            ("price", "true"),
            ("empty", "true"),
            ("one", "true"),
        ]
    )
    + ")",
)
def feature_spec(spark, d):
    return X.spec_table(spark, X.feature_spec(_parts(spark, d), exclude=["p_partkey"]))


def _fitted(df, **options):
    return X.fit_preprocessor(df, exclude=["p_partkey"], **options)


def _rounded(df, keep):
    return df.select(*[F.col(f"`{c}`") if c in keep else F.round(F.col(f"`{c}`"), 6).alias(c) for c in df.columns])


def _sizes(spark, d, **options):
    df = _parts(spark, d).select("p_partkey", "size", "price")
    return _rounded(_fitted(df, **options).transform(df, keep=["p_partkey"]), ["p_partkey"])


_FILLED = f"""
WITH p AS ({P_SQL}),
f AS (SELECT p_partkey, coalesce(cast(size AS double), (SELECT quantile_cont(cast(size AS double), 0.5) FROM p)) AS size,
             price FROM p)
"""


@query("feat_impute_median", _FILLED + "SELECT p_partkey, size, round(price, 6) AS price FROM f")
def feat_impute_median(spark, d):
    return _sizes(spark, d, scale_numerical=False)


def _scaled(shift, scale):
    cells = ", ".join(
        f"round(({c} - (SELECT {shift.format(c=c)} FROM f)) / (SELECT {scale.format(c=c)} FROM f), 6) AS {c}"
        for c in ("size", "price")
    )
    return _FILLED + f"SELECT p_partkey, {cells} FROM f"


@query("feat_scale_standard", _scaled("avg({c})", "stddev_pop({c})"))
def feat_scale_standard(spark, d):
    return _sizes(spark, d)


@query("feat_scale_minmax", _scaled("min({c})", "max({c}) - min({c})"))
def feat_scale_minmax(spark, d):
    return _sizes(spark, d, scaler="minmax")


@query(
    "feat_scale_robust",
    _scaled("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
)
def feat_scale_robust(spark, d):
    return _sizes(spark, d, scaler="robust")


_SEGMENTS = "SELECT c_custkey, segment FROM (" + duck(DIRTY_CUSTOMER) + ")"
_MODE = "(SELECT segment FROM d WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)"
_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "feat_impute_mode",
    f"""
WITH d AS ({_SEGMENTS}), l AS (SELECT DISTINCT segment FROM d WHERE segment IS NOT NULL),
k AS (SELECT segment, cast(row_number() OVER (ORDER BY segment) - 1 AS double) AS code FROM l)
SELECT c_custkey, k.code AS segment FROM (SELECT c_custkey, coalesce(segment, {_MODE}) AS segment FROM d) f
JOIN k ON k.segment = f.segment""",
)
def feat_impute_mode(spark, d):
    df = derived(spark, d, DIRTY_CUSTOMER).select("c_custkey", "segment")
    model = X.fit_preprocessor(df, exclude=["c_custkey"], categorical_encoding="ordinal")
    return model.transform(df, keep=["c_custkey"])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _flags(levels):
    return ", ".join(
        f"CASE WHEN o_orderpriority = '{v}' THEN 1.0e0 ELSE 0.0e0 END AS \"o_orderpriority_{v}\"" for v in levels
    )


def _priorities(spark, d, known=None, **options):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    fit = df.where(known) if known else df
    return X.fit_preprocessor(fit, exclude=["o_orderkey"], **options).transform(df, keep=["o_orderkey"])


@query("feat_onehot", f"SELECT o_orderkey, {_flags(_PRIORITIES)} FROM orders")
def feat_onehot(spark, d):
    return _priorities(spark, d)


@query("feat_onehot_unknown", f"SELECT o_orderkey, {_flags(_PRIORITIES[1:])} FROM orders")
def feat_onehot_unknown(spark, d):
    return _priorities(spark, d, "o_orderpriority <> '1-URGENT'")


@query(
    "feat_ordinal",
    "SELECT o_orderkey, CASE o_orderpriority WHEN '2-HIGH' THEN 0.0e0 WHEN '3-MEDIUM' THEN 1.0e0 "
    "WHEN '4-NOT SPECIFIED' THEN 2.0e0 WHEN '5-LOW' THEN 3.0e0 ELSE -1.0e0 END AS o_orderpriority FROM orders",
)
def feat_ordinal(spark, d):
    return _priorities(spark, d, "o_orderpriority <> '1-URGENT'", categorical_encoding="ordinal")


_MATRIX = """
WITH o AS (SELECT * FROM orders), fit AS (SELECT * FROM orders WHERE {fit}),
s AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1,
             avg(o_custkey) AS m2, stddev_pop(o_custkey) AS s2 FROM fit)
SELECT o_orderkey, round((o_custkey - m2) / s2, 6) AS o_custkey, round((o_totalprice - m1) / s1, 6) AS o_totalprice,
       CASE WHEN o_orderstatus = 'F' THEN 1.0e0 ELSE 0.0e0 END AS "o_orderstatus_F",
       CASE WHEN o_orderstatus = 'O' THEN 1.0e0 ELSE 0.0e0 END AS "o_orderstatus_O",
       CASE WHEN o_orderstatus = 'P' THEN 1.0e0 ELSE 0.0e0 END AS "o_orderstatus_P",
       {flags}
FROM o, s
"""


def _matrix(spark, d, known=None):
    df = table(spark, d, "orders")
    fit = df.where(known) if known else df
    model = X.fit_preprocessor(fit, exclude=["o_orderkey"])
    return _rounded(model.transform(df, keep=["o_orderkey"]), ["o_orderkey"])


@query("feature_matrix", _MATRIX.replace("{fit}", "true").replace("{flags}", _flags(_PRIORITIES)))
def feature_matrix(spark, d):
    return _matrix(spark, d)


@query("feature_build", _MATRIX.replace("{fit}", "true").replace("{flags}", "o_orderpriority"))
def feature_build(spark, d):
    """The matrix of a whole dataset with its target, by a preprocessor that was stored and read again; both are written."""
    df = table(spark, d, "orders")
    fitted = X.fit_preprocessor(df, exclude=["o_orderkey", "o_orderpriority"])
    path = scratch_path(spark, "preprocessor")
    fitted.save(spark, path)
    kept = ["o_orderkey", "o_orderpriority"]
    matrix = X.PreprocessorModel.load(spark, path).transform(df, keep=kept)
    return load_table(spark, save_table(_rounded(matrix, kept), scratch_path(spark, "matrix"), "parquet"), "parquet")


@query(
    "feature_transform_holdout",
    _MATRIX.replace("{fit}", "o_orderpriority <> '1-URGENT'").replace("{flags}", _flags(_PRIORITIES[1:])),
)
def feature_transform_holdout(spark, d):
    return _matrix(spark, d, "o_orderpriority <> '1-URGENT'")


# --------------------------------------------------------------------------- splits and folds
_RANK = "row_number() OVER ({by}ORDER BY md5(concat(length(cast(o_orderkey AS varchar)), ':', cast(o_orderkey AS varchar), '-', '42')))"
_WHOLE_RANK = _RANK.replace("{by}", "")
_CLASS_RANK = _RANK.replace("{by}", "PARTITION BY o_orderstatus ")


@query(
    "split_random",
    f"""
WITH r AS (SELECT o_orderkey, {_WHOLE_RANK} AS rn, count(*) OVER () AS n FROM orders),
c AS (SELECT *, ceil(n / 5) AS t, ceil((n - ceil(n / 5)) / 8) AS v FROM r)
SELECT o_orderkey, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + v THEN 'validation' ELSE 'train' END AS split FROM c""",
)
def split_random(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return S.split(df, key=["o_orderkey"]).drop("o_orderstatus")


@query("split_sink", ORACLES["split_random"])
def split_sink(spark, d):
    """The parts written as files, a folder each, and read back."""
    path = save_splits(split_random(spark, d), scratch_path(spark, "parts"))
    return spark.read.parquet(path).select("o_orderkey", "split")


def _allocated(count, part, name, source):
    share = f"{count} * {part} / sum({count}) OVER ()"
    return f"""
{name}0 AS (SELECT *, floor({share}) AS fl, round({share} - floor({share}), 9) AS fr FROM {source}),
{name} AS (SELECT * EXCLUDE (fl, fr),
    fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, o_orderstatus) <= {part} - sum(fl) OVER () THEN 1 ELSE 0 END AS {name}_n
    FROM {name}0)"""


@query(
    "split_stratified",
    f"""
WITH g AS (SELECT o_orderstatus, cast(count(*) AS double) AS n FROM orders GROUP BY 1),
h AS (SELECT *, ceil(sum(n) OVER () / 5) AS part FROM g), {_allocated('n', 'part', 't', 'h')},
w AS (SELECT *, n - t_n AS rest, ceil((sum(n) OVER () - part) / 8) AS vpart FROM t), {_allocated('rest', 'vpart', 'v', 'w')},
r AS (SELECT o_orderkey, o_orderstatus, {_CLASS_RANK} AS rn FROM orders)
SELECT o_orderkey, r.o_orderstatus,
       CASE WHEN rn <= t_n THEN 'test' WHEN rn <= t_n + v_n THEN 'validation' ELSE 'train' END AS split
FROM r JOIN v ON v.o_orderstatus = r.o_orderstatus""",
)
def split_stratified(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return S.split(df, stratify="o_orderstatus", key=["o_orderkey"])


@query(
    "holdout_split",
    f"""
WITH g AS (SELECT o_orderstatus, cast(count(*) AS double) AS n FROM orders GROUP BY 1),
h AS (SELECT *, ceil(sum(n) OVER () / 10) AS part FROM g), {_allocated('n', 'part', 't', 'h')},
r AS (SELECT o_orderkey, o_orderstatus, {_CLASS_RANK} AS rn FROM orders)
SELECT o_orderkey, r.o_orderstatus, CASE WHEN rn <= t_n THEN 'validation' ELSE 'train' END AS split
FROM r JOIN t ON t.o_orderstatus = r.o_orderstatus""",
)
def holdout_split(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return S.holdout(df, stratify="o_orderstatus", key=["o_orderkey"])


_KEY_DIGEST = "md5(concat(length(cast(user_id AS varchar)), ':', cast(user_id AS varchar), '-42'))"


@query(
    "holdout_repeated_ids",
    f"""
WITH e AS (SELECT event_id, user_id, {_KEY_DIGEST} AS h FROM events),
r AS (SELECT event_id, user_id, count(*) OVER () AS n, row_number() OVER (ORDER BY h, md5(concat(
    length(cast(event_id AS varchar)), ':', cast(event_id AS varchar), '-', length(cast(user_id AS varchar)), ':', cast(user_id AS varchar),
    '-34:0:', h, '-1:0-42'))) AS rn FROM e)
SELECT event_id, user_id, CASE WHEN rn <= ceil(n / 10) THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def holdout_repeated_ids(spark, d):
    """Users have many events each; the part of exact size ends among those of one user."""
    return S.holdout(table(spark, d, "events").select("event_id", "user_id"), key=["user_id"])


@query(
    "kfold_assign",
    f"""
WITH r AS (SELECT o_orderkey, {_WHOLE_RANK} AS rn, count(*) OVER () AS n FROM orders),
k AS (SELECT *, n // 5 AS q, n % 5 AS x FROM r)
SELECT o_orderkey, cast(CASE WHEN rn <= x * (q + 1) THEN (rn - 1) // (q + 1)
    ELSE x + (rn - 1 - x * (q + 1)) // q END AS integer) AS fold FROM k""",
)
def kfold_assign(spark, d):
    df = table(spark, d, "orders").select("o_orderkey")
    return S.kfold(df, key=["o_orderkey"])


@query(
    "stratified_kfold_assign",
    f"""
WITH g AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM g),
p AS (SELECT o_orderstatus, (start + range) % 5 AS fold FROM s, range((SELECT max(n) FROM g)) WHERE range < n),
f AS (SELECT o_orderstatus, fold, count(*) AS m FROM p GROUP BY 1, 2),
e AS (SELECT *, sum(m) OVER (PARTITION BY o_orderstatus ORDER BY fold) AS upto FROM f),
r AS (SELECT o_orderkey, o_orderstatus, {_CLASS_RANK} AS rn FROM orders)
SELECT o_orderkey, r.o_orderstatus, cast(e.fold AS integer) AS fold
FROM r JOIN e ON e.o_orderstatus = r.o_orderstatus AND rn <= upto AND rn > upto - m""",
)
def stratified_kfold_assign(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return S.kfold(df, stratify="o_orderstatus", key=["o_orderkey"])
