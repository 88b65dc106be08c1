"""Scores of ridge folds from sums of products, against fitting and scoring every fold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabloom.functions.storage import staged
from tabloom.operators.split import kfold
from tabloom.plans import training as T
from tabloom.plans.registry import create_model


@pytest.fixture(scope="module")
def folded(spark, prices):
    """Prices with missing cells of both kinds, a level that one fold alone has, and a column that is constant without it."""
    df = kfold(prices, folds=3, key=["customer_id"])
    odd = df.withColumn("rare", F.when(F.col("fold") == 0, F.when(F.col("tenure") > 5, "only here").otherwise("a")).otherwise("a"))
    odd = odd.withColumn("still", F.when(F.col("fold") == 1, F.col("tenure").cast("double")).otherwise(3.0))
    odd = odd.withColumn("several", F.when(F.col("tenure") % 4 > 0, F.concat(F.lit("k"), (F.col("tenure") % 7).cast("string"))))
    return staged(odd, "folded")


@pytest.mark.parametrize("scoring, options", [("r2", {}), ("neg_mean_squared_error", {}), ("neg_root_mean_squared_error", {"scaler": "minmax"}), ("r2", {"scale_numerical": False})])
def test_against_fitting_every_fold(folded, prices, monkeypatch, scoring, options):
    target = "price" if "price" in prices.columns else prices.columns[-1]
    plan = create_model("ridge", "regression", {"alpha": 2.5})
    same = dict(fold="fold", scoring=scoring, exclude=["customer_id"], **options)
    quick = T.cross_validate(folded, target, plan, **same)
    monkeypatch.setattr(T, "ridge_scores", lambda *a, **k: None)
    slow = T.cross_validate(folded, target, plan, **same)
    assert len(quick) == 3 and quick == pytest.approx(slow, rel=2e-4, abs=1e-4)


def test_what_does_not_follow_from_sums_is_left_to_fitting(folded, prices):
    target = "price" if "price" in prices.columns else prices.columns[-1]
    for options in ({"scoring": "neg_mean_absolute_error"}, {"scoring": "r2", "scaler": "robust"}, {"scoring": "r2", "categorical_encoding": "ordinal"}):
        assert T.ridge_scores(folded, target, 1.0, fold="fold", exclude=["customer_id"], **options) is None
