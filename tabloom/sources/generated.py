"""Generated customer data with a churn or price target.

Every value is a function of (seed, column, row id) through a digest, so the result does not
depend on partitioning and a lost task rebuilds the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.errors import DataError
from tabloom.functions.columns import col

MIN_ROWS = 50

# Categories with their cumulative shares, and the weights of both targets.
GENDERS = [("Male", 0.5), ("Female", 1.0)]
CONTRACTS = [("Month-to-month", 0.55), ("One year", 0.80), ("Two year", 1.0)]
PAYMENTS = [("Credit card", 0.25), ("Bank transfer", 0.5), ("Electronic check", 0.75), ("Mailed check", 1.0)]
CHURN = {
    "tenure": -0.08,
    "monthly_charges": 0.02,
    "support_calls": 0.35,
    "month_to_month": 0.5,
    "two_year": -1.0,
    "male": 0.3,
    "base": -1.5,
    "noise": 0.6,
}
PRICE = {
    "base": 5000.0,
    "tenure": 120.0,
    "monthly_charges": 15.0,
    "support_calls": 40.0,
    "income": 0.02,
    "one_year": 300.0,
    "two_year": -200.0,
    "noise": 800.0,
}
MISSING = {"monthly_charges": 0.03, "support_calls": 0.02}


def uniform(id_column: str, name: str, seed: int) -> Column:
    """A number in (0, 1) from 48 bits of a digest."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(name), col(id_column).cast("string")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def normal(id_column: str, name: str, seed: int) -> Column:
    """Standard normal by the Box-Muller transform."""
    u = uniform(id_column, name + "/r", seed)
    v = uniform(id_column, name + "/a", seed)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def _whole(u: Column, low: int, high: int) -> Column:
    """Integer from low to high - 1."""
    return (F.floor(u * (high - low)) + low).cast("int")


def _choice(u: Column, options: list[tuple[str, float]]) -> Column:
    expr = F.when(u < options[0][1], options[0][0])
    for name, upto in options[1:-1]:
        expr = expr.when(u < upto, name)
    return expr.otherwise(options[-1][0])


def customers_for(ids: DataFrame, id_column: str, *, task: str = "classification", seed: int = 42) -> DataFrame:
    """One generated customer per id, ``id_column`` counting from 1 being shown as CUST-00001."""
    if task not in ("classification", "regression"):
        raise DataError("The task of generated data is 'classification' or 'regression'.")

    def u(name: str) -> Column:
        return uniform(id_column, name, seed)

    def noise(name: str) -> Column:
        return normal(id_column, name, seed)

    income = F.round(60000 + 25000 * noise("income"), 0)
    base = ids.select(
        col(id_column).alias("_id"),
        F.format_string("CUST-%05d", col(id_column)).alias("customer_id"),
        _whole(u("tenure"), 1, 73).alias("tenure"),
        F.round(20 + 100 * u("monthly_charges"), 2).alias("monthly_charges"),
        _whole(u("age"), 18, 82).alias("age"),
        _whole(u("support_calls"), 0, 10).cast("double").alias("support_calls"),
        F.least(F.greatest(income, F.lit(15000.0)), F.lit(250000.0)).alias("income"),
        _choice(u("gender"), GENDERS).alias("gender"),
        _choice(u("contract"), CONTRACTS).alias("contract"),
        _choice(u("payment_method"), PAYMENTS).alias("payment_method"),
        noise("target").alias("_noise"),
        u("churn").alias("_draw"),
        *[(u(f"missing/{c}") < share).alias(f"_hole_{c}") for c, share in MISSING.items()],
    )

    def flag(test: Column) -> Column:
        return test.cast("double")

    if task == "classification":
        w = CHURN
        logit = (
            w["tenure"] * F.col("tenure")
            + w["monthly_charges"] * F.col("monthly_charges")
            + w["support_calls"] * F.col("support_calls")
            + w["month_to_month"] * flag(F.col("contract") == "Month-to-month")
            + w["two_year"] * flag(F.col("contract") == "Two year")
            + w["male"] * flag(F.col("gender") == "Male")
            + w["base"]
            + w["noise"] * F.col("_noise")
        )
        target = (F.col("_draw") < 1 / (1 + F.exp(-logit))).cast("int").alias("churn")
    else:
        w = PRICE
        price = (
            w["base"]
            + w["tenure"] * F.col("tenure")
            + w["monthly_charges"] * F.col("monthly_charges")
            + w["support_calls"] * F.col("support_calls")
            + w["income"] * F.col("income")
            + w["one_year"] * flag(F.col("contract") == "One year")
            + w["two_year"] * flag(F.col("contract") == "Two year")
            + w["noise"] * F.col("_noise")
        )
        target = F.greatest(F.round(price, 0), F.lit(0.0)).alias("price")

    def holed(name: str) -> Column:
        return F.when(~F.col(f"_hole_{name}"), F.col(name)).alias(name)

    return base.select(
        "customer_id",
        "tenure",
        holed("monthly_charges"),
        "age",
        holed("support_calls"),
        "income",
        "gender",
        "contract",
        "payment_method",
        target,
    )


def generate_customers(
    spark: SparkSession, rows: int = 2000, *, task: str = "classification", seed: int = 42
) -> DataFrame:
    if rows < MIN_ROWS:
        raise DataError(f"Generated data needs at least {MIN_ROWS} rows.")
    return customers_for(spark.range(1, rows + 1), "id", task=task, seed=seed)
