"""Reusable feature preprocessing: fit on one frame, apply to any other.

Fitting is at most four aggregates over the fit frame and yields plain parameters; applying is
one projection. Two forms come out of the same parameters: flat columns, and one vector column
for estimators, whose plan does not grow with the number of category levels.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.errors import ConfigError, DataError
from tabloom.functions.columns import col, is_numeric, require_flat
from tabloom.functions.longform import value_counts
from tabloom.functions.quantiles import quantiles

SCALERS = ("standard", "minmax", "robust")
ENCODINGS = ("onehot", "ordinal")
UNKNOWN = ("ignore", "error")
MAX_CATEGORIES = 50


@dataclass
class FeatureSpec:
    """Columns by use, in schema order; dropped ones are all missing, constant or too varied."""

    numeric_columns: list[str]
    categorical_columns: list[str]
    dropped_columns: list[str] = field(default_factory=list)

    @property
    def feature_columns(self) -> list[str]:
        return self.numeric_columns + self.categorical_columns


@dataclass
class _Profile:
    spec: FeatureSpec
    rows: int
    numbers: dict[str, dict[str, float]]
    levels: dict[str, list[str]]
    modes: dict[str, str]
    wide: list[str]


def _profile(df: DataFrame, exclude: list[str] | None, max_categories: int) -> _Profile:
    """One aggregate for all columns, then one value count of the columns with few values."""
    require_flat(df.drop(*(exclude or [])))
    fields = [f for f in df.schema if f.name not in (exclude or [])]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = col(f.name)
        numeric = is_numeric(f.dataType, include_boolean=True)
        v = c.cast("double") if numeric else c
        aggs += [F.count(c).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        if numeric:
            aggs += [F.avg(v).alias(f"a{i}"), F.stddev_pop(v).alias(f"s{i}")]
        else:
            aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
    row = df.agg(*aggs).first()
    numbers: dict[str, dict[str, float]] = {}
    candidates: list[str] = []
    usable = set()
    for i, f in enumerate(fields):
        if row[f"n{i}"] == 0 or row[f"lo{i}"] == row[f"hi{i}"]:
            continue
        if is_numeric(f.dataType, include_boolean=True):
            numbers[f.name] = {
                "count": row[f"n{i}"],
                "min": row[f"lo{i}"],
                "max": row[f"hi{i}"],
                "mean": row[f"a{i}"],
                "std": row[f"s{i}"],
            }
            usable.add(f.name)
        elif row[f"d{i}"] <= 2 * max_categories + 20:
            # The sketch is far within a factor of two here; exact levels are counted below.
            candidates.append(f.name)
    found: dict[str, list[tuple[object, str, int]]] = {c: [] for c in candidates}
    for frame in value_counts(df, candidates).values() if candidates else []:
        for r in frame.select("column", "value", F.col("value").cast("string").alias("text"), "n").collect():
            found[r["column"]].append((r["value"], r["text"], r["n"]))
    levels, modes = {}, {}
    for c, seen in found.items():
        if len(seen) > max_categories:
            continue
        usable.add(c)
        levels[c] = [text for _, text, _ in sorted(seen, key=lambda t: t[0])]
        top = max(n for *_, n in seen)
        modes[c] = min((v, text) for v, text, n in seen if n == top)[1]
    spec = FeatureSpec(
        numeric_columns=[f.name for f in fields if f.name in numbers],
        categorical_columns=[f.name for f in fields if f.name in levels],
        dropped_columns=[f.name for f in fields if f.name not in usable],
    )
    several = [f.name for i, f in enumerate(fields) if row[f"n{i}"] and row[f"lo{i}"] != row[f"hi{i}"]]
    wide = [c for c in several if c not in numbers and c not in levels]
    return _Profile(spec, row["rows"], numbers, levels, modes, wide)


def feature_spec(
    df: DataFrame, *, exclude: list[str] | None = None, max_categories: int = MAX_CATEGORIES
) -> FeatureSpec:
    """Numeric (with booleans), categorical and unusable columns of a frame."""
    return _profile(df, exclude, max_categories).spec


def spec_table(spark, spec: FeatureSpec) -> DataFrame:
    return spark.createDataFrame(
        [(c, "numeric") for c in spec.numeric_columns]
        + [(c, "categorical") for c in spec.categorical_columns]
        + [(c, "dropped") for c in spec.dropped_columns],
        "column string, role string",
    )


@dataclass
class PreprocessorModel:
    """Fitted parameters. ``shift``/``scale`` map a value x to (x - shift) / scale."""

    spec: FeatureSpec
    encoding: str
    unknown: str
    median: dict[str, float]
    shift: dict[str, float]
    scale: dict[str, float]
    mode: dict[str, str]
    levels: dict[str, list[str]]
    rows: int = 0  # fitted on

    # ------------------------------------------------------------------ names
    @property
    def feature_names(self) -> list[str]:
        names = list(self.spec.numeric_columns)
        for c in self.spec.categorical_columns:
            names += [f"{c}_{v}" for v in self.levels[c]] if self.encoding == "onehot" else [c]
        return names

    # ------------------------------------------------------------ expressions
    def _number(self, c: str) -> Column:
        v = F.coalesce(col(c).cast("double"), F.lit(self.median[c]))
        if c in self.shift:
            v = (v - F.lit(self.shift[c])) / F.lit(self.scale[c])
        return v

    def _category(self, c: str) -> Column:
        v = F.coalesce(col(c).cast("string"), F.lit(self.mode[c]))
        if self.unknown == "error":
            known = v.isin(self.levels[c])
            text = F.concat(F.lit(f"Unknown category in column '{c}': "), v)
            v = F.when(known, v).otherwise(F.raise_error(text))
        return v

    def _code(self, c: str) -> Column:
        """Position of the category among the sorted levels, -1 when unknown."""
        levels = F.array(*[F.lit(v) for v in self.levels[c]])
        return (F.array_position(levels, self._category(c)) - 1).cast("double")

    # -------------------------------------------------------------- transform
    def transform(self, df: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
        """Flat feature columns, numeric block first, after the columns to ``keep``."""
        out = [col(c) for c in keep or []]
        out += [self._number(c).alias(c) for c in self.spec.numeric_columns]
        for c in self.spec.categorical_columns:
            if self.encoding == "ordinal":
                out.append(self._code(c).alias(c))
            else:
                v = self._category(c)
                out += [
                    (v == F.lit(level)).cast("double").alias(f"{c}_{level}") for level in self.levels[c]
                ]
        return df.select(*out)

    def with_vector(self, df: DataFrame, output: str = "features") -> DataFrame:
        """The same features as one vector column beside the input columns.

        One-hot blocks hold the place of their level alone, and the vector is sparse wherever that is
        smaller, so a row costs one entry a column however many levels there are.
        """
        name = lambda kind, i: f"{output}~{kind}{i}"
        numbers = [self._number(c).alias(name("n", i)) for i, c in enumerate(self.spec.numeric_columns)]
        codes, blocks = [], []
        for i, c in enumerate(self.spec.categorical_columns):
            code = self._code(c)
            if self.encoding == "onehot":
                # One more level stands for unknown values. It is the last, which the encoder leaves out;
                # that the number of levels is declared saves it a scan.
                size = len(self.levels[c])
                declared = {"ml_attr": {"type": "nominal", "num_vals": size + 1, "name": name("c", i)}}
                code = F.when(code < 0, float(size)).otherwise(code).alias(name("c", i), metadata=declared)
                blocks.append(name("h", i))
            else:
                code = code.alias(name("c", i))
            codes.append(code)
        wide = df.select("*", *numbers, *codes)
        coded = [name("c", i) for i in range(len(codes))]
        if blocks:
            encoder = OneHotEncoder(inputCols=coded, outputCols=blocks, dropLast=True, handleInvalid="error")
            wide = encoder.fit(wide).transform(wide)
        inputs = [name("n", i) for i in range(len(numbers))] + (blocks or coded)
        out = VectorAssembler(inputCols=inputs, outputCol=output).transform(wide)
        # The estimators need no names of places; without them plans stay short.
        return out.select(*[col(c) for c in df.columns if c != output], col(output).alias(output, metadata={}))


    # ------------------------------------------------------------ persistence
    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "PreprocessorModel":
        data = json.loads(text)
        data["spec"] = FeatureSpec(**data["spec"])
        return cls(**data)

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "params string").write.mode("errorifexists").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "PreprocessorModel":
        return cls.from_json(spark.read.parquet(path).first()["params"])


def fit_preprocessor(
    df: DataFrame,
    spec: FeatureSpec | None = None,
    *,
    exclude: list[str] | None = None,
    max_categories: int = MAX_CATEGORIES,
    scale_numerical: bool = True,
    scaler: str = "standard",
    categorical_encoding: str = "onehot",
    handle_unknown: str = "ignore",
    exact: bool = True,
    max_given_levels: int = 10_000,
) -> PreprocessorModel:
    """Fit imputers, scaler and encoder on a frame.

    Levels become part of the fitted step: ``max_categories`` leaves out columns with more, and with a
    given ``spec`` a column with more than ``max_given_levels`` is refused.
    """
    if scaler not in SCALERS:
        raise ConfigError(f"scaler '{scaler}' is none of {', '.join(SCALERS)}.")
    if categorical_encoding not in ENCODINGS:
        raise ConfigError(f"categorical_encoding '{categorical_encoding}' is none of {', '.join(ENCODINGS)}.")
    if handle_unknown not in UNKNOWN:
        raise ConfigError(f"handle_unknown '{handle_unknown}' is none of {', '.join(UNKNOWN)}.")

    if spec is None:
        facts = _profile(df, exclude, max_categories)
        spec = facts.spec
    else:
        facts = _profile(df.select(*[col(c) for c in spec.feature_columns]), None, max_given_levels)
        if wide := [c for c in spec.categorical_columns if c in facts.wide]:
            raise DataError(f"Columns {', '.join(wide)} have more than {max_given_levels} levels to encode.")
    numeric = [c for c in spec.numeric_columns if c in facts.numbers]
    counts = {c: facts.numbers[c]["count"] for c in numeric}
    median = {c: v[0] for c, v in quantiles(df, numeric, [0.5], counts=counts, exact=exact).items()}

    shift: dict[str, float] = {}
    scale: dict[str, float] = {}
    if scale_numerical and scaler == "robust":
        filled = df.select(
            *[F.coalesce(col(c).cast("double"), F.lit(median[c])).alias(c) for c in numeric]
        )
        full = {c: facts.rows for c in numeric}
        for c, (q1, q2, q3) in quantiles(filled, numeric, [0.25, 0.5, 0.75], counts=full, exact=exact).items():
            shift[c], scale[c] = q2, (q3 - q1) or 1.0
    elif scale_numerical:
        for c in numeric:
            f = facts.numbers[c]
            if scaler == "minmax":
                shift[c], scale[c] = f["min"], (f["max"] - f["min"]) or 1.0
            else:
                # Moments after imputation follow from those before: no further scan.
                n, holes = f["count"], facts.rows - f["count"]
                mean = (n * f["mean"] + holes * median[c]) / facts.rows
                square = n * (f["std"] ** 2 + (f["mean"] - mean) ** 2) + holes * (median[c] - mean) ** 2
                shift[c], scale[c] = mean, math.sqrt(square / facts.rows) or 1.0
    return PreprocessorModel(
        spec=FeatureSpec(numeric, [c for c in spec.categorical_columns if c in facts.levels], list(spec.dropped_columns)),
        encoding=categorical_encoding,
        unknown=handle_unknown,
        median=median,
        shift=shift,
        scale=scale,
        mode=facts.modes,
        levels=facts.levels,
        rows=facts.rows,
    )
