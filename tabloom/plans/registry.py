"""Model names, their default parameters, and the MLlib estimators behind them."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

from tabloom.errors import ModelError

# Default parameters per model.
MODEL_DEFAULTS = {
    "logistic_regression": {"C": 1.0, "max_iter": 1000},
    "ridge": {"alpha": 1.0},
    "random_forest": {"n_estimators": 200, "max_depth": None, "min_samples_leaf": 1},
    "gradient_boosting": {"n_estimators": 200, "learning_rate": 0.1, "max_depth": 3, "subsample": 1.0},
}
# What a model takes besides, and the tasks it is for.
_EXTRA = {
    "logistic_regression": ("fit_intercept", "tol", "random_state"),
    "ridge": ("fit_intercept", "random_state"),
    "random_forest": ("max_features", "max_bins", "random_state"),
    "gradient_boosting": ("min_samples_leaf", "max_features", "max_bins", "random_state"),
}
_TASKS = {
    "logistic_regression": ("classification",),
    "ridge": ("regression",),
    "random_forest": ("classification", "regression"),
    "gradient_boosting": ("classification", "regression"),
}
# A tree of unlimited depth grows with the data; MLlib allows 30 levels and rejects 31.
DEEPEST_TREE = 30


def available_models(task: str | None = None) -> list[str]:
    """Names of all models, or of those for a task."""
    return [name for name, tasks in _TASKS.items() if task is None or task in tasks]


def model_defaults(algorithm: str) -> dict:
    if algorithm in MODEL_DEFAULTS:
        return MODEL_DEFAULTS[algorithm].copy()
    raise ModelError(f"'{algorithm}' is no model; choose from {', '.join(available_models())}.")


@dataclass
class ModelPlan:
    """A checked choice of algorithm and parameters; estimators are built per fit.

    Regularisation depends on the number of rows, so it is set when the fit frame is known, and so is
    ``memory_mb``, what one pass of a forest may take for the statistics of its nodes.
    """

    algorithm: str
    task: str
    params: dict = field(default_factory=dict)

    def estimator(self, *, rows: int, label_std: float = 1.0, classes: int = 2, seed: int = 42, memory_mb: int = 256):
        p = self.params
        seed = p.get("random_state", seed)
        if self.algorithm == "logistic_regression":
            return LogisticRegression(
                regParam=1.0 / (p["C"] * max(rows, 1)),
                elasticNetParam=0.0,
                standardization=False,
                maxIter=p["max_iter"],
                tol=p.get("tol", 1e-6),
                fitIntercept=p.get("fit_intercept", True),
                family="multinomial" if classes > 2 else "binomial",
            )
        if self.algorithm == "ridge":
            # MLlib scales the label by its standard deviation before penalising.
            return LinearRegression(
                regParam=p["alpha"] * label_std / max(rows, 1),
                elasticNetParam=0.0,
                standardization=False,
                solver="normal",
                fitIntercept=p.get("fit_intercept", True),
            )
        depth = p.get("max_depth")
        common = {
            "maxDepth": DEEPEST_TREE if depth is None else depth,
            "minInstancesPerNode": p.get("min_samples_leaf", 1),
            "maxBins": p.get("max_bins", 32),
            "seed": seed,
        }
        classify = self.task == "classification"
        if self.algorithm == "random_forest":
            # Deep trees: rows remember the node they are in instead of going down every tree again at each
            # level, and the nodes of a level are worked on in as few passes as memory allows.
            common |= {
                "cacheNodeIds": True,
                "checkpointInterval": 10,
                "maxMemoryInMB": memory_mb,
                "numTrees": p["n_estimators"],
                "featureSubsetStrategy": str(p.get("max_features") or ("sqrt" if classify else "all")),
            }
            return RandomForestClassifier(**common) if classify else RandomForestRegressor(**common)
        common |= {
            "maxIter": p["n_estimators"],
            "stepSize": p["learning_rate"],
            "subsamplingRate": p["subsample"],
            "featureSubsetStrategy": str(p.get("max_features") or "all"),
            "checkpointInterval": 10,
        }
        return GBTClassifier(**common) if classify else GBTRegressor(**common)


def create_model(algorithm: str, task: str, params: dict | None = None) -> ModelPlan:
    """A plan with the model's defaults under ``params``.

    Parameters that the model has no use for are left out with a warning, and a tree deeper than MLlib
    can grow is refused.
    """
    defaults, given = model_defaults(algorithm), params or {}
    if task not in _TASKS[algorithm]:
        others = available_models(task)
        hint = f"models for it are {', '.join(others)}" if others else "tasks are classification and regression"
        raise ModelError(f"{algorithm} cannot be trained for '{task}'; {hint}.")
    usable = {k: v for k, v in given.items() if k in defaults or k in _EXTRA[algorithm]}
    if len(usable) < len(given):
        warnings.warn(f"{algorithm} has no use for {', '.join(sorted(set(given) - set(usable)))}", stacklevel=2)
    if (usable.get("max_depth") or 0) > DEEPEST_TREE:
        raise ModelError(f"max_depth is {usable['max_depth']}, but trees have at most {DEEPEST_TREE} levels.")
    return ModelPlan(algorithm, task, defaults | usable)
