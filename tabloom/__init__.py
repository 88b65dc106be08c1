"""Tabular data-science workflows on Spark: load, profile, validate, clean, split, train, report."""

from tabloom.operators.clean import CleanerModel, clean_dataframe, fit_cleaner
from tabloom.operators.features import FeatureSpec, PreprocessorModel, feature_spec, fit_preprocessor
from tabloom.operators.metrics import compute_metrics
from tabloom.operators.profile import column_profile, dataset_summary, numeric_describe
from tabloom.operators.split import holdout, kfold, split
from tabloom.operators.validate import infer_task, validate
from tabloom.plans.registry import available_models, create_model
from tabloom.plans.report import eda_tables, evaluation_tables, report_rows
from tabloom.plans.runs import RunTable, record_training
from tabloom.plans.training import (
    compare_models,
    evaluate,
    load_model,
    predict,
    save_model,
    train_model,
)
from tabloom.sources.generated import generate_customers
from tabloom.sources.tables import load_table, save_table
from tabloom.streaming.apply import apply_to_stream

__all__ = [
    "CleanerModel",
    "FeatureSpec",
    "PreprocessorModel",
    "RunTable",
    "apply_to_stream",
    "available_models",
    "clean_dataframe",
    "column_profile",
    "compare_models",
    "compute_metrics",
    "create_model",
    "dataset_summary",
    "eda_tables",
    "evaluate",
    "evaluation_tables",
    "feature_spec",
    "fit_cleaner",
    "fit_preprocessor",
    "generate_customers",
    "holdout",
    "infer_task",
    "kfold",
    "load_model",
    "load_table",
    "numeric_describe",
    "predict",
    "record_training",
    "report_rows",
    "save_model",
    "save_table",
    "split",
    "train_model",
    "validate",
]
