"""All registered queries and their SQL counterparts."""

from tabloom.catalog import cleaning, evaluation, features, modelling, profiling, storage  # noqa: F401
from tabloom.catalog.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
