"""Imports every query module, so that all queries are registered."""

from codonlake.plans import (queries_core, queries_features, queries_grading, queries_io, queries_lists, queries_ml)  # noqa: F401
from codonlake.plans.suite import ORACLE, QUERIES  # noqa: F401
