"""Sparse count-matrix analytics on Spark DataFrames."""

from cellweave.model import Experiment
from cellweave.session import get_spark

__all__ = ["Experiment", "get_spark"]
