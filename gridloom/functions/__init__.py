"""Aggregate expressions with explicit rules for missing values."""

from gridloom.functions.missing import max_of, mean_of, min_of, row_mean_of, row_sum_of, sum_of

__all__ = ["max_of", "mean_of", "min_of", "row_mean_of", "row_sum_of", "sum_of"]
