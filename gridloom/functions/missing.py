"""Missing values: NULL is missing, NaN is a number that is none.

Without ``na_rm`` one missing value makes an aggregate missing, and NaN makes
it NaN.  With ``na_rm`` both are left out, but means still divide by the number
of all values.  Sums are of doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _present(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def sum_of(x: Column, na_rm: bool = False) -> Column:
    if na_rm:
        return F.coalesce(F.sum(_present(x)), F.lit(0.0))
    return F.when(F.count(x) == F.count(F.lit(1)), F.coalesce(F.sum(x), F.lit(0.0)))


def mean_of(x: Column, na_rm: bool = False) -> Column:
    return sum_of(x, na_rm) / F.count(F.lit(1))


def _extreme(x: Column, na_rm: bool, pick, empty: float) -> Column:
    if na_rm:
        return F.coalesce(pick(_present(x)), F.lit(empty))
    whole = F.when(F.coalesce(F.max(F.isnan(x).cast("int")), F.lit(0)) == 1, F.lit(float("nan"))).otherwise(F.coalesce(pick(x), F.lit(empty)))
    return F.when(F.count(x) == F.count(F.lit(1)), whole)


def max_of(x: Column, na_rm: bool = False) -> Column:
    return _extreme(x, na_rm, F.max, float("-inf"))


def min_of(x: Column, na_rm: bool = False) -> Column:
    return _extreme(x, na_rm, F.min, float("inf"))


def row_sum_of(values: list[Column], na_rm: bool = False) -> Column:
    if na_rm:
        values = [F.coalesce(_present(x), F.lit(0.0)) for x in values]
    return reduce(lambda a, b: a + b, values)


def row_mean_of(values: list[Column], na_rm: bool = False) -> Column:
    return row_sum_of(values, na_rm) / len(values)
