"""Aggregates over whole objects, columns and rows.

Each returns a DataFrame; partial aggregation runs where the data is, and no
aggregate of a dense object shuffles more than one row per task (medians: than
the counts of a few thousand ranges per column).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import max_of, mean_of, min_of, row_mean_of, row_sum_of, sum_of
from gridloom.index import RID
from gridloom.objects import DList, DObject, SparseArray, Table, WideArray
from gridloom.storage import forget, materialise


def _two_dimensional(x: DObject) -> None:
    if isinstance(x, DList):
        raise TypeError("a list has no columns")


def _names(x: DObject) -> list[str]:
    return x.colnames() if isinstance(x, Table) else [f"c{j}" for j in range(1, x.dim[1] + 1)]


def _by_column(x: DObject, of, sparse) -> DataFrame:
    """j, name, value."""
    _two_dimensional(x)
    if isinstance(x, WideArray):
        return x.coo().groupBy("j").agg(of(F.col("v")).alias("value")).select("j", F.concat(F.lit("c"), F.col("j")).alias("name"), "value")
    if isinstance(x, SparseArray):
        present = x.coo().groupBy("j").agg(sparse(F.col("v")).alias("value"))
        every = x.df.sparkSession.range(1, x.dim[1] + 1).withColumnRenamed("id", "j")
        return every.join(present, "j", "left").select("j", F.concat(F.lit("c"), F.col("j")).alias("name"), F.when(F.col("value").isNull(), F.lit(0.0)).otherwise(F.col("value.x")).alias("value"))
    one = x.df.agg(*(of(v).alias(f"_{k}") for k, v in enumerate(x.numbers())))
    rows = [F.struct(F.lit(k + 1).cast("long").alias("j"), F.lit(n).alias("name"), F.col(f"_{k}").alias("value")) for k, n in enumerate(x.columns)]
    return one.select(F.inline(F.array(*rows)))


def _cell(x: Column) -> Column:
    """Within a struct a missing value is told from an absent row."""
    return F.struct(x.alias("x"))


def col_sums(x: DObject, na_rm: bool = False) -> DataFrame:
    """j, name, value: one row per column."""
    return _by_column(x, lambda v: sum_of(v, na_rm), lambda v: _cell(sum_of(v, na_rm)))


def col_means(x: DObject, na_rm: bool = False) -> DataFrame:
    """j, name, value; divides by the number of all rows."""
    return _by_column(x, lambda v: mean_of(v, na_rm), lambda v: _cell(sum_of(v, na_rm) / x.dim[0]))


def col_medians(x: Table) -> DataFrame:
    """j, name, value."""
    _two_dimensional(x)
    found = _lower_medians(x)
    # of an even number of values the middle two may differ: the upper one is the next value there is
    found = found.select("j", F.when(F.col("even") & (F.col("k") + 1 >= F.col("n")), F.col("low") * 0.5 + F.col("beyond") * 0.5).otherwise(F.col("low")).alias("value"))
    if isinstance(x, WideArray):
        return found.select("j", F.concat(F.lit("c"), F.col("j")).alias("name"), "value")
    spark = x.df.sparkSession
    if isinstance(x, SparseArray):
        every = spark.range(1, x.dim[1] + 1).select(F.col("id").alias("j"), F.concat(F.lit("c"), F.col("id")).alias("name"))
        return every.join(found.select("j", F.struct("value").alias("_v")), "j", "left").select("j", "name", F.when(F.col("_v").isNull(), F.lit(0.0)).otherwise(F.col("_v.value")).alias("value"))
    names = [F.struct(F.lit(k).cast("long").alias("j"), F.lit(c).alias("name")) for k, c in enumerate(x.columns, 1)]
    return spark.range(1).select(F.inline(F.array(*names))).join(F.broadcast(found), "j", "left").select("j", "name", "value")


#: Ranges into which a pass cuts what is left of a column.
_CUTS = 4096
#: Columns whose ranges go whole to every task.
_MOST_BROADCAST = 100_000


def _lower_medians(x: DObject) -> DataFrame:
    """j; n values of low to high, all equal, of which the k-th (from 0) is the lower median; even: there is an upper one; beyond: the least value above high.

    A pass counts the values by ranges and keeps the range of the median: first sign
    and power of 2, then equal parts of what is left, until its values are equal (at
    most five more passes, as a double has 52 bits below its power).
    """
    if isinstance(x, (SparseArray, WideArray)):
        cells = x.coo()
    else:
        cells = x.df.select(F.posexplode(F.array(*x.numbers())).alias("j", "v")).withColumn("j", F.col("j") + F.lit(1).cast("long"))
    cells = cells.select("j", (F.col("v") + 0.0).alias("v"))  # one zero
    # rises with v and is NULL or NaN where v is: 3000 is above every power of 2
    power = F.signum("v") * (F.coalesce(F.floor(F.least(F.log2(F.abs("v")), F.lit(2000.0))), F.lit(0)) + 3000)
    ranks = _ranges(cells.withColumn("b", power)).withColumn("k", F.expr("(total - 1) div 2"))
    first = ranks.where("total = 0 or before <= k and k < before + n")
    found = materialise(first.select("j", (F.col("k") - F.col("before")).alias("k"), "n", "low", "high", "beyond", (F.col("total") % 2 == 0).alias("even")), "medians")
    spread = F.coalesce(F.col("low") < F.col("high"), F.lit(False))
    while not found.where(spread).isEmpty():
        wide = found.where(spread)
        wide = F.broadcast(wide) if x.dim[1] <= _MOST_BROADCAST else wide
        inside = cells.join(wide.select("j", "low", "high"), "j").where("v between low and high")
        ranks = _ranges(inside.select("j", "v", F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * _CUTS).alias("b")))
        left = wide.select("j", "k", "even", F.col("beyond").alias("_beyond"))
        here = ranks.join(left, "j").where("before <= k and k < before + n")
        here = here.select("j", (F.col("k") - F.col("before")).alias("k"), "n", "low", "high", F.coalesce("beyond", "_beyond").alias("beyond"), "even")
        before, found = found, materialise(found.where(~spread).union(here), "medians")
        forget(before)
    return found


def _ranges(cells: DataFrame) -> DataFrame:
    """Of j, v and a range b: per j and b the number of values, how many lie before, their least and greatest, and the least one beyond."""
    counted = cells.groupBy("j", "b").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    column = Window.partitionBy("j")
    ranges = column.orderBy("b")
    before = F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return counted.select("j", "n", "low", "high", before.alias("before"), F.lead("low").over(ranges).alias("beyond"), F.sum("n").over(column).alias("total"))


def _by_row(x: DObject, of, over) -> DataFrame:
    _two_dimensional(x)
    if isinstance(x, WideArray):
        return x.df.select(RID, over(F.col("row")).alias("value"))
    return x.df.select(RID, of(x.numbers()).alias("value"))


def _sparse_rows(x: SparseArray, na_rm: bool, divide: int) -> DataFrame:
    present = x.coo().groupBy(F.col("i").alias(RID)).agg(_cell(sum_of(F.col("v"), na_rm) / divide).alias("value"))
    every = x.df.sparkSession.range(1, x.dim[0] + 1).withColumnRenamed("id", RID)
    return every.join(present, RID, "left").select(RID, F.when(F.col("value").isNull(), F.lit(0.0)).otherwise(F.col("value.x")).alias("value"))


def _array_sum(na_rm: bool):
    def of(row: Column) -> Column:
        kept = F.filter(row, lambda v: v.isNotNull() & ~F.isnan(v)) if na_rm else row
        return F.aggregate(kept, F.lit(0.0), lambda a, v: a + v)

    return of


def row_sums(x: DObject, na_rm: bool = False) -> DataFrame:
    """__rid, value: one row per row, no shuffle for dense objects."""
    if isinstance(x, SparseArray):
        return _sparse_rows(x, na_rm, 1)
    return _by_row(x, lambda vs: row_sum_of(vs, na_rm), _array_sum(na_rm))


def row_means(x: DObject, na_rm: bool = False) -> DataFrame:
    """__rid, value; divides by the number of all columns."""
    if isinstance(x, SparseArray):
        return _sparse_rows(x, na_rm, x.dim[1])
    return _by_row(x, lambda vs: row_mean_of(vs, na_rm), lambda row: _array_sum(na_rm)(row) / x.dim[1])


def _one(x: DObject, na_rm: bool) -> DataFrame:
    if isinstance(x, (SparseArray, WideArray)):
        return x.coo().agg(sum_of(F.col("v"), na_rm).alias("value"))
    return row_sums(x, na_rm).agg(sum_of(F.col("value"), na_rm).alias("value"))


def total(*xs: DObject, na_rm: bool = False) -> DataFrame:
    """value: the sum of everything in all the objects."""
    for x in xs:
        _two_dimensional(x)
    return reduce(DataFrame.union, [_one(x, na_rm) for x in xs]).agg(sum_of(F.col("value"), na_rm).alias("value"))


def mean(x: DObject, na_rm: bool = False, trim: float = 0) -> DataFrame:
    """value: the mean of all cells; with na_rm missing cells count as 0."""
    if trim:
        raise ValueError("trim is not supported")
    _two_dimensional(x)
    n, p = x.dim
    return _one(x, na_rm).select((F.col("value") / (n * p)).alias("value"))


def _extreme(xs: tuple[DObject, ...], of, edge, na_rm: bool) -> DataFrame:
    found = []
    for x in xs:
        _two_dimensional(x)
        if isinstance(x, (SparseArray, WideArray)):
            one = x.coo().agg(of(F.col("v"), na_rm).alias("value"), F.count(F.lit(1)).alias("n"))
            if isinstance(x, SparseArray):
                # a cell that is absent is 0
                zero = edge(F.col("value"), F.lit(0.0))
                one = one.withColumn("value", F.when((F.col("n") < x.dim[0] * x.dim[1]) & F.col("value").isNotNull() & ~F.isnan("value"), zero).otherwise(F.col("value")))
            found.append(one.select("value"))
        else:
            cells = x.df.agg(*(of(v, na_rm).alias(f"_{k}") for k, v in enumerate(x.numbers())))
            found.append(cells.select(F.explode(F.array(*cells.columns)).alias("value")))
    return reduce(DataFrame.union, found).agg(of(F.col("value"), na_rm).alias("value"))


def largest(*xs: DObject, na_rm: bool = False) -> DataFrame:
    """value: the greatest cell of all the objects."""
    return _extreme(xs, max_of, F.greatest, na_rm)


def smallest(*xs: DObject, na_rm: bool = False) -> DataFrame:
    """value: the least cell of all the objects."""
    return _extreme(xs, min_of, F.least, na_rm)


def unique(x: DObject) -> DataFrame:
    """Distinct items of a list, cells of an array, rows of a frame."""
    if isinstance(x, DList):
        return x.df.select("value").distinct()
    if isinstance(x, SparseArray):
        values = x.coo().select("v").distinct()
        cells = x.coo().agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < x.dim[0] * x.dim[1]).select(F.lit(0.0).alias("v"))
        return values.union(cells).distinct().withColumnRenamed("v", "value")
    if x.kind == "darray":
        return x.coo().select(F.col("v").alias("value")).distinct()
    return x.df.select(*x.columns).distinct()


def which_max(x: DObject) -> DataFrame:
    """i, j, v of the greatest cell, the first by column and then row."""
    return x.coo().where("v is not null").agg(F.max(F.struct("v", (-F.col("j")).alias("j"), (-F.col("i")).alias("i"))).alias("m")).where("m is not null").select((-F.col("m.i")).alias("i"), (-F.col("m.j")).alias("j"), F.col("m.v").alias("v"))


def bin_counts(df: DataFrame, value: Column, breaks: list[float]) -> DataFrame:
    """bin, low, high, n: how many values lie in (low, high], empty bins included."""
    edges = list(zip(breaks[:-1], breaks[1:], strict=True))
    which = reduce(lambda c, k: c.when((value > edges[k][0]) & (value <= edges[k][1]), F.lit(k + 1)), range(len(edges)), F)
    counted = df.select(which.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.createDataFrame([(k + 1, float(a), float(b)) for k, (a, b) in enumerate(edges)], "bin int, low double, high double")
    return bins.join(counted, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))
