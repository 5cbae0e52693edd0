"""Lloyd's k-means: one aggregate job per pass, centers as literals."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.index import RID, with_row_index
from gridloom.objects import DArray, SparseArray, WideArray, is_darray
from gridloom.sources import as_darray


@dataclass
class KMeans:
    """centers, and where the model is complete the sums of squares and the labels."""

    centers: np.ndarray
    size: np.ndarray | None
    iter: int | None
    totss: float | None = None
    withinss: np.ndarray | None = None
    cluster: DataFrame | None = None

    @property
    def tot_withinss(self) -> float | None:
        return None if self.withinss is None else float(self.withinss.sum())

    @property
    def betweenss(self) -> float | None:
        return None if self.totss is None else self.totss - self.tot_withinss

    def predict(self, x: DArray | SparseArray | np.ndarray) -> DataFrame:
        """__rid, label (1-based)."""
        if isinstance(x, np.ndarray):
            x = as_darray(x)
        return assigned(x, self.centers).select(RID, "label")

    def fitted(self, method: str = "centers") -> DataFrame:
        """Of each row its center's coordinates, or its label."""
        if self.cluster is None:
            raise ValueError("the model is not complete")
        if method == "classes":
            return self.cluster
        table = F.array(*(F.array(*map(F.lit, map(float, c))) for c in self.centers))
        return self.cluster.select(RID, F.element_at(table, F.col("label")).alias("center"))

    def __repr__(self) -> str:
        ratio = "" if self.totss is None else f"; between / total sum of squares {self.betweenss / self.totss:.1%}"
        return f"k-means with {len(self.centers)} clusters of sizes {self.size}\n{self.centers}{ratio}"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_rows(x: DArray | SparseArray) -> DataFrame:
    """__rid, good: whether all cells of a row are finite."""
    if isinstance(x, SparseArray):
        bad = x.df.where(~_finite(F.col("v"))).select(F.col("i").alias(RID)).distinct().withColumn("bad", F.lit(True))
        every = x.df.sparkSession.range(1, x.dim[0] + 1).withColumnRenamed("id", RID)
        return every.join(bad, RID, "left").select(RID, F.col("bad").isNull().alias("good"))
    if isinstance(x, WideArray):
        return x.df.select(RID, F.forall("row", _finite).alias("good"))
    good = F.lit(True)
    for v in x.numbers():
        good = good & _finite(v)
    return x.df.select(RID, good.alias("good"))


def assigned(x: DArray | SparseArray, centers: np.ndarray, keep: bool = False) -> DataFrame:
    """__rid, label, d2 (and the columns): the first of the nearest centers."""
    k = len(centers)
    if isinstance(x, SparseArray):
        every = x.df.sparkSession.range(1, x.dim[0] + 1).withColumnRenamed("id", RID)
        literal = [F.array(*map(F.lit, map(float, c))) for c in centers]
        at = [F.element_at(c, F.col("j").cast("int")) for c in literal]
        sums = x.df.groupBy(F.col("i").alias(RID)).agg(*(F.sum(F.col("v") * F.col("v") - 2 * F.col("v") * a).alias(f"_{q}") for q, a in enumerate(at)))
        rows = every.join(sums, RID, "left")
        d2 = [F.coalesce(F.col(f"_{q}"), F.lit(0.0)) + float((centers[q] ** 2).sum()) for q in range(k)]
    elif isinstance(x, WideArray):
        rows = x.df
        d2 = [F.aggregate(F.zip_with("row", F.array(*map(F.lit, map(float, c))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centers]
    else:
        rows = x.df
        d2 = []
        for c in centers:
            total = F.lit(0.0)
            for v, m in zip(x.numbers(), c, strict=True):
                total = total + (v - float(m)) * (v - float(m))
            d2.append(total)
    ranked = rows.withColumn("_d", F.array(*d2))
    out = ranked.withColumn("d2", F.array_min("_d")).withColumn("label", F.array_position("_d", F.col("d2")).cast("int")).drop("_d")
    return out if keep else out.select(RID, "label", "d2")


def _pass(x: DArray | SparseArray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and sums of the clusters."""
    n, p = np.zeros(len(centers), np.int64), x.dim[1]
    sums = np.zeros((len(centers), p))
    if isinstance(x, SparseArray):
        labels = assigned(x, centers)
        for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect():
            n[r["label"] - 1] = r["n"]
        for r in x.df.join(labels.withColumnRenamed(RID, "i"), "i").groupBy("label", "j").agg(F.sum("v").alias("s")).collect():
            sums[r["label"] - 1, r["j"] - 1] = r["s"]
        return n, sums
    rows = assigned(x, centers, keep=True)
    if isinstance(x, WideArray):
        for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect():
            n[r["label"] - 1] = r["n"]
        for r in rows.select("label", F.posexplode("row").alias("j", "v")).groupBy("label", "j").agg(F.sum("v").alias("s")).collect():
            sums[r["label"] - 1, r["j"]] = r["s"]
        return n, sums
    for r in rows.groupBy("label").agg(F.count(F.lit(1)), *(F.sum(v) for v in x.numbers())).collect():
        n[r[0] - 1], sums[r[0] - 1] = r[1], r[2:]
    return n, sums


def lloyd(x: DArray | SparseArray, centers: np.ndarray, iter_max: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Centers, sizes, passes and whether the centers stood still; an empty cluster keeps its center."""
    for k in range(1, iter_max + 1):
        n, sums = _pass(x, centers)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        if (moved == centers).all():
            return centers, n, k, True
        centers = moved
    return centers, n, iter_max + 1, False


def _total_ss(x: DArray | SparseArray) -> float:
    n = x.dim[0]
    if isinstance(x, (SparseArray, WideArray)):
        return float(x.coo().groupBy("j").agg((F.sum(F.col("v") * F.col("v")) - F.sum("v") * F.sum("v") / n).alias("s")).agg(F.sum("s")).first()[0] or 0.0)
    return float(sum(v or 0.0 for v in x.df.agg(*(F.var_pop(v) for v in x.numbers())).first()) * n)


def _pick(x: DArray | SparseArray, k: int, seed: int) -> np.ndarray:
    """k different rows, drawn by a seeded order; at most ten draws."""
    for attempt in range(10):
        order = F.xxhash64(F.lit(seed + attempt), F.col("r"))
        ids = [r[0] for r in x.df.sparkSession.range(1, x.dim[0] + 1).select(F.col("id").alias("r")).orderBy(order).limit(k).collect()]
        if isinstance(x, SparseArray):
            rows = np.zeros((k, x.dim[1]))
            for r in x.df.where(F.col("i").isin(ids)).collect():
                rows[ids.index(r["i"]), r["j"] - 1] = r["v"]
        else:
            picked = x.df.where(F.col(RID).isin(ids)).select(F.col("row") if isinstance(x, WideArray) else F.array(*x.numbers())).collect()
            rows = np.array([r[0] for r in picked], float)
        if len(np.unique(rows, axis=0)) == k:
            return rows
    raise ValueError(f"no {k} different rows were found")


def kmeans(x: DArray | SparseArray, centers: int | np.ndarray, iter_max: int = 10, nstart: int = 1, na_action: str = "exclude", complete_model: bool = False, seed: int = 0) -> KMeans:
    """centers: a number of clusters, or the first centers, a row each."""
    if not is_darray(x):
        raise TypeError("an array is needed")
    if na_action not in ("exclude", "fail"):
        raise ValueError("na_action is exclude or fail")
    if iter_max < 1 or nstart < 1:
        raise ValueError("iter_max and nstart must be positive")
    good = finite_rows(x)
    bad = good.where("not good").count()
    if bad and na_action == "fail":
        raise ValueError(f"{bad} rows have values that are not finite")
    used = x
    if bad:
        keep = good.where("good").select(RID)
        n = x.dim[0] - bad
        if isinstance(x, SparseArray):
            number = with_row_index(keep, RID, "_r").withColumnRenamed(RID, "i")
            used = SparseArray(x.df.join(number, "i").select(F.col("_r").cast("long").alias("i"), "j", "v"), Grid((n,), x.grid.cols))
        else:
            used = x._like(x.df.join(keep, RID), Grid((n,), x.grid.cols), x.columns) if not isinstance(x, WideArray) else WideArray(x.df.join(keep, RID), Grid((n,), x.grid.cols))
    given = not isinstance(centers, int)
    if given:
        first = np.atleast_2d(np.asarray(centers, float))
        if first.shape[1] != x.dim[1] or not np.isfinite(first).all() or len(np.unique(first, axis=0)) != len(first):
            raise ValueError("centers must be different, finite and have as many columns as the data")
    elif centers < 1:
        raise ValueError("at least one cluster is needed")
    k = len(first) if given else centers
    if k > used.dim[0]:
        raise ValueError("more clusters than rows")
    used.df.persist()
    try:
        best = None
        for start in range(nstart if complete_model and not given else 1):
            begin = first if given else _pick(used, k, seed + 1000 * start)
            found, n, passes, still = lloyd(used, begin, iter_max)
            if not still:
                warnings.warn(f"no convergence in {iter_max} passes", stacklevel=2)
            if (n == 0).any():
                warnings.warn("there is an empty cluster", stacklevel=2)
            within = None
            if complete_model:
                within = np.zeros(k)
                for r in assigned(used, found).groupBy("label").agg(F.sum("d2").alias("s")).collect():
                    within[r["label"] - 1] = r["s"]
            if best is None or within.sum() < best[3].sum():
                best = (found, n, passes, within)
        found, n, passes, within = best
        if not complete_model:
            return KMeans(found, n, passes)
        return KMeans(found, n, passes, _total_ss(used), within, assigned(x, found).join(good, RID).select(RID, F.when(F.col("good"), F.col("label")).alias("label")))
    finally:
        used.df.unpersist()
