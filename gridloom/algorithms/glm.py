"""Generalised linear models by Newton steps: one aggregate job per iteration.

Families: gaussian (identity), binomial (logit), poisson (log).  An intercept is
always fitted.  Rows with any value that is not finite have weight 0.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.index import RID
from gridloom.objects import DArray
from gridloom.sources import as_darray

FAMILIES = ("gaussian", "binomial", "poisson")
#: Up to so many coefficients the normal equations are SQL sums; beyond, sums of Arrow batches.
_SQL_TERMS = 24


@dataclass
class Control:
    epsilon: float = 1e-8
    maxit: int = 25


def glm_control(epsilon: float = 1e-8, maxit: int = 25) -> Control:
    if epsilon <= 0 or maxit < 1:
        raise ValueError("epsilon and maxit must be positive")
    return Control(epsilon, maxit)


def link_inverse(family: str, eta: Column) -> Column:
    return eta if family == "gaussian" else 1 / (1 + F.exp(-eta)) if family == "binomial" else F.exp(eta)


def variance(family: str, mu: Column) -> Column:
    return F.lit(1.0) if family == "gaussian" else mu * (1 - mu) if family == "binomial" else mu


def deviance_of(family: str, y: Column, mu: Column, w: Column) -> Column:
    """The contribution of a row; 0 log 0 is 0."""
    if family == "gaussian":
        return w * (y - mu) * (y - mu)
    ratio = lambda a, b: F.when(a == 0, F.lit(0.0)).otherwise(a * F.log(a / b))
    if family == "binomial":
        return 2 * w * (ratio(y, mu) + ratio(1 - y, 1 - mu))
    return 2 * w * (ratio(y, mu) - (y - mu))


def _start_mu(family: str, y: Column, w: Column) -> Column:
    return y if family == "gaussian" else (w * y + 0.5) / (w + 1) if family == "binomial" else y + 0.1


def _eta(xs: list[str], beta: np.ndarray, offset: Column) -> Column:
    out = F.lit(float(beta[0])) + offset
    for c, b in zip(xs, beta[1:], strict=True):
        out = out + F.col(c) * float(b)
    return out


def normal_equations(df: DataFrame, xs: list[str], weight: Column, target: Column) -> tuple[np.ndarray, np.ndarray]:
    """X1' diag(weight) X1 and X1' target, X1 with an intercept."""
    p = len(xs) + 1
    upper = [(a, b) for a in range(p) for b in range(a, p)]
    if p <= _SQL_TERMS:
        x = [F.lit(1.0), *map(F.col, xs)]
        rows = df.withColumns({"_w": weight, "_t": target})
        sums = rows.agg(*(F.sum(F.col("_w") * x[a] * x[b]) for a, b in upper), *(F.sum(F.col("_t") * v) for v in x)).first()
        values = np.array([v or 0.0 for v in sums], float)
    else:

        def partial(batches):
            total = np.zeros(len(upper) + p)
            for batch in batches:
                cols = [np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns]
                x = np.column_stack([np.ones(len(batch)), *cols[2:]])
                gram = x.T @ (x * cols[0][:, None])
                total[: len(upper)] += gram[np.triu_indices(p)]
                total[len(upper) :] += x.T @ cols[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

        parts = df.select(weight.alias("_w"), target.alias("_t"), *xs).mapInArrow(partial, "k long, v double")
        values = np.zeros(len(upper) + p)
        for k, v in parts.groupBy("k").agg(F.sum("v")).collect():
            values[k] = v
    gram = np.zeros((p, p))
    for (a, b), v in zip(upper, values, strict=False):
        gram[a, b] = gram[b, a] = v
    return gram, values[len(upper) :]


@dataclass
class Glm:
    """A fitted model; rows are (__rid, y, x.., weight, offset, eta, mu) for those that were used."""

    family: str
    coefficients: np.ndarray
    deviance: float
    null_deviance: float
    aic: float
    iter: int
    converged: bool
    df_null: int
    df_residual: int
    rows: DataFrame = field(repr=False)
    names: list[str] = field(repr=False)
    bad_rows: int = 0

    def predict(self, x: DArray | np.ndarray, type: str = "link", mask: DataFrame | None = None) -> DataFrame:
        """__rid, value on the scale of the link or of the response; a mask (__rid, keep) leaves rows out."""
        if type not in ("link", "response"):
            raise ValueError("type is link or response")
        if isinstance(x, np.ndarray):
            x = as_darray(x)
        if mask is not None:
            x = DArray(x.df.join(mask.where("keep"), RID), x.grid, x.columns)
        names = [f"_x{k}" for k in range(len(x.columns))]
        rows = x.df.select(RID, *(v.alias(n) for v, n in zip(x.numbers(), names, strict=True)))
        eta = _eta(names, self.coefficients, F.lit(0.0))
        return rows.select(RID, (eta if type == "link" else link_inverse(self.family, eta)).alias("value"))

    def fitted(self) -> DataFrame:
        return self.rows.select(RID, F.col("_mu").alias("value"))

    def weights(self, type: str = "prior") -> DataFrame:
        w = F.col("_w") if type == "prior" else F.col("_w") * (F.lit(1.0) if self.family == "gaussian" else variance(self.family, F.col("_mu")))
        return self.rows.select(RID, w.alias("value"))

    def residuals(self, type: str = "deviance") -> DataFrame:
        """__rid, value: deviance, pearson, working or response residuals."""
        y, mu, w = F.col("_y"), F.col("_mu"), F.col("_w")
        derivative = F.lit(1.0) if self.family == "gaussian" else variance(self.family, mu)
        of = {
            "deviance": F.signum(y - mu) * F.sqrt(F.greatest(F.lit(0.0), deviance_of(self.family, y, mu, w))),
            "pearson": (y - mu) * F.sqrt(w) / F.sqrt(variance(self.family, mu)),
            "working": (y - mu) / derivative,
            "response": y - mu,
        }
        if type == "partial":
            return self.rows.select(RID, *(((y - mu) / derivative + F.col(n) * float(b)).alias(n) for n, b in zip(self.names, self.coefficients[1:], strict=True)))
        if type not in of:
            raise ValueError(f"type is one of {', '.join(of)}, partial")
        return self.rows.select(RID, of[type].alias("value"))

    def summary(self) -> pd.DataFrame:
        """estimate, std_error, statistic and p_value of every coefficient; dispersion in attrs."""
        y, mu, w = F.col("_y"), F.col("_mu"), F.col("_w")
        derivative = F.lit(1.0) if self.family == "gaussian" else variance(self.family, mu)
        working = w * derivative * derivative / variance(self.family, mu)
        hessian, _ = normal_equations(self.rows, self.names, working, F.lit(0.0))
        known = self.family != "gaussian"
        dispersion = 1.0 if known else self.rows.agg(F.sum(w * (y - mu) * (y - mu))).first()[0] / max(self.df_residual, 1)
        covariance = dispersion * np.linalg.inv(hessian)
        se = np.sqrt(np.diag(covariance))
        stat = self.coefficients / se
        p = [math.erfc(abs(s) / math.sqrt(2)) if known else student_two_sided(s, self.df_residual) for s in stat]
        out = pd.DataFrame({"estimate": self.coefficients, "std_error": se, "statistic": stat, "p_value": p}, index=["(Intercept)", *self.names])
        out.attrs.update(dispersion=dispersion, covariance=covariance, correlation=covariance / np.outer(se, se))
        return out


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a if x > 0 else 0.0
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 400):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or 1e-300)
            c = 1 + numerator / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h if swap else front * h


@F.pandas_udf(T.DoubleType())
def _log_factorial(n: pd.Series) -> pd.Series:
    return n.map(lambda v: math.lgamma(v + 1))


def _aic(family: str, rows: DataFrame, deviance: float, rank: int) -> float:
    y, mu, w = F.col("_y"), F.col("_mu"), F.col("_w")
    if family == "gaussian":
        n, log_w = rows.where("_w > 0").agg(F.count(F.lit(1)), F.sum(F.log(w))).first()
        return n * (math.log(2 * math.pi * deviance / n) + 1) + 2 - log_w + 2 * rank
    if family == "binomial":
        n, k = F.round(w), F.round(w * y)
        choose = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        part = F.when(n > 0, w / n).otherwise(0.0) * (choose + F.when(k > 0, k * F.log(mu)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - mu)).otherwise(0.0))
    else:
        part = w * (y * F.log(mu) - mu - _log_factorial(y))
    return -2 * rows.agg(F.sum(part)).first()[0] + 2 * rank


def glm(responses: DArray, predictors: DArray, family: str = "gaussian", weights: DArray | None = None, offset: DArray | None = None, start: np.ndarray | None = None, etastart: DArray | None = None, mustart: DArray | None = None, control: Control | None = None, na_action: str = "exclude") -> Glm:
    """Fit by Newton's method; start (of the coefficients) is 0 unless given.

    etastart or mustart, a column each, replace the means that the first deviance
    and the first working responses come from.

    Weights other than 0 and 1, and offsets, go through working responses and
    weights.  Ends when the deviance changes by less than epsilon, relatively;
    while a step makes it not finite, the step is halved.
    """
    if family not in FAMILIES:
        raise ValueError(f"family is one of {', '.join(FAMILIES)}")
    if responses.dim[0] != predictors.dim[0] or responses.dim[1] != 1:
        raise ValueError("responses are one column, as long as the predictors")
    control = control or Control()
    names = list(predictors.columns) if "__y" not in predictors.columns else [f"x{k}" for k in range(len(predictors.columns))]
    df = predictors.df.select(RID, *(v.alias(n) for v, n in zip(predictors.numbers(), names, strict=True)))
    df = df.join(responses.df.select(RID, responses.numbers()[0].alias("_y")), RID)
    for x, n, default in ((weights, "_w", 1.0), (offset, "_o", 0.0), (etastart, "_e", None), (mustart, "_m", None)):
        df = df.withColumn(n, F.lit(default).cast("double")) if x is None else df.join(x.df.select(RID, x.numbers()[0].alias(n)), RID)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    good = F.lit(True)
    for c in [*names, "_y"]:
        good = good & finite(c)
    bad = df.where(~good).count()
    if bad and na_action == "fail":
        raise ValueError(f"{bad} rows have values that are not finite")
    df = df.where(good).persist()
    y, w, o = F.col("_y"), F.col("_w"), F.col("_o")
    low, high, n_good, whole, odd = df.agg(F.min("_y"), F.max("_y"), F.sum((w != 0).cast("long")), F.sum(w), F.max(((w != 0) & (w != 1)).cast("int"))).first()
    if family == "binomial" and (low < 0 or high > 1) or family == "poisson" and low < 0:
        raise ValueError("the responses are outside of the family's range")
    general = offset is not None or bool(odd)
    p = len(names) + 1
    beta = np.zeros(p) if start is None else np.asarray(start, float)
    mu0 = _start_mu(family, y, w) if etastart is None and mustart is None else link_inverse(family, F.col("_e")) if etastart is not None else F.col("_m")
    before = df.agg(F.sum(deviance_of(family, y, mu0, w))).first()[0]
    # working responses begin at the starting mean, too
    eta0 = mu0 if family == "gaussian" else F.log(mu0 / (1 - mu0)) if family == "binomial" else F.log(mu0)
    converged, k, dev = False, 0, before
    for k in range(1, control.maxit + 1):
        last = beta
        first = k == 1 and start is None
        eta = eta0 if general and first else _eta(names, beta, o)
        mu = link_inverse(family, eta)
        derivative = F.lit(1.0) if family == "gaussian" else variance(family, mu)
        if general:
            working = w * derivative * derivative / variance(family, mu)
            gram, right = normal_equations(df, names, working, working * ((eta - o) + (y - mu) / derivative))
            beta = np.linalg.solve(gram, right)
        elif family == "gaussian":
            gram, right = normal_equations(df, names, w, w * y)
            beta = np.linalg.solve(gram, right)
        else:
            gram, gradient = normal_equations(df, names, w * derivative, w * (mu - y))
            beta = beta - np.linalg.solve(gram, gradient)
        dev = _deviance(df, family, names, beta)
        halvings = 0
        while not math.isfinite(dev) and halvings < control.maxit:
            beta, halvings = (beta + last) / 2, halvings + 1
            dev = _deviance(df, family, names, beta)
        if abs(dev - before) / (0.1 + abs(dev)) < control.epsilon:
            converged = True
            break
        before = dev
    if not converged:
        warnings.warn(f"no convergence in {control.maxit} steps", stacklevel=2)
    center = df.agg(F.sum(w * y) / F.sum(w)).first()[0]
    null = df.agg(F.sum(deviance_of(family, y, F.lit(float(center)), w))).first()[0]
    rank = min(p, n_good)
    rows = df.withColumn("_eta", _eta(names, beta, o)).withColumn("_mu", link_inverse(family, F.col("_eta")))
    _warn_of_bounds(family, rows)
    return Glm(family, beta, dev, null, _aic(family, rows, dev, rank), k, converged, n_good - 1, n_good - rank, rows, names, bad)


def _warn_of_bounds(family: str, rows: DataFrame) -> None:
    """Fitted means at the bounds of the family's range: the estimates may be unbounded."""
    if family == "gaussian":
        return
    near = 10 * np.finfo(float).eps
    low, high = rows.agg(F.min("_mu"), F.max("_mu")).first()
    if low is not None and low < near:
        warnings.warn("fitted probabilities of 0" if family == "binomial" else "fitted rates of 0", stacklevel=3)
    if family == "binomial" and high is not None and high > 1 - near:
        warnings.warn("fitted probabilities of 1", stacklevel=3)


def _deviance(df: DataFrame, family: str, names: list[str], beta: np.ndarray) -> float:
    mu = link_inverse(family, _eta(names, beta, F.col("_o")))
    found = df.agg(F.sum(deviance_of(family, F.col("_y"), mu, F.col("_w")))).first()[0]
    return math.nan if found is None else found
