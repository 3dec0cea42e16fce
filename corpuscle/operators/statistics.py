"""Dummy-coded least squares, joint tests, cross-group variance and Welch's test.

All predictors are categorical, so a fit needs only the count, sum and sum of squares of the outcome per cell of
factor levels: one aggregation with map-side combining.  The cells (at most ``MAX_CELLS``, checked) go to the driver,
where the normal equations are swept in column order; a column whose pivot vanishes is reported as aliased instead of
being given noise.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import f_upper, t_quantile, t_two_sided

MAX_CELLS = 100_000
REFERENCE = {"context": "commercial", "actor_type": "company", "positioning": "capability"}


@dataclass
class Fit:
    terms: list[str]
    beta: np.ndarray  # NaN where aliased
    cov: np.ndarray
    n: int
    rank: int
    sse: float
    sst: float

    def table(self):
        df = self.n - self.rank
        q = t_quantile(0.975, df) if df > 0 else float("nan")
        rows = []
        for i, term in enumerate(self.terms):
            b = self.beta[i]
            if math.isnan(b):
                rows.append((term, None, None, None, None, None, None, True))
                continue
            se = math.sqrt(max(self.cov[i, i], 0.0))
            t = b / se if se > 0 else float("inf")
            p = t_two_sided(t, df) if df > 0 and math.isfinite(t) else 0.0
            rows.append((term, float(b), se, float(t), float(p), float(b - q * se), float(b + q * se), False))
        return rows

    def summary(self):
        df, k = self.n - self.rank, self.rank - 1
        r2 = 1 - self.sse / self.sst if self.sst > 0 else float("nan")
        adj = 1 - (1 - r2) * (self.n - 1) / df if df > 0 else float("nan")
        f = (self.sst - self.sse) / k / (self.sse / df) if k > 0 and df > 0 and self.sse > 0 else float("nan")
        return r2, adj, f, f_upper(f, k, df) if f == f else float("nan"), self.n


def cells_of(df: DataFrame, ys: list[str], factors: list[str]) -> dict[str, list[tuple]]:
    """Per outcome (levels..., n, sum, sum of squares) of its complete rows, all outcomes in one aggregation."""
    sums = [x.alias(f"_{k}{i}") for i, y in enumerate(ys) for k, x in (("n", F.count(y)), ("s", F.sum(y)), ("q", F.sum(F.col(y) * F.col(y))))]
    rows = df.dropna(subset=factors).groupBy(*factors).agg(*sums).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError("more factor cells than MAX_CELLS")
    k = len(factors)
    return {y: [(*r[:k], *r[k + 3 * i : k + 3 * i + 3]) for r in rows if r[k + 3 * i]] for i, y in enumerate(ys)}


def cells(df: DataFrame, y: str, factors: list[str]) -> list[tuple]:
    return cells_of(df, [y], factors)[y]


def _levels(rows: list[tuple], i: int, factor: str) -> list:
    """Levels that occur, the reference first."""
    seen = sorted({r[i] for r in rows}, key=lambda v: (isinstance(v, str), v))
    ref = REFERENCE.get(factor)
    return [ref, *[v for v in seen if v != ref]] if ref in seen else seen


def fit(df: DataFrame, y: str, factors: list[str], interactions: list[tuple[str, str]] = (), numeric: tuple[str, ...] = ()) -> Fit:
    """Treatment-coded least squares of ``y`` on ``factors`` (those in ``numeric`` enter as numbers)."""
    return fit_cells(cells(df, y, factors), factors, interactions, numeric)


def fit_cells(rows: list[tuple], factors: list[str], interactions: list[tuple[str, str]] = (), numeric: tuple[str, ...] = ()) -> Fit:
    rows = sorted(rows, key=str)
    where = {f: i for i, f in enumerate(factors)}
    cols: list[tuple[str, np.ndarray]] = [("Intercept", np.ones(len(rows)))]
    dummies: dict[str, list[tuple[str, np.ndarray]]] = {}
    for f in factors:
        if f in numeric:
            dummies[f] = [(f, np.array([float(r[where[f]]) for r in rows]))]
        else:
            dummies[f] = [(f"{f}[{v}]", np.array([float(r[where[f]] == v) for r in rows])) for v in _levels(rows, where[f], f)[1:]]
        cols += dummies[f]
    for a, b in interactions:
        for na, xa in dummies[a]:
            for nb, xb in dummies[b]:
                if (xa * xb).any():  # only combinations that occur
                    cols.append((f"{na}:{nb}", xa * xb))
    k = len(factors)
    n = np.array([r[k] for r in rows], dtype=float)
    s = np.array([r[k + 1] for r in rows], dtype=float)
    total, q = n.sum(), sum(float(r[k + 2]) for r in rows)
    x = np.stack([c for _, c in cols], axis=1) if rows else np.zeros((0, len(cols)))
    gram, xty = (x * n[:, None]).T @ x, x.T @ s
    keep: list[int] = []
    for j in range(len(cols)):  # sweep in declared order
        if keep:
            sub = gram[np.ix_(keep, keep)]
            rest = gram[j, j] - gram[j, keep] @ np.linalg.solve(sub, gram[keep, j])
        else:
            rest = gram[j, j]
        if rest > 1e-8 * max(gram[j, j], 1.0):
            keep.append(j)
    beta = np.full(len(cols), np.nan)
    cov = np.full((len(cols), len(cols)), np.nan)
    inv = np.linalg.inv(gram[np.ix_(keep, keep)])
    b = inv @ xty[keep]
    beta[keep] = b
    sse = max(q - float(b @ xty[keep]), 0.0)
    df_ = total - len(keep)
    cov[np.ix_(keep, keep)] = inv * (sse / df_ if df_ > 0 else np.nan)
    sst = q - s.sum() ** 2 / total if total else 0.0
    return Fit([c for c, _ in cols], beta, cov, int(total), len(keep), sse, sst)


def wald(f: Fit, picked: list[int]) -> tuple[float, int, float]:
    """(F, numerator degrees of freedom, p) of the joint test that the picked coefficients are zero."""
    idx = [i for i in picked if not math.isnan(f.beta[i])]
    if not idx:
        return float("nan"), 0, float("nan")
    b = f.beta[idx]
    stat = float(b @ np.linalg.solve(f.cov[np.ix_(idx, idx)], b)) / len(idx)
    return stat, len(idx), f_upper(stat, len(idx), f.n - f.rank)


def stars(p) -> str:
    return "" if p is None or p >= 0.05 else "***" if p < 0.001 else "**" if p < 0.01 else "*"


def qualifying_cells(df: DataFrame, least: int) -> DataFrame:
    """Rows whose (actor, context) cell has at least ``least`` rows and whose actor keeps two contexts."""
    n = df.groupBy("actor", "context").count().where(F.col("count") >= least)
    two = n.groupBy("actor").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("actor")
    return df.join(n.join(two, "actor", "left_semi").select("actor", "context"), ["actor", "context"], "left_semi")


def cross_context(df: DataFrame, y: str, contexts: list[str], least: int = 10) -> DataFrame:
    """Sample standard deviation of an actor's context means, over cells of at least ``least`` rows, two or more."""
    cell = df.where(F.col(y).isNotNull()).groupBy("actor", "actor_type", "context").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m")).where(F.col("n") >= least)
    g = cell.groupBy("actor", "actor_type").agg(
        F.count(F.lit(1)).alias("n_contexts"), *[F.round(F.max(F.when(F.col("context") == c, F.col("m"))), 6).alias(f"mean_{c}") for c in contexts],
        F.round(F.stddev_samp("m"), 6).alias("cross_context_std"), F.sum("n").alias("n_docs"),
    )
    return g.where("n_contexts >= 2").withColumn("is_individual", (F.col("actor_type") == "individual").cast("int"))


def welch(groups: DataFrame, value: str, flag: str) -> DataFrame:
    """Welch's t-test of flag 1 against flag 0 on ``value`` (nulls left out); null where a side has fewer than two."""
    a = [F.count(F.when(F.col(flag) == k, F.col(value))).alias(f"n{k}") for k in (1, 0)]
    m = [F.avg(F.when(F.col(flag) == k, F.col(value))).alias(f"m{k}") for k in (1, 0)]
    v = [F.var_samp(F.when(F.col(flag) == k, F.col(value))).alias(f"v{k}") for k in (1, 0)]
    s = groups.agg(*a, *m, *v)
    e1, e0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    ok = (F.col("n1") >= 2) & (F.col("n0") >= 2) & (e1 + e0 > 0)
    t = F.when(ok, (F.col("m1") - F.col("m0")) / F.sqrt(e1 + e0))
    dof = F.when(ok, (e1 + e0) ** 2 / (e1**2 / (F.col("n1") - 1) + e0**2 / (F.col("n0") - 1)))
    return s.select("n1", "n0", F.round("m1", 6).alias("mean_1"), F.round("m0", 6).alias("mean_0"), F.round(t, 6).alias("t"), F.round(dof, 6).alias("df"))


def welch_verdict(test: DataFrame, gate: float = 0.05) -> DataFrame:
    """The one row of ``welch`` with its two-sided p and whether group 1 is significantly above group 0."""
    r = test.first()
    p = None if r is None or r["t"] is None else round(t_two_sided(r["t"], r["df"]), 6)
    supported = p is not None and p < gate and r["mean_1"] > r["mean_0"]
    return test.withColumn("p", F.lit(p).cast("double")).withColumn("supported", F.lit(supported))
