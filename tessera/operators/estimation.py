"""Fits on cell counts: logistic propensities by Newton steps, Cox by sums over distinct times, and doubly robust effects.

Covariates here have few values, so rows are first counted to cells (map-side combined). A fit then reads cells, whose
number the covariates bound, however many decisions there are; candidates and folds cost no copies of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.stored import cut

CLIP, RIDGE = (0.01, 0.99), 1.0


def irls(x: np.ndarray, hits: np.ndarray, n: np.ndarray, ridge: float = RIDGE, steps: int = 40) -> np.ndarray:
    """Coefficients of a logistic fit with a free intercept (first column of x) and an L2 penalty on the rest, on counts."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.diag(np.r_[0.0, np.ones(x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(x.shape[1]), x.T @ (hits - n * p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def design(cells: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Intercept and indicator columns of the cells' categorical values, the first level of each left out."""
    parts = [np.ones((len(cells), 1))]
    for c in columns:
        levels = sorted(cells[c].unique())[1:]
        parts += [(cells[c].to_numpy() == v).astype(float)[:, None] for v in levels]
    return np.hstack(parts)


def effects(cells: DataFrame, columns: list[str], epsilon: float, n_min: int) -> DataFrame:
    """Per candidate: the cross-fitted doubly robust effect, its standard error and how much was trimmed.

    cells: candidate, fold, columns, and n, y, yy (count, sum and sum of squares of the outcome) of all and (n1, y1, yy1) of
    the exposed. A group is one candidate's cells.
    """

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        x = design(p, columns)
        total = mean = square = trimmed = 0.0
        if p.n1.sum() >= n_min:
            for f in sorted(p.fold.unique()):
                out, own = (p.fold != f).to_numpy(), (p.fold == f).to_numpy()
                if not 3 <= p.n1[out].sum() <= p.n[out].sum() - 3:
                    continue
                e = np.clip(1 / (1 + np.exp(-x @ irls(x[out], p.n1[out].to_numpy(float), p.n[out].to_numpy(float)))), *CLIP)[own]
                mu = []
                for n, y in ((p.n - p.n1, p.y - p.y1), (p.n1, p.y1)):
                    w, s = n[out].to_numpy(float), y[out].to_numpy(float)
                    pen = RIDGE * np.diag(np.r_[0.0, np.ones(x.shape[1] - 1)]) + 1e-9 * np.eye(x.shape[1])
                    mu.append(x[own] @ np.linalg.solve((x[out] * w[:, None]).T @ x[out] + pen, x[out].T @ s))
                ok = (e >= epsilon) & (e <= 1 - epsilon)
                c = p[own]
                n1, y1, yy1 = (c[k].to_numpy(float) for k in ("n1", "y1", "yy1"))
                n0, y0, yy0 = (c[k].to_numpy(float) - v for k, v in (("n", n1), ("y", y1), ("yy", yy1)))
                d = mu[1] - mu[0]
                # Of each arm: base d - m k and slope k of the pseudo-outcome in y.
                for k, m, n, y, yy in ((1 / e, mu[1], n1, y1, yy1), (-1 / (1 - e), mu[0], n0, y0, yy0)):
                    b = d - k * m
                    mean += float(((b * n + k * y) * ok).sum())
                    square += float(((b * b * n + 2 * b * k * y + k * k * yy) * ok).sum())
                total += float(((n0 + n1) * ok).sum())
                trimmed += float(((n0 + n1) * ~ok).sum())
        tau = mean / total if total else float("nan")
        se = float(np.sqrt(max(square / total - tau * tau, 0.0) / total)) if total else float("nan")
        return pd.DataFrame({"candidate": [p.candidate.iloc[0]], "tau": [tau], "se": [se], "eligible": [int(total)], "trimmed": [int(trimmed)], "exposed": [int(p.n1.sum())]})

    return cells.groupBy("candidate").applyInPandas(fit, "candidate string, tau double, se double, eligible bigint, trimmed bigint, exposed bigint")


def cox_fit(rows: DataFrame, time: str, event: str, xs: list[str], ridge: float = 0.0, weight: str | None = None, steps: int = 30) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Coefficients of a Cox model, their information matrix, and the steps (t, hazard) of the cumulative baseline hazard.

    Breslow risk sets; rows are counted to distinct (time, covariates) once and written, and each Newton step is one pass over
    those counts, of which only sums over distinct times reach a window and only sums of a fixed number the driver.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    names = [f"x{i}" for i in range(len(xs))]
    n = cut(rows.groupBy(F.col(time).alias("t"), *[F.col(x).cast("double").alias(c) for x, c in zip(xs, names, strict=True)]).agg(F.sum(w).alias("n"), F.sum(F.when(F.col(event), w).otherwise(0.0)).alias("d")))
    beta, info = np.zeros(len(xs)), np.zeros((len(xs), len(xs)))
    back = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]

    def sums(beta: np.ndarray) -> DataFrame:
        e = F.col("n") * F.exp(sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, names, strict=True)), F.lit(0.0)))
        moments = {"s0": e, **{f"s_{c}": e * F.col(c) for c in names}, **{f"s_{i}_{j}": e * F.col(names[i]) * F.col(names[j]) for i, j in pairs}}
        s = n.groupBy("t").agg(F.sum("d").alias("d"), *[F.sum(F.col("d") * F.col(c)).alias(f"d_{c}") for c in names], *[F.sum(v).alias(k) for k, v in moments.items()])
        return s.select("t", "d", *[f"d_{c}" for c in names], *[F.sum(k).over(back).alias(k) for k in moments]).where("d > 0")

    for _ in range(steps):
        mean = lambda c: F.col(f"s_{c}") / F.col("s0")
        g = [F.sum(F.col(f"d_{c}") - F.col("d") * mean(c)).alias(f"g{i}") for i, c in enumerate(names)]
        h = [F.sum(F.col("d") * (F.col(f"s_{i}_{j}") / F.col("s0") - mean(names[i]) * mean(names[j]))).alias(f"h{i}_{j}") for i, j in pairs]
        r = sums(beta).agg(*g, *h).first()
        for i, j in pairs:
            info[i, j] = info[j, i] = r[f"h{i}_{j}"] or 0.0
        held = info + ridge * np.eye(len(xs))
        if np.linalg.matrix_rank(held) < len(xs):
            break
        step = np.linalg.solve(held, np.array([r[f"g{i}"] or 0.0 for i in range(len(xs))]) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    run = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return beta, info + ridge * np.eye(len(xs)), sums(beta).select("t", F.sum(F.col("d") / F.col("s0")).over(run).alias("hazard"))


def cox_hazard_ratio(rows: DataFrame, time: str, event: str, x: str, ridge: float = 0.0, steps: int = 30) -> tuple[float, float]:
    """(log hazard ratio, standard error) of one covariate."""
    beta, info, _ = cox_fit(rows, time, event, [x], ridge, steps=steps)
    return float(beta[0]), float(1 / info[0, 0] ** 0.5) if info[0, 0] > 0 else float("nan")


def cox_restricted_mean(points: DataFrame, baseline: DataFrame, eta: Column, horizon: str, keys: list[str]) -> DataFrame:
    """keys, rmst and survival: the area under exp(-H0(t) exp(eta)) up to the horizon, and its value there, for each covariate point.

    baseline has a row per distinct event time, of which each point takes those up to its horizon: points times times rows, which
    covariates of few values and times rounded to two decimals bound, and nothing else.
    """
    nxt = F.lead("t").over(Window.orderBy("t"))
    pieces = baseline.withColumn("next", nxt)
    first = baseline.agg(F.min("t").alias("first"))
    each = points.withColumn("_risk", F.exp(eta)).crossJoin(first).join(pieces, F.col("t") <= F.col(horizon), "left")
    width = F.least(F.coalesce("next", F.col(horizon)), F.col(horizon)) - F.col("t")
    area = F.coalesce(F.sum(F.exp(-F.col("hazard") * F.col("_risk")) * width), F.lit(0.0))
    head = F.least(F.coalesce("first", F.col(horizon)), F.col(horizon))
    return each.groupBy(*keys, F.col(horizon).alias("_h"), head.alias("_head")).agg((area + F.first(head)).alias("rmst"), F.coalesce(F.min(F.exp(-F.col("hazard") * F.col("_risk"))), F.lit(1.0)).alias("survival")).drop("_h", "_head")
