"""Nuisance models of all candidates and folds at once, on continuous covariates, and the effects that rest on them.

Rows hold a decision's covariates, its fold and the candidates that it is exposed to. One pass over them sums what every model needs:
a task adds up, by model, the moments of its rows in matrix products and sends only these, so what is shuffled and what the driver
solves depends on the number of candidates, folds and columns, never on rows. Ridge outcome models take one pass for all
candidates, folds and arms: sums of a fold are kept apart, and what is left out is subtracted. Logistic propensities take one pass
for each Newton step: first of the models that leave out nothing, whose sums by fold are also the first step of the others, which
start from there and need few more. The last pass scores each decision with the models of which it was no part.

A model is named by its candidate and the fold that it leaves out; ``NONE_OUT`` leaves out none, and scores other decisions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.stored import cut

NONE_OUT = -1
RIDGE, FLOOR, CEILING = 1.0, 0.01, 0.99
#: An arm of fewer decisions than this has no model.
LEAST_ARM = 3
STEPS, CLOSE = 40, 1e-8


def rows_of(decisions: DataFrame, exposures: DataFrame, covariates: list[str], outcome: str = "y", quadratic: tuple[str, ...] = ()) -> DataFrame:
    """(decision_id, fold, x, y, exposed): the design with its intercept first, then squares and products of the quadratic columns.

    decisions has decision_id, fold, the covariates and the outcome; exposures is long (decision_id, candidate). Decisions without
    exposure have an empty list. A null covariate counts as 0, and decisions of a null outcome are left out.
    """
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    more = [value(a) * value(b) for i, a in enumerate(quadratic) for b in quadratic[i:]]
    x = F.array(F.lit(1.0), *[value(c) for c in covariates], *more)
    own = exposures.groupBy("decision_id").agg(F.collect_set("candidate").alias("exposed"))
    d = decisions.where(F.col(outcome).isNotNull()).select("decision_id", F.col("fold").cast("int").alias("fold"), x.alias("x"), F.col(outcome).cast("double").alias("y"))
    return d.join(own, "decision_id", "left").withColumn("exposed", F.coalesce("exposed", F.array().cast("array<string>")))


def _batch(b: pa.RecordBatch, candidates: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The design, outcomes, folds, and exposure as 0 and 1 by candidate, of a batch."""
    x = b["x"].flatten().to_numpy().reshape(len(b), -1)
    lists, names = b["exposed"], b["exposed"].flatten()
    of = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
    at = pc.index_in(names, value_set=candidates).fill_null(-1).to_numpy() if len(names) else np.zeros(0, np.int64)
    a = np.zeros((len(b), len(candidates)))
    a[of[at >= 0], at[at >= 0]] = 1.0
    return x, b["y"].to_numpy(zero_copy_only=False), b["fold"].to_numpy(), a


#: Rows in a block. Passes read a block's numbers as they lie in memory, where rows would be turned into arrays again each time.
BLOCK = 4096


def _blocks(rows: DataFrame, candidates: list[str], folds: int) -> DataFrame:
    """The rows of the fit's folds as blocks of one fold: (fold, y, x, exposed), the latter three as bytes, a bit for each candidate."""
    names = pa.array(candidates, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, fold, a = _batch(b, names)
            for f in np.unique(fold[(fold >= 0) & (fold < folds)]):
                of = np.flatnonzero(fold == f)
                for lo in range(0, len(of), BLOCK):
                    at = of[lo : lo + BLOCK]
                    parts = y[at].tobytes(), x[at].tobytes(), np.packbits(a[at] > 0, axis=1).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), *[pa.array([v], pa.binary()) for v in parts]], names=["fold", "y", "x", "exposed"])

    return rows.mapInArrow(run, "fold int, y binary, x binary, exposed binary")


def _each(b: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """The design, outcomes, fold, and exposure as 0 and 1 by candidate, of each block in a batch."""
    for i in range(len(b)):
        y = np.frombuffer(b["y"][i].as_buffer())
        bits = np.frombuffer(b["exposed"][i].as_buffer(), np.uint8).reshape(len(y), -1)
        yield np.frombuffer(b["x"][i].as_buffer()).reshape(len(y), -1), y, b["fold"][i].as_py(), np.unpackbits(bits, axis=1, count=k).astype(np.float64)


def _upper(p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(p)


def _square(flat: np.ndarray, p: int) -> np.ndarray:
    """Symmetric matrices from their upper triangles, which are the last axis."""
    out = np.zeros((*flat.shape[:-1], p, p))
    i, j = _upper(p)
    out[..., i, j] = out[..., j, i] = flat
    return out


def _products(x: np.ndarray) -> np.ndarray:
    """The products of each row's values, as upper triangles."""
    p = x.shape[1]
    out, at = np.empty((len(x), p * (p + 1) // 2)), 0
    for i in range(p):
        np.multiply(x[:, i : i + 1], x[:, i:], out=out[:, at : at + p - i])
        at += p - i
    return out


def _summed(rows: DataFrame, sums, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of what ``sums`` returns for a batch, an array of this shape. A task sends its sum once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if len(b):
                total += sums(b)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "value"])

    out = np.zeros(int(np.prod(shape)))
    for b in rows.mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow().to_batches():
        out[b["at"].to_numpy()] = b["value"].to_numpy()
    return out.reshape(shape)


def _scales(n: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of columns from their counts, sums and sums of squares; the intercept and constant columns stay."""
    n = np.maximum(n, 1.0)[..., None]
    mean = first / n
    deviation = np.sqrt(np.maximum(second / n - mean**2, 0.0))
    deviation[deviation < 1e-8] = 1.0
    mean[..., 0], deviation[..., 0] = 0.0, 1.0
    return mean, deviation


@dataclass
class Nuisances:
    """Fitted models: by fold left out (the last leaves out none) and candidate, their coefficients on the raw columns."""

    candidates: list[str]
    folds: int
    exposed: np.ndarray
    fits: np.ndarray
    propensity: np.ndarray
    outcome: np.ndarray

    def place(self, fold: np.ndarray) -> np.ndarray:
        return np.where((fold >= 0) & (fold < self.folds), fold, self.folds)

    def scores(self, x: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row and candidate: whether there is a model, the propensity, and the outcome expected without and with exposure."""
        at, k = self.place(fold), len(self.candidates)
        fits, e, m0, m1 = np.zeros((len(x), k), bool), np.zeros((len(x), k)), np.zeros((len(x), k)), np.zeros((len(x), k))
        for f in np.unique(at):
            own = at == f
            fits[own] = self.fits[f]
            e[own] = np.clip(_sigmoid(x[own] @ self.propensity[f].T), FLOOR, CEILING)
            m0[own], m1[own] = x[own] @ self.outcome[f, :, 0].T, x[own] @ self.outcome[f, :, 1].T
        return fits, e, m0, m1

    def table(self, spark, names: list[str]) -> DataFrame:
        """(candidate, fold, model, column, coefficient) of all models, in long form, to be stored; names are those of the columns."""
        kinds = {"propensity": self.propensity, "outcome_unexposed": self.outcome[:, :, 0], "outcome_exposed": self.outcome[:, :, 1]}
        rows = [
            (c, NONE_OUT if f == self.folds else f, kind, name, float(v))
            for kind, b in kinds.items() for f in range(self.folds + 1) for i, c in enumerate(self.candidates) if self.fits[f, i] for name, v in zip(names, b[f, i], strict=True)
        ]
        return spark.createDataFrame(rows, "candidate string, fold int, model string, column string, coefficient double")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    out = np.clip(z, -30.0, 30.0)
    np.negative(out, out=out)
    np.exp(out, out=out)
    out += 1.0
    return np.reciprocal(out, out=out)


def fit(rows: DataFrame, candidates: list[str], folds: int, ridge: float = RIDGE, steps: int = STEPS) -> Nuisances:
    """The propensity and both outcome models of each candidate, without each fold and without none, on rows of :func:`rows_of`.

    Columns are standardised by the rows that a model is fitted on, and the penalty leaves the intercept alone. A candidate of fewer
    than LEAST_ARM exposed or unexposed decisions outside of a fold has no model there. rows are read once, and put into blocks that the passes read.
    """
    p, k = len(rows.select("x").first()["x"]) if not rows.isEmpty() else 1, len(candidates)
    width = p * (p + 1) // 2

    def moments(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((folds, k + 1, width + p))
        for x, y, f, a in _each(b, k):
            with_all = np.hstack([np.ones((len(y), 1)), a]).T
            out[f, :, :width] += with_all @ _products(x)
            out[f, :, width:] += with_all @ (x * y[:, None])
        return out

    blocks = cut(_blocks(rows, candidates, folds))
    m = _summed(blocks, moments, (folds, k + 1, width + p))
    left = np.concatenate([m.sum(0) - m, m.sum(0)[None]])  # by what is left out
    gram, xy = _square(left[..., :width], p), left[..., width:]
    n = gram[:, :, 0, 0]
    arms = np.stack([n[:, :1] - n[:, 1:], n[:, 1:]], -1)
    fits = (arms >= LEAST_ARM).all(-1)
    penalty = ridge * np.diag(np.r_[0.0, np.ones(p - 1)])

    outcome = np.zeros((folds + 1, k, 2, p))
    for arm, (g, v) in enumerate(((gram[:, :1] - gram[:, 1:], xy[:, :1] - xy[:, 1:]), (gram[:, 1:], xy[:, 1:]))):
        mean, deviation = _scales(g[..., 0, 0], g[..., 0, :], np.diagonal(g, axis1=-2, axis2=-1))
        # The standardised columns are the raw ones times this.
        turn = np.zeros((*mean.shape, p))
        turn[..., np.arange(p), np.arange(p)] = 1.0 / deviation
        turn[..., 0, 1:] = (-mean / deviation)[..., 1:]
        inner = np.swapaxes(turn, -1, -2) @ g @ turn + penalty
        inner[~fits] = np.eye(p)
        outcome[:, :, arm] = (turn @ np.linalg.solve(inner, (np.swapaxes(turn, -1, -2) @ v[..., None])))[..., 0]
    outcome[~fits] = 0.0

    whole = gram[:, 0]
    mean, deviation = _scales(whole[:, 0, 0], whole[:, 0], np.diagonal(whole, axis1=-2, axis2=-1))
    turn = np.zeros((folds + 1, p, p))
    turn[:, np.arange(p), np.arange(p)] = 1.0 / deviation
    turn[:, 0, 1:] = (-mean / deviation)[:, 1:]
    # Tasks work on columns scaled by all rows; a model's own are these times its step between the two.
    every = turn[folds]
    own = np.linalg.solve(every, turn)

    def sums(b: pa.RecordBatch, now: np.ndarray, todo: np.ndarray, apart: bool) -> np.ndarray:
        out = np.zeros((len(todo), k, p + width))
        for x, _, f, a in _each(b, k):
            there = (np.arange(len(todo)) == f)[:, None]
            of, which = np.nonzero(todo & (there if apart else ~there))
            if not len(of):
                continue
            z = x @ every
            e = _sigmoid(z @ now[of, which].T)
            out[of, which, :p] += (a[:, which] - e).T @ z
            out[of, which, p:] += (e * (1.0 - e)).T @ _products(z)
        return out

    def step(of: slice, s: np.ndarray) -> None:
        """A Newton step of the models that leave these folds out, from sums in the common columns."""
        across = own[of][:, None]
        back = np.swapaxes(across, -1, -2)
        inner = back @ _square(s[..., p:], p) @ across + penalty
        inner[~going[of]] = np.eye(p)
        d = np.linalg.solve(inner, back @ s[..., :p, None] - (beta[of] @ penalty)[..., None])[..., 0]
        d[~going[of]] = 0.0
        beta[of] += d
        going[of] &= np.abs(d).max(-1) >= CLOSE

    beta, going, whole_of, others = np.zeros((folds + 1, k, p)), fits.copy(), slice(folds, folds + 1), slice(0, folds)
    by_fold = None
    for _ in range(steps):
        if not going[folds].any():
            break
        # What leaves out nothing is summed by fold; models that are there already stay in, for the others' first step.
        now, todo = np.repeat(beta[whole_of], folds, 0), np.repeat(fits[whole_of], folds, 0)
        at = beta[folds].copy()
        by_fold = _summed(blocks, lambda b, now=now, todo=todo: sums(b, now, todo, True), (folds, k, p + width))
        step(whole_of, by_fold.sum(0)[None])
    if by_fold is not None:
        start = np.linalg.solve(own[:folds, None], at[None, ..., None])[..., 0]
        beta[others] = np.where(fits[others][..., None], start, 0.0)
        step(others, by_fold.sum(0) - by_fold)
    for _ in range(steps):
        if not going[others].any():
            break
        now, todo = np.einsum("fij,fkj->fki", own[others], beta[others]), going[others].copy()
        step(others, _summed(blocks, lambda b, now=now, todo=todo: sums(b, now, todo, False), (folds, k, p + width)))
    return Nuisances(list(candidates), folds, m.sum(0)[1:, 0], fits, np.einsum("fij,fkj->fki", turn, beta), outcome)


def _pseudo(b: pa.RecordBatch, fitted: Nuisances, names: pa.Array, epsilon: float, n_min: int) -> tuple[np.ndarray, ...]:
    """Of each row and candidate: the doubly robust value, the propensity, whether it is eligible, whether it was trimmed, exposure."""
    x, y, fold, a = _batch(b, names)
    fits, e, m0, m1 = fitted.scores(x, fold)
    enough = fits & (fitted.exposed >= n_min)
    ok = enough & (e >= epsilon) & (e <= 1.0 - epsilon)
    value = m1 - m0 + (a / e - (1.0 - a) / (1.0 - e)) * (y[:, None] - np.where(a > 0, m1, m0)) if len(x) else m0
    return np.where(ok, value, 0.0), e, ok, ~ok, a


def effects(rows: DataFrame, fitted: Nuisances, epsilon: float, n_min: int) -> DataFrame:
    """(candidate, tau, se, eligible, trimmed, exposed): the mean doubly robust value of the eligible rows and its error.

    A candidate that fewer than n_min decisions of the fit are exposed to, or that has no model without a row's fold, has that row
    trimmed, and so has a row of a propensity within epsilon of 0 or 1.
    """
    names, k = pa.array(fitted.candidates, pa.string()), len(fitted.candidates)

    def sums(b: pa.RecordBatch) -> np.ndarray:
        value, _, ok, trimmed, a = _pseudo(b, fitted, names, epsilon, n_min)
        return np.stack([value.sum(0), (value**2).sum(0), ok.sum(0), trimmed.sum(0), a.sum(0)], 1)

    s = _summed(rows, sums, (k, 5))
    n = np.maximum(s[:, 2], 1.0)
    tau = np.where(s[:, 2] > 0, s[:, 0] / n, np.nan)
    se = np.where(s[:, 2] > 0, np.sqrt(np.maximum(s[:, 1] / n - tau**2, 0.0) / n), np.nan)
    out = [(c, float(t), float(v), int(r[2]), int(r[3]), int(r[4])) for c, t, v, r in zip(fitted.candidates, tau, se, s, strict=True)]
    return rows.sparkSession.createDataFrame(out, "candidate string, tau double, se double, eligible bigint, trimmed bigint, exposed bigint")


def values(rows: DataFrame, fitted: Nuisances, epsilon: float, n_min: int) -> DataFrame:
    """(decision_id, candidate, propensity, value, exposed) of each eligible pair, one row each; other pairs are never formed on Spark.

    Rows of another fold than those of the fit, such as those of a site that was held out, are scored by the models of all folds.
    """
    names = pa.array(fitted.candidates, pa.string())
    id_type = rows.schema["decision_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, e, ok, _, a = _pseudo(b, fitted, names, epsilon, n_min)
            row, of = np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([b["decision_id"].take(pa.array(row)), names.take(pa.array(of)), pa.array(e[row, of]), pa.array(value[row, of]), pa.array(a[row, of] > 0)], names=["decision_id", "candidate", "propensity", "value", "exposed"])

    return rows.mapInArrow(run, f"decision_id {id_type}, candidate string, propensity double, value double, exposed boolean")


def catalogue(exposures: DataFrame) -> list[str]:
    """The candidates by name: as many as the catalogue has."""
    return [r.candidate for r in exposures.select("candidate").distinct().orderBy("candidate").collect()]
