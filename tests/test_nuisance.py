"""Batched fits on continuous covariates against dense ones, decision by decision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import nuisance as N

FOLDS, NAMES, COVARIATES = 3, ["a", "b", "rare"], ["u", "v", "w", "same"]


def data(n=240, seed=4):
    rng = np.random.default_rng(seed)
    u, v, w = rng.normal(3, 2, n), rng.integers(0, 3, n).astype(float), rng.normal(0, 0.1, n)
    p = 1 / (1 + np.exp(-(0.4 * (u - 3) - 0.5 * v)))
    a, b = rng.random(n) < p, rng.random(n) < 0.4
    rare = np.zeros(n, bool)
    rare[[0, 3, 4, 9]] = True
    y = 2 + 0.5 * u - v + 0.8 * a + rng.normal(0, 1, n)
    return np.stack([u, v, w, np.ones(n)], 1), np.stack([a, b, rare], 1), y, np.arange(n) % FOLDS


def frames(spark, x, a, y, fold, start=0):
    d = spark.createDataFrame([(start + i, int(fold[i]), float(y[i]), *map(float, x[i])) for i in range(len(y))], ["decision_id", "fold", "y", *COVARIATES])
    e = spark.createDataFrame([(start + int(i), NAMES[j]) for i, j in zip(*np.nonzero(a), strict=True)] + [(start, "not in the catalogue")], "decision_id long, candidate string")
    return N.rows_of(d.withColumn("x", F.lit("clash")).repartition(3), e, COVARIATES, quadratic=("u",))


def scaled(x):
    m, s = x.mean(0), x.std(0)
    s[s < 1e-8] = 1.0
    m[0], s[0] = 0.0, 1.0
    return m, s


def logistic(x, hit, ridge=1.0):
    m, s = scaled(x)
    z, beta, pen = (x - m) / s, np.zeros(x.shape[1]), ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(60):
        e = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve((z.T * (e * (1 - e))) @ z + pen, z.T @ (hit - e) - pen @ beta)
    return lambda x: np.clip(1 / (1 + np.exp(-((x - m) / s) @ beta)), 0.01, 0.99)


def regression(x, y, ridge=1.0):
    m, s = scaled(x)
    z = (x - m) / s
    beta = np.linalg.solve(z.T @ z + ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)]), z.T @ y)
    return lambda x: ((x - m) / s) @ beta


def dense(x, a, y, fold, new=None, epsilon=0.05, n_min=5):
    """Values of the eligible pairs, by loops over folds and candidates."""
    design = lambda x: np.hstack([np.ones((len(x), 1)), x, x[:, :1] ** 2])
    full, out = design(x), {}
    scored, of, ay, yy = (full, fold, a, y) if new is None else (design(new[0]), np.full(len(new[2]), -1), new[1], new[2])
    for f in np.unique(of):
        tr = fold != f
        for j, name in enumerate(NAMES):
            hit = a[:, j]
            if a[:, j].sum() < n_min or hit[tr].sum() < 3 or (~hit[tr]).sum() < 3:
                continue
            e, m1, m0 = logistic(full[tr], hit[tr]), regression(full[tr & hit], y[tr & hit]), regression(full[tr & ~hit], y[tr & ~hit])
            for i in np.flatnonzero(of == f):
                r = scored[i : i + 1]
                p, one, none = float(e(r)[0]), float(m1(r)[0]), float(m0(r)[0])
                if epsilon <= p <= 1 - epsilon:
                    out[i, name] = p, one - none + ((yy[i] - one) / p if ay[i, j] else -(yy[i] - none) / (1 - p)), bool(ay[i, j])
    return out


def got(frame, start=0):
    return {(r.decision_id - start, r.candidate): (r.propensity, r.value, r.exposed) for r in frame.collect()}


def same(one, two):
    assert one.keys() == two.keys() and all(one[k][:2] == pytest.approx(two[k][:2], rel=1e-6, abs=1e-8) and one[k][2] == two[k][2] for k in one)


@pytest.fixture(scope="module")
def fitted(spark):
    rows = frames(spark, *data()).cache()
    return rows, N.fit(rows, NAMES, FOLDS)


def test_values_equal_dense_fits(fitted):
    rows, models = fitted
    want = dense(*data())
    assert len(want) > 400 and not any(name == "rare" for _, name in want)
    same(got(N.values(rows, models, 0.05, 5)), want)


def test_rare_candidates_have_models_only_where_both_arms_do(fitted):
    rows, models = fitted
    # Four exposed decisions, in folds 0, 0, 1 and 0: without fold 0 only one is left.
    assert models.fits[:, 2].tolist() == [False, True, True, True]
    same(got(N.values(rows, models, 0.001, 1)), dense(*data(), epsilon=0.001, n_min=1))


def test_effects_are_means_of_the_values(fitted):
    rows, models = fitted
    want = dense(*data())
    for r in N.effects(rows, models, 0.05, 5).collect():
        v = np.array([x[1] for (_, name), x in want.items() if name == r.candidate])
        assert (r.eligible, r.trimmed, r.exposed) == (len(v), 240 - len(v), int(data()[1][:, NAMES.index(r.candidate)].sum()))
        if len(v):
            assert r.tau == pytest.approx(v.mean()) and r.se == pytest.approx(v.std() / len(v) ** 0.5)
        else:
            assert np.isnan(r.tau) and np.isnan(r.se)


def test_another_site_is_scored_by_the_models_of_all_and_changes_none(spark, fitted):
    _, models = fitted
    x, a, y, _ = data(50, 9)
    rows = frames(spark, x, a, y, np.full(50, N.NONE_OUT), 1000)
    same(got(N.values(rows, models, 0.05, 5), 1000), dense(*data(), new=(x, a, y)))


def test_models_are_stored_in_long_form(spark, fitted):
    _, models = fitted
    t = models.table(spark, ["one", *COVARIATES, "u*u"])
    assert t.count() == 3 * 6 * int(models.fits.sum()) and t.where("fold = -1 and candidate = 'a' and model = 'propensity'").count() == 6


def test_what_is_shuffled_does_not_grow_with_rows(spark, fitted):
    rows, _ = fitted
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("copy")
    one, more = N.fit(rows, NAMES, FOLDS, steps=3), N.fit(many, NAMES, FOLDS, steps=3, ridge=20.0)
    # Twenty times the rows and the penalty: the same models.
    fits = one.fits
    assert np.allclose(one.propensity[fits], more.propensity[fits]) and np.allclose(one.outcome[fits], more.outcome[fits]) and (more.exposed == 20 * one.exposed).all()


def test_nulls_empty_and_no_exposure(spark):
    d = spark.createDataFrame([(1, 0, 1.0, None), (2, 1, None, 2.0)], "decision_id long, fold int, y double, u double")
    x = spark.createDataFrame([], "decision_id long, candidate string")
    rows = N.rows_of(d, x, ["u"])
    assert [(r.decision_id, r.x, r.exposed) for r in rows.collect()] == [(1, [1.0, 0.0], [])]
    models = N.fit(rows, ["a"], 2)
    assert not models.fits.any() and N.values(rows, models, 0.05, 1).count() == 0
    assert [tuple(r)[3:] for r in N.effects(rows, models, 0.05, 1).collect()] == [(0, 1, 0)]
    assert N.fit(rows.where("false"), ["a"], 2).exposed.tolist() == [0.0]


def test_a_fit_reads_its_rows_once_and_takes_few_passes(spark, monkeypatch):
    rows, read, passes = frames(spark, *data()), spark.sparkContext.accumulator(0), []

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    summed = N._summed
    monkeypatch.setattr(N, "_summed", lambda *args: passes.append(args[2]) or summed(*args))
    N.fit(rows.mapInArrow(counted, rows.schema), NAMES, FOLDS)
    # Looking for the first row takes a few more; all passes are over the blocks, and none sums what leaves out nothing beside the others.
    assert read.value < 3 * 240 and len(passes) > 3 and all(shape[0] == FOLDS for shape in passes)
