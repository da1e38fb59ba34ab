"""Estimation, resampling and interaction read-outs; the emulation table is the engine's flagship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import nuisance
from tessera.operators.estimation import cox_hazard_ratio as _cox
from tessera.operators.estimation import cox_fit, cox_restricted_mean, effects
from tessera.operators.order import rank_within
from tessera.operators.resampling import DRAW, interval, replicates
from tessera.operators.survival import inverse_integral
from tessera.plans.cohort import FOLDS
from tessera.plans.graph import degree_terciles
from tessera.plans.ranking import EPSILON, N_MIN
from tessera.plans.survival import ARMED_CTE, armed
from tessera.sources.model import DECISION_CTE, EXPOSURE_CTE, PRESCRIBING, SCORED_CTE, covariates, decisions, exposed_candidates, exposed_lines, exposures, scored
from tessera.sources.stored import cut

CELL = ["fold", "site", "ecog", "prior_bucket", "c_mktsegment"]


#: The censoring curve's covariates, and the value it isn't believed below.
CENSORING, FLOOR = ["ecog", "prior_bucket"], 0.05


def _folded(spark, sf_dir, augment: bool = False) -> DataFrame:
    """Development decisions with a fold that is a function of the patient, and their outcome."""
    fold = ((F.col("patient_id") * 7919 + 104729) % 1000003 % FOLDS).cast("int")
    return with_outcome(decisions(spark, sf_dir).where("split = 'development'").withColumn("fold", fold), augment)


def with_outcome(d: DataFrame, augment: bool = False) -> DataFrame:
    """d with ``y``: the integral of 1 / G up to the restricted time, G the survival of censoring among the other folds.

    Its mean is that of the restricted time without censoring: a decision that was lost stands for those like it that were not.
    G is a curve for each fold and censoring key. Its knots are the distinct times of the key and the horizons, so every
    restricted time is one, and the integrals up to the knots go to the decisions by an equi-join.

    With ``augment``, y also has the integral of Q / G over the decision's censoring martingale, Q(u) being the mean restricted time of
    the other folds' decisions that are followed until u: what was lost adds Q / G at its time, and everybody gives off Q / G times
    the hazard of being lost for as long as followed. Both terms are sums up to a knot of the same curves, so that each
    decision still looks up one knot. The integral's mean is zero where G is right; Q being of whole times, not of what is
    left of them, it adds to the spread. A censoring key has one horizon; being followed beyond it isn't being lost.
    """
    at = d.groupBy(*CENSORING, "fold", F.col("follow_up_months").alias("t")).agg(F.count("*").alias("n"), F.count_if(~F.col("event")).alias("lost"))
    ends = d.select(*CENSORING, F.col("horizon_months").alias("t"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("lost")).distinct()
    whole = at.select(*ends.columns).union(ends).groupBy(*CENSORING, "t").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))
    each = whole.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).join(at.withColumnsRenamed({"n": "own", "lost": "own_lost"}), [*CENSORING, "fold", "t"], "left").fillna(0, ["own", "own_lost"])
    other = each.select(*CENSORING, "fold", "t", (F.col("n") - F.col("own")).alias("n"), (F.col("lost") - F.col("own_lost")).alias("deaths"))
    knots = inverse_integral(other, [*CENSORING, "fold"], FLOOR)
    plain = [*CENSORING, "fold", "t", F.col("integral").alias("y")]
    met = d.withColumn("t", F.least("follow_up_months", "horizon_months"))
    if not augment:
        return met.join(knots.select(*plain), [*CENSORING, "fold", "t"]).drop("t")
    w = Window.partitionBy(*CENSORING, "fold")
    knots = knots.join(d.groupBy(*CENSORING).agg(F.max("horizon_months").alias("_end")), CENSORING)
    q = F.try_divide(F.sum(F.col("n") * F.least("t", "_end")).over(w.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)), F.col("at_risk"))
    knots = knots.withColumn("_jump", F.coalesce(q / F.greatest(F.coalesce(F.lag("survival").over(w.orderBy("t")), F.lit(1.0)), F.lit(FLOOR)), F.lit(0.0)))
    hazard = F.coalesce(F.try_divide("deaths", F.col("at_risk")), F.lit(0.0))
    given = F.sum(F.when(F.col("t") < F.col("_end"), F.col("_jump") * hazard).otherwise(0.0)).over(w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    knots = knots.withColumn("_given", given)
    met = met.join(knots.select(*plain, "_jump", "_given"), [*CENSORING, "fold", "t"])
    lost = F.when(~F.col("event") & (F.col("follow_up_months") < F.col("horizon_months")), F.col("_jump")).otherwise(0.0)
    return met.withColumn("y", F.col("y") + lost - F.col("_given")).drop("t", "_jump", "_given")


def held_out_outcome(d: DataFrame) -> DataFrame:
    """The held-out site's decisions with ``y`` by the censoring curves of all development decisions.

    The knots of a curve are its own distinct times and the restricted times that are asked for.
    """
    own, out = d.where("split = 'development'"), d.where("split = 'held_out'").withColumn("t", F.least("follow_up_months", "horizon_months"))
    at = own.groupBy(*CENSORING, F.col("follow_up_months").alias("t")).agg(F.count("*").alias("n"), F.count_if(~F.col("event")).alias("deaths"))
    none = F.lit(0).cast("bigint")
    asked = out.select(*CENSORING, "t").distinct().join(own.select(*CENSORING).distinct(), CENSORING, "left_semi")
    steps = at.union(asked.select("*", none.alias("n"), none.alias("deaths"))).groupBy(*CENSORING, "t").agg(F.sum("n").alias("n"), F.sum("deaths").alias("deaths"))
    knots = inverse_integral(steps, CENSORING, FLOOR).select(*CENSORING, "t", F.col("integral").alias("y"))
    return out.join(knots, [*CENSORING, "t"]).drop("t")


def cells(d: DataFrame, x: DataFrame, cell: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counts, sums and sums of squares of the outcome: of all per cell, and of the exposed per candidate and cell.

    Only the long exposure rows meet the decisions, and are summed at once; no (decision, candidate) product is formed.
    """
    sums = lambda s: [F.count("*").alias(f"n{s}"), F.sum("y").alias(f"y{s}"), F.sum(F.col("y") * F.col("y")).alias(f"yy{s}")]
    return d.groupBy(*cell).agg(*sums("")), x.join(d, "decision_id").groupBy("candidate", *cell).agg(*sums("1"))


def effect_table(d: DataFrame, x: DataFrame) -> DataFrame:
    """Per candidate of x (decision_id, candidate): the cross-fitted doubly robust effect over d, see :func:`effects`.

    A candidate's cells are all cells, of which the covariates bound the number, whatever the number of decisions; the
    unexposed follow by subtraction.
    """
    total, exposed = cells(d, x, CELL)
    every = exposed.select("candidate").distinct().crossJoin(total)
    return effects(every.join(exposed, ["candidate", *CELL], "left").fillna(0, ["n1", "y1", "yy1"]), CELL[1:], EPSILON, N_MIN)


def _fitted(spark, sf_dir, augment: bool = False) -> tuple[DataFrame, nuisance.Nuisances]:
    """The development decisions' rows, written, and the models of all candidates without each fold and without none."""
    x = exposed_lines(spark, sf_dir)
    d = _folded(spark, sf_dir, augment).select("decision_id", "fold", "y").join(covariates(spark, sf_dir), "decision_id")
    rows = cut(nuisance.rows_of(d, x, PRESCRIBING))
    return rows, nuisance.fit(rows, nuisance.catalogue(exposed_candidates(spark, sf_dir)), FOLDS)


def emulation_table(spark, sf_dir, augment: bool = False):
    """Per candidate: cross-fitted doubly robust effect on restricted months, error, eligible, trimmed and exposed counts.

    Propensities are logistic and outcome models ridge fits on sixteen covariates, each without the fold that it scores. Censoring is
    accounted for by the inverse integral in the outcome, to which ``augment`` adds that over the censoring martingale.
    """
    rows, fitted = _fitted(spark, sf_dir, augment)
    e = nuisance.effects(rows, fitted, EPSILON, N_MIN)
    return e.select("candidate", F.round("tau", 6).alias("tau"), F.round("se", 6).alias("se"), "eligible", "trimmed", "exposed")


def augmented_effects(spark, sf_dir):
    """The emulation table with the augmented outcome."""
    return emulation_table(spark, sf_dir, augment=True)


def augmented_outcome(spark, sf_dir):
    """Per censoring key, the mean and deviation of the outcome as it is and augmented: the means are about equal."""
    keys = [*CENSORING, "line"]
    each = lambda augment, name: _folded(spark, sf_dir, augment).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("y"), 5).alias(name), F.round(F.stddev_samp("y"), 5).alias(f"{name}_sd"))
    return each(False, "plain").join(each(True, "augmented").drop("n"), keys)


def held_out_effects(spark, sf_dir):
    """The same of the held-out site: its decisions are scored by models of the development ones, and change none of them."""
    _, fitted = _fitted(spark, sf_dir)
    d = held_out_outcome(decisions(spark, sf_dir)).select("decision_id", "y").join(covariates(spark, sf_dir), "decision_id").withColumn("fold", F.lit(nuisance.NONE_OUT))
    rows = nuisance.rows_of(d, exposed_lines(spark, sf_dir), PRESCRIBING)
    e = nuisance.effects(cut(rows), fitted, EPSILON, N_MIN)
    return e.select("candidate", F.round("tau", 6).alias("tau"), F.round("se", 6).alias("se"), "eligible", "trimmed", "exposed")


def pseudo_outcomes(spark, sf_dir):
    """Each eligible development decision's propensity and doubly robust value for each candidate."""
    rows, fitted = _fitted(spark, sf_dir)
    v = nuisance.values(rows, fitted, EPSILON, N_MIN)
    return v.select("decision_id", "candidate", F.round("propensity", 6).alias("propensity"), F.round("value", 6).alias("value"), "exposed")


def saturated_effects(spark, sf_dir):
    """The same estimator with cell shares and means of the other folds as its nuisances, in DataFrame operations only."""
    cell = ["fold", "ecog", "prior_bucket"]
    total, exposed = cells(_folded(spark, sf_dir), exposures(spark, sf_dir), cell)
    # Where no fold has an exposed decision there is no model of the exposed: such cells drop out anyway.
    seen = exposed.select("candidate", "ecog", "prior_bucket").distinct().join(total, ["ecog", "prior_bucket"])
    c = seen.join(exposed, ["candidate", *cell], "left").fillna(0, ["n1", "y1", "yy1"])
    w = Window.partitionBy("candidate", "ecog", "prior_bucket")
    out = lambda k: F.sum(k).over(w) - F.col(k)
    c = c.select("candidate", *cell, "n", "y", "n1", "y1", *[out(k).alias(f"o_{k}") for k in ("n", "y", "n1", "y1")])
    c = c.withColumn("e", F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.try_divide("o_n1", F.col("o_n"))))).withColumn("m1", F.try_divide("o_y1", F.col("o_n1"))).withColumn("m0", F.try_divide(F.col("o_y") - F.col("o_y1"), F.col("o_n") - F.col("o_n1")))
    c = c.where("m1 is not null and m0 is not null and e >= 0.05 and e <= 0.95")
    g = (F.col("m1") - F.col("m0")) * F.col("n") + (F.col("y1") - F.col("n1") * F.col("m1")) / F.col("e") - ((F.col("y") - F.col("y1")) - (F.col("n") - F.col("n1")) * F.col("m0")) / (1 - F.col("e"))
    return c.groupBy("candidate").agg(F.round(F.sum(g) / F.sum("n"), 6).alias("tau"), F.sum("n").alias("eligible"))


def ridge_gram(spark, sf_dir):
    """Normal equations of restricted time on four columns per arm, in long form: what a ridge fit needs of any number of rows."""
    cols = ["one", "ecog", "prior_bucket", "balance"]
    d = armed(spark, sf_dir).select("exposed", F.lit(1.0).alias("one"), F.col("ecog").cast("double").alias("ecog"), F.col("prior_bucket").cast("double").alias("prior_bucket"), (F.col("c_acctbal") / 1000.0).alias("balance"), F.least("follow_up_months", "horizon_months").alias("y"))
    pairs = [(a, b) for i, a in enumerate(cols) for b in [*cols[i:], "y"]]
    one = d.groupBy("exposed").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs])
    return one.unpivot(["exposed"], [f"{a}*{b}" for a, b in pairs], "entry", "value").select("exposed", "entry", F.round("value", 3).alias("value"))


def cox_hazard_ratio(spark, sf_dir):
    d = armed(spark, sf_dir).select("follow_up_months", "event", "exposed")
    beta, se = _cox(d, "follow_up_months", "event", "exposed")
    return spark.createDataFrame([(round(beta, 6), round(se, 6))], "log_hr double, se double").select(F.round(F.exp("log_hr"), 6).alias("hazard_ratio"), F.round(F.exp(F.col("log_hr") - 1.959964 * F.col("se")), 6).alias("lower"), F.round(F.exp(F.col("log_hr") + 1.959964 * F.col("se")), 6).alias("upper"))


def cox_outcome_model(spark, sf_dir):
    """A Cox outcome model on exposure and covariates, and its restricted mean and survival at the horizon for every covariate cell."""
    xs = ["exposed", "ecog", "prior_bucket"]
    d = armed(spark, sf_dir).select("follow_up_months", "event", "horizon_months", *xs)
    beta, _, baseline = cox_fit(d, "follow_up_months", "event", xs, ridge=1.0)
    eta = sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta, xs, strict=True)), F.lit(0.0))
    points = d.select(*xs, "horizon_months").distinct()
    return cox_restricted_mean(points, baseline, eta, "horizon_months", [*xs, "horizon_months"]).select(*xs, "horizon_months", F.round("rmst", 6).alias("rmst"), F.round("survival", 6).alias("survival"))


def placebo_permutation(spark, sf_dir):
    """Exposure dealt anew within each site in the order of a hash: the contrast it leaves should be about nothing."""
    d = armed(spark, sf_dir).withColumn("y", F.least("follow_up_months", "horizon_months")).withColumn("h", (F.col("decision_id") * 7919 + 104729) % 1000003)
    a = rank_within(d.select("site", "exposed", "h", "decision_id"), ["site"], "h", "decision_id", "k").select("site", "exposed", "k")
    b = rank_within(d.select("site", "y", "decision_id"), ["site"], "decision_id", "decision_id", "k").select("site", "y", "k")
    j = a.join(b, ["site", "k"])
    arm = lambda x: F.avg(F.when(F.col("exposed") == x, F.col("y")))
    return j.groupBy("site").agg(F.round(arm(1) - arm(0), 6).alias("contrast"), F.sum("exposed").alias("exposed"))


REPS = 20


def bootstrap_ci(spark, sf_dir):
    """Percentile interval of mean follow-up, decisions drawn with replacement within their site."""
    d = decisions(spark, sf_dir).select("site", "decision_id", "follow_up_months")
    mean = F.sum(F.round(F.col("follow_up_months") * 100).cast("bigint") * F.col("times")) / F.sum("times") / 100.0
    q = interval(replicates(d, "site", "decision_id", {"m": mean}, REPS), "m")
    return q.crossJoin(d.agg(F.avg("follow_up_months").alias("point"))).select(F.round("point", 6).alias("point"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "reps")


def _normal_tail(z: Column) -> Column:
    """Two-sided normal tail by the fixed polynomial for erf."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def paired_seed_test(spark, sf_dir):
    """Sites as the pairs: mean follow-up on the second line against the first, normal tail."""
    m = decisions(spark, sf_dir).groupBy("site").agg((F.avg(F.when(F.col("line") == "second", F.col("follow_up_months"))) - F.avg(F.when(F.col("line") == "first", F.col("follow_up_months")))).alias("d"))
    s = m.agg(F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))
    return s.select(F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round(_normal_tail(F.col("mean") / F.col("se")), 6).alias("p"))


def tercile_summary(spark, sf_dir):
    """Scores by the degree tercile of their candidate, all three terciles present."""
    t = degree_terciles(spark, sf_dir).select(F.substring_index("node", ":", -1).alias("candidate"), "tercile")
    s = scored(spark, sf_dir).join(t, "candidate").groupBy("tercile").agg(F.round(F.avg("score"), 6).alias("gain"), F.count("*").alias("size"), F.count_distinct("candidate").alias("candidates"))
    return spark.createDataFrame([("lowest",), ("middle",), ("highest",)], "tercile string").join(s, "tercile", "left").select("tercile", F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("size", F.lit(0).cast("bigint")).alias("size"), F.coalesce("candidates", F.lit(0).cast("bigint")).alias("candidates"))


def unadjusted_contrast(spark, sf_dir):
    """Plain exposed minus unexposed means for every candidate, from sums and subtraction."""
    d = decisions(spark, sf_dir).withColumn("y", F.least("follow_up_months", "horizon_months"))
    total = d.agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    x = exposures(spark, sf_dir).join(d.select("decision_id", "y"), "decision_id").groupBy("candidate").agg(F.count("*").alias("n1"), F.sum("y").alias("y1"))
    return x.crossJoin(F.broadcast(total)).select("candidate", "n1", F.round(F.col("y1") / F.col("n1") - (F.col("y") - F.col("y1")) / (F.col("n") - F.col("n1")), 6).alias("contrast"))


_A = f"WITH {ARMED_CTE}"
_GRAM = " UNION ALL ".join(
    f"SELECT exposed, '{a}*{b}' AS entry, ROUND(SUM({a} * {b}), 3) AS value FROM x GROUP BY 1"
    for i, a in enumerate(("one", "ecog", "prior_bucket", "balance")) for b in [*("one", "ecog", "prior_bucket", "balance")[i:], "y"]
)
_OUTCOME = f"""d0 AS (SELECT *, (patient_id * 7919 + 104729) % 1000003 % {FOLDS} AS fold FROM decision WHERE split = 'development'),
cn AS (SELECT ecog, prior_bucket, fold, follow_up_months AS t, COUNT(*) AS n, COUNT(*) FILTER (NOT event) AS lost FROM d0 GROUP BY ALL),
ca AS (SELECT ecog, prior_bucket, t, SUM(n) AS n, SUM(lost) AS lost FROM (SELECT ecog, prior_bucket, t, n, lost FROM cn UNION ALL SELECT DISTINCT ecog, prior_bucket, horizon_months, 0, 0 FROM d0) GROUP BY ALL),
co AS (SELECT ca.ecog, ca.prior_bucket, ca.t, f.fold, ca.n - COALESCE(cn.n, 0) AS n, ca.lost - COALESCE(cn.lost, 0) AS lost FROM ca CROSS JOIN (SELECT unnest(range({FOLDS})) AS fold) f LEFT JOIN cn ON cn.ecog = ca.ecog AND cn.prior_bucket = ca.prior_bucket AND cn.t = ca.t AND cn.fold = f.fold),
cr AS (SELECT *, SUM(n) OVER (PARTITION BY ecog, prior_bucket, fold ORDER BY t DESC) AS at_risk FROM co),
cg AS (SELECT *, product(1.0 - COALESCE(CAST(lost AS DOUBLE) / NULLIF(at_risk, 0), 0.0)) OVER (PARTITION BY ecog, prior_bucket, fold ORDER BY t) AS g FROM cr),
cp AS (SELECT *, (t - COALESCE(lag(t) OVER w, 0.0)) / GREATEST(COALESCE(lag(g) OVER w, 1.0), {FLOOR}) AS piece FROM cg WINDOW w AS (PARTITION BY ecog, prior_bucket, fold ORDER BY t)),
ci AS (SELECT *, SUM(piece) OVER (PARTITION BY ecog, prior_bucket, fold ORDER BY t) AS y FROM cp),
d AS (SELECT d0.*, ci.y FROM d0 JOIN ci ON ci.ecog = d0.ecog AND ci.prior_bucket = d0.prior_bucket AND ci.fold = d0.fold AND ci.t = LEAST(follow_up_months, horizon_months))"""
_AUGMENT = f"""cq AS (SELECT cg.*, h, SUM(n * LEAST(t, h)) OVER (PARTITION BY ecog, prior_bucket, fold ORDER BY t DESC) / NULLIF(at_risk, 0) / GREATEST(COALESCE(lag(g) OVER (PARTITION BY ecog, prior_bucket, fold ORDER BY t), 1.0), {FLOOR}) AS jump
  FROM cg JOIN (SELECT ecog, prior_bucket, MAX(horizon_months) AS h FROM d0 GROUP BY ALL) USING (ecog, prior_bucket)),
cs AS (SELECT *, SUM(CASE WHEN t < h THEN COALESCE(jump * lost / NULLIF(at_risk, 0), 0.0) ELSE 0.0 END) OVER (PARTITION BY ecog, prior_bucket, fold ORDER BY t) AS given FROM cq),
da AS (SELECT d.*, d.y + CASE WHEN NOT event AND follow_up_months < horizon_months THEN COALESCE(jump, 0.0) ELSE 0.0 END - given AS ya FROM d
  JOIN cs ON cs.ecog = d.ecog AND cs.prior_bucket = d.prior_bucket AND cs.fold = d.fold AND cs.t = LEAST(follow_up_months, horizon_months))"""
_TAIL = "((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * EXP(-x * x)"
QUERIES = {f.__name__: f for f in (emulation_table, augmented_effects, augmented_outcome, held_out_effects, pseudo_outcomes, saturated_effects, ridge_gram, cox_hazard_ratio, cox_outcome_model, placebo_permutation, bootstrap_ci, paired_seed_test, tercile_summary, unadjusted_contrast)}
SQL = {
    "augmented_outcome": f"""WITH {DECISION_CTE}, {_OUTCOME}, {_AUGMENT}
SELECT ecog, prior_bucket, line, COUNT(*) AS n, ROUND(AVG(y), 5) AS plain, ROUND(STDDEV_SAMP(y), 5) AS plain_sd, ROUND(AVG(ya), 5) AS augmented, ROUND(STDDEV_SAMP(ya), 5) AS augmented_sd FROM da GROUP BY 1, 2, 3""",
    "saturated_effects": f"""WITH {DECISION_CTE}, {EXPOSURE_CTE}, {_OUTCOME},
t AS (SELECT fold, ecog, prior_bucket, COUNT(*) AS n, SUM(y) AS y FROM d GROUP BY 1, 2, 3), x AS (SELECT candidate, fold, ecog, prior_bucket, COUNT(*) AS n1, SUM(y) AS y1 FROM exposure JOIN d USING (decision_id) GROUP BY ALL),
c AS (SELECT k.candidate, t.*, COALESCE(n1, 0) AS n1, COALESCE(y1, 0) AS y1 FROM (SELECT DISTINCT candidate FROM x) k CROSS JOIN t LEFT JOIN x ON x.candidate = k.candidate AND x.fold = t.fold AND x.ecog = t.ecog AND x.prior_bucket = t.prior_bucket),
o AS (SELECT *, SUM(n) OVER w - n AS o_n, SUM(y) OVER w - y AS o_y, SUM(n1) OVER w - n1 AS o_n1, SUM(y1) OVER w - y1 AS o_y1 FROM c WINDOW w AS (PARTITION BY candidate, ecog, prior_bucket)),
e AS (SELECT *, GREATEST(0.01, LEAST(0.99, CAST(o_n1 AS DOUBLE) / NULLIF(o_n, 0))) AS e, o_y1 / NULLIF(o_n1, 0) AS m1, (o_y - o_y1) / NULLIF(o_n - o_n1, 0) AS m0 FROM o)
SELECT candidate, ROUND(SUM((m1 - m0) * n + (y1 - n1 * m1) / e - ((y - y1) - (n - n1) * m0) / (1 - e)) / SUM(n), 6) AS tau, CAST(SUM(n) AS BIGINT) AS eligible FROM e WHERE m1 IS NOT NULL AND m0 IS NOT NULL AND e BETWEEN 0.05 AND 0.95 GROUP BY 1""",
    "cox_hazard_ratio": f"""WITH RECURSIVE {ARMED_CTE}, n AS (SELECT follow_up_months AS t, CAST(exposed AS DOUBLE) AS x, COUNT(*) AS n, COUNT(*) FILTER (event) AS d FROM armed GROUP BY 1, 2),
s AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS beta, CAST(0 AS DOUBLE) AS info UNION ALL
  SELECT k + 1, beta + SUM(dx - d * s1 / s0) / SUM(d * (s2 / s0 - s1 * s1 / (s0 * s0))), SUM(d * (s2 / s0 - s1 * s1 / (s0 * s0))) FROM (
    SELECT k, beta, d, dx, SUM(e) OVER w AS s0, SUM(e1) OVER w AS s1, SUM(e2) OVER w AS s2 FROM (
      SELECT k, beta, t, SUM(d) AS d, SUM(d * x) AS dx, SUM(n * EXP(beta * x)) AS e, SUM(n * EXP(beta * x) * x) AS e1, SUM(n * EXP(beta * x) * x * x) AS e2 FROM s, n WHERE k < 12 GROUP BY k, beta, t)
    WINDOW w AS (PARTITION BY k ORDER BY t DESC)) GROUP BY k, beta)
SELECT ROUND(EXP(ROUND(beta, 6)), 6) AS hazard_ratio, ROUND(EXP(ROUND(beta, 6) - 1.959964 * ROUND(1 / SQRT(info), 6)), 6) AS lower, ROUND(EXP(ROUND(beta, 6) + 1.959964 * ROUND(1 / SQRT(info), 6)), 6) AS upper FROM s WHERE k = 12""",
    "ridge_gram": f"{_A}, x AS (SELECT exposed, 1.0 AS one, ecog, prior_bucket, c_acctbal / 1000.0 AS balance, LEAST(follow_up_months, horizon_months) AS y FROM armed) {_GRAM}",
    "placebo_permutation": f"""{_A}, a AS (SELECT site, exposed, row_number() OVER (PARTITION BY site ORDER BY (decision_id * 7919 + 104729) % 1000003, decision_id) AS k FROM armed), b AS (SELECT site, LEAST(follow_up_months, horizon_months) AS y, row_number() OVER (PARTITION BY site ORDER BY decision_id) AS k FROM armed)
SELECT site, ROUND(AVG(y) FILTER (exposed = 1) - AVG(y) FILTER (exposed = 0), 6) AS contrast, CAST(SUM(exposed) AS BIGINT) AS exposed FROM a JOIN b USING (site, k) GROUP BY 1""",
    "bootstrap_ci": f"""WITH {DECISION_CTE}, v AS (SELECT site, follow_up_months, row_number() OVER (PARTITION BY site ORDER BY decision_id) - 1 AS k, COUNT(*) OVER (PARTITION BY site) AS n FROM decision),
w AS (SELECT site, rep, {DRAW} AS k FROM v, unnest(range({REPS})) AS r(rep)), m AS (SELECT rep, CAST(SUM(CAST(ROUND(follow_up_months * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) / 100.0 AS m FROM w JOIN (SELECT site, k, follow_up_months FROM v) USING (site, k) GROUP BY 1)
SELECT (SELECT ROUND(AVG(follow_up_months), 6) FROM decision) AS point, ROUND(quantile_cont(m, 0.025), 6) AS lower, ROUND(quantile_cont(m, 0.975), 6) AS upper, COUNT(*) AS reps FROM m""",
    "paired_seed_test": f"""WITH {DECISION_CTE}, m AS (SELECT AVG(follow_up_months) FILTER (line = 'second') - AVG(follow_up_months) FILTER (line = 'first') AS d FROM decision GROUP BY site), s AS (SELECT AVG(d) AS mean, STDDEV_SAMP(d) / SQRT(COUNT(*)) AS se FROM m),
x AS (SELECT *, ABS(mean / se) / SQRT(2.0) AS x FROM s), t AS (SELECT *, CAST(1.0 AS DOUBLE) / (1.0 + CAST(0.3275911 AS DOUBLE) * x) AS t FROM x) SELECT ROUND(mean, 6) AS mean, ROUND(se, 6) AS se, ROUND({_TAIL}, 6) AS p FROM t""",
    "tercile_summary": None,
    "unadjusted_contrast": f"""WITH {DECISION_CTE}, {EXPOSURE_CTE}, d AS (SELECT decision_id, LEAST(follow_up_months, horizon_months) AS y FROM decision), t AS (SELECT COUNT(*) AS n, SUM(y) AS y FROM d), x AS (SELECT candidate, COUNT(*) AS n1, SUM(y) AS y1 FROM exposure JOIN d USING (decision_id) GROUP BY 1)
SELECT candidate, n1, ROUND(y1 / n1 - (y - y1) / (n - n1), 6) AS contrast FROM x, t""",
}


def _tercile_sql() -> str:
    from tessera.plans.graph import SQL as GRAPH

    graph = GRAPH["degree_terciles"]
    return f"""WITH g AS ({graph}), {SCORED_CTE}, s AS (SELECT tercile, ROUND(AVG(score), 6) AS gain, COUNT(*) AS size, COUNT(DISTINCT candidate) AS candidates FROM scored JOIN g ON g.node = 'candidate:' || candidate GROUP BY 1)
SELECT d.tercile, COALESCE(gain, 0.0) AS gain, COALESCE(size, 0) AS size, COALESCE(candidates, 0) AS candidates FROM (VALUES ('lowest'), ('middle'), ('highest')) AS d(tercile) LEFT JOIN s USING (tercile)"""


SQL["tercile_summary"] = _tercile_sql()
