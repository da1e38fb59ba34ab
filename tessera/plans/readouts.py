"""Further read-outs: lookups between knots, agreement, intervals, sensitivity over all candidates, features, panels and criteria."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.operators import survival as S
from tessera.operators.estimation import cox_hazard_ratio
from tessera.operators.order import as_of
from tessera.operators.ranking import ranked
from tessera.operators.resampling import DRAW, draws_sql, interval, replicates, resampled
from tessera.plans import clones as C
from tessera.plans.estimation import _TAIL, REPS, _normal_tail
from tessera.plans.policy import _HIT, _LOST, _hits, _uncensored
from tessera.plans.ranking import K, REASON, _counted, _metrics
from tessera.plans.survival import ARMED_CTE, SHORTEST, armed, curve_cte, restricted_means_beyond, rmst_contrast
from tessera.plans.survival import SQL as SURVIVAL
from tessera.sources.model import COVARIATE_CTE, DECISION_CTE, EXPOSURE_CTE, HORIZONS, PRESCRIBING, SCORED_CTE, covariates, decisions, exposures, scored
from tessera.sources.stored import cut

KEY = ["ecog", "prior_bucket"]
Z95, Z975 = fn.normal_quantile(0.95), fn.two_sided_quantile(0.95)


def censoring_as_of(spark, sf_dir):
    """The censoring curve of each decision's key at a time between its knots: the last step at or before it, 1 before the first."""
    d = decisions(spark, sf_dir).select("decision_id", *KEY, F.round(F.col("follow_up_months") * 0.9 + 0.003, 3).alias("at"), "follow_up_months", (~F.col("event")).alias("lost"))
    steps = S.curve(d, KEY, "follow_up_months", "lost")
    return as_of(d.select("decision_id", *KEY, "at"), steps, KEY, "at", "t", "survival", F.lit(1.0), "g").select("decision_id", "at", F.round("g", 6).alias("g"))


def q_as_of(spark, sf_dir):
    """The restricted-mean function of each arm and covariate key at months between its knots: the mean restricted time of those still
    followed at the last knot, which stays beyond the last one; nothing before the first, and for an arm and key that nobody has."""
    keys = ["exposed", *KEY]
    d = armed(spark, sf_dir)
    steps = restricted_means_beyond(d, keys)
    months = d.select(*KEY).distinct().select(F.explode(F.array(F.lit(0), F.lit(1))).alias("exposed"), *KEY)
    months = months.select(*keys, F.explode(F.array(*[F.lit(m / 2) for m in range(19)])).alias("month"))
    return as_of(months, steps, keys, "month", "knot", "q", F.lit(0.0), "q").select(*keys, "month", F.round(F.col("q") + 1e-9, 6).alias("q"))


def landmark_survival(spark, sf_dir):
    """Product-limit survival of each line at landmark months."""
    steps = S.curve(decisions(spark, sf_dir), ["line"], "follow_up_months", "event")
    months = steps.select("line").distinct().select("line", F.explode(F.array(*map(F.lit, (1.0, 2.5, 4.0, 5.5)))).alias("month"))
    return as_of(months, steps, ["line"], "month", "t", "survival", F.lit(1.0), "survival").select("line", "month", F.round("survival", 6).alias("survival"))


def agreement_identity(spark, sf_dir):
    """Both sides of the agreement identity, the weighted one at each line's horizon, and the comparisons that are not it, at the shortest."""
    h = _uncensored(_hits(spark, sf_dir), spark, sf_dir).withColumn("short", F.least("follow_up_months", F.lit(SHORTEST)))
    hit = F.col("hit")
    weighted = F.when(hit & F.col("event"), F.col("y") * F.col("weight") / F.greatest("g", F.lit(0.05))).otherwise(0.0)
    a = h.agg(F.avg(weighted).alias("w"), F.avg(F.when(hit, F.col("short"))).alias("v"), F.sum(F.when(hit, F.col("short"))).alias("s"), F.avg(hit.cast("double")).alias("p"), F.count("*").alias("n"))
    return a.select(
        F.round("w", 6).alias("weighted_value"), F.round("v", 6).alias("within_set_value"), F.round("v", 6).alias("unweighted_value"),
        F.round(F.col("s") / (F.col("p") * F.col("n")), 6).alias("constant_propensity_value"), F.col("n").alias("subjects"), F.round("p", 6).alias("agreement_share"),
    )


def propensity_constant(spark, sf_dir):
    """Whether the probability of starting a recommended candidate is the same for all, by covariate and altogether."""
    h = _hits(spark, sf_dir).select(F.concat(F.lit("ecog="), F.col("ecog").cast("string")).alias("scope"), (1.0 / F.col("weight")).alias("p"))
    both = h.union(h.select(F.lit("all").alias("scope"), "p"))
    return both.groupBy("scope").agg((F.max("p") - F.min("p") <= 1e-9).alias("constant"), F.count("*").alias("n"))


def collapsibility_gap(spark, sf_dir):
    """The gap between the hazard ratio and the restricted-mean contrast of each line: they answer different questions.

    There are three lines, each with a Cox fit of its own.
    """
    d = armed(spark, sf_dir).select("line", "follow_up_months", "event", "exposed")
    ratios = [(line, float(np.exp(cox_hazard_ratio(d.where(F.col("line") == line), "follow_up_months", "event", "exposed")[0]))) for line in HORIZONS]
    r = spark.createDataFrame(ratios, "line string, hazard_ratio double")
    return r.join(rmst_contrast(spark, sf_dir).select("line", "contrast"), "line").select("line", F.round("hazard_ratio", 6).alias("hazard_ratio"), "contrast", F.round(F.abs(F.col("hazard_ratio") - 1.0) - F.abs("contrast"), 5).alias("gap"))


def top_three_value(spark, sf_dir):
    """Value of acting on the leading eligible candidates of a positive value: decisions without one count 0 and are not covered."""
    r = ranked(_counted(spark, sf_dir).where("reason is null and score > 0"), "decision_id", "score", "candidate").where(F.col("rank") <= K)
    v = r.groupBy("decision_id").agg(F.avg("score").alias("v"))
    each = decisions(spark, sf_dir).select("decision_id").join(v, "decision_id", "left")
    value = F.coalesce("v", F.lit(0.0))
    return each.agg(F.lit(K).alias("depth"), F.round(F.avg(value), 6).alias("value"), F.round(F.stddev_samp(value) / F.sqrt(F.count("*")), 6).alias("se"), F.count("*").alias("decisions"), F.count("v").alias("covered"))


def precision_at_k(spark, sf_dir):
    """Share of the leading k that is relevant, of as many as there are."""
    return _metrics(spark, sf_dir).select("decision_id", F.round("hits", 6).alias("precision"))


def log_softmax(spark, sf_dir):
    """Log shares of each decision's scores, shifted by their maximum."""
    w = Window.partitionBy("decision_id")
    s = scored(spark, sf_dir).withColumn("x", F.col("score") - F.max("score").over(w))
    return s.select("decision_id", "candidate", F.round(F.col("x") - F.log(F.sum(F.exp("x")).over(w)), 6).alias("log_share"))


def score_intervals(spark, sf_dir):
    """Mean score of each candidate with a two-sided and a one-sided normal limit, the propensity-weighted mean, and whether the interval excludes zero."""
    s = scored(spark, sf_dir).groupBy("candidate").agg(F.avg("score").alias("m"), (F.stddev_samp("score") / F.sqrt(F.count("*"))).alias("e"), fn.weighted_mean(F.col("score"), F.col("propensity")).alias("weighted"))
    lower, upper = fn.two_sided(F.col("m"), F.col("e"))
    return s.select("candidate", *[F.round(c, 6).alias(n) for n, c in (("point", F.col("m")), ("lower", lower), ("upper", upper), ("one_sided", fn.one_sided_upper(F.col("m"), F.col("e"))), ("weighted", F.col("weighted")))], fn.excludes(lower, upper, F.lit(0.0)).alias("clear"))


def _candidate_risks(spark, sf_dir, month: float) -> DataFrame:
    """(candidate, ratio, lower, upper) of incidences by a month, exposed over unexposed, for every candidate.

    Decisions are counted per distinct time, of all and of each candidate's exposed; the unexposed are the difference, so no
    decision meets a candidate it wasn't exposed to.
    """
    d = decisions(spark, sf_dir).select("decision_id", F.least("follow_up_months", F.lit(month)).alias("t"), "event")
    count = lambda s: [F.count("*").alias(f"n{s}"), F.count_if("event").alias(f"d{s}")]
    total = d.groupBy("t").agg(*count(""))
    x = exposures(spark, sf_dir).join(d, "decision_id").groupBy("candidate", "t").agg(*count("1"))
    every = x.select("candidate").distinct().crossJoin(total).join(x, ["candidate", "t"], "left").fillna(0, ["n1", "d1"])
    arms = F.explode(F.array(F.struct(F.lit(1).alias("exposed"), F.col("n1").alias("n"), F.col("d1").alias("deaths")), F.struct(F.lit(0).alias("exposed"), (F.col("n") - F.col("n1")).alias("n"), (F.col("d") - F.col("d1")).alias("deaths"))))
    steps = every.select("candidate", "t", arms.alias("a")).select("candidate", "t", "a.*")
    w = Window.partitionBy("candidate", "exposed").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    at = steps.withColumn("at_risk", F.sum("n").over(w)).withColumn("left", 1.0 - F.coalesce(F.try_divide("deaths", F.col("at_risk")), F.lit(0.0)))
    r = at.groupBy("candidate", "exposed").agg((1.0 - F.product("left")).alias("risk"), F.sum("n").alias("n"))
    arm = lambda c, a: F.max(F.when(F.col("exposed") == a, F.col(c)))
    r = r.groupBy("candidate").agg(*[arm(c, a).alias(f"{c}{a}") for c in ("risk", "n") for a in (0, 1)])
    var = lambda a: F.greatest(1.0 - F.col(f"risk{a}"), F.lit(1e-9)) / F.greatest(F.col(f"n{a}") * F.col(f"risk{a}"), F.lit(1e-9))
    r = r.select("candidate", F.try_divide("risk1", "risk0").alias("ratio"), F.sqrt(var(1) + var(0)).alias("se"))
    return r.select("candidate", "ratio", F.exp(F.log("ratio") - 1.96 * F.col("se")).alias("lower"), F.exp(F.log("ratio") + 1.96 * F.col("se")).alias("upper"))


TOLERANCE = 0.15


def candidate_e_values(spark, sf_dir):
    """E-values of every candidate's risk ratio, and whether its negative control, a quarter into the follow-up, stays close to one."""
    e = _candidate_risks(spark, sf_dir, SHORTEST).select("candidate", "ratio", S.e_value(F.col("ratio")).alias("point"), S.e_value_limit(*[F.col(c) for c in ("ratio", "lower", "upper")]).alias("interval_limit"))
    control = _candidate_risks(spark, sf_dir, SHORTEST / 4).select("candidate", (F.abs(F.col("ratio") - 1.0) <= TOLERANCE).alias("screened"))
    return e.join(control, "candidate").select("candidate", *[F.round(c, 6).alias(c) for c in ("ratio", "point", "interval_limit")], F.coalesce("screened", F.lit(False)).alias("screened"))


def pooled_e_value(spark, sf_dir):
    """Mean E-values over the candidates, those that are no numbers left out."""
    mean = lambda c: F.round(F.avg(F.when(~F.isnan(c), F.col(c))), 5).alias(c)
    return candidate_e_values(spark, sf_dir).agg(mean("point"), mean("interval_limit"), F.count_if("screened").alias("screened"))


def clone_weight_quantiles(spark, sf_dir):
    """Quantiles of the clones' weights by strategy; weights are counted by value before any is sorted."""
    q = lambda p: F.round(F.percentile("weight", F.lit(p)), 6)
    return C.clones(spark, sf_dir).groupBy("strategy").agg(q(0.01).alias("p01"), q(0.5).alias("p50"), q(0.99).alias("p99"))


def bootstrap_contrast(spark, sf_dir):
    """Second line less first, in mean follow-up: the point, and its percentile interval under draws within sites."""
    d = decisions(spark, sf_dir).where("line <> 'third_plus'").select("site", "decision_id", "line", F.round(F.col("follow_up_months") * 100).cast("bigint").alias("v"))
    mean = lambda line, times: F.sum(F.when(F.col("line") == line, F.col("v") * times)) / F.sum(F.when(F.col("line") == line, times)) / 100.0
    contrast = lambda times: mean("second", times) - mean("first", times)
    q = interval(replicates(d, "site", "decision_id", {"m": contrast(F.col("times"))}, REPS), "m")
    return d.agg(contrast(F.lit(1)).alias("point")).crossJoin(q).select(*[F.round(c, 6).alias(c) for c in ("point", "lower", "upper", "half")], "reps")


#: Replicates of the hits' interval, as in the protocols of the original.
RESAMPLES = 400


def bootstrap_hits(spark, sf_dir):
    """Percentile interval of the mean hits at k under draws with replacement within sites."""
    d = cut(_metrics(spark, sf_dir).select("decision_id", F.round(F.col("hits") * 1000000).cast("bigint").alias("v")).join(decisions(spark, sf_dir).select("decision_id", "site"), "decision_id"))
    mean = lambda times: F.sum(F.col("v") * times) / F.sum(times) / 1000000.0
    q = interval(resampled(d, "site", "decision_id", {"m": mean(F.col("times"))}, RESAMPLES), "m")
    return d.agg(mean(F.lit(1)).alias("point")).crossJoin(q).select(*[F.round(c, 6).alias(c) for c in ("point", "lower", "upper")], "reps")


def one_sample_seed_test(spark, sf_dir):
    """Sites as the repeats: mean nDCG against a constant, normal tail."""
    m = _metrics(spark, sf_dir).join(decisions(spark, sf_dir).select("decision_id", "site"), "decision_id").groupBy("site").agg((F.avg("ndcg") - 0.5).alias("d"))
    s = m.agg(F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))
    return s.select(F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round(_normal_tail(F.col("mean") / F.col("se")), 6).alias("p"))


def site_ablation(spark, sf_dir):
    """A ranking read-out without each site: its value, the delta to the whole, and the interval of the delta in quadrature.

    The whole's sums less the site's are those without it, so every ablation costs one row.
    """
    d = _metrics(spark, sf_dir).join(decisions(spark, sf_dir).select("decision_id", "site"), "decision_id")
    part = d.groupBy("site").agg(F.count("*").alias("n"), F.sum("ndcg").alias("s"), F.sum(F.col("ndcg") * F.col("ndcg")).alias("ss"))
    whole = part.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("ss").alias("all_ss"))
    x = part.crossJoin(F.broadcast(whole)).withColumns({"n": F.col("all_n") - F.col("n"), "s": F.col("all_s") - F.col("s"), "ss": F.col("all_ss") - F.col("ss")})
    half = lambda n, s, ss: Z975 * F.sqrt((F.col(ss) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1) / F.col(n))
    delta, width = F.col("s") / F.col("n") - F.col("all_s") / F.col("all_n"), F.sqrt(F.pow(half("n", "s", "ss"), F.lit(2.0)) + F.pow(half("all_n", "all_s", "all_ss"), F.lit(2.0)))
    return x.select("site", *[F.round(c, 6).alias(n) for n, c in (("value", F.col("s") / F.col("n")), ("delta", delta), ("lower", delta - width), ("upper", delta + width))])


def panel_readout(spark, sf_dir):
    """Strata of several panels against the whole: size, value, delta, and whether it is its panel's worst."""
    d = _metrics(spark, sf_dir).join(decisions(spark, sf_dir), "decision_id")
    panels = F.explode(F.array(*[F.struct(F.lit(p).alias("panel"), F.col(c).cast("string").alias("stratum")) for p, c in (("site", "site"), ("line", "line"), ("segment", "c_mktsegment"), ("status", "ecog"))]))
    s = d.select(panels.alias("p"), "ndcg").groupBy("p.panel", "p.stratum").agg(F.count("*").alias("n"), F.avg("ndcg").alias("value"))
    whole = d.agg(F.avg("ndcg").alias("whole"))
    x = s.crossJoin(F.broadcast(whole)).withColumn("delta", F.round(F.col("value") - F.col("whole"), 6))
    return x.select("panel", "stratum", "n", F.round("value", 6).alias("value"), "delta", (F.col("delta") == F.min("delta").over(Window.partitionBy("panel"))).alias("worst"))


FAMILIES, TRANSFER = 5, 3


def _roster(spark, sf_dir) -> DataFrame:
    """Comparators as the data has them: each candidate's mean score, its family and whether it is a transfer row, by the brand's number."""
    number = F.regexp_replace("candidate", "[^0-9]", "").cast("int")
    return scored(spark, sf_dir).groupBy("candidate").agg(F.round(F.avg("score"), 6).alias("value")).select("candidate", "value", (number % FAMILIES).alias("family"), (number % TRANSFER == 0).alias("transfer"))


def comparator_families(spark, sf_dir):
    """Members of each comparator family, how many are transfer rows, its spread, and its best member that is not one."""
    best = F.min_by(F.when(~F.col("transfer"), F.col("candidate")), F.when(~F.col("transfer"), F.struct(-F.col("value"), F.col("candidate"))))
    return _roster(spark, sf_dir).groupBy("family").agg(F.count("*").alias("members"), F.count_if("transfer").alias("transfers"), F.min("value").alias("low"), F.max("value").alias("high"), best.alias("best"))


#: Pre-registered criteria on the read-outs: kind, the bar, and whether it is adjusted for multiplicity.
CRITERIA = (("value", "primary", 0.05, True), ("coverage", "primary", 0.5, True), ("spread", "secondary", 0.02, False), ("hits", "secondary", 0.99, False))


def criteria_status(spark, sf_dir):
    """Each criterion with what was observed, its margin, and whether it was met."""
    v = top_three_value(spark, sf_dir).select("value", (F.col("covered") / F.col("decisions")).alias("coverage"))
    spread = _roster(spark, sf_dir).agg((F.max("value") - F.min("value")).alias("spread"))
    hits = _metrics(spark, sf_dir).agg(F.avg("hits").alias("hits"))
    seen = v.crossJoin(spread).crossJoin(hits).unpivot([], ["value", "coverage", "spread", "hits"], "criterion", "observed")
    c = spark.createDataFrame(list(CRITERIA), "criterion string, kind string, bar double, adjusted boolean")
    return c.join(seen, "criterion").select("criterion", "kind", "adjusted", F.round("observed", 6).alias("observed"), F.round(F.col("observed") - F.col("bar"), 6).alias("margin"), (F.col("observed") >= F.col("bar")).alias("met"))


def criteria_summary(spark, sf_dir):
    """How many criteria there are, how many are primary, adjusted, met, and whether all primary ones were."""
    primary = F.col("kind") == "primary"
    return criteria_status(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(primary).alias("primary"), F.count_if("adjusted").alias("adjusted"), F.count_if("met").alias("met"), F.count_if(~F.col("met")).alias("not_met"), F.every(F.when(primary, F.col("met"))).alias("primary_all_met"))


def prescribing_matrix(spark, sf_dir):
    """The propensity design: an intercept and the sixteen columns that the prescriber sees, a row for each decision."""
    return covariates(spark, sf_dir).select("decision_id", F.lit(1.0).alias("intercept"), *[F.round(c, 6).alias(c) for c in PRESCRIBING])


def state_features(spark, sf_dir):
    """A decision's covariates, standardised by the mean and deviation of all; a constant column is centred only."""
    cols, d = PRESCRIBING, covariates(spark, sf_dir)
    m = d.agg(*[f(n).alias(f"{k}_{n}") for n in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda n: F.round((F.col(n) - F.col(f"m_{n}")) / F.when(F.col(f"s_{n}") > 1e-8, F.col(f"s_{n}")).otherwise(1.0), 6)
    return d.crossJoin(F.broadcast(m)).select("decision_id", *[z(n).alias(n) for n in cols])


EARLY = 4


def early_stop_split(spark, sf_dir):
    """Development patients and decisions of each side of the inner split: a quarter, by a hash of the patient, stops early."""
    early = ((F.col("patient_id") * 48271 + 12345) % 2147483647 % EARLY == 0).alias("early")
    return decisions(spark, sf_dir).where("split = 'development'").groupBy(early).agg(F.count("*").alias("decisions"), F.count_distinct("patient_id").alias("patients"))


def strata(spark, sf_dir):
    """Decisions, events and follow-up of every stratum of status, line and segment."""
    return decisions(spark, sf_dir).groupBy("ecog", "line", "c_mktsegment").agg(F.count("*").alias("n"), F.count_if("event").alias("events"), F.round(F.avg("follow_up_months"), 6).alias("follow_up"))


_D = f"WITH {DECISION_CTE}"
_S = f"WITH {SCORED_CTE}"
_RANK = """rk AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY propensity DESC, candidate) AS place, GREATEST(score, 0.0) AS gain, CASE WHEN score > 0 THEN 1 ELSE 0 END AS rel FROM scored),
rg AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY gain DESC) AS ideal FROM rk)"""
_METRIC = f"""{_RANK}, met AS (SELECT decision_id, CAST(SUM(CASE WHEN place <= {K} THEN rel END) AS DOUBLE) / LEAST({K}, COUNT(*)) AS hits,
COALESCE(SUM(CASE WHEN place <= {K} THEN gain / log2(place + 1.0) END) / NULLIF(SUM(CASE WHEN ideal <= {K} THEN gain / log2(ideal + 1.0) END), 0), 0.0) AS ndcg FROM rg GROUP BY 1)"""
_CENSOR = curve_cte("SELECT ecog, prior_bucket, follow_up_months AS t, NOT event AS died, 1.0 AS w FROM decision", "ecog, prior_bucket")
_LINE = curve_cte("SELECT line, follow_up_months AS t, event AS died, 1.0 AS w FROM decision", "line")
_TOP3 = f"""tc AS (SELECT decision_id, candidate, score FROM (SELECT *, {REASON} AS reason FROM scored JOIN counted USING (candidate)) WHERE reason IS NULL AND score > 0),
tv AS (SELECT decision_id, AVG(score) AS v FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY score DESC, candidate) AS rn FROM tc) WHERE rn <= {K} GROUP BY 1),
t3 AS (SELECT {K} AS depth, ROUND(AVG(COALESCE(v, 0.0)), 6) AS value, ROUND(STDDEV_SAMP(COALESCE(v, 0.0)) / SQRT(COUNT(*)), 6) AS se, COUNT(*) AS decisions, COUNT(v) AS covered FROM decision LEFT JOIN tv USING (decision_id))"""


def _risk_sql(name: str, month: float) -> str:
    return f"""{name}_x AS (SELECT k.candidate, LEAST(d.follow_up_months, {month}) AS t, d.event, e.decision_id IS NOT NULL AS exposed FROM decision d CROSS JOIN (SELECT DISTINCT candidate FROM exposure) k LEFT JOIN exposure e ON e.decision_id = d.decision_id AND e.candidate = k.candidate),
{name}_n AS (SELECT candidate, exposed, t, COUNT(*) AS n, COUNT(*) FILTER (event) AS d FROM {name}_x GROUP BY ALL), {name}_r AS (SELECT *, SUM(n) OVER (PARTITION BY candidate, exposed ORDER BY t DESC) AS at_risk FROM {name}_n),
{name}_i AS (SELECT candidate, exposed, 1.0 - product(1.0 - CAST(d AS DOUBLE) / at_risk) AS risk, SUM(n) AS n FROM {name}_r GROUP BY 1, 2),
{name}_w AS (SELECT candidate, MAX(risk) FILTER (exposed) AS r1, MAX(risk) FILTER (NOT exposed) AS r0, MAX(n) FILTER (exposed) AS n1, MAX(n) FILTER (NOT exposed) AS n0 FROM {name}_i GROUP BY 1),
{name} AS (SELECT candidate, r1 / NULLIF(r0, 0) AS ratio, SQRT(GREATEST(1 - r1, 1e-9) / GREATEST(n1 * r1, 1e-9) + GREATEST(1 - r0, 1e-9) / GREATEST(n0 * r0, 1e-9)) AS se FROM {name}_w)"""


_EV = "CASE WHEN {0} <= 0 THEN CAST('nan' AS DOUBLE) ELSE (CASE WHEN {0} < 1 THEN 1 / {0} ELSE {0} END) + SQRT((CASE WHEN {0} < 1 THEN 1 / {0} ELSE {0} END) * ((CASE WHEN {0} < 1 THEN 1 / {0} ELSE {0} END) - 1)) END"
_EVALUES = f"""WITH {DECISION_CTE}, {EXPOSURE_CTE}, {_risk_sql('full_', SHORTEST)}, {_risk_sql('early', SHORTEST / 4)},
lim AS (SELECT *, EXP(LN(ratio) - 1.96 * se) AS lo, EXP(LN(ratio) + 1.96 * se) AS hi FROM full_),
ev AS (SELECT lim.candidate, ROUND(lim.ratio, 6) AS ratio, ROUND({_EV.format('lim.ratio')}, 6) AS point, ROUND(CASE WHEN lo <= 1 AND hi >= 1 THEN 1.0 WHEN lim.ratio >= 1 THEN {_EV.format('lo')} ELSE {_EV.format('hi')} END, 6) AS interval_limit,
COALESCE(ABS(early.ratio - 1.0) <= {TOLERANCE}, FALSE) AS screened FROM lim JOIN early USING (candidate))"""
_ROSTER = f"{_S}, roster AS (SELECT candidate, ROUND(AVG(score), 6) AS value, CAST(regexp_replace(candidate, '[^0-9]', '', 'g') AS INTEGER) % {FAMILIES} AS family, CAST(regexp_replace(candidate, '[^0-9]', '', 'g') AS INTEGER) % {TRANSFER} = 0 AS transfer FROM scored GROUP BY 1)"
_CRITERIA = f"""WITH {DECISION_CTE}, {SCORED_CTE}, {_METRIC}, {_TOP3}, roster AS (SELECT candidate, ROUND(AVG(score), 6) AS value FROM scored GROUP BY 1),
seen AS (SELECT 'value' AS criterion, value AS observed FROM t3 UNION ALL SELECT 'coverage', CAST(covered AS DOUBLE) / decisions FROM t3 UNION ALL SELECT 'spread', MAX(value) - MIN(value) FROM roster UNION ALL SELECT 'hits', AVG(hits) FROM met),
st AS (SELECT criterion, kind, adjusted, ROUND(observed, 6) AS observed, ROUND(observed - bar, 6) AS margin, observed >= bar AS met FROM (VALUES {', '.join(f"('{c}', '{k}', CAST({b} AS DOUBLE), {a})" for c, k, b, a in CRITERIA)}) AS c(criterion, kind, bar, adjusted) JOIN seen USING (criterion))"""


def _boot_sql(rows: str, statistic: str, point: str, extra: str = "") -> str:
    return f"""v AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY decision_id) - 1 AS k, COUNT(*) OVER (PARTITION BY site) AS n FROM ({rows})),
dr AS (SELECT site, rep, {DRAW} AS k FROM v, unnest(range({REPS})) AS r(rep)), m AS (SELECT rep, {statistic} AS m FROM dr JOIN (SELECT * EXCLUDE (n) FROM v) USING (site, k) GROUP BY 1)
SELECT (SELECT ROUND({point}, 6) FROM v) AS point, ROUND(quantile_cont(m, 0.025), 6) AS lower, ROUND(quantile_cont(m, 0.975), 6) AS upper{extra}, COUNT(*) AS reps FROM m"""


def _resampled_sql(rows: str, statistic: str) -> str:
    return f"""v AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY decision_id) - 1 AS k, COUNT(*) OVER (PARTITION BY site) AS n FROM ({rows})),
{draws_sql('site', 'decision_id', RESAMPLES)},
m AS (SELECT rep, {statistic} AS m FROM dr JOIN v ON dr.site IS NOT DISTINCT FROM v.site AND dr.k = v.k GROUP BY 1)
SELECT (SELECT ROUND({statistic}, 6) FROM v) AS point, ROUND(quantile_cont(m, 0.025), 6) AS lower, ROUND(quantile_cont(m, 0.975), 6) AS upper, COUNT(*) AS reps FROM m"""


_CON = "CAST(SUM(v) FILTER (line = 'second') AS DOUBLE) / COUNT(*) FILTER (line = 'second') / 100.0 - CAST(SUM(v) FILTER (line = 'first') AS DOUBLE) / COUNT(*) FILTER (line = 'first') / 100.0"
QUERIES = {
    f.__name__: f
    for f in (
        censoring_as_of, q_as_of, landmark_survival, agreement_identity, propensity_constant, collapsibility_gap, top_three_value, precision_at_k, log_softmax, score_intervals, candidate_e_values, pooled_e_value, clone_weight_quantiles,
        bootstrap_contrast, bootstrap_hits, one_sample_seed_test, site_ablation, panel_readout, comparator_families, criteria_status, criteria_summary, prescribing_matrix, state_features, early_stop_split, strata,
    )
}
SQL = {
    "censoring_as_of": f"""{_D}, {_CENSOR}, p AS (SELECT decision_id, ecog, prior_bucket, ROUND(follow_up_months * CAST(0.9 AS DOUBLE) + CAST(0.003 AS DOUBLE), 3) AS at FROM decision)
SELECT p.decision_id, p.at, ROUND(COALESCE(k.survival, 1.0), 6) AS g FROM p ASOF LEFT JOIN k ON p.ecog = k.ecog AND p.prior_bucket = k.prior_bucket AND p.at >= k.t""",
    "q_as_of": f"""WITH {ARMED_CTE}, n AS (SELECT exposed, ecog, prior_bucket, LEAST(follow_up_months, horizon_months) AS knot, COUNT(*) AS n FROM armed GROUP BY ALL),
k AS (SELECT *, SUM(CAST(ROUND(knot * 100) AS BIGINT) * n) OVER w / CAST(100.0 AS DOUBLE) / SUM(n) OVER w AS q FROM n WINDOW w AS (PARTITION BY exposed, ecog, prior_bucket ORDER BY knot DESC)),
p AS (SELECT CAST(exposed AS INTEGER) AS exposed, ecog, prior_bucket, CAST(m / 2.0 AS DOUBLE) AS month FROM (SELECT DISTINCT ecog, prior_bucket FROM armed), (SELECT unnest([0, 1]) AS exposed), unnest(range(19)) AS g(m))
SELECT p.exposed, p.ecog, p.prior_bucket, p.month, ROUND(COALESCE(k.q, 0.0) + 1e-9, 6) AS q FROM p ASOF LEFT JOIN k ON p.exposed = k.exposed AND p.ecog = k.ecog AND p.prior_bucket = k.prior_bucket AND p.month >= k.knot""",
    "landmark_survival": f"{_D}, {_LINE}, p AS (SELECT line, month FROM (SELECT DISTINCT line FROM decision), (SELECT CAST(unnest([1.0, 2.5, 4.0, 5.5]) AS DOUBLE) AS month)) SELECT p.line, month, ROUND(COALESCE(k.survival, 1.0), 6) AS survival FROM p ASOF LEFT JOIN k ON p.line = k.line AND p.month >= k.t",
    "agreement_identity": f"""{_HIT}, {_LOST}, sb AS (SELECT *, LEAST(follow_up_months, {SHORTEST}) AS short FROM h ASOF LEFT JOIN k ON h.y > k.t)
SELECT ROUND(AVG(CASE WHEN hit AND event THEN y * weight / GREATEST(COALESCE(survival, 1.0), 0.05) ELSE 0.0 END), 6) AS weighted_value, ROUND(AVG(short) FILTER (hit), 6) AS within_set_value, ROUND(AVG(short) FILTER (hit), 6) AS unweighted_value,
ROUND(SUM(short) FILTER (hit) / (AVG(CASE WHEN hit THEN 1.0 ELSE 0.0 END) * COUNT(*)), 6) AS constant_propensity_value, COUNT(*) AS subjects, ROUND(AVG(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS agreement_share FROM sb""",
    "propensity_constant": f"{_HIT}, sb AS (SELECT 'ecog=' || ecog AS scope, 1.0 / weight AS p FROM h UNION ALL SELECT 'all', 1.0 / weight FROM h) SELECT scope, MAX(p) - MIN(p) <= 1e-9 AS constant, COUNT(*) AS n FROM sb GROUP BY 1",
    "collapsibility_gap": f"""WITH RECURSIVE c AS ({SURVIVAL['rmst_contrast']}), a AS (WITH {ARMED_CTE} SELECT * FROM armed),
n AS (SELECT line, follow_up_months AS t, CAST(exposed AS DOUBLE) AS x, COUNT(*) AS n, COUNT(*) FILTER (event) AS d FROM a GROUP BY 1, 2, 3),
s AS (SELECT line, 0 AS k, CAST(0 AS DOUBLE) AS beta FROM (SELECT DISTINCT line FROM n) UNION ALL
  SELECT line, k + 1, beta + SUM(dx - d * s1 / s0) / SUM(d * (s2 / s0 - s1 * s1 / (s0 * s0))) FROM (
    SELECT line, k, beta, d, dx, SUM(e) OVER w AS s0, SUM(e1) OVER w AS s1, SUM(e2) OVER w AS s2 FROM (
      SELECT line, k, beta, t, SUM(d) AS d, SUM(d * x) AS dx, SUM(n * EXP(beta * x)) AS e, SUM(n * EXP(beta * x) * x) AS e1, SUM(n * EXP(beta * x) * x * x) AS e2 FROM s JOIN n USING (line) WHERE k < 12 GROUP BY line, k, beta, t)
    WINDOW w AS (PARTITION BY line, k ORDER BY t DESC)) GROUP BY line, k, beta)
SELECT line, ROUND(EXP(beta), 6) AS hazard_ratio, contrast, ROUND(ABS(EXP(beta) - 1.0) - ABS(contrast), 5) AS gap FROM s JOIN c USING (line) WHERE k = 12""",
    "top_three_value": f"WITH {DECISION_CTE}, {SCORED_CTE}, {_TOP3} SELECT * FROM t3",
    "precision_at_k": f"{_S}, {_METRIC} SELECT decision_id, ROUND(hits, 6) AS precision FROM met",
    "log_softmax": f"{_S}, x AS (SELECT *, score - MAX(score) OVER (PARTITION BY decision_id) AS x FROM scored) SELECT decision_id, candidate, ROUND(x - LN(SUM(EXP(x)) OVER (PARTITION BY decision_id)), 6) AS log_share FROM x",
    "score_intervals": f"""{_S}, m AS (SELECT candidate, AVG(score) AS m, STDDEV_SAMP(score) / SQRT(COUNT(*)) AS e, SUM(score * propensity) / SUM(propensity) AS weighted FROM scored GROUP BY 1)
SELECT candidate, ROUND(m, 6) AS point, ROUND(m - {Z975} * e, 6) AS lower, ROUND(m + {Z975} * e, 6) AS upper, ROUND(m + {Z95} * e, 6) AS one_sided, ROUND(weighted, 6) AS weighted, 0 < m - {Z975} * e OR 0 > m + {Z975} * e AS clear FROM m""",
    "candidate_e_values": f"{_EVALUES} SELECT * FROM ev",
    "pooled_e_value": f"{_EVALUES} SELECT ROUND(AVG(point) FILTER (NOT isnan(point)), 5) AS point, ROUND(AVG(interval_limit) FILTER (NOT isnan(interval_limit)), 5) AS interval_limit, COUNT(*) FILTER (screened) AS screened FROM ev",
    "clone_weight_quantiles": f"{C._C} SELECT strategy, ROUND(quantile_cont(weight, 0.01), 6) AS p01, ROUND(quantile_cont(weight, 0.5), 6) AS p50, ROUND(quantile_cont(weight, 0.99), 6) AS p99 FROM clone GROUP BY 1",
    "bootstrap_contrast": f"{_D}, " + _boot_sql("SELECT site, decision_id, line, CAST(ROUND(follow_up_months * 100) AS BIGINT) AS v FROM decision WHERE line <> 'third_plus'", _CON, _CON, f", ROUND({Z975} * STDDEV_SAMP(m) / SQRT(COUNT(*)), 6) AS half"),
    "bootstrap_hits": f"WITH {DECISION_CTE}, {SCORED_CTE}, {_METRIC}, " + _resampled_sql("SELECT site, decision_id, CAST(ROUND(hits * 1000000) AS BIGINT) AS v FROM met JOIN decision USING (decision_id)", "CAST(SUM(v) AS DOUBLE) / COUNT(*) / 1000000.0"),
    "one_sample_seed_test": f"""WITH {DECISION_CTE}, {SCORED_CTE}, {_METRIC}, a AS (SELECT AVG(ndcg) - 0.5 AS d FROM met JOIN decision USING (decision_id) GROUP BY site), s AS (SELECT AVG(d) AS mean, STDDEV_SAMP(d) / SQRT(COUNT(*)) AS se FROM a),
x AS (SELECT *, ABS(mean / se) / SQRT(2.0) AS x FROM s), t AS (SELECT *, CAST(1.0 AS DOUBLE) / (1.0 + CAST(0.3275911 AS DOUBLE) * x) AS t FROM x) SELECT ROUND(mean, 6) AS mean, ROUND(se, 6) AS se, ROUND({_TAIL}, 6) AS p FROM t""",
    "site_ablation": f"""WITH {DECISION_CTE}, {SCORED_CTE}, {_METRIC}, a AS (SELECT site, ndcg FROM met JOIN decision USING (decision_id)), w AS (SELECT AVG(ndcg) AS m, {Z975} * STDDEV_SAMP(ndcg) / SQRT(COUNT(*)) AS h FROM a),
o AS (SELECT s.site, AVG(ndcg) AS m, {Z975} * STDDEV_SAMP(ndcg) / SQRT(COUNT(*)) AS h FROM (SELECT DISTINCT site FROM a) s JOIN a ON a.site <> s.site GROUP BY 1)
SELECT site, ROUND(o.m, 6) AS value, ROUND(o.m - w.m, 6) AS delta, ROUND(o.m - w.m - SQRT(o.h * o.h + w.h * w.h), 6) AS lower, ROUND(o.m - w.m + SQRT(o.h * o.h + w.h * w.h), 6) AS upper FROM o, w""",
    "panel_readout": f"""WITH {DECISION_CTE}, {SCORED_CTE}, {_METRIC}, a AS (SELECT * FROM met JOIN decision USING (decision_id)),
l AS (SELECT 'site' AS panel, site AS stratum, ndcg FROM a UNION ALL SELECT 'line', line, ndcg FROM a UNION ALL SELECT 'segment', c_mktsegment, ndcg FROM a UNION ALL SELECT 'status', CAST(ecog AS VARCHAR), ndcg FROM a),
s AS (SELECT panel, stratum, COUNT(*) AS n, AVG(ndcg) AS value, ROUND(AVG(ndcg) - (SELECT AVG(ndcg) FROM a), 6) AS delta FROM l GROUP BY 1, 2) SELECT panel, stratum, n, ROUND(value, 6) AS value, delta, delta = MIN(delta) OVER (PARTITION BY panel) AS worst FROM s""",
    "comparator_families": f"{_ROSTER} SELECT family, COUNT(*) AS members, COUNT(*) FILTER (transfer) AS transfers, MIN(value) AS low, MAX(value) AS high, FIRST(candidate ORDER BY value DESC, candidate) FILTER (NOT transfer) AS best FROM roster GROUP BY 1",
    "criteria_status": f"{_CRITERIA} SELECT * FROM st",
    "criteria_summary": f"{_CRITERIA} SELECT COUNT(*) AS total, COUNT(*) FILTER (kind = 'primary') AS primary, COUNT(*) FILTER (adjusted) AS adjusted, COUNT(*) FILTER (met) AS met, COUNT(*) FILTER (NOT met) AS not_met, BOOL_AND(met) FILTER (kind = 'primary') AS primary_all_met FROM st",
    "prescribing_matrix": f"WITH {COVARIATE_CTE} SELECT decision_id, CAST(1 AS DOUBLE) AS intercept, {', '.join(f'ROUND({c}, 6) AS {c}' for c in PRESCRIBING)} FROM covariate",
    "state_features": f"""WITH {COVARIATE_CTE}, m AS (SELECT {', '.join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in PRESCRIBING)} FROM covariate)
SELECT decision_id, {', '.join(f"ROUND(({c} - m_{c}) / CASE WHEN s_{c} > 1e-8 THEN s_{c} ELSE 1.0 END, 6) AS {c}" for c in PRESCRIBING)} FROM covariate, m""",
    "early_stop_split": f"{_D} SELECT (patient_id * 48271 + 12345) % 2147483647 % {EARLY} = 0 AS early, COUNT(*) AS decisions, COUNT(DISTINCT patient_id) AS patients FROM decision WHERE split = 'development' GROUP BY 1",
    "strata": f"{_D} SELECT ecog, line, c_mktsegment, COUNT(*) AS n, COUNT(*) FILTER (event) AS events, ROUND(AVG(follow_up_months), 6) AS follow_up FROM decision GROUP BY ALL",
}
