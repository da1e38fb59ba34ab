"""Survival read-outs over the decisions, by line and by exposure to a tracer candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import survival as S
from tessera.sources.model import DECISION_CTE, EXPOSURE_CTE, decisions, exposures

TRACER = "Brand#1"
SHORTEST = 5.5
LINE_ARM = ["line", "exposed", "horizon_months"]
Z = 1.959964


def armed(spark: SparkSession, sf_dir: str, candidate: str = TRACER) -> DataFrame:
    """Decisions with ``exposed``: whether the candidate is among the order's lines."""
    x = exposures(spark, sf_dir).where(F.col("candidate") == candidate).select("decision_id", F.lit(1).alias("hit"))
    return decisions(spark, sf_dir).join(x, "decision_id", "left").withColumn("exposed", F.coalesce("hit", F.lit(0))).drop("hit")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves per line and arm, with events re-evaluated at the line's horizon."""
    d = armed(spark, sf_dir).select(
        *LINE_ARM, F.least("follow_up_months", "horizon_months").alias("time"), (F.col("event") & (F.col("follow_up_months") <= F.col("horizon_months"))).alias("died")
    )
    return S.curve(d, LINE_ARM, "time", "died")


def km_by_line(spark, sf_dir):
    """Restricted mean per line and arm."""
    return S.restricted_mean(_steps(spark, sf_dir), LINE_ARM, "horizon_months").select(*LINE_ARM, F.round("rmst", 6).alias("rmst"))


def restricted_mean_error(spark, sf_dir):
    return S.restricted_mean_error(_steps(spark, sf_dir), LINE_ARM, "horizon_months").select(*LINE_ARM, F.round("error", 6).alias("error"))


def rmst_contrast(spark, sf_dir):
    """Exposed minus unexposed restricted mean per line, with the root-sum-square error."""
    steps = _steps(spark, sf_dir)
    both = S.restricted_mean(steps, LINE_ARM, "horizon_months").join(S.restricted_mean_error(steps, LINE_ARM, "horizon_months"), LINE_ARM)
    arm = lambda c, a: F.max(F.when(F.col("exposed") == a, F.col(c)))
    return both.groupBy("line").agg(
        F.round(arm("rmst", 1) - arm("rmst", 0), 6).alias("contrast"), F.round(F.sqrt(arm("error", 1) * arm("error", 1) + arm("error", 0) * arm("error", 0)), 6).alias("error")
    )


def km_curve(spark, sf_dir):
    return _steps(spark, sf_dir).select("line", "exposed", F.col("t").alias("month"), F.col("at_risk").cast("bigint").alias("at_risk"), F.col("deaths").cast("bigint").alias("deaths"), F.round("survival", 6).alias("survival"))


def cumulative_incidence(spark, sf_dir):
    return S.incidence(armed(spark, sf_dir), ["line", "exposed"], "follow_up_months", "event", SHORTEST).select("line", "exposed", "n", F.round("risk", 6).alias("risk"))


def _ratio(spark, sf_dir, month) -> DataFrame:
    """(ratio, lower, upper) of the two arms' incidences at a month, with a Wald interval on the log scale."""
    r = S.incidence(armed(spark, sf_dir), ["exposed"], "follow_up_months", "event", month)
    arm = lambda c, a: F.max(F.when(F.col("exposed") == a, F.col(c)))
    w = r.agg(*[arm(c, a).alias(f"{c}{a}") for c in ("risk", "n") for a in (0, 1)])
    var = lambda a: F.greatest(1.0 - F.col(f"risk{a}"), F.lit(1e-9)) / F.greatest(F.col(f"n{a}") * F.col(f"risk{a}"), F.lit(1e-9))
    w = w.select(F.try_divide("risk1", "risk0").alias("ratio"), F.sqrt(var(1) + var(0)).alias("se"))
    return w.select("ratio", F.exp(F.log("ratio") - 1.96 * F.col("se")).alias("lower"), F.exp(F.log("ratio") + 1.96 * F.col("se")).alias("upper"))


def risk_ratio(spark, sf_dir):
    return _ratio(spark, sf_dir, SHORTEST).select(*[F.round(c, 6).alias(c) for c in ("ratio", "lower", "upper")])


def negative_control(spark, sf_dir):
    """The same contrast at a quarter of the horizon, where no effect is plausible yet."""
    return _ratio(spark, sf_dir, SHORTEST / 4).select(*[F.round(c, 6).alias(c) for c in ("ratio", "lower", "upper")])


def e_value(spark, sf_dir):
    r = _ratio(spark, sf_dir, SHORTEST)
    return r.select(F.round(S.e_value(F.col("ratio")), 6).alias("point"), F.round(S.e_value_limit(*[F.col(c) for c in ("ratio", "lower", "upper")]), 6).alias("interval_limit"))


def landmark_contrast(spark, sf_dir):
    r = S.incidence(armed(spark, sf_dir), ["line", "exposed"], "follow_up_months", "event", 4.0)
    arm = lambda c, a: F.max(F.when(F.col("exposed") == a, F.col(c)))
    return r.groupBy("line").agg(F.round(arm("risk", 1), 6).alias("exposed_risk"), F.round(arm("risk", 0), 6).alias("control_risk"), arm("n", 1).alias("exposed_n"), arm("n", 0).alias("control_n"))


def median_survival(spark, sf_dir):
    return S.median_time(S.curve(armed(spark, sf_dir), ["line", "exposed"], "follow_up_months", "event"), ["line", "exposed"])


def events_by_arm(spark, sf_dir):
    return armed(spark, sf_dir).groupBy("exposed").agg(F.count_if("event").alias("events"), F.count_if(~F.col("event")).alias("censored"))


def smd_balance(spark, sf_dir):
    """Standardised difference of each covariate between the arms, sample variances."""
    d = armed(spark, sf_dir).select("exposed", *[F.col(c).cast("double").alias(c) for c in ("c_acctbal", "ecog", "prior_bucket", "follow_up_months")])
    long = d.unpivot(["exposed"], ["c_acctbal", "ecog", "prior_bucket", "follow_up_months"], "covariate", "value")
    arm = lambda f, a: f(F.when(F.col("exposed") == a, F.col("value")))
    return long.groupBy("covariate").agg(F.round((arm(F.avg, 1) - arm(F.avg, 0)) / F.sqrt((arm(F.var_samp, 1) + arm(F.var_samp, 0)) / 2.0), 6).alias("smd"))


def _site_effects(spark, sf_dir) -> DataFrame:
    """(site, est, se): difference of the arms' mean restricted follow-up at each site."""
    d = armed(spark, sf_dir).withColumn("y", F.least("follow_up_months", "horizon_months"))
    arm = lambda f, a: f(F.when(F.col("exposed") == a, F.col("y")))
    return d.groupBy("site").agg((arm(F.avg, 1) - arm(F.avg, 0)).alias("est"), F.sqrt(arm(F.var_samp, 1) / arm(F.count, 1) + arm(F.var_samp, 0) / arm(F.count, 0)).alias("se"))


def cochran_heterogeneity(spark, sf_dir):
    """Cochran's Q and I squared of the site effects; sites without a positive error are left out."""
    s = _site_effects(spark, sf_dir).where("se > 0").withColumn("w", 1.0 / (F.col("se") * F.col("se")))
    a = s.agg(F.count("*").alias("k"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("est")).alias("we"), F.sum(F.col("w") * F.col("est") * F.col("est")).alias("wee"))
    q = F.col("wee") - F.col("we") * F.col("we") / F.col("w")
    return a.select(F.round(q, 6).alias("q"), F.round(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(q - (F.col("k") - 1), q), F.lit(0.0))), 6).alias("i_squared"))


def pooled_site_interval(spark, sf_dir):
    """Inverse-variance pooled site effect with its interval."""
    s = _site_effects(spark, sf_dir).where("se > 0").withColumn("w", 1.0 / (F.col("se") * F.col("se")))
    p = s.agg((F.sum(F.col("w") * F.col("est")) / F.sum("w")).alias("point"), F.sqrt(1.0 / F.sum("w")).alias("se"))
    return p.select(F.round("point", 6).alias("point"), F.round(F.col("point") - Z * F.col("se"), 6).alias("lower"), F.round(F.col("point") + Z * F.col("se"), 6).alias("upper"))


def censoring_survival(spark, sf_dir):
    """Product-limit curves of censoring, floored, per arm, performance status and prior lines."""
    d = armed(spark, sf_dir).select("exposed", "ecog", "prior_bucket", "follow_up_months", (~F.col("event")).alias("lost"))
    c = S.curve(d, ["exposed", "ecog", "prior_bucket"], "follow_up_months", "lost")
    return c.select("exposed", "ecog", "prior_bucket", F.col("t").alias("knot"), F.round(F.greatest("survival", F.lit(0.05)), 6).alias("g"))


def restricted_means_beyond(d: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, knot, q): at each distinct restricted time, the mean restricted time of those who are followed until then."""
    n = d.groupBy(*keys, F.least("follow_up_months", "horizon_months").alias("knot")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("knot").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return n.select(*keys, "knot", (F.sum(F.round(F.col("knot") * 100).cast("bigint") * F.col("n")).over(w) / 100.0 / F.sum("n").over(w)).alias("q"))


def q_function(spark, sf_dir):
    """Per censoring key, the mean restricted follow-up of those still followed at each knot."""
    keys = ["exposed", "ecog", "prior_bucket"]
    return restricted_means_beyond(armed(spark, sf_dir), keys).withColumn("q", F.round(F.col("q") + 1e-9, 6))


def weighted_km(spark, sf_dir):
    """Curves per arm with rows weighted to the pooled mix of performance status."""
    from pyspark.sql import Window

    d = armed(spark, sf_dir)
    n = d.groupBy("exposed", "ecog").agg(F.count("*").alias("n"))
    whole, arm, status = Window.partitionBy(), Window.partitionBy("exposed"), Window.partitionBy("ecog")
    share = n.select("exposed", "ecog", (F.sum("n").over(status) / F.sum("n").over(whole) / (F.col("n") / F.sum("n").over(arm))).alias("w"))
    c = S.curve(d.join(share, ["exposed", "ecog"]), ["exposed"], "follow_up_months", "event", "w")
    return c.select("exposed", F.col("t").alias("month"), F.round("at_risk", 4).alias("at_risk"), F.round("survival", 6).alias("survival"))


ARMED_CTE = f"""{DECISION_CTE}, {EXPOSURE_CTE},
armed AS (SELECT d.*, CASE WHEN x.decision_id IS NULL THEN 0 ELSE 1 END AS exposed FROM decision d
          LEFT JOIN (SELECT decision_id FROM exposure WHERE candidate = 'Brand#1') x USING (decision_id))"""


def curve_cte(rows: str, keys: str) -> str:
    """SQL of a curve: rows is a SELECT of the keys, t, died and w."""
    return f"""s AS (SELECT {keys}, t, CAST(SUM(w) AS DOUBLE) AS n, CAST(SUM(CASE WHEN died THEN w ELSE 0 END) AS DOUBLE) AS deaths FROM ({rows}) GROUP BY {keys}, t),
r AS (SELECT *, SUM(n) OVER (PARTITION BY {keys} ORDER BY t DESC) AS at_risk FROM s),
k AS (SELECT *, product(1.0 - deaths / at_risk) OVER (PARTITION BY {keys} ORDER BY t) AS survival, lead(t) OVER (PARTITION BY {keys} ORDER BY t) AS nxt,
             row_number() OVER (PARTITION BY {keys} ORDER BY t) AS rn FROM r)"""


_LINES = curve_cte("SELECT line, exposed, horizon_months, LEAST(follow_up_months, horizon_months) AS t, event AND follow_up_months <= horizon_months AS died, 1.0 AS w FROM armed", "line, exposed, horizon_months")
_RMST = "SUM(survival * GREATEST(LEAST(COALESCE(nxt, horizon_months), horizon_months) - LEAST(t, horizon_months), 0.0)) + SUM(CASE WHEN rn = 1 THEN LEAST(t, horizon_months) ELSE 0.0 END)"
_ERROR = "SQRT(SUM(CASE WHEN t <= horizon_months THEN survival * survival * deaths / (at_risk * at_risk) END)) * horizon_months"


def _incidence(keys: str, month: float) -> str:
    rows = f"SELECT {keys}, LEAST(follow_up_months, {month}) AS t, event AS died, 1.0 AS w FROM armed"
    return f"{curve_cte(rows, keys)}, i AS (SELECT {keys}, CAST(SUM(n) AS BIGINT) AS n, 1.0 - arg_max(survival, t) AS risk FROM k GROUP BY {keys})"


def _ratio_sql(month: float) -> str:
    return f"""WITH {ARMED_CTE}, {_incidence('exposed', month)},
v AS (SELECT MAX(CASE WHEN exposed = 1 THEN risk END) AS r1, MAX(CASE WHEN exposed = 0 THEN risk END) AS r0, MAX(CASE WHEN exposed = 1 THEN n END) AS n1, MAX(CASE WHEN exposed = 0 THEN n END) AS n0 FROM i),
x AS (SELECT r1 / r0 AS ratio, SQRT(GREATEST(1 - r1, 1e-9) / GREATEST(n1 * r1, 1e-9) + GREATEST(1 - r0, 1e-9) / GREATEST(n0 * r0, 1e-9)) AS se FROM v),
y AS (SELECT ratio, EXP(LN(ratio) - 1.96 * se) AS lower, EXP(LN(ratio) + 1.96 * se) AS upper FROM x) """


_ROUNDED = "SELECT ROUND(ratio, 6) AS ratio, ROUND(lower, 6) AS lower, ROUND(upper, 6) AS upper FROM y"
_EV = "CASE WHEN {0} <= 0 THEN NULL ELSE GREATEST({0}, 1 / {0}) + SQRT(GREATEST({0}, 1 / {0}) * (GREATEST({0}, 1 / {0}) - 1)) END"
_SITES = f"""WITH {ARMED_CTE}, e AS (SELECT site, AVG(CASE WHEN exposed = 1 THEN LEAST(follow_up_months, horizon_months) END) - AVG(CASE WHEN exposed = 0 THEN LEAST(follow_up_months, horizon_months) END) AS est,
  SQRT(VAR_SAMP(CASE WHEN exposed = 1 THEN LEAST(follow_up_months, horizon_months) END) / SUM(exposed) + VAR_SAMP(CASE WHEN exposed = 0 THEN LEAST(follow_up_months, horizon_months) END) / SUM(1 - exposed)) AS se FROM armed GROUP BY site),
g AS (SELECT COUNT(*) AS k, SUM(1 / (se * se)) AS w, SUM(est / (se * se)) AS we, SUM(est * est / (se * se)) AS wee FROM e WHERE se > 0) """
_BALANCE = " UNION ALL ".join(
    f"SELECT '{c}' AS covariate, ROUND((AVG(CASE WHEN exposed = 1 THEN {c} END) - AVG(CASE WHEN exposed = 0 THEN {c} END)) / SQRT((VAR_SAMP(CASE WHEN exposed = 1 THEN {c} END) + VAR_SAMP(CASE WHEN exposed = 0 THEN {c} END)) / 2.0), 6) AS smd FROM armed"
    for c in ("c_acctbal", "ecog", "prior_bucket", "follow_up_months")
)
QUERIES = {f.__name__: f for f in (km_by_line, restricted_mean_error, rmst_contrast, km_curve, cumulative_incidence, risk_ratio, negative_control, e_value, landmark_contrast, median_survival, events_by_arm, smd_balance, cochran_heterogeneity, pooled_site_interval, censoring_survival, q_function, weighted_km)}
SQL = {
    "km_by_line": f"WITH {ARMED_CTE}, {_LINES} SELECT line, exposed, horizon_months, ROUND({_RMST}, 6) AS rmst FROM k GROUP BY line, exposed, horizon_months",
    "restricted_mean_error": f"WITH {ARMED_CTE}, {_LINES} SELECT line, exposed, horizon_months, ROUND({_ERROR}, 6) AS error FROM k GROUP BY line, exposed, horizon_months",
    "rmst_contrast": f"""WITH {ARMED_CTE}, {_LINES}, a AS (SELECT line, exposed, {_RMST} AS rmst, {_ERROR} AS err FROM k GROUP BY line, exposed, horizon_months)
SELECT line, ROUND(MAX(CASE WHEN exposed = 1 THEN rmst END) - MAX(CASE WHEN exposed = 0 THEN rmst END), 6) AS contrast, ROUND(SQRT(SUM(err * err)), 6) AS error FROM a GROUP BY line""",
    "km_curve": f"WITH {ARMED_CTE}, {_LINES} SELECT line, exposed, t AS month, CAST(at_risk AS BIGINT) AS at_risk, CAST(deaths AS BIGINT) AS deaths, ROUND(survival, 6) AS survival FROM k",
    "cumulative_incidence": f"WITH {ARMED_CTE}, {_incidence('line, exposed', SHORTEST)} SELECT line, exposed, n, ROUND(risk, 6) AS risk FROM i",
    "risk_ratio": _ratio_sql(SHORTEST) + _ROUNDED,
    "negative_control": _ratio_sql(SHORTEST / 4) + _ROUNDED,
    "e_value": _ratio_sql(SHORTEST) + f"SELECT ROUND({_EV.format('ratio')}, 6) AS point, ROUND(CASE WHEN lower <= 1 AND upper >= 1 THEN 1.0 WHEN ratio >= 1 THEN {_EV.format('lower')} ELSE {_EV.format('upper')} END, 6) AS interval_limit FROM y",
    "landmark_contrast": f"""WITH {ARMED_CTE}, {_incidence('line, exposed', 4.0)} SELECT line, ROUND(MAX(CASE WHEN exposed = 1 THEN risk END), 6) AS exposed_risk, ROUND(MAX(CASE WHEN exposed = 0 THEN risk END), 6) AS control_risk,
  MAX(CASE WHEN exposed = 1 THEN n END) AS exposed_n, MAX(CASE WHEN exposed = 0 THEN n END) AS control_n FROM i GROUP BY line""",
    "median_survival": f"WITH {ARMED_CTE}, {curve_cte('SELECT line, exposed, follow_up_months AS t, event AS died, 1.0 AS w FROM armed', 'line, exposed')} SELECT line, exposed, MIN(CASE WHEN survival <= 0.5 AND deaths > 0 THEN t END) AS median FROM k GROUP BY line, exposed",
    "events_by_arm": f"WITH {ARMED_CTE} SELECT exposed, COUNT(*) FILTER (event) AS events, COUNT(*) FILTER (NOT event) AS censored FROM armed GROUP BY exposed",
    "smd_balance": f"WITH {ARMED_CTE} {_BALANCE}",
    "cochran_heterogeneity": _SITES + "SELECT ROUND(wee - we * we / w, 6) AS q, ROUND(GREATEST(0.0, (wee - we * we / w - (k - 1)) / (wee - we * we / w)), 6) AS i_squared FROM g",
    "pooled_site_interval": _SITES + f"SELECT ROUND(we / w, 6) AS point, ROUND(we / w - {Z} * SQRT(1 / w), 6) AS lower, ROUND(we / w + {Z} * SQRT(1 / w), 6) AS upper FROM g",
    "censoring_survival": f"WITH {ARMED_CTE}, {curve_cte('SELECT exposed, ecog, prior_bucket, follow_up_months AS t, NOT event AS died, 1.0 AS w FROM armed', 'exposed, ecog, prior_bucket')} SELECT exposed, ecog, prior_bucket, t AS knot, ROUND(GREATEST(survival, 0.05), 6) AS g FROM k",
    "q_function": f"""WITH {ARMED_CTE}, n AS (SELECT exposed, ecog, prior_bucket, LEAST(follow_up_months, horizon_months) AS knot, COUNT(*) AS n FROM armed GROUP BY ALL)
SELECT exposed, ecog, prior_bucket, knot, ROUND(SUM(CAST(ROUND(knot * 100) AS BIGINT) * n) OVER w / 100.0 / SUM(n) OVER w + 1e-9, 6) AS q FROM n WINDOW w AS (PARTITION BY exposed, ecog, prior_bucket ORDER BY knot DESC)""",
    "weighted_km": f"""WITH {ARMED_CTE}, c AS (SELECT exposed, ecog, COUNT(*) AS n FROM armed GROUP BY ALL),
f AS (SELECT exposed, ecog, CAST(SUM(n) OVER (PARTITION BY ecog) AS DOUBLE) / SUM(n) OVER () / (CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY exposed)) AS w FROM c),
{curve_cte('SELECT exposed, follow_up_months AS t, event AS died, w FROM armed JOIN f USING (exposed, ecog)', 'exposed')} SELECT exposed, t AS month, ROUND(at_risk, 4) AS at_risk, ROUND(survival, 6) AS survival FROM k""",
}
