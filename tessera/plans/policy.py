"""Policy values, censoring integrals and summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import survival as S
from tessera.operators.order import as_of
from tessera.operators.ranking import at_depths, ranked
from tessera.plans import clones as C
from tessera.plans.ranking import SQL as RANKING
from tessera.plans.ranking import _gate, _metrics
from tessera.plans.survival import ARMED_CTE, armed, curve_cte
from tessera.sources.model import DECISION_CTE, EXPOSURE_CTE, SCORED_CTE, decisions, exposures, scored

DEPTHS = (1, 3, 5)


def _hits(spark, sf_dir) -> DataFrame:
    """Decisions with their restricted time and whether they started a recommended candidate within the grace window."""
    hit = C.clones(spark, sf_dir).where("strategy = 'top_agreement'").select("decision_id", (~F.col("censored")).alias("hit"), F.col("weight"))
    return decisions(spark, sf_dir).withColumn("y", F.least("follow_up_months", "horizon_months")).join(hit, "decision_id")


def _lost_curve(spark, sf_dir) -> DataFrame:
    d = decisions(spark, sf_dir).select(F.lit(1).alias("k"), "follow_up_months", (~F.col("event")).alias("lost"))
    return S.curve(d, ["k"], "follow_up_months", "lost")


def within_set_value(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("line").agg(F.round(F.avg(F.when(F.col("hit"), F.col("y"))), 6).alias("value"), F.count_if("hit").alias("hits"), F.count("*").alias("n"))


def _uncensored(h: DataFrame, spark, sf_dir) -> DataFrame:
    """h with ``g``, the censoring curve just before each restricted time."""
    return as_of(h.withColumn("k", F.lit(1)), _lost_curve(spark, sf_dir), ["k"], "y", "t", "survival", F.lit(1.0), "g", before=True).drop("k")


def weighted_agreement_value(spark, sf_dir):
    """Inverse-probability weighted restricted time of those who agreed and had their event, over the chance of being seen until then."""
    h = _uncensored(_hits(spark, sf_dir), spark, sf_dir)
    term = F.when(F.col("hit") & F.col("event"), F.col("y") * F.col("weight") / F.greatest("g", F.lit(0.05))).otherwise(0.0)
    return h.agg(F.round(F.avg(term), 6).alias("value"), F.count("*").alias("n"))


def policy_contrast(spark, sf_dir):
    r = C.clone_weighted_rmst(spark, sf_dir)
    arm = lambda s: F.max(F.when(F.col("strategy") == s, F.col("rmst")))
    return r.agg(F.round(arm("top_agreement") - arm("no_initiation"), 5).alias("difference"), F.round(arm("no_initiation"), 5).alias("no_initiation"))


def inverse_survival_integral(spark, sf_dir):
    """Integral of one over the floored censoring curve up to each knot, by its left values."""
    w = Window.partitionBy("k").orderBy("t")
    c = _lost_curve(spark, sf_dir).withColumn("g", F.greatest("survival", F.lit(0.05)))
    width = F.col("t") - F.coalesce(F.lag("t").over(w), F.lit(0.0))
    piece = c.withColumn("piece", width / F.coalesce(F.lag("g").over(w), F.lit(1.0)))
    return piece.select(F.col("t").alias("knot"), F.round(F.sum("piece").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("integral"))


def martingale_mean(spark, sf_dir):
    """Censorings observed less those the cumulative hazard expects, per censoring key: sums that cancel."""
    keys = ["exposed", "ecog", "prior_bucket"]
    d = armed(spark, sf_dir).select(*keys, "follow_up_months", (~F.col("event")).alias("lost"))
    c = S.curve(d, keys, "follow_up_months", "lost")
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    h = c.withColumn("hazard", F.sum(F.try_divide("deaths", F.col("at_risk"))).over(w))
    return h.groupBy(*keys).agg(F.sum("deaths").cast("bigint").alias("lost"), F.round(F.sum(F.col("n") * F.col("hazard")), 4).alias("expected"), F.sum("n").cast("bigint").alias("n"))


def metric_tables(spark, sf_dir):
    """Mean hits, recall and nDCG by line and depth."""
    r = ranked(scored(spark, sf_dir), "decision_id", "propensity", "candidate")
    line = decisions(spark, sf_dir).select("decision_id", "line")
    return at_depths(r, "decision_id", "score", DEPTHS).join(line, "decision_id").groupBy("line", "depth").agg(*[F.round(F.avg(c) + 1e-9, 5).alias(c) for c in ("hits", "recall", "ndcg")], F.count("*").alias("n"))


def seed_dispersion(spark, sf_dir):
    """Spread of a read-out over repeats, here the sites: sample deviation, 0 for fewer than two."""
    m = _metrics(spark, sf_dir).join(decisions(spark, sf_dir).select("decision_id", "site"), "decision_id").groupBy("site").agg(F.avg("ndcg").alias("m"))
    return m.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 6).alias("sd"), F.count("*").alias("repeats"))


def gate_diagnostics(spark, sf_dir):
    g = _gate(spark, sf_dir)
    return g.agg(F.count("*").alias("n"), F.count_if("act").alias("acted"), F.count_if(F.col("harm") != "").alias("with_harm"), F.count_if(F.col("ranking") == "").alias("empty"), F.round(F.avg((~F.col("act")).cast("double")), 6).alias("deferral_rate"))


def design_summary(spark, sf_dir):
    d, x = decisions(spark, sf_dir), exposures(spark, sf_dir)
    return d.agg(F.count("*").alias("decisions"), F.count_distinct("patient_id").alias("patients"), F.count_if("event").alias("events")).crossJoin(x.agg(F.count("*").alias("exposures"), F.count_distinct("candidate").alias("candidates")))


def censoring_keys(spark, sf_dir):
    """Decisions of each censoring key in both arms, each decision counted in either."""
    d = decisions(spark, sf_dir).groupBy("ecog", "prior_bucket").agg(F.count("*").alias("n"))
    return d.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("arm"), "ecog", "prior_bucket", "n")


def reference_vector(spark, sf_dir):
    """A decision's covariates on a common scale, clipped to [-1, 1]."""
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    d = decisions(spark, sf_dir)
    return d.select("decision_id", F.col("ecog").cast("double").alias("v1"), (F.col("prior_bucket") / 2.0).alias("v2"), F.round(clip(F.col("c_acctbal") / 5000.0 - 1.0), 6).alias("v3"), F.when(F.col("site") == "ASIA", 1.0).otherwise(0.0).alias("v4"))


def candidate_spread(spark, sf_dir):
    """Size-weighted mean spread of scores within candidates: the floor that no ordering of candidates can go below."""
    c = scored(spark, sf_dir).groupBy("candidate").agg(F.count("*").alias("n"), F.stddev_pop("score").alias("sd"))
    return c.agg(F.round(F.sum(F.col("n") * F.col("sd")) / F.sum("n"), 6).alias("floor"), F.count("*").alias("candidates"))


_LOST = curve_cte("SELECT 1 AS one, follow_up_months AS t, NOT event AS died, 1.0 AS w FROM decision", "one").replace("s AS (", "s0 AS (", 1).replace("FROM s)", "FROM s0)")
_CLONE = C._C
_HIT = f"{_CLONE}, h AS (SELECT d.*, LEAST(d.follow_up_months, horizon_months) AS y, NOT c.censored AS hit, c.weight FROM decision d JOIN clone c ON c.decision_id = d.decision_id AND c.strategy = 'top_agreement')"
_KEY = curve_cte("SELECT exposed, ecog, prior_bucket, follow_up_months AS t, NOT event AS died, 1.0 AS w FROM armed", "exposed, ecog, prior_bucket")
_DEPTH = "(SELECT unnest([1, 3, 5]) AS depth)"
QUERIES = {f.__name__: f for f in (within_set_value, weighted_agreement_value, policy_contrast, inverse_survival_integral, martingale_mean, metric_tables, seed_dispersion, gate_diagnostics, design_summary, censoring_keys, reference_vector, candidate_spread)}
SQL = {
    "within_set_value": f"{_HIT} SELECT line, ROUND(AVG(y) FILTER (hit), 6) AS value, COUNT(*) FILTER (hit) AS hits, COUNT(*) AS n FROM h GROUP BY 1",
    "weighted_agreement_value": f"{_HIT}, {_LOST} SELECT ROUND(AVG(CASE WHEN hit AND event THEN y * weight / GREATEST(COALESCE(survival, 1.0), 0.05) ELSE 0.0 END), 6) AS value, COUNT(*) AS n FROM h ASOF LEFT JOIN k ON h.y > k.t",
    "policy_contrast": f"WITH x AS ({C.SQL['clone_weighted_rmst']}) SELECT ROUND(MAX(CASE WHEN strategy = 'top_agreement' THEN rmst END) - MAX(CASE WHEN strategy = 'no_initiation' THEN rmst END), 5) AS difference, ROUND(MAX(CASE WHEN strategy = 'no_initiation' THEN rmst END), 5) AS no_initiation FROM x",
    "inverse_survival_integral": f"""WITH {DECISION_CTE}, {_LOST}, p AS (SELECT t, (t - COALESCE(lag(t) OVER (ORDER BY t), 0.0)) / (CASE WHEN lag(t) OVER (ORDER BY t) IS NULL THEN 1.0 ELSE GREATEST(lag(survival) OVER (ORDER BY t), 0.05) END) AS piece FROM k)
SELECT t AS knot, ROUND(SUM(piece) OVER (ORDER BY t), 6) AS integral FROM p""",
    "martingale_mean": f"""WITH {ARMED_CTE}, {_KEY}, z AS (SELECT *, SUM(deaths / at_risk) OVER (PARTITION BY exposed, ecog, prior_bucket ORDER BY t) AS hazard FROM k)
SELECT exposed, ecog, prior_bucket, CAST(SUM(deaths) AS BIGINT) AS lost, ROUND(SUM(n * hazard), 4) AS expected, CAST(SUM(n) AS BIGINT) AS n FROM z GROUP BY 1, 2, 3""",
    "metric_tables": f"""WITH {DECISION_CTE}, {SCORED_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY propensity DESC, candidate) AS rk, GREATEST(score, 0.0) AS gain, CASE WHEN score > 0 THEN 1 ELSE 0 END AS rel FROM scored),
m AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY gain DESC) AS ideal FROM r),
e AS (SELECT decision_id, depth, CAST(SUM(CASE WHEN rk <= depth THEN rel ELSE 0 END) AS DOUBLE) / LEAST(depth, COUNT(*)) AS hits, COALESCE(CAST(SUM(CASE WHEN rk <= depth THEN rel ELSE 0 END) AS DOUBLE) / NULLIF(SUM(rel), 0), 0.0) AS recall,
  COALESCE(SUM(CASE WHEN rk <= depth THEN gain / log2(rk + 1.0) END) / NULLIF(SUM(CASE WHEN ideal <= depth THEN gain / log2(ideal + 1.0) END), 0), 0.0) AS ndcg FROM m, {_DEPTH} GROUP BY 1, 2)
SELECT line, depth, ROUND(AVG(hits) + 1e-9, 5) AS hits, ROUND(AVG(recall) + 1e-9, 5) AS recall, ROUND(AVG(ndcg) + 1e-9, 5) AS ndcg, COUNT(*) AS n FROM e JOIN decision USING (decision_id) GROUP BY 1, 2""",
    "seed_dispersion": f"""WITH {DECISION_CTE}, x AS ({RANKING['ndcg_at_k'].replace('ROUND(COALESCE(SUM(', '(COALESCE(SUM(').replace(', 0.0), 6) AS ndcg', ', 0.0)) AS ndcg')}), m AS (SELECT site, AVG(ndcg) AS m FROM x JOIN decision USING (decision_id) GROUP BY 1)
SELECT ROUND(AVG(m), 6) AS mean, ROUND(COALESCE(STDDEV_SAMP(m), 0.0), 6) AS sd, COUNT(*) AS repeats FROM m""",
    "gate_diagnostics": f"WITH x AS ({RANKING['gate_decisions']}) SELECT COUNT(*) AS n, COUNT(*) FILTER (act) AS acted, COUNT(*) FILTER (harm <> '') AS with_harm, COUNT(*) FILTER (ranking = '') AS empty, ROUND(AVG(CASE WHEN act THEN 0.0 ELSE 1.0 END), 6) AS deferral_rate FROM x",
    "design_summary": f"WITH {DECISION_CTE}, {EXPOSURE_CTE} SELECT (SELECT COUNT(*) FROM decision) AS decisions, (SELECT COUNT(DISTINCT patient_id) FROM decision) AS patients, (SELECT COUNT(*) FILTER (event) FROM decision) AS events, COUNT(*) AS exposures, COUNT(DISTINCT candidate) AS candidates FROM exposure",
    "censoring_keys": f"WITH {DECISION_CTE} SELECT arm, ecog, prior_bucket, COUNT(*) AS n FROM decision, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS arm) GROUP BY 1, 2, 3",
    "reference_vector": f"WITH {DECISION_CTE} SELECT decision_id, CAST(ecog AS DOUBLE) AS v1, prior_bucket / 2.0 AS v2, ROUND(GREATEST(-1.0, LEAST(1.0, c_acctbal / 5000.0 - 1.0)), 6) AS v3, CAST(CASE WHEN site = 'ASIA' THEN 1 ELSE 0 END AS DOUBLE) AS v4 FROM decision",
    "candidate_spread": f"WITH {SCORED_CTE}, c AS (SELECT candidate, COUNT(*) AS n, STDDEV_POP(score) AS sd FROM scored GROUP BY 1) SELECT ROUND(SUM(n * sd) / SUM(n), 6) AS floor, COUNT(*) AS candidates FROM c",
}
