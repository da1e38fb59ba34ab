"""Seeded cohort generation on Spark, and its closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import MULTIPLIERS, uniform, weibull
from tessera.sources.model import DECISION_CTE, decisions

SHAPE, SCALE, CENSOR_SCALE, HORIZON = 1.3, 6.0, 9.0, 5.5
EFFECT = -0.4


def cohort(spark, sf_dir) -> DataFrame:
    """Simulated follow-up for every decision: log-hazard from its covariates, Weibull event and censoring times, whichever first.

    Draws depend on the decision's key alone, so the cohort is the same however it is partitioned.
    """
    d = decisions(spark, sf_dir).select("decision_id", "site", "ecog", "prior_bucket")
    k = F.col("decision_id")
    treated = (uniform(k, 1) < 0.4).cast("int")
    eta = 0.18 * F.col("ecog") + 0.05 * F.col("prior_bucket") + EFFECT * treated
    d = d.withColumn("treated", treated).withColumn("eta", eta)
    event, lost = weibull(uniform(k, 2), F.col("eta"), SHAPE, SCALE), weibull(uniform(k, 3), F.lit(0.0), SHAPE, CENSOR_SCALE)
    return d.withColumn("follow_up", F.greatest(F.lit(0.02), F.least(event, lost, F.lit(1.4 * HORIZON)))).withColumn("event", (event <= lost) & (event <= 1.4 * HORIZON))


def generated_cohort(spark, sf_dir):
    c = cohort(spark, sf_dir)
    return c.groupBy("site", "treated").agg(F.count("*").alias("n"), F.count_if("event").alias("events"), F.round(F.avg(F.least("follow_up", F.lit(HORIZON))), 4).alias("mean_follow_up"))


def _u(stream: int) -> str:
    return f"((((decision_id * {MULTIPLIERS[stream]} + 12345) % 2147483647) * 16807 + {stream}) % 2147483647 + CAST(0.5 AS DOUBLE)) / CAST(2147483647.0 AS DOUBLE)"


_COHORT = f"""WITH {DECISION_CTE}, t AS (SELECT decision_id, site, CASE WHEN {_u(1)} < 0.4 THEN 1 ELSE 0 END AS treated, ecog, prior_bucket FROM decision),
e AS (SELECT *, CAST(0.18 AS DOUBLE) * ecog + CAST(0.05 AS DOUBLE) * prior_bucket + CAST({EFFECT} AS DOUBLE) * treated AS eta FROM t),
x AS (SELECT *, {SCALE} * POW(-LN({_u(2)}) / EXP(eta), CAST({1 / SHAPE} AS DOUBLE)) AS ev, {CENSOR_SCALE} * POW(-LN({_u(3)}), CAST({1 / SHAPE} AS DOUBLE)) AS lost FROM e)"""
QUERIES = {f.__name__: f for f in (generated_cohort,)}
SQL = {
    "generated_cohort": f"{_COHORT} SELECT site, treated, COUNT(*) AS n, COUNT(*) FILTER (ev <= lost AND ev <= {1.4 * HORIZON}) AS events, ROUND(AVG(LEAST(GREATEST(0.02, LEAST(ev, lost, {1.4 * HORIZON})), {HORIZON})), 4) AS mean_follow_up FROM x GROUP BY 1, 2",
}
