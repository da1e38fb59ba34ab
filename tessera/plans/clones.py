"""Clone-censor-weight emulation of two strategies: start a recommended candidate within the grace window, or start none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import survival as S
from tessera.plans.survival import curve_cte
from tessera.sources.model import DECISION_CTE, decisions, table

GRACE_DAYS = {"first": 30, "second": 45, "third_plus": 60}
DAYS_PER_MONTH, HORIZON = 30.4375, 5.5
#: A candidate is recommended if its brand's number is odd; an order's lines start their brands on the day of their place.
RECOMMENDED = "CAST(regexp_replace(p_brand, '[^0-9]', {g}) AS INT) % 2 = 1"


def starts(spark, sf_dir) -> DataFrame:
    """(decision_id, day, recommended): when each line's candidate was started, days after the decision."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    odd = F.regexp_replace("p_brand", "[^0-9]", "").cast("int") % 2 == 1
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("decision_id"), (F.col("l_quantity") + 10 * F.col("l_linenumber")).cast("int").alias("day"), odd.alias("recommended"))


def clones(spark, sf_dir) -> DataFrame:
    """Two rows per decision, one for each strategy, with censoring, weight and observed time in months.

    The interval join (starts within the line's window) becomes one grouped minimum per decision and kind, so each decision
    meets a single row; the strategies are columns that are unfolded, not a join.
    """
    d = decisions(spark, sf_dir)
    grace = F.create_map(*[F.lit(x) for kv in GRACE_DAYS.items() for x in kv])[F.col("line")]
    s = starts(spark, sf_dir).groupBy("decision_id").agg(F.min("day").alias("any_day"), F.min(F.when(F.col("recommended"), F.col("day"))).alias("rec_day"))
    j = d.join(s, "decision_id", "left").withColumn("grace", grace)
    hit, started = F.coalesce(F.col("rec_day") <= F.col("grace"), F.lit(False)), F.coalesce(F.col("any_day") <= F.col("grace"), F.lit(False))
    p = F.when(F.col("ecog") == 1, 0.4).otherwise(0.6)
    top = F.struct(F.lit("top_agreement").alias("strategy"), (~hit).alias("censored"), F.when(hit, 0.0).otherwise(F.col("grace").cast("double")).alias("day"), (1.0 / p).alias("weight"))
    no = F.struct(F.lit("no_initiation").alias("strategy"), started.alias("censored"), F.when(started, F.col("any_day").cast("double")).otherwise(0.0).alias("day"), (1.0 / (1.0 - p)).alias("weight"))
    c = j.select("decision_id", "line", "follow_up_months", "event", F.explode(F.array(top, no)).alias("c")).select("decision_id", "line", "follow_up_months", "event", "c.*")
    time = F.when(F.col("censored"), F.least(F.col("day") / DAYS_PER_MONTH, F.col("follow_up_months"))).otherwise(F.col("follow_up_months"))
    return c.withColumn("time", F.round(time, 9)).withColumn("died", ~F.col("censored") & F.col("event"))


def clone_population(spark, sf_dir):
    c = clones(spark, sf_dir)
    return c.groupBy("strategy", "line").agg(F.count("*").alias("n"), F.count_if("censored").alias("censored"), F.count_if("died").alias("events"), F.round(F.sum(F.when(F.col("died"), F.col("weight"))), 4).alias("weighted_events"))


def clone_ess(spark, sf_dir):
    w = F.col("weight")
    return clones(spark, sf_dir).groupBy("strategy").agg(F.round(F.sum(w) * F.sum(w) / F.sum(w * w), 4).alias("ess"))


def clone_person_time(spark, sf_dir):
    return clones(spark, sf_dir).groupBy("strategy").agg(F.round(F.sum(F.col("weight") * F.least("time", F.lit(HORIZON))), 3).alias("person_months"))


def clone_weighted_rmst(spark, sf_dir):
    c = clones(spark, sf_dir).withColumn("h", F.lit(HORIZON))
    steps = S.curve(c, ["strategy", "h"], "time", "died", "weight")
    return S.restricted_mean(steps, ["strategy", "h"], "h").select("strategy", F.round("rmst", 6).alias("rmst"))


def initiation_agreement(spark, sf_dir):
    """Decisions by line, and how many started a recommended candidate, another, or none inside the window."""
    c = clones(spark, sf_dir)
    flags = c.groupBy("decision_id", "line").agg(F.max(F.when(F.col("strategy") == "top_agreement", (~F.col("censored")).cast("int"))).alias("hit"), F.max(F.when(F.col("strategy") == "no_initiation", F.col("censored").cast("int"))).alias("any"))
    return flags.groupBy("line").agg(F.count("*").alias("n"), F.sum("hit").alias("agreement"), F.sum(F.col("any") - F.col("hit")).alias("other"), F.sum(1 - F.col("any")).alias("none"))


_C = f"""WITH {DECISION_CTE}, s AS (SELECT l_orderkey AS decision_id, MIN(CAST(l_quantity + 10 * l_linenumber AS INTEGER)) AS any_day,
  MIN(CAST(l_quantity + 10 * l_linenumber AS INTEGER)) FILTER (CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) % 2 = 1) AS rec_day FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
j AS (SELECT d.*, any_day, rec_day, CASE line WHEN 'first' THEN 30 WHEN 'second' THEN 45 ELSE 60 END AS grace, CASE WHEN ecog = 1 THEN 0.4 ELSE 0.6 END AS p FROM decision d LEFT JOIN s USING (decision_id)),
b AS (SELECT decision_id, line, follow_up_months, event, 'top_agreement' AS strategy, NOT COALESCE(rec_day <= grace, FALSE) AS censored, CASE WHEN COALESCE(rec_day <= grace, FALSE) THEN 0.0 ELSE CAST(grace AS DOUBLE) END AS day, 1.0 / CAST(p AS DOUBLE) AS weight FROM j
  UNION ALL SELECT decision_id, line, follow_up_months, event, 'no_initiation', COALESCE(any_day <= grace, FALSE), CASE WHEN COALESCE(any_day <= grace, FALSE) THEN CAST(any_day AS DOUBLE) ELSE 0.0 END, 1.0 / (1.0 - CAST(p AS DOUBLE)) FROM j),
clone AS (SELECT *, ROUND(CASE WHEN censored THEN LEAST(day / {DAYS_PER_MONTH}, follow_up_months) ELSE follow_up_months END, 9) AS time, NOT censored AND event AS died FROM b)"""
QUERIES = {f.__name__: f for f in (clone_population, clone_ess, clone_person_time, clone_weighted_rmst, initiation_agreement)}
SQL = {
    "clone_population": f"{_C} SELECT strategy, line, COUNT(*) AS n, COUNT(*) FILTER (censored) AS censored, COUNT(*) FILTER (died) AS events, ROUND(SUM(weight) FILTER (died), 4) AS weighted_events FROM clone GROUP BY 1, 2",
    "clone_ess": f"{_C} SELECT strategy, ROUND(SUM(weight) * SUM(weight) / SUM(weight * weight), 4) AS ess FROM clone GROUP BY 1",
    "clone_person_time": f"{_C} SELECT strategy, ROUND(SUM(weight * LEAST(time, {HORIZON})), 3) AS person_months FROM clone GROUP BY 1",
    "clone_weighted_rmst": f"""{_C}, {curve_cte('SELECT strategy, time AS t, died, weight AS w FROM clone', 'strategy').replace('s AS', 'steps AS', 1).replace('FROM s)', 'FROM steps)')}
SELECT strategy, ROUND(SUM(survival * GREATEST(LEAST(COALESCE(nxt, {HORIZON}), {HORIZON}) - LEAST(t, {HORIZON}), 0.0)) + SUM(CASE WHEN rn = 1 THEN LEAST(t, {HORIZON}) ELSE 0.0 END), 6) AS rmst FROM k GROUP BY strategy""",
    "initiation_agreement": f"""{_C}, f AS (SELECT decision_id, line, MAX(CASE WHEN strategy = 'top_agreement' THEN CAST(NOT censored AS INTEGER) END) AS hit, MAX(CASE WHEN strategy = 'no_initiation' THEN CAST(censored AS INTEGER) END) AS any_ FROM clone GROUP BY 1, 2)
SELECT line, COUNT(*) AS n, CAST(SUM(hit) AS BIGINT) AS agreement, CAST(SUM(any_ - hit) AS BIGINT) AS other, CAST(SUM(1 - any_) AS BIGINT) AS none FROM f GROUP BY 1""",
}
