"""A battery of invariants over the engine's own results: one row per check, with the number of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.operators import survival as S
from tessera.plans import clones, cohort, ranking, survival
from tessera.plans.survival import ARMED_CTE, curve_cte
from tessera.sources.model import decisions

CHECKS = ("survival_monotone", "survival_in_unit_interval", "decisions_unique", "folds_cover_patients", "clones_twice_decisions", "shares_sum_to_one", "eligible_and_blocked_add_up", "marginals_add_up")


def verification_rollup(spark, sf_dir):
    from pyspark.sql import Window

    steps = S.curve(survival.armed(spark, sf_dir), ["line", "exposed"], "follow_up_months", "event")
    rise = steps.withColumn("up", F.col("survival") > F.lag("survival").over(Window.partitionBy("line", "exposed").orderBy("t")) + 1e-12)
    d = decisions(spark, sf_dir)
    shares = ranking.softmax(spark, sf_dir).groupBy("decision_id").agg(F.sum("share").alias("s"))
    n = cohort.marginal_counts(spark, sf_dir)
    total = n.where("label <> '_total'").groupBy("variable").agg(F.sum("n").alias("n")).join(n.where("label = '_total'").select("variable", F.col("n").alias("t")), "variable")
    bad = {
        "survival_monotone": rise.agg(F.count_if("up").alias("v")),
        "survival_in_unit_interval": steps.agg(F.count_if((F.col("survival") < -1e-12) | (F.col("survival") > 1 + 1e-12)).alias("v")),
        "decisions_unique": d.agg((F.count("*") - F.count_distinct("decision_id")).alias("v")),
        "folds_cover_patients": d.select("patient_id").distinct().join(cohort.fold_assignment(spark, sf_dir), "patient_id", "left_anti").agg(F.count("*").alias("v")),
        "clones_twice_decisions": clones.clones(spark, sf_dir).groupBy("decision_id").agg(F.count("*").alias("n")).where("n <> 2").agg(F.count("*").alias("v")),
        "shares_sum_to_one": shares.where("abs(s - 1) > 1e-4").agg(F.count("*").alias("v")),
        "eligible_and_blocked_add_up": ranking.eligible_sizes(spark, sf_dir).where("eligible > scored").agg(F.count("*").alias("v")),
        "marginals_add_up": total.where("n <> t").agg(F.count("*").alias("v")),
    }
    rows = [df.select(F.lit(name).alias("name"), F.col("v").cast("bigint").alias("violations")) for name, df in bad.items()]
    return reduce(lambda a, b: a.union(b), rows).select("name", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"), "violations")


#: The family of each check.
FAMILIES = {"survival": CHECKS[:2], "cohort": (CHECKS[2], CHECKS[3], CHECKS[7]), "estimation": (CHECKS[4],), "gate": (CHECKS[5], CHECKS[6])}
_FAMILY = "CASE name " + " ".join(f"WHEN '{c}' THEN '{f}'" for f, cs in FAMILIES.items() for c in cs) + " END"


def verification_by_family(spark, sf_dir):
    """Checks of each family, how many passed, its status (that of its worst check) and which are outstanding."""
    r = verification_rollup(spark, sf_dir).withColumn("family", F.expr(_FAMILY))
    passed = F.col("status") == "PASS"
    return r.groupBy("family").agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"), F.min("status").alias("status"), F.concat_ws(",", F.sort_array(F.collect_list(F.when(~passed, F.col("name"))))).alias("outstanding")).select(
        "family", "n", "passed", "status", "outstanding"
    )


QUERIES = {"verification_rollup": verification_rollup, "verification_by_family": verification_by_family}
_ROLLUP = f"""WITH {ARMED_CTE}, {curve_cte('SELECT line, exposed, follow_up_months AS t, event AS died, 1.0 AS w FROM armed', 'line, exposed')},
u AS (SELECT survival > lag(survival) OVER (PARTITION BY line, exposed ORDER BY t) + 1e-12 AS up FROM k),
vf AS ({cohort.SQL['fold_assignment']}), vc AS ({clones._C} SELECT decision_id, COUNT(*) AS n FROM clone GROUP BY 1), vs AS ({ranking.SQL['softmax']}), ve AS ({ranking.SQL['eligible_sizes']}), vm AS ({cohort.SQL['marginal_counts']}),
v AS (SELECT 'survival_monotone' AS name, COUNT(*) FILTER (up) AS violations FROM u UNION ALL SELECT 'survival_in_unit_interval', COUNT(*) FILTER (survival < -1e-12 OR survival > 1 + 1e-12) FROM k
  UNION ALL SELECT 'decisions_unique', COUNT(*) - COUNT(DISTINCT decision_id) FROM decision
  UNION ALL SELECT 'folds_cover_patients', COUNT(*) FROM (SELECT DISTINCT patient_id FROM decision) p WHERE NOT EXISTS (SELECT 1 FROM vf WHERE vf.patient_id = p.patient_id)
  UNION ALL SELECT 'clones_twice_decisions', COUNT(*) FROM vc WHERE n <> 2
  UNION ALL SELECT 'shares_sum_to_one', COUNT(*) FROM (SELECT decision_id FROM vs GROUP BY 1 HAVING ABS(SUM(share) - 1) > 1e-4)
  UNION ALL SELECT 'eligible_and_blocked_add_up', COUNT(*) FROM ve WHERE eligible > scored
  UNION ALL SELECT 'marginals_add_up', COUNT(*) FROM (SELECT variable FROM vm GROUP BY 1 HAVING SUM(n) FILTER (label <> '_total') <> SUM(n) FILTER (label = '_total'))),
w AS (SELECT name, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(violations AS BIGINT) AS violations FROM v)"""
SQL = {
    "verification_rollup": f"{_ROLLUP} SELECT * FROM w",
    "verification_by_family": f"""{_ROLLUP} SELECT {_FAMILY} AS family, COUNT(*) AS n, COUNT(*) FILTER (status = 'PASS') AS passed, MIN(status) AS status, COALESCE(string_agg(name, ',' ORDER BY name) FILTER (status <> 'PASS'), '') AS outstanding FROM w GROUP BY 1""",
}
