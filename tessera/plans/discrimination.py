"""Discrimination, calibration and clinical-utility read-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.model import DECISION_CTE, RATED_CTE, decisions, rated
from tessera.sources.stored import cut, spread

BINS, MONTH = 10, 4.0


def brier(spark, sf_dir):
    r = rated(spark, sf_dir)
    return r.agg(F.round(F.avg((F.col("p") - F.col("outcome")) * (F.col("p") - F.col("outcome"))), 6).alias("brier"), F.count("*").alias("n"))


def ece(spark, sf_dir):
    """Mass-weighted gap of mean probability and event rate over equal-width bins."""
    b = rated(spark, sf_dir).groupBy(F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("outcome").alias("y"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"))


def _ranks(rows: DataFrame, score: str) -> DataFrame:
    """Distinct scores with cases, controls and the controls below: what rank statistics need, one row per distinct score."""
    d = rows.groupBy(score).agg(F.sum("case").alias("cases"), F.sum("control").alias("controls"))
    w = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("below", F.sum("controls").over(w) - F.col("controls"))


def auroc(spark, sf_dir):
    """Mann-Whitney share of (case, control) pairs in order, ties one half; never forms the pairs."""
    r = rated(spark, sf_dir).select("p", F.col("outcome").alias("case"), (1 - F.col("outcome")).alias("control"))
    a = _ranks(r, "p").agg(F.sum(F.col("cases") * (F.col("below") + F.col("controls") / 2.0)).alias("won"), F.sum("cases").alias("cases"), F.sum("controls").alias("controls"))
    return a.select(F.round(F.try_divide("won", F.col("cases") * F.col("controls")), 6).alias("auroc"), "cases", "controls")


def td_auroc(spark, sf_dir):
    """Cases have their event by the month, controls are followed beyond it; those lost before are neither."""
    d = decisions(spark, sf_dir).select(
        F.round("c_acctbal", 2).alias("s"), (F.col("event") & (F.col("follow_up_months") <= MONTH)).cast("bigint").alias("case"), (F.col("follow_up_months") > MONTH).cast("bigint").alias("control")
    ).where("case + control > 0")
    a = _ranks(d, "s").agg(F.sum(F.col("cases") * (F.col("below") + F.col("controls") / 2.0)).alias("won"), F.sum("cases").alias("cases"), F.sum("controls").alias("controls"))
    return a.select(F.round(F.try_divide("won", F.col("cases") * F.col("controls")), 6).alias("auroc"), "cases", "controls")


def concordance(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, pairs, c_index) of rows (*by, t, s, event), exact: pairs have the event first, equal scores count one half.

    Of two ranks of times the later one has a one where the other has a zero, in the highest bit that differs. So each pair is
    counted once, at that bit, among the ranks that agree above it: by running sums over the distinct scores there. Counts are
    dealt once, by bit and what is above it, to tasks whose number goes with that of the counts.
    """
    n = cut(rows.where("t is not null and s is not null").groupBy(*by, "t", "s").agg(F.count("*").alias("n"), F.count_if("event").alias("events")))
    times = n.select(*by, "t").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("t")))
    times = cut(times.withColumn("bits", F.length(F.bin(F.max("rank").over(Window.partitionBy(*by))))))
    most = times.agg(F.max("bits")).first()[0] or 1
    size = n.count() * most
    # A row becomes one for each bit: what writes these takes shares of a size of its own, four of the readers' shares.
    met = spread(n.join(times, [*by, "t"]), size // 4, *by, "t", "s")
    rank = met.select(*by, "s", "n", "events", "rank", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("bit"))
    one = F.expr("shiftright(rank, bit) & 1") == 1
    level = [*by, "bit", "above"]
    dealt = spread(rank.withColumn("above", F.expr("shiftright(shiftright(rank, bit), 1)")), size, *level)
    d = dealt.groupBy(*level, "s").agg(F.sum(F.when(one, F.col("n")).otherwise(0)).alias("later"), F.sum(F.when(one, 0).otherwise(F.col("events"))).alias("events"))
    w = Window.partitionBy(*level)
    d = d.withColumn("all", F.sum("later").over(w)).withColumn("lower", F.sum("later").over(w.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("later"))
    pairs = d.groupBy(*by).agg(F.sum(F.col("events") * F.col("all")).alias("pairs"), F.sum(F.col("events") * (F.col("lower") + F.col("later") / 2.0)).alias("agree"))
    return pairs.where("pairs > 0").select(*by, "pairs", F.round(F.col("agree") / F.col("pairs"), 6).alias("c_index"))


def concordance_index(spark, sf_dir):
    """Harrell's C per site and line, of times and scores as they are; groups without comparable pairs have no row."""
    d = decisions(spark, sf_dir).select("site", "line", F.col("follow_up_months").alias("t"), F.col("c_acctbal").alias("s"), "event")
    return concordance(d, ["site", "line"])


def concordance_binned(spark, sf_dir):
    """Harrell's C per site and line of binned times and scores, so approximate: a cheaper look than ``concordance_index``.

    Scores are binned to a hundred levels and times to quarters of a month, so rows are first counted per (time, level). Over
    the grid of those, which the bins bound, later and lower counts are running sums: pairs are never formed.
    """
    d = decisions(spark, sf_dir).select("site", "line", F.round(F.col("follow_up_months") * 4).cast("int").alias("t"), F.floor((F.col("c_acctbal") + 1000.0) / 110.0).cast("int").alias("s"), "event")
    by = ["site", "line"]
    n = d.groupBy(*by, "t", "s").agg(F.count("*").alias("n"), F.count_if("event").alias("events"))
    grid = n.select(*by, "t").distinct().join(n.select(*by, "s").distinct(), by).join(n, [*by, "t", "s"], "left").fillna(0, ["n", "events"])
    before = lambda keys, *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    later = grid.withColumn("later", F.coalesce(F.sum("n").over(before([*by, "s"], F.desc("t"))), F.lit(0)))
    lower = later.withColumn("lower", F.coalesce(F.sum("later").over(before([*by, "t"], "s")), F.lit(0))).withColumn("all", F.sum("later").over(Window.partitionBy(*by, "t")))
    pairs = lower.groupBy(*by).agg(F.sum(F.col("events") * F.col("all")).alias("pairs"), F.sum(F.col("events") * (F.col("lower") + F.col("later") / 2.0)).alias("agree"))
    return pairs.select("site", "line", "pairs", F.round(F.try_divide("agree", F.col("pairs")), 6).alias("c_index"))


def auprc(spark, sf_dir):
    """Trapezoid area under precision over recall, from (0, 1), ties in order of id.

    Rows are numbered among those of equal probability; what comes before is a running sum over the distinct probabilities.
    A step's predecessor is known from its own numbers, so steps meet no other.
    """
    r = rated(spark, sf_dir)
    own = Window.partitionBy("p").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = r.withColumn("tp", F.sum("outcome").over(own)).withColumn("at", F.count("*").over(own))
    n = r.groupBy("p").agg(F.count("*").alias("n"), F.sum("outcome").alias("hits"))
    w = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = n.select("p", (F.sum("n").over(w) - F.col("n")).alias("n_before"), (F.sum("hits").over(w) - F.col("hits")).alias("hits_before"), F.sum("hits").over(Window.partitionBy()).alias("total"))
    x = each.join(before, "p").select("outcome", (F.col("at") + F.col("n_before")).alias("at"), (F.col("tp") + F.col("hits_before")).alias("tp"), "total")
    precision = F.col("tp") / F.col("at")
    last = F.when(F.col("at") == 1, 1.0).otherwise((F.col("tp") - F.col("outcome")) / (F.col("at") - 1))
    return x.agg(F.round(F.sum(F.try_divide("outcome", F.col("total")) * (precision + last) / 2.0), 6).alias("auprc"))


def net_benefit(spark, sf_dir):
    """Net benefit and its advantage over treating all or none, over a grid of thresholds in one pass."""
    grid = (0.1, 0.2, 0.3, 0.5, 0.7)
    y, p = F.col("outcome") > 0, F.col("p")
    a = rated(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(y).alias("pos"), *[F.count_if(y & (p >= t)).alias(f"tp{i}") for i, t in enumerate(grid)], *[F.count_if(~y & (p >= t)).alias(f"fp{i}") for i, t in enumerate(grid)])
    odds = lambda t: t / (1 - t)
    nb = lambda i, t: (F.col(f"tp{i}") - F.col(f"fp{i}") * F.lit(odds(t))) / F.col("n")
    all_ = lambda t: F.greatest(F.lit(0.0), (F.col("pos") - (F.col("n") - F.col("pos")) * F.lit(odds(t))) / F.col("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.round(nb(i, t), 6).alias("net_benefit"), F.round(nb(i, t) - all_(t), 6).alias("advantage")) for i, t in enumerate(grid)]))
    return a.select(rows.alias("r")).select("r.*")


def nri(spark, sf_dir):
    """Categorical net reclassification at one half, of the second probability against the first."""
    up, down, y = F.expr("p2 >= 0.5 and p < 0.5"), F.expr("p2 < 0.5 and p >= 0.5"), F.col("outcome") > 0
    a = rated(spark, sf_dir).agg(*[F.count_if(c & e).alias(n) for n, c, e in (("ue", up, y), ("de", down, y), ("un", up, ~y), ("dn", down, ~y))], F.greatest(F.count_if(y), F.lit(1)).alias("e"), F.greatest(F.count_if(~y), F.lit(1)).alias("m"))
    return a.select(F.round((F.col("ue") - F.col("de")) / F.col("e") - (F.col("un") - F.col("dn")) / F.col("m"), 6).alias("nri"))


STEPS = 25


def calibration_slope(spark, sf_dir):
    """Logistic intercept and slope of the outcome on the probability's logit: Newton steps over counts of distinct logits, which are written once."""
    r = rated(spark, sf_dir).select(F.col("outcome").cast("double").alias("y"), F.log(F.greatest("p", F.lit(1e-6)) / F.greatest(1 - F.col("p"), F.lit(1e-6))).alias("x")).groupBy("x").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    r = cut(r)
    a = b = 0.0
    for _ in range(STEPS):
        m = 1.0 / (1.0 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w, e = F.col("n") * m * (1 - m), F.col("y") - F.col("n") * m
        s = r.agg(F.sum(e).alias("g0"), F.sum(e * F.col("x")).alias("g1"), F.sum(w).alias("h00"), F.sum(w * F.col("x")).alias("h01"), F.sum(w * F.col("x") * F.col("x")).alias("h11")).first()
        det = (s["h00"] or 0) * (s["h11"] or 0) - (s["h01"] or 0) ** 2
        if not det or abs(det) < 1e-12:
            break
        da, db = (s["h11"] * s["g0"] - s["h01"] * s["g1"]) / det, (s["h00"] * s["g1"] - s["h01"] * s["g0"]) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "intercept double, slope double")


_D = f"WITH {RATED_CTE}"
_TD = f"""WITH {DECISION_CTE}, d AS (SELECT ROUND(c_acctbal, 2) AS s, CASE WHEN event AND follow_up_months <= {MONTH} THEN 1 ELSE 0 END AS y, CASE WHEN follow_up_months > {MONTH} THEN 1 ELSE 0 END AS z FROM decision)"""
_MW = "SELECT ROUND(SUM(y * (CAST(below AS DOUBLE) + same / 2.0)) / (SUM(y) * SUM(z)), 6) AS auroc, CAST(SUM(y) AS BIGINT) AS cases, CAST(SUM(z) AS BIGINT) AS controls FROM (SELECT s, y, z, below, z AS same FROM (SELECT s, SUM(y) AS y, SUM(z) AS z, SUM(SUM(z)) OVER (ORDER BY s) - SUM(z) AS below FROM d GROUP BY s))"
QUERIES = {f.__name__: f for f in (brier, ece, auroc, td_auroc, concordance_index, concordance_binned, auprc, net_benefit, nri, calibration_slope)}
SQL = {
    "brier": f"{_D} SELECT ROUND(AVG((p - outcome) * (p - outcome)), 6) AS brier, COUNT(*) AS n FROM rated",
    "ece": f"{_D}, b AS (SELECT LEAST({BINS - 1}, FLOOR(p * {BINS})) AS bin, COUNT(*) AS n, AVG(p) AS p, AVG(outcome) AS y FROM rated GROUP BY 1) SELECT ROUND(SUM(n * ABS(p - y)) / SUM(n), 6) AS ece FROM b",
    "auroc": f"{_D}, d AS (SELECT p AS s, outcome AS y, 1 - outcome AS z FROM rated) {_MW}",
    "td_auroc": f"{_TD} {_MW}",
    "concordance_binned": f"""WITH {DECISION_CTE}, d AS (SELECT site, line, CAST(ROUND(follow_up_months * 4) AS INTEGER) AS t, CAST(FLOOR((c_acctbal + 1000.0) / 110.0) AS INTEGER) AS s, event FROM decision),
n AS (SELECT site, line, t, s, COUNT(*) AS n, COUNT(*) FILTER (event) AS e FROM d GROUP BY ALL)
SELECT a.site, a.line, CAST(SUM(a.e * b.n) AS BIGINT) AS pairs, ROUND(SUM(a.e * b.n * CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) / SUM(a.e * b.n), 6) AS c_index FROM n a JOIN n b ON a.site = b.site AND a.line = b.line AND b.t > a.t WHERE a.e > 0 GROUP BY 1, 2""",
    "concordance_index": f"""WITH {DECISION_CTE}, n AS (SELECT site, line, follow_up_months AS t, c_acctbal AS s, COUNT(*) AS n, COUNT(*) FILTER (event) AS e FROM decision WHERE c_acctbal IS NOT NULL GROUP BY ALL)
SELECT a.site, a.line, CAST(SUM(a.e * b.n) AS BIGINT) AS pairs, ROUND(SUM(a.e * b.n * CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) / SUM(a.e * b.n), 6) AS c_index FROM n a JOIN n b ON a.site = b.site AND a.line = b.line AND b.t > a.t WHERE a.e > 0 GROUP BY 1, 2""",
    "auprc": f"""{_D}, c AS (SELECT CAST(SUM(outcome) OVER w AS DOUBLE) AS tp, row_number() OVER (ORDER BY p DESC, doc_id) AS place, SUM(outcome) OVER () AS total FROM rated WINDOW w AS (ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING)),
x AS (SELECT place, tp / place AS prec, tp / total AS rec FROM c) SELECT ROUND(SUM(s), 6) AS auprc FROM (SELECT (rec - COALESCE(lag(rec) OVER (ORDER BY place), 0.0)) * (prec + COALESCE(lag(prec) OVER (ORDER BY place), 1.0)) / 2.0 AS s FROM x)""",
    "net_benefit": f"""{_D}, a AS (SELECT CAST(t AS DOUBLE) AS t, COUNT(*) AS n, SUM(outcome) AS pos, COUNT(*) FILTER (outcome = 1 AND p >= t) AS tp, COUNT(*) FILTER (outcome = 0 AND p >= t) AS fp FROM rated, (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7]) AS t) GROUP BY t)
SELECT t AS threshold, ROUND((tp - fp * (t / (1 - t))) / n, 6) AS net_benefit, ROUND((tp - fp * (t / (1 - t))) / n - GREATEST(0.0, (pos - (n - pos) * (t / (1 - t))) / n), 6) AS advantage FROM a""",
    "nri": f"""{_D} SELECT ROUND(CAST(COUNT(*) FILTER (outcome = 1 AND p2 >= 0.5 AND p < 0.5) - COUNT(*) FILTER (outcome = 1 AND p2 < 0.5 AND p >= 0.5) AS DOUBLE) / GREATEST(1, COUNT(*) FILTER (outcome = 1))
  - CAST(COUNT(*) FILTER (outcome = 0 AND p2 >= 0.5 AND p < 0.5) - COUNT(*) FILTER (outcome = 0 AND p2 < 0.5 AND p >= 0.5) AS DOUBLE) / GREATEST(1, COUNT(*) FILTER (outcome = 0)), 6) AS nri FROM rated""",
    "calibration_slope": f"""WITH RECURSIVE {RATED_CTE}, r AS (SELECT LN(GREATEST(p, 1e-6) / GREATEST(1 - p, 1e-6)) AS x, CAST(SUM(outcome) AS DOUBLE) AS y, COUNT(*) AS n FROM rated GROUP BY 1),
s AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b UNION ALL
  SELECT k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT k, a, b, SUM(y - n * m) AS g0, SUM((y - n * m) * x) AS g1, SUM(n * m * (1 - m)) AS h00, SUM(n * m * (1 - m) * x) AS h01, SUM(n * m * (1 - m) * x * x) AS h11
    FROM (SELECT k, a, b, x, y, n, 1 / (1 + EXP(-(a + b * x))) AS m FROM s, r WHERE k < {STEPS}) GROUP BY k, a, b))
SELECT ROUND(a, 6) AS intercept, ROUND(b, 6) AS slope FROM s WHERE k = {STEPS}""",
}
