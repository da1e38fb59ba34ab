"""Ranking, gate, eligibility and policy read-outs over scored (decision, candidate) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import at_k, ranked
from tessera.sources.model import DECISION_CTE, SCORED_CTE, decisions, scored
from tessera.sources.stored import cut

K, EPSILON, N_MIN, ALPHA, MARGIN = 3, 0.05, 40, 0.1, 0.0
#: What separates trimmed candidates: exposure is tested first.
REASON = f"CASE WHEN exposed < {N_MIN} THEN 'exposure below minimum' WHEN propensity < {EPSILON} OR propensity > {1 - EPSILON} THEN 'propensity trimmed' END"


def _counted(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    """Scored pairs (s if given) with their candidate's exposure count and the reason, if any, that they are not eligible."""
    s = scored(spark, sf_dir) if s is None else s
    n = s.groupBy("candidate").agg(F.count("*").alias("exposed"))
    return s.join(n, "candidate").withColumn("reason", F.expr(REASON))


def eligibility_partition(spark, sf_dir):
    c = _counted(spark, sf_dir)
    return c.groupBy(F.coalesce("reason", F.lit("eligible")).alias("status")).agg(F.count("*").alias("n"), F.count_distinct("candidate").alias("candidates"))


def eligible_sizes(spark, sf_dir):
    return _counted(spark, sf_dir).groupBy("decision_id").agg(F.count_if(F.col("reason").isNull()).alias("eligible"), F.count("*").alias("scored"))


def trimming_sweep(spark, sf_dir):
    """Share of propensities outside [e, 1 - e] over a grid of e, in one pass: the grid is columns, not a join."""
    grid = (0.01, 0.02, 0.05, 0.1, 0.2)
    p = F.col("propensity")
    outside = lambda e: F.count_if((p < e) | (p > 1 - e))
    one = scored(spark, sf_dir).agg(F.count("*").alias("n"), *[outside(e).alias(f"c{i}") for i, e in enumerate(grid)])
    rows = F.explode(F.array(*[F.struct(F.lit(e).alias("epsilon"), F.round(F.col(f"c{i}") / F.col("n"), 6).alias("rate")) for i, e in enumerate(grid)]))
    return one.select(rows.alias("r")).select("r.*")


def propensity_margins(spark, sf_dir):
    m = F.least(F.col("propensity") - EPSILON, 1 - EPSILON - F.col("propensity"))
    return scored(spark, sf_dir).groupBy("candidate").agg(F.round(F.min(m), 6).alias("least_margin"), F.round(F.min("propensity"), 6).alias("low"), F.round(F.max("propensity"), 6).alias("high"))


def _metrics(spark, sf_dir) -> DataFrame:
    s = ranked(scored(spark, sf_dir), "decision_id", "propensity", "candidate")
    return at_k(s, "decision_id", "score", K)


def hits_at_k(spark, sf_dir):
    return _metrics(spark, sf_dir).select("decision_id", F.round("hits", 6).alias("hits"))


def ndcg_at_k(spark, sf_dir):
    return _metrics(spark, sf_dir).select("decision_id", F.round("ndcg", 6).alias("ndcg"))


def recall_at_k(spark, sf_dir):
    return _metrics(spark, sf_dir).select("decision_id", F.round("recall", 6).alias("recall"))


def average_precision(spark, sf_dir):
    return _metrics(spark, sf_dir).select("decision_id", F.round(F.col("average_precision") + 1e-9, 6).alias("average_precision"))


def _top(spark, sf_dir, score: str) -> DataFrame:
    r = ranked(scored(spark, sf_dir), "decision_id", score, "candidate").where(F.col("rank") <= K)
    return r.groupBy("decision_id").agg(F.collect_set("candidate").alias("top"))


def top_k_jaccard(spark, sf_dir):
    """Overlap of the top sets by score and by propensity; two empty sets overlap whole."""
    a, b = _top(spark, sf_dir, "score"), _top(spark, sf_dir, "propensity").withColumnRenamed("top", "other")
    return a.join(b, "decision_id").select("decision_id", F.round(F.size(F.array_intersect("top", "other")) / F.size(F.array_union("top", "other")), 6).alias("jaccard"))


def mean_pairwise_jaccard(spark, sf_dir):
    """Mean overlap of the candidates' sets of patients, over all pairs of candidates.

    Pairs come from shared patients: an equi-join on the patient, never a product of the sets.
    """
    d = decisions(spark, sf_dir).select("decision_id", "patient_id")
    s = scored(spark, sf_dir).join(d, "decision_id").select("candidate", "patient_id").distinct()
    n = s.groupBy("candidate").agg(F.count("*").alias("n"))
    both = s.alias("a").join(s.alias("b"), "patient_id").where("a.candidate < b.candidate").groupBy(F.col("a.candidate").alias("a"), F.col("b.candidate").alias("b")).agg(F.count("*").alias("both"))
    j = both.join(n.select(F.col("candidate").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("candidate").alias("b"), F.col("n").alias("nb")), "b")
    k = n.agg(F.count("*").alias("k"))
    return j.agg(F.sum(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("s")).crossJoin(k).select(F.round(F.col("s") / (F.col("k") * (F.col("k") - 1) / 2), 6).alias("mean_jaccard"))


def policy_value_k(spark, sf_dir):
    """Mean over decisions of the mean leading-k positive score; decisions without one count 0."""
    r = ranked(scored(spark, sf_dir).where("score > 0"), "decision_id", "score", "candidate").where(F.col("rank") <= K)
    v = r.groupBy("decision_id").agg(F.avg("score").alias("v"))
    all_ = decisions(spark, sf_dir).select("decision_id").join(v, "decision_id", "left").select(F.coalesce("v", F.lit(0.0)).alias("v"))
    return all_.agg(F.round(F.avg("v"), 6).alias("value"), F.round(F.stddev_samp("v") / F.sqrt(F.count("*")), 6).alias("se"), F.count("*").alias("n"))


def selection_regret(spark, sf_dir):
    """Best-k mean score minus that of the first k by name, averaged over decisions."""
    s = scored(spark, sf_dir)
    w = Window.partitionBy("decision_id")
    r = s.withColumn("best", F.row_number().over(w.orderBy(F.desc("score"), "candidate"))).withColumn("rule", F.row_number().over(w.orderBy("candidate")))
    d = r.groupBy("decision_id").agg((F.avg(F.when(F.col("best") <= K, F.col("score"))) - F.avg(F.when(F.col("rule") <= K, F.col("score")))).alias("regret"))
    return d.agg(F.round(F.avg("regret"), 6).alias("regret"), F.count("*").alias("n"))


def _written(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The scored pairs and the decisions with their bins, each written once: what follows reads them several times."""
    return cut(scored(spark, sf_dir)), cut(_binned(spark, sf_dir))


def _residuals(s: DataFrame, d: DataFrame) -> DataFrame:
    """Scored pairs with their residual, the distance from the candidate's mean score in development, and their covariate bin."""
    s = s.join(d, "decision_id")
    mean = s.where("split <> 'held_out'").groupBy("candidate").agg(F.round(F.avg("score"), 6).alias("mean"))
    return s.join(mean, "candidate").withColumn("residual", F.round(F.abs(F.col("score") - F.col("mean")), 4))


def _limit(residuals: DataFrame, weights: DataFrame) -> DataFrame:
    """One row (q, n): the residuals' weighted quantile at level (1 - a)(1 + 1 / n), development rows weighted to look like the held-out ones.

    Weights are whole millionths, so that sums are exact; the window runs over distinct residuals, which rounding bounds.
    """
    w = weights.select("bin", F.round(F.col("weight") * 1000000).cast("bigint").alias("w"))
    cal = residuals.where("split <> 'held_out'").join(w, "bin").groupBy("residual").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    total = cal.agg(F.sum("w").alias("total"), F.sum("n").alias("all"))
    c = cal.withColumn("cum", F.sum("w").over(Window.orderBy("residual").rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(total))
    level = F.least(F.lit(1.0), (1 - ALPHA) * (1.0 + 1.0 / F.col("all")))
    return c.agg(F.min(F.when(F.col("cum") / F.col("total") >= level, F.col("residual"))).alias("q"), F.max("all").alias("n"))


def weighted_conformal(spark, sf_dir):
    """The weighted limit of the development decisions, and how many held-out scores lie within it of their prediction."""
    s, d = _written(spark, sf_dir)
    r = _residuals(s, d)
    q = _limit(r, _weights(d))
    return r.where("split = 'held_out'").crossJoin(F.broadcast(q)).agg(F.max("q").alias("q"), F.max("n").alias("calibrated"), F.count("*").alias("n"), F.count_if(F.col("residual") <= F.col("q")).alias("covered"))


def conformal_bounds(spark, sf_dir):
    """Mean lower and upper limit of the held-out decisions' scores by candidate, and the share of them on one side of zero."""
    s, d = _written(spark, sf_dir)
    q = _limit(_residuals(s, d), _weights(d))
    s = s.join(d.where("split = 'held_out'"), "decision_id").crossJoin(F.broadcast(q))
    lower, upper = F.col("score") - F.col("q"), F.col("score") + F.col("q")
    return s.groupBy("candidate").agg(F.round(F.avg(lower) + 1e-9, 5).alias("lower"), F.round(F.avg(upper) + 1e-9, 5).alias("upper"), F.count_if((lower > 0) | (upper < 0)).alias("clear"), F.count("*").alias("n"))


def _gate(spark, sf_dir) -> DataFrame:
    """One row per decision: its ranking of identified, positive, harmless candidates, what harm removed, and whether to act.

    A score's lower limit is the weighted conformal one.
    """
    s, d = _written(spark, sf_dir)
    q = _limit(_residuals(s, d), _weights(d)).select("q")
    c = _counted(spark, sf_dir, s).crossJoin(F.broadcast(q)).withColumn("lower", F.col("score") - F.col("q"))
    ok = F.col("reason").isNull()
    c = c.withColumn("harm", ok & (F.col("lower") < 0)).withColumn("kept", ok & (F.col("lower") >= 0) & (F.col("score") > 0))
    r = c.withColumn("rank", F.when(F.col("kept"), F.row_number().over(Window.partitionBy("decision_id", "kept").orderBy(F.desc("score"), "candidate"))))
    g = r.groupBy("decision_id").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("rank", "candidate")))), lambda x: x["candidate"])).alias("ranking"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("harm"), F.col("candidate"))))).alias("harm"),
        F.max(F.when(F.col("rank") <= K, F.col("lower"))).alias("best"), F.count_if(ok).alias("identified"),
    )
    act = F.coalesce(F.col("best") > MARGIN, F.lit(False))
    reason = F.when(act, F.lit("")).when(F.col("identified") == 0, "no identified candidate").when(F.col("ranking") == "", "no candidate without harm").otherwise("limit within margin")
    return g.select("decision_id", "ranking", "harm", act.alias("act"), reason.alias("reason"))


def gate_decisions(spark, sf_dir):
    return _gate(spark, sf_dir)


def deferral_reasons(spark, sf_dir):
    return _gate(spark, sf_dir).groupBy("act", "reason").agg(F.count("*").alias("n"))


def pathway_readout(spark, sf_dir):
    """Where the agents really started, the order's brands of large quantity, stand in the ranking: exclusive buckets."""
    g = _gate(spark, sf_dir)
    started = scored(spark, sf_dir).where("score > 0.1").groupBy("decision_id").agg(F.collect_set("candidate").alias("agents"))
    list_ = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    j = g.join(started, "decision_id", "left").withColumn("agents", F.coalesce("agents", F.array().cast("array<string>"))).withColumn("r", list_(F.col("ranking"))).withColumn("h", list_(F.col("harm")))
    bucket = (
        F.when(F.array_contains("agents", F.try_element_at("r", F.lit(1))), "top_ranked_started").when(F.arrays_overlap("agents", F.slice("r", 1, K)), "another_top3_started")
        .when(F.arrays_overlap("agents", "r"), "outside_top3_started").when(F.arrays_overlap("agents", "h"), "de_prioritised_coprescribed").when(F.size("agents") > 0, "backbone_only").otherwise("none_started")
    )
    return j.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def softmax(spark, sf_dir):
    """Scores of each decision as shares, shifted by their maximum."""
    w = Window.partitionBy("decision_id")
    s = scored(spark, sf_dir).withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return s.select("decision_id", "candidate", F.round(F.col("e") / F.sum("e").over(w), 6).alias("share"))


def kish_ess(spark, sf_dir):
    """Effective sample size of the inverse-propensity weights per candidate."""
    w = 1.0 / F.greatest("propensity", F.lit(EPSILON))
    return scored(spark, sf_dir).withColumn("w", w).groupBy("candidate").agg(F.round(F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w")), 4).alias("ess"), F.count("*").alias("n"))


def weighted_quantile(spark, sf_dir):
    """The smallest score with at least 90 % of the propensity mass at or below it, per candidate."""
    w = Window.partitionBy("candidate")
    d = scored(spark, sf_dir).groupBy("candidate", "score").agg(F.sum(F.round(F.col("propensity") * 1000000).cast("bigint")).alias("m"))
    c = d.withColumn("cum", F.sum("m").over(w.orderBy("score").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("m").over(w))
    return c.groupBy("candidate").agg(F.min(F.when(F.col("cum") * 10 >= F.col("total") * 9, F.col("score"))).alias("quantile"))


def conformal_limits(spark, sf_dir):
    """Split-conformal: the residual quantile at level (1 - a)(1 + 1/n) of one half of the decisions, and the other half's cover."""
    s = scored(spark, sf_dir).withColumn("residual", F.round(F.abs(F.col("score") - F.col("propensity")), 6)).withColumn("half", F.col("decision_id") % 2)
    cal = s.where("half = 0").groupBy("residual").agg(F.count("*").alias("n"))
    # Windows without a partition run over distinct residuals, which rounding bounds, not over rows.
    w = Window.orderBy("residual").rowsBetween(Window.unboundedPreceding, 0)
    c = cal.withColumn("cum", F.sum("n").over(w))
    total = cal.agg(F.sum("n").alias("total"))
    level = F.least(F.lit(1.0), 0.9 * (1.0 + 1.0 / F.col("total")))
    q = c.crossJoin(total).where(F.col("cum") / F.col("total") >= level).agg(F.min("residual").alias("q"))
    return s.where("half = 1").crossJoin(F.broadcast(q)).agg(F.max("q").alias("q"), F.count("*").alias("n"), F.count_if(F.col("residual") <= F.col("q")).alias("covered"))


def _binned(spark, sf_dir) -> DataFrame:
    """Decisions with their account balance's bin of ten."""
    d = decisions(spark, sf_dir).select("decision_id", "split", F.col("c_acctbal").alias("x"))
    edges = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return d.crossJoin(F.broadcast(edges)).select("decision_id", "split", F.least(F.lit(9), F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 10.0))).cast("int").alias("bin"))


def covariate_weights(spark, sf_dir):
    """Histogram density ratio of held-out over development account balances in ten shared bins, floored and clipped."""
    return _weights(_binned(spark, sf_dir))


def _weights(d: DataFrame) -> DataFrame:
    n = d.groupBy("bin").agg(F.count_if(F.col("split") == "held_out").alias("target"), F.count_if(F.col("split") != "held_out").alias("source"))
    return n.select("bin", "target", "source", F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.1), F.col("target") / F.greatest("source", F.lit(1)))), 6).alias("weight"))


_W = f"WITH {SCORED_CTE}"
_COUNTED = f"{_W}, c AS (SELECT *, {REASON} AS reason FROM scored JOIN counted USING (candidate))"
_RANKED = f"""{_W}, r AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY propensity DESC, candidate) AS rk, GREATEST(score, 0.0) AS gain, CASE WHEN score > 0 THEN 1 ELSE 0 END AS rel FROM scored),
m AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY gain DESC) AS ideal, SUM(rel) OVER (PARTITION BY decision_id ORDER BY rk) AS found FROM r)"""
_TOP = """top AS (SELECT decision_id, list(candidate) FILTER (rs <= 3) AS a, list(candidate) FILTER (rp <= 3) AS b FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY score DESC, candidate) AS rs,
  row_number() OVER (PARTITION BY decision_id ORDER BY propensity DESC, candidate) AS rp FROM scored) GROUP BY decision_id)"""
_BINS = """eb AS (SELECT MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM decision), bd AS (SELECT decision_id, split, CAST(LEAST(9, FLOOR((c_acctbal - lo) / ((hi - lo) / 10.0))) AS INTEGER) AS bin FROM decision, eb),
bw AS (SELECT bin, target, source, ROUND(LEAST(10.0, GREATEST(0.1, CAST(target AS DOUBLE) / GREATEST(source, 1))), 6) AS weight FROM (SELECT bin, COUNT(*) FILTER (split = 'held_out') AS target, COUNT(*) FILTER (split <> 'held_out') AS source FROM bd GROUP BY 1))"""
_LIMIT = f"""{DECISION_CTE}, {SCORED_CTE}, {_BINS}, lm AS (SELECT candidate, ROUND(AVG(score), 6) AS mean FROM scored JOIN bd USING (decision_id) WHERE split <> 'held_out' GROUP BY 1),
lr AS (SELECT split, bin, ROUND(ABS(score - mean), 4) AS residual FROM scored JOIN bd USING (decision_id) JOIN lm USING (candidate)),
lc AS (SELECT residual, SUM(CAST(ROUND(weight * 1000000) AS BIGINT)) AS w, COUNT(*) AS n FROM lr JOIN bw USING (bin) WHERE split <> 'held_out' GROUP BY 1),
lt AS (SELECT residual, CAST(SUM(w) OVER (ORDER BY residual) AS DOUBLE) / SUM(w) OVER () AS share, SUM(n) OVER () AS n FROM lc),
lq AS (SELECT MIN(residual) FILTER (share >= LEAST(1.0, CAST({1 - ALPHA} AS DOUBLE) * (1.0 + CAST(1.0 AS DOUBLE) / n))) AS q, CAST(MAX(n) AS BIGINT) AS n FROM lt)"""
_GATE = f"""WITH {_LIMIT}, c AS (SELECT *, {REASON} AS reason FROM scored JOIN counted USING (candidate)), l AS (SELECT c.*, score - q AS lower, reason IS NULL AS ok FROM c, lq),
k AS (SELECT *, ok AND lower < 0 AS is_harm, ok AND lower >= 0 AND score > 0 AS kept FROM l),
r AS (SELECT *, CASE WHEN kept THEN row_number() OVER (PARTITION BY decision_id, kept ORDER BY score DESC, candidate) END AS rk FROM k),
g AS (SELECT decision_id, COALESCE(string_agg(candidate, ',' ORDER BY rk) FILTER (kept), '') AS ranking, COALESCE(string_agg(candidate, ',' ORDER BY candidate) FILTER (is_harm), '') AS harm,
  MAX(CASE WHEN rk <= {K} THEN lower END) AS best, COUNT(*) FILTER (ok) AS identified FROM r GROUP BY decision_id),
gate AS (SELECT decision_id, ranking, harm, COALESCE(best > {MARGIN}, FALSE) AS act, CASE WHEN COALESCE(best > {MARGIN}, FALSE) THEN '' WHEN identified = 0 THEN 'no identified candidate' WHEN ranking = '' THEN 'no candidate without harm' ELSE 'limit within margin' END AS reason FROM g)"""
QUERIES = {f.__name__: f for f in (eligibility_partition, eligible_sizes, trimming_sweep, propensity_margins, hits_at_k, ndcg_at_k, recall_at_k, average_precision, top_k_jaccard, mean_pairwise_jaccard, policy_value_k, selection_regret, gate_decisions, deferral_reasons, pathway_readout, softmax, kish_ess, weighted_quantile, conformal_limits, covariate_weights, weighted_conformal, conformal_bounds)}
SQL = {
    "eligibility_partition": f"{_COUNTED} SELECT COALESCE(reason, 'eligible') AS status, COUNT(*) AS n, COUNT(DISTINCT candidate) AS candidates FROM c GROUP BY 1",
    "eligible_sizes": f"{_COUNTED} SELECT decision_id, COUNT(*) FILTER (reason IS NULL) AS eligible, COUNT(*) AS scored FROM c GROUP BY 1",
    "trimming_sweep": f"{_W} SELECT epsilon, ROUND(AVG(CASE WHEN propensity < epsilon OR propensity > 1 - epsilon THEN 1.0 ELSE 0.0 END), 6) AS rate FROM scored, (SELECT CAST(unnest([0.01, 0.02, 0.05, 0.1, 0.2]) AS DOUBLE) AS epsilon) GROUP BY epsilon",
    "propensity_margins": f"{_W} SELECT candidate, ROUND(MIN(LEAST(propensity - {EPSILON}, {1 - EPSILON} - propensity)), 6) AS least_margin, ROUND(MIN(propensity), 6) AS low, ROUND(MAX(propensity), 6) AS high FROM scored GROUP BY 1",
    "hits_at_k": f"{_RANKED} SELECT decision_id, ROUND(CAST(SUM(CASE WHEN rk <= {K} THEN rel END) AS DOUBLE) / LEAST({K}, COUNT(*)), 6) AS hits FROM m GROUP BY 1",
    "ndcg_at_k": f"{_RANKED} SELECT decision_id, ROUND(COALESCE(SUM(CASE WHEN rk <= {K} THEN gain / log2(rk + 1.0) END) / NULLIF(SUM(CASE WHEN ideal <= {K} THEN gain / log2(ideal + 1.0) END), 0), 0.0), 6) AS ndcg FROM m GROUP BY 1",
    "recall_at_k": f"{_RANKED} SELECT decision_id, ROUND(COALESCE(CAST(SUM(CASE WHEN rk <= {K} THEN rel END) AS DOUBLE) / NULLIF(SUM(rel), 0), 0.0), 6) AS recall FROM m GROUP BY 1",
    "average_precision": f"{_RANKED} SELECT decision_id, ROUND(COALESCE(SUM(CASE WHEN rel = 1 THEN CAST(found AS DOUBLE) / rk END) / NULLIF(SUM(rel), 0), 0.0) + 1e-9, 6) AS average_precision FROM m GROUP BY 1",
    "top_k_jaccard": f"{_W}, {_TOP} SELECT decision_id, ROUND(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM top",
    "mean_pairwise_jaccard": f"""WITH {DECISION_CTE}, {SCORED_CTE}, p AS (SELECT DISTINCT candidate, patient_id FROM scored JOIN decision USING (decision_id)), n AS (SELECT candidate, COUNT(*) AS n FROM p GROUP BY 1),
j AS (SELECT a.candidate AS a, b.candidate AS b, COUNT(*) AS n_both FROM p a JOIN p b USING (patient_id) WHERE a.candidate < b.candidate GROUP BY 1, 2)
SELECT ROUND(SUM(CAST(n_both AS DOUBLE) / (x.n + y.n - n_both)) / (SELECT COUNT(*) * (COUNT(*) - 1) / 2.0 FROM n), 6) AS mean_jaccard FROM j JOIN n x ON x.candidate = j.a JOIN n y ON y.candidate = j.b""",
    "policy_value_k": f"""WITH {DECISION_CTE}, {SCORED_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY score DESC, candidate) AS rk FROM scored WHERE score > 0),
v AS (SELECT decision_id, AVG(score) AS v FROM r WHERE rk <= {K} GROUP BY 1), w AS (SELECT COALESCE(v, 0.0) AS v FROM decision LEFT JOIN v USING (decision_id))
SELECT ROUND(AVG(v), 6) AS value, ROUND(STDDEV_SAMP(v) / SQRT(COUNT(*)), 6) AS se, COUNT(*) AS n FROM w""",
    "selection_regret": f"""{_W}, r AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY score DESC, candidate) AS best, row_number() OVER (PARTITION BY decision_id ORDER BY candidate) AS rule FROM scored),
d AS (SELECT decision_id, AVG(CASE WHEN best <= {K} THEN score END) - AVG(CASE WHEN rule <= {K} THEN score END) AS regret FROM r GROUP BY 1) SELECT ROUND(AVG(regret), 6) AS regret, COUNT(*) AS n FROM d""",
    "gate_decisions": f"{_GATE} SELECT * FROM gate",
    "deferral_reasons": f"{_GATE} SELECT act, reason, COUNT(*) AS n FROM gate GROUP BY ALL",
    "pathway_readout": f"""{_GATE}, st AS (SELECT decision_id, list(DISTINCT candidate) AS agents FROM scored WHERE score > 0.1 GROUP BY 1),
j AS (SELECT COALESCE(agents, []) AS agents, list_filter(string_split(ranking, ','), lambda x: x <> '') AS r, list_filter(string_split(harm, ','), lambda x: x <> '') AS h FROM gate LEFT JOIN st USING (decision_id))
SELECT CASE WHEN list_contains(agents, r[1]) THEN 'top_ranked_started' WHEN list_has_any(agents, r[1:{K}]) THEN 'another_top3_started' WHEN list_has_any(agents, r) THEN 'outside_top3_started'
  WHEN list_has_any(agents, h) THEN 'de_prioritised_coprescribed' WHEN len(agents) > 0 THEN 'backbone_only' ELSE 'none_started' END AS bucket, COUNT(*) AS n FROM j GROUP BY 1""",
    "softmax": f"{_W}, e AS (SELECT *, EXP(score - MAX(score) OVER (PARTITION BY decision_id)) AS e FROM scored) SELECT decision_id, candidate, ROUND(e / SUM(e) OVER (PARTITION BY decision_id), 6) AS share FROM e",
    "kish_ess": f"{_W}, w AS (SELECT candidate, 1.0 / GREATEST(propensity, {EPSILON}) AS w FROM scored) SELECT candidate, ROUND(SUM(w) * SUM(w) / SUM(w * w), 4) AS ess, COUNT(*) AS n FROM w GROUP BY 1",
    "weighted_quantile": f"""{_W}, d AS (SELECT candidate, score, SUM(CAST(ROUND(propensity * 1000000) AS BIGINT)) AS m FROM scored GROUP BY 1, 2),
c AS (SELECT *, SUM(m) OVER (PARTITION BY candidate ORDER BY score) AS cum, SUM(m) OVER (PARTITION BY candidate) AS total FROM d) SELECT candidate, MIN(score) FILTER (cum * 10 >= total * 9) AS quantile FROM c GROUP BY 1""",
    "conformal_limits": f"""{_W}, s AS (SELECT *, ROUND(ABS(score - propensity), 6) AS residual FROM scored), c AS (SELECT residual, CAST(SUM(COUNT(*)) OVER (ORDER BY residual) AS DOUBLE) / SUM(COUNT(*)) OVER () AS share, SUM(COUNT(*)) OVER () AS total FROM s WHERE decision_id % 2 = 0 GROUP BY residual),
q AS (SELECT MIN(residual) AS q FROM c WHERE share >= LEAST(1.0, CAST(0.9 AS DOUBLE) * (1.0 + CAST(1.0 AS DOUBLE) / total))) SELECT MAX(q) AS q, COUNT(*) AS n, COUNT(*) FILTER (residual <= q) AS covered FROM s, q WHERE decision_id % 2 = 1""",
    "weighted_conformal": f"WITH {_LIMIT} SELECT MAX(q) AS q, MAX(lq.n) AS calibrated, COUNT(*) AS n, COUNT(*) FILTER (residual <= q) AS covered FROM lr, lq WHERE split = 'held_out'",
    "conformal_bounds": f"WITH {_LIMIT} SELECT candidate, ROUND(AVG(score - q) + 1e-9, 5) AS lower, ROUND(AVG(score + q) + 1e-9, 5) AS upper, COUNT(*) FILTER (score - q > 0 OR score + q < 0) AS clear, COUNT(*) AS n FROM scored JOIN bd USING (decision_id), lq WHERE split = 'held_out' GROUP BY 1",
    "covariate_weights": f"""WITH {DECISION_CTE}, e AS (SELECT MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM decision), b AS (SELECT split, CAST(LEAST(9, FLOOR((c_acctbal - lo) / ((hi - lo) / 10.0))) AS INTEGER) AS bin FROM decision, e),
n AS (SELECT bin, COUNT(*) FILTER (split = 'held_out') AS target, COUNT(*) FILTER (split <> 'held_out') AS source FROM b GROUP BY 1) SELECT bin, target, source, ROUND(LEAST(10.0, GREATEST(0.1, CAST(target AS DOUBLE) / GREATEST(source, 1))), 6) AS weight FROM n""",
}
