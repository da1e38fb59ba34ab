"""The catalogue, patients' anchors in the graph, and summaries of weights, residuals, horizons and effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.cohort import SQL as COHORT
from tessera.plans.cohort import TARGET, feature, scaled_marginals
from tessera.plans.discrimination import concordance
from tessera.plans.estimation import SQL as ESTIMATION
from tessera.plans.estimation import saturated_effects, tercile_summary
from tessera.plans.graph import STRIDE
from tessera.plans.ranking import _BINS, covariate_weights
from tessera.sources.model import DECISION_CTE, HORIZONS, SCORED_CTE, decisions, scored, table

#: Indication labels that hold one of these terms don't admit a candidate by themselves.
TERMS = ("PROMO", "ECONOMY")
GAIN, PRIORITY_FLOOR = 10.0, 150.0


def catalogue_admission(spark, sf_dir):
    """Candidates with their indications, how many are of the excluded kind, whether another admits them, and their priority."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("candidate"), F.col("p_type").alias("indication"), (F.col("p_size") % 10).alias("target")).distinct()
    excluded = F.upper("indication").rlike("|".join(TERMS))
    c = p.groupBy("candidate").agg(F.count_distinct("indication").alias("indications"), F.count_distinct(F.when(excluded, F.col("indication"))).alias("excluded"), F.count_distinct("target").alias("targets"))
    degree = F.col("indications") + F.col("targets")
    return c.select("candidate", "indications", "excluded", (F.col("excluded") < F.col("indications")).alias("admitted"), degree.alias("degree"), (degree * GAIN - PRIORITY_FLOOR).alias("priority"))


def degree_histogram(spark, sf_dir):
    return catalogue_admission(spark, sf_dir).groupBy("degree").agg(F.count("*").alias("candidates"))


def _anchors(spark, sf_dir) -> DataFrame:
    """(patient_id, kind, anchor): the pathways of what a patient was exposed to, its nation, and its segment."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("patient_id"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("patient_id"), "n_name", "c_mktsegment")
    path = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("patient_id", F.lit("pathway").alias("kind"), F.col("p_type").alias("anchor")).distinct()
    rest = c.select("patient_id", F.explode(F.array(F.struct(F.lit("disease").alias("kind"), F.col("n_name").alias("anchor")), F.struct(F.lit("record").alias("kind"), F.col("c_mktsegment").alias("anchor")))).alias("a")).select("patient_id", "a.*")
    return path.union(rest)


def patient_anchors(spark, sf_dir):
    """How many patients each node anchors, by kind, and how many anchors of the kind such a patient has on average."""
    a = _anchors(spark, sf_dir)
    own = a.groupBy("patient_id", "kind").agg(F.count("*").alias("own"))
    return a.join(own, ["patient_id", "kind"]).groupBy("kind", "anchor").agg(F.count("*").alias("patients"), F.round(F.avg("own") + 1e-9, 5).alias("mean_own"))


CORRUPTIONS = 2


def _stride(m):
    """A stride that shares no factor with m, so that it meets all of m places: a prime that isn't one, or else a single step."""
    return F.when(m % STRIDE != 0, STRIDE).otherwise(1)


def anchor_corruptions(spark, sf_dir):
    """For each patient and kind of anchor, CORRUPTIONS nodes of the kind that aren't its anchors, drawn by a stride without replacement.

    Kinds with too few nodes besides a patient's own give it none.
    """
    a = _anchors(spark, sf_dir)
    pool = a.select("kind", "anchor").distinct()
    w = Window.partitionBy("kind")
    pool = pool.select("kind", "anchor", (F.row_number().over(w.orderBy("anchor")) - 1).alias("number"), F.count("*").over(w).alias("m"))
    own = a.groupBy("patient_id", "kind").agg(F.count("*").alias("own")).join(pool.select("kind", "m").distinct(), "kind").where(F.col("own") + CORRUPTIONS <= F.col("m"))
    steps = own.select("patient_id", "kind", "m", F.explode(F.sequence(F.lit(0), (F.col("own") + CORRUPTIONS - 1).cast("int"))).alias("step"))
    drawn = steps.withColumn("number", ((F.col("patient_id") * 31 + F.col("step") * _stride(F.col("m"))) % F.col("m")).cast("int")).join(pool.select("kind", "number", "anchor"), ["kind", "number"])
    free = drawn.join(a, ["patient_id", "kind", "anchor"], "left_anti")
    place = F.row_number().over(Window.partitionBy("patient_id", "kind").orderBy("step"))
    return free.withColumn("place", place).where(F.col("place") <= CORRUPTIONS).select("patient_id", "kind", F.col("anchor").alias("negative"), "place")


def reference_concordance(spark, sf_dir):
    """Harrell's C, in development and held out, of a reference score: less the mean restricted time of the covariate cell in development."""
    cell = ["ecog", "line", "c_mktsegment"]
    d = decisions(spark, sf_dir).withColumn("y", F.round(F.least("follow_up_months", "horizon_months") * 100).cast("bigint"))
    score = d.where("split = 'development'").groupBy(*cell).agg(F.round(-F.sum("y") / F.count("*") / 100.0 + 1e-9, 5).alias("s"))
    return concordance(d.join(score, cell).select("split", F.col("follow_up_months").alias("t"), "s", "event"), ["split"])


def horizon_table(spark, sf_dir):
    """Each line's horizon, its share of the first line's, and the number of distinct restricted times."""
    d = decisions(spark, sf_dir)
    return d.groupBy("line", "horizon_months").agg(F.count_distinct(F.least("follow_up_months", "horizon_months")).alias("steps")).select("line", "horizon_months", F.round(F.col("horizon_months") / HORIZONS["first"], 6).alias("ratio"), "steps")


def weight_diagnostics(spark, sf_dir):
    """The covariate weights as shares of their sum over the development decisions, with the sum and the effective size."""
    w = covariate_weights(spark, sf_dir)
    total = w.agg(F.sum(F.col("weight") * F.col("source")).alias("total"), F.sum(F.col("weight") * F.col("weight") * F.col("source")).alias("squares"))
    return w.crossJoin(F.broadcast(total)).select("bin", F.round(F.col("weight") / F.col("total"), 9).alias("share"), F.round("total", 4).alias("total"), F.round(F.col("total") * F.col("total") / F.col("squares"), 4).alias("effective"))


def residual_summary(spark, sf_dir):
    """Residuals of the scores from their candidate's mean: mean, root mean square, and that weighted by propensity; the weights' effective mass."""
    s = scored(spark, sf_dir)
    r = s.join(s.groupBy("candidate").agg(F.avg("score").alias("m")), "candidate").select((F.col("score") - F.col("m")).alias("r"), F.col("propensity").alias("w"))
    square, w = F.col("r") * F.col("r"), F.col("w")
    return r.agg(F.round(F.avg("r") + 1e-9, 6).alias("mean"), F.round(F.sqrt(F.avg(square)), 6).alias("rmse"), F.round(F.sqrt(F.sum(w * square) / F.greatest(F.sum(w), F.lit(1.0))), 6).alias("weighted_rmse"), F.round(F.sum(w) * F.sum(w) / F.sum(w * w), 2).alias("effective"))


#: What the graph is expected to add in each tercile of exposure: fixed values.
EXPECTATIONS = {"lowest": "largest KG gain", "middle": "intermediate", "highest": "about zero KG gain"}


def tercile_gain(spark, sf_dir):
    """Gain of each exposure tercile, what is expected of it, and the gain as a share of that of the highest."""
    t = tercile_summary(spark, sf_dir)
    top = t.agg(F.max(F.when(F.col("tercile") == "highest", F.col("gain"))).alias("top"))
    expected = F.create_map(*[F.lit(x) for kv in EXPECTATIONS.items() for x in kv])[F.col("tercile")]
    return t.crossJoin(F.broadcast(top)).select("tercile", "gain", expected.alias("expectation"), F.round(F.when(F.abs("top") >= 1e-12, F.col("gain") / F.col("top")), 6).alias("normalised"))


def mean_effect_ratio(spark, sf_dir):
    """Mean over the candidates of the exponential of their effect, and its extremes."""
    e = saturated_effects(spark, sf_dir)
    return e.agg(F.round(F.avg(F.exp("tau")) + 1e-9, 5).alias("mean_ratio"), F.min("tau").alias("least"), F.max("tau").alias("most"), F.count("tau").alias("candidates"))


def marginal_matches(spark, sf_dir):
    """Whether each variable's apportioned counts add up to the target."""
    return scaled_marginals(spark, sf_dir).groupBy("variable").agg(F.sum("n").alias("n"), (F.sum("n") == TARGET).alias("matches"))


LEXICON = (0.9, 0.4, 0.3, 0.5)


def slide_profile(spark, sf_dir):
    """Per vector: the lexicon read-out of its first coordinates, and its source as a pair of indicators."""
    e = table(spark, sf_dir, "embeddings")
    first = F.col("label") % 2 == 0
    return e.select("vec_id", F.round(feature(F.col("embedding"), LEXICON), 4).alias("lexicon"), first.cast("int").alias("primary_source"), (~first).cast("int").alias("metastasis_source"))


_PART = f"""p AS (SELECT DISTINCT p_brand AS candidate, p_type AS indication, p_size % 10 AS target FROM part),
c AS (SELECT candidate, COUNT(DISTINCT indication) AS indications, COUNT(DISTINCT indication) FILTER (regexp_matches(upper(indication), '{"|".join(TERMS)}')) AS excluded, COUNT(DISTINCT target) AS targets FROM p GROUP BY 1),
a AS (SELECT candidate, indications, excluded, excluded < indications AS admitted, indications + targets AS degree, (indications + targets) * CAST({GAIN} AS DOUBLE) - {PRIORITY_FLOOR} AS priority FROM c)"""
_ANCHORS = """an AS (SELECT DISTINCT o_custkey AS patient_id, 'pathway' AS kind, p_type AS anchor FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
UNION ALL SELECT c_custkey, 'disease', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, 'record', c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
own AS (SELECT patient_id, kind, COUNT(*) AS own FROM an GROUP BY 1, 2)"""
QUERIES = {f.__name__: f for f in (catalogue_admission, degree_histogram, patient_anchors, anchor_corruptions, reference_concordance, horizon_table, weight_diagnostics, residual_summary, tercile_gain, mean_effect_ratio, marginal_matches, slide_profile)}
SQL = {
    "catalogue_admission": f"WITH {_PART} SELECT * FROM a",
    "degree_histogram": f"WITH {_PART} SELECT degree, COUNT(*) AS candidates FROM a GROUP BY 1",
    "patient_anchors": f"WITH {_ANCHORS} SELECT kind, anchor, COUNT(*) AS patients, ROUND(AVG(own) + 1e-9, 5) AS mean_own FROM an JOIN own USING (patient_id, kind) GROUP BY 1, 2",
    "anchor_corruptions": f"""WITH {_ANCHORS}, pool AS (SELECT kind, anchor, row_number() OVER (PARTITION BY kind ORDER BY anchor) - 1 AS number, COUNT(*) OVER (PARTITION BY kind) AS m FROM (SELECT DISTINCT kind, anchor FROM an)),
s AS (SELECT o.patient_id, o.kind, m, step FROM own o JOIN (SELECT DISTINCT kind, m FROM pool) USING (kind), unnest(range(own + {CORRUPTIONS})) AS u(step) WHERE own + {CORRUPTIONS} <= m),
d AS (SELECT s.patient_id, s.kind, pool.anchor, step FROM s JOIN pool ON pool.kind = s.kind AND pool.number = (s.patient_id * 31 + step * {STRIDE}) % s.m WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.patient_id = s.patient_id AND an.kind = s.kind AND an.anchor = pool.anchor))
SELECT * FROM (SELECT patient_id, kind, anchor AS negative, row_number() OVER (PARTITION BY patient_id, kind ORDER BY step) AS place FROM d) WHERE place <= {CORRUPTIONS}""",
    "reference_concordance": f"""WITH {DECISION_CTE}, d AS (SELECT *, CAST(ROUND(LEAST(follow_up_months, horizon_months) * 100) AS BIGINT) AS y FROM decision), s AS (SELECT ecog, line, c_mktsegment, ROUND(-CAST(SUM(y) AS DOUBLE) / COUNT(*) / 100.0 + 1e-9, 5) AS s FROM d WHERE split = 'development' GROUP BY ALL),
n AS (SELECT split, follow_up_months AS t, s, COUNT(*) AS n, COUNT(*) FILTER (event) AS e FROM d JOIN s USING (ecog, line, c_mktsegment) GROUP BY ALL)
SELECT a.split, CAST(SUM(a.e * b.n) AS BIGINT) AS pairs, ROUND(SUM(a.e * b.n * CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) / SUM(a.e * b.n), 6) AS c_index FROM n a JOIN n b ON a.split = b.split AND b.t > a.t WHERE a.e > 0 GROUP BY 1""",
    "horizon_table": f"WITH {DECISION_CTE} SELECT line, horizon_months, ROUND(horizon_months / {HORIZONS['first']}, 6) AS ratio, COUNT(DISTINCT LEAST(follow_up_months, horizon_months)) AS steps FROM decision GROUP BY 1, 2",
    "weight_diagnostics": f"""WITH {DECISION_CTE}, {_BINS}, t AS (SELECT SUM(weight * source) AS total, SUM(weight * weight * source) AS squares FROM bw) SELECT bin, ROUND(weight / total, 9) AS share, ROUND(total, 4) AS total, ROUND(total * total / squares, 4) AS effective FROM bw, t""",
    "residual_summary": f"""WITH {SCORED_CTE}, r AS (SELECT score - AVG(score) OVER (PARTITION BY candidate) AS r, propensity AS w FROM scored)
SELECT ROUND(AVG(r) + 1e-9, 6) AS mean, ROUND(SQRT(AVG(r * r)), 6) AS rmse, ROUND(SQRT(SUM(w * r * r) / GREATEST(SUM(w), 1.0)), 6) AS weighted_rmse, ROUND(SUM(w) * SUM(w) / SUM(w * w), 2) AS effective FROM r""",
    "tercile_gain": f"""WITH t AS ({ESTIMATION['tercile_summary']}), h AS (SELECT MAX(gain) FILTER (tercile = 'highest') AS top FROM t)
SELECT tercile, gain, CASE tercile {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EXPECTATIONS.items())} END AS expectation, ROUND(CASE WHEN ABS(top) >= 1e-12 THEN gain / top END, 6) AS normalised FROM t, h""",
    "mean_effect_ratio": f"WITH e AS ({ESTIMATION['saturated_effects']}) SELECT ROUND(AVG(EXP(tau)) + 1e-9, 5) AS mean_ratio, MIN(tau) AS least, MAX(tau) AS most, COUNT(tau) AS candidates FROM e",
    "marginal_matches": f"WITH m AS ({COHORT['scaled_marginals']}) SELECT variable, CAST(SUM(n) AS BIGINT) AS n, SUM(n) = {TARGET} AS matches FROM m GROUP BY 1",
    "slide_profile": f"SELECT vec_id, ROUND(list_sum(list_transform(list_zip(embedding[1:4], {list(LEXICON)}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 4) AS lexicon, CAST(label % 2 = 0 AS INTEGER) AS primary_source, CAST(label % 2 <> 0 AS INTEGER) AS metastasis_source FROM embeddings",
}
