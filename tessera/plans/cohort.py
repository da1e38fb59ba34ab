"""Cohort construction, splits, counts and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order import rank_within
from tessera.sources.contract import Contract
from tessera.sources.model import DECISION_CTE, EXPOSURE_CTE, HORIZONS, decisions, exposures, table

FOLDS, TARGET = 5, 1000
#: Of the first coordinates in a slide's signature.
WEIGHTS = (-0.9, 0.2, 0.6, 0.2)
VARIABLES = ("site", "split", "line", "c_mktsegment")


def _long(spark, sf_dir) -> DataFrame:
    d = decisions(spark, sf_dir).select(*VARIABLES, F.when(F.col("ecog") == 1, "impaired").otherwise("active").alias("status"))
    return d.unpivot([], [*VARIABLES, "status"], "variable", "label")


def marginal_counts(spark, sf_dir):
    """Counts of every label of every variable, with each variable's total: one expansion, one grouped sum."""
    n = _long(spark, sf_dir).groupBy("variable", "label").agg(F.count("*").alias("n"))
    return n.union(n.groupBy("variable").agg(F.lit("_total").alias("label"), F.sum("n").alias("n")))


def scaled_marginals(spark, sf_dir):
    """Largest-remainder apportionment of each variable's counts to a target total; ties go by label."""
    n = _long(spark, sf_dir).groupBy("variable", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("variable")
    whole = F.floor(F.col("n") * TARGET / F.col("total")).cast("bigint")
    s = n.withColumn("total", F.sum("n").over(w)).withColumn("whole", whole).withColumn("rest", (F.col("n") * TARGET) % F.col("total"))
    s = s.withColumn("left", TARGET - F.sum("whole").over(w)).withColumn("rk", F.row_number().over(w.orderBy(F.desc("rest"), "label")))
    return s.select("variable", "label", (F.col("whole") + F.when(F.col("rk") <= F.col("left"), 1).otherwise(0)).alias("n"))


#: Slots are made so many at a time.
CHUNK = 10_000


def interleave(spark, sf_dir):
    """Labels of a variable spread evenly over the slots: the i-th of n is due at (i + 1/2) N / n.

    An item's slot is its own number and, for each other label, the count of that label's items that are due before it, which
    is arithmetic on the two labels' sizes. So slots need no sort, only the label counts, of which there are few.
    """
    n = decisions(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n"))
    sizes = n.agg(F.collect_list(F.struct("site", "n")).alias("sizes"))
    chunks = n.crossJoin(F.broadcast(sizes)).select("site", "n", "sizes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(CHUNK).cast("bigint"))).alias("first"))
    items = chunks.select("site", "n", "sizes", F.explode(F.sequence("first", F.least(F.col("first") + CHUNK - 1, F.col("n") - 1))).alias("i"))
    # Item j of a label of m is due before item i of one of n if (2 j + 1) n < (2 i + 1) m, or if the two are equal and its name comes first.
    due = lambda x: (2 * F.col("i") + 1) * x["n"] - F.col("n")
    strictly = lambda x: F.when(due(x) > 0, F.floor((due(x) + 2 * F.col("n") - 1) / (2 * F.col("n")))).otherwise(0)
    or_equal = lambda x: F.when(due(x) >= 0, F.floor(due(x) / (2 * F.col("n"))) + 1).otherwise(0)
    before = F.transform(F.filter("sizes", lambda x: x["site"] != F.col("site")), lambda x: F.least(x["n"], F.when(x["site"] < F.col("site"), or_equal(x)).otherwise(strictly(x)).cast("bigint")))
    return items.select((F.col("i") + 1 + F.aggregate(before, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("slot"), "site", "i")


def fold_assignment(spark, sf_dir):
    """Patients of each site dealt to folds in the order of a hash that any engine can repeat."""
    p = decisions(spark, sf_dir).select("patient_id", "site").distinct().withColumn("h", (F.col("patient_id") * 7919 + 104729) % 1000003)
    return rank_within(p, ["site"], "h", "patient_id").select("patient_id", "site", ((F.col("rank") - 1) % FOLDS).cast("int").alias("fold"))


def fold_sizes(spark, sf_dir):
    f = fold_assignment(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"))
    return f.withColumn("spread", F.max("n").over(Window.partitionBy()) - F.min("n").over(Window.partitionBy()))


def cross_fitted_folds(spark, sf_dir):
    """Training and test decisions of every fold: one grouped count, each fold's complement by subtraction."""
    d = decisions(spark, sf_dir).join(fold_assignment(spark, sf_dir).select("patient_id", "fold"), "patient_id")
    n = d.groupBy("fold").agg(F.count("*").alias("test"), F.count_if("event").alias("test_events"))
    return n.select("fold", "test", (F.sum("test").over(Window.partitionBy()) - F.col("test")).alias("train"), "test_events")


def first_decision(spark, sf_dir):
    return decisions(spark, sf_dir).where("line = 'first'").select("patient_id", "decision_id", "site")


def outer_site_split(spark, sf_dir):
    return decisions(spark, sf_dir).groupBy("split", "site").agg(F.count("*").alias("decisions"), F.count_distinct("patient_id").alias("patients"))


def partition_closes(spark, sf_dir):
    """Whether strata, each decision in one, add up: rows, distinct ids and their sum over strata."""
    d = decisions(spark, sf_dir)
    strata = d.groupBy("line", "ecog").agg(F.count("*").alias("n"))
    return d.agg(F.count("*").alias("rows"), F.count_distinct("decision_id").alias("ids")).crossJoin(strata.agg(F.sum("n").alias("over_strata"), F.count("*").alias("strata")))


def exposure_prevalence(spark, sf_dir):
    x = exposures(spark, sf_dir).groupBy("candidate").agg(F.count("*").alias("exposed"))
    n = decisions(spark, sf_dir).agg(F.count("*").alias("n"))
    return x.crossJoin(F.broadcast(n)).select("candidate", "exposed", F.round(F.col("exposed") / F.col("n"), 6).alias("prevalence"))


def modality_census(spark, sf_dir):
    """Decisions with and without any exposure row: a left join on the key, counted."""
    x = exposures(spark, sf_dir).select("decision_id").distinct().withColumn("has", F.lit(True))
    return decisions(spark, sf_dir).join(x, "decision_id", "left").groupBy(F.coalesce("has", F.lit(False)).alias("has_lines")).agg(F.count("*").alias("n"))


def patient_counts(spark, sf_dir):
    return decisions(spark, sf_dir).groupBy("patient_id").agg(F.count("*").alias("n"))


#: Contract checks in order: the first that fails names the reason.
CHECKS = (("follow_up", "follow_up_months <= 0 OR follow_up_months > 9.9"), ("balance", "c_acctbal < -900 OR c_acctbal > 9900"), ("segment", "c_mktsegment IN ('MACHINERY')"))


def validation_rejects(spark, sf_dir):
    """Rows that break the record contract, each with the first reason, beside the number that pass."""
    reason = F.expr("CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in CHECKS) + " ELSE 'valid' END")
    return decisions(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


#: What decisions must hold; the bounds are tighter than the data, so that there is something to reject.
DECISIONS = Contract(
    keys=("decision_id", "patient_id"), domains={"site": ("AFRICA", "AMERICA", "ASIA", "EUROPE"), "line": tuple(HORIZONS), "c_mktsegment": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")},
    bounds={"follow_up_months": (0, 9.5), "c_acctbal": (-900, 9900), "ecog": (0, 1)}, flags=("event",), positive=("follow_up_months",),
)


def contract_rejects(spark, sf_dir):
    """Decisions by every reason for which the contract rejects them, one with several reasons counted for each, and those without."""
    return DECISIONS.rejects(decisions(spark, sf_dir))


def embedding_norm(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("vec_id", "label", F.round(norm, 4).alias("norm"))


def slide_signature(spark, sf_dir):
    """Per label, the mean of each of an embedding's first eight coordinates; ``slide_feature`` is the survey's dot product.

    Exploded with positions and summed map-side.
    """
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 8)).alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 4).alias("mean"))


def feature(embedding, weights: tuple[float, ...] = WEIGHTS):
    """The dot product of an embedding's first coordinates with the weights, of as many as it has; 0 for none."""
    n = len(weights)
    pairs = F.zip_with(F.slice(embedding, 1, n), F.slice(F.array(*map(F.lit, weights)), F.lit(1), F.least(F.size(embedding), F.lit(n))), lambda x, w: x.cast("double") * w)
    return F.when(F.size(embedding) > 0, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def slide_feature(spark, sf_dir):
    """The survey's slide signature of each vector."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(feature(F.col("embedding")), 4).alias("signature"))


def centred_modifier(spark, sf_dir):
    """A modifier centred on the eligible rows of its site: others keep zero."""
    d = decisions(spark, sf_dir).select("decision_id", "site", "c_acctbal", (F.col("ecog") == 0).alias("eligible"))
    mean = d.groupBy("site").agg(F.avg(F.when(F.col("eligible"), F.col("c_acctbal"))).alias("mean"))
    return d.join(mean, "site").select("decision_id", F.round(F.when(F.col("eligible"), F.col("c_acctbal") - F.col("mean")).otherwise(0.0), 4).alias("centred"))


_W = f"WITH {DECISION_CTE}"
_LONG = f"""{_W}, l AS (SELECT 'site' AS variable, site AS label FROM decision UNION ALL SELECT 'split', split FROM decision UNION ALL SELECT 'line', line FROM decision
UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM decision UNION ALL SELECT 'status', CASE WHEN ecog = 1 THEN 'impaired' ELSE 'active' END FROM decision),
n AS (SELECT variable, label, COUNT(*) AS n FROM l GROUP BY 1, 2)"""
_FOLD = f"{_W}, fold AS (SELECT patient_id, site, CAST((row_number() OVER (PARTITION BY site ORDER BY (patient_id * 7919 + 104729) % 1000003, patient_id) - 1) % {FOLDS} AS INTEGER) AS fold FROM (SELECT DISTINCT patient_id, site FROM decision))"
QUERIES = {f.__name__: f for f in (marginal_counts, scaled_marginals, interleave, fold_assignment, fold_sizes, cross_fitted_folds, first_decision, outer_site_split, partition_closes, exposure_prevalence, modality_census, patient_counts, contract_rejects, validation_rejects, embedding_norm, slide_signature, slide_feature, centred_modifier)}
SQL = {
    "marginal_counts": f"{_LONG} SELECT * FROM n UNION ALL SELECT variable, '_total', CAST(SUM(n) AS BIGINT) FROM n GROUP BY 1",
    "scaled_marginals": f"""{_LONG}, s AS (SELECT *, CAST(SUM(n) OVER (PARTITION BY variable) AS BIGINT) AS total FROM n), f AS (SELECT *, n * {TARGET} // total AS whole, (n * {TARGET}) % total AS rest FROM s),
r AS (SELECT *, {TARGET} - SUM(whole) OVER (PARTITION BY variable) AS remaining, row_number() OVER (PARTITION BY variable ORDER BY rest DESC, label) AS rk FROM f) SELECT variable, label, CAST(whole + CASE WHEN rk <= remaining THEN 1 ELSE 0 END AS BIGINT) AS n FROM r""",
    "interleave": f"""{_W}, n AS (SELECT site, COUNT(*) AS n FROM decision GROUP BY 1), t AS (SELECT SUM(n) AS total FROM n), s AS (SELECT site, CAST(i AS BIGINT) AS i, (2 * i + 1) * CAST(total AS DOUBLE) / (2.0 * n) AS k FROM n, t, unnest(range(n)) AS u(i))
SELECT row_number() OVER (ORDER BY k, site) AS slot, site, i FROM s""",
    "fold_assignment": f"{_FOLD} SELECT * FROM fold",
    "fold_sizes": f"{_FOLD}, c AS (SELECT fold, COUNT(*) AS n FROM fold GROUP BY 1) SELECT fold, n, MAX(n) OVER () - MIN(n) OVER () AS spread FROM c",
    "cross_fitted_folds": f"{_FOLD}, c AS (SELECT fold, COUNT(*) AS test, COUNT(*) FILTER (event) AS test_events FROM decision JOIN fold USING (patient_id) GROUP BY 1) SELECT fold, test, CAST(SUM(test) OVER () - test AS BIGINT) AS train, test_events FROM c",
    "first_decision": f"{_W} SELECT patient_id, decision_id, site FROM decision WHERE line = 'first'",
    "outer_site_split": f"{_W} SELECT split, site, COUNT(*) AS decisions, COUNT(DISTINCT patient_id) AS patients FROM decision GROUP BY 1, 2",
    "partition_closes": f"{_W}, s AS (SELECT COUNT(*) AS n FROM decision GROUP BY line, ecog) SELECT (SELECT COUNT(*) FROM decision) AS rows, (SELECT COUNT(DISTINCT decision_id) FROM decision) AS ids, CAST(SUM(n) AS BIGINT) AS over_strata, COUNT(*) AS strata FROM s",
    "exposure_prevalence": f"{_W}, {EXPOSURE_CTE} SELECT candidate, COUNT(*) AS exposed, ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM decision), 6) AS prevalence FROM exposure GROUP BY 1",
    "modality_census": f"{_W}, {EXPOSURE_CTE} SELECT decision_id IN (SELECT decision_id FROM exposure) AS has_lines, COUNT(*) AS n FROM decision GROUP BY 1",
    "patient_counts": f"{_W} SELECT patient_id, COUNT(*) AS n FROM decision GROUP BY 1",
    "validation_rejects": f"{_W} SELECT CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in CHECKS) + " ELSE 'valid' END AS reason, COUNT(*) AS n FROM decision GROUP BY 1",
    "contract_rejects": f"""{_W}, r AS (SELECT list_filter([CASE WHEN site NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') THEN 'site: not declared' END, CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') THEN 'c_mktsegment: not declared' END,
CASE WHEN follow_up_months NOT BETWEEN 0 AND 9.5 THEN 'follow_up_months: out of bounds' END, CASE WHEN c_acctbal NOT BETWEEN -900 AND 9900 THEN 'c_acctbal: out of bounds' END, CASE WHEN follow_up_months <= 0 THEN 'follow_up_months: not positive' END], lambda x: x IS NOT NULL) AS r FROM decision)
SELECT unnest(CASE WHEN len(r) = 0 THEN ['valid'] ELSE r END) AS reason, COUNT(*) AS n FROM r GROUP BY 1""",
    "embedding_norm": "SELECT vec_id, label, ROUND(SQRT(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM embeddings",
    "slide_signature": "SELECT label, CAST(i - 1 AS INTEGER) AS pos, ROUND(AVG(CAST(embedding[i] AS DOUBLE)), 4) AS mean FROM embeddings, unnest(range(1, 9)) AS u(i) GROUP BY 1, 2",
    "slide_feature": f"SELECT vec_id, ROUND(COALESCE(list_sum(list_transform(list_zip(embedding[1:{len(WEIGHTS)}], {list(WEIGHTS)}[1:len(embedding)]), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 0.0), 4) AS signature FROM embeddings",
    "centred_modifier": f"{_W} SELECT decision_id, ROUND(CASE WHEN ecog = 0 THEN c_acctbal - AVG(c_acctbal) FILTER (ecog = 0) OVER (PARTITION BY site) ELSE 0.0 END, 4) AS centred FROM decision",
}
