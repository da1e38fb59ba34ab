"""The ranking head and graph embeddings, fitted on Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.sources.model import DECISION_CTE, SCORED_CTE, decisions, edges, scored

COLUMNS, RIDGE = ("one", "ecog", "prior", "balance"), 1.0


def _terms(spark, sf_dir):
    d = decisions(spark, sf_dir).select("decision_id", F.lit(1.0).alias("one"), F.col("ecog").cast("double").alias("ecog"), F.col("prior_bucket").cast("double").alias("prior"), (F.col("c_acctbal") / 10000.0).alias("balance"))
    return scored(spark, sf_dir).join(d, "decision_id")


def head_equations(spark, sf_dir):
    """Normal equations of the score on a decision's covariates, per candidate: ten products and four sums, whatever the rows."""
    pairs = [(a, b) for i, a in enumerate(COLUMNS) for b in [*COLUMNS[i:], "score"]]
    g = _terms(spark, sf_dir).groupBy("candidate").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs])
    return g.unpivot(["candidate"], [f"{a}*{b}" for a, b in pairs], "entry", "value").select("candidate", "entry", F.round(F.col("value") + 1e-7, 3).alias("value"))


def ranking_head(spark, sf_dir):
    """Ridge coefficients of each candidate's score; one group is one candidate's fourteen sums."""
    pairs = [(a, b) for i, a in enumerate(COLUMNS) for b in [*COLUMNS[i:], "score"]]
    g = _terms(spark, sf_dir).groupBy("candidate").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs])

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        k = len(COLUMNS)
        gram, rhs = np.zeros((k, k)), np.zeros(k)
        for i, a in enumerate(COLUMNS):
            rhs[i] = p[f"{a}*score"].iloc[0]
            for j in range(i, k):
                gram[i, j] = gram[j, i] = p[f"{a}*{COLUMNS[j]}"].iloc[0]
        beta = np.linalg.solve(gram + RIDGE * np.diag(np.r_[0.0, np.ones(k - 1)]) + 1e-9 * np.eye(k), rhs)
        return pd.DataFrame({"candidate": [p.candidate.iloc[0]], **{c: [round(float(b), 6)] for c, b in zip(COLUMNS, beta, strict=True)}})

    return g.groupBy("candidate").applyInPandas(solve, "candidate string, " + ", ".join(f"{c} double" for c in COLUMNS))


def graph_embeddings(spark, sf_dir):
    """Candidates' embeddings from who supplies them: implicit alternating least squares, blocked over the cluster by Spark.

    Returns each candidate's norm and how much better its true suppliers score than all suppliers do on average.
    """
    from pyspark.ml.recommendation import ALS

    e = edges(spark, sf_dir).where("relation = 'supplies'")
    n = e.select(F.regexp_extract("head", "[0-9]+", 0).cast("int").alias("supplier"), F.regexp_extract("tail", "[0-9]+", 0).cast("int").alias("brand")).distinct().withColumn("weight", F.lit(1.0))
    model = ALS(userCol="supplier", itemCol="brand", ratingCol="weight", implicitPrefs=True, rank=8, maxIter=5, seed=11).fit(n)
    items = model.itemFactors.select(F.col("id").alias("brand"), F.col("features").alias("f"))
    # The mean over all suppliers is one product with their mean vector: no (supplier, candidate) table is formed.
    mean = model.userFactors.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    true = model.transform(n).groupBy("brand").agg(F.avg("prediction").alias("true"))
    return items.join(true, "brand").crossJoin(F.broadcast(mean)).select(F.concat(F.lit("Brand#"), F.col("brand").cast("string")).alias("candidate"), F.round(F.sqrt(dot(F.col("f"), F.col("f"))), 4).alias("norm"), F.round(F.col("true") - dot(F.col("f"), F.col("m")), 4).alias("lift"))


_W = f"""WITH {DECISION_CTE}, {SCORED_CTE}, t AS (SELECT candidate, score, CAST(1.0 AS DOUBLE) AS one, ecog, prior_bucket AS prior, c_acctbal / 10000.0 AS balance FROM scored JOIN decision USING (decision_id)) """
QUERIES = {f.__name__: f for f in (head_equations, ranking_head, graph_embeddings)}
SQL = {"head_equations": _W + " UNION ALL ".join(f"SELECT candidate, '{a}*{b}' AS entry, ROUND(SUM({a} * {b}) + 1e-7, 3) AS value FROM t GROUP BY 1" for i, a in enumerate(COLUMNS) for b in [*COLUMNS[i:], "score"])}
