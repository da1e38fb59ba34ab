"""Ranking metrics over long (list, item, relevance) rows: one pass of rank windows per list, then map-side combined sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: str, score: str, name: str, into: str = "rank") -> DataFrame:
    """rows with each item's place in its list: scores descend, names ascend on a tie."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(name))))


def at_k(rows: DataFrame, by: str, relevance: str, k: int) -> DataFrame:
    """Per list of ranked rows: hits, recall, ndcg at k and average precision. Lists without relevant items score 0."""
    rel = F.col(relevance) > 0
    gain = F.greatest(F.col(relevance), F.lit(0.0))
    ideal = F.row_number().over(Window.partitionBy(by).orderBy(gain.desc()))
    found = F.sum(rel.cast("int")).over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    r = rows.withColumn("_ideal", ideal).withColumn("_found", found).withColumn("_gain", gain).withColumn("_rel", rel.cast("int"))
    top = F.col("rank") <= k
    total = F.sum("_rel")
    return r.groupBy(by).agg(
        (F.sum(F.when(top, F.col("_rel"))) / F.least(F.lit(k), F.count("*"))).alias("hits"),
        F.coalesce(F.try_divide(F.sum(F.when(top, F.col("_rel"))), total), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(F.sum(F.when(top, F.col("_gain") / F.log2(F.col("rank") + 1.0))), F.sum(F.when(F.col("_ideal") <= k, F.col("_gain") / F.log2(F.col("_ideal") + 1.0)))), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("_rel") == 1, F.col("_found") / F.col("rank"))), total), F.lit(0.0)).alias("average_precision"),
    )


def at_depths(rows: DataFrame, by: str, relevance: str, depths: tuple[int, ...]) -> DataFrame:
    """(by, depth, hits, recall, ndcg) of ranked rows for several depths: the windows and the grouping are those of one."""
    rel = (F.col(relevance) > 0).cast("int")
    gain = F.greatest(F.col(relevance), F.lit(0.0))
    r = rows.withColumn("_ideal", F.row_number().over(Window.partitionBy(by).orderBy(gain.desc()))).withColumn("_gain", gain).withColumn("_rel", rel)
    discounted = lambda place: F.col("_gain") / F.log2(F.col(place) + 1.0)

    def one(k: int):
        hits = F.sum(F.when(F.col("rank") <= k, F.col("_rel")).otherwise(0))
        return F.struct(
            F.lit(k).alias("depth"), (hits / F.least(F.lit(k), F.count("*"))).alias("hits"), F.coalesce(F.try_divide(hits, F.sum("_rel")), F.lit(0.0)).alias("recall"),
            F.coalesce(F.try_divide(F.sum(F.when(F.col("rank") <= k, discounted("rank"))), F.sum(F.when(F.col("_ideal") <= k, discounted("_ideal")))), F.lit(0.0)).alias("ndcg"),
        )

    return r.groupBy(by).agg(F.array(*map(one, depths)).alias("_d")).select(by, F.explode("_d").alias("_d")).select(by, "_d.*")
