"""Connected components of an edge table, by hooking to the smallest neighbouring label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: An end of more edges than HUB has them dealt to SALTS tasks.
HUB, SALTS = 500, 32


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the smallest id that can be reached.

    A round's labels are written to the shared folder. Labels at least halve the depth of each tree per round, so the rounds
    grow with the logarithm of the longest path. Hubs are no trouble: what they hear from their neighbours is combined to a minimum
    before the shuffle, and what they tell them goes out from several tasks.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.write(both)
    hubs = scratch.write(both.groupBy("b").count().where(F.col("count") > HUB).select(F.col("b").alias("hub")))
    salted = not hubs.isEmpty()
    if salted:
        salt = F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("a"), F.lit(SALTS))).otherwise(0).cast("int")
        both = scratch.write(both.join(hubs, F.col("b") == F.col("hub"), "left").select("a", "b", salt.alias("salt")))
    labels = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        told, on = labels, F.col("b") == F.col("id")
        if salted:
            salts = F.explode(F.when(F.col("hub").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
            told = labels.join(hubs, F.col("id") == F.col("hub"), "left").select("id", "component", salts.alias("of_salt"))
            on = on & (F.col("salt") == F.col("of_salt"))
        near = both.join(told, on).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        root = labels.select(F.col("id").alias("root"), F.col("component").alias("above"))
        jumped = scratch.write(hooked.join(root, F.col("component") == F.col("root"), "left").select("id", "old", F.least("component", "above").alias("component")))
        scratch.drop(labels)
        labels = jumped.select("id", "component")
        labels._scratch_path = jumped._scratch_path
        if jumped.where("old <> component").isEmpty():
            scratch.drop(both)
            return labels
