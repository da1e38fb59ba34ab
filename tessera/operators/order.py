"""Order across large groups: ranks by ranges of the ordering number and as-of values, so that no group has to fit into one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.stored import cut


def rank_within(rows: DataFrame, by: list[str], number: str, tie: str, into: str = "rank", size: str | None = None) -> DataFrame:
    """rows with their place from 1 in their group, in the order of (number, tie), and their group's size if that has a name.

    Spark cuts the rows by ranges of (group, number, tie) that hold about equally many, however the numbers are spread. A row's place
    is its place in its range and the count of its group's rows in the ranges before. So a window holds one range, or one
    count for each range, whatever the size of a group. Rows are written once, as their ranges must not change.
    """
    order = [*by, number, tie]
    placed = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    same = [F.col(f"_b_{c}").eqNullSafe(F.col(c)) for c in [*by, "_part"]]
    counts = counts.select(*[F.col(c).alias(f"_b_{c}") for c in [*by, "_part"]], before.alias("_before"), *([F.sum("_n").over(Window.partitionBy(*by)).alias(size)] if size else []))
    placed = placed.withColumn(into, F.row_number().over(Window.partitionBy(*by, "_part").orderBy(number, tie)))
    return placed.join(counts, reduce(and_, same)).withColumn(into, F.col(into) + F.col("_before")).select(*rows.columns, into, *([size] if size else []))


def as_of(points: DataFrame, steps: DataFrame, keys: list[str], at: str, t: str, value: str, default: Column, into: str, before: bool = False) -> DataFrame:
    """points with the value of the last step at or before their time, or strictly before it; default where there is none.

    Points are first reduced to distinct times, which are put between the steps in one window per key; what each time finds
    then goes back to the points by an equi-join. So the window holds times, not points, and any time may be asked for.
    """
    times = points.select(*keys, F.col(at).alias("_t")).distinct()
    known = steps.select(*keys, F.col(t).alias("_t"), F.col(value).cast("double").alias("_value"), F.lit(0).alias("_asks"))
    both = known.unionByName(times.withColumn("_value", F.lit(None).cast("double")).withColumn("_asks", F.lit(-1 if before else 1)))
    last = F.last("_value", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn(into, last).where("_asks <> 0").select(*keys, F.col("_t").alias(at), F.coalesce(into, default).alias(into))
    return points.join(found, [*keys, at], "left")
