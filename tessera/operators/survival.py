"""Product-limit curves and the quantities read off them. Each takes long rows and grouping keys; windows run over distinct times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def curve(rows: DataFrame, keys: list[str], time: str, event: str, weight: str | None = None) -> DataFrame:
    """Product-limit steps per key: one row per distinct time t with n, deaths, at_risk and survival.

    Rows are first summed to distinct times (map-side combined), so the windows run over steps, not over rows.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    steps = rows.groupBy(*keys, F.col(time).alias("t")).agg(F.sum(w).alias("n"), F.sum(F.when(F.col(event), w).otherwise(0.0)).alias("deaths"))
    back = Window.partitionBy(*keys).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    forth = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    at = steps.withColumn("at_risk", F.sum("n").over(back))
    return at.withColumn("survival", F.product(1.0 - F.coalesce(F.try_divide("deaths", F.col("at_risk")), F.lit(0.0))).over(forth))


def restricted_mean(steps: DataFrame, keys: list[str], horizon: str) -> DataFrame:
    """Area under each key's step curve up to the (per key constant) horizon: keys and rmst."""
    w = Window.partitionBy(*keys).orderBy("t")
    cut = F.least(F.col("t"), F.col(horizon))
    nxt = F.least(F.coalesce(F.lead("t").over(w), F.col(horizon)), F.col(horizon))
    pieces = steps.withColumn("piece", F.col("survival") * F.greatest(nxt - cut, F.lit(0.0))).withColumn("head", F.when(F.row_number().over(w) == 1, cut).otherwise(0.0))
    return pieces.groupBy(*keys).agg((F.sum("piece") + F.sum("head")).alias("rmst"))


def restricted_mean_error(steps: DataFrame, keys: list[str], horizon: str) -> DataFrame:
    """sqrt(sum S^2 d / n^2) times the horizon, S after the drop: the error that goes with the restricted mean here."""
    part = F.col("survival") * F.col("survival") * F.try_divide("deaths", F.col("at_risk") * F.col("at_risk"))
    return steps.where(F.col("t") <= F.col(horizon)).groupBy(*keys, F.col(horizon).alias("_h")).agg((F.sqrt(F.sum(part)) * F.col("_h")).alias("error")).drop("_h")


def inverse_integral(steps: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """steps (keys, t, n, deaths) with the curve and ``integral``: that of one over the floored curve from 0 up to t, by left values."""
    w = Window.partitionBy(*keys).orderBy("t")
    back = Window.partitionBy(*keys).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    at = steps.withColumn("at_risk", F.sum("n").over(back))
    at = at.withColumn("survival", F.product(1.0 - F.coalesce(F.try_divide("deaths", F.col("at_risk")), F.lit(0.0))).over(run))
    width = F.col("t") - F.coalesce(F.lag("t").over(w), F.lit(0.0))
    piece = at.withColumn("piece", width / F.greatest(F.coalesce(F.lag("survival").over(w), F.lit(1.0)), F.lit(floor)))
    return piece.withColumn("integral", F.sum("piece").over(run)).drop("piece")


def survival_at(steps: DataFrame, keys: list[str], month: Column) -> DataFrame:
    """keys and survival: the curve's value at a time, 1 before the first step."""
    inside = F.col("t") <= month
    return steps.groupBy(*keys).agg(F.coalesce(F.max_by(F.when(inside, F.col("survival")), F.when(inside, F.col("t"))), F.lit(1.0)).alias("survival"))


def incidence(rows: DataFrame, keys: list[str], time: str, event: str, month: float) -> DataFrame:
    """keys, n and risk: cumulative incidence at a month.

    Times beyond the month are capped to it and keep their event, so a later event counts at the month itself.
    """
    capped = rows.withColumn("_t", F.least(F.col(time), F.lit(month)))
    at = survival_at(curve(capped, keys, "_t", event), keys, F.lit(month))
    return at.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys).select(*keys, "n", (1.0 - F.col("survival")).alias("risk"))


def median_time(steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys and median: the first event time at which survival is one half or less, null if there is none."""
    return steps.groupBy(*keys).agg(F.min(F.when((F.col("survival") <= 0.5) & (F.col("deaths") > 0), F.col("t"))).alias("median"))


def e_value(ratio: Column) -> Column:
    """Strength of confounding that would explain a ratio away; NaN for ratios that are not positive."""
    r = F.when(ratio < 1.0, 1.0 / ratio).otherwise(ratio)
    return F.when(ratio <= 0.0, F.lit(float("nan"))).otherwise(r + F.sqrt(r * (r - 1.0)))


def e_value_limit(ratio: Column, lower: Column, upper: Column) -> Column:
    """The E-value of the limit nearer to one; 1 if the interval holds one."""
    return F.when((lower <= 1.0) & (upper >= 1.0), F.lit(1.0)).when(ratio >= 1.0, e_value(lower)).otherwise(e_value(upper))
