"""Canonical views of the fact tables: one row per decision, and long exposure rows."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.stored import spread

HELD_OUT_SITE = "ASIA"
#: Restricted-mean horizons in months, by line of therapy.
HORIZONS = {"first": 8.0, "second": 6.5, "third_plus": 5.5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: patient, site, split, line of therapy, covariates, follow-up and event.

    The line is the rank of the order among the customer's, so the one large shuffle is on the customer key, which the join
    with the customers then reuses. Nation and region are small dimensions that Spark broadcasts by their measured size.
    """
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w))
    geo = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    d = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.when(F.col("rn") == 1, "first").when(F.col("rn") == 2, "second").otherwise("third_plus")
    months = F.when(F.col("rn") == 1, F.lit(HORIZONS["first"])).when(F.col("rn") == 2, F.lit(HORIZONS["second"])).otherwise(F.lit(HORIZONS["third_plus"]))
    return d.select(
        F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("patient_id"), F.col("r_name").alias("site"),
        F.when(F.col("r_name") == HELD_OUT_SITE, "held_out").otherwise("development").alias("split"), line.alias("line"),
        F.least(F.lit(2), F.col("rn") - 1).cast("int").alias("prior_bucket"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("ecog"),
        "c_acctbal", "c_mktsegment", (F.floor(F.col("o_totalprice") / 500.0).cast("double") / F.lit(100.0)).alias("follow_up_months"),
        (F.col("o_orderstatus") != "O").alias("event"), months.alias("horizon_months"),
    )


def exposed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`exposures` as often as there are lines, for what counts none of them twice."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("decision_id"), F.col("p_brand").alias("candidate"))


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (decision_id, candidate) rows: an order is exposed to a brand that one of its lines has."""
    return exposed_lines(spark, sf_dir).distinct()


def exposed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct candidates of :func:`exposures`, without forming its rows: brands of parts that some line has."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf_dir, "part").join(lines, "p_partkey", "left_semi").select(F.col("p_brand").alias("candidate")).distinct()


#: What the prescriber sees at the time of a decision, in a fixed order; the continuous ones among them.
PRESCRIBING = "ecog prior_orders line_index balance years_since_first log_gap first_order season_sin season_cos calendar_year seg_building seg_furniture seg_household seg_machinery n_lines mean_quantity".split()
CONTINUOUS = ("prior_orders", "balance", "log_gap", "calendar_year", "mean_quantity")


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decision_id and the PRESCRIBING columns, all doubles: the state at the order's time, from the customer's earlier orders and its lines."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", day.alias("day"), F.row_number().over(w).alias("rn"), F.datediff(day, F.lag(day).over(w)).alias("gap"), F.datediff(day, F.first(day).over(w)).alias("since"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.avg("l_quantity").alias("mean_quantity"))
    d = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    turn = 2.0 * pi * (F.dayofyear("day") - 1) / 365.0
    segment = lambda name: (F.col("c_mktsegment") == name)
    columns = {
        "ecog": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "prior_orders": F.log1p(F.col("rn") - 1), "line_index": F.least(F.lit(2), F.col("rn") - 1), "balance": F.col("c_acctbal") / 1000.0,
        "years_since_first": F.col("since") / 365.0, "log_gap": F.log1p(F.coalesce("gap", F.lit(0))), "first_order": F.col("rn") == 1, "season_sin": F.sin(turn), "season_cos": F.cos(turn), "calendar_year": F.year("day") - 1995,
        **{f"seg_{s.lower()}": segment(s) for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}, "n_lines": F.coalesce("n_lines", F.lit(0)), "mean_quantity": F.coalesce("mean_quantity", F.lit(0.0)),
    }
    return d.select(F.col("o_orderkey").alias("decision_id"), *[columns[c].cast("double").alias(c) for c in PRESCRIBING])


COVARIATE_CTE = """covariate AS (
SELECT o_orderkey AS decision_id, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS DOUBLE) AS ecog, ln(CAST(rn AS DOUBLE)) AS prior_orders, CAST(LEAST(2, rn - 1) AS DOUBLE) AS line_index, c_acctbal / 1000.0 AS balance,
       (day - first_day) / 365.0 AS years_since_first, ln(1.0 + COALESCE(day - before, 0)) AS log_gap, CAST(rn = 1 AS DOUBLE) AS first_order,
       sin(2.0 * pi() * (dayofyear(day) - 1) / 365.0) AS season_sin, cos(2.0 * pi() * (dayofyear(day) - 1) / 365.0) AS season_cos, CAST(year(day) - 1995 AS DOUBLE) AS calendar_year,
       CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS seg_building, CAST(c_mktsegment = 'FURNITURE' AS DOUBLE) AS seg_furniture, CAST(c_mktsegment = 'HOUSEHOLD' AS DOUBLE) AS seg_household, CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS seg_machinery,
       CAST(COALESCE(n_lines, 0) AS DOUBLE) AS n_lines, COALESCE(mean_quantity, 0.0) AS mean_quantity
FROM (SELECT *, CAST(o_orderdate AS DATE) AS day, ROW_NUMBER() OVER w AS rn, LAG(CAST(o_orderdate AS DATE)) OVER w AS before, FIRST(CAST(o_orderdate AS DATE)) OVER w AS first_day
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) o
JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n_lines, AVG(l_quantity) AS mean_quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


#: The same two views as SQL common table expressions, to prefix oracle statements with.
DECISION_CTE = """decision AS (
SELECT decision_id, patient_id, site, split, line, prior_bucket, ecog, c_acctbal, c_mktsegment, follow_up_months, event,
       CAST(CASE line WHEN 'first' THEN 8.0 WHEN 'second' THEN 6.5 ELSE 5.5 END AS DOUBLE) AS horizon_months
FROM (SELECT o_orderkey AS decision_id, o_custkey AS patient_id, r_name AS site,
             CASE WHEN r_name = 'ASIA' THEN 'held_out' ELSE 'development' END AS split,
             CASE WHEN rn = 1 THEN 'first' WHEN rn = 2 THEN 'second' ELSE 'third_plus' END AS line,
             CAST(LEAST(2, rn - 1) AS INT) AS prior_bucket,
             CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS ecog,
             c_acctbal, c_mktsegment,
             CAST(FLOOR(o_totalprice / 500.0) AS DOUBLE) / CAST(100 AS DOUBLE) AS follow_up_months,
             o_orderstatus <> 'O' AS event
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) o
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) d)"""
EXPOSURE_CTE = "exposure AS (SELECT DISTINCT l_orderkey AS decision_id, p_brand AS candidate FROM lineitem JOIN part ON l_partkey = p_partkey)"

SCORED_CTE = """scored AS (SELECT l_orderkey AS decision_id, p_brand AS candidate, ROUND(SUM(l_quantity * (1 - l_discount)) / 100.0 - 0.25, 6) AS score,
  ROUND(AVG(l_tax) * 10.0 + 0.02, 6) AS propensity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
counted AS (SELECT candidate, COUNT(*) AS exposed FROM scored GROUP BY 1)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (decision_id, candidate, score, propensity): what an emulation would hand to the gate, derived from the lines.

    Lines are dealt by their decision to as many tasks as their number asks for, so that sums, and windows over a decision's
    candidates, need no other shuffle, and a task's share of them is the same whatever the size of the tables.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    met = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("decision_id"), F.col("p_brand").alias("candidate"), "l_quantity", "l_discount", "l_tax")
    return spread(met, li.count(), "decision_id").groupBy("decision_id", "candidate").agg(
        F.round(F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))) / 100.0 - 0.25, 6).alias("score"), F.round(F.avg("l_tax") * 10.0 + 0.02, 6).alias("propensity")
    )


RATED_CTE = "rated AS (SELECT doc_id, quality AS outcome, ROUND(n_chars / (n_chars + 1500.0), 4) AS p, ROUND(LEAST(0.99, n_chars / 4000.0), 4) AS p2 FROM documents JOIN labels USING (doc_id))"


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, outcome, p, p2): labelled documents with two predicted probabilities."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("outcome"), F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 4).alias("p"), F.round(F.least(F.lit(0.99), F.col("n_chars") / 4000.0), 4).alias("p2"))


EDGE_CTE = """edge AS (
  SELECT DISTINCT 'candidate:' || p_brand AS head, 'has_type' AS relation, 'pathway:' || p_type AS tail FROM part
  UNION ALL SELECT DISTINCT 'candidate:' || p_brand, 'has_size', 'target:' || CAST(p_size % 10 AS VARCHAR) FROM part
  UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), 'located_in', 'nation:' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'nation:' || n_name, 'part_of', 'region:' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT 'supplier:' || CAST(l_suppkey AS VARCHAR), 'supplies', 'candidate:' || p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(head, relation, tail): a typed graph over brands, types, sizes, suppliers, nations and regions."""
    part, supplier, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    region, lines = table(spark, sf_dir, "region"), table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), c.cast("string"))
    col = F.col
    rows = lambda df, h, r, t: df.select(h.alias("head"), F.lit(r).alias("relation"), t.alias("tail"))
    brand = node("candidate", col("p_brand"))
    return (
        rows(part, brand, "has_type", node("pathway", col("p_type"))).distinct()
        .union(rows(part, brand, "has_size", node("target", col("p_size") % 10)).distinct())
        .union(rows(supplier.join(nation, col("s_nationkey") == col("n_nationkey")), node("supplier", col("s_suppkey")), "located_in", node("nation", col("n_name"))))
        .union(rows(nation.join(region, col("n_regionkey") == col("r_regionkey")), node("nation", col("n_name")), "part_of", node("region", col("r_name"))))
        .union(rows(lines.join(part, col("l_partkey") == col("p_partkey")), node("supplier", col("l_suppkey")), "supplies", brand).distinct())
    )
