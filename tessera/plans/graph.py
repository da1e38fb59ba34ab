"""The typed graph: census, degrees, walks, motifs, orbits, negatives and Laplacian entries."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.model import EDGE_CTE, SCORED_CTE, edges, scored
from tessera.sources.stored import cut

#: The motifs that a node's signature counts: every relation, and walks of two and three; a relation after ~ is walked backwards.
MOTIF_SET = (
    ("has_type",), ("has_size",), ("located_in",), ("part_of",), ("supplies",),
    ("has_type", "has_size"), ("located_in", "part_of"), ("supplies", "has_type"), ("supplies", "has_size"),
    ("~supplies", "located_in", "part_of"), ("has_size", "~has_size", "has_type"), ("supplies", "has_size", "~has_size"),
)


def _kind(c) -> F.Column:
    return F.split_part(c, F.lit(":"), F.lit(1))


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("head").alias("node")).union(e.select(F.col("tail").alias("node"))).distinct()


def graph_census(spark, sf_dir):
    """Nodes by kind and edges by relation, with totals."""
    e = edges(spark, sf_dir)
    n = nodes(e).groupBy(F.concat(F.lit("node:"), _kind(F.col("node"))).alias("what")).agg(F.count("*").alias("n"))
    r = e.groupBy(F.concat(F.lit("edge:"), F.col("relation")).alias("what")).agg(F.count("*").alias("n"))
    return n.union(r).union(n.agg(F.lit("node:_total").alias("what"), F.sum("n").alias("n"))).union(r.agg(F.lit("edge:_total").alias("what"), F.sum("n").alias("n")))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Distinct names with their number from 0 in order: ranges of names are sorted apart, and the ranges' counts are summed up."""
    part = cut(rows.repartitionByRange(name).withColumn("part", F.spark_partition_id()))
    n = part.groupBy("part").agg(F.count("*").alias("n"))
    before = n.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    return part.join(before, "part").select(name, (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1).alias("number"))


def _degrees(e: DataFrame) -> DataFrame:
    both = e.select(F.col("head").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(e.select(F.col("tail").alias("node"), F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("out").alias("out_degree"), F.sum("in").alias("in_degree"))


def degrees(spark, sf_dir):
    return _degrees(edges(spark, sf_dir))


def degree_terciles(spark, sf_dir):
    """Candidates cut at n // 3 and 2 n // 3 by degree; ties by name, the last group the largest."""
    d = _degrees(edges(spark, sf_dir)).where("node like 'candidate:%'").select("node", (F.col("out_degree") + F.col("in_degree")).alias("degree"))
    w = Window.orderBy("degree", "node")
    n = F.count("*").over(Window.partitionBy())
    r = d.withColumn("rk", F.row_number().over(w)).withColumn("n", n)
    return r.select("node", "degree", F.when(F.col("rk") <= F.floor(F.col("n") / 3), "lowest").when(F.col("rk") <= F.floor(2 * F.col("n") / 3), "middle").otherwise("highest").alias("tercile"))


def walk_counts_2(spark, sf_dir):
    """Directed two-step walks by relation pair: heads and tails are counted per node and relation first, so no walk is formed."""
    e = edges(spark, sf_dir)
    into = e.groupBy(F.col("tail").alias("node"), F.col("relation").alias("first")).agg(F.count("*").alias("i"))
    out = e.groupBy(F.col("head").alias("node"), F.col("relation").alias("second")).agg(F.count("*").alias("o"))
    return into.join(out, "node").groupBy("first", "second").agg(F.sum(F.col("i") * F.col("o")).alias("walks"))


def both_ways(e: DataFrame) -> DataFrame:
    """The edges, and each of them backwards under ``~`` and its relation."""
    return e.union(e.select("tail", F.concat(F.lit("~"), "relation"), "head"))


def starts(e: DataFrame, order: int, motifs: tuple[tuple[str, ...], ...] | None = None) -> DataFrame:
    """(node, motif, order, n): how many walks along each pattern of up to ``order`` relations start at each node; none where there are none.

    Walks grow at their start: those of a pattern are, by edge, those of the pattern without its first relation at the edge's tail. So
    counts of a level are one join with the edges and one sum, patterns that end alike share them, and patterns without a walk drop
    out. With motifs, only these and what they end in are grown, and only they are returned.
    """
    wanted = None if motifs is None else {">".join(m[i:]) for m in motifs for i in range(len(m))}
    kept = lambda level: level if wanted is None else level.where(F.col("motif").isin(*wanted))
    level = kept(e.select(F.col("head").alias("node"), F.col("relation").alias("motif"))).groupBy("node", "motif").agg(F.count("*").alias("n"))
    levels = [level.withColumn("order", F.lit(1))]
    for k in range(2, order + 1):
        level = cut(level)
        step = e.join(level, F.col("tail") == F.col("node")).select(F.col("head").alias("node"), F.concat_ws(">", "relation", "motif").alias("motif"), "n")
        level = kept(step).groupBy("node", "motif").agg(F.sum("n").alias("n"))
        levels.append(level.withColumn("order", F.lit(k)))
    out = reduce(DataFrame.unionByName, levels)
    return out if motifs is None else out.where(F.col("motif").isin(*[">".join(m) for m in motifs]))


def _bank(spark, sf_dir) -> DataFrame:
    return starts(both_ways(edges(spark, sf_dir)), max(map(len, MOTIF_SET)), MOTIF_SET)


def motif_frequencies(spark, sf_dir):
    """Walks of each motif of the set and their share of all; a motif without walks counts zero."""
    motifs = spark.createDataFrame([(">".join(m), len(m)) for m in MOTIF_SET], "motif string, order int")
    n = _bank(spark, sf_dir).groupBy("motif").agg(F.sum("n").alias("n"))
    w = motifs.join(n, "motif", "left").withColumn("walks", F.coalesce("n", F.lit(0).cast("bigint")))
    return w.select("motif", "order", "walks", F.round(F.col("walks") / F.sum("walks").over(Window.partitionBy()), 6).alias("share"))


def walks(e: DataFrame, motif: tuple[str, ...]) -> DataFrame:
    """(start, end, n): the number of walks along the motif's relations; a relation after ~ is walked backwards.

    Walks are counted to (start, node) after every step, so no single walk is formed. These are the nonzero entries of the
    product of the relations' operators.
    """
    now = None
    for relation in motif:
        head, tail = ("tail", "head") if relation.startswith("~") else ("head", "tail")
        step = e.where(F.col("relation") == relation.lstrip("~")).select(F.col(head).alias("node"), F.col(tail).alias("end"))
        if now is None:
            now = step.select(F.col("node").alias("start"), "end", F.lit(1).cast("bigint").alias("n"))
        else:
            now = now.withColumnRenamed("end", "node").join(step, "node").select("start", "end", "n")
        now = now.groupBy("start", "end").agg(F.sum("n").alias("n"))
    return now


#: The motif of the orbits and of the Laplacian: candidates that share targets.
SHARED = ("has_size", "~has_size")


def orbit_partition(spark, sf_dir):
    """The orbits of each candidate's neighbourhood under a motif: neighbours that as many walks from it reach."""
    w = walks(edges(spark, sf_dir), SHARED)
    return w.groupBy(F.col("start").alias("candidate"), F.col("n").alias("walks")).agg(F.count("*").alias("size"), F.concat_ws(",", F.sort_array(F.collect_list("end"))).alias("members"))


def orbit_regret_floor(spark, sf_dir):
    """Per candidate, the size-weighted mean spread of mean scores inside its orbits: what an encoder of structure alone can't resolve."""
    w = walks(edges(spark, sf_dir), SHARED)
    score = scored(spark, sf_dir).groupBy(F.concat(F.lit("candidate:"), "candidate").alias("end")).agg(F.avg("score").alias("score"))
    o = w.join(score, "end").groupBy("start", "n").agg(F.count("*").alias("size"), F.stddev_pop("score").alias("spread"))
    return o.groupBy(F.col("start").alias("candidate")).agg(F.round(F.sum(F.col("size") * F.col("spread")) / F.sum("size"), 6).alias("floor"), F.count("*").alias("orbits"))


def motif_bank(spark, sf_dir):
    """The motif signature of every node: its number of walks of each motif of the set, zeros included."""
    n = _bank(spark, sf_dir).groupBy("node").agg(*[F.sum(F.when(F.col("motif") == ">".join(m), F.col("n")).otherwise(0)).alias(_column(m)) for m in MOTIF_SET])
    return nodes(edges(spark, sf_dir)).join(n, "node", "left").fillna(0)


def _column(motif: tuple[str, ...]) -> str:
    return "__".join(r.replace("~", "of_") for r in motif)


def enumerate_motifs(spark, sf_dir):
    """Every pattern of one to three relations, either way, that occurs: its place in the order of names and its share of its length's walks."""
    w = starts(both_ways(edges(spark, sf_dir)), 3).groupBy("order", "motif").agg(F.sum("n").alias("walks"))
    return w.select("motif", "order", "walks", F.row_number().over(Window.partitionBy("order").orderBy("motif")).alias("place"), F.round(F.col("walks") / F.sum("walks").over(Window.partitionBy("order")), 6).alias("share"))


MASK_EVERY, NEGATIVES, STRIDE = 7, 12, 7919


def coprime(stride: int, m: int) -> int:
    """The least number from stride on that shares no factor with m."""
    while gcd(stride, m) > 1:
        stride += 1
    return stride


def negatives(e: DataFrame) -> DataFrame:
    """Of a fixed share of edges, each masked, NEGATIVES tails that are neither its head nor linked to it by its relation.

    Nodes are numbered once. An edge steps through them from a place of its own by a stride that shares no factor with their
    number, so it meets no node twice; the first free ones are its draw, which is without replacement. All edges take two steps for
    each negative first, and only those that fell short, because their head is linked to much, go on, twice as far each time.
    """
    node = numbered(nodes(e), "node")
    m = node.count()
    at = node.select(F.col("node").alias("head"), F.col("number").alias("h"))
    masked = e.join(at, "head").join(node.select(F.col("node").alias("tail"), F.col("number").alias("t")), "tail").where((F.col("h") * 31 + F.col("t") * 17) % MASK_EVERY == 0)
    taken = e.groupBy("head", "relation").agg(F.count("*").alias("taken"))
    left = cut(masked.join(taken, ["head", "relation"]).where(NEGATIVES + F.col("taken") + 1 <= m).select("head", "relation", "tail", "h", "t", F.lit(0).cast("bigint").alias("found")))
    by, links = coprime(STRIDE, m), e.select("head", "relation", F.col("tail").alias("negative"))
    free, first, after = None, 0, 2 * NEGATIVES
    while True:
        steps = left.select("head", "relation", "tail", "h", "t", F.explode(F.sequence(F.lit(first), F.lit(min(after, m) - 1))).alias("step"))
        drawn = steps.withColumn("number", (F.col("h") * 31 + F.col("t") * 17 + F.col("step").cast("bigint") * by) % m).join(node.withColumnRenamed("node", "negative"), "number").where("negative <> head")
        now = cut(drawn.join(links, ["head", "relation", "negative"], "left_anti"))
        free = now if free is None else free.union(now)
        more = now.groupBy("head", "relation", "tail").agg(F.count("*").alias("more"))
        left = left.join(more, ["head", "relation", "tail"], "left").withColumn("found", F.col("found") + F.coalesce("more", F.lit(0))).drop("more").where(F.col("found") < NEGATIVES)
        first, after = after, 2 * after
        if first >= m or left.isEmpty():
            break
        left = cut(left)
    place = F.row_number().over(Window.partitionBy("head", "relation", "tail").orderBy("step"))
    return free.withColumn("place", place).where(F.col("place") <= NEGATIVES).select("head", "relation", "tail", "negative", "place")


def negative_tails(spark, sf_dir):
    return negatives(edges(spark, sf_dir))


def anchors(spark, sf_dir):
    """Edges whose tail is shared by the most heads of their relation: the anchor of each relation."""
    n = edges(spark, sf_dir).groupBy("relation", "tail").agg(F.count("*").alias("n"))
    return n.groupBy("relation").agg(F.min_by("tail", F.struct(-F.col("n"), F.col("tail"))).alias("anchor"), F.max("n").alias("n"))


def laplacian_entries(spark, sf_dir):
    """Nonzero entries of the symmetric normalised Laplacian I - D^-1/2 A D^-1/2 of a motif's operator A, with D its row sums."""
    a = walks(edges(spark, sf_dir), SHARED)
    d = a.groupBy("start").agg(F.sum("n").alias("d"))
    both = a.join(d, "start").join(d.select(F.col("start").alias("end"), F.col("d").alias("d_end")), "end")
    value = F.when(F.col("start") == F.col("end"), 1.0).otherwise(0.0) - F.col("n") / F.sqrt(F.col("d").cast("double") * F.col("d_end"))
    return both.select(F.col("start").alias("i"), F.col("end").alias("j"), F.round(value, 6).alias("value"))


_W = f"WITH {EDGE_CTE}"
_N = f"{_W}, node AS (SELECT head AS node FROM edge UNION SELECT tail FROM edge)"
_DEG = f"{_W}, d AS (SELECT node, CAST(SUM(o) AS BIGINT) AS out_degree, CAST(SUM(i) AS BIGINT) AS in_degree FROM (SELECT head AS node, 1 AS o, 0 AS i FROM edge UNION ALL SELECT tail, 0, 1 FROM edge) GROUP BY 1)"
_SHARED = f"{_W}, z AS (SELECT head, tail FROM edge WHERE relation = 'has_size'), a AS (SELECT x.head AS s, y.head AS t, COUNT(*) AS n FROM z x JOIN z y USING (tail) GROUP BY 1, 2)"
_STARTS = f"""{_W}, bw AS (SELECT head, relation, tail FROM edge UNION ALL SELECT tail, '~' || relation, head FROM edge),
w1 AS (SELECT head AS node, relation AS motif, 1 AS "order", COUNT(*) AS n FROM bw GROUP BY 1, 2),
w2 AS (SELECT a.head AS node, a.relation || '>' || b.relation AS motif, 2 AS "order", COUNT(*) AS n FROM bw a JOIN bw b ON a.tail = b.head GROUP BY 1, 2),
w3 AS (SELECT a.head AS node, a.relation || '>' || w2.motif AS motif, 3 AS "order", CAST(SUM(n) AS BIGINT) AS n FROM bw a JOIN w2 ON a.tail = w2.node GROUP BY 1, 2),
st AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)"""
_WALK = f"{_W}, w AS (SELECT a.relation AS first, b.relation AS second, COUNT(*) AS walks FROM edge a JOIN edge b ON a.tail = b.head GROUP BY 1, 2)"
QUERIES = {f.__name__: f for f in (graph_census, degrees, degree_terciles, walk_counts_2, motif_frequencies, orbit_partition, orbit_regret_floor, motif_bank, enumerate_motifs, negative_tails, anchors, laplacian_entries)}
SQL = {
    "graph_census": f"""{_N}, c AS (SELECT 'node:' || split_part(node, ':', 1) AS what, COUNT(*) AS n FROM node GROUP BY 1 UNION ALL SELECT 'edge:' || relation, COUNT(*) FROM edge GROUP BY 1)
SELECT * FROM c UNION ALL SELECT 'node:_total', COUNT(*) FROM node UNION ALL SELECT 'edge:_total', COUNT(*) FROM edge""",
    "degrees": f"{_DEG} SELECT * FROM d",
    "degree_terciles": f"""{_DEG}, r AS (SELECT node, out_degree + in_degree AS degree, row_number() OVER (ORDER BY out_degree + in_degree, node) AS rk, COUNT(*) OVER () AS n FROM d WHERE node LIKE 'candidate:%')
SELECT node, degree, CASE WHEN rk <= n // 3 THEN 'lowest' WHEN rk <= 2 * n // 3 THEN 'middle' ELSE 'highest' END AS tercile FROM r""",
    "walk_counts_2": f"{_WALK} SELECT * FROM w",
    "motif_frequencies": f"""{_STARTS} SELECT motif, "order", COALESCE(walks, 0) AS walks, ROUND(CAST(COALESCE(walks, 0) AS DOUBLE) / SUM(COALESCE(walks, 0)) OVER (), 6) AS share
FROM (VALUES {', '.join(str((">".join(m), len(m))) for m in MOTIF_SET)}) AS s(motif, "order") LEFT JOIN (SELECT motif, CAST(SUM(n) AS BIGINT) AS walks FROM st GROUP BY 1) USING (motif)""",
    "orbit_partition": f"{_SHARED} SELECT s AS candidate, n AS walks, COUNT(*) AS size, string_agg(t, ',' ORDER BY t) AS members FROM a GROUP BY 1, 2",
    "orbit_regret_floor": f"""{_SHARED}, {SCORED_CTE}, m AS (SELECT 'candidate:' || candidate AS t, AVG(score) AS score FROM scored GROUP BY 1), o AS (SELECT s, n, COUNT(*) AS size, STDDEV_POP(score) AS spread FROM a JOIN m USING (t) GROUP BY 1, 2)
SELECT s AS candidate, ROUND(SUM(size * spread) / SUM(size), 6) AS floor, COUNT(*) AS orbits FROM o GROUP BY 1""",
    "motif_bank": f"""{_STARTS}, node AS (SELECT head AS node FROM edge UNION SELECT tail FROM edge)
SELECT node, {', '.join(f"CAST(COALESCE(SUM(n) FILTER (motif = '{'>'.join(m)}'), 0) AS BIGINT) AS {_column(m)}" for m in MOTIF_SET)} FROM node LEFT JOIN st USING (node) GROUP BY 1""",
    "enumerate_motifs": f"""{_STARTS}, w AS (SELECT "order", motif, CAST(SUM(n) AS BIGINT) AS walks FROM st GROUP BY 1, 2)
SELECT motif, "order", walks, row_number() OVER (PARTITION BY "order" ORDER BY motif) AS place, ROUND(CAST(walks AS DOUBLE) / SUM(walks) OVER (PARTITION BY "order"), 6) AS share FROM w""",
    "negative_tails": f"""{_N}, v AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS number, COUNT(*) OVER () AS m FROM node), k AS (SELECT head, relation, COUNT(*) AS taken FROM edge GROUP BY 1, 2),
d AS (SELECT e.*, h.number * 31 + t.number * 17 AS place, h.m, taken FROM edge e JOIN v h ON h.node = e.head JOIN v t ON t.node = e.tail JOIN k ON k.head = e.head AND k.relation = e.relation WHERE (h.number * 31 + t.number * 17) % {MASK_EVERY} = 0 AND {NEGATIVES} + taken + 1 <= h.m),
x AS (SELECT d.head, d.relation, d.tail, v.node AS negative, step FROM d, unnest(range({NEGATIVES} + taken + 1)) AS u(step) JOIN v ON v.number = (d.place + step * {STRIDE}) % d.m WHERE v.node <> d.head AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.head = d.head AND e.relation = d.relation AND e.tail = v.node))
SELECT * FROM (SELECT head, relation, tail, negative, row_number() OVER (PARTITION BY head, relation, tail ORDER BY step) AS place FROM x) WHERE place <= {NEGATIVES}""",
    "anchors": f"{_W}, n AS (SELECT relation, tail, COUNT(*) AS n FROM edge GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY n DESC, tail) AS rk FROM n) SELECT relation, tail AS anchor, n FROM r WHERE rk = 1",
    "laplacian_entries": f"{_SHARED}, d AS (SELECT s, SUM(n) AS d FROM a GROUP BY 1) SELECT a.s AS i, a.t AS j, ROUND(CASE WHEN a.s = a.t THEN 1.0 ELSE 0.0 END - n / SQRT(CAST(x.d AS DOUBLE) * y.d), 6) AS value FROM a JOIN d x ON x.s = a.s JOIN d y ON y.s = a.t",
}
