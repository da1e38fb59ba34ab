"""Clustering of vectors by rounds of nearest centroids, found by annulus search.

Components are whole numbers, and everything that decides is computed exactly. Centroids are sorted by norm. A vector can only be
closer to a centroid than u if their norms differ by u at most, so a binary search for the vector's norm leads to the nearest
candidates, and from there the search goes outwards on both sides. Each candidate is compared exactly and may lower u; a side is
done when its next norm lies outside the annulus. Norms are compared with a margin that covers rounding, so that whatever is
as near as the best, on the boundary too, is compared.

A round is one scan of the vectors: each task sums the vectors of each centroid, and Spark sums the tasks' sums. Only centroids,
whose number and size are parameters, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import Scratch, table

#: Components up to this size give squared distances that doubles, and up to that size that 64-bit integers hold exactly.
IN_DOUBLE, IN_LONG = 1 << 20, 1 << 26
#: Sums are sent as two decimals, of what is above and below this.
SPLIT = 10**18
LONGEST = (1 << 63) - 1


def _kind(*parts: np.ndarray) -> type:
    """The type in which distances between the rows of some whole-numbered arrays of doubles or Python integers are exact."""
    most = max((abs(p).max() for p in parts if p.size), default=0)
    return np.float64 if most <= IN_DOUBLE else np.int64 if most <= IN_LONG else object


def _exact(x: np.ndarray, kind: type) -> np.ndarray:
    return np.array([[int(c) for c in row] for row in x], object).reshape(x.shape) if kind is object and x.dtype != object else x.astype(kind)


class Annulus:
    """Centroids by norm; ``nearest`` gives each vector's centroid, the smaller number on a tie, and squared distance."""

    def __init__(self, centroids: list[list[int]]):
        #: Their numbers in order of norm.
        self.number = np.array(sorted(range(len(centroids)), key=lambda i: (sum(x * x for x in centroids[i]), i)), np.int64)
        self.centroids = np.array([centroids[i] for i in self.number], object)
        self.norm = np.sqrt((self.centroids * self.centroids).sum(1).astype(np.float64))
        #: Candidates compared by the last call.
        self.compared = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _kind(vectors, self.centroids)
        vectors, centroids = _exact(vectors, kind), self.centroids.astype(kind)
        n, k = len(vectors), len(centroids)
        norm = np.sqrt((vectors * vectors).sum(1).astype(np.float64)) if n else np.zeros(0)
        after = np.searchsorted(self.norm, norm)
        best, number = np.full(n, -1, kind), np.full(n, k, np.int64)
        u = np.full(n, np.inf)
        self.compared = 0
        #: By side, the rows that it isn't done for; all have come equally far from where their norm lies.
        sides = [(1, np.arange(n)), (-1, np.arange(n))]
        for step in range(k):
            left = []
            for side, rows in sides:
                at = after[rows] + step if side > 0 else after[rows] - 1 - step
                inside = (at >= 0) & (at < k)
                rows, at = rows[inside], at[inside]
                gap = np.abs(self.norm[at] - norm[rows])
                inside = gap <= u[rows] + 1e-9 * (norm[rows] + self.norm[at]) + 1e-9
                rows, at = rows[inside], at[inside]
                self.compared += len(rows)
                apart = vectors[rows] - centroids[at]
                far = (apart * apart).sum(1) if len(rows) else np.zeros(0, kind)
                won = (number[rows] == k) | (far < best[rows]) | (far == best[rows]) & (self.number[at] < number[rows])
                best[rows[won]], number[rows[won]] = far[won], self.number[at[won]]
                u[rows[won]] = np.sqrt(far[won].astype(np.float64))
                left.append((side, rows))
            sides = left
        return number, best


def _vectors(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The integers of some vectors of equal length, as doubles."""
    flat = column.flatten().to_numpy().astype(np.float64)
    return np.floor(scale * flat).reshape(-1, dims)


_SUMS = "cluster int, dim int, n bigint, above decimal(38,0), below decimal(38,0)"


def _moved(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after one round: the floor of the mean of their vectors, or where they were if they have none."""
    k, dims = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for b in batches:
            v = _vectors(b["v"], dims, scale)
            number, _ = search.nearest(v)
            v = _exact(v, object if _kind(v) is object else np.int64)
            n += np.bincount(number, minlength=k)
            for i in np.unique(number):
                sums[i] += v[number == i].sum(0)
        of = np.flatnonzero(n)
        flat = [int(x) for i in of for x in sums[i]]
        two = [pa.array([Decimal(f(x, SPLIT)) for x in flat], pa.decimal128(38, 0)) for f in (int.__floordiv__, int.__mod__)]
        counts = [pa.array(np.repeat(of, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(of)), pa.int32()), pa.array(np.repeat(n[of], dims))]
        yield pa.RecordBatch.from_arrays([*counts, *two], names=["cluster", "dim", "n", "above", "below"])

    sums = vectors.select("v").mapInArrow(run, _SUMS).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("above").alias("above"), F.sum("below").alias("below"))
    out = [list(c) for c in centroids]
    for r in sums.collect():  # k * dims rows
        out[r.cluster][r.dim] = (int(r.above) * SPLIT + int(r.below)) // r.n
    return out


def _assigned(vectors: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    dims, key = len(centroids[0]), vectors.schema["vec_id"]
    schema = T.StructType([key, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for b in batches:
            number, far = search.nearest(_vectors(b["v"], dims, scale))
            far = pa.array([x if x <= LONGEST else None for x in far.tolist()], pa.int64()) if far.dtype == object else pa.array(far.astype(np.int64))
            yield pa.RecordBatch.from_arrays([b["vec_id"].cast(to_arrow_type(key.dataType)), pa.array(number, pa.int32()), far], names=schema.names)

    return vectors.select("vec_id", "v").mapInArrow(run, schema)


def cluster(vectors: DataFrame, scratch: Scratch, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance), one row per row whose vector is kept, and the final centroids by number.

    Kept are vectors of exactly ``dims`` components without nulls, NaN or infinity; each component x becomes floor(scale * x). The first
    centroids are the k kept vectors of least sha256 of ``seed:vec_id``, on equal ids those of the lesser components first; rows
    of a null id start none. Fewer rows give fewer centroids, none of them no rows. Repeated rows count each; equal centroids are a
    tie, which the smaller number wins; centroids without vectors stay. Squared distances beyond 64 bits are compared exactly
    but given as null. Components may be as large as 32-bit floats are. Other columns are ignored.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    kept = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v"))
    kept = scratch.write(kept.where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").orderBy(order, "v").limit(k).select("v").collect()
    centroids = [[int(x) for x in np.floor(scale * np.array(r.v))] for r in first]
    if not centroids:
        return kept.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []
    for _ in range(rounds):
        centroids = _moved(kept, centroids, scale)
    return _assigned(kept, centroids, scale), centroids


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "centroids")
    found, centroids = cluster(table(spark, sf_dir, "embeddings"), scratch)
    found = scratch.write(found)
    # A row for each centroid; a sum that has an unknown term or passes 64 bits is unknown.
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), (F.count("distance") == F.count("*")).alias("known")).collect()
    fits = lambda rows: None if not all(r.known for r in rows) or (s := sum(int(r["sum"]) for r in rows)) > LONGEST else s
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sums = spark.createDataFrame([(r.cluster, fits([r]), fits(per), digest[r.cluster]) for r in per], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (SELECT rid, v.v, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.rid, v.v, c.c, (list_dot_product(v.v, v.v) - 2 * list_dot_product(v.v, c.v) + list_dot_product(c.v, c.v))::BIGINT AS d FROM v, c{i} c) v GROUP BY 1, 2),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS v FROM (SELECT c, j, sum(v[j]::BIGINT)::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) AS t(j) GROUP BY 1, 2) GROUP BY 1),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c)),"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL QUALIFY c < 40),
{"".join(map(_round, range(5)))}
a5 AS (SELECT rid, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.rid, c.c, (list_dot_product(v.v, v.v) - 2 * list_dot_product(v.v, c.v) + list_dot_product(c.v, c.v))::BIGINT AS d FROM v, c5 c) GROUP BY 1)
SELECT vec_id, a5.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a5.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(c5.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a5 JOIN v USING (rid) JOIN c5 USING (c)
"""
