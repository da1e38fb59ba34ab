"""Near-duplicate detection with an LSH forest over word n-gram sets.

Every distinct set gets a pool of minhash values, and each tree of the forest takes another selection of them, in order, as a
set's label. A tree is the sorted order of its labels: Spark sorts all trees at once by ranges, so that no prefix, however common,
has to fit in a task. Sets that stand next to each other there and share a prefix of BASE values or more are candidates; the
longer the common prefix, the better. How deep a region is searched depends on what it holds. First each set is verified
against its best neighbours, those of the longest common prefixes in all trees together, which settles dense regions of alike sets
at any depth. Only regions of a common BASE prefix that then still hold several components are searched in full: by a rare-first
prefix join inside them, so that no pair that shares enough regions is left out, and none is enumerated that its sizes and members rule
out. All links are confirmed on full sets.

Two sets of similarity 0.85 miss all trees, or meet in one only, with a chance of less than one in a million; see ``missed``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import Scratch, table
from tessera.llm.components import components
from tessera.llm.ngram_join import BAND, KEPT_SETS, OP1_SQL, enough, left_over, sets_of, shingles, verify, whole_sets
from tessera.llm.words import mix, slices

PERCENT = 85
#: Minhash values of a set, and trees; the values of a label that neighbours must share, and those that only order them further.
POOL, TREES, BASE, DEEPER = 128, 40, 5, 3
#: Rounds in which each set is verified against its best neighbours that aren't known to be connected with it, and how many.
ROUNDS = (1, 3, 6)
#: A similar pair meets in two trees at least, so a set must have company in as many.
MEETINGS = 2


@lru_cache(maxsize=1)
def _layout() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multipliers and addends of the pool's functions, and of each tree, which of them make its labels."""
    rng = np.random.default_rng(7)
    factor, addend = rng.integers(0, 1 << 63, (2, POOL), np.int64).astype(np.uint64)
    # Each function is used equally often at the base: trees are rows of shuffled copies of the pool.
    deals = -(-TREES * BASE // POOL)
    while True:
        base = np.concatenate([rng.permutation(POOL) for _ in range(deals)])[: TREES * BASE].reshape(TREES, BASE)
        if all(len(set(r)) == BASE for r in base.tolist()):
            break
    rest = np.array([rng.choice(np.setdiff1d(np.arange(POOL), r), DEEPER, replace=False) for r in base])
    return factor * np.uint64(2) + np.uint64(1), addend, np.concatenate([base, rest], 1)


def missed(similarity: float, draws: int = 200_000, seed: int = 1) -> float:
    """The share of pairs of sets of this similarity that meet in fewer than MEETINGS trees, by simulation of equal minhash values."""
    _, _, trees = _layout()
    rng = np.random.default_rng(seed)
    same = rng.random((draws, POOL)) < similarity
    met = sum(same[:, t[:BASE]].all(1).astype(int) for t in trees)
    return float((met < MEETINGS).mean())


def minhashes(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """POOL minhash values for each of some sets without empty ones: grams[at[i]:at[i + 1]]."""
    factor, addend, _ = _layout()
    out = np.empty((POOL, len(at) - 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(POOL):
            out[i] = np.minimum.reduceat(grams * factor[i] + addend[i], at[:-1])
    return out


def labels(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By tree and set, a 64-bit name of the label's first BASE values, and 16 bits of each deeper one, the first foremost."""
    _, _, trees = _layout()
    key, deep = np.zeros((TREES, values.shape[1]), np.uint64), np.zeros((TREES, values.shape[1]), np.uint64)
    with np.errstate(over="ignore"):
        for t, picks in enumerate(trees):
            for i in picks[:BASE]:
                key[t] = mix(key[t] * np.uint64(0x9FB21C651E98DF25) + values[i])
            for i in picks[BASE:]:
                deep[t] = deep[t] << np.uint64(16) | mix(values[i]) & np.uint64(0xFFFF)
    return key, deep


def _signed(docs: DataFrame) -> DataFrame:
    """(tree, key, deep, doc_id, n, of): a row per document with tree -1 and its set's fingerprints, and one per tree for sets new to the task.

    of is an earlier document of the same task whose set is equal, if this worker still knows it.
    """
    key = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("deep", T.LongType()), key, T.StructField("n", T.LongType()), T.StructField("of", key.dataType)])
    of_type = to_arrow_type(key.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_row, met = TaskContext.get().partitionId() << 40, {}
        for b in batches:
            for lo, hi in slices(b["text"]):
                grams, at = shingles(b["text"].slice(lo, hi - lo))
                ids = b["doc_id"].slice(lo, hi - lo)
                n, (whole, check) = np.diff(at), whole_sets(grams, at)
                names, keys, of, sign = ids.to_pylist(), np.stack([whole, check], 1).tobytes(), [None] * (hi - lo), np.zeros(hi - lo, bool)
                if len(met) > KEPT_SETS:
                    met.clear()
                for i in np.flatnonzero((n > 0) & ids.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    first = met.setdefault(keys[16 * i : 16 * i + 16], (names[i],))
                    if first[0] is names[i]:
                        sign[i] = True
                    else:
                        of[i] = first[0]
                # Those that link with nothing, and copies that know of what, are spread out, each alone.
                whole[~sign] = mix(np.arange(at_row, at_row + hi - lo, dtype=np.uint64))[~sign]
                at_row += hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, -1, np.int32)), pa.array(whole.view(np.int64)), pa.array(check.view(np.int64)), ids, pa.array(n), pa.array(of, of_type)], names=schema.names)
                new = np.flatnonzero(sign)
                if not len(new):
                    continue
                key, deep = labels(minhashes(grams[np.repeat(sign, n)], np.concatenate([[0], np.cumsum(n[new])])))
                tree, signer = np.repeat(np.arange(TREES, dtype=np.int32), len(new)), ids.take(pa.array(np.tile(new, TREES)))
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(key.ravel().view(np.int64)), pa.array(deep.ravel().view(np.int64)), signer, pa.array(np.full(len(tree), -1 - MEETINGS * BAND)), pa.nulls(len(tree), of_type)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _neighbours(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, key, a, b, depth) of each two rows (tree, key, deep, doc_id) that are next to each other in their tree and share its key.

    depth counts the values that their labels share. Each partition of the sorted order also tells its first and last row, and
    those of two partitions that follow each other are put together afterwards.
    """
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("deep", T.LongType()), T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("depth", T.IntegerType()), T.StructField("part", T.IntegerType())])

    def shared(x: np.ndarray) -> np.ndarray:
        """BASE and the leading values of 16 bits that two deeper labels, whose exclusive or is x, share."""
        return (BASE + sum(((x >> np.int64(16 * i)) & np.int64((1 << 16 * (DEEPER - i)) - 1) == 0).astype(np.int32) for i in range(DEEPER))).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        end = lambda b, i: pa.RecordBatch.from_arrays([*(b[c].slice(i, 1) for c in ("tree", "key", "deep", "doc_id")), pa.nulls(1, b["doc_id"].type), pa.array([i and -2 or -1], pa.int32()), pa.array([part], pa.int32())], names=schema.names)
        for b in batches:
            if not len(b):
                continue
            if last is None:
                yield end(b, 0)
            else:
                b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            tree, key, deep = (b[c].to_numpy() for c in ("tree", "key", "deep"))
            i = np.flatnonzero((tree[1:] == tree[:-1]) & (key[1:] == key[:-1]))
            if len(i):
                one, two = pa.array(i), pa.array(i + 1)
                arrays = [b["tree"].take(one), b["key"].take(one), b["deep"].take(one), b["doc_id"].take(one), b["doc_id"].take(two), pa.array(shared(deep[i] ^ deep[i + 1])), pa.array(np.full(len(i), part, np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            last = b.slice(len(b) - 1)
        if last is not None:
            out = end(last, 0)
            yield out.set_column(5, "depth", pa.array([-2], pa.int32()))

    order = ["tree", "key", "deep", "doc_id"]
    found = scratch.write(rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    # Two rows for each partition.
    ends = found.where("depth < 0").groupBy("part").agg(*[F.max(F.when(F.col("depth") == which, F.struct("tree", "key", "deep", "a"))).alias(name) for name, which in (("first", -1), ("last", -2))])
    ends = ends.withColumn("next", F.lead("first").over(Window.orderBy("part"))).where("last.tree = next.tree and last.key = next.key")
    across = ends.select("last.tree", "last.key", F.col("last.a").alias("a"), F.col("next.a").alias("b"), F.lit(BASE).alias("depth"))
    return found.where("depth > 0").select("tree", "key", "a", "b", "depth").union(across).where("a <> b")


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs.

    Documents link if 100 * intersection >= percent * union of their sets. component_id is the smallest id that links lead to, the
    row's own included, and kept says whether that is the row's own. Texts that are null or have no words have no shingles and link
    with nothing. Rows of a null id have a null component, link with nothing and are kept; rows of one id are one document.
    Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = scratch.write(_signed(docs))
    rows = signed.where("tree < 0").drop("tree")
    # Of the sets that tasks met first, those that are equal: a row or none for each task and set. Further copies follow their first.
    first = rows.where("n > 0 and of is null")
    centres = first.groupBy("key", "deep").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("far")).where("centre <> far")
    equal = first.join(centres, ["key", "deep"]).where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b"))
    # Rows of one id are one document: where they are copies of different texts, these belong together.
    twice = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    equal = scratch.write(equal.union(rows.where("of is not null and doc_id <> of").join(twice, "doc_id", "left_semi").select("doc_id", "of")))
    known = components(equal, scratch)
    pairs = scratch.write(_neighbours(signed.where("tree >= 0"), scratch))
    region = ["tree", "key"]
    members = pairs.select(*region, F.col("a").alias("doc_id")).union(pairs.select(*region, "b")).distinct()
    near = members.withColumn("sig", F.xxhash64("tree", "key")).withColumn("n", F.lit(-1 - MEETINGS * BAND))
    near = scratch.write(enough(near.select("doc_id", "sig", "n")))
    candidates = scratch.write(near.select("doc_id").distinct())
    sets = scratch.write(sets_of(docs.join(candidates, "doc_id", "left_semi")))
    best = scratch.write(pairs.groupBy("a", "b").agg(F.sum("depth").alias("depth")))
    tested = None
    for most in ROUNDS:
        of = lambda end: known.select(F.col("id").alias(end), F.col("component").alias(f"{end}_in"))  # noqa: B023, E731
        apart = best.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b", "depth")
        if tested is not None:
            apart = apart.join(tested, ["a", "b"], "left_anti")
        # A set has two neighbours in a tree at most.
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("depth"), "b"))
        now = scratch.write(apart.withColumn("rank", rank).where(F.col("rank") <= most).select("a", "b"))
        known = _joined(known, scratch.write(verify(now, sets, percent)), scratch)
        tested = now if tested is None else tested.union(now)
    own = near.join(known.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = own.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
    near = scratch.write(enough(own.join(several, "sig", "left_semi")))
    if not near.isEmpty():
        sizes = rows.where("n > 0").select("doc_id", F.col("n").alias("size")).distinct()
        known = _joined(known, scratch.write(verify(left_over(near, sets, sizes, scratch, percent), sets, percent)), scratch)
    first = F.coalesce("of", "doc_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), first.alias("id")).join(known, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("group"))
    # The smallest id may be that of a copy that followed another.
    smallest = scratch.write(out.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("far")).where("component_id <> far or component_id <> group").drop("far"))
    out = out.join(smallest, "group", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _joined(known: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The components of known ones (id, component) and further links (a, b)."""
    return known if found.isEmpty() else components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found), scratch)


def op11_minhash_forest(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "minhash-forest")
    return near_duplicates(table(spark, sf_dir, "documents"), scratch)


OP11_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({OP1_SQL.replace('>= 80 *', f'>= {PERCENT} *')})"
