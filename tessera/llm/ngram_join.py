"""Jaccard join of word n-gram sets through PartEnum signatures.

Sets are put in bands of equal size. In a band whose largest set has r members, two sets of similarity 0.8 differ in at most
k = 2r/9 members. The domain of n-gram fingerprints is cut into first-level parts, each of these into second-level parts,
and a set gets a signature for every subset of second-level parts that leaves ``spare`` of them out. There are more
first-level parts than k differences can spoil, so similar sets share signatures. A set also signs for the next band if a
partner may lie there.

There are a quarter more parts than sharing one signature takes. So similar sets share many, and how many is known for
each set: what shares fewer with all others together, or with one other, is dropped without a look at its members. This
keeps out sets that have a passage in common and little else, however many they are. What is left is verified exactly.

Sets that are equal to one that the task met before are not signed again: a text that a million pages share signs about once
a task. Groups of equal signature are never expanded to all pairs. First each member is verified against one centre of its groups;
what this proves connected is one component. Only pairs that share enough signatures across components are then looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import Scratch, table
from tessera.llm.components import components
from tessera.llm.words import Words, mix, slices

WORDS = 5
#: Bands of up to this many differences have three second-level parts, one of them spared; wider ones a single part.
FINE_K = 24
STAR_ROUNDS = 2
#: Sets that a task remembers to know their copies by; it then forgets them all, and signs a text once more when it comes back.
KEPT_SETS = 200_000
#: A signature's row carries the band and the least number of signatures that a similar pair shares there, in one number.
BAND = 128


@lru_cache(maxsize=1)
def _bands() -> np.ndarray:
    """The largest set size of each band."""
    r = [1]
    while r[-1] < 1 << 40:
        r.append(max(r[-1] + 1, r[-1] * 3 // 2))
    return np.array(r)


def _layout(r: int) -> tuple[int, int, int]:
    """First-level parts, second-level parts of each, and how many of these a subset spares, for sets of at most r members."""
    k = 2 * r // 9
    second, spare = (3, 1) if k <= FINE_K else (1, 0)
    slack = 2 + int(0.1 * k if spare else 0.25 * k + 0.4 * k**0.5)
    return k // (spare + 1) + 1 + slack, second, spare


def _least_shared(first: int, spare: int, differ: int) -> int:
    """Signatures that two sets share at least if ``differ`` members spoil parts at will."""
    if not spare:
        return first - differ
    # The first difference in a first-level part costs two of its three subsets, the second the last one.
    return max(0, 3 * first - 2 * min(differ, first) - max(0, differ - first))


def shingles(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram fingerprints of each text, sorted within it, and the offsets of the texts.

    Words are lower-cased in A-Z. A text of fewer than n words is one gram of all of them; without words it has none.
    """
    w = Words(texts, lower=True)
    grams, first = w.grams(n)
    doc = w.doc[first]
    count = np.diff(w.at)
    short = np.flatnonzero((count > 0) & (count < n))
    whole, word = np.zeros(len(short), np.uint64), w.hashes() if len(short) else w.code
    with np.errstate(over="ignore"):
        for j in range(n - 1):
            has = count[short] > j
            whole[has] += mix(word[w.at[short[has]] + j] + np.uint64(j * 0x1000193 + 7))
        whole = mix(whole + count[short].astype(np.uint64))
    grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.searchsorted(doc[new], np.arange(w.docs + 1))


def signatures(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of one sorted array of distinct fingerprints, and for each its band and least number, as one."""
    s = len(own)
    out, codes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if not s:
        return out[0], codes[0]
    bands = _bands()
    band = int(np.searchsorted(bands, s))
    high = own >> np.uint64(32)
    with np.errstate(over="ignore"):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own))])
        for i in (band, band + 1) if 5 * s >= 4 * (int(bands[band]) + 1) else (band,):
            r = int(bands[i])
            if 2 * r // 9 == 0:
                continue  # only equal sets are similar enough, and those share the signature of the whole set
            first, second, spare = _layout(r)
            n = first * second
            cut = np.searchsorted((high * np.uint64(n)) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
            part = mix(running[cut[1:]] - running[cut[:-1]] + mix(np.arange(n, dtype=np.uint64) + np.uint64(i << 32)))
            void = cut[1:] == cut[:-1]
            if spare:
                part, void = part.reshape(first, second), void.reshape(first, second)
                # The subsets that leave out one of the three parts.
                void = np.stack([void[:, 1] & void[:, 2], void[:, 0] & void[:, 2], void[:, 0] & void[:, 1]], 1).ravel()
                part = mix(np.stack([part[:, 1] + part[:, 2], part[:, 0] + part[:, 2], part[:, 0] + part[:, 1]], 1).ravel())
            # No partner in this band differs in more members than this.
            differ = (s + min(r, 5 * s // 4)) // 9
            least = _least_shared(first, spare, differ)
            # Subsets without members are the same in all sets and aren't signed, unless the rest can't vouch for a match. Then
            # all are, but a partner may sign for none of its own, and is only known to share one that has members.
            if least - int(void.sum()) > 0:
                part, least = part[~void], least - int(void.sum())
            else:
                least = 1
            out.append(part)
            codes.append(np.full(len(part), -1 - i - BAND * max(least, 1), np.int64))
    return np.concatenate(out), np.concatenate(codes)


def whole_sets(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each whole set: only sets that agree in both count as equal."""
    n = np.diff(at).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for salt in (np.uint64(1 << 60), np.uint64(0x5851F42D4C957F2D)):
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ salt))])
            out.append(mix(running[at[1:]] - running[at[:-1]] + mix(n + salt)))
    return out[0], out[1]


def _signed(docs: DataFrame) -> DataFrame:
    """(sig, check, doc_id, n, of): one row per signature with n < 0, and one row per document, by the whole set, with n its size.

    of is an earlier document of the same task whose set is equal, if this worker still knows it; such a copy isn't signed and
    its row is alone.
    """
    key = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("sig", T.LongType()), T.StructField("check", T.LongType()), key, T.StructField("n", T.LongType()), T.StructField("of", key.dataType)])
    of_type = to_arrow_type(key.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_row, met = TaskContext.get().partitionId() << 40, {}
        for b in batches:
            for lo, hi in slices(b["text"]):
                grams, at = shingles(b["text"].slice(lo, hi - lo))
                ids = b["doc_id"].slice(lo, hi - lo)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                n = np.diff(at)
                whole, check = whole_sets(grams, at)
                names, keys, alone, of, sign = ids.to_pylist(), np.stack([whole, check], 1).tobytes(), (n == 0) | ~known, [None] * (hi - lo), np.zeros(hi - lo, bool)
                if len(met) > KEPT_SETS:
                    met.clear()
                for i in np.flatnonzero(~alone).tolist():
                    first = met.setdefault(keys[16 * i : 16 * i + 16], (names[i],))
                    if first[0] is names[i]:
                        sign[i] = True
                    else:
                        of[i] = first[0]
                # Those that link with nothing, and copies that know of what, are spread out, each alone.
                alone |= ~sign
                whole[alone] = mix(np.arange(at_row, at_row + hi - lo, dtype=np.uint64))[alone]
                at_row += hi - lo
                sigs, codes = zip(*[signatures(grams[at[i] : at[i + 1]] if sign[i] else grams[:0]) for i in range(hi - lo)], strict=True)
                size = np.fromiter(map(len, sigs), np.int64, len(sigs))
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(check.view(np.int64)), ids, pa.array(n), pa.array(of, of_type)], names=schema.names)
                flat = np.concatenate(sigs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat.view(np.int64)), pa.array(np.zeros(len(flat), np.int64)), ids.take(pa.array(np.repeat(np.arange(hi - lo), size))), pa.array(np.concatenate(codes)), pa.nulls(len(flat), of_type)],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema)


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, grams array<long>)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("grams", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b["text"]):
                grams, at = shingles(b["text"].slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams.view(np.int64)))], names=["doc_id", "grams"])

    return docs.mapInArrow(run, schema)


def verify(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union; pairs of repeated rows repeat.

    Nothing is grouped by a or b behind the joins, so that adaptive execution may split a centre that thousands of pairs share.
    """
    one = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("grams_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("grams_b"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    small, large = F.least(F.size("grams_a"), F.size("grams_b")), F.greatest(F.size("grams_a"), F.size("grams_b"))
    # Sizes alone rule a pair out when the smaller set is too small; no intersection is computed then.
    return pairs.join(one, "a").join(two, "b").where((100 * small >= percent * large) & (100 * both >= percent * (small + large - both))).select("a", "b")


def _code() -> Column:
    return -1 - F.col("n")


def enough(rows: DataFrame) -> DataFrame:
    """The rows (sig, doc_id, n, ...) of documents that share as many signatures in a band as one partner there would bring."""
    counts = rows.groupBy("doc_id", "n").count().where(F.col("count") >= F.floor(_code() / BAND)).select("doc_id", "n")
    return rows.join(counts, ["doc_id", "n"], "left_semi")


def left_over(near: DataFrame, sets: DataFrame, sizes: DataFrame, scratch: Scratch, percent: int = 80) -> DataFrame:
    """The pairs (a, b) of near (doc_id, sig, n, component) across components that can be similar, for exact verification.

    A set's overlap with any other is at most the number of its members that are not its alone. Two sets of sizes x and y
    need an overlap of 4/9 (x + y) at 80 percent; so this number bounds the size of a partner from above. Copies that are too far from
    their group's centre mostly differ by members of their own, and so go here one by one, before any pair is formed.
    """
    largest = lambda overlap: F.call_function("div", overlap * F.lit(100 + percent), F.lit(percent)) - F.col("size")
    members = near.select("doc_id").distinct()
    own = sets.join(members, "doc_id", "left_semi").select("doc_id", F.explode("grams").alias("g"))
    alone = own.groupBy("g").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other")).where("doc_id = other").groupBy("doc_id").agg(F.count("*").alias("alone"))
    most = members.join(sizes, "doc_id").join(alone, "doc_id", "left")
    most = most.select("doc_id", "size", largest(F.col("size") - F.coalesce("alone", F.lit(0))).alias("largest"))
    near = near.join(most, "doc_id")
    # A group counts for a document if it has one small enough in it, and counts at all if it has several components.
    group = near.groupBy("sig").agg(F.min("size").alias("smallest"))
    near = near.join(group, "sig").where("largest >= smallest").drop("smallest")
    several = near.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
    near = scratch.write(enough(near.join(several, "sig", "left_semi")))
    # Of the documents that are left, the members by how rare they are among them. If two sets are similar, their first
    # common member comes early enough in both for what follows to reach the overlap: members further on needn't be met.
    # Counts are combined before they are shuffled, and written: a member that thousands of sets have then only meets its
    # count in a plain join, which adaptive execution splits.
    kept = scratch.write(near.select("doc_id", "size", "component").distinct())
    held = sets.join(kept.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode("grams").alias("g"))
    df = scratch.write(held.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"))
    own = Window.partitionBy("doc_id")
    met = held.join(df, "g").join(kept, "doc_id").withColumn("pos", F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "g")))
    early = scratch.write(met.withColumn("largest", largest(F.col("size") - F.col("pos") + 1)).where(f"100 * largest >= {percent} * size").drop("df", "pos"))
    several = early.groupBy("g").agg(F.min("size").alias("smallest"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("g", "smallest")
    early = scratch.write(early.join(scratch.write(several), "g").where("largest >= smallest").select("g", "doc_id", "component", "size", "largest"))
    other = early.select("g", F.col("doc_id").alias("b"), F.col("component").alias("of"), F.col("size").alias("size_b"), F.col("largest").alias("largest_b"))
    can = (F.col("component") < F.col("of")) & (F.col("size") <= F.col("largest_b")) & (F.col("size_b") <= F.col("largest"))
    return early.join(other, (early["g"] == other["g"]) & can).select(F.col("doc_id").alias("a"), "b").distinct()


def link(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of docs.

    component_id is the smallest id that links lead to, the row's own included. Texts that are null or have no words have no
    shingles and link with nothing. Rows of a null id keep a null component and link with nothing; rows of one id are one
    document. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    group = Window.partitionBy("sig", "check")
    shared = _signed(docs).withColumn("centre", F.min("doc_id").over(group)).withColumn("far", F.max("doc_id").over(group))
    shared = scratch.write(shared.where((F.col("n") >= 0) | (F.col("centre") != F.col("far"))).withColumn("centre", F.coalesce("of", "centre")).drop("far", "of", "check"))
    equal = shared.where("n > 0 and doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b"))
    near = scratch.write(enough(shared.where("n < 0")))
    # The written list of ids is small enough to be sent to the texts, or its size tells Spark that it isn't.
    candidates = scratch.write(near.select("doc_id").distinct())
    sets = scratch.write(sets_of(docs.join(candidates, "doc_id", "left_semi")))
    labels = components(equal, scratch)
    pairs = near.where("doc_id <> centre").groupBy("doc_id", "centre").count().groupBy(F.col("doc_id").alias("a")).agg(F.max_by("centre", "count").alias("b"))
    pairs = pairs.join(equal, ["a", "b"], "left_anti")
    for i in range(STAR_ROUNDS + 1):
        found = scratch.write(verify(pairs, sets))
        if not found.isEmpty():
            labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found), scratch)
        if i == STAR_ROUNDS:
            break
        # Groups that still hold several components, and in them the documents that can have a partner in another one.
        own = near.select("sig", "doc_id", "n").join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        several = own.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
        near = scratch.write(enough(own.join(several, "sig", "left_semi")))
        if near.isEmpty():
            break
        if i < STAR_ROUNDS - 1:
            # Another member of each group as its centre, for those of other components.
            rank = F.xxhash64("doc_id", F.lit(i))
            centres = near.groupBy("sig").agg(F.min_by("doc_id", rank).alias("b"), F.min_by("component", rank).alias("of"))
            pairs = near.join(centres, "sig").where("component <> of").groupBy(F.col("doc_id").alias("a"), "b").count().groupBy("a").agg(F.max_by("b", "count").alias("b"))
        else:
            pairs = left_over(near, sets, shared.where("n > 0").select("doc_id", F.col("n").alias("size")).distinct(), scratch)
    out = shared.where("n >= 0").select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "ngram-join")
    return link(table(spark, sf_dir, "documents"), scratch)


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i+4]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT link.b, r.c FROM r JOIN link ON link.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY 1, 2
"""
