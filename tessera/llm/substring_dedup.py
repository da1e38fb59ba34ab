"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

Positions are ranked by the KEY bytes there, then by the pair of that rank and the rank KEY bytes further on, which names twice
as many bytes, then by the pair of two such names that cover LENGTH bytes: 37, 74, 100. Spark sorts the pairs in each round; what
is unique drops out, and so does what is known to repeat. Within a task the first ranks come about in the same way, from pairs of
8, 16 and 32 bytes. Ranks are 64-bit names that depend on the string alone, so no round has to number them.

Not every position is ranked but a sample that its content chooses: of the KEY-byte strings in each window of LENGTH bytes, the
one of the least rank is the window's anchor. Equal windows have their anchors at equal offsets, so windows only need comparing
where anchors agree, and a window that repeats is never missed. An anchor stands for the run of windows that chose it; a round
looks at aligned pieces of runs, of 64 windows, then 27, then one: the string that all windows of a piece share, as long as the
round's ranks, is sorted, and the string that they span tells whether whole pieces are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, table
from tessera.llm.words import Ranks, bounds, mix, no_nulls, pair, slices

LENGTH, KEY = 100, 37
SPAN = LENGTH - KEY + 1  # windows that can share an anchor
HALF = LENGTH - 2 * KEY + 1  # windows that share 2 * KEY bytes
#: Bytes ranked at once; longer documents are ranked in overlapping parts.
PART = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)
#: What a task knows of a row: nothing, that it repeats an earlier one of its slice whole, that its rank has several wholes in its
#: slice, or that it is no row but says so of a rank.
COLD, REPEAT, SEVERAL, PROBE = range(4)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors of documents data[off[i]:off[i+1]]: document, anchor's place in it, least and greatest offset of its windows, rank, name of all that they span."""
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    ranks = Ranks(data, 64)
    rank = ranks.of(slice(None), 32, KEY - 32)
    at = np.arange(n - KEY + 1)
    # The least of each 64 in a row, the leftmost on a tie: minima of 2, 4, ... 64.
    least = (rank & ~_PLACE) | at.astype(np.uint64)
    for step in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-step], least[step:])
    windows = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(off[:-1], off[1:], strict=True) if b - a >= LENGTH] or [empty])
    if not len(windows):
        return anchors(data[:0], off[:1])
    anchor = (least[windows] & _PLACE).astype(np.int64)
    head = np.ones(len(windows), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [len(windows)]]) - 1
    place = anchor[first]
    low, high = place - windows[last], place - windows[first]
    whole = ranks.spans(windows[first], windows[last] + LENGTH)
    with np.errstate(over="ignore"):
        whole = mix(whole + (low * SPAN + high).astype(np.uint64))
    doc = np.searchsorted(off, place, "right") - 1
    return doc, place - off[doc], low, high, rank[place], whole


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, byte it starts at, bytes, offsets): slices of rows, or overlapping parts of one long row."""
    for lo, hi in slices(texts, PART):
        data, off = bounds(texts.slice(lo, hi - lo))
        if hi - lo > 1 or len(data) <= 2 * PART:
            yield lo, 0, data, off
        else:
            for a in range(0, len(data) - LENGTH + 1, PART):
                part = data[a : a + PART + LENGTH - 1]
                yield lo, a, part, np.array([0, len(part)])


def _known(name: np.ndarray, whole: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a slice of rows in order tells of them: their sort keys, their states, and the rows that speak for ranks of several wholes.

    A rank may occur in every document there is. So what a slice settles is sorted by keys of its own: a row that repeats one of
    the slice whole by a key that no other has, and rows of a rank with several wholes, which are open whatever other slices
    hold, by rank and whole. For such a rank one row goes to the task that sorts it, and opens what it has of other slices.
    """
    by = np.lexsort((whole, name))
    n, w = name[by], whole[by]
    head, new = np.ones(len(by), bool), np.ones(len(by), bool)
    head[1:] = n[1:] != n[:-1]
    new[1:] = head[1:] | (w[1:] != w[:-1])
    group = np.cumsum(head) - 1
    several = np.bincount(group, weights=new)[group] > 1 if len(by) else head
    state = np.zeros(len(by), np.int8)
    state[by] = np.where(new, np.where(several, SEVERAL, COLD), REPEAT)
    with np.errstate(over="ignore"):
        key = np.where(state == REPEAT, mix(name + mix(row.astype(np.uint64) * np.uint64(2) + np.uint64(1))), np.where(state == SEVERAL, mix(name + mix(whole)), name))
    return key, state, by[head & several]


def _ranked(docs: DataFrame) -> DataFrame:
    """(rank, whole, doc, place, low, high, state): the anchors of all documents, and what their slice tells of them."""
    schema = T.StructType([T.StructField("rank", T.LongType()), T.StructField("whole", T.LongType()), docs.schema["doc"], T.StructField("place", T.LongType()), T.StructField("low", T.ByteType()), T.StructField("high", T.ByteType()), T.StructField("state", T.ByteType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 40
        for b in batches:
            # Documents in the order of their ids, so that the first of equal anchors is the earliest.
            b = b.take(pc.sort_indices(b, sort_keys=[("order", "ascending"), ("tie", "ascending")], null_placement="at_start"))
            texts = no_nulls(b["text"])
            for row, start, data, off in _parts(texts):
                doc, place, low, high, rank, whole = anchors(data, off)
                key, state, probes = _known(rank, whole, seen + np.arange(len(rank)))
                seen += len(rank)
                key, whole, state = np.concatenate([key, rank[probes]]), np.concatenate([whole, np.zeros(len(probes), np.uint64)]), np.concatenate([state, np.full(len(probes), PROBE, np.int8)])
                each = np.concatenate([np.arange(len(doc)), probes])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), b["doc"].take(pa.array(doc[each] + row)), pa.array(place[each] + start), pa.array(low[each].astype(np.int8)), pa.array(high[each].astype(np.int8)), pa.array(state)],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema)


def _settle(rows: DataFrame, *rank: str) -> DataFrame:
    """rows (rank..., whole, doc, place, state, ...) that say something, with ``repeat`` and ``open``.

    A row repeats if one of equal rank and whole is earlier. The earliest is open if its rank has another whole: only parts of
    it may be equal. All else is unique, or the first of equals, and drops out. One sort by rank; groups stream through it.
    """
    earlier = F.row_number().over(Window.partitionBy(*rank, "whole").orderBy("doc", "place")) > 1
    group = Window.partitionBy(*rank)
    rows = rows.repartition(*rank).withColumn("repeat", (F.col("state") == REPEAT) | earlier).withColumn("least", F.min("whole").over(group)).withColumn("most", F.max("whole").over(group))
    said = F.col("repeat") | (F.col("state") == SEVERAL) | (F.col("least") != F.col("most"))
    return rows.where((F.col("state") != PROBE) & said).withColumn("open", ~F.col("repeat")).drop("least", "most", "state")


def _with_bytes(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """The open anchors (doc, place, low, high) with the bytes that their windows span."""
    lists = open_.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("place", "low", "high")).alias("anchors"))
    joined = docs.select("doc", "text").join(lists, F.col("doc").eqNullSafe(F.col("of"))).drop("of")
    schema = T.StructType([f for f in open_.schema if f.name in ("doc", "place", "low", "high")] + [T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = (b["text"][i].as_py() or "").encode()
                own = b["anchors"][i].values
                place, low, high = (own.field(f).to_numpy() for f in ("place", "low", "high"))
                cut = [text[p - h : p - l + LENGTH] for p, l, h in zip(place.tolist(), low.tolist(), high.tolist(), strict=True)]
                columns = {"doc": b["doc"].take(pa.array(np.full(len(cut), i))), "place": own.field("place"), "low": own.field("low"), "high": own.field("high"), "bytes": pa.array(cut, pa.binary())}
                yield pa.RecordBatch.from_arrays([columns[f] for f in schema.names], names=schema.names)

    return joined.mapInArrow(run, schema)


def _finer(rows: DataFrame, size: int) -> DataFrame:
    """Open pieces (doc, place, low, high, bytes) cut into aligned pieces of size windows, with rank and next, a pair of ranks.

    Pieces of HALF windows share 2 * KEY bytes, named by the ranks of their two halves; single windows, of LENGTH bytes, are named
    by two overlapping such pairs. bytes are those that the piece's windows span; they are carried on while pieces have more
    than one window. Where documents have plain ids, a slice tells of its rows what it can.
    """
    keep, plain = size > 1, not isinstance(rows.schema["doc"].dataType, T.StructType)
    names = ["rank", "next", "whole", "doc", "place", "low", "high", "state"] + ["bytes"] * keep
    types = {"rank": T.LongType(), "next": T.LongType(), "whole": T.LongType(), "state": T.ByteType(), "bytes": T.BinaryType()}
    schema = T.StructType([T.StructField(n, types[n]) if n in types else rows.schema[n] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 40
        for b in batches:
            if plain:
                b = b.take(pc.sort_indices(b, sort_keys=[("doc", "ascending"), ("place", "ascending")], null_placement="at_start"))
            for lo, hi in slices(b["bytes"], PART):
                c = b.slice(lo, hi - lo)
                data, off = bounds(c["bytes"])
                low, high = (c[f].to_numpy().astype(np.int64) for f in ("low", "high"))
                count = high // size - low // size + 1
                i = np.repeat(np.arange(len(c)), count)
                piece = low[i] // size + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
                least, most = np.maximum(low[i], piece * size), np.minimum(high[i], piece * size + size - 1)
                at = off[:-1][i] + high[i]  # the anchor's place in the slice's bytes
                shared, ranks = at - piece * size, Ranks(data, 64)  # where the bytes begin that all windows of the piece share
                one = lambda p: ranks.of(p, 32, KEY - 32)
                two = lambda p: pair(one(p), one(p + KEY))
                rank, then = (one(shared), one(shared + KEY)) if keep else (two(shared), two(shared + LENGTH - 2 * KEY))
                with np.errstate(over="ignore"):
                    whole = mix(ranks.spans(at - most, at - least + LENGTH) + (least * SPAN + most).astype(np.uint64))
                state, each = np.zeros(len(i), np.int8), np.arange(len(i))
                if plain:
                    key, state, probes = _known(pair(rank, then), whole, seen + each)
                    seen += len(each)
                    own = state != COLD
                    rank, then = np.concatenate([np.where(own, key, rank), rank[probes]]), np.concatenate([np.where(own, np.uint64(0), then), then[probes]])
                    each, state, whole = np.concatenate([each, probes]), np.concatenate([state, np.full(len(probes), PROBE, np.int8)]), np.concatenate([whole, np.zeros(len(probes), np.uint64)])
                take = pa.array(i[each])
                columns = [pa.array(rank.view(np.int64)), pa.array(then.view(np.int64)), pa.array(whole.view(np.int64)), c["doc"].take(take), c["place"].take(take), pa.array(least[each].astype(np.int8)), pa.array(most[each].astype(np.int8)), pa.array(state)]
                if keep:
                    raw = data.tobytes()
                    columns.append(pa.array([raw[x:y] for x, y in zip((at - most)[each].tolist(), (at - least + LENGTH)[each].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, start, end): the byte ranges of docs (doc, order, tie, text) that repeat an earlier string; they may overlap."""
    spans = lambda d: d.where("repeat").select("doc", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + LENGTH).alias("end"))
    found = scratch.write(_settle(_ranked(docs), "rank"))
    out = spans(found)
    rows = scratch.write(_with_bytes(docs, found.where("open")))
    for size in (HALF, 1):
        found = scratch.write(_settle(_finer(rows, size), "rank", "next"))
        out = out.union(spans(found))
        rows = found.where("open")
    return out


def _cut(docs: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """docs (doc, doc_id, text) with what is left of them: n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept."""
    lists = spans.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = docs.join(lists, F.col("doc").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "spans")
    more = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept", T.BinaryType())] * with_text
    schema = T.StructType([docs.schema["doc_id"], *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in more]
            for text, own in zip(b["text"], b["spans"], strict=True):
                data = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
                raw, n_removed, n_spans, kept, at = memoryview(data), 0, 0, [], 0
                if own.is_valid:
                    start, end = (own.values.field(f).to_numpy() for f in ("start", "end"))
                    order = np.argsort(start, kind="stable")
                    start, reach = start[order], np.maximum.accumulate(end[order])
                    head = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
                    for a, z in zip(start[head].tolist(), reach[np.concatenate([head[1:], [len(start)]]) - 1].tolist(), strict=True):
                        kept.append(raw[at:a])
                        n_removed, n_spans, at = n_removed + z - a, n_spans + 1, z
                kept.append(raw[at:])
                digest = hashlib.sha256()
                for k in kept:
                    digest.update(k)
                for column, value in zip(out, [len(raw), n_removed, n_spans, digest.hexdigest(), b"".join(kept) if with_text else None], strict=False):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(c, t) for c, t in zip(out, [pa.int64()] * 3 + [pa.string(), pa.binary()], strict=False)]], names=schema.names)

    return joined.mapInArrow(run, schema)


def _place(id_col: Column, text: Column, unique: bool) -> Column:
    return id_col if unique else F.struct(id_col.alias("id"), F.xxhash64(text).alias("text"))


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one row per row of docs.

    A byte goes if a string of LENGTH bytes around it also starts earlier: in a document of a smaller id, or before in the
    same one. Null texts are empty and never matched, and texts shorter than LENGTH stay whole. A null id comes before all
    others. Rows that are equal in id and text are one document, and each gets its result; rows of one id with different
    texts are documents in the order of their texts' hashes. Other columns are ignored; an empty table gives no rows.
    """
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    unique = docs.groupBy(key).count().where("count > 1").isEmpty()
    docs = docs.select(_place(key, text, unique).alias("doc"), key.alias("doc_id"), text.alias("text"))
    spans = repeats(docs.select("doc", F.col("doc_id").alias("order"), (F.lit(0) if unique else F.col("doc.text")).alias("tie"), "text").where(F.octet_length("text") >= LENGTH), scratch)
    return _cut(docs, spans, with_text)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "suffix-dedup")
    return remove_repeats(table(spark, sf_dir, "documents"), scratch)


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM d, unnest(range(n - 99)) AS u(p) WHERE n >= 100),
x AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, CASE WHEN p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) + 100 THEN 1 ELSE 0 END AS head FROM x),
r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM (SELECT doc_id, p, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
c AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""
