"""Phrase collocation mining by hierarchical pair naming.

Texts become sequences of word numbers, a row for each block of documents of one language, each with a dictionary of its own.
Level by level, the ids of adjacent frequent k-grams are replaced by the id of their pair, which names the (k+1)-gram that
the two cover: a task counts the distinct pairs of its blocks, Spark sums them over all tasks in buckets of packed sorted keys, what
reaches the support gets an id, and a join by pair, or where the names are few a look-up, brings the ids back to the blocks that hold them. A phrase is frequent only if both of its ends are, so
nothing is lost on the way up, and what is left of the sequences gets short quickly.

A name's two ids are pointers to the phrase without its last and without its first word. Following the left ones gives every first
part of a cut, the right ones every rest; and a phrase is subsumed by a longer one only if one of those that point to it
is as frequent, so that nothing further away has to be looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table
from tessera.llm.words import bounds, codes, lower, slices

#: Bytes of text in a block. A longer document is a block of its own.
BLOCK = 4 << 20
#: Names of a level are sent to all tasks, which look them up, if they take no more bytes than this; more are joined by key, which
#: Spark splits, so that any number will do.
SENT = 8 << 20
#: Words for each bucket of pairs: no bucket has more pairs than about that to sum, however large the input.
BUCKET = 2 << 20
#: Pairs whose counts a task holds, at most, besides those of one block.
HELD = 2 << 20
_NONE, _SPACE, _CUT = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _SPACE
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _CUT


def _sequence(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The word numbers of some texts in order, -1 between two pieces, and the distinct words by number."""
    data, off = bounds(texts)
    data = lower(data)
    kind = _CLASS[data]
    inside = kind == _NONE
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = off[:-1][off[1:] > off[:-1]]
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    code, distinct = codes(data, inside, start)
    piece = np.cumsum(kind == _CUT, dtype=np.int64)[start] + np.searchsorted(off, start, "right")
    gap = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    return np.insert(code, gap, -1).astype(np.int32), distinct


_BLOCKS = "row bigint, lang string, words array<string>, counts array<bigint>, seq binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """A row for each block of documents (lang, text): its words with their counts, and the sequence of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            langs = b["lang"].dictionary_encode()
            of = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                texts = b["text"].take(pa.array(np.flatnonzero(of == i)))
                for lo, hi in slices(texts, BLOCK):
                    seq, distinct = _sequence(texts.slice(lo, hi - lo))
                    if not len(seq):
                        continue
                    counts = np.bincount(seq[seq >= 0], minlength=len(distinct))
                    end = pa.array([0, len(distinct)], pa.int32())
                    arrays = [pa.array([row], pa.int64()), pa.array([lang], pa.string()), pa.ListArray.from_arrays(end, distinct.cast(pa.string())), pa.ListArray.from_arrays(end, pa.array(counts, pa.int64())), pa.array([_packed(seq + 1)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["row", "lang", "words", "counts", "seq"])
                    row += 1

    return docs.mapInArrow(run, _BLOCKS)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers in few bytes: how many, then compressed all their lowest bytes, all their second ones and so on."""
    planes = np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(of: pa.Scalar) -> np.ndarray:
    held = of.as_buffer()
    n = int.from_bytes(held[:8], "little")
    planes = np.frombuffer(pa.decompress(held[8:], 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


_ROWS = "row bigint, ids binary, seq binary"


def _row(row: pa.Array, seq: np.ndarray, at: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A sequence of local numbers, those in ``at`` having the ids, as a row of its ids in order and the sequence of their places.

    What has no neighbour with an id is left out, with one -1 for each stretch of it. No row if nothing is left.
    """
    place = np.full(max(int(seq.max(initial=0)), int(at.max(initial=0))) + 2, -1, np.int64)  # the last is that of -1
    order = np.argsort(ids)
    place[at[order]] = np.arange(len(at))
    seq = place[seq]
    pair = (seq[:-1] >= 0) & (seq[1:] >= 0)
    if not pair.any():
        return
    near = np.append(pair, False)
    near[1:] |= pair
    keep = near.copy()
    keep[1:] |= near[:-1]
    seq = np.where(near, seq, -1)[keep]
    used = np.bincount(seq[seq >= 0], minlength=len(at)) > 0
    seq = np.where(seq >= 0, (np.cumsum(used) - 1)[seq], -1)
    columns = [_packed(np.diff(ids[order][used], prepend=0)), _packed(seq + 1)]
    yield pa.RecordBatch.from_arrays([row, *[pa.array([x], pa.binary()) for x in columns]], names=["row", "ids", "seq"])


def _adjacent(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of adjacent ids in a row with their counts, and the sequence of the pairs' numbers, -1 between stretches."""
    ids, seq = np.cumsum(_unpacked(b["ids"][i])), _unpacked(b["seq"][i]) - 1
    both = (seq[:-1] >= 0) & (seq[1:] >= 0)
    pairs, local, counts = np.unique(seq[:-1][both] * len(ids) + seq[1:][both], return_inverse=True, return_counts=True)
    out = np.full(len(both), -1, np.int64)
    out[both] = local
    return ids[pairs // len(ids)], ids[pairs % len(ids)], counts, out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def _parts(rows: DataFrame, n: int, buckets: int) -> DataFrame:
    """The counts of adjacent ids below n, in each task a row for each bucket of pairs: their keys' differences in order, and counts.

    A pair's bucket is its sum modulo the number of buckets, so that the pairs of a frequent id are in all of them. In its bucket the
    left id and the quotient of the right one tell which it is. A key is less than n * (n + buckets), so n may be up to 2^31.
    """
    across = -(-n // buckets)

    def dealt(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ends = np.searchsorted(keys, np.arange(buckets + 1) * (n * across))
        there = np.flatnonzero(ends[1:] > ends[:-1])
        parts = [slice(ends[i], ends[i + 1]) for i in there]
        columns = [[_packed(np.diff(keys[x], prepend=i * (n * across))) for i, x in zip(there.tolist(), parts, strict=True)], [_packed(counts[x]) for x in parts]]
        return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *[pa.array(x, pa.binary()) for x in columns]], names=["bucket", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(len(b)):
                left, right, counts, _ = _adjacent(b, i)
                held.append((((left + right) % buckets * n + left) * across + right // buckets, counts))
                size += len(counts)
                if size > HELD:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield dealt(*held.pop())
                        size = 0
        if held:
            yield dealt(*_summed(held))

    return rows.mapInArrow(run, "bucket int, keys binary, counts binary")


def _often(rows: DataFrame, n: int, buckets: int, support: int) -> DataFrame:
    """(left, right, f) of the pairs of adjacent ids below n that rows have ``support`` times."""
    across = -(-n // buckets)

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        keys, f = _summed([(np.cumsum(_unpacked(k)), _unpacked(c)) for k, c in zip(part["keys"], part["counts"], strict=True)])
        left, rest = np.divmod(keys[f >= support], across)
        return pa.table({"left": left, "right": rest * buckets + (key[0].as_py() - left) % buckets, "f": f[f >= support]})

    return _parts(rows, n, buckets).groupBy("bucket").applyInArrow(run, "left bigint, right bigint, f bigint")


def _numbered(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """df, written, with an id from 0 on without gaps, and how many rows it has. The driver gets a number for each task."""
    at = scratch.write(df.withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33).cast("int")
    sizes = dict(at.groupBy(task).count().collect())
    before = np.cumsum([0, *[sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]])
    return at.withColumn("id", F.get(F.lit(before), task) + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at"), int(before[-1])


def _joined(rows: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """The sequences of rows, words of blocks or pairs of adjacent ids, by the ids of names, which are joined to them.

    What is gathered for a row is at most its own dictionary.
    """
    words = on == ["lang", "word"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                left, right, counts, _ = _adjacent(b, i)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), b["row"][i].as_py())), pa.array(np.arange(len(left))), pa.array(left), pa.array(right)], names=["row", "pos", *on])

    local = rows.select("row", "lang", F.posexplode("words").alias("pos", "word")) if words else rows.mapInArrow(listed, "row bigint, pos bigint, left bigint, right bigint")
    ids = local.join(names.select(*on, "id"), on).groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("pos", "id")).alias("ids"))
    held = ["seq"] if words else ["ids", "seq"]
    named = rows.join(ids.select("of", F.col("ids.pos").cast("array<bigint>").alias("at"), F.col("ids.id").alias("named")), F.col("row") == F.col("of")).select("row", *held, "at", "named")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                seq = _unpacked(b["seq"][i]) - 1 if words else _adjacent(b, i)[3]
                yield from _row(b["row"].slice(i, 1), seq, b["at"][i].values.to_numpy(), b["named"][i].values.to_numpy())

    return named.mapInArrow(run, _ROWS)


def _looked_up(rows: DataFrame, names: DataFrame, on: list[str], n: int) -> DataFrame:
    """The same by names that are sent to all tasks, which look up their rows' dictionaries in them: no row has to move. A pair's ids are below n."""
    words = on == ["lang", "word"]
    sent = names.select(*on, "id").toArrow().combine_chunks()
    ids, first, second = sent["id"].to_numpy(), sent[on[0]], sent[on[1]]
    if words:
        langs = first.to_numpy(zero_copy_only=False)
        held = {lang: (second.filter(pc.equal(first, lang)).combine_chunks(), ids[langs == lang]) for lang in set(langs.tolist())}
    else:
        keys = first.to_numpy() * n + second.to_numpy()
        held = np.sort(keys), ids[np.argsort(keys)]
    held = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                if words:
                    known, ids = held.value.get(b["lang"][i].as_py(), (pa.array([], pa.string()), np.zeros(0, np.int64)))
                    place, seq = pc.index_in(b["words"][i].values, value_set=known).fill_null(-1).to_numpy(), _unpacked(b["seq"][i]) - 1
                else:
                    known, ids = held.value
                    left, right, _, seq = _adjacent(b, i)
                    place = _place(known, left * n + right)
                at = np.flatnonzero(place >= 0)
                yield from _row(b["row"].slice(i, 1), seq, at, ids[place[at]])

    return rows.mapInArrow(run, _ROWS)


def _place(known: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where each number is among sorted known ones; -1 for those that aren't."""
    if not len(known):
        return np.full(len(of), -1)
    at = np.minimum(np.searchsorted(known, of), len(known) - 1)
    return np.where(known[at] == of, at, -1)


def mine(docs: DataFrame, scratch: Scratch, longest: int = 5, support: int = 100, within: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, words, phrase, a, l, r, n, score) of each phrase of 2 to ``longest`` words that occurs ``support`` times and isn't subsumed.

    Texts are lower-cased in A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs into words. All is per
    language, null being ``und``. n counts words, a the phrase within pieces, overlaps included. Of its cuts into two parts
    of counts l and r, that of the lowest floor(1000 * a * n / (l * r)) counts, on ties the one with the shortest first part. A
    phrase is subsumed if a longer frequent one that contains it occurs at least ``within`` percent as often.

    Null and empty texts have no words. Repeated rows are counted each. Other columns are ignored, whatever their names. An
    empty table gives no rows. Sums are of longs; a score is computed in decimals of 38 digits, enough for 10^17 words.
    """
    docs = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    blocks = scratch.write(_blocks(docs))
    words = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    total = scratch.write(blocks.groupBy(F.col("lang").alias("of")).agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("n")))
    names = words.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= support)
    none = F.array().cast("array<bigint>")
    names, n = _numbered(names.select("lang", "word", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("firsts"), none.alias("rests")), scratch)
    buckets = max(64, (total.agg(F.sum("n")).first()[0] or 0) // BUCKET)
    rows, on, below, levels = blocks, ["lang", "word"], 0, []
    for _ in range(2, longest + 1):
        last, rows = rows, scratch.write(_looked_up(rows, names, on, below) if scratch.size(names) <= SENT else _joined(rows, names, on))
        scratch.drop(last)
        on, below = ["left", "right"], n
        often, n = _numbered(_often(rows, n, buckets, support), scratch)
        # Each end's counts of its own parts, and its own: what the cuts of the pair need.
        left = names.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.concat("firsts", F.array("f")).alias("firsts"), F.col("f").alias("left_f"))
        right = names.select(F.col("id").alias("right"), "last", F.concat("rests", F.array("f")).alias("rests"), F.col("f").alias("right_f"))
        named = often.join(left, "left").join(right, "right")
        names = scratch.write(named.select("id", "lang", "left", "right", "f", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "firsts", "rests", "left_f", "right_f"))
        levels.append(names)
    found = None
    for i, level in enumerate(levels):
        if i + 1 < len(levels):
            longer = levels[i + 1]
            as_often = lambda end: longer.where(100 * F.col("f") >= within * F.col(f"{end}_f")).select(F.col(end).alias("id"))  # noqa: B023, E731
            level = level.join(as_often("left").union(as_often("right")).distinct(), "id", "left_anti")
        level = level.select("lang", F.lit(i + 2).alias("words"), "phrase", F.col("f").alias("a"), "firsts", "rests")
        found = level if found is None else found.union(level)
    cuts = F.transform(F.arrays_zip("firsts", F.reverse("rests").alias("rests")), lambda x, k: F.struct(_score(F.col("a"), F.col("n"), x["firsts"], x["rests"]).alias("score"), k.alias("k"), x["firsts"].alias("l"), x["rests"].alias("r")))
    found = found.join(total, F.col("lang") == F.col("of")).withColumn("cut", F.array_min(cuts))
    return found.select("lang", "words", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exactly."""
    wide = lambda x, digits: x.cast(f"decimal({digits},0)")
    return F.call_function("div", wide(F.lit(1000) * wide(a, 19), 19) * wide(n, 18), wide(left, 19) * wide(right, 18))


def top(phrases: DataFrame, most: int = 2000) -> DataFrame:
    """Each language's first ``most`` phrases by score, count and, in the order of UTF-8 bytes, words; rank counts from 1.

    Tasks drop what is behind their own first ones before anything is shuffled, so no task gets all phrases of a language.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return phrases.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("bigint"))


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "phrases")
    return top(mine(table(spark, sf_dir, "documents"), scratch)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.k, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, n.n, (1000 * c.f * n.n) // (x.f * y.f) AS score
        FROM c JOIN n USING (lang), range(1, 5) AS t(j), f x, f y
        WHERE j < c.k AND x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(c.w[1:j], ' ') AND y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT DISTINCT c.lang, array_to_string(c.w[i:i + m - 1], ' ') AS phrase, c.f AS longer FROM c, range(2, 5) AS t(m), range(1, 5) AS u(i) WHERE m < c.k AND i + m - 1 <= c.k),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.longer >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
