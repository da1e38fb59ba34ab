"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to k errors. It is split into k + 1 pieces, so an occurrence within the budget
holds at least one piece unchanged. All pieces are found in one pass of a multi-string search over each document; around
the hits, Myers' bit-parallel algorithm computes the least edit distance of the item to any substring.

The items are the stated query set: they are dealt into blocks of bounded size in the shared folder, and each block meets all
documents. Tasks read the block themselves; no item goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import Scratch, table

#: Errors allowed for each hundred characters of an item.
ERRORS_PER_100 = 5
#: Items are dealt into blocks of about this many characters: what a task holds is bounded, however many items there are.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    """Lower case, and each run of white space one space: what matching works on."""
    return " ".join(text.lower().split())


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 ranges of nearly equal length that cut up m characters."""
    at = [m * i // (k + 1) for i in range(k + 2)]
    return list(zip(at, at[1:], strict=False))


def least_distance(item: str, text: str, most: int) -> int | None:
    """The least edit distance of item to a substring of text, or None if it is over most (Myers 1999, on one long integer)."""
    m, peq = len(item), {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        score += bool(up & last) - bool(down & last)
        # No carry into the lowest bit: an occurrence may start anywhere.
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if score < best:
            best = score
            if not best:
                return 0
    return best if best <= most else None


@lru_cache(maxsize=1)
def _block(folder: str, per_100: int):
    """The items (id, normal text) of a folder of the shared one, and what finds their pieces; a worker holds one block at a time."""
    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return (), None
    rows = dataset.dataset(path, filesystem=store, format="parquet", partitioning=None).to_table(columns=["item_id", "text"]).to_pylist()
    block = tuple((r["item_id"], text) for r in rows if (text := normal(r["text"] or "")))
    return block, _searcher(block, per_100) if block else None


def _searcher(block: tuple[tuple[object, str], ...], per_100: int):
    import ahocorasick

    where: dict[str, list[tuple[int, int, int]]] = {}
    for i, (_, text) in enumerate(block):
        for a, b in pieces(len(text), len(text) * per_100 // 100):
            where.setdefault(text[a:b], []).append((i, a, b))
    found = ahocorasick.Automaton()
    for piece, at in where.items():
        found.add_word(piece, at)
    found.make_automaton()
    return found


def matches(text: str, block: tuple[tuple[object, str], ...], per_100: int = ERRORS_PER_100, searcher=None) -> dict[int, int]:
    """Index in the block to least distance, for the items that occur in a (normal) text within their budget."""
    near: dict[int, list[tuple[int, int]]] = {}
    for end, at in (searcher or _searcher(block, per_100)).iter(text):
        for i, _, b in at:
            m = len(block[i][1])
            k, start = m * per_100 // 100, end + 1 - b
            spans = near.setdefault(i, [])
            # Hits come by their ends, so windows that overlap meet here: each stretch of text is scanned once for an item.
            lo, hi = max(0, start - k), start + m + k
            if spans and lo <= spans[-1][1]:
                lo, hi = min(lo, spans[-1][0]), max(hi, spans[-1][1])
                spans.pop()
            spans.append((lo, hi))
    out = {}
    for i, spans in near.items():
        item = block[i][1]
        best = [d for lo, hi in spans if (d := least_distance(item, text[lo:hi], len(item) * per_100 // 100)) is not None]
        if best:
            out[i] = min(best)
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", per_100: int = ERRORS_PER_100, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id, distance, budget): the items found in each document, with the least number of errors.

    Null and empty texts, of documents or items, match nothing. Rows of a null id are reported with a null id; repeated rows
    are matched each. Other columns are ignored. Without documents or items there are no rows. Documents aren't shuffled; a task
    holds one block of items and one batch of documents, and the driver the blocks' number.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], items.schema["item_id"], T.StructField("distance", T.LongType()), T.StructField("budget", T.LongType())])
    item_type = to_arrow_type(schema["item_id"].dataType)
    scratch = scratch or Scratch(docs.sparkSession, "decontamination")
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = chars // BLOCK_CHARS + 1
    dealt = scratch.write(items.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(n))).repartition("block"), by="block")
    # No rows, but a reader of the blocks: they are kept as long as the result is.
    out = dealt.where("false").select(F.lit(None).cast(schema["doc_id"].dataType).alias("doc_id"), "item_id", F.lit(0).cast("bigint").alias("distance"), F.lit(0).cast("bigint").alias("budget"))
    for i in range(n if chars else 0):

        def run(batches: Iterator[pa.RecordBatch], folder=f"{dealt._scratch_path}/block={i}") -> Iterator[pa.RecordBatch]:
            block, searcher = _block(folder, per_100)
            for b in batches:
                ids, which, distance = [], [], []
                for row, text in enumerate(b["text"] if block else ()):
                    if text.is_valid:
                        for i, d in sorted(matches(normal(text.as_py()), block, per_100, searcher).items()):
                            ids.append(row)
                            which.append(i)
                            distance.append(d)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(pa.array(ids, pa.int64())), pa.array([block[i][0] for i in which], item_type), pa.array(distance, pa.int64()), pa.array([len(block[i][1]) * per_100 // 100 for i in which], pa.int64())],
                    names=["doc_id", "item_id", "distance", "budget"],
                )

        out = out.union(docs.where(F.col("text").isNotNull()).mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose id has no match. Rows of a null id are kept."""
    found = scratch.write(contaminated(docs, items, id_col, text_col, scratch=scratch).select("doc_id").distinct())
    return docs.join(found, docs[f"`{id_col}`"] == found["doc_id"], "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
