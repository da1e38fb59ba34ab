"""Concatenate-and-cut packing of tokenised documents.

Pass one tokenises each scan partition and writes every document's ids with its offset inside the partition. The totals of
the partitions, one row each, are summed up to global offsets. Pass two cuts the running stream of ids at every multiple of
the window; a document that crosses a cut leaves a boundary record, a piece, on either side.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, table
from tessera.llm.words import bounds, no_nulls, slices

WINDOW, END_ID = 4096, 2
#: Bytes of text encoded at once.
SLICE = 3 << 20
VOCABULARY = "word_bpe_49k.json"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _model(path: str):
    """The same vocabulary without normaliser and splitting, for chunks that need neither: half the work."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"], spec["pre_tokenizer"] = None, spec["pre_tokenizer"]["pretokenizers"][-1]
    if spec["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError(f"{path} is not a vocabulary that these chunks are made for")
    return Tokenizer.from_str(json.dumps(spec))


#: Chunks of letters that lower-casing is all there is to do to.
_LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-įıĲ-ſ]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where this machine has the vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache:
    """Ids of the chunks that this worker has met, in one flat array; it starts afresh when it is full."""

    FULL = 400_000

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.model, self.end_id = _tokenizer(path), _model(path), end_id
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.begin, self.flat = np.zeros(1, np.int64), np.full(1, self.end_id, np.uint32)

    @staticmethod
    def _ids(tokenizer, new: list[str]) -> list[list[int]]:
        # Few at a time: an encoding holds much besides its ids.
        return [e.ids for i in range(0, len(new), 2000) for e in tokenizer.encode_batch_fast(new[i : i + 2000], add_special_tokens=False)]

    def places(self, chunks: list[str]) -> np.ndarray:
        """Where each of the (distinct) chunks is kept; place 0 is the end id."""
        if len(self.place) > self.FULL:
            self.clear()
        found = list(map(self.place.get, chunks))
        if missing := [i for i, at in enumerate(found) if at is None]:
            plain = [i for i in missing if _LETTERS.fullmatch(chunks[i])]
            other = [i for i in missing if not _LETTERS.fullmatch(chunks[i])] if len(plain) < len(missing) else []
            ids = self._ids(self.model, [chunks[i].lower() for i in plain]) + self._ids(self.tokenizer, [chunks[i] for i in other])
            missing = plain + other
            new = [chunks[i] for i in missing]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            at = range(len(self.begin), len(self.begin) + len(new))
            self.place.update(zip(new, at, strict=True))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))])
            for i, k in zip(missing, at, strict=True):
                found[i] = k
        return np.array(found, np.int64)


@lru_cache(maxsize=1)
def _cache(path: str, end_id: int) -> _Cache:
    return _Cache(path, end_id)


_KIND = np.full(256, 3, np.uint8)  # letters 1, digits 2, white space 0, all else 3
_KIND[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = 1
_KIND[0x30:0x3A] = 2
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_PLAIN = np.zeros(256, bool)  # ASCII but for the apostrophe, and the bytes of U+00C0 to U+017F
_PLAIN[list(range(0x80)) + list(range(0x80, 0xC0)) + [0xC3, 0xC4, 0xC5]] = True
_PLAIN[ord("'")] = False
_DOWN = np.arange(256, dtype=np.uint8)
_DOWN[0x41:0x5B] += 32


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut into chunks that the vocabulary encodes one by one as it does all at once, and each text's first chunk.

    Its pre-tokeniser parts white space, letters, digits and the rest, and lower-cases. So cuts are made at ASCII white
    space, and in words of plain letters, digits and signs between these kinds. Words with an apostrophe or a character
    outside Latin letters stay whole, as contractions, compositions and other classes of characters may span them.
    """
    data, off = bounds(no_nulls(texts))
    kind = _KIND[data]
    inside = kind > 0
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    full = off[:-1][off[1:] > off[:-1]]
    head[full] = inside[full]
    word = np.cumsum(head, dtype=np.int32)
    odd = ~_PLAIN[data]
    if len(data) > 1:
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the two signs among those letters
        odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)  # lower-cases to a letter and a mark
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))  # may be the name of a special token
    whole = np.zeros(int(word[-1]) + 1 if len(word) else 1, bool)
    whole[word[odd & inside]] = True
    as_is = whole[word] if len(word) else inside
    kind[as_is & inside] = 1
    head[1:] |= inside[1:] & (kind[1:] != kind[:-1]) & ~as_is[1:]
    starts = np.flatnonzero(head)
    body = np.where(as_is, data, _DOWN[data])[inside]
    place = np.cumsum(inside, dtype=np.int32) - inside
    at = np.concatenate([place[starts], [len(body)]]).astype(np.int32)
    out = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body)))
    return out, np.searchsorted(starts, off)


def encode(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each with end_id behind, and the offsets of the texts in them."""
    cut, at = chunks(texts)
    coded = cut.dictionary_encode()
    kept = _cache(path, end_id)
    places = kept.places(coded.dictionary.to_pylist())
    # Each text's chunks, and then place 0, which is just end_id.
    which = np.insert(places[coded.indices.to_numpy()] if len(cut) else np.zeros(0, np.int64), at[1:], 0)
    begin = pa.array(np.concatenate([kept.begin, [len(kept.flat)]]).astype(np.int32))
    taken = pa.ListArray.from_arrays(begin, pa.array(kept.flat)).take(pa.array(which))
    ends = taken.offsets.to_numpy()[1:].astype(np.int64) - taken.offsets[0].as_py()
    last = at[1:] + np.arange(1, len(at)) - 1
    return taken.flatten().to_numpy(), np.concatenate([[0], ends[last]]).astype(np.int64)


def tokenise(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(part, start_in_part, doc_id, doc_tokens, ids): pass one. ids are little-endian unsigned 32-bit numbers in one binary."""
    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("start_in_part", T.LongType()), kept.schema["doc_id"], T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi in slices(b["text"], SLICE):
                ids, off = encode(b["text"].slice(lo, hi - lo), path)
                n = np.diff(off)
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(off * 4), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, part, np.int32)), pa.array(done + off[:-1]), b["doc_id"].slice(lo, hi - lo), pa.array(n), body.cast(pa.binary())],
                    names=["part", "start_in_part", "doc_id", "doc_tokens", "ids"],
                )
                done += int(off[-1])

    return kept.mapInArrow(run, schema)


def pack(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids.

    All sequences but the last are full, so only the last is padded. Null and empty texts are one end id; repeated rows are
    packed as often as they occur, a null id stays null; other columns are ignored; an empty table gives no rows. The order
    of documents is that of the scan, fixed once pass one is written. Memory holds one document's ids at a time.
    """
    coded = scratch.write(tokenise(docs, id_col, text_col, path or vocabulary_path()))
    # One row of 16 bytes for each scan partition, whatever the number of documents: small enough for a window. It is written, so
    # that Spark knows its size when it decides how to join it.
    totals = coded.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    placed = coded.join(scratch.write(before), "part").withColumn("at", F.col("before") + F.col("start_in_part"))
    w = F.lit(window)
    whole = lambda x: F.floor(x / w).cast("bigint")  # noqa: E731  the numbers stay far below 2**53

    def piece(s):
        start = F.greatest(s * w - F.col("at"), F.lit(0))
        length = F.least((s + 1) * w - F.col("at"), F.col("doc_tokens")) - start
        ids = F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), F.crc32(ids).alias("ids_crc32"), s.alias("sequence_id"), (F.col("at") + start - s * w).alias("offset"), ids.alias("ids"))

    pieces = F.transform(F.sequence(whole(F.col("at")), whole(F.col("at") + F.col("doc_tokens") - 1)), piece)
    out = placed.select("doc_id", "doc_tokens", F.explode(pieces).alias("p"))
    return out.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", "p.ids")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    return pack(table(spark, sf_dir, "documents"), scratch).drop("ids")
