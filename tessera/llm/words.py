"""Vectorised words, lines and word n-grams of Arrow string batches (words are runs outside ``[\\x20\\x09-\\x0D]``).

Everything is computed on the UTF-8 bytes of a slice of documents at once. Inside a slice, equal strings are found by Arrow's
dictionary encoding, which compares bytes: what is decided within a document is exact. Across slices words are told apart by
64-bit hashes: of two chained states for short words, and BLAKE2b for long ones, so that no regularity of a text makes them collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text that are worked on at once; a longer document is a slice of its own.
SLICE = 1 << 20
#: Words of more bytes than this are hashed one by one.
LONG = 64


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array that hold about limit bytes each."""
    size = np.diff(bounds(texts)[1])
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(size):
        yield at, len(size)


def bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and each row's offsets in them."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], kind, count=len(texts) + 1, offset=texts.offset * np.dtype(kind).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def no_nulls(texts: pa.Array) -> pa.Array:
    return texts.fill_null("") if texts.null_count else texts


def hashes(distinct: pa.Array) -> np.ndarray:
    """64 bits for each of some strings, the same in every task."""
    data, off = bounds(distinct)
    start, size = off[:-1], np.diff(off)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    one, two = mix(size.astype(U64)), mix(~size.astype(U64))
    with np.errstate(over="ignore"):
        for at in range(0, min(int(size.max(initial=0)), LONG), 8):
            i = np.flatnonzero(size > at)
            left = np.minimum(size[i] - at, 8).astype(U64)
            block = eight[start[i] + at] << (U64(64) - left * U64(8))
            one[i], two[i] = mix(one[i] ^ block), mix(two[i] + block * U64(0x9FB21C651E98DF25))
        out = mix(one + (two ^ (two >> U64(31))))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[off[i] : off[i + 1]].tobytes(), digest_size=8).digest(), "little")
    return out


def codes(data: np.ndarray, inside: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers for the strings that start at each start and hold the bytes inside: equal for equal strings, whatever their length.

    Also the distinct strings, in the order of the numbers. inside must be set from each start to the string's end.
    """
    place = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside, dtype=np.int64)])
    body = np.ascontiguousarray(data[inside])
    at = np.append(place[start], len(body))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(body)]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


class Ranks:
    """Ranks of the strings at every position of some bytes, by prefix doubling: the rank of a string of twice the length is that of
    the pair of ranks of its halves. A rank is a 64-bit name that depends on the string alone, so no sort has to number it.
    """

    def __init__(self, data: np.ndarray, longest: int):
        #: By length, the ranks of the strings that start at each position.
        self.at = {8: np.ndarray(max(len(data) - 7, 0), "<u8", np.ascontiguousarray(data), 0, (1,)).astype(U64)}
        n = 8
        while 2 * n <= longest:
            self.at[2 * n] = pair(self.at[n][: max(len(data) - 2 * n + 1, 0)], self.at[n][n:])
            n *= 2

    def of(self, start: np.ndarray | slice, length: int, more: int) -> np.ndarray:
        """Ranks of the strings of length + more bytes (between one and two times length) that start at each start (or at all)."""
        a, b = self.at[length], self.at[8 if more <= 8 else length]
        reach = 8 if more <= 8 else length
        if isinstance(start, slice):
            return pair(a[: max(len(b) - (length + more - reach), 0)], b[length + more - reach :])
        return pair(a[start], b[start + length + more - reach])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ranks of the strings of 64 to 192 bytes from each start to its end: three strings of 64 that cover it, and its length."""
        a, size = self.at[64], end - start
        with np.errstate(over="ignore"):
            return pair(pair(a[start], a[start + (size - 64) // 2]), a[end - 64]) + mix(size.astype(U64))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name for each pair of ranks."""
    with np.errstate(over="ignore"):
        return mix(a * U64(0x9FB21C651E98DF25) + (b ^ (b >> U64(29))))


class Words:
    """The words of a slice of documents in order: numbers that are equal for equal words, and the document each belongs to."""

    def __init__(self, texts: pa.Array, lower: bool):
        data, self.off = bounds(no_nulls(texts))
        self.data = data = _LOWER[data] if lower else data
        self.docs = len(self.off) - 1
        inside = ~_SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = self.off[:-1][self.off[1:] > self.off[:-1]]
        ends = self.off[1:][self.off[1:] > self.off[:-1]] - 1
        first[full], last[ends] = inside[full], inside[ends]
        self.inside = inside
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.off, self.start, "right") - 1
        self.code, self.distinct = codes(data, inside, self.start)
        self._hash = None
        #: Of each document, where its words begin and end.
        self.at = np.searchsorted(self.doc, np.arange(self.docs + 1))

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same in every task."""
        if self._hash is None:
            self._hash = hashes(self.distinct)[self.code] if len(self.code) else np.zeros(0, U64)
        return self._hash

    def _first(self, n: int) -> np.ndarray:
        """The index of the first word of each run of n words inside a document."""
        return np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :]) if len(self.doc) >= n else np.zeros(0, np.int64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """64 bits for each run of n words inside a document, the same in every task, and the index of its first word."""
        first, word = self._first(n), self.hashes()
        total = np.zeros(len(first), U64)
        with np.errstate(over="ignore"):
            for j in range(n):
                total += mix(word[first + j] + U64(j * 0x1000193 + 1))
        return mix(total), first

    def gram_codes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers for the runs of n words inside a document, equal for equal runs of this slice, and the index of their first words."""
        first, count = self._first(n), len(self.distinct)
        out, top = self.code[first], count
        for j in range(1, n):
            if top * count >= 1 << 62:
                _, out = np.unique(out, return_inverse=True)
                top = len(out)
            out, top = out * count + self.code[first + j], top * count
        return out, first


def repeats(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys within documents (in the order of documents): which occur twice or more, and which equal an earlier one."""
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    same = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    often, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    later[order[1:][same]] = True
    return often, later
