"""Vectorised words and word-window hashes over Arrow string columns.

Everything works on the raw UTF-8 bytes of a whole slice of a column at once:
there is no Python object per document or per word. A word is
``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2 << 20  #: text that is held as arrays at once; a longer text is a slice of its own

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_M = 0x2545F4914F6CDD1D
_M_INV = pow(_M, -1, 1 << 64)
_OTHER = 0xD1342543DE82EF95
_OTHER_INV = pow(_OTHER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * SLICE_BYTES + 1:
            _powers[base] = have
    return have[:n]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows of at most size bytes of text (or one
    row) and at most 65,536 rows, which a run's index of 16 bits can tell apart."""
    i = batch.schema.get_field_index(column)
    col = batch.column(i).fill_null("").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = min(at + (1 << 16), max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1))
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _M, inverse: int = _M_INV) -> np.ndarray:
    """A 64-bit hash of each span of bytes, lower-casing A-Z."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[LOWER[data]] * _pow(base, len(data)), out=total[1:], dtype=U64)
    return mix((total[ends] - total[starts]) * _pow(inverse, len(data) + 1)[starts])


def hash_windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n values from each position on, as if zeros followed the last."""
    h = np.concatenate([h, np.zeros(n, U64)])
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * _pow(_M, len(h)), out=total[1:], dtype=U64)
    at = np.arange(len(h) - n)
    return mix((total[at + n] - total[at]) * _pow(_M_INV, len(h))[at] + U64(n))


class Words:
    """The words of consecutive documents.

    starts, ends: byte positions of each word; first: for document d its words
    are first[d]:first[d+1]; h: a 64-bit hash of each lower-cased word.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, hashes: bool = True) -> None:
        inside = ~_SPACE[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        some = off[:-1][off[1:] > off[:-1]]
        begin[some] = inside[some]
        last = off[1:][off[1:] > off[:-1]] - 1
        end[last] = inside[last]
        self.data, self.off = data, off
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, off)
        if hashes:
            self.h = hash_spans(data, self.starts, self.ends)

    @property
    def sums(self) -> np.ndarray:
        """A second number of each word: its bytes, as digits of another base."""
        return hash_spans(self.data, self.starts, self.ends, _OTHER, _OTHER_INV)

    def __len__(self) -> int:
        return len(self.starts)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they end in its document."""
        at = np.arange(len(self))
        return hash_windows(self.h, n), at + n <= np.repeat(self.first[1:], np.diff(self.first))


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each document, as sorted 64-bit hashes.

    Returns (hashes, first): document d has hashes[first[d]:first[d+1]]. With
    1 to n-1 words the whole sequence is the only shingle; without words the
    set is empty.
    """
    count = np.diff(words.first)
    h, whole = words.windows(n)
    doc = words.docs()
    h, doc = h[whole], doc[whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), U64)
        for k in range(1, n):
            own = short[count[short] == k]
            if len(own):
                hk, _ = words.windows(k)
                extra[count[short] == k] = hk[words.first[own]]
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
    order = np.argsort(h)
    kind = np.uint16 if len(count) < 1 << 16 else np.int64
    order = order[np.argsort(doc[order].astype(kind), kind="stable")]
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(count) + 1))


_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def cores(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words without the ASCII punctuation around them: (which words have something
    left, starts, ends, first), first as in Words."""
    at = np.arange(len(words.data), dtype=np.int32 if len(words.data) < 1 << 31 else np.int64)
    punct = _PUNCT[words.data]
    after = np.minimum.accumulate(np.where(punct, at.dtype.type(len(at)), at)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(punct, at.dtype.type(-1), at))
    starts = after[words.starts] if len(words) else words.starts
    some = np.flatnonzero(starts < words.ends)
    return some, starts[some].astype(np.int64), before[words.ends[some] - 1].astype(np.int64) + 1, np.searchsorted(some, words.first)
