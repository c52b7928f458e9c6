"""Repeated passages by a sparse suffix array.

Suffixes start at words. Only those at content-selected positions are retained:
a position whose SEED-word hash is least within some WINDOW consecutive
positions (a minimiser), so equal passages retain equal positions. Any passage
of MIN_WORDS words has such a position among its first WINDOW; its suffix then
shares at least PREFIX = MIN_WORDS - WINDOW + 1 words with the suffix in every
copy of the passage.

The retained suffixes are ordered by their first PREFIX words; those with an
equal neighbour are candidates. Around them the passages are extended left and
right: a window of MIN_WORDS words whose start lies at most WINDOW - 1 words
before a candidate is compared with its neighbours in the order of windows, and
maximal runs of repeated windows are the spans. So every occurrence of every
passage of MIN_WORDS words that occurs twice is found, and nothing else.

The order is that of a 64-bit hash of the words, and neighbours count as equal only
if a second hash, made of other numbers, agrees as well (128 bits together).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .text import U64, Words, hash_windows, mix, slices

MIN_WORDS, WINDOW, SEED = 50, 24, 5
SHARD_SUFFIXES = 2_000_000  #: suffixes or windows that one task sorts, on average


def minimisers(h: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least hash of some window of consecutive positions
    of a document (the first one of equals); h has one hash per word."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64)
    # Least position of each window by doubling: (hash, position) pairs as one order.
    at = np.arange(n)
    width = 1
    best = at.copy()
    while width * 2 <= window:
        a, b = best[: len(best) - width], best[width:]
        best = np.where(h[b] < h[a], b, a)
        width *= 2
    if width < window:
        gap = window - width
        a, b = best[: len(best) - gap], best[gap:]
        best = np.where(h[b] < h[a], b, a)
    doc_end = np.repeat(first[1:], np.diff(first))
    whole = at[: len(best)] + window <= doc_end[: len(best)]
    return np.unique(best[whole])


PACKED = "shard int, keys binary, checks binary, docs binary, places binary"


def check(w: Words, n: int) -> np.ndarray:
    """A second hash of the n words from each word on."""
    return mix(hash_windows(w.sums, n))


def _pack(key: np.ndarray, other: np.ndarray, doc: np.ndarray, place: np.ndarray, shards: int) -> pa.RecordBatch:
    """Entries by the shard of their key (its top bits). Of entries with equal keys
    only the first is sent; all of them are known to be repeated and travel
    without a key. So a hot passage is one entry from a slice of text."""
    order = np.lexsort((other, key))
    key, other, doc, place = key[order], other[order], doc[order], place[order].astype(np.int32)
    same = (key[1:] == key[:-1]) & (other[1:] == other[:-1])
    lead, known = np.append(True, ~same)[: len(key)], np.append(False, same)[: len(key)] | np.append(same, False)[: len(key)]
    rows: list[tuple[int, bytes, bytes, bytes, bytes]] = []
    for k, c, d, p, shard in (
        (key[lead], other[lead], doc[lead], place[lead], (key[lead] >> U64(40)) * U64(shards) >> U64(24)),
        (key[:0], other[:0], doc[known], place[known], mix(doc[known].astype(U64)) % U64(shards)),
    ):
        by = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[by], np.arange(shards + 1).astype(U64))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            at = by[cut[s] : cut[s + 1]]
            rows.append((s, *((x[at].tobytes() if len(x) else b"") for x in (k, c, d, p))))
    cols = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["shard", "keys", "checks", "docs", "places"])


def _suffixes(shards: int, least: int, window: int, seed: int):  # noqa: ANN202
    prefix = least - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, "text"):
                ids = rows.column("row").to_numpy(zero_copy_only=False)
                w = Words(data, off)
                grams, _ = w.windows(min(seed, prefix))
                at = minimisers(mix(grams), w.first, window)
                key, whole = w.windows(prefix)
                at = at[whole[at]]
                doc = np.searchsorted(w.first, at, "right") - 1
                yield _pack(key[at], check(w, prefix)[at], ids[doc], at - w.first[doc], shards)

    return run


def _arrays(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    parts = [(np.frombuffer(d.as_buffer(), np.int64), np.frombuffer(p.as_buffer(), np.int32)) for b in batches for d, p in zip(b.column(names[0]), b.column(names[1]), strict=True)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int32)]


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: its places, in order."""
    doc, place = _arrays(batches, "docs", "places")
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(start[1:], len(doc))
    for lo in range(0, len(start), 20_000):
        s, e = start[lo : lo + 20_000], ends[lo : lo + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array([place[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())], ["row", "places"])


def _repeated(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Sorts a shard's entries; those equal to a neighbour, packed by the shard of their document."""
    keys, checks, docs, places, known, known_at = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [], []
    for b in batches:
        for k, c, d, p in zip(*(b.column(x) for x in ("keys", "checks", "docs", "places")), strict=True):
            if len(k.as_buffer()):
                keys.append(np.frombuffer(k.as_buffer(), U64))
                checks.append(np.frombuffer(c.as_buffer(), U64))
            (docs if len(k.as_buffer()) else known).append(np.frombuffer(d.as_buffer(), np.int64))
            (places if len(k.as_buffer()) else known_at).append(np.frombuffer(p.as_buffer(), np.int32))
    key, other, doc, place = np.concatenate(keys), np.concatenate(checks), np.concatenate(docs), np.concatenate(places)
    del keys, checks, docs, places
    order = np.argsort(key)
    tie = np.append(False, key[order][1:] == key[order][:-1])
    if (tie[1:] & (other[order][1:] != other[order][:-1])).any():  # entries of one key by the second hash
        order = np.lexsort((other, key))
    same = (key[order][1:] == key[order][:-1]) & (other[order][1:] == other[order][:-1])
    twice = order[(np.append(False, same) | np.append(same, False))[: len(key)]]
    doc, place = np.concatenate([doc[twice], *known]), np.concatenate([place[twice], *known_at])
    shard = mix(doc.astype(U64)) % U64(shards)
    by = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[by], np.arange(shards + 1).astype(U64))
    full = np.flatnonzero(np.diff(cut)).tolist()
    part = lambda x: pa.array([x[by[cut[s] : cut[s + 1]]].tobytes() for s in full], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), part(doc), part(place)], ["shard", "docs", "places"])


def _windows(shards: int, least: int, window: int):  # noqa: ANN202
    """The windows that may be repeated: those that start at most window - 1
    words before one of their document's candidate places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, "text"):
                ids = rows.column("row").to_numpy(zero_copy_only=False)
                w = Words(data, off)
                key, whole = w.windows(least)
                mark = np.zeros(len(w) + 1, np.int64)
                for i, x in enumerate(rows.column("places")):
                    at = np.frombuffer(x.as_buffer(), np.int32) + w.first[i]
                    at = at[at < w.first[i + 1]]
                    np.add.at(mark, np.maximum(at - window + 1, w.first[i]), 1)
                    np.add.at(mark, at + 1, -1)
                at = np.flatnonzero((np.cumsum(mark)[:-1] > 0) & whole)
                doc = np.searchsorted(w.first, at, "right") - 1
                yield _pack(key[at], check(w, least)[at], ids[doc], at - w.first[doc], shards)

    return run


def _spans(least: int):  # noqa: ANN202
    """A document's repeated windows, merged to spans [start, end) of words, with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, "text"):
                w = Words(data, off, hashes=False)
                out: list[tuple] = []
                for i, (doc, x) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("places"), strict=True)):
                    at = np.unique(np.frombuffer(x.as_buffer(), np.int32))
                    at = at[at + least <= w.first[i + 1] - w.first[i]]
                    new = np.flatnonzero(np.append(True, at[1:] > at[:-1] + least))
                    for s, e in zip(at[new].tolist(), at[np.append(new[1:], len(at)) - 1].tolist(), strict=True):
                        a, b = w.first[i] + s, w.first[i] + e + least - 1
                        out.append((doc, s, e + least, data[w.starts[a] : w.ends[b]].tobytes().decode("utf-8", "replace")))
                cols = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], ["doc_id", "start_word", "end_word", "passage"])

    return run


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per maximal span of words that is covered by passages of at least
    `least` words that occur elsewhere in the table (in another document, or
    elsewhere in the same): doc_id, start_word, end_word (excluded), n_words,
    passage. Spans that touch or overlap are one.

    Words are compared after lower-casing A-Z. Null, empty and short texts have
    no spans. Rows that repeat an id are rows of their own, also with other texts;
    each yields its spans. Rows without an id are left out.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.where("doc_id is not null").select(store.row_key(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    bytes_ = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = store.width(spark, bytes_ / 6 * 2 / (window + 1), SHARD_SUFFIXES)
    kept = d.mapInArrow(_suffixes(shards, least, window, seed), PACKED).repartitionById(shards, "shard")

    def places(packed: DataFrame) -> DataFrame:
        n = shards
        found = packed.mapInArrow(lambda batches: _repeated(batches, n), "shard int, docs binary, places binary")
        return found.repartitionById(n, "shard").select("docs", "places").mapInArrow(_by_document, "row long, places binary")

    near = store.save(d.join(places(kept), "row"), "regions")
    n = near.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = store.width(spark, n / 6, SHARD_SUFFIXES)
    again = near.mapInArrow(_windows(shards, least, window), PACKED).repartitionById(shards, "shard")
    own = near.select("row", "doc_id", "text").join(places(again), "row")
    spans = own.select("doc_id", "text", "places").mapInArrow(_spans(least), "doc_id long, start_word int, end_word int, passage string")
    return spans.withColumn("n_words", F.col("end_word") - F.col("start_word")).select("doc_id", "start_word", "end_word", "n_words", "passage")
