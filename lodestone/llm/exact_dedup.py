"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["digest", "check", "n_bytes"]
RUN = "part int, node int, entries binary"
DISTINCT = "digest binary, check long, n_bytes long, keep_id long, members long"
ENTRY = np.dtype([("key", "S48"), ("keep_id", "<i8"), ("members", "<i8")])  #: key: digest, check and length in byte order
FAN_BITS = 3  #: binomial rounds between two exchanges: runs of 2**FAN_BITS nodes meet in one task
LEAF_ENTRIES = 500_000  #: entries that a leaf holds before it sends its run
PART_ENTRIES = 250_000  #: rows of a digest range, on average
OUT_ROWS = 20_000  #: entries of an Arrow batch of the result


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest (SHA-256), check (an independent
    hash), n_bytes and copy_no, which numbers rows that repeat both id and text."""
    t = normalised(F.col("text"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t"))
    d = d.select("doc_id", F.unhex(F.sha2(F.col("t"), 256)).alias("digest"), F.xxhash64("t").alias("check"), F.octet_length("t").cast("long").alias("n_bytes"))
    same = Window.partitionBy("doc_id", *KEY).orderBy(F.lit(0))
    return store.save(d.withColumn("copy_no", F.row_number().over(same)), "digests")


def _collapse(run: np.ndarray, best: np.ufunc) -> np.ndarray:
    """A sorted run whose equal entries are one: the id that stays, and how many rows there were."""
    at = np.flatnonzero(np.append(True, run["key"][1:] != run["key"][:-1]))
    out = run[at]
    out["keep_id"], out["members"] = best.reduceat(run["keep_id"], at), np.add.reduceat(run["members"], at)
    return out


def merge(a: np.ndarray, b: np.ndarray, best: np.ufunc) -> np.ndarray:
    """Two sorted runs of distinct entries as one; entries equal in digest, check and length collapse."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a["key"], b["key"])
    same = np.append(a["key"], b"")[at] == b["key"] if len(a) else np.zeros(len(b), bool)
    same &= at < len(a)
    out, hit = a.copy(), at[same]
    out["keep_id"][hit] = best(out["keep_id"][hit], b["keep_id"][same])
    out["members"][hit] += b["members"][same]
    return np.insert(out, at[~same], b[~same])


class Runs:
    """Sorted runs, merged two by two as a binomial heap is: a run of rank r holds
    those of 2**r additions, and two of a rank make one of the next."""

    def __init__(self, best: np.ufunc) -> None:
        self.best, self.by_rank = best, {}

    def add(self, run: np.ndarray) -> None:
        rank = 0
        while rank in self.by_rank:
            run = merge(self.by_rank.pop(rank), run, self.best)
            rank += 1
        self.by_rank[rank] = run

    def size(self) -> int:
        return sum(map(len, self.by_rank.values()))

    def take(self) -> np.ndarray:
        out = np.zeros(0, ENTRY)
        for rank in sorted(self.by_rank):
            out = merge(self.by_rank[rank], out, self.best)
        self.by_rank = {}
        return out


def _entries(batch: pa.RecordBatch, none: int) -> np.ndarray:
    """The rows of a batch as entries, unsorted."""
    out = np.zeros(batch.num_rows, ENTRY)
    raw = out.view(np.uint8).reshape(-1, ENTRY.itemsize)
    raw[:, :32] = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
    for c, at in (("check", 32), ("n_bytes", 40)):
        raw[:, at : at + 8] = batch.column(c).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
    out["keep_id"], out["members"] = batch.column("doc_id").fill_null(none).to_numpy(zero_copy_only=False), 1
    return out


def _cut(run: np.ndarray, node: int, parts: int) -> pa.RecordBatch:
    """A run by digest ranges: one row per range that it has entries of."""
    lead = np.ascontiguousarray(run.view(np.uint8).reshape(-1, ENTRY.itemsize)[:, :4]).view(">u4").ravel().astype(np.uint64)
    part = (lead * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # in order, as the entries are
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    rows = [run[i:j].tobytes() for i, j in zip(at.tolist(), np.append(at[1:], len(run)).tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array([node] * len(rows), pa.int32()), pa.array(rows, pa.binary())], ["part", "node", "entries"])


def _leaf(parts: int, largest: bool):  # noqa: ANN202
    """A partition's sorted run (several, beyond LEAF_ENTRIES distinct texts), by digest ranges."""
    best, none = (np.maximum, -(1 << 63)) if largest else (np.minimum, (1 << 63) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, node = Runs(best), 0
        for b in batches:
            if b.num_rows:
                node = b.column("node")[0].as_py()
                new = _entries(b, none)
                runs.add(_collapse(new[np.argsort(new["key"], kind="stable")], best))
                if runs.size() > LEAF_ENTRIES:
                    yield _cut(runs.take(), node, parts)
        if runs.size():
            yield _cut(runs.take(), node, parts)

    return run


def _merged(batches: Iterator[pa.RecordBatch], best: np.ufunc) -> Iterator[tuple[int, int, np.ndarray]]:
    """(part, node, run) of each group of runs; the groups of a task come one after the other."""
    held, runs = None, Runs(best)
    for b in batches:
        for part, node, entries in zip(b.column("part").to_pylist(), b.column("node").to_pylist(), b.column("entries"), strict=True):
            if held not in (None, (part, node)):
                yield *held, runs.take()
            held = part, node
            runs.add(np.frombuffer(entries.as_buffer(), ENTRY))
    if held is not None:
        yield *held, runs.take()


def _level(largest: bool):  # noqa: ANN202
    """The runs of each node and digest range as one."""
    best = np.maximum if largest else np.minimum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, node, out in _merged(batches, best):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([node], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "node", "entries"])

    return run


def _root(largest: bool):  # noqa: ANN202
    """The last level: a row per distinct text."""
    best = np.maximum if largest else np.minimum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, whole in _merged(batches, best):
            for lo in range(0, len(whole), OUT_ROWS):
                out = whole[lo : lo + OUT_ROWS]
                raw = out.view(np.uint8).reshape(-1, ENTRY.itemsize)
                field = lambda i: pa.array(np.ascontiguousarray(raw[:, i : i + 8]).view(">i8").ravel().astype(np.int64))  # noqa: B023, E731
                digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(out), [None, pa.py_buffer(np.ascontiguousarray(raw[:, :32]))]).cast(pa.binary())
                cols = [digest, field(32), field(40), pa.array(out["keep_id"].copy()), pa.array(out["members"].copy())]
                yield pa.RecordBatch.from_arrays(cols, [*KEY, "keep_id", "members"])

    return run


def groups(d: DataFrame, largest: bool = True) -> DataFrame:
    """(digest, check, n_bytes, keep_id, members): one row per distinct text.

    Leaves are the partitions of the digest table; each sorts its batches and merges
    them to a run in which a digest occurs once, however many copies the partition
    holds. Runs are cut into digest ranges and travel packed, a row per run and range.
    After each exchange the runs of 2**FAN_BITS nodes (node >> FAN_BITS) are in one
    task, which merges them in FAN_BITS binomial rounds without sorting them again;
    equal entries (digest, second hash and length) collapse to the id that stays. So a
    hot text is never more than a run's worth of entries of a range anywhere, and all
    entries of a range are about PART_ENTRIES at most.
    """
    parts = store.width(d.sparkSession, d.count(), PART_ENTRIES)
    nodes = max(1, d.rdd.getNumPartitions())
    runs = d.select("doc_id", *KEY, F.spark_partition_id().alias("node")).mapInArrow(_leaf(parts, largest), RUN)
    while True:
        nodes = -(-nodes >> FAN_BITS)
        up = runs.withColumn("node", F.shiftright("node", FAN_BITS))
        # Every task gets one range of each node.
        up = up.repartitionById(parts, ((F.col("part") + F.col("node")) % parts).cast("int")).sortWithinPartitions("part", "node")
        if nodes <= 1:
            none = -(1 << 63) if largest else (1 << 63) - 1
            out = up.mapInArrow(_root(largest), DISTINCT)
            return out.select(*KEY, F.when(F.col("keep_id") != none, F.col("keep_id")).alias("keep_id"), "members")
        runs = up.mapInArrow(_level(largest), RUN)


def exact_groups(docs: DataFrame, largest: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty.
    The row with the largest doc_id stays (the smallest with largest=False).
    Rows that repeat an id with its text: one of them stays. Rows without an id
    belong to their text's group and stay only if no row of it has an id; of
    several such rows, one stays. An empty table gives an empty result; other
    columns of docs are ignored.
    """
    d = digests(docs)
    out = d.join(groups(d, largest), KEY, "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy_no") == 1)
    return out.select("doc_id", "keep_id", F.col("members").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, largest: bool = True) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Only (id, digest) of rows that go meet the texts: broadcast, if a count finds
    them few. Of rows that repeat an id with its text and stay, one is picked.
    """
    id_, sha, own, doc, one, n = store.unused(docs, "id", "sha", "own", "doc", "one", "n")
    d = digests(docs)
    far = d.join(groups(d, largest).where("members > 1"), KEY)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    far = far.where(~stays | (F.col("copy_no") > 1)).select(F.col("doc_id").alias(id_), F.col("digest").alias(sha), stays.alias(one)).distinct()
    far = store.save(far, "dropped")
    count, again = far.agg(F.count("*"), F.count_if(F.col(one))).first()
    mine = docs.withColumns({own: F.unhex(F.sha2(normalised(F.col("text")), 256)), doc: F.col("doc_id").cast("long")})
    hit = mine.join(F.broadcast(far) if count <= store.BROADCAST_KEYS // 4 else far, F.col(doc).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha)), "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = hit.where(F.col(one).isNull()).select(*names)
    if again:
        first = F.row_number().over(Window.partitionBy(doc, own).orderBy(F.lit(0)))
        out = out.union(hit.where(F.col(one)).withColumn(n, first).where(F.col(n) == 1).select(*names))
    return out
