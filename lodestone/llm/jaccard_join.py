"""Similarity join on word shingles by parity sketches.

A document's set A of shingle hashes is folded into a parity sketch: every
token flips one bit, so the bits in which two sketches differ are at most
|A xor B|. The sketch is very wide and kept as K blocks of 64-bit fingerprints
(the XOR of the tokens that fall into a block): a token changes one block, so
two sketches differ in at most |A xor B| blocks.

Sizes are cut into bands so that similar sets lie in the same or in adjacent
bands. Scheme j holds bands j and j + 1 and knows the largest symmetric
difference k of a similar pair there. With K = k + 1 + e blocks, such a pair
agrees on at least e + 1 blocks (pigeonhole), so it shares a block that is not
weak unless all those are weak. A weak block holds fewer tokens than WEAK; this
depends on its content only. A set with more than e weak blocks also takes
part with the next seed, as would its partner, up to SEEDS times; at the last
seed weak blocks count too. So weak blocks, which unrelated sets share, are
never join keys and no pair is lost.

Shared blocks only name candidates: links are verified on the whole sets. Where a
slice of text holds a block HOT times or more, one entry stands for them in the
exchange; its members join the block's group by a number made from the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .graph import components
from .text import U64, Words, mix, shingle_sets, slices

SEEDS = 6
KEY_BYTES = 5  #: kept of a key within its shard; a chance likeness only adds a candidate
SHARD_KEYS = 1_500_000  #: block keys that one task sorts, on average
HOT = 8  #: members of a block in a slice of text from which on one entry is sent for them
BLOCK = 4096  #: members of a group on each side of a comparison in one task
BLOCK_BYTES = 48 << 20  #: of their sets, on each side

SET_ROWS = 500  #: rows with a set or a sketch in an Arrow batch

_bands: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def bands(num: int, den: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least size, blocks, weak blocks allowed, weak limit) of each scheme, for sizes up to top."""
    top = 1 << top.bit_length()
    if (num, den, top) in _bands:
        return _bands[num, den, top]
    low = [1, max(2, den // num + 1)]
    while low[-1] <= top * den // num + 1:
        low.append(max(low[-1] + 1, den * (low[-1] - 1) // num + 1))
    low.append(max(low[-1] + 1, den * (low[-1] - 1) // num + 1))
    k, e, weak = [], [], []
    for j in range(len(low) - 2):
        a = low[j + 1] - 1
        b = min(low[j + 2] - 1, den * a // num)
        k.append((den - num) * (a + b) // (den + num))
        e.append(0 if not k[-1] else 1 + k[-1] // 10)
        # Blocks of one token are weak, too, if a typical set then has at most e weak blocks.
        many, load = k[-1] + 1 + e[-1], 1.1 * low[j] / (k[-1] + 1 + e[-1])
        few = many * np.exp(-load) * (1 + load)
        weak.append(2 if few + 2 * np.sqrt(few) <= e[-1] else 1)
    _bands[num, den, top] = np.array(low), np.array(k) + 1 + np.array(e), np.array(e), np.array(weak)
    return _bands[num, den, top]


def block_keys(h: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) of all blocks that are join keys; h is sorted within a document."""
    size = np.diff(first)
    keys, docs = [], []
    if not len(h):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    low, blocks, slack, weak = bands(num, den, int(size.max()))
    band = np.searchsorted(low, size, "right") - 1
    for down in (0, 1):
        scheme = band - down
        use = np.flatnonzero((size > 0) & (scheme >= 0))
        for seed in range(SEEDS):
            if not len(use):
                break
            tok = np.repeat(first[use], size[use]) + np.arange(size[use].sum()) - np.repeat(np.cumsum(size[use]) - size[use], size[use])
            t, own = h[tok], np.repeat(np.arange(len(use)), size[use])
            if seed:  # other blocks: the order within a document changes
                t = mix(t + U64(seed))
                order = np.lexsort((t, own))
                t = t[order]
            K = blocks[scheme[use]]
            at = ((t >> U64(32)) * K[own].astype(U64) >> U64(32)).astype(np.int64)
            new = np.ones(len(t), bool)
            new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, len(t)))
            whose, block = own[start], at[start]
            s = scheme[use][whose]
            last = seed == SEEDS - 1
            strong = n >= (1 if last else weak[s])
            key = np.bitwise_xor.reduceat(mix(t), start)
            key = mix(key + mix((s * 1_000_003 + block + 1).astype(U64)) * U64(2 * seed + 1))
            keys.append(key[strong])
            docs.append(use[whose[strong]])
            n_strong = np.bincount(whose[strong], minlength=len(use))
            bad = K - n_strong > slack[scheme[use]]
            if last and bad.any():  # empty blocks are keys, too
                K0, s0 = K[bad], scheme[use][bad]
                r = np.repeat(np.flatnonzero(bad), K0)
                i = np.arange(K0.sum()) - np.repeat(np.cumsum(K0) - K0, K0)
                full = set(zip(whose.tolist(), block.tolist(), strict=True))
                empty = np.array([(x, y) not in full for x, y in zip(r.tolist(), i.tolist(), strict=True)], bool)
                keys.append(mix(mix((np.repeat(s0, K0)[empty] * 1_000_003 + i[empty] + 1).astype(U64)) * U64(2 * seed + 1)))
                docs.append(use[r[empty]])
            use = use[bad]
    return np.concatenate(keys), np.concatenate(docs)


SKETCH = "shard int, ids binary, names binary, sizes binary, reps binary, keys binary, bits binary, fresh binary"
MEMBERS, PAIRS, GROUPS = -1, -2, -3  #: shards of rows that are not block keys


def sketch_bits(size: np.ndarray) -> np.ndarray:
    """Bits of the dense parity sketch of sets: a power of two, at least their size."""
    return 1 << np.maximum(8, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))


def dense(h: np.ndarray, first: np.ndarray) -> bytes:
    """The dense parity sketches of sets, one after the other: each token flips a bit."""
    size = np.diff(first)
    bits = sketch_bits(size)
    at = np.append(0, np.cumsum(bits))
    pos = (mix(h + U64(5)) & np.repeat(bits - 1, size).astype(U64)).astype(np.int64) + np.repeat(at[:-1], size)
    return np.packbits((np.bincount(pos, minlength=at[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(x: np.ndarray, words: int) -> np.ndarray:
    """A sketch (rows of 64-bit words) as if it had fewer bits."""
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _pack_ids(table: np.ndarray, at: np.ndarray) -> bytes:
    """table[at], as 16-bit places in the table where that is shorter."""
    if 8 * len(table) + 2 * len(at) < 8 * len(at):
        return len(table).to_bytes(4, "little") + table.tobytes() + at.astype(np.uint16).tobytes()
    return bytes(4) + table[at].tobytes()


def _unpack_ids(body: bytes) -> np.ndarray:
    n = int.from_bytes(body[:4], "little")
    if not n:
        return np.frombuffer(body, np.int64, offset=4)
    return np.frombuffer(body, np.int64, n, 4)[np.frombuffer(body, np.uint16, offset=4 + 8 * n)]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _group(shard: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The number of a block's group, from what a shard knows of its key."""
    return mix(mix(shard.astype(U64)) + key).view(np.int64)


def _sketches(n: int, num: int, den: int, shards: int, hot: int):  # noqa: ANN202
    """Rows of whole slices of a partition. Shard MEMBERS has each row's number,
    id, set size and representative; shards from 0 on have (key, row) of the
    blocks. Blocks that a slice holds often are one entry there (with fresh), and
    their rows are in PAIRS with the least of them and in GROUPS by the key.

    Of equal sets in a partition, the smallest number stands for all, so a hot copy
    sends its blocks once from a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for rows, data, off in slices(batch, "text"):
                ids, names = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "doc_id"))
                h, first = shingle_sets(Words(data, off), n)
                size = np.diff(first)
                some = np.flatnonzero(size)
                a, b = np.zeros(len(size), U64), np.zeros(len(size), U64)
                if len(some):
                    a[some], b[some] = np.add.reduceat(mix(h), first[some]), np.bitwise_xor.reduceat(mix(h + U64(77)), first[some])
                reps, fresh = ids.copy(), size > 0
                for i in some.tolist():
                    key = (int(size[i]), int(a[i]), int(b[i]))
                    was = seen.setdefault(key, int(ids[i]))
                    if was != ids[i]:
                        reps[i], fresh[i] = was, False
                pick = np.flatnonzero(fresh)
                tok = np.repeat(fresh, size)
                own = np.append(0, np.cumsum(size[pick]))
                keys, doc = block_keys(h[tok], own, num, den)
                out: list[dict] = [{"shard": MEMBERS, "ids": ids.tobytes(), "names": names.tobytes(), "sizes": size.astype(np.int64).tobytes(), "reps": reps.tobytes(), "bits": dense(h[tok], own), "fresh": fresh.tobytes()}]
                # The scheme of a row is fixed by its size; a key's top bits choose the shard.
                shard = ((keys >> U64(40)) * U64(shards) >> U64(24)).astype(np.int32)
                keys &= U64((1 << 8 * KEY_BYTES) - 1)
                order = np.lexsort((keys, shard))
                keys, doc, shard = keys[order], doc[order], shard[order]
                start = _starts(shard, keys) if len(keys) else np.zeros(0, np.int64)
                many = np.diff(np.append(start, len(keys)))
                often = np.repeat(many >= hot, many)
                if often.any():
                    at = start[many >= hot]
                    member, runs = ids[pick][doc[often]], many[many >= hot]
                    begin = np.cumsum(runs) - runs
                    least = np.minimum.reduceat(member, begin)
                    pair = np.unique(np.stack([member, np.repeat(least, runs)])[:, member != np.repeat(least, runs)], axis=1)
                    out.append({"shard": PAIRS, "ids": pair[0].tobytes(), "reps": pair[1].tobytes()})
                    out.append({"shard": GROUPS, "ids": member.tobytes(), "reps": np.repeat(_group(shard[at], keys[at]), runs).tobytes()})
                    cut = np.searchsorted(shard[at], np.arange(shards + 1))
                    raw = keys[at].view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                    out += [{"shard": int(s), "ids": _pack_ids(least, np.arange(cut[s], cut[s + 1])), "keys": raw[cut[s] : cut[s + 1]].tobytes(), "fresh": b"1"} for s in np.flatnonzero(np.diff(cut))]
                    keys, doc, shard = keys[~often], doc[~often], shard[~often]
                raw = keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                cut = np.searchsorted(shard, np.arange(shards + 1))
                out += [{"shard": int(s), "ids": _pack_ids(ids[pick], doc[cut[s] : cut[s + 1]]), "keys": raw[cut[s] : cut[s + 1]].tobytes()} for s in np.flatnonzero(np.diff(cut))]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], pa.int32() if c == "shard" else pa.binary()) for c in _SKETCH_COLUMNS], _SKETCH_COLUMNS)

    return run


_SKETCH_COLUMNS = [c.split()[0] for c in SKETCH.split(", ")]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back from blobs to a row per document; representatives have their sketch."""
    for b in batches:
        for i in range(b.num_rows):
            ids, names, size, reps = (np.frombuffer(b.column(c)[i].as_buffer(), np.int64) for c in ("ids", "names", "sizes", "reps"))
            own = np.zeros(len(ids), np.int64)
            fresh = np.flatnonzero((size > 0) & (np.frombuffer(b.column("fresh")[i].as_buffer(), np.bool_)))
            own[fresh] = sketch_bits(size[fresh]) // 8
            ends = np.append(0, np.cumsum(own)).astype(np.int32)
            bits = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), b.column("bits")[i].as_buffer()])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(names), pa.array(size), pa.array(reps), bits], ["row", "doc_id", "n_shingles", "rep", "bits"])


def _two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back from blobs to (row, other)."""
    for b in batches:
        for x, y in zip(b.column("ids"), b.column("reps"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c.as_buffer(), np.int64)) for c in (x, y)], ["doc", "center"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of documents that share a block: (document, smallest id) pairs with
    gid null, and the members of groups of three or more with gid. A group that has
    entries for several rows goes by its key, others by their members."""
    keys, ids, shards, heavy = [], [], [], []
    for b in batches:
        for s, k, d, f in zip(b.column("shard").to_pylist(), b.column("keys"), b.column("ids"), b.column("fresh"), strict=True):
            ids.append(_unpack_ids(d.as_py()))
            keys.append(np.zeros((len(ids[-1]), 8), np.uint8))
            keys[-1][:, :KEY_BYTES] = np.frombuffer(k.as_buffer(), np.uint8).reshape(-1, KEY_BYTES)
            shards.append(np.full(len(ids[-1]), s, np.int32))
            heavy.append(np.full(len(ids[-1]), f.is_valid))
    if not keys:
        return
    key, doc, shard, sent = np.concatenate(keys).view(U64).ravel(), np.concatenate(ids), np.concatenate(shards), np.concatenate(heavy)
    del keys, ids, shards, heavy
    order = np.argsort(key) if (shard == shard[0]).all() else np.lexsort((key, shard))
    key, doc, shard, sent = key[order], doc[order], shard[order], sent[order]
    start = _starts(key, shard)
    n = np.diff(np.append(start, len(key)))
    least = np.repeat(np.minimum.reduceat(doc, start), n)
    pair = np.unique(np.stack([doc, least])[:, doc != least], axis=1)
    by_key = np.logical_or.reduceat(sent, start)
    gid = np.add.reduceat(mix(doc.astype(U64)), start)
    gid, at = np.unique(np.where((n > 2) & ~by_key, gid, 0), return_index=True)  # groups with the same members count once
    at = at[gid != 0]
    gid = gid[gid != 0]
    member = np.concatenate([doc[start[i] : start[i] + n[i]] for i in at]) if len(at) else doc[:0]
    own = np.flatnonzero(np.repeat(by_key, n) & ~sent)  # the others came from their slices
    member = np.append(member, doc[own])
    gids = np.append(np.repeat(gid, n[at]).view(np.int64), _group(shard[own], key[own]))
    for lo in range(0, max(pair.shape[1], len(member)), 100_000):
        p, m, g = pair[:, lo : lo + 100_000], member[lo : lo + 100_000], gids[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.nulls(p.shape[1], pa.int64()), pa.array(g)]), pa.array(np.append(p[0], m)), pa.concat_arrays([pa.array(p[1]), pa.nulls(len(m), pa.int64())])],
            ["gid", "doc", "center"],
        )


def _sets(n: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, "text"):
                h, first = shingle_sets(Words(data, off), n)
                sets = [h[first[i] : first[i + 1]].tobytes() for i in range(len(off) - 1)]
                yield pa.RecordBatch.from_arrays([rows.column("row").cast(pa.int64()), pa.array(sets, pa.binary())], ["doc", "set"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if num * max(len(a), len(b)) > den * min(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * common >= num * (len(both) - common)


def _verify(num: int, den: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_similar(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), num, den) for x, y in zip(b.column("set"), b.column("center_set"), strict=True)]
            yield b.select(["doc", "center"]).filter(pa.array(ok, pa.bool_()))

    return run


def _limit(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest symmetric difference of similar sets of these sizes; -1 if sizes rule that out."""
    fits = num * np.maximum(a, b) <= den * np.minimum(a, b)
    return np.where(fits, (den - num) * (a + b) // (den + num), -1)


def _near(num: int, den: int):  # noqa: ANN202
    """Pairs whose sketches' Hamming distance, a lower bound, does not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            limit = _limit(b.column("n").to_numpy(), b.column("center_n").to_numpy(), num, den)
            ok = limit >= 0
            for i in np.flatnonzero(ok).tolist():
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), U64) for c in ("bits", "center_bits"))
                words = min(len(x), len(y))
                ok[i] = np.bitwise_count(fold(x, words) ^ fold(y, words)).sum() <= limit[i]
            yield b.select(["doc", "center"]).filter(pa.array(ok, pa.bool_()))

    return run


def _blocks(batches: Iterator[pa.RecordBatch], body: str) -> Iterator[tuple[tuple[int, int, int], dict[str, np.ndarray], list[np.ndarray]]]:
    """The runs of rows of one (gid, i, j) of a sorted partition: key, columns, and the arrays of body."""
    now, held = None, []

    def block() -> tuple[tuple[int, int, int], dict[str, np.ndarray], list[np.ndarray]]:
        doc, comp, n, side, arrays = zip(*held, strict=True)
        return now, {"doc": np.array(doc), "comp": np.array(comp), "n": np.array(n), "side": np.array(side)}, list(arrays)

    for b in batches:
        for g, i, j, d, c, n, k, s in zip(*(b.column(x).to_pylist() for x in ("gid", "i", "j", "doc", "comp", "n", "side")), b.column(body), strict=True):
            if (g, i, j) != now:
                if held:
                    yield block()
                now, held = (g, i, j), []
            held.append((d, c, n, k, np.frombuffer(s.as_py(), U64)))
    if held:
        yield block()


def _meet(at: tuple[int, int, int], x: dict[str, np.ndarray], i: object, j: object) -> np.ndarray:
    """Which of members i and j belong to different components and sides of a block."""
    apart = x["comp"][i] != x["comp"][j]
    return apart & (x["side"][i] != x["side"][j]) if at[1] != at[2] else apart


def _near_members(num: int, den: int):  # noqa: ANN202
    """The members of each block whose sketch does not rule out some member of another
    component: at most a row for each row read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, x, bits in _blocks(batches, "bits"):
            m = len(bits)
            if (x["comp"] == x["comp"][0]).all():
                continue
            words = min(len(b) for b in bits)
            sk = np.stack([fold(b, words) for b in bits])
            near = np.zeros(m, bool)
            step = max(1, 2_000_000 // (m * words))
            for lo in range(0, m, step):
                hi = min(m, lo + step)
                far = np.bitwise_count(sk[lo:hi, None, :] ^ sk[None, :, :]).sum(axis=2, dtype=np.int64)
                near[lo:hi] |= ((far <= _limit(x["n"][lo:hi, None], x["n"][None, :], num, den)) & _meet(at, x, np.arange(lo, hi)[:, None], np.arange(m)[None, :])).any(axis=1)
            k = np.flatnonzero(near)
            if len(k):
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(k), v), t) for v, t in zip(at, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array(x["doc"][k]), pa.array(x["comp"][k]), pa.array(x["side"][k], pa.int32()), pa.array(np.full(len(k), x["doc"][k].min()))], ["gid", "i", "j", "doc", "comp", "side", "least"])

    return run


def spanning(num: int, den: int, at: tuple[int, int, int], x: dict[str, np.ndarray], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all components of a block that links connect, a forest:
    whole sets are compared, but only those whose components are still apart."""
    n = np.array([len(s) for s in sets])
    first = np.append(0, np.cumsum(n))
    words = int(sketch_bits(n.min()[None])[0]) // 64
    flat = np.concatenate(sets)
    rows = np.frombuffer(dense(flat, first), U64)
    ends = np.append(0, np.cumsum(sketch_bits(n) // 64))
    sk = np.stack([fold(rows[a:b], words) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
    token = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(token.max() + 1, bool)
    x = x | {"comp": x["comp"].copy()}
    links = []
    for i in range(len(sets) - 1):
        j = i + 1 + np.flatnonzero(_meet(at, x, i, slice(i + 1, None)))
        if len(j):
            j = j[np.bitwise_count(sk[i] ^ sk[j]).sum(axis=1, dtype=np.int64) <= _limit(n[i], n[j], num, den)]
        if not len(j):
            continue
        mark[token[first[i] : first[i + 1]]] = True
        begin = np.cumsum(n[j]) - n[j]
        common = np.add.reduceat(mark[token[np.repeat(first[j] - begin, n[j]) + np.arange(n[j].sum())]], begin, dtype=np.int64)
        mark[token[first[i] : first[i + 1]]] = False
        for k in j[den * common >= num * (n[i] + n[j] - common)].tolist():
            if x["comp"][k] != x["comp"][i]:
                links.append((i, k))
                x["comp"][x["comp"] == x["comp"][k]] = x["comp"][i]
    return links


def _spanning(num: int, den: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, x, sets in _blocks(batches, "set"):
            links = np.array(spanning(num, den, at, x, sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x["doc"][links].max(axis=1)), pa.array(x["doc"][links].min(axis=1))], ["doc", "center"])

    return run


def clustered(near: DataFrame, reps: DataFrame) -> DataFrame:
    """The same members with fewer repeats: gid, i, j, doc, comp, side, n.

    A member lies in many groups that differ little. What groups connect is one
    cluster; if it has at most BLOCK members (BLOCK_BYTES), it is compared as one
    group, in which each member occurs once. Larger clusters keep their groups,
    those with equal members once.
    """
    joined = components(near.select("doc", "least").distinct(), "doc", "least")
    own = near.select("doc", "comp").distinct().join(reps.select("doc", "n"), "doc").join(joined.withColumnRenamed("node", "doc"), "doc")
    small = own.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where((F.col("m") <= BLOCK) & (F.col("s") * 8 <= BLOCK_BYTES)).select("component")
    own = store.save(own.join(small.withColumn("few", F.lit(True)), "component", "left"), "clusters")
    whole = own.where("few").select(F.col("component").alias("gid"), F.lit(0).alias("i"), F.lit(0).alias("j"), "doc", "comp", F.lit(0).alias("side"), "n")
    rest = near.drop("least").join(own.where("few is null").select("doc", "n"), "doc")
    key = rest.groupBy("gid", "i", "j").agg(F.sum(F.xxhash64("doc", "side").cast("decimal(38,0)")).alias("h"), F.count("*").alias("m"))
    key = key.groupBy("h", "m").agg(F.min(F.struct("gid", "i", "j")).alias("k")).select("k.gid", "k.i", "k.j")
    rest = rest.join(key, ["gid", "i", "j"], "left_semi")
    return whole.unionByName(rest)


def similar_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two rows link if den * |A and B| >= num * |A or B| on their sets of
    n-word shingles; component_id is the smallest doc_id that links reach.
    Empty and null texts have no shingles and link with nothing. Rows that
    repeat an id are rows of their own, also if their texts differ. Rows without
    an id are never linked and have no component. Other columns of docs are
    ignored.

    1. Sketch (one scan): each slice of text yields its blocks as packed
       arrays, dealt out by key; sets that are equal within a partition send
       one. 2. Each shard sorts its keys; groups yield star pairs to their
       smallest member, linear in the keys. 3. Star pairs are verified on whole
       sets and joined to components. 4. Only groups that still hold several
       components are compared across them, in blocks of at most BLOCK members
       and BLOCK_BYTES a side: first by sketches, then, for the members with
       some partner left, on whole sets. A block yields a forest of links, so rows
       grow with members, not with pairs.
    """
    labels, _ = _labelled(docs, n, num, den, hot)
    lost = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("row"), F.col("text").alias("text")).mapInArrow(_sets(n), "doc long, set binary")
    return labels.select("doc_id", "n_shingles", "component_id").union(lost.select("doc", (F.length("set") / 8).cast("long"), F.lit(None).cast("long")))


def _labelled(docs: DataFrame, n: int, num: int, den: int, hot: int) -> tuple[DataFrame, Column]:
    """A row per row with an id: row, doc_id, n_shingles, component_id, stays (the row
    of its group that stays); and row as an expression over docs."""
    spark = docs.sparkSession
    row = store.row_key(docs)
    keyed = docs.where("doc_id is not null").select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    # Words a document are about n_chars / 6; keys are a third of the words.
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = store.width(spark, size / 12, SHARD_KEYS)
    sketch = store.save(keyed.mapInArrow(_sketches(n, num, den, shards, hot), SKETCH), "sketch")
    members = sketch.where(F.col("shard") == MEMBERS).select("ids", "names", "sizes", "reps", "bits", "fresh").mapInArrow(_members, "row long, doc_id long, n_shingles long, rep long, bits binary")
    blocks = sketch.where("shard >= 0").select("shard", "keys", "ids", "fresh").repartitionById(shards, "shard")
    link = "doc long, center long"
    local = lambda shard: sketch.where(F.col("shard") == shard).select("ids", "reps").mapInArrow(_two, link)
    found = store.save(blocks.mapInArrow(_stars, "gid long, doc long, center long"), "stars")
    found = found.union(local(PAIRS).select(F.lit(None).cast("long"), "doc", "center")).union(local(GROUPS).select("center", "doc", F.lit(None).cast("long")))
    star = store.save(found.where("gid is null").select("doc", "center").distinct(), "pairs")
    group = store.save(found.where("gid is not null").select("gid", "doc").distinct(), "groups")
    need = star.select("doc").union(star.select("center")).distinct()
    reps = members.where("length(bits) > 0").select(F.col("row").alias("doc"), F.col("n_shingles").alias("n"), "bits")
    # Each representative once, before any join: a hot one may then be split.
    reps = store.save(store.only(reps, "doc", need).groupBy("doc").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "reps")
    other = reps.select(*[F.col(c).alias(f"center_{c}" if c != "doc" else "center") for c in reps.columns])

    def sets_of(need: DataFrame) -> DataFrame:
        """The shingle sets of some rows, each once."""
        sets = store.only(keyed, "row", need.distinct()).mapInArrow(_sets(n), "doc long, set binary")
        return store.save(sets.groupBy("doc").agg(F.first("set").alias("set")), "sets", batch=SET_ROWS)

    pairs = star.join(reps, "doc").join(other, "center").select("doc", "center", "n", "center_n", "bits", "center_bits")
    pairs = store.save(pairs.mapInArrow(_near(num, den), link), "pairs", batch=SET_ROWS)
    sets = sets_of(pairs.select("doc").union(pairs.select("center")))
    both = pairs.join(sets, "doc").join(sets.select(F.col("doc").alias("center"), F.col("set").alias("center_set")), "center")
    edges = store.save(both.select("doc", "center", "set", "center_set").mapInArrow(_verify(num, den), link), "edges", batch=SET_ROWS)
    comp = components(edges, "doc", "center")

    g = group.join(comp.withColumnRenamed("node", "doc"), "doc", "left").join(reps.select("doc", "n"), "doc")
    g = g.select("gid", "doc", F.coalesce("component", "doc").alias("comp"), "n")
    several = g.groupBy("gid").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("m"), F.sum("n").alias("s")).where("a < b")
    several = several.select("gid", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("s") * 8 / BLOCK_BYTES)).cast("int").alias("c"))
    g = store.save(g.join(several, "gid").withColumn("k", F.pmod(F.xxhash64("doc"), F.col("c")).cast("int")), "several")
    if not g.isEmpty():
        g = g.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        g = g.select("gid", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "doc", "comp", "n", (F.col("k") > F.col("o")).cast("int").alias("side"))
        dealt = lambda x: x.repartition(store.width(spark), "gid", "i", "j").sortWithinPartitions("gid", "i", "j")
        near = dealt(g.join(reps.select("doc", "bits"), "doc")).mapInArrow(_near_members(num, den), "gid long, i int, j int, doc long, comp long, side int, least long")
        near = clustered(store.save(near, "near", batch=SET_ROWS), reps)
        near = dealt(near.drop("n").join(sets_of(near.select("doc")), "doc").withColumn("n", F.length("set") / 8))
        edges = edges.union(store.save(near.mapInArrow(_spanning(num, den), link), "edges", batch=SET_ROWS))
        comp = components(edges, "doc", "center")

    # A representative need not be the smallest of its copies, so labels are the least of all members.
    own = members.groupBy("rep").agg(F.min(F.struct("doc_id", "row")).alias("least")).join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    own = own.select("rep", "least", F.coalesce("component", "rep").alias("c"))
    label = own.join(own.groupBy("c").agg(F.min("least").alias("first")), "c").select("rep", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("stays"))
    return members.join(label, "rep").select("row", "doc_id", "n_shingles", "component_id", "stays"), row


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of docs: the one with the smallest id (of several texts
    with that id, one). Rows that repeat an id and its text go or stay together; rows
    without an id stay."""
    labels, row = _labelled(docs, n, num, den, HOT)
    return store.without(docs, row, labels.where("row != stays").select("row"))
