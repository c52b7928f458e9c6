"""A trigram language model in sharded Elias-Fano tries.

Model. With u the word before w and t the one before u,

    P(w | t u) = (c(t u w) + A c(u w) + B P1(w)) / (c(t u) + A c(u) + B),
    P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), one class of unknown words included.

Over all w the numerators add up to the denominator, so this is a distribution.
The numerator needs counts that lie with w, the denominator counts that lie with
u as a word after t, so it is subtracted where u itself is a word: everything
about a word and the contexts before it meets in the bucket of that word, and one
exchange of packed token arrays both trains and scores. Words with very many
occurrences are spread over the buckets by their context; their counts come
from the census, which also gives the exact V.

Trie of a bucket. Level 1: the sorted 64-bit hashes of words, their cumulated
counts and pointers into level 2. Level 2: for each word the 40-bit codes of its
contexts u, and pointers into level 3: for each pair the 32-bit codes of t. Words,
counts, pointers and contexts are Elias-Fano coded; a context is found by a
successor search between two pointers. Every entry has 16-bit codes of the
logarithms of its numerator and (levels 1 and 2) of the denominator after it. The
levels lie in one block of bytes, which a task maps into memory.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .elias_fano import EliasFano
from .text import U64, Words, mix, slices

A, B = 0.02, 10.0  #: weights of the second and the first order
BUCKET_TOKENS = 2_000_000  #: tokens that a task holds at once, on average
SHARDS = 1 << 15  #: tasks of an exchange, at most; beyond, a task works bucket by bucket
HOT_WORDS = 1_000_000  #: words that are spread by their context, at most: executors hold their counts
SLICE = 4 << 20
CENSUS = 2_000_000  #: different words that a task of the census holds
END, BEGIN, TOKENS = U64(0x9D3F5C1B2A7E4D61), U64(0x51C64E6D7A3B9F87), U64(0x3C6EF372FE94F82B)
CODE, CODE2 = U64((1 << 40) - 1), U64((1 << 32) - 1)


class Codes:
    """16-bit codes of real numbers, evenly between their least and largest."""

    @staticmethod
    def pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
        step = (hi - lo) / 65535 or 1.0
        return np.round((x - lo) / step).astype(np.uint16), np.array([lo, step])

    @staticmethod
    def unpack(code: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return scale[0] + scale[1] * code


class Trie:
    """The levels of one bucket; see the module's text."""

    KINDS = (U64, U64, np.int64, np.int64) * 6 + (np.uint16, np.float64) * 5 + (np.float64,)

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.arrays = arrays
        self.words, self.counts, self.pointers, self.contexts, self.pointers2, self.contexts2 = (EliasFano(*arrays[4 * i : 4 * i + 4]) for i in range(6))
        self.q1, self.d1, self.q2, self.d2, self.q3 = (arrays[24 + 2 * i : 26 + 2 * i] for i in range(5))
        self.head = arrays[34]

    @classmethod
    def build(cls, word: np.ndarray, u: np.ndarray, t: np.ndarray, count: np.ndarray, of: Counts) -> Trie:
        """From distinct (word, u, t) in order, with counts."""
        two = _starts(word, u)
        one = two[_starts(word[two])]
        c2 = np.add.reduceat(count, two) if len(two) else count[:0]
        at1 = np.searchsorted(two, one)
        c1 = of.total(word[one], np.add.reduceat(count, one) if len(one) else count[:0])
        own1, own2 = _spread(at1, len(two)), _spread(two, len(word))
        p1 = of.b * (c1 + 0.5) / of.z
        cum = np.append(0, np.cumsum(c1))
        fano = lambda v, bits: EliasFano.build(v, max(1, bits)).parts()
        arrays = [
            *fano(word[one], 64), *fano(cum, int(cum[-1]).bit_length()),
            *fano(np.append(at1, len(two)), len(two).bit_length()), *fano(own1.astype(U64) << U64(40) | u[two], 40 + len(one).bit_length()),
            *fano(np.append(two, len(word)), len(word).bit_length()), *fano(own2.astype(U64) << U64(32) | t, 32 + len(two).bit_length()),
            *Codes.pack(np.log10(p1)), *Codes.pack(np.log10(of.a * c1 + of.b)),
            *Codes.pack(np.log10(of.a * c2 + p1[own1])), *Codes.pack(np.log10(c2 + of.a * c1[own1] + of.b)),
            *Codes.pack(np.log10(count + of.a * c2[own2] + p1[own1][own2])), np.log10([of.b * 0.5 / of.z, of.b]),
        ]
        return cls([np.ascontiguousarray(x, k) for x, k in zip(arrays, cls.KINDS, strict=True)])

    def pack(self) -> bytes:
        return _pack(*self.arrays)

    @classmethod
    def load(cls, body: bytes) -> Trie:
        """The levels as views of a memory map that holds body."""
        place = mmap.mmap(-1, max(1, len(body)))
        place.write(body)
        return cls(_unpack(memoryview(place), *cls.KINDS))

    def ask(self, word: np.ndarray, u: np.ndarray, t: np.ndarray, of: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of the word, log numerator, log denominator after it) of triples in
        order; each word and each pair is searched once. What a bucket lacks of hot
        words the census knows."""
        two = _starts(word, u)
        one = two[_starts(word[two])]
        w = word[one]
        count = np.zeros(len(one), np.int64)
        num, den = (np.full(len(one), float(x)) for x in self.head)
        rank = self.words.find(w)
        hot, place = of.place(w)
        k = np.flatnonzero(hot & (rank < 0))
        c = of.hot_count[place[k]]
        count[k], num[k] = c, np.log10(of.b * (c + 0.5) / of.z)
        den[k] = np.log10(of.a * c + of.b)
        k = np.flatnonzero(rank >= 0)
        r = rank[k]
        count[k] = (self.counts.access(r + 1) - self.counts.access(r)).astype(np.int64)
        num[k], den[k] = Codes.unpack(self.q1[0][r], self.q1[1]), Codes.unpack(self.d1[0][r], self.d1[1])
        own = _spread(np.searchsorted(two, one), len(two))
        lo, hi = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        lo[k], hi[k] = self.pointers.access(r), self.pointers.access(r + 1)
        count, num, den, rank = count[own], num[own], den[own], rank[own]
        node = self.contexts.within(rank.clip(0).astype(U64) << U64(40) | u[two], lo[own], hi[own])
        k = np.flatnonzero(node >= 0)
        r = node[k]
        num[k], den[k] = Codes.unpack(self.q2[0][r], self.q2[1]), Codes.unpack(self.d2[0][r], self.d2[1])
        own = _spread(two, len(word))
        lo, hi = np.zeros(len(two), np.int64), np.zeros(len(two), np.int64)
        lo[k], hi[k] = self.pointers2.access(r), self.pointers2.access(r + 1)
        node = self.contexts2.within(node.clip(0)[own].astype(U64) << U64(32) | t, lo[own], hi[own])
        count, num, den = count[own], num[own], den[own]
        k = np.flatnonzero(node >= 0)
        num[k] = Codes.unpack(self.q3[0][node[k]], self.q3[1])
        return count, num, den


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _spread(start: np.ndarray, n: int) -> np.ndarray:
    """The run of each of n entries."""
    return np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))


@dataclass(frozen=True)
class Counts:
    """What the census knows: tokens, tokens and documents to learn from, their vocabulary,
    and the hot words (in order) with their counts; the model's weights; the buckets."""

    tokens: int
    train: int
    documents: int
    vocabulary: int
    hot: np.ndarray
    hot_count: np.ndarray
    a: float
    b: float
    shards: int
    subs: int
    bucket_tokens: int

    @property
    def z(self) -> float:
        return self.train + 0.5 * (self.vocabulary + 1)

    def place(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether words are hot, their place among the hot words)."""
        if not len(self.hot):
            return np.zeros(len(word), bool), np.zeros(len(word), np.int64)
        at = np.searchsorted(self.hot, word).clip(0, len(self.hot) - 1)
        return self.hot[at] == word, at

    def total(self, word: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The counts of words, of which a bucket has own occurrences."""
        hot, at = self.place(word)
        return np.where(hot, self.hot_count[at], own) if hot.any() else own

    def key(self, word: np.ndarray, u: np.ndarray) -> np.ndarray:
        """What decides the bucket, by its order: the word, of hot words also the context,
        by which they are cut into as many parts as their count asks for."""
        hot, at = self.place(word)
        out = word.copy()
        parts = (4 * self.hot_count[at[hot]] // self.bucket_tokens + 2).astype(U64)
        out[hot] = mix(word[hot] + (mix(u[hot]) >> U64(32)) * parts >> U64(32))
        return out

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return ((key >> U64(32)) * U64(self.shards * self.subs) >> U64(32)).astype(np.int64)


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, code of the word before, code of the one before that, document) of every token, and tokens per document."""
    w = Words(data, off)
    n = np.diff(w.first) + 1
    word = np.insert(w.h, w.first[1:], END)
    first = np.cumsum(n) - n
    u = np.append(BEGIN, word[:-1])
    u[first] = BEGIN
    t = np.append(BEGIN, u[:-1])
    t[first] = BEGIN
    return word, mix(u) & CODE, mix(t) & CODE2, np.repeat(np.arange(len(n)), n), n


def _learn(rows: pa.RecordBatch) -> np.ndarray:
    return ~rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of a partition to learn from, with their occurrences; all
    tokens go under TOKENS."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = tokens = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        word, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(word)
        start = _starts(word[order])
        return word[order][start], np.add.reduceat(n[order], start)

    rows = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1])], ["word", "n"])
    for batch in batches:
        for part, data, off in slices(batch, "text", SLICE):
            w = Words(data, off)
            count, learn = np.diff(w.first), _learn(part)
            word = np.sort(w.h[np.repeat(learn, count)])
            start = _starts(word) if len(word) else np.zeros(0, np.int64)
            held.append((np.append(word[start], END), np.append(np.diff(np.append(start, len(word))), learn.sum())))
            tokens += len(w) + len(count)
            size += len(start)
            if size > CENSUS:
                held, size = [merged()], 0
                if len(held[0][0]) > CENSUS // 2:
                    yield rows(held[0])
                    held = []
    yield rows(merged() if held else (np.zeros(0, U64), np.zeros(0, np.int64)))
    yield rows((np.array([TOKENS]), np.array([tokens])))


def census(docs: DataFrame, a: float = A, b: float = B, bucket_tokens: int = BUCKET_TOKENS) -> Counts:
    """Counts every word of docs (text, held_out) exactly."""
    words = store.save(docs.mapInArrow(_census, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "words")
    at = lambda k: F.col("word") == int(k.view(np.int64))
    tokens, train, v, n_docs = words.agg(F.sum(F.when(at(TOKENS), F.col("n"))), F.sum(F.when(~at(TOKENS), F.col("n"))), F.count_if(~at(TOKENS)), F.sum(F.when(at(END), F.col("n")))).first()
    tokens, train, n_docs = tokens or 0, train or 0, n_docs or 0
    least = max(bucket_tokens // 2, -(-tokens // HOT_WORDS))
    hot = words.where((F.col("n") >= least) & ~at(TOKENS)).toArrow()  # at most HOT_WORDS rows
    word, count = hot.column("word").to_numpy().view(U64), hot.column("n").to_numpy()
    order = np.argsort(word)
    buckets = max(1, -(-tokens // bucket_tokens))
    shards = store.width(docs.sparkSession, min(buckets, SHARDS))
    return Counts(tokens, train, n_docs, v, word[order], count[order], a, b, shards, max(1, -(-buckets // shards)), bucket_tokens)


PACKED = "shard int, sub int, slice long, body binary"


def _deal(of: Counts):  # noqa: ANN202
    """Each slice of text as a packed array per bucket: words, tokens per word,
    context codes and documents; and (sub -1) the slice's documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, data, off in slices(batch, "text", SLICE):
                word, u, t, doc, n = _tokens(data, off)
                key = of.key(word, u)
                order = np.argsort(key, kind="stable")
                key, word, u, t, doc = key[order], word[order], u[order], t[order].astype(np.uint32), doc[order].astype(np.uint16)
                start = np.union1d(_starts(key), np.arange(0, len(key), 1 << 16))  # a run's length fits 16 bits, less one
                per = (np.diff(np.append(start, len(word))) - 1).astype(np.uint16)
                distinct = word[start]
                code = u.view(np.uint8).reshape(-1, 8)[:, :5]
                cut = np.searchsorted(of.bucket(key[start]), np.arange(of.shards * of.subs + 1))  # keys are in order, and so are buckets
                tok = np.append(start, len(word))[cut]
                learn, ids = _learn(rows), rows.column("doc_id")
                shard, sub, body = [number % of.shards], [-1], [_pack(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), n, ~learn)]
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    x, y, i, j = cut[b], cut[b + 1], tok[b], tok[b + 1]
                    shard.append(b // of.subs)
                    sub.append(b % of.subs)
                    d = doc[i:j]
                    body.append(_pack(learn, distinct[x:y], per[x:y], code[i:j], t[i:j], (d & 255).astype(np.uint8), (d >> 8).astype(np.uint8)))
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "sub": pa.array(sub, pa.int32()), "slice": pa.array([number] * len(shard), pa.int64()), "body": pa.array(body, pa.binary())})
                number += 1

    return run


def _pack(*arrays: np.ndarray) -> bytes:
    lengths = np.array([a.nbytes for a in arrays], np.int64)
    return b"".join([lengths.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpack(body: memoryview, *kinds: type) -> list[np.ndarray]:
    lengths = np.frombuffer(body, np.int64, len(kinds))
    ends = 8 * len(kinds) + np.cumsum(lengths)
    return [np.frombuffer(body[e - n : e], k) for k, e, n in zip(kinds, ends.tolist(), lengths.tolist(), strict=True)]


ANSWER = "slice long, kind int, body binary"
TRIE = -1  #: the slice of rows whose body is the trie of a bucket


class Bucket:
    """The tokens that all slices sent to a bucket, in order of (word, u, t)."""

    def __init__(self, parts: list[tuple[int, list[np.ndarray]]]) -> None:
        word = np.concatenate([np.repeat(p[1], p[2].astype(np.int64) + 1) for _, p in parts])
        raw = np.zeros((len(word), 8), np.uint8)
        raw[:, :5] = np.concatenate([p[3].reshape(-1, 5) for _, p in parts])
        u = raw.view(U64).ravel()
        t = np.concatenate([p[4] for _, p in parts])
        doc = np.concatenate([p[5].astype(np.int64) | p[6].astype(np.int64) << 8 for _, p in parts])
        self.slices = [s for s, _ in parts]
        self.base = np.cumsum([0] + [len(p[0]) for _, p in parts])  # documents of all slices, one after the other
        doc += np.repeat(self.base[:-1], [len(p[5]) for _, p in parts])
        learn = np.concatenate([p[0] for _, p in parts]).astype(bool)
        order = np.lexsort((t, u, word))
        word, u, t, self.doc = word[order], u[order], t[order], doc[order]
        at = _starts(word, u, t)
        self.own = _spread(at, len(word))
        self.word, self.u, self.t = word[at], u[at], t[at].astype(U64)
        self.count = np.bincount(self.own, weights=learn[self.doc], minlength=len(at)).astype(np.int64)

    def trie(self, of: Counts) -> Trie:
        seen = self.count > 0
        return Trie.build(self.word[seen], self.u[seen], self.t[seen], self.count[seen], of)

    def answers(self, trie: Trie, of: Counts) -> pa.RecordBatch:
        """For each slice: its documents here, their known tokens, and sums of logarithms."""
        c, num, den = trie.ask(self.word, self.u, self.t, of)
        value = num - np.where(self.word == END, 0.0, den)
        total = self.base[-1]
        add = lambda x: np.bincount(self.doc, weights=x[self.own], minlength=total)
        score, plain, hits = add(value), add(np.log10(c + 0.5)), add(c > 0).astype(np.uint32)
        touched = np.bincount(self.doc, minlength=total) > 0
        body = []
        for a, b in zip(self.base[:-1].tolist(), self.base[1:].tolist(), strict=True):
            i = np.flatnonzero(touched[a:b])
            body.append(_pack(i.astype(np.uint16), hits[a + i], plain[a + i], score[a + i].astype(np.float32)))
        return _answer_rows(self.slices, 1, body)


def _answer_rows(s: list[int], kind: int, body: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array([kind] * len(s), pa.int32()), pa.array(body, pa.binary())], ["slice", "kind", "body"])


def _answer(of: Counts, learn: bool = False, given: bool = False):  # noqa: ANN202
    """Of each bucket the answers to its tokens, from the trie that comes with them (given)
    or is built of them; with learn, the trie instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, trie = None, [], None

        def solved() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            b = Bucket(parts)
            if learn:
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([TRIE], pa.int64()), pa.array([b.trie(of).pack()], pa.binary())], ["shard", "sub", "slice", "body"])
            else:
                if given and trie is None:  # nothing was learned here
                    b.count[:] = 0
                yield b.answers(trie or Trie.load(b.trie(of).pack()), of)

        for b in batches:
            for sh, sub, sl, body in zip(b.column("shard").to_pylist(), b.column("sub").to_pylist(), b.column("slice").to_pylist(), b.column("body"), strict=True):
                if sub < 0:
                    if not learn:
                        yield _answer_rows([sl], 0, [body.as_py()])
                    continue
                if (sh, sub) != now:
                    yield from solved()
                    now, parts, trie = (sh, sub), [], None
                if sl == TRIE:
                    trie = Trie.load(body.as_py())
                else:
                    parts.append((sl, _unpack(memoryview(body.as_py()), np.uint8, U64, np.uint16, np.uint8, np.uint32, np.uint8, np.uint8)))
        yield from solved()

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up what the buckets say of each slice; a row per document."""
    now, sums = None, None
    names = [c.split()[0] for c in GATHERED.split(", ")]

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, sums, strict=True)))

    for b in batches:
        for s, kind, body in zip(b.column("slice").to_pylist(), b.column("kind").to_pylist(), b.column("body"), strict=True):
            body = memoryview(body.as_py())
            if s != now and sums is not None:
                yield rows()
                sums = None
            now = s
            if kind == 0:
                valid, ids, n, held = _unpack(body, np.bool_, np.int64, np.int64, np.bool_)
                sums = [pa.array(ids, mask=~valid), held, n, np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))]
            else:
                i, hits, plain, score = _unpack(body, np.uint16, np.uint32, np.float64, np.float32)
                sums[3][i] += hits
                sums[4][i] += plain
                sums[5][i] += score
    if sums is not None:
        yield rows()


GATHERED = "doc_id long, held_out boolean, n_tokens long, n_known long, plain double, score double"


def _rows(docs: DataFrame, held_out: object) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))


def _scored(d: DataFrame, of: Counts, tries: DataFrame | None) -> DataFrame:
    dealt = d.mapInArrow(_deal(of), PACKED)
    dealt = (dealt if tries is None else dealt.union(tries)).repartitionById(of.shards, "shard").sortWithinPartitions("shard", "sub", "slice")
    answers = dealt.mapInArrow(_answer(of, given=tries is not None), ANSWER).repartition(store.width(d.sparkSession), "slice").sortWithinPartitions("slice", "kind")
    begin = float(np.log10(of.documents * (1 + of.a) + of.b))
    return answers.mapInArrow(_gather, GATHERED).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(of.train).cast("long").alias("train_tokens"),
        (F.col("plain") - F.col("n_tokens") * float(np.log10(of.z))).alias("base_score"),
        (F.col("score") - begin).alias("score"),
    )


def score(docs: DataFrame, held_out: object, a: float = A, b: float = B, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    held_out is a Boolean column: the model learns from all other rows (null:
    learns). Null texts are empty and have one token, the end. base_score is the
    sum of log10((c + 0.5) / (N + 0.5 (V + 1))); score is the model's log10
    probability. Repeated ids are scored row by row. Empty tables give empty
    results; without rows to learn from all counts are 0.
    """
    d = _rows(docs, held_out)
    return _scored(d, census(d, a, b, bucket_tokens), None)


@dataclass(frozen=True)
class Model:
    """A trained model: the census and a table of tries in the shared folder."""

    counts: Counts
    tries: DataFrame

    def score(self, docs: DataFrame) -> DataFrame:
        """Like score(), for any documents: none is learned from, all are held out."""
        return _scored(_rows(docs, F.lit(True)), self.counts, self.tries)


def learn(docs: DataFrame, held_out: object, a: float = A, b: float = B, bucket_tokens: int = BUCKET_TOKENS) -> Model:
    """A model of the rows of docs that are not held out."""
    d = _rows(docs, held_out).where("not held_out")
    of = census(d, a, b, bucket_tokens)
    dealt = d.mapInArrow(_deal(of), PACKED).repartitionById(of.shards, "shard").sortWithinPartitions("shard", "sub", "slice")
    return Model(of, store.save(dealt.mapInArrow(_answer(of, learn=True), PACKED), "tries"))
