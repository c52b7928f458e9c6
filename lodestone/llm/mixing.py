"""Mixing documents to target weights of domains, by soft membership.

A softmax classifier over hashed words, fitted on the rows of docs that are in a
labelled table, gives each document posteriors over domains. Nonnegative rates
(expected copies of each document) are then fitted by projected gradient so that
the expected tokens of each domain match its target: with tokens n_i and
posteriors p_i, minimise the squared residual of sum_i r_i n_i p_i, measured by
the inverse of M = sum_i n_i p_i p_i'. In this metric a step of one is safe, and
r_i <- max(0, r_i - p_i . M^-1 residual). All rates start at one, so a rate is a
function of p_i and of the few step vectors so far: executors replay these, and
a round sends one vector of domains per partition.

Where no document may go (cover), rates are max(1, 1 + p_i . x): of all rates of
one or more whose tokens are in the targets' proportions, the nearest to one. Soft
posteriors give every domain tokens of the others' documents, so the budget is
free. x minimises a convex function of domains by Newton steps over the rows with
a rate above one; a round sends their M as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .text import U64, Words, slices

FIT_ROWS = 8_000  #: labelled rows to fit the classifier on, at most, by the order of a hash
SLICE_BYTES, BATCH_ROWS = 1 << 19, 2_000  #: text whose features a task holds at once; rows of an Arrow batch
HASHED = 1 << 14
ROUNDS, TOLERANCE = 40, 1e-5
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def _features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed word, square root of its share) of distinct hashed words."""
    doc = w.docs()
    key, n = np.unique(doc * HASHED + (w.h & U64(HASHED - 1)).astype(np.int64), return_counts=True)
    d = key // HASHED
    return d, key % HASHED, np.sqrt(n / np.maximum(1, np.diff(w.first))[d])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in slices(batch, "text", SLICE_BYTES):
            d, f, x = _features(Words(data, off))
            cut = np.searchsorted(d, np.arange(len(off)))
            part = lambda a, t: pa.array([a[cut[i] : cut[i + 1]].astype(t).tobytes() for i in range(len(off) - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("domain"), part(f, np.int16), part(x, np.float32)], ["domain", "f", "x"])


def fit(y: np.ndarray, f: list[np.ndarray], x: list[np.ndarray], classes: int, rounds: int = 200, l2: float = 1e-5) -> np.ndarray:
    """Softmax regression; all domains weigh the same. The last row is the bias."""
    row = np.repeat(np.arange(len(y)), [len(a) for a in f])
    col, val = np.concatenate(f).astype(np.int64), np.concatenate(x).astype(float)
    gold = np.eye(classes)[y]
    c = (gold / np.maximum(1, gold.sum(axis=0))).sum(axis=1, keepdims=True) / classes
    w = np.zeros((HASHED + 1, classes))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.stack([np.bincount(row, weights=w[col, k] * val, minlength=len(y)) for k in range(classes)], axis=1) + w[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        r = c * (p / p.sum(axis=1, keepdims=True) - gold)
        g = l2 * w
        for k in range(classes):
            g[:-1, k] += np.bincount(col, weights=r[row, k] * val, minlength=HASHED)
        g[-1] += r.sum(axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def classifier(docs: DataFrame, labels: DataFrame, domain: str, domains: list[str]) -> np.ndarray:
    """Weights fitted on at most FIT_ROWS rows of docs whose id is in labels."""
    spark = docs.sparkSession
    ids = labels.select(F.col("doc_id").cast("long").alias("__id")).where("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(FIT_ROWS)
    some = F.broadcast(spark.createDataFrame(ids.collect(), "__id long"))  # at most FIT_ROWS ids
    own = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").alias("text"), F.col(domain).cast("string").alias("domain"))
    own = own.where(F.col("domain").isin(domains)).join(some, F.col("__doc") == some["__id"]).select("domain", "text")
    rows = own.mapInArrow(_labelled, "domain string, f binary, x binary").toArrow()
    if not rows.num_rows:
        return np.zeros((HASHED + 1, len(domains)))
    y = np.array([domains.index(x) for x in rows.column("domain").to_pylist()])
    return fit(y, [np.frombuffer(b.as_buffer(), np.int16) for b in rows.column("f")], [np.frombuffer(b.as_buffer(), np.float32) for b in rows.column("x")], len(domains))


def posteriors(weights: np.ndarray, w: Words) -> np.ndarray:
    """A row of probabilities of the domains per document."""
    d, f, x = _features(w)
    z = np.stack([np.bincount(d, weights=weights[f, k] * x, minlength=len(w.first) - 1) for k in range(weights.shape[1])], axis=1) + weights[-1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _posteriors(weights: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, "text", SLICE_BYTES):
                w = Words(data, off)
                p = posteriors(weights, w)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), flat], ["doc_id", "n_tokens", "p"])

    return run


def _matrix(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column("p").flatten().to_numpy().reshape(-1, k)


def _replay(p: np.ndarray, steps: list[np.ndarray], least: float) -> np.ndarray:
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(least, r - p @ s)
    return r


def _sums(k: int, steps: list[np.ndarray], square: bool, least: float):  # noqa: ANN202
    """A partition's sums: expected tokens of each domain, and if square M of the rows above the least rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, m = np.zeros(k), np.zeros((k, k))
        for b in batches:
            p, n = _matrix(b, k), b.column("n_tokens").to_numpy()
            total += (n * _replay(p, steps, least)) @ p
            if square:
                some = _replay(p, steps, least) > least if steps else slice(None)
                m += (p[some] * n[some, None]).T @ p[some]
        value = np.concatenate([total, m.ravel()]) if square else total
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value))), pa.array(value)], ["i", "v"])

    return run


def _collect(d: DataFrame, k: int, steps: list[np.ndarray], square: bool, least: float) -> np.ndarray:
    out = np.zeros(k + k * k if square else k)
    for i, v in d.select("n_tokens", "p").mapInArrow(_sums(k, steps, square, least), "i long, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out


def _cover(d: DataFrame, want: np.ndarray, now: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    """The step to rates of one or more that bring the tokens into proportion."""
    k, x, least = len(want), np.zeros(len(want)), 0.0
    ridge = 1e-9 * max(now.sum(), 1) * np.eye(k)
    side, step = np.zeros((k + 1, k + 1)), None
    side[:k, k] = side[k, :k] = want
    for _ in range(ROUNDS if now.sum() else 0):
        if np.abs(now - want * now.sum()).max() <= TOLERANCE * now.sum():
            break
        if step is None:
            side[:k, :k] = m + ridge
            step = np.linalg.solve(side, np.append(-now, 0))[:k]
        out = _collect(d, k, [-x - step], True, 1.0)
        new, m_new = out[:k], out[k:].reshape(k, k)
        value = new @ (x + step) - (x + step) @ m_new @ (x + step) / 2
        if value <= least + 1e-4 * now @ step:
            x, least, now, m, step = x + step, value, new, m_new, None
        else:
            step = step / 2
    return [-x]


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str, cover: bool) -> tuple[list[str], np.ndarray, list[np.ndarray], DataFrame]:
    """(domains, the classifier's weights, the steps of the rates, the table of posteriors)."""
    domains = sorted(targets)
    k = len(domains)
    want = np.array([targets[d] for d in domains], float)
    want /= want.sum()
    weights = classifier(docs, labels, domain, domains).astype(np.float32)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    d = store.save(d.mapInArrow(_posteriors(weights), "doc_id long, n_tokens long, p array<double>"), "posteriors", batch=BATCH_ROWS)
    first = _collect(d, k, [], True, float(cover))
    now, m = first[:k], first[k:].reshape(k, k)
    total = now.sum()
    goal = want * total
    steps = _cover(d, want, now, m) if cover else []
    inverse = np.linalg.inv(m + 1e-9 * max(total, 1) * np.eye(k))
    for _ in range(ROUNDS if total and not cover else 0):
        left = now - goal
        if np.abs(left).max() <= TOLERANCE * total:
            break
        steps.append(inverse @ left)
        now = _collect(d, k, steps, False, 0.0)
    return domains, weights, steps, d


def _copies(rate: Column, doc: Column) -> Column:
    """The rate rounded up or down by a hash of the id; to the nearest without an id."""
    u = F.coalesce(F.pmod(F.xxhash64(doc), F.lit(1 << 30)) / float(1 << 30), F.lit(0.5))
    return F.when(doc.isNull(), F.round(rate)).otherwise(F.floor(rate + u)).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: str = "lang", cover: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, domain (most likely), p_domain,
    rate, copies.

    targets gives each domain's share of tokens (scaled to a sum of one). The
    budget is the tokens of docs; with cover, every rate is one or more and the
    budget is as large as the targets then ask for. copies is the rate rounded up or down by a hash of the id, so
    its expectation is the rate; rows without an id round to the nearest. Null
    and empty texts have no tokens and count for nothing; rates of repeated rows
    are alike. A domain of which docs hold nothing stays empty. An empty table
    gives an empty result. Other columns are ignored.
    """
    domains, _, steps, d = _fitted(docs, labels, targets, domain, cover)
    k, least, names = len(domains), float(cover), np.array(domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _matrix(b, k)
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array(names[best].tolist(), pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(_replay(p, steps, least))], ["doc_id", "n_tokens", "domain", "p_domain", "rate"])

    out = d.mapInArrow(run, "doc_id long, n_tokens long, domain string, p_domain double, rate double")
    return out.withColumn("copies", _copies(F.col("rate"), F.col("doc_id")))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: str = "lang") -> DataFrame:
    """The rows of docs, each as often as its copies say, with its rate and the
    number of the copy. Every rate is one or more, so every row stays. A rate is a
    function of the text, so rows get theirs as they are scanned, without a join."""
    _, weights, steps, _ = _fitted(docs, labels, targets, domain, True)
    rate, copy_no = store.unused(docs, "rate", "copy_no")

    @F.arrow_udf("double")
    def rated(text: pa.Array) -> pa.Array:
        parts = [_replay(posteriors(weights, Words(data, off)), steps, 1.0) for _, data, off in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text")]
        return pa.array(np.concatenate([*parts, np.zeros(0)]))

    copies = _copies(F.col(rate), F.col("doc_id").cast("long"))
    return docs.withColumn(rate, rated(F.col("text"))).withColumn(copy_no, F.explode(F.sequence(F.lit(1), copies)))
