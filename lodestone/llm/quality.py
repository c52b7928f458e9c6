"""A quality classifier from weak labels.

LABELLERS are overlapping heuristics; each votes bad (1), good (0) or abstains
on a document. How often each combination of votes occurs is counted over all
documents, and expectation-maximisation over these counts (a Dawid-Skene model
with abstentions) estimates each labeller's accuracies and the share of bad
documents; no given labels are used. The posterior of a document's votes is its
soft label; a hashed linear scorer of token shapes is trained on a bounded
sample of soft labels and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, Words, cores, hash_spans, mix, slices

SAMPLE = 12_000  #: different texts that the scorer is fitted on, about, by the order of a hash
HASHED = 1 << 12  #: weights of the scorer
REJECT = 0.5  #: a document is rejected at this score or above
EM_ROUNDS, ROUNDS, L2 = 200, 300, 1e-5

_CLASS = np.full(256, ord("x"), np.uint8)  # letters below A-Z, and bytes of other letters
_CLASS[33:127] = np.arange(33, 127)
_CLASS[48:58] = ord("9")
_CLASS[65:91] = ord("X")
_CLASS[97:123] = ord("x")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]] = True

#: (name, polarity, measure, limit): the labeller votes bad above (+1) or good at most (-1) the limit
LABELLERS = [
    ("symbols in words", 1, "symbol", 0.08),
    ("words that end in several symbols", 1, "tail", 0.15),
    ("words without letters or digits", 1, "bare", 0.10),
    ("tables of bars", 1, "bars", 0.08),
    ("exclamations", 1, "shout", 0.15),
    ("capitals", 1, "upper", 0.35),
    ("repeats of the word before", 1, "repeat", 0.10),
    ("one word is very frequent", 1, "top", 0.22),
    ("few different words", 1, "poor", 0.75),
    ("plain words, hardly repeated", -1, "rough", 0.06),
    ("no odd marks", -1, "odd", 0.02),
    ("lower case, varied", -1, "mono", 0.30),
]


def measures(w: Words) -> dict[str, np.ndarray]:
    """Statistics of each document, between 0 and 1; 0 for documents without words.

    Those that only make sense for more than a few words (top, poor, mono, repeat)
    are 0 below 20 words.
    """
    n_doc = len(w.first) - 1
    count = np.diff(w.first)
    doc = w.docs()
    share = lambda mask: np.bincount(doc, weights=mask, minlength=n_doc) / np.maximum(count, 1)
    some, starts, ends, _ = cores(w)
    bare = np.ones(len(w), bool)
    bare[some] = False
    tail = np.zeros(len(w), np.int64)
    tail[some] = w.ends[some] - ends
    lead = w.data
    symbols = np.append(0, np.cumsum(_SYMBOL[lead]))
    n_symbols = symbols[w.ends] - symbols[w.starts]
    last = lead[w.ends - 1] if len(w) else lead[:0]
    tail_symbol = (tail >= 2) & (n_symbols >= 2)
    shout = (tail >= 2) & (last == 33)
    caps = np.append(0, np.cumsum((lead >= 65) & (lead <= 90)))
    small = np.append(0, np.cumsum((lead >= 97) & (lead <= 122)))
    upper = (caps[w.ends] - caps[w.starts] >= 2) & (small[w.ends] == small[w.starts])
    core = np.zeros(len(w), U64)
    core[some] = hash_spans(w.data, starts, ends)
    repeat = np.zeros(len(w), bool)
    repeat[1:] = (core[1:] == core[:-1]) & (doc[1:] == doc[:-1]) & (core[1:] != 0)
    order = np.argsort(core, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    c, d = core[order], doc[order]
    new = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (d[1:] != d[:-1]))) if len(c) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(c)))
    top = np.zeros(n_doc)
    np.maximum.at(top, d[new], np.where(c[new] != 0, times, 0))
    kinds = np.bincount(d[new], minlength=n_doc)
    longer = count >= 20
    top = np.where(longer, top / np.maximum(count, 1), 0)
    poor = np.where(longer, np.clip(1 - kinds / np.maximum(1, 8 * count**0.6), 0, 1), 0)
    out = {"symbol": share(n_symbols >= 1), "tail": share(tail_symbol), "bare": share(bare), "bars": share(last == 124), "shout": share(shout), "upper": share(upper), "top": top, "poor": poor}
    out["repeat"] = np.where(longer, share(repeat), 0)
    out["rough"] = np.maximum.reduce([share(bare | tail_symbol | shout), out["repeat"], np.where(top > 0.22, 1, 0)])
    out["odd"] = np.maximum(out["symbol"], out["shout"])
    out["mono"] = np.maximum(out["upper"], np.where(longer, share(repeat) + np.where(top > 0.22, 1, 0), 0))
    return out


def votes(w: Words) -> np.ndarray:
    """A code per document: two bits a labeller, 0 abstains, 1 votes good, 2 votes bad."""
    m = measures(w)
    out = np.zeros(len(w.first) - 1, np.int64)
    some = np.diff(w.first) > 0
    for k, (_, side, name, limit) in enumerate(LABELLERS):
        hit = m[name] > limit if side > 0 else (m[name] <= limit) & some
        out |= np.where(hit, 2 if side > 0 else 1, 0) << 2 * k
    return out


def estimate(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Posterior probability that documents with these vote codes are bad.

    EM starts from labellers that are mostly right; each has its own rates of
    voting on good and on bad documents.
    """
    v = (codes[:, None] >> 2 * np.arange(len(LABELLERS))) & 3
    voted = (v > 0).astype(float)
    side = np.array([s for _, s, _, _ in LABELLERS])
    rate = np.where(side > 0, [[0.02], [0.5]], [[0.9], [0.2]])  # of voting at all, on good and on bad documents
    prior = 0.15
    total = n.sum()
    p = np.zeros(len(codes))
    for _ in range(EM_ROUNDS):
        like = [voted @ np.log(r) + (1 - voted) @ np.log(1 - r) for r in rate]
        p = 1 / (1 + np.exp(np.clip(like[0] + np.log(1 - prior) - like[1] - np.log(prior), -500, 500)))
        bad = p * n
        prior = float(np.clip(bad.sum() / total, 1e-4, 1 - 1e-4))
        for y, weight in enumerate((n - bad, bad)):
            rate[y] = np.clip((voted * weight[:, None]).sum(axis=0) + [0.5], 0, None) / (weight.sum() + 1)
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
    return p


def shapes(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed feature, value): shares of token shapes, alone and in pairs.

    A shape has x for runs of small letters, X for capitals, 9 for digits, and
    other signs as they are, runs shortened to one; repeats of the word before
    are a shape of their own.
    """
    cls = _CLASS[w.data]
    keep = np.ones(len(cls), bool)
    keep[1:] = cls[1:] != cls[:-1]
    keep[w.starts] = True
    at = np.append(0, np.cumsum(keep))
    short = cls[keep]
    raw = hash_spans(np.where(short == ord("X"), 1, short).astype(np.uint8), at[w.starts], at[w.ends])
    doc = w.docs()
    some, starts, ends, _ = cores(w)
    core = np.zeros(len(w), U64)
    core[some] = hash_spans(w.data, starts, ends)
    same = np.zeros(len(w), bool)
    same[1:] = (core[1:] == core[:-1]) & (doc[1:] == doc[:-1])
    raw = np.where(same, mix(raw + U64(9)), raw)
    pair = np.append(raw[:1], raw[1:] + raw[:-1] * U64(3))
    pair[w.first[:-1][np.diff(w.first) > 0]] = U64(1)
    f = (np.concatenate([mix(raw), mix(pair + U64(17))]) & U64(HASHED - 1)).astype(np.int64)
    key = np.concatenate([doc, doc]) * HASHED + f
    key, n = np.unique(key, return_counts=True)
    d = key // HASHED
    return d, key % HASHED, np.sqrt(n / np.maximum(1, np.diff(w.first))[d])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, off in slices(batch, "text"):
            code, n = np.unique(votes(Words(data, off)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n, pa.int64())], ["code", "n"])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, off in slices(batch, "text"):
            w = Words(data, off)
            d, f, x = shapes(w)
            cut = np.searchsorted(d, np.arange(len(off)))
            part = lambda a, t: pa.array([a[cut[i] : cut[i + 1]].astype(t).tobytes() for i in range(len(off) - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(votes(w)), part(f, np.int16), part(x, np.float32)], ["code", "f", "x"])


def fit(p: np.ndarray, f: list[np.ndarray], x: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; both sides weigh the same."""
    row = np.repeat(np.arange(len(p)), [len(a) for a in f])
    col, val = np.concatenate(f).astype(np.int64), np.concatenate(x).astype(float)
    c = 0.5 * (p / max(p.sum(), 1e-9) + (1 - p) / max((1 - p).sum(), 1e-9))
    w, b = np.zeros(HASHED), 0.0
    m, v = np.zeros(HASHED + 1), np.zeros(HASHED + 1)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=w[col] * val, minlength=len(p)) + b
        r = c * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - p)
        g = np.append(np.bincount(col, weights=r[row] * val, minlength=HASHED) + L2 * w, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def model(docs: DataFrame):  # noqa: ANN201
    """A function from Words to scores, fitted on docs.

    Vote patterns are counted over all rows. The scorer is fitted on the different
    texts with the least hashes, about SAMPLE of them (all, if there are fewer):
    repeats of a text, with or without ids, count there once. A sample that turns
    out empty leaves the posteriors of the votes themselves as scores.
    """
    d = docs.select(F.col("text").alias("text"))
    code, n = np.array([tuple(r) for r in d.mapInArrow(_vote, "code long, n long").groupBy("code").agg(F.sum("n")).collect()], np.int64).reshape(-1, 2).T
    posterior = dict(zip(code.tolist(), estimate(code, n).tolist(), strict=True)) if len(code) else {}
    weights, bias = None, 0.0
    if posterior:
        rows = sample(d, distinct_texts(d)).mapInArrow(_sample, "code long, f binary, x binary").toArrow()
        f = [np.frombuffer(b.as_buffer(), np.int16) for b in rows.column("f")]
        x = [np.frombuffer(b.as_buffer(), np.float32) for b in rows.column("x")]
        if sum(map(len, f)):
            weights, bias = fit(np.array([posterior.get(c, 0.5) for c in rows.column("code").to_pylist()]), f, x)
            weights = weights.astype(np.float32)

    def scores(w: Words) -> np.ndarray:
        if weights is None:
            s = np.array([posterior.get(c, 0.5) for c in votes(w).tolist()])
        else:
            doc, feat, val = shapes(w)
            z = np.bincount(doc, weights=weights[feat] * val, minlength=len(w.first) - 1) + bias
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return np.where(np.diff(w.first) > 0, s, 1.0)

    return scores


def distinct_texts(d: DataFrame) -> int:
    """How many different texts d holds, by HyperLogLog."""
    return d.agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).first()[0]


def sample(d: DataFrame, distinct: int) -> DataFrame:
    """About SAMPLE of the different texts of d, by the order of a hash; all if there
    are fewer. Its size does not depend on how often a text occurs."""
    h = F.xxhash64("text").alias("h")
    part = d.select(h, "text")
    if distinct > SAMPLE:
        part = part.where(F.shiftrightunsigned("h", 1) < max(1, int(2**63 * SAMPLE / distinct)))
    return part.groupBy("h").agg(F.first("text").alias("text")).select("text")


def score(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, higher is worse), keep.

    Null and empty texts have score 1 and are rejected: they hold nothing to
    learn from. Rows that repeat an id are scored one by one; rows without an id
    as well. An empty table gives an empty result. Other columns are ignored.
    """
    scores = model(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, "text"):
                s = scores(Words(data, off))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(s), pa.array(s < REJECT)], ["doc_id", "score", "keep"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return d.mapInArrow(run, "doc_id long, score double, keep boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected. Each row is judged by its own text,
    while it is scanned: rows that share an id, or have none, do not affect each other."""
    scores = model(docs)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        parts = [scores(Words(data, off)) < REJECT for _, data, off in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text")]
        return pa.array(np.concatenate([*parts, np.zeros(0, bool)]), pa.bool_())

    return docs.where(good(F.col("text")))
