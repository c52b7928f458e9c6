"""A toxicity classifier with counterfactual regularisation.

The score is a logistic function of the set of hashed features of a text: each
word without the punctuation around it, and its byte prefixes (which catch
inflected forms). Training minimises the logistic loss with an L1 penalty, plus
CF_WEIGHT times the squared change of the linear score when identity terms are
swapped for others of their group, so that naming a group carries no weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .text import U64, Words, cores, hash_spans, mix, slices

MAX_TOXIC, MAX_OTHER = 6_000, 14_000  #: labelled rows to fit on, at most, by the order of a hash
MAX_FEATURES = 200_000  #: candidates, at most; the most frequent in toxic rows
LEAST_ROWS, LEAST_SHARE, LEAST_LIFT = 3, 0.004, 4.0  #: toxic rows with a feature; how much more frequent it is there
PREFIXES = (4, 5, 6, 7, 8)
CF_WEIGHT, L1, ROUNDS = 1.0, 2e-5, 400
THRESHOLD = 0.7

# Groups of identity terms that are swapped for one another, in English,
# German, French and Spanish. A term of several groups belongs to the first.
IDENTITY = [
    ["man", "woman", "boy", "girl", "male", "female"],
    ["men", "women", "boys", "girls"],
    ["black", "white", "asian", "latino", "arab"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual"],
    ["transgender", "cisgender"],
    ["american", "mexican", "chinese", "indian", "african", "european"],
    ["old", "young"],
    ["disabled", "deaf", "blind"],
    ["immigrant", "refugee", "citizen"],
    ["mann", "frau", "junge", "mädchen"],
    ["männer", "frauen", "jungen"],
    ["schwarze", "weiße", "asiatische", "arabische"],
    ["christ", "muslim", "jude", "buddhist", "atheist"],
    ["christen", "muslime", "juden", "buddhisten", "atheisten"],
    ["schwul", "lesbisch", "bisexuell", "heterosexuell", "homosexuell"],
    ["amerikaner", "türke", "chinese", "inder", "afrikaner", "europäer"],
    ["alte", "junge"],
    ["behinderte", "gehörlose", "blinde"],
    ["einwanderer", "flüchtling", "bürger"],
    ["homme", "femme", "garçon", "fille"],
    ["hommes", "femmes", "garçons", "filles"],
    ["noir", "blanc", "asiatique", "arabe"],
    ["chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"],
    ["chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"],
    ["lesbienne", "bisexuel", "hétérosexuel", "homosexuel"],
    ["américain", "mexicain", "chinois", "indien", "africain", "européen"],
    ["vieux", "jeune"],
    ["handicapé", "sourd", "aveugle"],
    ["immigré", "réfugié", "citoyen"],
    ["hombre", "mujer", "niño", "niña"],
    ["hombres", "mujeres", "niños", "niñas"],
    ["negro", "blanco", "asiático", "árabe"],
    ["cristiano", "musulmán", "judío", "hindú", "budista", "ateo"],
    ["cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"],
    ["lesbiana", "bisexuales", "heterosexuales", "homosexuales"],
    ["americano", "mexicano", "chino", "indio", "africano", "europeo"],
    ["viejo", "joven"],
    ["discapacitado", "sordo", "ciego"],
    ["inmigrante", "refugiado", "ciudadano"],
]


def partners() -> dict[str, list[str]]:
    """The other terms of each term's group."""
    out: dict[str, list[str]] = {}
    for g in IDENTITY:
        for i, w in enumerate(g):
            out.setdefault(w, g[i + 1 :] + g[:i])
    return out


def _word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) for all words and all their prefixes."""
    out, own = [hash_spans(data, starts, ends)], [np.arange(len(starts))]
    for p in PREFIXES:
        use = np.flatnonzero(ends - starts > p)
        out.append(hash_spans(data, starts[use], starts[use] + p) + U64(p))
        own.append(use)
    return np.concatenate(out), np.concatenate(own)


def _of(word: str) -> set[int]:
    data = np.frombuffer(word.encode(), np.uint8)
    return set(_word_features(data, np.array([0]), np.array([len(data)]))[0].tolist())


class Featurizer:
    """Features that are in a sorted array, as indices into it, with a bitmap in front."""

    def __init__(self, wanted: np.ndarray) -> None:
        self.wanted = wanted
        self.bits = max(10, min(24, int(len(wanted)).bit_length() + 6))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[(wanted & U64((1 << self.bits) - 1)).astype(np.int64)] = True

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, index) pairs, in order."""
        w = Words(data, off, hashes=False)
        _, starts, ends, first = cores(w)
        f, word = _word_features(data, starts, ends)
        hit = np.flatnonzero(self.map[(f & U64((1 << self.bits) - 1)).astype(np.int64)])
        f, word = f[hit], word[hit]
        at = np.searchsorted(self.wanted, f)
        ok = np.flatnonzero((at < len(self.wanted)) & (self.wanted[np.minimum(at, len(self.wanted) - 1)] == f)) if len(self.wanted) else at[:0]
        doc = np.searchsorted(first, word[ok], "right") - 1
        pair = np.unique(doc.astype(np.int64) * (len(self.wanted) + 1) + at[ok])
        return pair // (len(self.wanted) + 1), pair % (len(self.wanted) + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, in how many rows each feature occurs."""
    for batch in batches:
        for _, data, off in slices(batch, "text"):
            w = Words(data, off, hashes=False)
            _, starts, ends, first = cores(w)
            f, word = _word_features(data, starts, ends)
            doc = np.searchsorted(first, word, "right") - 1
            order = np.lexsort((doc, f))
            f, doc = f[order], doc[order]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
            name, n = np.unique(f[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n, pa.int64())], ["name", "n"])


def _count_known(featurize: Featurizer):  # noqa: ANN202
    """Per batch, in how many rows each of the featurizer's features occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, off in slices(batch, "text"):
                at, n = np.unique(featurize(data, off)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["i", "n"])

    return run


def counterfactual(swaps: dict[str, list[str]]):  # noqa: ANN202
    """A function that gives each identity term of a text a partner. The text's checksum
    picks which, so that over many texts a term meets all of its partners."""
    import re
    import zlib

    identity = re.compile(r"(?<![^\W_])(" + "|".join(sorted(swaps, key=len, reverse=True)) + r")(?![^\W_])", re.IGNORECASE)

    def swap(text: str) -> str:
        turn = zlib.crc32(text.encode())

        def other(m) -> str:  # noqa: ANN001
            with_ = swaps.get(m[0].lower())
            return with_[turn % len(with_)] if with_ else m[0]

        return identity.sub(other, text)

    return swap


def _index(featurize: Featurizer, swaps: dict[str, list[str]]):  # noqa: ANN202
    """A row per labelled row: its label, features, and those of its counterfactual (null: none)."""
    swap = counterfactual(swaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, "text"):
                n = len(off) - 1
                doc, at = featurize(data, off)
                cut = np.searchsorted(doc, np.arange(n + 1))
                other: list[list[int] | None] = [None] * n
                for i in range(n):
                    text = data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")
                    new = swap(text)
                    if new != text:
                        d = np.frombuffer(new.encode(), np.uint8)
                        other[i] = featurize(d, np.array([0, len(d)]))[1].tolist()
                has = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("label").cast(pa.int32()), has, pa.array(other, pa.list_(pa.int32()))], ["label", "has", "swapped"])

    return run


class Rows:
    """A sparse 0/1 matrix: the columns of row i are col[first[i]:first[i+1]]."""

    def __init__(self, col: np.ndarray, first: np.ndarray) -> None:
        self.col, self.n = col, len(first) - 1
        self.row = np.repeat(np.arange(self.n), np.diff(first))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def t_dot(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, weights=r[self.row], minlength=width)


def _rows(lists: pa.ChunkedArray) -> Rows:
    x = lists.combine_chunks() if lists.num_chunks else pa.array([], lists.type)
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    first = x.offsets.to_numpy() - (x.offsets[0].as_py() if len(x) else 0)
    return Rows(x.flatten().to_numpy(zero_copy_only=False).astype(np.int64), first if len(x) else np.zeros(1, np.int64))


def fit(label: np.ndarray, x: Rows, a: Rows, b: Rows, width: int) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal Adam; both classes weigh the same. a and b
    are the rows that name identity terms, as they are and with terms swapped."""
    share = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    c = np.where(label == 1, 0.5 / share[0], 0.5 / share[1])
    w, bias = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -40, 40)))
        r = c * (p - label)
        g = x.t_dot(r, width)
        if a.n:
            change = CF_WEIGHT * (a.dot(w) - b.dot(w)) / a.n
            g += a.t_dot(change, width) - b.t_dot(change, width)
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.1 / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        step = np.minimum(rate, 1e4) * m / (1 - 0.9**t)
        w, bias = w - step[:-1], bias - step[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(rate[:-1], 1e4) * L1)
    return w, float(bias)


class Model:
    """Sorted feature hashes with their weights, and a bias."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.names, self.weights, self.bias = names, weights, bias


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most MAX_TOXIC + MAX_OTHER labelled rows of docs.

    labels has doc_id and toxic; null and repeated labels: the largest of an id
    counts, ids without any are left out. Without rows of both classes the model
    is a bias of 0.
    """
    spark = docs.sparkSession
    one = labels.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("label")).where("label is not null and __id is not null")
    pick = [one.where(F.col("label") == v).orderBy(F.xxhash64("__id"), "__id").limit(n).collect() for v, n in ((1, MAX_TOXIC), (0, MAX_OTHER))]
    if not all(pick):
        return Model(np.zeros(0, U64), np.zeros(0), 0.0)
    rows = [(r["__id"], r["label"]) for part in pick for r in part]
    some = F.broadcast(spark.createDataFrame(rows, "__id long, label int"))  # at most MAX_TOXIC + MAX_OTHER rows
    own = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").alias("text"))
    own = store.save(own.join(some, own["__doc"] == some["__id"]).select("text", "label"), "labelled")
    n = own.agg(F.sum("label"), F.count("*")).first()
    least = max(LEAST_ROWS, int(LEAST_SHARE * (n[0] or 0)))
    count = own.where("label = 1").select("text").mapInArrow(_count, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = count.orderBy(F.desc("n"), "name").limit(MAX_FEATURES).toArrow()
    seen = dict(zip(found.column("name").to_numpy().view(U64).tolist(), found.column("n").to_pylist(), strict=True))
    extra = np.array(sorted({f for g in IDENTITY for w in g for f in _of(w)}), U64)
    names = np.unique(np.concatenate([np.array(list(seen), U64), extra]))
    toxic = np.array([seen.get(x, 0) for x in names.tolist()], float)
    other = np.zeros(len(names))
    known = own.where("label = 0").select("text").mapInArrow(_count_known(Featurizer(names)), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    other[known.column("i").to_numpy()] = known.column("n").to_numpy()
    n_toxic, n_other = (n[0] or 0), n[1] - (n[0] or 0)
    lift = ((toxic + 0.5) / (n_toxic + 1)) / ((other + 0.5) / (n_other + 1))
    names = names[(lift >= LEAST_LIFT) | np.isin(names, extra)]
    data = own.mapInArrow(_index(Featurizer(names), partners()), "label int, has array<int>, swapped array<int>").toArrow()
    label = data.column("label").to_numpy().astype(np.float64)
    named = data.filter(data.column("swapped").is_valid())
    w, bias = fit(label, _rows(data.column("has")), _rows(named.column("has")), _rows(named.column("swapped")), len(names))
    return Model(names[w != 0], w[w != 0], bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with score (0 to 1), a row per row; null texts count as empty."""
    weights, bias = np.append(model.weights, 0.0), model.bias
    featurize = Featurizer(model.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, "text"):
                doc, at = featurize(data, off)
                z = np.bincount(doc, weights=weights[at], minlength=len(off) - 1) + bias
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    held_out is an expression of doc_id that tells which rows the model must
    not learn from. Empty and null texts get the score of no features.
    """
    model = train(docs, labels.where(~F.coalesce(held_out, F.lit(False))))
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
