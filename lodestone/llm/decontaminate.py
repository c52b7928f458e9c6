"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so that a benchmark item
and a copy of it with other numbers or names have the same template. Windows of
WINDOW template tokens are hash-joined between documents and items. Windows
that lie on one alignment of a document with an item must fill each slot value
of the item with one value throughout: a re-parameterised copy renames
consistently, a chance likeness does not. A slot value with several values there
discounts the windows that hold it. Every window is also hashed with its values,
so that what is word for word always counts, however few of its tokens are words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .text import U64, Words, cores, hash_spans, hash_windows, mix, slices

WINDOW = 10  #: template tokens; a shorter item is one window of its own length
LEAST_LITERAL = 0.5  #: of a window's tokens must be words, not placeholders, to count with other values
LEAST_COVER = 0.3  #: of an item's windows must occur consistently
FILTER_BITS = 1 << 27  #: at most, of the filter that executors hold
BROADCAST_WINDOWS = 500_000

# Words of measure that count as units after a number.
UNITS = """
% percent mm cm m km inch inches in ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds
oz ounce ounces ton tons ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour
hours day days week weeks month months year years km/h mph m/s hz khz mhz ghz w kw kwh j kj cal kcal v a k c f degree degrees
dollar dollars cent cents euro euros usd eur gbp kb mb gb tb
""".split()
NUMBER, UNIT, NAME = 1, 2, 3

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    return np.sort(hash_spans(data, ends - [len(w.encode()) for w in words], ends))


UNIT_HASHES = _hash_words(UNITS)


class Template:
    """Template tokens of consecutive documents: punctuation around words is
    dropped, and so are words that have nothing else.

    h: the lower-cased word's hash (a slot's value); kind: 0 for words; t: hash
    of the word, or of its placeholder; first: as in Words.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        w = Words(data, off, hashes=False)
        some, starts, ends, self.first = cores(w)
        lines = np.append(0, np.cumsum(data == 10))
        opens = np.ones(len(w), bool)  # the first word of a sentence or line
        opens[1:] = _STOP[data[w.ends[:-1] - 1]] | (lines[w.starts[1:]] > lines[w.ends[:-1]])
        opens[w.first[:-1][np.diff(w.first) > 0]] = True
        opens = opens[some]
        self.h = hash_spans(data, starts, ends)
        lead, second = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
        two = ends - starts > 1
        small = (second >= 97) & (second <= 122) | (second >= 0xC3)
        upper = (lead >= 65) & (lead <= 90) & two & small
        upper |= (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97) & (ends - starts > 2)
        self.kind = np.zeros(len(starts), np.uint8)
        self.kind[upper & ~opens] = NAME
        number = (lead >= 48) & (lead <= 57)
        self.kind[number] = NUMBER
        unit = np.zeros(len(starts), bool)
        unit[1:] = number[:-1]
        at = np.searchsorted(UNIT_HASHES, self.h).clip(0, len(UNIT_HASHES) - 1)
        self.kind[unit & (UNIT_HASHES[at] == self.h)] = UNIT
        self.t = np.where(self.kind > 0, mix(self.kind.astype(U64) + U64(0xA5A5A5A5)), self.h)
        self.words = np.append(0, np.cumsum(self.kind == 0))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the window of n tokens from each token on: its hash as a template and
        with its values, whether it ends in its document, and whether the template counts."""
        at = np.arange(len(self.t))
        ok = at + n <= np.repeat(self.first[1:], np.diff(self.first))
        ends = np.minimum(at + n, len(self.t))
        return hash_windows(self.t, n), mix(hash_windows(self.h, n) + U64(0x5A5A5A5A)), ok, ok & (self.words[ends] - self.words[at] >= LEAST_LITERAL * n)


ROWS = "id long, size int, at int, window long, literal boolean, slots array<long>"


def _windows(sizes: list[int], keep: np.ndarray | None):  # noqa: ANN202
    """A row per window with its values, which has no slots, and one per window whose
    template counts (literal), with the values of its slots.

    sizes[0] is WINDOW; for documents, keep is the filter of windows that some
    item has. For items (keep None), an item with fewer tokens than WINDOW has
    one window, of all its tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, "text"):
                ids = rows.column("id").to_numpy(zero_copy_only=False)
                t = Template(data, off)
                count = np.diff(t.first)
                doc = np.repeat(np.arange(len(count)), count)
                for n in sizes if keep is not None else sorted({min(WINDOW, c) for c in count.tolist() if c}):
                    template, raw, ok, literal = t.windows(n)
                    for h, own, slotted in ((template, literal, True), (raw, ok, False)):
                        if keep is not None:
                            own = own & (keep[(h >> U64(6)) & U64(len(keep) - 1)] >> (h & U64(63)) & U64(1)).astype(bool)
                        elif n < WINDOW:
                            own = own & (count == n)[doc]
                        at = np.flatnonzero(own)
                        for lo in range(0, len(at), 50_000):
                            p = at[lo : lo + 50_000]
                            slots = [t.h[i : i + n][t.kind[i : i + n] > 0].astype(np.int64).tolist() for i in p.tolist()] if slotted else [[]] * len(p)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(ids[doc[p]], pa.int64()), pa.array(np.full(len(p), n), pa.int32()), pa.array(p - t.first[doc[p]], pa.int32()), pa.array(h[p].astype(np.int64)), pa.array(literal[p]), pa.array(slots, pa.list_(pa.int64()))],
                                ["id", "size", "at", "window", "literal", "slots"],
                            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least_cover: float = LEAST_COVER) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id,
    n_windows, item_windows, coverage, reparameterised.

    A document holds an item if at least least_cover of the item's windows, or of
    those with LEAST_LITERAL words (coverage is the greater share), occur in it
    word for word or, with LEAST_LITERAL words, with consistent slots;
    reparameterised says that some slot has another value there. Null and empty
    texts hold nothing and are held by nothing. Rows without an id are
    left out; rows that repeat an id count as one document. Other columns are
    ignored.

    The item windows are hashed into a filter of at most FILTER_BITS, which
    executors apply as they scan; only windows that pass are joined, with a
    broadcast if the items have at most BROADCAST_WINDOWS windows.
    """
    spark = docs.sparkSession
    item = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").alias("text")).where("id is not null")
    item = store.save(item.mapInArrow(_windows([], None), ROWS).select(F.col("id").alias("item_id"), "size", F.col("at").alias("item_at"), "window", "literal", F.col("slots").alias("item_slots")), "items")
    n, sizes = item.agg(F.count("*"), F.collect_set("size")).first()
    words = 1 << max(4, min(FILTER_BITS // 64 - 1, max(1, n) // 4).bit_length())
    cells = item.select(F.shiftrightunsigned("window", 6).bitwiseAND(F.lit(words - 1)).alias("w"), F.expr("shiftleft(1L, cast(window & 63 as int))").alias("b"))
    keep = np.zeros(words, U64)
    for w, b in cells.groupBy("w").agg(F.expr("bit_or(b)")).toLocalIterator():
        keep[w] = np.int64(b).astype(U64)
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")).where("id is not null")
    d = d.mapInArrow(_windows(sorted(sizes or []), keep), ROWS).withColumnRenamed("id", "doc_id").drop("literal")
    hit = d.join(F.broadcast(item) if n <= BROADCAST_WINDOWS else item, ["window", "size"])
    hit = hit.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("off"), "item_at", "literal", F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")).alias("slots"))
    hit = store.save(hit, "hits")
    key = ["doc_id", "item_id", "off"]
    slot = hit.select(*key, F.explode("slots").alias("s"))
    slot = slot.groupBy(*key, F.col("s")["i"].alias("i")).agg(F.min(F.col("s")["d"]).alias("lo"), F.max(F.col("s")["d"]).alias("hi"))
    slot = slot.groupBy(*key).agg(F.max((F.col("lo") != F.col("i")) | (F.col("hi") != F.col("i"))).alias("changed"), F.collect_set(F.when(F.col("lo") != F.col("hi"), F.col("i"))).alias("torn"))  # an item's slots: bounded by its length
    whole = F.forall("slots", lambda s: ~F.array_contains("torn", s["i"]))
    good = hit.join(slot, key, "left").where(whole).select("doc_id", "item_id", F.coalesce("changed", F.lit(False)).alias("changed"), "item_at", "literal")
    place = good.groupBy("doc_id", "item_id", "item_at").agg(F.min("changed").alias("changed"), F.max("literal").alias("literal"))
    literal = F.when(F.col("literal"), F.col("item_at"))
    total = item.groupBy(F.col("item_id").alias("__item")).agg(F.countDistinct("item_at").alias("item_windows"), F.countDistinct(literal).alias("literal_windows"))
    out = place.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.count(literal).alias("n_literal"), F.max("changed").alias("reparameterised"))
    out = out.join(total, F.col("item_id") == F.col("__item")).withColumn("coverage", F.greatest(F.col("n_windows") / F.col("item_windows"), F.try_divide("n_literal", "literal_windows")))
    return out.where(F.col("coverage") >= least_cover).select("doc_id", "item_id", "n_windows", "item_windows", "coverage", "reparameterised")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    return store.without(docs, F.col("doc_id").cast("long"), contaminated(docs, benchmark).select("doc_id").distinct())
