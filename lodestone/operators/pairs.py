"""Sums over all ordered pairs of rows, without making the pairs."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Functions that run on executors travel by value, so that executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET_ROWS = 16_384  #: rows of a bucket; more where buckets would outnumber the cube root of the rows
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "d")
_OUT = "e1 int, e2 int, " + ", ".join(f"{k} decimal(38,0)" for k in SUMS)


def ordered_pair_sums(df: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Sums over all pairs of rows with left id < right id.

    df has id, grp, x and w (integers; few values of w in a group). Returns per (grp1,
    grp2) the weight n of the pairs and the weighted sums sx, sy, sxx, syy, sxy and d
    (of abs(x1 - x2)); a null x counts in n and in the sums that do not need it.

    Rows lie in buckets of ids and in buckets of x. Pairs in one bucket of ids are summed
    there; so is d of pairs in one bucket of x and in different ones of ids. All other
    pairs are products of sums over the cells of the grid of both. Within a bucket, two
    rows differ in their ranks first at one bit: for each bit, running sums by group in
    order of x. The result does not depend on where buckets begin. A row travels twice,
    and a task holds one bucket: n log(n) steps for each group.
    """
    spark = df.sparkSession
    d = df.where("id is not null").select(F.col("id").cast("long").alias("id"), "grp", F.col("x").cast("long").alias("x"), F.col("w").cast("long").alias("w"))
    kinds = [(k, *r) for k, r in enumerate(d.select("grp", "w", F.col("x").isNull().alias("none")).distinct().collect())]
    schema = f"e int, kind_grp {d.schema['grp'].dataType.simpleString()}, kind_w long, none boolean"
    kind = F.broadcast(spark.createDataFrame(kinds, schema))
    n = d.count()
    buckets = max(1, min(n // bucket_rows + 1, round(n ** (1 / 3))))
    at = [k / buckets for k in range(1, buckets)]
    bounds = [[], []]
    if at:
        q = d.select(*[F.percentile_approx(c, F.array(*[F.lit(p) for p in at]), max(10_000, 20 * buckets)).alias(c) for c in ("id", "x")]).first()
        bounds = [sorted(set(q[c] or [])) for c in ("id", "x")]
    same = F.col("grp").eqNullSafe(F.col("kind_grp")) & (F.col("w") == F.col("kind_w")) & (F.col("x").isNull() == F.col("none"))
    cut = d.join(kind, same).select("id", "e", F.coalesce("x", F.lit(0)).alias("x"), "none").mapInArrow(_cut(bounds), "ib int, xb int, pos long, e int, x long, none boolean")
    # Odd buckets hold one id, or one x: nothing to sum within them.
    ids, xs = len(bounds[0]) + 1, len(bounds[1]) + 1
    near = cut.where("ib % 2 = 0").selectExpr("cast(ib div 2 as int) as part", "true as whole", "pos", "e", "x", "none")
    near = near.union(cut.where("xb % 2 = 0 and not none").selectExpr(f"cast({ids} + xb div 2 as int)", "false", "cast(ib as long)", "e", "x", "none"))
    near = near.repartitionById(ids + xs, "part").mapInArrow(_bucket(len(kinds)), _OUT)
    cells = cut.groupBy("ib", "xb", "e").agg(F.count("*").alias("c"), F.sum("x").alias("s"), F.sum((F.col("x").cast("decimal(19,0)") * F.col("x").cast("decimal(19,0)")).cast("decimal(38,0)")).alias("ss"))
    far = cells.repartition(1).sortWithinPartitions("ib").mapInArrow(_grid(2 * xs, [k[3] for k in kinds]), _OUT)
    of = lambda i: kind.select(F.col("e").alias(f"e{i}"), F.col("kind_grp").alias(f"grp{i}"), F.col("kind_w").alias(f"w{i}"))
    pairs = near.union(far).groupBy("e1", "e2").agg(*[F.sum(k).alias(k) for k in SUMS]).join(of(1), "e1").join(of(2), "e2")
    weight = F.col("w1").cast("decimal(19,0)") * F.col("w2").cast("decimal(19,0)")
    return pairs.groupBy("grp1", "grp2").agg(*[F.sum((F.col(k) * weight.cast("decimal(38,0)")).cast("decimal(38,0)")).alias(k) for k in SUMS])


def _cut(bounds: list[list[int]]):  # noqa: ANN202
    """Gives rows their buckets: 2 i between bounds, 2 i + 1 for the values of bound i itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_id, of_x = (np.array(b, np.int64) for b in bounds)
        place = lambda b, v: (np.searchsorted(b, v, "left") + np.searchsorted(b, v, "right")).astype(np.int32)
        for batch in batches:
            i, x = (np.asarray(batch.column(c)) for c in ("id", "x"))
            yield pa.RecordBatch.from_arrays([pa.array(place(of_id, i)), pa.array(place(of_x, x)), batch.column("id"), batch.column("e"), batch.column("x"), batch.column("none")], ["ib", "xb", "pos", "e", "x", "none"])

    return run


def _rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    e1, e2 = np.nonzero(sum(s != 0 for s in sums.values()))
    columns = [pa.array([Decimal(int(v)) for v in sums[k][e1, e2]], pa.decimal128(38, 0)) for k in SUMS]
    yield pa.RecordBatch.from_arrays([pa.array(e1.astype(np.int32)), pa.array(e2.astype(np.int32)), *columns], ["e1", "e2", *SUMS])


def _zeros(groups: int) -> np.ndarray:
    return np.full((groups, groups), 0, object)


def _before(v: np.ndarray) -> np.ndarray:
    """Running sums: at k the sum of what is before k."""
    return np.concatenate([np.zeros(1, v.dtype), np.cumsum(v)])


def _by(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Exact sums of v between cuts; the two halves of each number are added up apart."""
    high, low = (_before(h)[cuts].astype(object) for h in (v >> 31, v & (1 << 31) - 1))
    return np.diff(high) * (1 << 31) + np.diff(low)


def _moments(pos: np.ndarray, e: np.ndarray, x: np.ndarray, groups: int) -> dict[str, np.ndarray]:
    """All sums but d over pairs with pos1 < pos2, by group."""
    order = np.argsort(pos, kind="stable")
    pos, e, x = pos[order], e[order], x[order]
    right = np.argsort(e, kind="stable")
    cuts = np.searchsorted(e[right], np.arange(groups + 1))
    first = np.searchsorted(pos, pos, "left")[right]
    y = x[right]
    out = {k: _zeros(groups) for k in SUMS}
    for g in np.unique(e):
        own = e == g
        n, s, ss = (_before(np.where(own, v, 0 * v))[first] for v in (own.astype(np.int64), x, x * x))
        for k, v in (("n", n), ("sx", s), ("sxx", ss), ("sy", y * n), ("syy", y * y * n), ("sxy", y * s)):
            out[k][g] += _by(v, cuts)
    return out


def _spread(pos: np.ndarray, e: np.ndarray, x: np.ndarray, groups: int) -> np.ndarray:
    """The sum of abs(x1 - x2) over pairs with pos1 < pos2, by group."""
    out = _zeros(groups)
    if not len(pos):
        return out
    pos = np.unique(pos, return_inverse=True)[1]
    order = np.argsort(x, kind="stable")
    pos, e, x = pos[order], e[order], x[order]
    x = x - x[0]
    for bit in range(int(pos.max()).bit_length()):
        cell = pos >> (bit + 1)
        order = np.argsort(cell, kind="stable")  # by x within a cell
        c, f, y, late = cell[order], e[order], x[order], (pos[order] >> bit & 1).astype(bool)
        right = np.flatnonzero(late)
        right = right[np.argsort(f[right], kind="stable")]
        cuts = np.searchsorted(f[right], np.arange(groups + 1))
        begin, end = np.searchsorted(c, c[right], "left"), np.searchsorted(c, c[right], "right")
        z = y[right]
        for g in np.unique(f[~late]):
            own = (f == g) & ~late
            n, s = _before(own.astype(np.int64)), _before(np.where(own, y, 0 * y))
            # Below z: z - x, n[right] - n[begin] times; above: x - z.
            out[g] += _by(z * (2 * n[right] - n[begin] - n[end]) - (2 * s[right] - s[begin] - s[end]), cuts)
    return out


def _bucket(groups: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(map(len, rows)):
            return
        rows = pa.Table.from_batches(rows)
        pos, e, x, none = (np.concatenate([np.asarray(a) for a in (y.to_numpy(zero_copy_only=False) for y in rows.column(c).chunks)]) for c in ("pos", "e", "x", "none"))
        most = max(abs(int(x.min())), abs(int(x.max())), 1)
        if 4 * most * most * len(x) >= 1 << 62:
            x = x.astype(object)
        out = _moments(pos, e, x, groups) if rows.column("whole")[0].as_py() else {k: _zeros(groups) for k in SUMS}
        known = ~none.astype(bool)
        out["d"] = _spread(pos[known], e[known], x[known], groups)
        yield from _rows(out)

    return run


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a transposed times b, exactly; factors that are too large are split."""
    top, other = (max(abs(int(v.min())), abs(int(v.max()))) for v in (a, b))
    if top * other * len(a) < 1 << 62:
        return (a.T @ b).astype(object)
    if top < other:
        return _product(b, a).T
    half = top.bit_length() // 2
    return _product(a >> half, b) * (1 << half) + _product(a & (1 << half) - 1, b)


def _grid(places: int, none: list[bool]):  # noqa: ANN202
    """Pairs in different buckets of ids from the sums of cells, which come in order of these buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = len(none)
        out = {k: _zeros(groups) for k in SUMS}
        total = [np.full(groups, 0, object) for _ in range(3)]
        n, s = np.zeros((places, groups), np.int64), np.zeros((places, groups), np.int64)

        def add(part: list[tuple]) -> None:
            own = [np.full(groups, 0, object) for _ in range(3)]
            m, t = np.zeros_like(n), np.zeros_like(s)
            for _, xb, e, c, sx, ss in part:
                own[0][e] += c
                own[1][e] += sx
                own[2][e] += int(ss)
                if not none[e]:
                    m[xb, e] += c
                    t[xb, e] += sx
            for k, a, b in (("n", 0, 0), ("sx", 1, 0), ("sxx", 2, 0), ("sy", 0, 1), ("syy", 0, 2), ("sxy", 1, 1)):
                out[k] += np.outer(total[a], own[b])
            below = lambda v: np.cumsum(v, axis=0) - v
            apart = lambda v: 2 * below(v) + v - v.sum(axis=0)  # noqa: E731  below less above
            out["d"] += _product(apart(n), t) - _product(apart(s), m)
            for a, b in zip(total, own, strict=True):
                a += b
            n[:], s[:] = n + m, s + t

        part: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("ib", "xb", "e", "c", "s", "ss")), strict=True):
                if part and part[0][0] != row[0]:
                    add(part)
                    part = []
                part.append(row)
        if part:
            add(part)
            yield from _rows(out)

    return run


def spreads(df: DataFrame) -> DataFrame:
    """df with n sxx - sx^2, n syy - sy^2 and n sxy - sx sy as doubles vx, vy and cov.
    The products can have more digits than DECIMAL; df is small (a row per pair of groups)."""
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sx, sy, sxx, syy, sxy = ([int(v) for v in batch.column(k).to_pylist()] for k in ("n", "sx", "sy", "sxx", "syy", "sxy"))
            of = lambda a, b, c: pa.array([float(m * p - q * r) for m, p, q, r in zip(n, a, b, c, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, of(sxx, sx, sx), of(syy, sy, sy), of(sxy, sx, sy)], [*keep, "vx", "vy", "cov"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", vx double, vy double, cov double")
