"""Do two statements return the same rows? On all data, or on key-consistent samples."""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ranks import ensure_checkpoints
from .sources.bank import FOREIGN_KEYS, PRIMARY_KEYS

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def safe_name(name: str) -> str:
    """name, if it is a plain identifier; ValueError otherwise."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name


def anchor_key(tables: dict[str, list[str]], foreign=FOREIGN_KEYS, primary=PRIMARY_KEYS) -> tuple[str, str] | None:  # noqa: ANN001
    """(table, column) whose keys relate the given tables: the parent that most of
    them refer to by declared keys; else a column ending in id that most of them
    share, anchored at one of just these tables. None for unrelated tables."""
    votes: dict[tuple[str, str], set[str]] = {}
    for (child, _), parent in foreign.items():
        if child in tables and parent[0] in tables:
            votes.setdefault(parent, {parent[0]}).add(child)
    if votes:
        return min(votes, key=lambda k: (-len(votes[k]), k))
    shared: dict[str, list[str]] = {}
    for t, cols in sorted(tables.items()):
        for c in cols:
            if c.lower().endswith("id"):
                shared.setdefault(c, []).append(t)
    best = [c for c, ts in shared.items() if len(ts) > 1]
    if not best:
        return None
    c = min(best, key=lambda c: (-len(shared[c]), c))
    own = [t for t in shared[c] if primary.get(t) == c]
    return (own or shared[c])[0], c


def shadow_views(spark: SparkSession, tables: dict[str, DataFrame], keys: int = 5, rest: int = 1000) -> tuple[SparkSession, tuple[str, str] | None, list]:
    """A new session in which the tables' names are views of consistent samples.

    The anchor's keys are chosen by the order of a hash; tables that have the
    anchor column keep its rows for them, other tables their first rows by a hash
    of all columns. The samples are small by construction.
    """
    anchor = anchor_key({n: d.columns for n, d in tables.items()})
    s = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        s.conf.set(k, spark.conf.get(k))
    picked = []
    if anchor:
        c = anchor[1]
        picked = [r[0] for r in tables[anchor[0]].select(c).where(F.col(c).isNotNull()).distinct().orderBy(F.xxhash64(c), c).limit(keys).collect()]
    for n, d in tables.items():
        part = d.where(F.col(anchor[1]).isin(picked)) if anchor and anchor[1] in d.columns else d.orderBy(F.xxhash64(*d.columns)).limit(rest)
        _show(part, s, n)
    return s, anchor, picked


def _show(df: DataFrame, session: SparkSession, name: str) -> None:
    """Makes df a temporary view of another session of the same application."""
    own = f"v_{uuid.uuid4().hex}"
    df.createOrReplaceGlobalTempView(own)
    session.sql(f"CREATE OR REPLACE TEMPORARY VIEW {safe_name(name)} AS SELECT * FROM global_temp.{own}")


@dataclass(frozen=True)
class Verdict:
    valid: bool
    reason: str
    rows: tuple[int, int]
    differences: list


def _mark(df: DataFrame) -> tuple[int, int]:
    """Row count and a sum of row hashes: equal for equal multisets in any order."""
    r = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)


def same_rows(a: DataFrame, b: DataFrame, show: int = 10) -> Verdict:
    """Names, then counts and hashes; on a difference, up to show rows with how many
    more of them the first side has (__more)."""
    if a.columns != b.columns:
        return Verdict(False, f"columns differ: {a.columns} and {b.columns}", (-1, -1), [])
    (n, h), (m, k) = _mark(a), _mark(b)
    if (n, h) == (m, k):
        return Verdict(True, "same rows", (n, m), [])
    # Both sides are cut from their plans: as one plan, statements over the same views share attributes.
    ensure_checkpoints(a)
    a, b = a.checkpoint(), b.checkpoint()
    signed = a.withColumn("__side", F.lit(1)).union(b.withColumn("__side", F.lit(-1)))
    only = signed.groupBy(*a.columns).agg(F.sum("__side").alias("__more")).where("__more <> 0").limit(show).collect()
    return Verdict(not only, "row counts differ" if n != m else "rows differ" if only else "same rows", (n, m), only)


def seconds(df: DataFrame, limit: float | None = None) -> float | None:
    """Wall clock of a whole run whose rows go nowhere; None if it reached the limit, at
    which its jobs are cancelled."""
    sc, group, late = df.sparkSession.sparkContext, f"timed-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(limit, stop) if limit else None
    if timer:
        sc.setJobGroup(group, "a run with a time limit", interruptOnCancel=True)
        timer.start()
    t = time.perf_counter()
    try:
        df.write.format("noop").mode("overwrite").save()
    except Exception:
        if not late.is_set():
            raise
    finally:
        if timer:
            timer.cancel()
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                sc.setLocalProperty(name, None)
    return None if late.is_set() else time.perf_counter() - t


def cost(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes that the plan's relations hold: what is left to compare when time is up."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def speedup(before: float, after: float) -> str:
    if before > 0 and after > 0:
        return f"{before / after:.1f}x faster" if after < before else f"{after / before:.1f}x slower (Regression)"
    return "Instant" if before > 0 else "N/A"


def compare(spark: SparkSession, before: str, after: str, tables: dict[str, DataFrame], sample: bool = False, limit: float | None = None) -> dict:
    """Runs both statements on the same data (whole, or shadow samples) and reports
    equality, times and the speedup label.

    A side that fails is reported under errors. With limit, in seconds, a side that
    takes longer is stopped; then rows are not compared, and cost holds what both
    plans read by the optimizer's estimate.
    """
    if sample:
        s, anchor, keys = shadow_views(spark, tables)
    else:
        s, anchor, keys = spark.newSession(), None, []
        for n, d in tables.items():
            _show(d, s, n)
    out = {"results_match": False, "reason": "", "rows": (-1, -1), "differences": [], "anchor": anchor, "sampled_keys": keys, "seconds": (None, None), "speedup": "N/A", "errors": {}, "cost": None}
    sides, times = {}, {}
    for name, sql in (("before", before), ("after", after)):
        try:
            sides[name] = s.sql(sql)
            times[name] = seconds(sides[name], limit)
        except PySparkException as e:
            out["errors"][name] = str(e).splitlines()[0]
    if out["errors"]:
        return out | {"reason": "; ".join(f"{k} fails: {v}" for k, v in out["errors"].items())}
    t = times["before"], times["after"]
    if None in t:
        return out | {"reason": f"stopped after {limit:g} s", "seconds": t, "cost": tuple(cost(d) for d in sides.values())}
    v = same_rows(sides["before"], sides["after"])
    return out | {"results_match": v.valid, "reason": v.reason, "rows": v.rows, "differences": v.differences, "seconds": t, "speedup": speedup(*t)}
