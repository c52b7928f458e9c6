"""Queries that show the advisor, the catalog and the equivalence check as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..advisor import advise, rules
from ..advisor.rewrite import rewrite, rewrite_all
from ..equivalence import anchor_key, compare
from ..sources.bank import Bank
from ..sources.explorer import columns
from ..streaming.monitor import counted_stream
from .corpus import query

EXAMPLE = """
WITH movements AS (SELECT aid, delta FROM history)
SELECT a.aid, (SELECT count(*) FROM history h WHERE h.aid = a.aid) AS n,
       (SELECT max(delta) FROM history h WHERE h.aid = a.aid) AS most
FROM accounts a JOIN branches b ON CAST(a.bid AS STRING) = CAST(b.bid AS STRING)
CROSS JOIN movements m
WHERE a.aid <= 5000 AND m.aid <= 5000
ORDER BY n DESC
"""
SLOW = "SELECT a.aid, (SELECT count(*) FROM history h WHERE h.aid = a.aid) AS n, (SELECT coalesce(sum(delta), 0) FROM history h WHERE h.aid = a.aid) AS total FROM accounts a"
FAST = "SELECT a.aid, coalesce(t.n, 0) AS n, coalesce(t.total, 0) AS total FROM accounts a LEFT JOIN (SELECT aid AS k, count(*) AS n, sum(delta) AS total FROM history GROUP BY aid) t ON t.k = a.aid"


def _tables(b: Bank) -> dict[str, DataFrame]:
    return {n: getattr(b, n) for n in ("accounts", "branches", "tellers", "history")}


@query()
def advisor_bottlenecks(b: Bank) -> DataFrame:
    return rules.as_frame(b.spark, rules.detect(b.spark, EXAMPLE))


@query()
def advisor_suggestions(b: Bank) -> DataFrame:
    return advise.suggestions_frame(b.spark, advise.suggest(rules.detect(b.spark, EXAMPLE)))


@query("SELECT 'branches' AS anchor_table, 'bid' AS anchor_column")
def anchor(b: Bank) -> DataFrame:
    return b.spark.createDataFrame([anchor_key({n: d.columns for n, d in _tables(b).items()})], "anchor_table string, anchor_column string")


#: Statements that the rewriter changes; the SQL forms are the statements themselves.
CORRELATED = """SELECT a.aid AS aid, b.bbalance AS bbalance,
  (SELECT count(*) FROM history h WHERE h.aid = a.aid) AS n, (SELECT coalesce(sum(h.delta), 0) FROM history h WHERE h.aid = a.aid) AS total,
  (SELECT max(h.mtime) FROM history h WHERE h.aid = a.aid AND h.filler = '1-URGENT') AS last_urgent
FROM accounts a JOIN branches b ON a.bid = b.bid
WHERE a.abalance > 0"""
FILTERED = """WITH per AS (SELECT h.aid AS who, count(*) AS n, max(h.delta) AS most FROM history h GROUP BY h.aid)
SELECT p.who AS who, p.n AS n, p.most AS most, a.abalance AS abalance FROM per p JOIN accounts a ON a.aid = p.who WHERE p.n >= 3 AND p.who <= 1200 AND a.abalance > 0"""
PEERS = "SELECT x.aid, count(*) AS peers FROM accounts x JOIN accounts y ON x.bid = y.bid AND x.aid <> y.aid GROUP BY x.aid"


def _rewritten(b: Bank, sql: str, rewriter=rewrite) -> DataFrame:  # noqa: ANN001
    """The result of a statement as the advisor rewrites it."""
    s = b.spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        s.conf.set(k, b.spark.conf.get(k))
    Bank(s, b.path).views()
    report = advise.optimize(s, sql, rewriter)
    if report.optimized == sql:
        raise ValueError(f"not rewritten: {report.notes}")
    return s.sql(report.optimized)


@query(CORRELATED)
def rewritten_subqueries(b: Bank) -> DataFrame:
    """Three correlated subqueries as two aggregates and two left joins, by the text rewriter."""
    return _rewritten(b, CORRELATED)


@query("SELECT * FROM (" + FILTERED + ")")
def rewritten_filters(b: Bank) -> DataFrame:
    """Filters moved into the WHERE and the HAVING of a common table expression."""
    return _rewritten(b, FILTERED)


@query("SELECT aid, peers FROM (" + PEERS + ")")
def rewritten_peers(b: Bank) -> DataFrame:
    """A counting self-join as a window count; ids are unique."""
    return _rewritten(b, PEERS, rewrite_all)


@query()
def catalog_columns(b: Bank) -> DataFrame:
    return columns(b.spark, b.views())


@query()
def equivalence_report(b: Bank) -> DataFrame:
    """The consolidated rewrite against the correlated original, on shadow samples and on all rows."""
    out = []
    for sample in (True, False):
        r = compare(b.spark, SLOW, FAST, _tables(b), sample)
        out.append(("sample" if sample else "all", r["results_match"], r["rows"][0], r["rows"][1], ".".join(r["anchor"]) if r["anchor"] else None, len(r["sampled_keys"])))
    return b.spark.createDataFrame(out, "data string, results_match boolean, rows_before long, rows_after long, anchor string, sampled_keys int")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY ALL")
def extension_stream_counts(b: Bank) -> DataFrame:
    """An extension: tumbling counts of events, computed by Structured Streaming."""
    return counted_stream(b.spark, b.path)


@query("SELECT bid, abalance > 0 AS positive, count(*) AS n, CAST(sum(abalance) AS BIGINT) AS total FROM (SELECT bid, abalance FROM accounts) GROUP BY ROLLUP (bid, positive)")
def extension_rollup(b: Bank) -> DataFrame:
    from pyspark.sql import functions as F

    return b.accounts.withColumn("positive", F.col("abalance") > 0).rollup("bid", "positive").agg(F.count("*").alias("n"), F.sum("abalance").alias("total"))


@query("SELECT aid, bid FROM accounts a WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.aid = a.aid AND h.filler = '1-URGENT')")
def extension_anti_join(b: Bank) -> DataFrame:
    return b.accounts.select("aid", "bid").join(b.history.where("filler = '1-URGENT'").select("aid"), "aid", "left_anti")
