"""Single operators of the query language, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bank import Bank
from .corpus import query


@query("SELECT b.bid AS bid, t.tid AS tid, t.tbalance AS tbalance FROM tellers t RIGHT JOIN branches b ON t.bid = b.bid")
def join_right(b: Bank) -> DataFrame:
    return b.tellers.join(b.branches.select("bid"), "bid", "right").select("bid", "tid", "tbalance")


@query("SELECT t.tid AS tid, a.aid AS aid FROM tellers t FULL JOIN accounts a ON t.tid = a.aid")
def join_full(b: Bank) -> DataFrame:
    t, a = b.tellers, b.accounts
    return t.join(a, t["tid"] == a["aid"], "full").select("tid", "aid")


@query("SELECT x.bid AS bid, r.r_regionkey AS region FROM branches x CROSS JOIN region r")
def join_cross(b: Bank) -> DataFrame:
    """Two fixed dimensions."""
    return b.branches.select("bid").crossJoin(b.raw("region").select(F.col("r_regionkey").alias("region")))


@query("SELECT aid, bid FROM accounts WHERE aid IN (SELECT aid FROM history GROUP BY aid HAVING count(*) >= 12)")
def join_semi(b: Bank) -> DataFrame:
    busy = b.history.groupBy("aid").count().where("count >= 12")
    return b.accounts.select("aid", "bid").join(busy, "aid", "left_semi")


@query(
    """SELECT aid, bid, abs(abalance) AS size, abalance % 97 AS rest, CAST(power(abalance % 10, 2) AS DOUBLE) AS square, round(abalance / 100.0::DOUBLE, 1) AS units,
       least(abalance, 500000) AS low, greatest(abalance, 500000) AS high, left(filler, 4) AS head, CAST(length(rtrim(filler)) AS INTEGER) AS width, filler || '-' || aid AS tag, md5(CAST(aid AS VARCHAR)) AS mark,
       CASE WHEN abalance < 0 THEN 'debt' WHEN abalance BETWEEN 0 AND 99999 THEN 'small' ELSE 'large' END AS class, coalesce(nullif(bid, 0), -1) AS branch
FROM accounts WHERE filler LIKE '%1%' AND filler NOT ILIKE '%CUSTOMER#0000000002%' AND bid IN (0, 1, 2, 3, 5, 8, 13, 21) AND NOT (abalance IS NULL)"""
)
def scalar_functions(b: Bank) -> DataFrame:
    x = F.col("abalance")
    a = b.accounts.where(F.col("filler").like("%1%") & ~F.col("filler").ilike("%CUSTOMER#0000000002%") & F.col("bid").isin(0, 1, 2, 3, 5, 8, 13, 21) & x.isNotNull())
    size = F.when(x < 0, "debt").when(x.between(0, 99_999), "small").otherwise("large")
    return a.select(
        "aid", "bid", F.abs(x).alias("size"), (x % 97).alias("rest"), F.power(x % 10, F.lit(2)).alias("square"), F.round(x / 100, 1).alias("units"), F.least(x, F.lit(500_000)).alias("low"), F.greatest(x, F.lit(500_000)).alias("high"),
        F.left("filler", F.lit(4)).alias("head"), F.length(F.rtrim("filler")).alias("width"), F.concat("filler", F.lit("-"), F.col("aid").cast("string")).alias("tag"), F.md5(F.col("aid").cast("string")).alias("mark"),
        size.alias("class"), F.coalesce(F.nullif("bid", F.lit(0)), F.lit(-1)).alias("branch"),
    )


@query(
    """SELECT aid, CAST(mtime AS DATE) AS day, CAST(date_trunc('month', mtime) AS DATE) AS month, CAST(extract(year FROM mtime) AS INTEGER) AS year,
       CAST(mtime - INTERVAL '15 minutes' AS TIMESTAMP) AS earlier, CAST(floor(epoch(mtime)) AS BIGINT) AS seconds FROM history WHERE mtime >= TIMESTAMP '1998-01-01' AND delta > 10000000"""
)
def date_functions(b: Bank) -> DataFrame:
    m = F.col("mtime")
    h = b.history.where((m >= F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'")) & (F.col("delta") > 10_000_000))
    return h.select("aid", m.cast("date").alias("day"), F.trunc(m, "month").alias("month"), F.year(m).alias("year"), F.expr("mtime - INTERVAL '15' MINUTE").alias("earlier"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', mtime)").alias("seconds"))


@query("SELECT bid FROM accounts UNION SELECT bid FROM tellers")
def set_union(b: Bank) -> DataFrame:
    return b.accounts.select("bid").union(b.tellers.select("bid")).distinct()


@query("SELECT aid FROM accounts INTERSECT SELECT aid FROM history WHERE filler = '1-URGENT'")
def set_intersect(b: Bank) -> DataFrame:
    return b.accounts.select("aid").intersect(b.history.where("filler = '1-URGENT'").select("aid"))


@query("SELECT aid FROM accounts EXCEPT SELECT aid FROM history WHERE filler = '1-URGENT'")
def set_except(b: Bank) -> DataFrame:
    return b.accounts.select("aid").subtract(b.history.where("filler = '1-URGENT'").select("aid"))


@query("SELECT aid, abalance FROM accounts ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20 OFFSET 10")
def order_offset(b: Bank) -> DataFrame:
    return b.accounts.select("aid", "abalance").orderBy(F.desc_nulls_last("abalance"), "aid").offset(10).limit(20)


@query("SELECT CAST(i AS BIGINT) AS i, CAST(i % 7 AS BIGINT) AS r FROM generate_series(1, 5000) g(i) WHERE i % 3 = 0")
def generated_series(b: Bank) -> DataFrame:
    """Distributed from the start: a range, not an exploded array."""
    return b.spark.range(1, 5001).where("id % 3 = 0").select(F.col("id").alias("i"), (F.col("id") % 7).alias("r"))


@query("SELECT bid, count(*) AS n, count(DISTINCT filler) AS kinds, CAST(sum(CASE WHEN abalance > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, min(abalance) AS low, max(abalance) AS high, CAST(max(length(filler)) AS INTEGER) AS longest FROM accounts GROUP BY bid HAVING count(*) > 5")
def group_having(b: Bank) -> DataFrame:
    x = F.col("abalance")
    g = b.accounts.groupBy("bid").agg(F.count("*").alias("n"), F.count_distinct("filler").alias("kinds"), F.sum(F.when(x > 0, 1).otherwise(0)).alias("positive"), F.min(x).alias("low"), F.max(x).alias("high"), F.max(F.length("filler")).alias("longest"))
    return g.where("n > 5")


@query("SELECT bid, aid, count(*) OVER (PARTITION BY bid) AS n, CAST(sum(abalance) OVER (PARTITION BY bid) AS BIGINT) AS total, last_value(aid) OVER w AS last_aid, nth_value(aid, 2) OVER w AS second_aid FROM accounts WINDOW w AS (PARTITION BY bid ORDER BY abalance, aid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def window_whole(b: Bank) -> DataFrame:
    p = Window.partitionBy("bid")
    w = p.orderBy("abalance", "aid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return b.accounts.select("bid", "aid", F.count("*").over(p).alias("n"), F.sum("abalance").over(p).alias("total"), F.last("aid").over(w).alias("last_aid"), F.nth_value("aid", 2).over(w).alias("second_aid"))


@query("SELECT aid, bid, abalance FROM accounts WHERE CAST(md5(CAST(aid AS VARCHAR)) AS VARCHAR) < '1'")
def sampled_scan(b: Bank) -> DataFrame:
    """A repeatable sample: rows whose hash falls in a sixteenth of its range."""
    return b.accounts.where(F.md5(F.col("aid").cast("string")) < "1").select("aid", "bid", "abalance")


@query("SELECT event_type, CAST(min(value) AS DOUBLE) AS low, count(*) FILTER (props IS NOT NULL) AS n FROM events GROUP BY event_type")
def extension_event_types(b: Bank) -> DataFrame:
    return b.raw("events").groupBy("event_type").agg(F.min("value").alias("low"), F.count("props").alias("n"))
