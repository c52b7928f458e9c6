"""Long-running statements and alerts over snapshots of the activity table.

The current time is a parameter. Over a live system, activity is a JDBC read or
a stream of snapshots; see lodestone.streaming.monitor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.bank import Bank
from .corpus import query

NOW = "2024-01-31 00:00:00"


def seconds(now: str = NOW) -> Column:
    """Age of a statement in seconds, as double."""
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("query_start").cast("timestamp"))) / 1e6


def running(activity: DataFrame, over_s: float, now: str = NOW) -> DataFrame:
    """Active statements, but for those of the monitor itself, older than over_s."""
    own = F.col("query").ilike("%pg_stat_activity%")
    return activity.where((F.col("state") == "active") & ~own & (seconds(now) > over_s))


def count_long(activity: DataFrame, over_s: float = 5, now: str = NOW) -> DataFrame:
    return running(activity, over_s, now).agg(F.count("*").alias("long_queries"))


def detail_long(activity: DataFrame, over_s: float = 5, now: str = NOW) -> DataFrame:
    d = running(activity, over_s, now)
    return d.select("pid", F.col("usename").alias("username"), F.col("datname").alias("database"), "query_start", F.round(seconds(now)).cast("int").alias("duration_seconds"), "state", F.left("query", F.lit(200)).alias("query_text")).orderBy(F.desc("duration_seconds"), "pid")


_AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(query_start)) / 1e6"
_RUN = "FROM activity WHERE state = 'active' AND query NOT ILIKE '%pg_stat_activity%'"


@query(f"SELECT count(*) AS long_queries {_RUN} AND {_AGE} > 5")
def long_query_count(b: Bank) -> DataFrame:
    return count_long(b.activity)


@query(f"SELECT pid, usename AS username, datname AS database, query_start, CAST(round({_AGE}) AS INTEGER) AS duration_seconds, state, left(query, 200) AS query_text {_RUN} AND {_AGE} > 5")
def long_query_detail(b: Bank) -> DataFrame:
    return detail_long(b.activity)


@query(f"SELECT pid, usename, datname, state, CAST(round({_AGE}) AS INTEGER) AS duration_seconds, round(round({_AGE}) / 60, 2) AS duration_minutes, left(query, 100) AS query_preview, query_start {_RUN} AND {_AGE} > 900 AND datname = 'app_db'")
def long_query_detail_15m(b: Bank) -> DataFrame:
    s = F.round(seconds())
    d = running(b.activity, 900).where("datname = 'app_db'")
    return d.select("pid", "usename", "datname", "state", s.cast("int").alias("duration_seconds"), F.round(s / 60, 2).alias("duration_minutes"), F.left("query", F.lit(100)).alias("query_preview"), "query_start").orderBy("query_start", "pid")


@query(f"SELECT coalesce(CAST(round(max({_AGE})) AS INTEGER), 0) AS max_query_duration_seconds {_RUN} AND datname = 'app_db'")
def max_duration(b: Bank) -> DataFrame:
    d = b.activity.where((F.col("state") == "active") & ~F.col("query").like("%pg_stat_activity%") & (F.col("datname") == "app_db"))
    return d.agg(F.coalesce(F.round(F.max(seconds())).cast("int"), F.lit(0)).alias("max_query_duration_seconds"))


@query("SELECT eventid, name, severity, to_timestamp(clock)::TIMESTAMP AS event_time FROM problems WHERE name LIKE '%long running query%' AND r_eventid IS NULL ORDER BY clock DESC, eventid DESC LIMIT 10")
def active_alerts(b: Bank) -> DataFrame:
    open_ = b.problems.where(F.col("name").like("%long running query%") & F.col("r_eventid").isNull())
    return open_.orderBy(F.desc("clock"), F.desc("eventid")).limit(10).select("eventid", "name", "severity", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, clock)").alias("event_time"))


def statements(spark) -> DataFrame:  # noqa: ANN001
    """What this application runs now: job_id, status, its stages, tasks active and done."""
    t = spark.sparkContext.statusTracker()
    rows = []
    for j in t.getActiveJobsIds():
        info = t.getJobInfo(j)
        stages = [s for s in (t.getStageInfo(i) for i in (info.stageIds if info else [])) if s]
        rows.append((int(j), info.status if info else "UNKNOWN", len(stages), sum(s.numActiveTasks for s in stages), sum(s.numCompletedTasks for s in stages)))
    return spark.createDataFrame(rows, "job_id int, status string, stages int, active_tasks int, done_tasks int")


def kill(spark, tag: str) -> list[str]:  # noqa: ANN001
    """Stops what this session runs under a tag; the interrupted operations' ids."""
    return spark.interruptTag(tag)


def resolve_alert(problems: DataFrame, eventid: int, stop, fast) -> dict:  # noqa: ANN001
    """Check that an alert is open, stop the statements behind it, run the replacement.

    stop() returns how many it stopped; fast() returns the replacement's
    DataFrame. The status says what was done; it never claims that the
    replacement answers the stopped statement.
    """
    alert = problems.where((F.col("eventid") == eventid) & F.col("r_eventid").isNull()).limit(1).collect()
    if not alert:
        return {"eventid": eventid, "status": "NOT_ACTIVE", "killed": 0, "rows": None}
    killed = stop()
    return {"eventid": eventid, "status": "STOPPED" if killed else "NOTHING_RUNNING", "killed": killed, "rows": fast().count()}


def preview(problems: DataFrame, eventid: int) -> list[str]:
    """The steps that resolve_alert would take."""
    return [f"check that alert {eventid} is open", "stop the statements behind it", "run the replacement query and count its rows"]
