"""The banking tables, mapped from the warehouse tables or read over JDBC.

Balances and amounts are whole cents, so sums, minima and counts are exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared keys: Spark enforces none, so they are kept here. child column -> (parent table, parent column)
PRIMARY_KEYS = {"branches": "bid", "accounts": "aid", "tellers": "tid"}
FOREIGN_KEYS = {("accounts", "bid"): ("branches", "bid"), ("tellers", "bid"): ("branches", "bid"), ("history", "aid"): ("accounts", "aid"), ("history", "bid"): ("branches", "bid")}

SCHEMAS = {
    "branches": T.StructType([T.StructField("bid", T.IntegerType()), T.StructField("bbalance", T.LongType()), T.StructField("filler", T.StringType())]),
    "accounts": T.StructType([T.StructField("aid", T.LongType()), T.StructField("bid", T.IntegerType()), T.StructField("abalance", T.LongType()), T.StructField("filler", T.StringType())]),
    "tellers": T.StructType([T.StructField("tid", T.LongType()), T.StructField("bid", T.IntegerType()), T.StructField("tbalance", T.LongType()), T.StructField("filler", T.StringType())]),
    "history": T.StructType([T.StructField("aid", T.LongType()), T.StructField("bid", T.IntegerType()), T.StructField("delta", T.LongType()), T.StructField("mtime", T.TimestampType()), T.StructField("filler", T.StringType())]),
}

# The seed rows of employees (name, position, salary, hire date).
EMPLOYEES = [
    ("Alice Smith", "Engineer", 90000, date(2023, 1, 15)),
    ("Bob Jones", "Manager", 120000, date(2022, 5, 20)),
    ("Charlie Brown", "Analyst", 75000, date(2023, 8, 10)),
    ("Diana Prince", "Director", 150000, date(2021, 11, 1)),
    ("Evan Wright", "Developer", 85000, date(2023, 3, 30)),
]


def cents(name: str):  # noqa: ANN201
    return F.round(F.col(name) * 100).cast("long")


@dataclass
class Bank:
    """The mapped tables of one directory; every member is a lazy DataFrame."""

    spark: SparkSession
    path: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def accounts(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("aid"), F.col("c_nationkey").alias("bid"), cents("c_acctbal").alias("abalance"), F.col("c_name").alias("filler"))

    @property
    def branches(self) -> DataFrame:
        total = self.accounts.groupBy("bid").agg(F.sum("abalance").alias("bbalance"))
        own = self.raw("nation").select(F.col("n_nationkey").alias("bid"), F.col("n_name").alias("filler"))
        return own.join(total, "bid", "left").select("bid", F.coalesce("bbalance", F.lit(0)).cast("long").alias("bbalance"), "filler")

    @property
    def tellers(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("tid"), F.col("s_nationkey").alias("bid"), cents("s_acctbal").alias("tbalance"), F.col("s_name").alias("filler"))

    @property
    def history(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_custkey").alias("aid"), cents("o_totalprice").alias("delta"), F.col("o_orderdate").alias("mtime"), F.col("o_orderpriority").alias("filler"))

    @property
    def activity(self) -> DataFrame:
        """Snapshots of running statements; events of type view count as active."""
        state = F.when(F.col("event_type") == "view", "active").otherwise("idle")
        return self.raw("events").select(F.col("event_id").alias("pid"), F.concat(F.lit("user"), F.col("user_id")).alias("usename"), F.lit("app_db").alias("datname"), state.alias("state"), F.col("props").alias("query"), F.col("ts").alias("query_start"))

    @property
    def problems(self) -> DataFrame:
        """Alerts from error events; those with an even id are resolved."""
        e = self.raw("events").where("event_type = 'error'")
        resolved = F.when(F.col("event_id") % 2 == 0, F.col("event_id"))
        return e.select(F.col("event_id").alias("eventid"), F.concat(F.lit("long running query by user "), F.col("user_id")).alias("name"), (F.col("event_id") % 6).cast("int").alias("severity"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("clock"), resolved.alias("r_eventid"))

    @property
    def employees(self) -> DataFrame:
        return self.spark.createDataFrame(EMPLOYEES, "name string, position string, salary int, hire_date date")

    def views(self, session: SparkSession | None = None) -> list[str]:
        """Registers every table as a temporary view and returns the names."""
        names = ["accounts", "branches", "tellers", "history", "activity", "problems"]
        own = Bank(session or self.spark, self.path)
        for n in names:
            getattr(own, n).createOrReplaceTempView(n)
        return names


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A table of a relational database, read in ranges of an integer key in parallel.

    Filters and columns are pushed to the database by Spark's JDBC source.
    Credentials belong in options at call time, never in code.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


#: The same mapping as SQL, in front of every oracle query.
ORACLE_VIEWS = """
accounts AS (SELECT c_custkey AS aid, c_nationkey AS bid, CAST(round(c_acctbal * 100) AS BIGINT) AS abalance, c_name AS filler FROM customer),
branches AS (SELECT n_nationkey AS bid, CAST(coalesce(t.s, 0) AS BIGINT) AS bbalance FROM nation LEFT JOIN (SELECT bid AS b, sum(abalance) AS s FROM accounts GROUP BY bid) t ON n_nationkey = t.b),
tellers AS (SELECT s_suppkey AS tid, s_nationkey AS bid, CAST(round(s_acctbal * 100) AS BIGINT) AS tbalance FROM supplier),
history AS (SELECT o_custkey AS aid, CAST(round(o_totalprice * 100) AS BIGINT) AS delta, o_orderdate AS mtime, o_orderpriority AS filler FROM orders),
activity AS (SELECT event_id AS pid, 'user' || user_id AS usename, 'app_db' AS datname, CASE WHEN event_type = 'view' THEN 'active' ELSE 'idle' END AS state, props AS query, ts AS query_start FROM events),
problems AS (SELECT event_id AS eventid, 'long running query by user ' || user_id AS name, CAST(event_id % 6 AS INTEGER) AS severity, CAST(floor(epoch(ts)) AS BIGINT) AS clock, CASE WHEN event_id % 2 = 0 THEN event_id END AS r_eventid FROM events WHERE event_type = 'error')
"""
