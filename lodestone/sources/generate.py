"""A generator of banking tables of any size, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCOUNTS, TELLERS = 100_000, 10  #: of each branch


def generate(spark: SparkSession, scale: int, seed: int = 1, accounts: int = ACCOUNTS) -> dict[str, DataFrame]:
    """scale branches with their tellers, accounts and one movement per account.

    Values are hashes of ids, so that partitions can be made anywhere, in any
    order, and again after a loss.
    """
    pick = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(salt)), F.lit(n))
    a = spark.range(1, scale * accounts + 1).select(F.col("id").alias("aid"), (F.floor((F.col("id") - 1) / accounts) + 1).cast("int").alias("bid"), (pick("id", 1_100_000, 1) - 100_000).alias("abalance"), F.lpad(F.col("id").cast("string"), 10, "0").alias("filler"))
    t = spark.range(1, scale * TELLERS + 1).select(F.col("id").alias("tid"), (F.floor((F.col("id") - 1) / TELLERS) + 1).cast("int").alias("bid"), pick("id", 1_000_000, 2).alias("tbalance"), F.lit("").alias("filler"))
    h = a.select("aid", "bid", (pick("aid", 10_001, 3) - 5_000).alias("delta"), F.timestamp_seconds(F.lit(1_700_000_000) + pick("aid", 86_400 * 30, 4)).alias("mtime"), F.lit("").alias("filler"))
    b = a.groupBy("bid").agg(F.sum("abalance").alias("bbalance")).withColumn("filler", F.lit(""))
    return {"branches": b, "tellers": t, "accounts": a, "history": h}
