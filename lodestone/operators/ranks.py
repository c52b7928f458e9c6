"""Global ranks without a single-partition window on large inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_BYTES = 64 << 20  #: below this (by the plan's statistics) one sorted partition is cheaper


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def numbered(df: DataFrame, *order: str | Column, small_bytes: int = SMALL_BYTES, name: str = "rn", total: str = "n") -> DataFrame:
    """df with each row's number (from 1) in a total order, and the number of rows.

    The order must be unique.
    """
    d = sums_before(df.withColumn("__one", F.lit(1)), "__one", *order, small_bytes=small_bytes, name=name, total=total)
    return d.withColumn(name, F.col(name) + 1).drop("__one")


def sums_before(df: DataFrame, weight: str, *order: str | Column, small_bytes: int = SMALL_BYTES, name: str = "before", total: str = "total") -> DataFrame:
    """df with the sum of a whole-number weight over the rows before each row in a total
    order, and over all rows.

    The order must be unique. A large input is range-partitioned by it; sums within
    partitions get the sums of the partitions before as an offset. Only one sum per
    partition is joined back.
    """
    w = F.col(weight).cast("long")
    rows_before = lambda of: of.rowsBetween(Window.unboundedPreceding, -1)
    if plan_bytes(df) <= small_bytes:
        return df.withColumn(name, F.coalesce(F.sum(w).over(rows_before(Window.orderBy(*order))), F.lit(0))).withColumn(total, F.sum(w).over(Window.partitionBy()))
    ensure_checkpoints(df)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    size = ranged.groupBy("__part").agg(F.sum(w).alias("__size"))  # a row per partition
    size = size.withColumn("__before", F.coalesce(F.sum("__size").over(rows_before(Window.orderBy("__part"))), F.lit(0))).withColumn(total, F.sum("__size").over(Window.partitionBy()))
    own = F.coalesce(F.sum(w).over(rows_before(Window.partitionBy("__part").orderBy(*order))), F.lit(0))
    return ranged.withColumn("__own", own).join(F.broadcast(size), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__size", "__before")


def ensure_checkpoints(df: DataFrame) -> None:
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        import tempfile

        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))


def ntile(df: DataFrame, tiles: int, *order: str | Column, name: str = "tile", small_bytes: int = SMALL_BYTES) -> DataFrame:
    """NTILE over the whole table: of n rows, the first n mod tiles tiles have one row more."""
    d = numbered(df, *order, small_bytes=small_bytes, name="__rn", total="__n")
    q, r = F.floor(F.col("__n") / tiles), F.col("__n") % tiles
    big = r * (q + 1)
    late = F.when(q > 0, r + F.floor((F.col("__rn") - big - 1) / F.greatest(q, F.lit(1)))).otherwise(0) + 1
    tile = F.when(F.col("__rn") <= big, F.floor((F.col("__rn") - 1) / (q + 1)) + 1).otherwise(late)
    return d.withColumn(name, tile.cast("int")).drop("__rn", "__n")
