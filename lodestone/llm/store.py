"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and master is
    local (tests, one machine), a temporary folder that is removed at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(f"file://{base}")
        base = f"file://{base}"
    return base.rstrip("/")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def save(df: DataFrame, tag: str, codec: str = "zstd", batch: int = 0) -> DataFrame:
    """Write df once to the shared folder and return a DataFrame that reads it.

    This cuts the lineage: a lost executor costs a re-read, never a recompute. With
    batch, Arrow batches hold at most that many rows, for rows of many kilobytes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"
    was = spark.conf.get(BATCH_ROWS)
    if batch:
        spark.conf.set(BATCH_ROWS, str(batch))
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, was)
    return spark.read.schema(df.schema).parquet(path)


def row_key(docs: DataFrame) -> Column:
    """A number for each row of docs with an id, as an expression: the id, or, where some
    id has several texts, a hash of id and text. Rows that repeat both share it."""
    text, doc = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    marks = docs.where("doc_id is not null").groupBy(doc).agg(F.min(F.xxhash64(text)).alias("a"), F.max(F.xxhash64(text)).alias("b"))
    return doc if marks.where("a <> b").isEmpty() else F.xxhash64(doc, text)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


BROADCAST_KEYS = 1_000_000  #: keys that are counted first and then sent to all executors, at most


def only(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose column is in the one column of keys. Few keys, once counted,
    are broadcast, so that the rows are not shuffled."""
    return _matched(df, F.col(column), keys, "left_semi")


def without(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of df whose key, an expression over it, is not in the one column of keys;
    rows whose key is null stay."""
    return _matched(df, key, keys, "left_anti")


def _matched(df: DataFrame, key: Column, keys: DataFrame, how: str) -> DataFrame:
    own, name = unused(df, "own", "key")
    keys = save(keys.toDF(name), "keys")
    few = keys.count() <= BROADCAST_KEYS
    return df.withColumn(own, key).join(F.broadcast(keys) if few else keys, F.col(own) == F.col(name), how).drop(own)


def width(spark: SparkSession, rows: float = 0, per_partition: float = 1) -> int:
    """Partitions for a shuffle: the session's setting, or more if the rows ask for it."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(-(-rows // per_partition)))
