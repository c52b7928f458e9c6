"""Schema exploration: columns of tables, and their latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of columns that tell when a row was written, the best first.
TIME_COLUMNS = ("updated_at", "created_at", "inserted_at", "event_time", "timestamp", "query_start", "mtime", "ts")


def order_column(df: DataFrame, key: str | None = None) -> str | None:
    """The column that orders rows by age: of the columns that hold times, one with a
    known name before others; else the key, else none."""
    times = [f.name for f in df.schema.fields if f.dataType.typeName().startswith(("timestamp", "date"))]
    rank = {n: i for i, n in enumerate(TIME_COLUMNS)}
    return min(times, key=lambda c: rank.get(c, len(rank)), default=key)


def latest(df: DataFrame, n: int = 5, key: str | None = None) -> DataFrame:
    """The n newest rows, ties by key; any n rows if nothing orders them."""
    by = order_column(df, key)
    if by is None:
        return df.limit(n)
    order = [F.col(by).desc_nulls_last()] + ([F.col(key).desc_nulls_last()] if key and key != by else [])
    return df.orderBy(*order).limit(n)


def columns(spark: SparkSession, names: list[str]) -> DataFrame:
    """(table_name, position, column_name, data_type, nullable) of views or tables."""
    rows = [(n, i, f.name, f.dataType.simpleString(), f.nullable) for n in names for i, f in enumerate(spark.table(n).schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")


def explore(tables: dict[str, DataFrame], n: int = 5, keys: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The n latest rows of every table."""
    return {name: latest(d, n, (keys or {}).get(name)) for name, d in tables.items()}


def catalog(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """All tables and views that the session sees in a database, by name."""
    return {t.name: spark.table(t.name if t.isTemporary else f"{t.namespace[0]}.{t.name}" if t.namespace else t.name) for t in spark.catalog.listTables(database)}
