"""What a plan did when it ran: operators, rows, and where it lost time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BIG_SCAN, HUGE_SCAN, BIG_RATIO = 10_000, 100_000, 10
SLOW_SORT_MS, SLOW_HASH_MS = 1_000, 5_000


@dataclass(frozen=True)
class PlanNode:
    depth: int
    operator: str
    rows: int
    time_ms: int
    text: str


def _metric(node, *names: str) -> int:  # noqa: ANN001
    m = node.metrics()
    return max([int(m.apply(n).value()) for n in names if m.contains(n)], default=-1)


def nodes(df: DataFrame) -> list[PlanNode]:
    """Runs df (rows are counted and dropped) and walks the final plan with its metrics."""
    query = df._jdf.queryExecution()
    query.toRdd().count()
    out: list[PlanNode] = []

    def walk(n, depth: int) -> None:  # noqa: ANN001
        kind = n.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(n.executedPlan(), depth)
        if kind.endswith("QueryStageExec"):
            return walk(n.plan(), depth)
        out.append(PlanNode(depth, kind.removesuffix("Exec"), _metric(n, "numOutputRows"), _metric(n, "sortTime", "buildTime", "aggTime", "scanTime"), str(n.simpleString(120))))
        children = n.children()
        for i in range(children.size()):
            walk(children.apply(i), depth + 1)
        return None

    walk(query.executedPlan(), 0)
    return out


def bottlenecks(found: list[PlanNode]) -> list[tuple[str, str, str]]:
    """(type, severity, operator) of large scans, nested loops, slow sorts and exploding joins."""
    out = []
    for i, n in enumerate(found):
        if "Scan" in n.operator and n.rows > BIG_SCAN:
            out.append(("LARGE_SEQ_SCAN", "HIGH" if n.rows > HUGE_SCAN else "MEDIUM", n.text))
        if n.operator in ("BroadcastNestedLoopJoin", "CartesianProduct"):
            out.append(("NESTED_LOOP", "HIGH", n.text))
        if n.operator == "Sort" and n.time_ms > SLOW_SORT_MS:
            out.append(("SLOW_SORT", "MEDIUM", n.text))
        if ("Hash" in n.operator or n.operator == "BroadcastExchange") and n.time_ms > SLOW_HASH_MS:
            out.append(("SLOW_HASH", "MEDIUM", n.text))
        if "Join" in n.operator and n.rows > 0:
            below = max([m.rows for m in found[i + 1 :] if m.depth > n.depth], default=0)
            if below > 0 and n.rows > BIG_RATIO * below:
                out.append(("EXPLODING_JOIN", "MEDIUM", n.text))
    return out


def table_metadata(spark: SparkSession, table: str) -> DataFrame:
    """Per column of a table: type, distinct values (estimated) and nulls, in one pass."""
    from pyspark.sql import functions as F

    d = spark.table(table)
    aggs = [F.count("*").alias("n")] + [f(c).alias(f"{k}{i}") for i, c in enumerate(d.columns) for k, f in (("d", F.approx_count_distinct), ("z", lambda c: F.count_if(F.col(c).isNull())))]
    r = d.agg(*aggs).first()
    rows = [(table, c, t, r["n"], r[f"d{i}"], r[f"z{i}"]) for i, (c, t) in enumerate(d.dtypes)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, n_rows long, n_distinct long, n_null long")


def estimated_rows(n_rows: int, n_distinct: int) -> float:
    """Rows that an equality on a column keeps; one for a unique column."""
    return n_rows / max(1, n_distinct)


def layout_advice(metadata: DataFrame, column: str, least_rows: int = HUGE_SCAN) -> str:
    """How to lay out a table that is often filtered by a column, from table_metadata: the
    counterpart of an index."""
    r = metadata.where(metadata["column_name"] == column).first()
    if r is None or r["n_rows"] < least_rows:
        return "none: the table is small or lacks the column"
    if r["n_distinct"] <= 1_000:
        return f"partition by {column}: {r['n_distinct']} values, about {estimated_rows(r['n_rows'], r['n_distinct']):.0f} rows each"
    return f"bucket and sort by {column}: an equality keeps about {estimated_rows(r['n_rows'], r['n_distinct']):.0f} rows, and row groups are skipped by their ranges"
