"""Join shapes that the optimizer does not find by itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import ordered_pair_sums  # noqa: F401


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], band: str, width: int) -> DataFrame:
    """Inner join on equal keys and abs(left.band - right.band) <= width.

    band is an integer column. Rows go to buckets of width + 1 values; the left
    side also visits the two buckets beside its own, so a match shares exactly
    one bucket and the join is a plain hash join on (keys, bucket). A hot key is
    spread over its buckets. The inputs must have no other column in common;
    the right side's keys are dropped.
    """
    step = width + 1
    at = F.floor(F.col(band) / F.lit(step)).cast("long")
    b = left.withColumn("__bucket", F.explode(F.array(at - 1, at, at + 1)))
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys or c == band else F.col(c) for c in right.columns], at.alias("__r_bucket"))
    on = [F.col(k) == F.col(f"__r_{k}") for k in keys] + [F.col("__bucket") == F.col("__r_bucket"), F.abs(F.col(band) - F.col(f"__r_{band}")) <= width]
    cond: Column = on[0]
    for c in on[1:]:
        cond = cond & c
    return b.join(r, cond).drop("__bucket", "__r_bucket", *[f"__r_{k}" for k in keys], f"__r_{band}")


def consolidated(base: DataFrame, child: DataFrame, key: str, aggregates: dict[str, Column], empty: dict[str, object]) -> DataFrame:
    """Several correlated aggregates over one child table as one aggregate and one left join.

    empty names the value of each aggregate over no rows (0 for counts and for
    sums with a default); aggregates left out of it stay null, as max would.
    """
    per = child.groupBy(F.col(key).alias("__key")).agg(*[c.alias(n) for n, c in aggregates.items()])
    out = base.join(per, base[key] == per["__key"], "left").drop("__key")
    return out.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in empty.items()})


def peers_per_group(df: DataFrame, group: str, name: str = "peers") -> DataFrame:
    """What a self-join on group and different ids would count, by one aggregate:
    rows of groups with more than one member, each with the number of others.
    Null groups join with nothing and are left out."""
    n = df.groupBy(F.col(group).alias("__g")).agg((F.count("*") - 1).alias(name)).where(F.col(name) > 0)
    return df.join(n, df[group] == n["__g"]).drop("__g")
