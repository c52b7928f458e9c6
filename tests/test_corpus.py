"""Every query against its SQL in DuckDB, and the techniques against plain forms."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import lodestone.plans.advice
import lodestone.plans.blocks
import lodestone.plans.monitor  # noqa: F401  registers its queries
from lodestone.operators.joins import band_join, consolidated, ordered_pair_sums, peers_per_group
from lodestone.operators.ranks import ntile, numbered, sums_before
from lodestone.plans import corpus
from lodestone.sources.bank import Bank

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/sf0.01/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(corpus.ORACLE))
def test_query_equals_sql(spark, data, duck, name):
    df = corpus.QUERIES[name](spark, f"{data}/sf0.01")
    cols = sorted(df.columns)
    got = Counter(tuple(repr(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(corpus.ORACLE[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    assert got == Counter(tuple(repr(r[i]) for i in at) for r in res.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(corpus.QUERIES) - set(corpus.ORACLE)))
def test_other_queries_have_rows(spark, data, name):
    assert corpus.QUERIES[name](spark, f"{data}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 75
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("rows,tiles", [(0, 4), (1, 4), (3, 4), (10, 4), (101, 100), (57, 7)])
def test_distributed_ntile_equals_window(spark, rows, tiles):
    d = spark.range(rows).select(F.col("id"), F.pmod(F.hash("id"), F.lit(5)).alias("x"))
    far = ntile(d, tiles, "x", "id", small_bytes=-1)
    near = ntile(d, tiles, "x", "id", small_bytes=1 << 40)
    want = d.selectExpr("id", "x", f"ntile({tiles}) over (order by x, id) as tile")
    assert sorted(far.collect()) == sorted(want.collect()) == sorted(near.collect())


def test_numbered_has_offsets(spark):
    d = numbered(spark.range(1000), "id", small_bytes=-1)
    assert d.where("rn != id + 1 or n != 1000").count() == 0


@pytest.mark.parametrize("small_bytes", [-1, 1 << 40])
def test_sums_before_equal_a_window(spark, small_bytes):
    d = spark.range(300).select("id", F.pmod(F.hash("id"), F.lit(9)).alias("w"))
    got = sums_before(d, "w", F.desc("id"), small_bytes=small_bytes).select("id", "w", "before", "total").collect()
    want = d.selectExpr("id", "w", "coalesce(sum(w) over (order by id desc rows between unbounded preceding and 1 preceding), 0)", "sum(w) over ()").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)


def odd_bank(tmp_path, accounts, tellers):
    """Tables of accounts (aid, bid, balance) and tellers (tid, bid, balance) over three branches."""
    con = duckdb.connect()
    rows = lambda r: ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in x) + ")" for x in r)
    con.execute(f"COPY (SELECT a::BIGINT AS c_custkey, b::INTEGER AS c_nationkey, x::DOUBLE AS c_acctbal, 'n' || a AS c_name FROM (VALUES {rows(accounts)}) t(a, b, x)) TO '{tmp_path}/customer.parquet'")
    con.execute(f"COPY (SELECT a::BIGINT AS s_suppkey, b::INTEGER AS s_nationkey, x::DOUBLE AS s_acctbal, 'n' || a AS s_name FROM (VALUES {rows(tellers)}) t(a, b, x)) TO '{tmp_path}/supplier.parquet'")
    con.execute(f"COPY (SELECT i::INTEGER AS n_nationkey, 'b' || i AS n_name FROM range(3) t(i)) TO '{tmp_path}/nation.parquet'")
    for t in ("customer", "supplier", "nation", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path if t in ('customer', 'supplier', 'nation') else '/root/testdata/sf0.001'}/{t}.parquet'")
    return con


def equals_sql(spark, tmp_path, con, name):
    df = corpus.QUERIES[name](spark, str(tmp_path))
    res = con.execute(corpus.ORACLE[name])
    at = [[d[0] for d in res.description].index(c) for c in df.columns]
    want = Counter(tuple(repr(r[i]) for i in at) for r in res.fetchall())
    assert Counter(tuple(repr(v) for v in r) for r in df.collect()) == want
    return sum(want.values())


def test_account_stats_with_null_balances_and_no_tellers(spark, tmp_path):
    accounts = [(i, i % 3 if i % 11 else 7, None if i % 10 == 3 else round(i * 7919 % 13 - 4.37, 2)) for i in range(1, 80)]
    con = odd_bank(tmp_path, accounts, [(i, 1 if i < 9 else 2, i + 0.5) for i in range(1, 11)])
    assert equals_sql(spark, tmp_path, con, "recon_account_stats") > 80


def test_account_stats_fans_out_last(spark, data):
    """Nothing sorts, shuffles or sums up the rows by teller."""
    plan = corpus.recon_account_stats(Bank(spark, f"{data}/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("LeftOuter")]
    assert not [x for x in ("Window", "Sort", "Aggregate", "Repartition", "RDD") if x in above], above


def test_band_join_equals_direct(spark):
    a = spark.range(200).select(F.pmod("id", F.lit(3)).alias("k"), F.col("id").alias("a"), (F.pmod(F.hash("id"), F.lit(50)) - 25).alias("v"))
    b = a.select("k", F.col("a").alias("b"), "v")
    for w in (0, 1, 5, 100):
        got = band_join(a, b, ["k"], "v", w).select("a", "b").collect()
        want = a.alias("x").join(b.alias("y"), F.expr(f"x.k = y.k and abs(x.v - y.v) <= {w}")).select("a", "b").collect()
        assert sorted(got) == sorted(want)


def test_consolidated_keeps_unmatched_rows(spark):
    base = spark.createDataFrame([(1,), (2,)], "k long")
    child = spark.createDataFrame([(1, 5), (1, 7)], "k long, v long")
    out = consolidated(base, child, "k", {"n": F.count("*"), "s": F.sum("v"), "m": F.max("v")}, {"n": 0, "s": 0}).orderBy("k").collect()
    assert [tuple(r) for r in out] == [(1, 2, 12, 7), (2, 0, 0, None)]


def test_peer_count_drops_single_and_null_groups(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id long, g string")
    assert sorted(tuple(r) for r in peers_per_group(d, "g").collect()) == [(1, "a", 1), (2, "a", 1)]


@pytest.mark.parametrize("rows", [1, 2, 63, 65, 400])
def test_ordered_pair_sums_equal_pairs(spark, rows):
    d = spark.range(rows).select((F.col("id") * 7 % 1009).alias("id"), (F.col("id") % 3).alias("grp"), (F.pmod(F.hash("id"), F.lit(40)) - 20).cast("long").alias("x"), (F.col("id") % 2 + 1).alias("w"))
    want = Counter()
    have = [tuple(r) for r in d.collect()]
    for i, g, x, w in have:
        for j, h, y, v in have:
            if i < j:
                for k, z in zip(("n", "sx", "sy", "sxx", "syy", "sxy", "d"), (1, x, y, x * x, y * y, x * y, abs(x - y)), strict=True):
                    want[g, h, k] += w * v * z
    got = {(r.grp1, r.grp2, k): int(r[k]) for r in ordered_pair_sums(d).collect() for k in ("n", "sx", "sy", "sxx", "syy", "sxy", "d")}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("rows,of_x,bucket_rows", [(300, 40, 20), (300, 1, 20), (260, 10**12, 30), (100, 5, 1000)])
def test_pair_sums_over_many_buckets(spark, rows, of_x, bucket_rows):
    """With ids that repeat, null x, sums of more than 64 bits, and one x that all share."""
    d = [(i * 7 % 211 - 50, "ab"[i % 2] if i % 9 else None, None if i % 17 == 5 else (i * 7919 % 1009 - 300) % of_x - of_x // 3, i % 3 + 1) for i in range(rows)]
    df = spark.createDataFrame(d, "id int, grp string, x long, w int")
    want = Counter()
    for i, g, x, w in d:
        for j, h, y, v in d:
            if i < j:
                for k, z in (("n", 1), ("sx", x), ("sy", y), ("sxx", x and x * x), ("syy", y and y * y), ("sxy", None if x is None or y is None else x * y), ("d", None if x is None or y is None else abs(x - y))):
                    want[g, h, k] += w * v * (z or 0)
    got = {(r.grp1, r.grp2, k): int(r[k]) for r in ordered_pair_sums(df, bucket_rows).collect() for k in ("n", "sx", "sy", "sxx", "syy", "sxy", "d")}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_pair_sums_keep_rows_linear(spark):
    """Each row travels twice at most, and not once for each pair of bits."""
    d = spark.range(3000).select("id", (F.col("id") % 2).alias("grp"), F.pmod(F.hash("id"), F.lit(10**6)).cast("long").alias("x"), F.lit(1).alias("w"))
    assert ordered_pair_sums(d)._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 0


def test_spreads_of_more_than_38_digits(spark):
    from lodestone.operators.pairs import spreads

    d = spark.createDataFrame([(4 * 10**15, 0, 1, Decimal(10**27), Decimal(10**27), Decimal(-(10**26)))], "n long, sx long, sy long, sxx decimal(38,0), syy decimal(38,0), sxy decimal(38,0)")
    r = spreads(d).first()
    assert (r.vx, r.vy, r.cov) == (4e42, float(4 * 10**42 - 1), -4e41)


def test_cross_branch_with_null_balances_and_no_tellers(spark, tmp_path):
    accounts = [(i, i % 3 if i % 11 else 7, None if i % 10 == 3 else round(i * 7919 % 131 - 40.37, 2)) for i in range(1, 90)]
    con = odd_bank(tmp_path, accounts, [(i, 1 if i < 9 else 2, i + 0.5) for i in range(1, 11)])
    assert equals_sql(spark, tmp_path, con, "recon_cross_branch") == 9


def test_hot_key_plans_are_hash_joins(spark, data):
    plan = corpus.peer_pairs(Bank(spark, f"{data}/sf0.01"), 5, 80_000, False)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_columns_are_pruned(spark, data):
    plan = Bank(spark, f"{data}/sf0.01").accounts.select("aid")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint>" in plan


def test_safe_corr_of_a_constant_group_is_null(spark):
    from lodestone.functions import stats

    d = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "x long, y long")
    assert d.agg(stats.corr(F.col("x"), F.col("y"))).first()[0] is None
    assert d.limit(1).agg(stats.stddev(F.col("x"))).first()[0] is None


def test_generator_makes_related_tables(spark):
    from lodestone.sources.generate import generate

    t = generate(spark, 2, accounts=300)
    assert [t[n].count() for n in ("branches", "tellers", "accounts", "history")] == [2, 20, 600, 600]
    assert t["accounts"].join(t["branches"], "bid").count() == 600 == t["history"].join(t["accounts"], "aid", "left_semi").count()
    assert sorted(t["accounts"].collect()) == sorted(generate(spark, 2, accounts=300)["accounts"].repartition(7).collect())


def test_explorer_shows_every_table(spark, data):
    from lodestone.sources.explorer import explore, order_column

    b = Bank(spark, f"{data}/sf0.001")
    shown = explore({"accounts": b.accounts, "history": b.history, "events": b.raw("events")}, 5)
    assert all(d.count() == 5 for d in shown.values()) and order_column(b.history) == "mtime"
    assert order_column(b.accounts, "aid") == "aid"
