"""Rules, guard, static checks and equivalence."""

import time

import pytest

from lodestone import equivalence
from lodestone.advisor import advise, execution, rules
from lodestone.plans.advice import EXAMPLE, FAST, SLOW
from lodestone.sources.bank import Bank


def kinds(spark, sql):
    return {b.type: b.severity for b in rules.detect(spark, sql)}


def test_rules_on_the_example(spark):
    got = kinds(spark, EXAMPLE)
    assert {"CROSS_JOIN_EXPLOSION", "CROSS_JOIN_ROW_EXPLOSION", "SUBQUERY_IN_SELECT", "CAST_IN_JOIN_CONDITION", "ORDER_BY_WITHOUT_LIMIT", "LARGE_CTE_OUTPUT"} <= set(got)
    assert rules.expected_improvement(rules.detect(spark, EXAMPLE)) == "100x-1000x"


@pytest.mark.parametrize(
    "sql,kind,severity",
    [
        ("SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY x) FROM t", "PERCENTILE_CONT", "LOW"),
        ("SELECT stddev(x) FROM t", "STDDEV_AGGREGATION", "LOW"),
        ("SELECT DISTINCT x FROM t", "DISTINCT_LARGE_SET", "LOW"),
        ("SELECT x FROM t WHERE x > 5", "UNBOUND_WHERE_RANGE", "MEDIUM"),
        ("SELECT x FROM t WHERE lower(x) = 'a'", "FUNCTION_IN_WHERE", "MEDIUM"),
        ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT n FROM r", "RECURSIVE_CTE", "MEDIUM"),
        ("SELECT * FROM range(1, 5000000)", "LARGE_GENERATE_SERIES", "HIGH"),
        ("SELECT a.x FROM a, b", "CROSS_JOIN_EXPLOSION", "HIGH"),
        ("SELECT x FROM t ORDER BY x", "ORDER_BY_WITHOUT_LIMIT", "MEDIUM"),
    ],
)
def test_each_rule(spark, sql, kind, severity):
    assert kinds(spark, sql).get(kind) == severity


def test_limit_on_the_next_line_is_seen(spark):
    assert "ORDER_BY_WITHOUT_LIMIT" not in kinds(spark, "SELECT x FROM t\nORDER BY x\nLIMIT 5")
    assert "ORDER_BY_WITHOUT_LIMIT" not in kinds(spark, "SELECT rank() OVER (\nORDER BY x) FROM t")


def test_every_suggestion_has_a_bottleneck(spark):
    found = rules.detect(spark, EXAMPLE)
    s = advise.suggest(found)
    assert {x.strategy_id for x in s} >= {"CONVERT_SUBQUERY_TO_JOIN", "SELF_JOIN_TO_WINDOW", "MATERIALIZE_CTE"}
    assert {x.bottleneck for x in s} <= {b.type for b in found}
    report = advise.optimize(spark, EXAMPLE)
    assert report.as_json() and "CROSS_JOIN_EXPLOSION" in report.as_text() and len(report.by_line()) == len(EXAMPLE.splitlines())


@pytest.mark.parametrize(
    "sql,ok",
    [
        ("SELECT 1", True),
        ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT n FROM r", True),
        ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL (SELECT n + 1 FROM r WHERE n < 5 LIMIT 1)) SELECT n FROM r", False),
        ("SELECT sum(count(*) OVER ()) OVER () FROM range(3) GROUP BY rank() OVER (ORDER BY id)", False),
        ("SELECT (1", False),
        ("SELEC 1", False),
    ],
)
def test_static_checks(spark, sql, ok):
    assert advise.validate(spark, sql)[0] is ok


def test_guard(spark):
    base = "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY x) FROM t WHERE aid <= 80000"
    assert not advise.alterations(spark, base, f"WITH w AS (SELECT * FROM t) {base.replace('FROM t', 'FROM w')}")
    assert advise.alterations(spark, base, base.replace("cont", "disc")) == ["percentile_cont replaced by percentile_disc"]
    assert advise.alterations(spark, base, base.replace("80000", "5000"))
    assert advise.alterations(spark, base, base + " LIMIT 5") == ["new GlobalLimit"]


def test_rewrites_that_change_data_are_refused(spark):
    sql = "SELECT id FROM range(100) WHERE id <= 50"
    r = advise.optimize(spark, sql, lambda q: q.replace("50", "5"))
    assert r.optimized == sql and r.notes
    assert advise.optimize(spark, sql, lambda q: "SELECT").optimized == sql
    good = "SELECT id FROM (SELECT id FROM range(100)) WHERE id <= 50"
    assert advise.optimize(spark, sql, lambda q: good, lambda a, b: equivalence.same_rows(spark.sql(a), spark.sql(b)).valid).optimized == good


def _tables(spark, data):
    b = Bank(spark, f"{data}/sf0.01")
    return {n: getattr(b, n) for n in ("accounts", "branches", "history")}


def test_compare(spark, data):
    t = _tables(spark, data)
    assert equivalence.compare(spark, SLOW, FAST, t, sample=True)["results_match"]
    # a sum without its default is another answer as soon as a key has no rows
    urgent = t | {"history": t["history"].where("filler = '1-URGENT'")}
    bad = FAST.replace("coalesce(t.total, 0)", "t.total")
    assert not equivalence.compare(spark, SLOW, bad, urgent)["results_match"]
    assert equivalence.compare(spark, SLOW, FAST, urgent)["results_match"]


def test_filter_pushed_into_a_shared_cte_is_caught(spark):
    cte = "WITH s AS (SELECT id % 5 AS g, count(*) AS n FROM range(23) GROUP BY 1{}) "
    a = cte.format("") + "SELECT x.g, y.g AS h FROM s x JOIN s y ON x.g <> y.g WHERE x.n > 4"
    b = cte.format(" HAVING count(*) > 4") + "SELECT x.g, y.g AS h FROM s x JOIN s y ON x.g <> y.g"
    v = equivalence.same_rows(spark.sql(a), spark.sql(b))
    assert not v.valid and v.differences


def test_anchor_and_names(spark):
    assert equivalence.anchor_key({"accounts": ["aid", "bid"], "history": ["aid", "bid"]}) == ("accounts", "aid")
    assert equivalence.anchor_key({"x": ["user_id", "v"], "y": ["user_id"], "z": ["other_id"]}) == ("x", "user_id")
    assert equivalence.anchor_key({"x": ["v"], "y": ["w"]}) is None
    with pytest.raises(ValueError):
        equivalence.safe_name("a; drop table b")


def test_labels():
    assert equivalence.speedup(10, 2) == "5.0x faster"
    assert equivalence.speedup(2, 10) == "5.0x slower (Regression)"
    assert equivalence.speedup(1, 0) == "Instant"
    assert equivalence.speedup(0, 1) == "N/A"


def test_executed_plan(spark):
    found = execution.nodes(spark.range(200_000).crossJoin(spark.range(2)))
    assert any(k == "NESTED_LOOP" for k, _, _ in execution.bottlenecks(found))
    spark.range(10).selectExpr("id", "id % 2 AS x").createOrReplaceTempView("ten")
    assert [r.n_distinct for r in execution.table_metadata(spark, "ten").collect()] == [10, 2]
    assert execution.estimated_rows(100, 100) == 1


def test_alert_resolution(spark, data):
    from lodestone.plans import monitor

    p = Bank(spark, f"{data}/sf0.01").problems
    open_id = p.where("r_eventid IS NULL").first()["eventid"]
    done = monitor.resolve_alert(p, open_id, lambda: 2, lambda: spark.range(3))
    assert (done["status"], done["killed"], done["rows"]) == ("STOPPED", 2, 3)
    assert monitor.resolve_alert(p, -1, lambda: 2, lambda: spark.range(3))["status"] == "NOT_ACTIVE"
    assert len(monitor.preview(p, open_id)) == 3


def test_watch_stream(spark, data, tmp_path):
    from lodestone.streaming.monitor import snapshots, watch

    a = Bank(spark, f"{data}/sf0.001").activity
    a.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    q = watch(snapshots(spark, str(tmp_path / "in"), a.schema), lambda d, n: seen.append(d.count()))
    q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) == a.where("state = 'active'").count()


def test_rewriter_leaves_what_it_does_not_know():
    from lodestone.advisor.rewrite import rewrite

    for sql in (
        "SELECT 1",
        "SELECT '(SELECT count(*) FROM h WHERE h.k = a.k)' AS x FROM a",
        "SELECT (SELECT h.v FROM h WHERE h.k = a.k) FROM a",  # no aggregate
        "SELECT (SELECT count(*) FROM h WHERE h.k > a.k) FROM a",
        "SELECT (SELECT count(*) FROM h WHERE h.k = a.k OR h.x = 1) FROM a",
        "SELECT (SELECT sum(h.v) FROM h WHERE h.k = a.k AND h.d > a.d) FROM a",
        "SELECT a.g, max((SELECT count(*) FROM h WHERE h.k = a.k)) FROM a GROUP BY a.g",
        "WITH c AS (SELECT x FROM t) SELECT p.x FROM c p JOIN c q ON p.x = q.x WHERE p.x > 5",  # used twice
        "WITH c AS (SELECT x FROM t LIMIT 5) SELECT p.x FROM c p WHERE p.x > 5",
        "WITH c AS (SELECT x, rank() OVER (ORDER BY x) AS r FROM t) SELECT p.x FROM c p WHERE p.x > 5",
        "SELECT t.x, p.x FROM t LEFT JOIN p ON t.x = p.x WHERE p.x > 5",
        "SELECT a.id, sum(a.v) FROM t a JOIN t b ON a.g = b.g AND a.id <> b.id GROUP BY a.id",
    ):
        assert rewrite(sql) == sql


def test_rewriter_keeps_values_of_keys_without_rows(spark):
    spark.createDataFrame([(1,), (2,), (None,)], "k int").createOrReplaceTempView("rw_a")
    spark.createDataFrame([(1, 5), (1, None), (None, 3)], "k int, v int").createOrReplaceTempView("rw_h")
    sql = """SELECT a.k -- count(*) here
    , (SELECT count(*) FROM rw_h h WHERE h.k = a.k) AS n, (SELECT count(h.v) FROM rw_h h WHERE a.k = h.k) AS m,
    (SELECT sum(h.v) FROM rw_h h WHERE h.k = a.k) AS s, (SELECT coalesce(sum(h.v), 7) FROM rw_h h WHERE h.k = a.k AND h.v BETWEEN 1 AND 9) AS d
    FROM rw_a AS a WHERE 0 <= (SELECT count(*) FROM rw_h h WHERE h.k = a.k) ORDER BY a.k;"""
    r = advise.optimize(spark, sql, same=lambda a, b: equivalence.same_rows(spark.sql(a.rstrip(";")), spark.sql(b.rstrip(";"))).valid)
    assert r.optimized.count("LEFT JOIN") == 2 and not r.notes
    assert [tuple(x) for x in spark.sql(r.optimized.rstrip(";")).collect()] == [(None, 0, 0, None, 7), (1, 2, 1, 5, 5), (2, 0, 0, None, 7)]
    s = [x for x in r.suggestions if x.strategy_id == "CONVERT_SUBQUERY_TO_JOIN"]
    assert s and advise.apply(sql, s) == s[0].suggested_sql != sql == s[0].original_sql


def test_guard_sees_operators_limits_and_dropped_filters(spark):
    sql = "SELECT id FROM range(100) WHERE id <= 5 AND id > 1 LIMIT 5"
    for new in (sql.replace("<=", "<"), sql.replace(" AND id > 1", ""), sql.replace(" LIMIT 5", ""), sql.replace("LIMIT 5", "LIMIT 2")):
        assert advise.alterations(spark, sql, new)
    assert not advise.alterations(spark, sql, sql.replace("id FROM", "id  FROM"))


def test_compare_reports_failures_and_time_limits(spark):
    d = {"rw_t": spark.range(10).toDF("x")}
    r = equivalence.compare(spark, "SELECT x FROM rw_t", "SELECT y FROM rw_t", d)
    assert not r["results_match"] and set(r["errors"]) == {"after"}
    slow = "SELECT sum(id % 7) AS n FROM range(0, 20000000000, 1, 200)"
    r = equivalence.compare(spark, "SELECT count(*) AS n FROM rw_t", slow, d, limit=2)
    assert r["seconds"][1] is None and r["cost"] and "stopped" in r["reason"]
    assert spark.range(5).count() == 5


def test_command_line(tmp_path):
    import json
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "q.sql").write_text("SELECT a.x, (SELECT count(*) FROM h WHERE h.k = a.k) AS n FROM a")
    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-m", "lodestone", str(tmp_path / "q.sql"), "--json", "--save", str(tmp_path / "new.sql")], cwd=root, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and "LEFT JOIN" in (tmp_path / "new.sql").read_text()
    assert {b["type"] for b in json.loads(out.stdout)["bottlenecks"]} >= {"SUBQUERY_IN_SELECT"}
    bad = subprocess.run([sys.executable, "-m", "lodestone", "-q", "SELECT (1"], cwd=root, capture_output=True, text=True, timeout=300)
    assert bad.returncode == 2


def test_layout_advice(spark):
    spark.range(1000).selectExpr("id", "id % 5 AS g").createOrReplaceTempView("rw_m")
    m = execution.table_metadata(spark, "rw_m")
    assert "partition by g" in execution.layout_advice(m, "g", 100) and "none" in execution.layout_advice(m, "g")
    assert "bucket" in execution.layout_advice(m.withColumn("n_distinct", m["n_distinct"] + 2_000), "id", 100)


def test_dry_run_runs_nothing_and_has_a_limit(spark, monkeypatch):
    assert advise.validate(spark, "CREATE TEMPORARY VIEW made_by_dry_run AS SELECT 1 AS a")[0]
    assert not spark.catalog.tableExists("made_by_dry_run")
    assert advise.validate(spark, "SELECT 1 AS a;", limit=60) == (True, "")
    for limit in (None, 60):
        ok, why = advise.validate(spark, "SELECT no_such FROM range(3)", limit=limit)
        assert not ok and "no_such" in why
    monkeypatch.setattr(advise, "_dry_run", lambda *_: time.sleep(5))
    assert advise.validate(spark, "SELECT 1 AS a", limit=0.1) == (False, "not planned within 0.1 s")
