"""The pipeline stage by stage against brute force."""

import re
from collections import Counter

import corpus_pipeline as p
from lodestone.llm.queries import oracle_sql, queries

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def test_stages(spark, data):
    from test_operators import brute_groups, low

    sf = f"{data}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [" ".join(WORD.findall(low(r.text))[1:-1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        after = {r.doc_id: r.text for r in rows}
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns and len(rows) == len(after)
        gone = set(before) - set(after)
        if name == "quality_classifier":
            assert all(labels.get(i, 0) == 0 for i in gone) and all(labels.get(i, 1) for i in after)
        if name == "exact_copies":
            first = {}
            for i in sorted(before):
                first.setdefault(low(before[i]), i)
            assert set(after) == set(first.values())
        if name == "near_copies":
            assert set(after) == {i for i, _, c in brute_groups(sorted(before.items()), 5, 80, 100) if i == c}
        if name == "benchmark_items":
            assert gone == {i for i, t in before.items() if any(x in " ".join(WORD.findall(low(t))) for x in items)}
        if name == "mixing_to_targets":
            share = Counter()
            for r in rows:
                share[r.lang] += len(WORD.findall(r.text))
            assert set(after) == set(before)
            assert all(abs(share[k] / sum(share.values()) - v) < 0.12 for k, v in {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}.items())
        docs, before = spark.createDataFrame(rows, out.schema), after
    assert [n for n, _ in p.STAGES][2] == "near_copies"


def test_registered(spark, data):
    q = queries()
    assert sorted(int(n[2:].split("_")[0]) for n in q if n.startswith("op")) == list(range(1, 11))
    assert "pipeline" in q and set(oracle_sql()) <= set(q)


def test_op6_equals_sql(spark, data):
    import duckdb

    sf = f"{data}/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries()["op6_exact_dedup"](spark, sf)
    res = con.execute(oracle_sql()["op6_exact_dedup"])
    at = [[d[0] for d in res.description].index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in at) for r in res.fetchall())
