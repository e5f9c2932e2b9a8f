"""The newer queries against their SQL on the smallest tables, and odd rows in what they are made of."""

import math
from pathlib import Path

import duckdb
import pytest
from tallyspark.operators import evidence
from tallyspark.plans import audits, cards, contexts, forecasts, imports, reads

AT = "/root/testdata/sf0.001"
MODULES = (audits, cards, contexts, forecasts, imports, reads)


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    base.execute("set timezone = 'UTC'")
    for path in Path(AT).glob("*.parquet"):
        base.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return base


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.ORACLES])
def test_query_equals_its_sql(spark, duck, name):
    module = next(m for m in MODULES if name in m.QUERIES)
    df = module.QUERIES[name](spark, AT)
    found = duck.execute(module.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    assert got == sorted((plain(r) for r in found.fetchall()), key=repr)


def test_name_tiers_on_odd_rows(spark):
    contests = spark.createDataFrame([("e", 1, "José", "Bob"), ("e", 2, "Cy", "Di"), ("e", 3, "cy ", "DI"), ("e", 4, None, "Bob"), ("f", 5, "Ann", "Eve")], "event string, bout long, x string, y string")
    quotes = [("e", 1, "bob", "JOSÉ"), ("e", 2, "Bob", "Jose"), ("e", 3, "Di", "Cy"), ("e", 4, "Bob", "Zoe"), ("e", 5, "Zoe", "Max"), ("e", 6, None, "Bob"), ("f", 7, "José", "Bob"), ("g", 8, "Ann", "Eve")]
    got = {r.quote: (r.status, r.bout) for r in evidence.name_tiers(spark.createDataFrame(quotes, "event string, quote long, x string, y string"), contests, "event", "quote", "bout").collect()}
    assert got == {1: ("exact", 1), 2: ("accent_normalization", 1), 3: ("ambiguous", None), 4: ("review", None), 5: ("absent", None), 6: ("review", None), 7: ("absent", None), 8: ("absent", None)}


def test_candidates_number_what_a_name_may_mean(spark):
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "key string")
    known = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("c", 3), (None, 4)], "key string, id long")
    got = sorted(tuple(r) for r in evidence.candidates(wanted, known, "key", "id").select("key", "id", "n", "position").collect())
    assert got == [("a", 1, 2, 1), ("a", 1, 2, 1), ("a", 2, 2, 2), ("a", 2, 2, 2)]


def test_candidates_of_a_frequent_key_meet_it_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(evidence, "CHUNK", 3)
    wanted = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "row int, key string")
    known = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "key string, id long")
    out = evidence.candidates(wanted, known, "key", "id")
    assert sorted((r.row, r.id, r.n, r.position) for r in out.collect()) == [(r, i, 10, i + 1) for r in (1, 2) for i in range(10)] + [(3, i, 3, i + 1) for i in range(3)]
    out.write.format("noop").mode("overwrite").save()
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # one before


def test_candidates_are_joined_a_chunk_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(evidence, "CHUNK", 2)
    wanted = spark.createDataFrame([(1, "a"), (2, "b")], "row int, key string")
    known = spark.createDataFrame([("a", None), ("a", 5), ("a", 3), ("b", 4)], "key string, id long")
    out = evidence.candidates(wanted, known, "key", "id")
    assert sorted(((r.row, r.id, r.n, r.position) for r in out.collect()), key=repr) == [(1, 3, 3, 2), (1, 5, 3, 3), (1, None, 3, 1), (2, 4, 1, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan.split("Join Inner")[0]  # the join made every row of the result before
