"""Queries that do the whole job where the SQL of an older one holds a part of it: against their SQL, and by hand."""

import duckdb
from pyspark.sql import functions as F

from tallyspark.operators import evaluate
from tallyspark.plans import domain, evaluation, registry, relational

SF = "/root/testdata/sf0.001"


def same(spark, name):
    """The rows of a query, equal to those of its SQL."""
    frame = registry.QUERIES[name](spark, SF)
    sql = duckdb.connect()
    for t in ("orders", "lineitem", "documents", "labels", "embeddings"):
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sql.execute(registry.ORACLES[name])
    assert [c[0] for c in want.description] == frame.columns
    got = [tuple(r) for r in frame.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))
    return got


def test_paired_rounds_of_every_participant(spark):
    got = same(spark, "paired_rounds_all")
    assert len({r[1] for r in got}) > 1
    assert sorted(map(repr, same(spark, "paired_rounds"))) == sorted(map(repr, got))


def test_calibration_counts_every_forecast(spark):
    got = same(spark, "calibration_bins_all")
    assert sum(r[1] for r in got) == spark.read.parquet(f"{SF}/labels.parquet").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").count()
    assert {r[0]: r[1] for r in got}[4] > 0


def test_calibration_shows_an_empty_bin(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.75, 1), (0.95, 1)], "p double, y int")
    assert [(r.bin, r.n, r.mean_p) for r in evaluation.calibrated(rows).orderBy("bin").collect()] == [(0, 1, 0.1), (1, 0, None), (2, 0, None), (3, 1, 0.75), (4, 1, 0.95)]


def test_next_other_division_looks_a_year_ahead(spark):
    assert same(spark, "next_other_division")
    rows = [(1, 1, 0, "x"), (1, 2, 0, "x"), (1, 3, 100, ""), (1, 4, 366, "y"), (1, 5, 367, "x"), (1, 6, 800, "y"), (2, 7, 0, "x"), (2, 8, 0, "y"), (2, 9, 5, "x"), (3, 10, 0, "x"), (3, 11, 367, "y")]
    got = relational.other_divisions(spark.createDataFrame(rows, "who int, bout_id int, day int, division string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 4), (1, 2, 4), (1, 4, 5), (2, 7, 8), (2, 8, 9)]


def test_nested_groups_hold_every_contest(spark):
    assert sum(r[2] for r in same(spark, "nested_groups_all")) == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_bootstrap_interval_is_the_operators(spark):
    blocks = evaluate.block_sums(domain.contests(spark, SF), "event_date", [(F.col("outcome") == "win").cast("double")])
    assert tuple(registry.QUERIES["bootstrap_interval"](spark, SF).first()) == evaluate.bootstrap(blocks, "event_date", repeats=2000)


def test_vectors_are_read_whole(spark):
    wide = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("max(size(embedding))").first()[0]
    assert wide > 8 and max(len(r[1]) for r in same(spark, "vector_orientation_whole")) == wide


def test_lines_are_dealt_by_their_size(spark, monkeypatch):
    """A task's share of the lines has a bound, however large the table is."""
    from tallyspark.plans import domain

    at = "/root/testdata/sf0.01"
    whole = sorted(map(repr, domain.facts(spark, at).collect()))
    monkeypatch.setattr(domain, "LINE_BYTES", 1 << 15)
    lines = domain.rounds(spark, at)
    dealt = domain.dealt(spark, at, lines)
    assert dealt.rdd.getNumPartitions() >= 30 and dealt.count() == lines.count()
    assert sorted(map(repr, domain.facts(spark, at).collect())) == whole


def tables(at, lines):
    """Orders 0 to 7, and lines (order, supplier, number) of them."""
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT k AS o_orderkey, k AS o_custkey, 'F' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, TIMESTAMP '1997-01-01' AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(8) t(k)) TO '{at}/orders.parquet'")
    rows = ", ".join(f"({k}, {s}, {n}, {i + 1})" for i, (k, s, n) in enumerate(lines)).replace("None", "NULL")
    duck.execute(f"COPY (SELECT k::BIGINT AS l_orderkey, 1::BIGINT AS l_partkey, s::BIGINT AS l_suppkey, n::INT AS l_linenumber, q::DOUBLE AS l_quantity, 0.5::DOUBLE AS l_discount, 'N' AS l_returnflag, 'F' AS l_linestatus FROM (VALUES {rows}) t(k, s, n, q)) TO '{at}/lineitem.parquet'")
    for t in ("orders", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return duck


ODD = [(0, 3, 1), (0, 5, 1), (0, None, 2), (1, 4, 1), (1, None, 1), (2, 7, 1), (2, 7, 2), (3, 1, 1), (3, 2, 1), (3, 2, 1), (3, 9, 1), (4, 1, 2), (4, 2, 3), (None, 1, 1), (None, 2, 1), (5, 3, 1), (5, 4, 1), (5, 3, 4), (9, 1, 1), (9, 2, 1)]


def as_sql(spark, duck, at, name):
    found = duck.execute(registry.ORACLES[name])
    columns, want = [c[0] for c in found.description], found.fetchall()
    got = registry.QUERIES[name](spark, str(at)).select(*columns).collect()
    assert want and sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_lines_without_a_participant_hide_no_contest(spark, tmp_path):
    duck = tables(tmp_path, ODD)
    for name in ("opponent_history", "record_pivot"):
        as_sql(spark, duck, tmp_path, name)


def test_lines_are_dealt_by_their_size_on_many_cores(spark, monkeypatch):
    """More cores than shuffle partitions do not lift the bound."""
    at = "/root/testdata/sf0.01"
    lines = domain.rounds(spark, at)
    monkeypatch.setattr(domain, "LINE_BYTES", 1 << 19)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert domain.dealt(spark, at, lines).rdd.getNumPartitions() >= 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_paired_rounds_of_odd_lines(spark, tmp_path):
    """Null suppliers and numbers, repeated numbers, a third supplier between the sides, orders without lines and lines without orders."""
    odd = [*ODD, (6, 1, None), (6, 2, None), (6, 1, 1), (7, 1, 1), (7, 5, 1), (7, 9, 1), (7, 1, 1), (7, 9, 2)]
    as_sql(spark, tables(tmp_path, odd), tmp_path, "paired_rounds")


def test_paired_rounds_are_dealt_by_their_size(spark, monkeypatch):
    """No step of the query, from the lines to the result, has a share that grows with the table."""
    at = "/root/testdata/sf0.01"
    whole = sorted(map(repr, registry.QUERIES["paired_rounds"](spark, at).collect()))
    monkeypatch.setattr(domain, "LINE_BYTES", 1 << 15)
    frame = registry.QUERIES["paired_rounds"](spark, at)
    assert sorted(map(repr, frame.collect())) == whole
    assert frame.rdd.getNumPartitions() >= 30


def test_last_rounds_share_the_step_of_paired_rounds(spark, tmp_path, monkeypatch):
    """Odd lines as in the SQL; its rounds are dealt by their size as well."""
    odd = [*ODD, (6, 1, None), (6, 2, None), (6, 1, 1), (7, 1, 1), (7, 5, 1), (7, 9, 1), (7, 1, 1), (7, 9, 2)]
    duck = tables(tmp_path, odd)
    for name in ("last_rounds", "paired_rounds_all"):
        as_sql(spark, duck, tmp_path, name)
    monkeypatch.setattr(domain, "LINE_BYTES", 1 << 15)
    for name in ("last_rounds", "paired_rounds_all"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= 30


def test_card_report_counts_contests_with_a_null_supplier(spark, tmp_path):
    """A contest that also has a line without a supplier counts for both of its sides."""
    duck = tables(tmp_path, [(0, 1, 1), (0, 2, 1), (1, 1, 1), (1, 2, 2), (1, None, 3), (2, 2, 1), (2, 3, 1), (2, None, 1), (3, 3, 1), (3, None, 1)])
    as_sql(spark, duck, tmp_path, "card_report")
    assert {r.a: (r.attempts_a, r.attempts_b) for r in registry.QUERIES["card_report"](spark, str(tmp_path)).collect()} == {1: (2.0, 4.0), 2: (4.0, 7.0)}


def test_card_report_aggregates_the_lines_once(spark, tmp_path):
    """Both participants of a pair come from one pass over the lines, with the rows of the SQL; gaps between ids and missing attempts as well."""
    duck = tables(tmp_path, [(0, -1, 1), (0, 0, 1), (1, 0, 1), (1, 1, 1), (2, 3, 1), (2, 5, 1), (3, 5, 1), (3, 6, 1), (4, 8, 1), (4, 8, 2), (5, 6, 1), (5, 7, 1)])
    duck.execute(f"COPY (SELECT * REPLACE (CASE WHEN l_suppkey <> 6 THEN l_quantity END AS l_quantity) FROM lineitem) TO '{tmp_path}/missing.parquet'")
    (tmp_path / "missing.parquet").replace(tmp_path / "lineitem.parquet")
    report = registry.QUERIES["card_report"](spark, str(tmp_path))
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") == 1
    as_sql(spark, duck, tmp_path, "card_report")
    columns = ("a", "b", "attempts_a", "attempts_b", "excluded_a")
    assert {tuple(r[c] for c in columns) for r in report.collect()} == {(-1, 0, 1.0, 2.5, 0), (0, 1, 2.5, 4.0, 0), (5, 6, 6.5, None, 0), (6, 7, None, 12.0, 2)}
    assert same(spark, "card_report")
