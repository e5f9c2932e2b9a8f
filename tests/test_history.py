"""Lookups in a laid-out history: what they return, and how few files they read."""

import pytest
from pyspark.sql import functions as F
from tallyspark.operators import history

FIELDS = ["landed", "control_seconds"]


def files_read(df) -> int:
    """The scan's own count, after the plan has run."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    text, total = [plan], 0
    while text:
        node = text.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            text.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            text.append(node.plan())
            continue
        metrics = node.metrics()
        if node.nodeName().startswith("Scan") and metrics.contains("numFiles"):
            total += metrics.apply("numFiles").value()
        children = node.children()
        text += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('history')}/v1"
    facts = [(b, f, 3 - f if f < 3 else 9, b * 10, 600.0 if b % 3 else None, float(b + f), 5.0 if b != 4 else None, float(b), 4.0) for b in range(1, 40) for f in ((1, 2) if b % 2 else (3, 4))]
    tables = {
        "profiles": spark.createDataFrame([(k, f"name {k}", 180.0) for k in range(1, 500)], "fighter_id long, name string, reach_cm double"),
        "links": spark.createDataFrame([(10_001, 1), (10_002, 2), (10_003, 3), (10_003, 4)], "research_id long, fighter_id long"),
        "events": spark.createDataFrame([(k, k * 10) for k in range(1, 40)], "event_id long, day int"),
        "bouts": spark.createDataFrame([(b // 4, b) for b in range(1, 40)], "event_id long, bout_id long"),
        "facts": spark.createDataFrame(facts, "bout_id long, fighter_id long, opponent_id long, day int, elapsed double, landed double, control_seconds double, o_landed double, o_control_seconds double"),
        "rounds": spark.createDataFrame([(b, n, f, 300.0 if n < 3 else None, 250.0 if n != 2 else 301.0) for b in range(1, 40) for n in (2, 1, 3) for f in (2, 1)], "bout_id long, number int, fighter_id long, elapsed double, control_seconds double"),
    }
    history.lay_out(tables, root)
    return history.History(spark, root, FIELDS)


def test_lookups(laid_out):
    h = laid_out
    assert h.fighter_id(1) == 1 and h.fighter_id(10_001) == 1 and h.fighter_id(10_003) is None and h.fighter_id(77_777) is None
    assert h.fighter_profile(10_002).first().name == "name 2" and h.fighter_profile(77_777).count() == 0
    assert h.event(3).first().day == 30 and [r.bout_id for r in h.event_bouts(2).collect()] == [8, 9, 10, 11]
    assert [r.bout_id for r in h.prior_fighter_bouts(10_001, 70).collect()] == [1, 3, 5]
    assert [r.bout_id for r in h.last_bouts(1, 200, 2).collect()] == [19, 17]
    rounds = [tuple(r) for r in h.bout_rounds(5).select("number", "fighter_id", "control_seconds").collect()]
    assert rounds == [(1, 1, 250.0), (1, 2, 250.0), (2, 1, None), (2, 2, None), (3, 1, 250.0), (3, 2, 250.0)]
    one = h.fighter_aggregate(1, 70).first()
    assert (one.bouts, one.elapsed, one.known_elapsed, one.duration_bouts, one.landed, one.missing_control_seconds) == (3, None, 1200.0, 2, 12.0, 0)
    other = h.fighter_aggregate(3, 70).first()
    assert (other.bouts, other.control_seconds, other.missing_control_seconds, other.o_landed) == (3, None, 1, 12.0)
    none = h.fighter_aggregate(1, 5).first()
    assert none.bouts == 0 and none.landed is None and none.known_elapsed == 0
    assert h.fighter_aggregate(77_777, 500).first().bouts == 0


def test_lookups_read_one_bucket(laid_out):
    h = laid_out
    whole = files_read(h.table("facts").where("fighter_id = 1"))
    assert whole >= 4
    for name, value in (("facts", 1), ("profiles", 7), ("rounds", 5), ("bouts", 2), ("events", 3), ("links", 10_001)):
        assert 1 <= files_read(h.of(name, value)) <= 4, name
    assert files_read(h.table("profiles").where("fighter_id = 7")) > 30 and files_read(h.of("profiles", 7)) == 1


def test_aggregates_before_equal_lookups(laid_out):
    every = {(r.bout_id, r.fighter_id): r for r in history.aggregates_before(laid_out.table("facts"), FIELDS).collect()}
    for bout, who in ((1, 1), (7, 2), (12, 3), (39, 1)):
        assert every[bout, who].asDict() == {"bout_id": bout, "fighter_id": who, **laid_out.fighter_aggregate(who, bout * 10).first().asDict()}


def test_coverage_keeps_what_has_no_contest(spark):
    events = spark.createDataFrame([(1,), (2,)], "event_id long")
    bouts = spark.createDataFrame([(10, 1, 5, 6, "usable", None), (11, 1, None, 6, "held", 60.0)], "bout_id long, event_id long, a long, b long, status string, elapsed double")
    profiles = spark.createDataFrame([(5, 180.0), (6, 170.0), (7, None)], "fighter_id long, reach_cm double")
    none = spark.createDataFrame([], "id long, research_id string")
    got = {r.event_id: r for r in history.event_coverage(events, bouts, profiles, none).collect()}
    assert (got[1].bouts, got[1].paired_stat_bouts, got[1].duration_stat_bouts, got[1].held_bouts, got[1].identity_resolved_bouts, got[1].both_reach_bouts) == (2, 1, 0, 1, 1, 1)
    assert got[2].bouts == 0
    facts = spark.createDataFrame([(5, 3, 60.0), (5, 9, None)], "fighter_id long, day int, elapsed double")
    found = {r.fighter_id: r for r in history.fighter_coverage(profiles, facts, none).collect()}
    assert (found[5].paired_stat_bouts, found[5].duration_stat_bouts, found[5].first_day, found[5].last_day) == (2, 1, 3, 9) and found[7].paired_stat_bouts == 0
    assert [r.position for r in history.numbered(bouts).orderBy("bout_id").collect()] == [1, 2]


def test_crosswalk_never_multiplies_rows(spark):
    facts = spark.createDataFrame([(1, 5, 6), (2, 5, 7)], "bout_id long, fighter_id long, opponent_id long")
    bouts = spark.createDataFrame([(1, "B1"), (1, "B2"), (2, "B3"), (2, "B3")], "id long, research_id string")
    fighters = spark.createDataFrame([(5, "F5"), (7, "F7")], "id long, research_id string")
    got = sorted(tuple(r) for r in history.crosswalk(facts, bouts, fighters).select("bout_id", "research_bout_id", "research_fighter_id", "research_opponent_id").collect())
    assert got == [(1, None, "F5", None), (2, "B3", "F5", "F7")]
    assert facts.select(history.bucket(F.col("fighter_id"), 8)).distinct().count() == 1


def test_last_rows_with_ties_hold_no_window(spark):
    """A sorted stream by participant: no window, and results that do not hang on where a batch ends. Rows without a date are no one's past."""
    import random

    from tallyspark.operators import asof

    rnd = random.Random(5)
    rows = [(rnd.choice("abc"), rnd.choice([None, *range(12)]), i, float(rnd.randint(0, 9))) for i in range(150)]
    frame = spark.createDataFrame(rows, "k string, day int, id int, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = asof.last_with_ties(frame, "k", "day", "id", ["x"], 5, 3)
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: (r.n_last, r.last_x) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, day, i, _ in rows:
        past = sorted(((d, x) for kk, d, _, x in rows if kk == k and d is not None and day is not None and d < day - 2), reverse=True)
        kept = [x for d, x in past if len(past) <= 5 or d >= past[4][0]]
        assert got[i] == (len(kept), sum(kept))
