"""Gates, states, decisions, reviewed imports, receipts and year tables: by hand, and all outcomes of the registered queries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import decisions, evaluate, evidence
from tallyspark.plans import registry
from tallyspark.sources import reviewed, wikitext

NOW = datetime(2024, 1, 20, 12)
SF = "/root/testdata/sf0.001"
GATE = "now timestamp, snapshot_at timestamp, starts_at timestamp, as_of timestamp, captured_at timestamp, updated_at timestamp, decision string, model_p double, market_p double, quote_id long, book string, selection_p double, price double"


def scored(**change):
    at = lambda s: NOW - timedelta(seconds=s)
    row = {"now": NOW, "snapshot_at": at(20), "starts_at": at(-60), "as_of": at(10), "captured_at": at(20), "updated_at": at(30), "decision": "candidate", "model_p": 0.55, "market_p": 0.5, "quote_id": 1, "book": "x", "selection_p": 0.55, "price": 2.0}
    return tuple((row | change).values())


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, "ok"), ({"market_p": None}, "ok"), ({"now": None}, "invalid_reference_time"), ({"starts_at": NOW}, "event_started"), ({"market_p": float("nan")}, "invalid_market_probability"), ({"model_p": 0.75}, "pass_market_disagreement"),
        ({"decision": "pass_market_disagreement"}, "pass_market_disagreement"), ({"decision": None}, "not_model_candidate"), ({"book": None}, "missing_quote"), ({"updated_at": None}, "invalid_row_time"), ({"snapshot_at": NOW}, "different_snapshot"),
        ({"as_of": NOW + timedelta(seconds=1)}, "invalid_time_order"), ({"updated_at": NOW - timedelta(seconds=61)}, "stale_data"), ({"selection_p": 1.0}, "invalid_probability"), ({"selection_p": None}, "invalid_probability"), ({"price": float("inf")}, "invalid_odds"),
        ({"price": None}, "invalid_odds"), ({"price": 1.04}, "price_drift_exhausts_odds"), ({"price": 1.9}, "edge_below_floor"),
    ],
)
def test_gate(spark, change, reason):
    (row,) = decisions.alert_gate(spark.createDataFrame([scored(**change)], GATE)).collect()
    assert (row.alert_reason, row.alert_eligible) == (reason, reason == "ok")
    assert (row.conservative_price is None) == (reason not in ("ok", "edge_below_floor"))
    if reason == "ok":
        assert row.conservative_price == pytest.approx(1.95) and row.conservative_profit == pytest.approx(0.0725)


def test_gate_of_nothing_and_bad_limits(spark):
    none = spark.createDataFrame([], GATE)
    assert decisions.alert_gate(none).count() == 0
    with pytest.raises(ValueError):
        decisions.alert_gate(none, max_gap=1.5)


def test_every_outcome_occurs(spark):
    of = lambda q, c, sf=SF: {r[0] for r in registry.QUERIES[q](spark, sf).select(c).distinct().collect()}
    assert len(of("alert_gates", "reason", "/root/testdata/sf0.01")) == 15
    assert len(of("availability_states", "availability")) == 12
    assert of("score_events", "decision", "/root/testdata/sf0.01") == {"pass_market_disagreement", "research_only", "candidate", "pass", "no_quote"}
    assert len(of("reviewed_contests", "problem")) == 10
    assert of("reviewed_counts", "problem") == {None, "landed", "landed_above_attempted", "no_finished_contest", "observed_too_early", "stored_already", "conflicts_with_stored"} | ({"conflicting_rows"} & of("reviewed_counts", "problem"))
    assert of("year_tables", "problem") == {None, "non_numeric_number", "event_cell", "event_date", "other_year"}
    totals = registry.QUERIES["evidence_integrity"](spark, SF).drop("source").groupBy().sum().first()
    assert all(n > 0 for n in totals)


def test_decisions(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.61, 0.5, 3.0, 1), (2, 0.5, None, 0.5, 2.1, 2), (3, 0.5, 0.5, 0.5, 2.0, 3), (4, 0.5, None, None, None, None)], "id int, model_p double, market_p double, selection_p double, price double, quote_id long")
    got = {r.id: r for r in decisions.decide(rows, F.lit(False)).collect()}
    assert [got[k].decision for k in (1, 2, 3, 4)] == ["pass_market_disagreement", "candidate", "pass", "no_quote"]
    assert got[2].expected_profit == pytest.approx(0.05) and got[2].break_even == pytest.approx(1 / 2.1) and got[2].market_gap is None
    assert [r.decision for r in decisions.decide(rows.where("id = 2"), F.lit(True)).collect()] == ["research_only"]


def test_profiles_against_themselves_and_what_is_stored(spark):
    columns = "fighter_id string, observed_at string, source_evidence_uri string, birth_date string, reach_cm string, remark string"
    at = "2024-01-01T00:00:00Z"
    rows = [("a", at, "u", "1990-01-01", "180", "first"), ("a", at, "u", "1990-01-01", " 180 ", "again"), ("b", at, "u", "", "180", ""), ("b", at, "u", "", "181", ""), ("c", at, "u", None, "190", None), (None, at, "u", None, "190", None), ("d", "2024-01-01", "u", None, "190", None), ("d", at, " ", None, "190", None), ("d", at, "u", None, "nan", None), ("zz", at, "u", None, "190", None), ("e", "2023-12-31T23:00:00-01:00", "u", None, "170.5", None)]
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",), ("e",)], "fighter_id string")
    stored = spark.createDataFrame([("c", datetime(2024, 1, 1), "u", None, 191.0), ("e", datetime(2024, 1, 1), "u", None, 170.5)], "fighter_id string, at timestamp, source_evidence_uri string, birth_date date, reach_cm double")
    now = F.lit("2025-01-01T00:00:00Z").cast("timestamp")
    frame = spark.createDataFrame(rows, columns)
    got = sorted(((r.fighter_id or "", r.problem) for r in reviewed.profile_observations(frame, known, now, stored).collect()), key=repr)
    want = [("a", None), ("a", None), ("b", "conflicting_rows"), ("b", "conflicting_rows"), ("c", "conflicts_with_stored"), ("", "fighter_id_required"), ("d", "observed_at"), ("d", "evidence_required"), ("d", "reach_out_of_range"), ("zz", "unknown_participant"), ("e", "stored_already")]
    assert got == sorted(want, key=repr)
    assert "remark" in reviewed.profile_observations(frame, known, now).columns
    assert reviewed.profile_observations(frame.limit(0), known, now, stored).count() == 0


def test_counts_follow_the_start(spark):
    rows = spark.createDataFrame([("1", "a", "2024-01-01T20:00:00Z", "u", "3", "4"), ("1", "a", "2024-01-01T22:00:00Z", "u", "3", "4"), ("2", "a", "2024-01-01T22:00:00Z", "u", "3", "4"), ("2", "c", "2024-01-02T00:00:00Z", "u", "3", "4"), ("3", "a", "2024-01-02T00:00:00Z", "u", "3", "4"), ("2", "a", "2024-01-02T00:00:00Z", "u", "3.5", "4")], "bout_id string, fighter_id string, observed_at string, source_evidence_uri string, landed string, attempted string")
    day = datetime(2024, 1, 1).date()
    bouts = spark.createDataFrame([("1", "a", "b", True, day, datetime(2024, 1, 1, 21)), ("2", "a", "b", True, day, None), ("3", "a", "b", False, day, None)], "bout_id string, a string, b string, over boolean, event_date date, starts_at timestamp")
    got = reviewed.stat_observations(rows, bouts, F.lit("2025-01-01T00:00:00Z").cast("timestamp")).collect()
    assert sorted(((r.bout_id, r.fighter_id, r.at.hour, r.problem) for r in got), key=repr) == sorted([("1", "a", 20, "observed_too_early"), ("1", "a", 22, None), ("2", "a", 22, "observed_too_early"), ("2", "c", 0, "no_finished_contest"), ("3", "a", 0, "no_finished_contest"), ("2", "a", 0, "landed")], key=repr)


def test_receipts_find_moved_files(spark, tmp_path):
    for name, text in (("a", "one"), ("moved", "two"), ("c", "three")):
        (tmp_path / name).write_text(text)
    digest = lambda text: __import__("hashlib").sha256(text.encode()).hexdigest()
    path = lambda name: f"file:{tmp_path}/{name}"
    rows = [(1, "s", path("a"), digest("one")), (2, "s", path("b"), digest("two")), (3, "s", path("c"), digest("other")), (4, "s", path("gone"), digest("gone")), (5, "t", "", digest("one")), (6, "t", path("a"), None)]
    checked = evidence.verify_receipts(spark.createDataFrame(rows, "run_id int, source string, path string, sha256 string"), evidence.payload_digests(spark, [str(tmp_path)]))
    got = {r.run_id: (r.problem, (r.found_at or "").rsplit("/", 1)[-1]) for r in checked.collect()}
    assert got == {1: (None, "a"), 2: (None, "moved"), 3: ("payload_hash_mismatch", ""), 4: ("missing_payload", ""), 5: ("missing_payload_path", ""), 6: ("invalid_receipt_hash", "")}
    assert sorted(map(tuple, evidence.receipt_summary(checked).collect())) == [("s", 4, 2, 0, 0, 1, 1), ("t", 2, 0, 1, 1, 0, 0)]


def test_year_table(spark):
    source = """intro {| class="z"
! Name
|-
| 1 || [[Not an event]] || Jan 1, 2024
|}
==Events list==
{| class="wikitable"
! scope="col" | #
! scope="col" | Event
! scope="col" | Date
! Venue
|-
| align=center | 12 <!-- | 13 -->
| {{sort|12|[[Card 12: A vs. B|Card 12]]}}
| {{dts|2024|March|9}}
| {{nowrap|Hall || One}}
|- style="x"
| 11 || [[Card_11]] || Mar 2, 2024 || Hall
|-
| — || [[Card X]] || February 3, 2024
|-
| colspan="4" | Bonus awards
|-
| 10 || [[Card 10#Results]] || Jan 6, 2024
|-
| 9 || [[Card 9]] || Dec 30, 2023
|-
| 8 || [[Card 8]] || 31 Feb 2024
|}"""
    rows = wikitext.year_events(spark.createDataFrame([(1, 2024, source), (2, 2024, None), (3, 2024, "{|\n|-\n| 1\n|}")], "page_id long, year int, source string")).collect()
    got = [(r.number, r.title, r.name, str(r.event_date), r.problem) for r in sorted(rows, key=lambda r: r.row)]
    assert got == [(12, "Card 12: A vs. B", "Card 12", "2024-03-09", None), (11, "Card 11", "Card 11", "2024-03-02", None), (None, "Card X", "Card X", "2024-02-03", "non_numeric_number"), (10, None, None, "2024-01-06", "event_cell"), (9, "Card 9", "Card 9", "2023-12-30", "other_year"), (8, "Card 8", "Card 8", "None", "event_date")]


def test_models_are_compared_on_their_own_coverage(spark):
    rows = spark.createDataFrame([(0.8, None, 1), (0.6, 0.9, 0), (0.4, 0.2, 0)], "p double, book double, y int")
    out = evaluate.compared(rows, {"m": F.col("p"), "book": F.col("book")}, {"all": F.lit(True), "priced": F.col("book").isNotNull()}, "y")
    got = {(r.model, r.cohort): r for r in out.collect()}
    assert [(got[k].asked, got[k].n) for k in (("m", "all"), ("book", "all"), ("m", "priced"), ("book", "priced"))] == [(3, 3), (3, 2), (2, 2), (2, 2)]
    assert got["m", "all"].brier == pytest.approx((0.04 + 0.36 + 0.16) / 3) and got["book", "all"].accuracy == 0.5
