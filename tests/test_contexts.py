"""Two times, held cards, saved markets; what a matchup's context shows and what it leaves out."""

import random

import pytest
from pyspark.sql import functions as F
from tallyspark.operators import context, replay


def test_results_count_from_their_capture_on(spark):
    """One participant's history at every cutoff, against a search of all revisions."""
    rnd = random.Random(1)
    bouts = [(b, f, rnd.randrange(60)) for b in range(60) for f in (1, 2)]
    days = {b: d for b, _, d in bouts}
    bouts = [(b, f, days[b]) for b, f, _ in bouts]
    revisions = []
    for b, f, d in bouts:
        for n in range(rnd.randrange(4)):
            revisions.append((b, f, d + rnd.randrange(-2, 12), n, rnd.choice([None, 0.0, 0.5, 1.0])))
    revisions += [(999, 1, 3, 0, 1.0), revisions[0]]
    got = replay.states(spark.createDataFrame(bouts, "bout_id long, fighter_id long, day int"), spark.createDataFrame(revisions, "bout_id long, fighter_id long, captured int, number int, points double")).collect()
    for f in (1, 2):
        mine = sorted(((r.day, r) for r in got if r.fighter_id == f), key=lambda x: x[0])
        for cutoff in range(0, 80):
            seen = [r for d, r in mine if d <= cutoff]
            state = (seen[-1].required, seen[-1].proven, seen[-1].scored, seen[-1].total) if seen else (0, 0, 0, 0.0)
            required = [b for b, g, d in bouts if g == f and d < cutoff]
            newest = {}
            for b, g, captured, n, points in sorted(revisions, key=lambda r: (r[2], r[3])):
                if g == f and b in required and captured <= cutoff:
                    newest[b] = points
            values = [v for v in newest.values() if v is not None]
            assert state == (len(required), len(newest), len(values), sum(values)), (f, cutoff)


CONTESTS = [(1, 1, 10), (1, 2, 10), (2, 1, 20), (2, 3, 20), (3, 2, 30), (3, 3, 30), (4, 4, 30), (4, 5, 30)]
TARGETS = [(3, "card", 2, 3, 30, 28), (4, "card", 4, 5, 30, 28), (5, "late", 1, 4, 40, 38), (6, "new", 7, 8, 40, 38)]


def replayed(spark, revisions, quotes=(), **how):
    return {
        r.bout_id: r
        for r in replay.replay(
            spark.createDataFrame(TARGETS, "bout_id long, card string, a long, b long, day int, cutoff int"),
            spark.createDataFrame(CONTESTS, "bout_id long, fighter_id long, day int"),
            spark.createDataFrame(revisions, "bout_id long, fighter_id long, captured int, number int, points double"),
            spark.createDataFrame(list(quotes), "bout_id long, book string, side long, price double, updated int, captured int"),
            **how,
        ).collect()
    }


PROVEN = [(1, 1, 11, 0, 1.0), (1, 2, 11, 0, 0.0), (2, 1, 21, 0, 0.5), (2, 3, 21, 0, 0.5)]


def test_one_missing_result_holds_the_card(spark):
    got = replayed(spark, PROVEN)
    assert (got[3].status, got[3].unproven, got[3].prior_a, got[3].prior_b) == ("exploratory", 0, 1, 1)
    assert got[3].p == pytest.approx((1 / 3) / (1 / 3 + 1.5 / 3)) and got[4].p == 0.5
    assert got[5].status == replay.HELD and got[5].unproven == 1  # contest 4 took place and has no result
    assert got[6].p == 0.5 and got[6].odds_status == "no_two_sided_book"
    late = replayed(spark, [*PROVEN[:3], (2, 3, 29, 0, 0.5)])  # captured a day after the cutoff
    assert late[3].status == late[4].status == replay.HELD and late[3].p is None and late[4].unproven == 1
    amended = replayed(spark, [*PROVEN, (1, 2, 28, 1, 1.0), (1, 2, 29, 2, None)])  # the newest that was captured by then
    assert amended[3].prior_a == 1 and amended[3].p == pytest.approx((2 / 3) / (2 / 3 + 1.5 / 3))


def test_saved_markets(spark):
    def books(quotes, **how):
        r = replayed(spark, PROVEN, quotes, **how)[3]
        return r.odds_status, r.books, r.market_p, r.age

    good = [(3, "x", 2, 2.0, 25, 26), (3, "x", 3, 2.0, 25, 26)]
    assert books(good) == ("two_sided", 1, 0.5, 3)
    assert books(good, start=F.col("bout_id") == 3) == ("started_at_capture", 0, None, None)
    none = ("no_two_sided_book", 0, None, None)
    for bad in (
        good[:1],  # one side
        [*good, (3, "x", 9, 3.0, 25, 26)],  # a third
        [good[0], (3, "x", 3, 2.0, 24, 26)],  # updated at different times
        [good[0], (3, "x", 3, None, 25, 26)],
        [good[0], (3, "x", 3, 1.0, 25, 26)],
        [(3, "x", 2, 2.0, 27, 26), (3, "x", 3, 2.0, 27, 26)],  # updated after the capture
        [(3, "x", 2, 2.0, 25, 29), (3, "x", 3, 2.0, 25, 29)],  # captured after the cutoff
        [good[0], good[0]],
        [*good, (3, "x", 2, 2.0, 27, 27)],  # a newer capture with one side hides the older one
    ):
        assert books(bad) == none, bad
    newer = [*good, (3, "x", 2, 4.0, 27, 28), (3, "x", 3, 4.0 / 3, 27, 28), (3, "y", 2, 2.0, 28, 28), (3, "y", 3, 2.0, 28, 28)]
    assert books(newer) == ("two_sided", 2, pytest.approx((0.25 / (0.25 + 0.75) + 0.5) / 2), 0)


STATS = ["sig_attempted", "sig_landed", "control_seconds", "kd", "td_attempted", "td_landed", "sub_attempts", "clinch_attempted", "ground_attempted", "body_attempted", "leg_attempted", "distance_attempted", "head_attempted"]


def records(spark, bouts):
    """bouts: (bout, day, a, b, outcome, points of a, eligible, landed of a)"""
    rows = []
    for bout, day, a, b, outcome, points, eligible, landed in bouts:
        for who, other, mine, own, their in ((a, b, points, landed, 10.0), (b, a, None if points is None else 1 - points, 10.0, landed)):
            value = {s: 20.0 for s in STATS} | {"sig_landed": own}
            opposing = {f"o_{s}": 20.0 for s in STATS} | {"o_sig_landed": their}
            rows.append({"bout_id": bout, "fighter_id": who, "opponent_id": other, "day": day, "event_id": day, "outcome": outcome, "points": mine, "elapsed": 600.0, "method": "ko_tko", "eligible": eligible} | value | opposing)
    schema = "bout_id long, fighter_id long, opponent_id long, day int, event_id long, outcome string, points double, elapsed double, method string, eligible boolean, " + ", ".join(f"{s} double, o_{s} double" for s in STATS)
    return spark.createDataFrame(rows, schema)


def test_a_context_leaves_out_the_target_its_date_and_the_embargo(spark):
    bouts = [(k, k * 10, 1, 10 + k, "win", 1.0, k != 3, 5.0) for k in range(1, 8)]
    bouts += [(20, 97, 1, 30, "win", 1.0, True, 5.0), (21, 98, 1, 31, "draw", 0.5, True, 5.0), (22, 100, 1, 32, "win", 0.0, True, 5.0), (50, 100, 1, 2, "win", 1.0, True, 5.0), (60, 101, 1, 33, "win", 1.0, True, 5.0)]
    bouts += [(70, 5, 15, 99, "win", 1.0, True, None), (71, 6, 15, 98, "draw", 0.5, True, 30.0)]
    side = {(r.bout_id, r.fighter_id): r for r in context.contexts(records(spark, bouts)).collect()}
    mine = side[50, 1]
    assert [f.bout_id for f in mine.fights] == [4, 5, 6, 7, 20] and mine.available == 8 and mine.left_out == 2  # 21 and 22
    assert mine.eligible == 5 and [f.result for f in mine.fights] == ["win"] * 5
    strength = {f.bout_id: f.strength for f in mine.fights}
    assert (strength[5].wins, strength[5].draws, strength[5].losses) == (1, 1, 0)  # opponent 15 before that date
    assert mine.opponent_win_rate == 0.75 and mine.opponent_rating is None
    assert [(m.method, m.wins, m.losses) for m in mine.methods] == [("ko_tko", 5, 0)]
    style = {m.name: m for m in mine.style}
    assert (style["striking_accuracy"].value, style["striking_accuracy"].n) == (0.25, 5) and style["sig_landed_per_minute"].value == 0.5 and style["striking_defence"].value == 0.5
    early = side[5, 1]  # contest 3 is held: shown, not measured
    assert [(f.bout_id, f.eligible) for f in early.fights] == [(1, True), (2, True), (3, False), (4, True)] and early.eligible == 3
    odd = {m.name: m for m in side[5, 15].style}["striking_accuracy"]
    assert (odd.n, odd.no_count, odd.above_exposure, odd.value) == (0, 1, 1, None)
    assert side[50, 2].fights == [] and side[50, 2].available == 0 and side[50, 2].opponent_win_rate is None
    ratings = spark.createDataFrame([(5, 15, 1600.0), (4, 14, 1500.0)], "bout_id long, fighter_id long, rating double")
    pair = context.matchups(records(spark, bouts), ratings).where("bout_id = 50").first()
    assert pair.a.fighter_id == 1 and pair.a.opponent_rating == 1600.0 and pair.b.fights == [] and {d.value for d in pair.differences} == {None}
    assert context.matchups(records(spark, bouts).where("false")).count() == 0


def test_only_what_is_shown_goes_to_the_contest(spark):
    """No nested cells of each metric are carried from row to row."""
    from tallyspark.plans import contexts

    plan = contexts.matchup_context(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "values" in plan and "measured" not in plan


def test_wide_records_are_shuffled_once(spark):
    """The opponents' records are stored before; the reader shuffles the rows by participant, the contexts by contest."""
    from tallyspark.plans import contexts

    plan = contexts.matchup_context(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2 and "lineitem" not in plan  # 5, and the lines, before


def test_brief_contexts_say_the_same(spark):
    bouts = [(k, k * 4, 1 + k % 2, 10 + k % 3, "win", 1.0, k % 3 != 0, 5.0) for k in range(1, 12)] + [(5, 20, 2, 12, "win", 1.0, True, 5.0), (30, 70, 1, 40, "draw", 0.5, True, None)]
    whole = {repr((r.bout_id, r.fighter_id, r.day)): r for r in context.contexts(records(spark, bouts)).collect()}
    brief = context.contexts(records(spark, bouts), brief=True).collect()
    assert len(brief) == 2 * len(bouts)
    for r in brief:
        other = whole[repr((r.bout_id, r.fighter_id, r.day))]
        assert [(f.bout_id, f.result, f.eligible, f.strength) for f in r.fights] == [(f.bout_id, f.result, f.eligible, f.strength) for f in other.fights]
        assert [(m.name, m.value) for m in r.style] == [(m.name, m.value) for m in other.style]
        assert (r.available, r.left_out, r.eligible, r.opponent_win_rate) == (other.available, other.left_out, other.eligible, other.opponent_win_rate)
