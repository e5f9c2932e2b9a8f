"""Ratings in blocks and levels equal one plain fold."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from tallyspark.operators import folds


def made(seed, people, n, dates):
    rnd = random.Random(seed)
    out = []
    for bout in range(n):
        a, b = rnd.sample(range(people), 2)
        out.append((bout, rnd.randrange(5), dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(dates)), a, b, rnd.choice([None, 0.0, 0.5, 1.0])))
    return out


def plain(rows, k, by_date, date_snapshot):
    rating, out, at = defaultdict(lambda: 1500.0), {}, None
    held, first = defaultdict(float), {}
    for bout, event, day, a, b, score in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        if day != at:
            for who, change in held.items():
                rating[who] += change
            at, held, first = day, defaultdict(float), {}
        ra, rb = rating[a], rating[b]
        sa, sb = (first.setdefault(a, ra), first.setdefault(b, rb)) if date_snapshot else (ra, rb)
        out[bout] = sa, sb, 1 / (1 + 10 ** ((sb - sa) / 400))
        if score is not None:
            change = k * (score - 1 / (1 + 10 ** ((rb - ra) / 400)))
            if by_date:
                held[a] += change
                held[b] -= change
            else:
                rating[a] += change
                rating[b] -= change
    return out


SCHEMA = "bout_id long, event_id long, event_date date, a long, b long, score double"


@pytest.mark.parametrize("by_date,date_snapshot", [(False, False), (True, False), (False, True)])
@pytest.mark.parametrize("people,n,dates,most", [(30, 60, 6, 1000), (30, 60, 6, 15), (12, 24, 2, 5)])
def test_blocks_and_levels_equal_a_plain_fold(spark, by_date, date_snapshot, people, n, dates, most):
    rows = made(people + most, people, n, dates)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, 32.0, by_date, date_snapshot)
    got = {r.bout_id: (r.rating_a, r.rating_b, r.p_a) for r in folds.one_pool(frame, 32.0, by_date=by_date, date_snapshot=date_snapshot, most=most).collect()}
    assert got.keys() == want.keys()
    for bout, values in want.items():
        assert got[bout] == pytest.approx(values, abs=1e-9), bout


def test_blocks_hold_whole_dates(spark):
    day = lambda d: dt.date(2024, 1, d)
    frame = spark.createDataFrame([(1, 1, day(d), 1, 2, 1.0) for d in (1, 1, 2, 3, 3, 3, 3, 3, 4, 5)], SCHEMA)
    assert folds.blocks(frame, 4) == [(day(1), day(2), 3), (day(3), day(3), 5), (day(4), day(5), 2)]
    assert folds.one_pool(frame.where("false"), 32.0).count() == 0
    assert folds.one_pool(frame.selectExpr("bout_id", "event_id", "cast(null as date) event_date", "a", "b", "score"), 32.0).count() == 0
    assert folds.one_pool(frame, 32.0).columns == folds.one_pool(frame, 32.0, most=4).columns


def test_contests_are_made_once_whatever_the_number_of_blocks(spark):
    """They are counted by date, stored, and each block reads its own rows."""
    made_rows = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            made_rows.add(len(frame))
            yield frame

    frame = spark.createDataFrame(made(5, 30, 400, 20), SCHEMA).mapInPandas(count, SCHEMA)
    assert folds.one_pool(frame, 32.0, most=25).count() == 400
    assert made_rows.value == 800  # each block made them all again before: 18 and more times 400


@pytest.mark.parametrize("by_date,date_snapshot", [(False, False), (True, False), (False, True)])
def test_stream_over_dates_longer_than_a_batch(spark, by_date, date_snapshot):
    """Contests that go together, long chains and dates that two batches share equal the plain fold."""
    chain = [(1000 + i, 9, dt.date(2024, 1, 2), 0, 1 + i % 3, 1.0) for i in range(150)]
    rows = made(3, 500, 900, 4) + chain
    want = plain(rows, 32.0, by_date, date_snapshot)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 170)
    try:
        got = {r.bout_id: (r.rating_a, r.rating_b, r.p_a) for r in folds.one_pool(spark.createDataFrame(rows, SCHEMA), 32.0, by_date=by_date, date_snapshot=date_snapshot).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys()
    for bout, values in want.items():
        assert got[bout] == pytest.approx(values, abs=1e-9), bout


@pytest.mark.parametrize("most", [1000, 7])
def test_rules_share_a_pass(spark, most):
    """Several rules over one stream (or block, or large date) give what each gives alone."""
    rows = made(8, 20, 18, 3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = folds.pools(frame, [folds.Rule(32.0, date_snapshot=True), folds.Rule(64.0, by_date=True)], most=most).collect()
    assert len(got) == len(rows)
    for n, want in enumerate((plain(rows, 32.0, False, True), plain(rows, 64.0, True, False))):
        for r in got:
            assert (r[f"rating_a{n}"], r[f"rating_b{n}"], r[f"p_a{n}"]) == pytest.approx(want[r.bout_id], abs=1e-9)
