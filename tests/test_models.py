"""Feature vectors, metric bundles and the refresh against hand values and a plain replay."""

import bisect
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tallyspark.operators import evaluate, features, folds, ledger
from tallyspark.plans import models, refresh, registry

STATS = ("sig_landed", "sig_attempted", "kd", "td_landed", "td_attempted", "sub_attempts", "control_seconds", "clinch_attempted", "ground_attempted", "body_attempted", "leg_attempted", "distance_attempted", "head_attempted")
SCHEMA = "bout_id int, fighter_id int, opponent_id int, day int, event_id int, points double, elapsed double, method string, birth_day int, reach_cm double, " + ", ".join(f"{p}{s} double" for s in STATS for p in ("", "o_"))


def two_sides(bout, day, a, b, points, elapsed, method, one, two, people):
    """Both records of a contest; points are those of a."""
    for me, other, own, theirs, p in ((a, b, one, two, points), (b, a, two, one, None if points is None else 1 - points)):
        yield (bout, me, other, day, day % 3, p, elapsed, method, *people.get(me, (None, None)), *[x for s in STATS for x in (own.get(s), theirs.get(s))])


def test_recent_metrics_by_hand(spark):
    one = {"sig_landed": 60.0, "sig_attempted": 100.0, "kd": 1.0, "td_landed": 2.0, "td_attempted": 4.0, "sub_attempts": 0.0}
    two = {"sig_landed": 30.0, "sig_attempted": 80.0, "kd": 0.0, "td_landed": 1.0, "td_attempted": 5.0, "sub_attempts": 0.0}
    rows = [*two_sides(1, 10, 1, 2, 1.0, 600.0, "ko_tko", one, two, {}), *two_sides(2, 20, 1, 3, 1.0, 600.0, "other", {}, {}, {}), *two_sides(3, 12, 1, 4, None, None, None, {}, {}, {})]
    got = {r.bout_id: r for r in features.metrics_before(spark.createDataFrame(rows, SCHEMA), features.RECENT).where("fighter_id = 1").collect()}
    want = {"sig_landed_per_minute": 3.75, "sig_absorbed_per_minute": 3.0, "sig_accuracy": 85 / 150, "sig_defence": 1 - 55 / 130, "knockdowns_per_15": 0.45, "takedown_accuracy": 6 / 14, "takedown_defence": 2 / 3, "control_share": 0.25}
    for name, value in want.items():
        assert got[2][name] == pytest.approx(value), name
    assert got[2].control_share_n == 0 and got[2].sig_accuracy_n == 1 and got[2].n_last == 2
    assert got[3].n_last == 0 and got[3].sig_accuracy == 0.5  # two days before is too near


def replay(rows, people):
    """All vectors by a plain replay: rows are (bout, day, a, b, points of a, elapsed, method, stats of a, stats of b)."""
    rating, strong, history, out, snapshots = defaultdict(lambda: 1500.0), defaultdict(lambda: 1500.0), defaultdict(list), {}, {}
    expect = lambda r, a, b: 1 / (1 + 10 ** ((r[b] - r[a]) / 400))

    def known(f, day):
        past = [h for h in history[f] if h["day"] < day]
        scored = [h for h in past if h["points"] is not None]
        residuals = [h["residual"] for h in past if h["residual"] is not None]
        return {"n": len(scored), "total": sum(h["points"] for h in scored), "last": max((h["day"] for h in scored), default=None), "form": (sum(h["points"] for h in scored[-5:]) + 1) / (len(scored[-5:]) + 2), "stat_n": len(residuals), "adjusted": sum(residuals) / (len(residuals) + 2), "birth": people[f][0], "reach": people[f][1], "elo": rating[f]}

    def last_five(f, day):
        past = [h for h in history[f] if h["day"] < day - 2]
        return past if len(past) <= 5 else [h for h in past if h["day"] >= past[-5]["day"]]

    def metric(m, past):
        num = den = n = 0.0
        for h in past:
            env = defaultdict(lambda: None, h["env"])
            v = {"rate": lambda: None}
            num_, den_, ok, counted = measure(m, env)
            if ok:
                num, den, n = num + num_, den + den_, n + counted
        value = (num + m.prior * m.weight / m.unit) / (den + m.weight) * m.unit
        return (1 - value if m.complement else value), n

    def measure(m, e):
        if m.name in ("ko_win_share", "ko_loss_share", "submission_win_share", "submission_loss_share"):
            ok = e["points"] in (0, 1) and e["method"] in ("ko_tko", "submission", "decision", "decision_unanimous", "decision_split", "decision_majority")
            method, points = ("ko_tko" if m.name.startswith("ko") else "submission"), (1 if "win" in m.name else 0)
            return float(e["method"] == method and e["points"] == points), 1.0, ok, 1
        if m.name in ("opponent_win_rate", "opponent_elo"):
            return (e["o_rate"] if m.name == "opponent_win_rate" else e["o_elo"]), 1.0, e["o_rate"] is not None, 1
        num, elapsed = e[m.num], e["elapsed"]
        if m.den == "elapsed / 60":
            return num, (elapsed or 0) / 60, num is not None and bool(elapsed), 1
        den = e[m.den]
        ok = num is not None and den is not None and num <= den and (m.weight not in (1800.0,) or den > 0)
        if m.name.endswith("_share") and m.den == "sig_attempted":
            ok = ok and den > 0
        return num, den, ok, int(ok and (m.name == "control_share" or den > 0))

    for day in sorted({r[1] for r in rows}):
        today = sorted((r for r in rows if r[1] == day), key=lambda r: (r[1] % 3, r[0]))
        for bout, _, a, b, *_ in today:
            x, y = known(a, day), known(b, day)
            rest = lambda s: 0.0 if s["last"] is None else min(day - s["last"], 730) / 365
            age = lambda s: (day - s["birth"]) / 365.2425
            both = lambda k: x[k] is not None and y[k] is not None
            base = [(x["elo"] - y["elo"]) / 400, math.log1p(x["n"]) - math.log1p(y["n"]), (x["total"] + 1) / (x["n"] + 2) - (y["total"] + 1) / (y["n"] + 2), rest(x) - rest(y), (x["last"] is not None) - (y["last"] is not None), x["form"] - y["form"]]
            base += [(age(x) - age(y)) / 10 if both("birth") else 0.0, (x["birth"] is not None) - (y["birth"] is not None), (x["reach"] - y["reach"]) / 20 if both("reach") else 0.0, (x["reach"] is not None) - (y["reach"] is not None)]
            base += [x["adjusted"] - y["adjusted"], (x["stat_n"] > 0) - (y["stat_n"] > 0), math.log1p(x["stat_n"]) - math.log1p(y["stat_n"])]
            hinge = (max(age(x) - 32, 0) - max(age(y) - 32, 0)) / 5 if both("birth") else 0.0
            reduced = [v for n, v in zip(features.BASE, base, strict=True) if n not in features.COVERAGE] + [hinge]
            pa, pb = last_five(a, day), last_five(b, day)
            rich = reduced + [(metric(m, pa)[0] - metric(m, pb)[0]) / m.scale for m in features.RECENT]
            whole = list(rich)
            for m in (*features.CONTEXT, features.OPPONENT_ELO):
                (u, nu), (v, nv) = metric(m, pa), metric(m, pb)
                whole += [(u - v) / m.scale, (nu > 0) - (nv > 0)]
            out[bout] = base, reduced, rich, whole
            snapshots[bout] = {a: (strong[a], x), b: (strong[b], y)}
        news, changes = [], defaultdict(float)
        for bout, _, a, b, points, elapsed, method, one, two in today:
            for me, other, own, theirs, p in ((a, b, one, two, points), (b, a, two, one, None if points is None else 1 - points)):
                shown = p is not None and own.get("sig_landed") is not None and theirs.get("sig_landed") is not None and own["sig_attempted"] > 0 and theirs["sig_attempted"] > 0
                given = [h for h in history[other] if h["shown"]]
                residual = own["sig_landed"] / own["sig_attempted"] - (sum(h["env"]["o_sig_landed"] for h in given) + 1) / (sum(h["env"]["o_sig_attempted"] for h in given) + 2) if shown else None
                o = snapshots[bout][other]
                env = {"points": p, "elapsed": elapsed, "method": method, "o_elo": o[0], "o_rate": o[1]["total"] / o[1]["n"] if o[1]["n"] else None} | own | {f"o_{k}": v for k, v in theirs.items()}
                news.append((me, {"day": day, "points": p, "residual": residual, "shown": shown, "env": env, "key": (day, day % 3, bout)}))
            if points is not None:
                change = 64 * (points - expect(strong, a, b))
                changes[a] += change
                changes[b] -= change
                step = 32 * (points - expect(rating, a, b))
                rating[a], rating[b] = rating[a] + step, rating[b] - step
        for who, c in changes.items():
            strong[who] += c
        for who, h in news:
            bisect.insort(history[who], h, key=lambda h: h["key"])
    return out


def test_vectors_equal_a_plain_replay(spark):
    rnd = random.Random(17)
    people = {f: (rnd.choice([None, -12000, -4000]), rnd.choice([None, 170.0, 190.0])) for f in range(8)}
    rows = []
    for bout in range(120):
        a, b = sorted(rnd.sample(range(8), 2))
        stats = []
        for _ in range(2):
            att = rnd.choice([0, 10, 50])
            s = {x: float(rnd.randint(0, 9)) for x in STATS} | {"sig_attempted": float(att), "sig_landed": rnd.choice([None, float(rnd.randint(0, att))]), "control_seconds": rnd.choice([None, 30.0, 2000.0])}
            stats.append(s)
        rows.append((bout, rnd.randint(0, 60), a, b, rnd.choice([1.0, 0.0, 0.5, None]), rnd.choice([None, 300.0, 900.0]), rnd.choice(["ko_tko", "submission", "decision_split", "other"]), *stats))
    frame = spark.createDataFrame([x for bout, day, a, b, p, e, m, s, t in rows for x in two_sides(bout, day, a, b, p, e, m, s, t, people)], SCHEMA)
    contests = spark.createDataFrame([(day, day % 3, bout, a, b, p) for bout, day, a, b, p, *_ in rows], "event_date int, event_id int, bout_id int, a int, b int, score double")
    of = lambda k, names, **how: folds.elo(contests, None, k, **how).select("bout_id", F.col("rating_a").alias(names[0]), F.col("rating_b").alias(names[1]))
    got = features.vectors(frame, of(32.0, ("elo_a", "elo_b"), date_snapshot=True), of(64.0, ("strong_a", "strong_b"), by_date=True)).collect()
    want = replay(rows, people)
    assert len(got) == len(rows)
    for r in got:
        assert [len(x) for x in r[1:]] == [13, 11, 21, 43]
        for have, plain in zip(r[1:], want[r.bout_id], strict=True):
            assert list(have) == pytest.approx(plain, abs=1e-9), r.bout_id


def test_one_pool_follows_participants_across_divisions(spark):
    rows = [(1, 0, 1, 1, 2, 1.0, "x"), (2, 0, 2, 1, 3, 1.0, "y"), (3, 0, 3, 1, 2, 0.0, "y")]
    frame = spark.createDataFrame(rows, "event_date int, event_id int, bout_id int, a int, b int, score double, division string")
    got = {r.bout_id: r.rating_a for r in folds.elo(frame, None, 32.0).collect()}
    assert got[1] == 1500 and got[2] == 1516 and got[3] > got[2]
    apart = {r.bout_id: r.rating_a for r in folds.elo(frame, "division", 32.0).collect()}
    assert apart[2] == 1500


def test_chains_are_verified(spark):
    rows = spark.createDataFrame([(u, i, f"p{i}") for u in range(3) for i in range(5)], "u int, i int, payload string").repartition(4)
    entries = ledger.chained(rows, "u", ["i"])
    assert ledger.verify(entries, "u").where("problem is not null").count() == 0
    assert {r.problem for r in registry.QUERIES["chain_verification"](spark, "/root/testdata/sf0.001").collect()} == {None, "gap", "broken_link", "wrong_digest"}


def test_planted_faults_are_found(spark):
    at = "/root/testdata/sf0.01"
    report = {r.lang: r for r in registry.QUERIES["report_invariants"](spark, at).collect()}
    assert not report["de"].rows_match and not report["de"].outcomes_add_up and not report["fr"].metrics_match and report["en"].rows_match and report["en"].metrics_match
    assert {r.explained for r in registry.QUERIES["explanation_check"](spark, at).collect()} == {True, False}
    with pytest.raises(ValueError):
        evaluate.bootstrap(spark.range(evaluate.MOST_DATES + 1).selectExpr("id d", "1 n", "1.0 s0"), "d", repeats=1)


def test_refresh_holds_with_every_reason(spark):
    got = {r.reason for r in refresh.refresh_contests(spark, "/root/testdata/sf0.001").collect()}
    assert got == {None, "conflicting_duplicate_url", "unknown_or_ambiguous_fighter", "unsupported_outcome", "missing_or_conflicting_rounds"} or len(got) >= 4


def test_metric_bundles_hold_every_metric():
    assert len(features.RECENT) == 10 and len(features.CONTEXT) + 1 == 11 and len(features.STYLE) == 17 and len(features.BASE) == 13 and len(features.REDUCED) == 11
    assert {"recent_metrics", "context_metrics", "style_metrics", "state_differences", "replay_as_of", "walk_forward"} <= set(models.ORACLES)


def test_audit_codes_are_all_there(spark):
    from tallyspark.plans import catalog

    got = catalog.full_audit(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len({(r.source, r.code) for r in got}) == len(catalog.RULES) + len(catalog.PARENTS) + len(catalog.KEYS)
    assert {r.code for r in got if r.n} and [r.n for r in got] == sorted((r.n for r in got), reverse=True)


def test_optional_bounds_reach_the_scan(spark):
    from tallyspark.plans import catalog

    at = "/root/testdata/sf0.001"
    assert "GreaterThanOrEqual(o_orderdate" in catalog.optional_bounds(spark, at)._jdf.queryExecution().executedPlan().toString()
    assert catalog.optional_bounds(spark, at, None, None).count() == spark.read.parquet(f"{at}/orders.parquet").count()
    assert catalog.optional_bounds(spark, at, None, "1990-01-01").count() == 0


def test_images_are_judged_by_their_bytes_and_declared_type():
    import struct
    import zlib

    from tallyspark.sources import images

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 40, 50, 8, 0, 0, 0, 0))
    png = images.PNG + head + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")
    assert images.inspect(png, "image/png; q=1")[:3] == ("image/png", 40, 50) and images.inspect(png, "image/jpeg")[-1] == "content_type"
    assert images.inspect(images.PNG + head + chunk(b"IDAT", b"x") + chunk(b"IEND", b"x"))[-1] == "incomplete"
    assert images.inspect(images.PNG + head + chunk(b"IDAT", bytes(images.MOST_BYTES)) + chunk(b"IEND", b""))[-1] == "too_large"
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 50, 40, 1) + b"\x01\x11\x00"
    assert images.inspect(b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xff\xc2" + frame[2:] + b"\xff\xd9")[:3] == ("image/jpeg", 40, 50)
    assert images.inspect(b"\xff\xd8\xff\xda\x00\x02" + frame + b"\xff\xd9")[-1] == "no_frame" and images.inspect(b"\xff\xd8\xff\xe0\x00\xff\xff\xd9")[-1] == "truncated"


def test_the_shuffles_of_a_step_end_with_it(spark):
    """What was shuffled for a stored table is gone once the table is there."""
    import glob
    import time

    from tallyspark.operators import store

    places = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for place in places for f in glob.glob(f"{place}/**/shuffle_*.data", recursive=True)}
    before = shuffled()
    rows = spark.range(1000).repartition(3, "id")
    kept = store.stored(rows, "rows")
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and kept.count() == 1000 and spark.conf.get(store.CLEANUP, "false") == "false"
    assert sum(rows.groupBy((F.col("id") % 2).alias("k")).count().toPandas()["count"]) == 1000  # the session's other queries are as before


def test_lines_are_shuffled_as_they_are(spark):
    """The statistics of a line are made after the shuffle: fewer columns go through it than come out."""
    from tallyspark.plans import domain

    def nodes(plan):
        yield plan
        children = plan.children()
        for i in range(children.size()):
            yield from nodes(children.apply(i))

    records = domain.records(spark, "/root/testdata/sf0.001")
    dealt = [n.output().size() for n in nodes(records._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "RepartitionByExpression"]
    assert dealt and max(dealt) <= 6  # 15 before


def test_vectors_leave_few_shuffles_to_their_reader(spark):
    """State, ratings and what follows from them are stored steps; the last plan shuffles the records by participant, and two sides by contest."""
    people = {f: (None, None) for f in range(4)}
    stats = {x: 1.0 for x in STATS}
    frame = spark.createDataFrame([x for bout in range(6) for x in two_sides(bout, bout, bout % 3, 3, 1.0, 300.0, "ko_tko", stats, stats, people)], SCHEMA)
    ratings = spark.createDataFrame([(bout, 1500.0, 1500.0, 1500.0, 1500.0) for bout in range(6)], "bout_id long, elo_a double, elo_b double, strong_a double, strong_b double")
    plan = features.vectors(frame, ratings)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") <= 3  # 11 before
