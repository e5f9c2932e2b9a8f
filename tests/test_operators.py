"""Hand-computed, metamorphic and brute-force tests of the analytics operators."""

import datetime as dt
import importlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F
from tallyspark.functions import names, scalar
from tallyspark.operators import asof, evaluate, folds, joins, ledger, market, metrics, normalize, store
from tallyspark.sources import archive, markup, odds
from tallyspark.streaming import quotes


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def value(spark, column, x, kind="string"):
    return one(spark, x, kind).select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("round_", "time", "form", "want"),
    [(2, "2:00", "3 Rnd (5-5-5)", 420), (2, "2:00", "1 Rnd + OT (12-3)", 840), (1, "15:30", "No Time Limit", 930), (2, "6:00", "3 Rnd (5-5-5)", None), (3, "2:00", "1 Rnd + OT (12-3)", None), (1, "2:61", "3 Rnd (5-5-5)", None), (1, "1:00", "Unknown", None)],
)
def test_elapsed(spark, round_, time, form, want):
    row = spark.createDataFrame([(round_, time, form)], "r int, t string, f string")
    assert row.select(scalar.elapsed(F.col("r"), F.col("t"), F.col("f")).alias("y")).first().y == want


def test_scalar_rules(spark):
    v = lambda f, x, k="string": value(spark, f, x, k)
    assert tuple(v(scalar.counts, "3 of 5")) == (3, 5, None)
    assert tuple(v(scalar.counts, "6 of 5")) == (None, None, "landed_above_attempted")
    assert v(scalar.counts, "--").error == "unparsed"
    assert v(scalar.seconds, "4:59") == 299 and v(scalar.seconds, "4:60") is None and v(scalar.number, "3.0") == 3 and v(scalar.number, "3.5") is None
    assert v(scalar.reach_cm, '70"') == 177.8 and v(scalar.reach_cm, "--") is None and v(scalar.reach_cm, '20"') is None
    assert v(scalar.sides, "A B vs. C D") == ["A B", "C D"] and v(scalar.sides, "A") is None
    assert v(scalar.date, "March 5, 2021") == dt.date(2021, 3, 5) == v(scalar.date, "{{start date|2021|3|5}}") == v(scalar.date, "5 March 2021")
    assert v(scalar.utc, "2024-01-01T00:00:00Z") is not None and v(scalar.utc, "2024-01-01T00:00:00") is None
    assert v(scalar.csv_safe, " =1+1") == "' =1+1" and v(scalar.csv_safe, "a") == "a"
    assert v(scalar.html_escape, "<a&'\">") == "&lt;a&amp;&#x27;&quot;&gt;"
    assert tuple(v(scalar.rank_label, "T-3")) == (3, True) and tuple(v(scalar.rank_label, "4")) == (4, False)
    assert v(scalar.favourite, 0.5, "double") == "even" and v(scalar.favourite, 0.42, "double") == "small"
    assert v(lambda c: scalar.identity(c, "x.org", "fight", "s"), "http://www.x.org/fight/0123456789abcdef") == "s:fight:0123456789abcdef"
    assert v(names.name_key, "  Ｊosé  ALDO ") == "josé aldo" and v(names.letters_key, "Aldo, José") == "josealdo" and v(names.accent_key, "JOSÉ") == "jose"


def test_last_with_ties_and_embargo(spark):
    for days, n in (([1, 2, 3, 3, 4, 5, 6], 5), ([1, 2, 3, 3, 3, 4, 5, 6], 6)):
        rows = [("f", d, i, 1.0) for i, d in enumerate(days)] + [("f", 9, 99, 1.0)]
        got = asof.last_with_ties(spark.createDataFrame(rows, "k string, day int, id int, x double"), "k", "day", "id", ["x"], 5, 3)
        assert got.where("id = 99").first()[-2:] == (n, float(n))
    near = [("f", 1, 0, 1.0), ("f", 7, 1, 5.0), ("f", 8, 2, 5.0), ("f", 9, 3, 5.0), ("f", 9, 4, 5.0)]
    got = asof.last_with_ties(spark.createDataFrame(near, "k string, day int, id int, x double"), "k", "day", "id", ["x"], 5, 3)
    assert got.where("id = 3").first()[-2:] == (1, 1.0)


def test_last_with_ties_equals_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), rnd.randint(0, 25), i, float(rnd.randint(0, 9))) for i in range(200)]
    got = {r.id: (r.n_last, r.last_x) for r in asof.last_with_ties(spark.createDataFrame(rows, "k string, day int, id int, x double"), "k", "day", "id", ["x"], 5, 3).collect()}
    for k, day, i, _ in rows:
        past = sorted(((d, x) for kk, d, _, x in rows if kk == k and d < day - 2), reverse=True)
        kept = [x for d, x in past if len(past) <= 5 or d >= past[4][0]]
        assert got[i] == (len(kept), sum(kept))


@pytest.mark.parametrize(("forward", "strict"), [(False, False), (False, True), (True, False), (True, True)])
def test_asof_join_equals_brute_force(spark, forward, strict):
    rnd = random.Random(2)
    left = [(rnd.choice("ab"), rnd.randint(0, 40), i) for i in range(60)]
    right = [(k, t, 100 * t + ord(k)) for k in "ab" for t in rnd.sample(range(40), 15)]
    got = {r.id: r.v for r in asof.asof_join(spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, u int, v int"), ["k"], "t", "u", ["v"], forward, strict).collect()}
    for k, t, i in left:
        fit = [(u, v) for kk, u, v in right if kk == k and (u > t if forward else u < t) or kk == k and u == t and not strict]
        assert got[i] == ((min if forward else max)(fit)[1] if fit else None)


def test_unique_match_band_and_two_sided(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None)], "id int, k string")
    right = spark.createDataFrame([(10, "a"), (11, "b"), (12, "d"), (13, "d")], "rid int, k string")
    got = {r.id: (r.matched_id, r.hold) for r in joins.unique_match(left, right, ["k"], "rid").collect()}
    assert got == {1: (10, None), 2: (None, "ambiguous"), 3: (None, "ambiguous"), 4: (None, "absent"), 5: (None, "absent")}
    rnd = random.Random(3)
    a, b = ([(i, rnd.choice("xy"), rnd.randint(-20, 20)) for i in range(50)] for _ in range(2))
    pairs = joins.band_join(spark.createDataFrame(a, "i int, k string, d int"), spark.createDataFrame(b, "j int, k string, e int"), ["k"], "d", "e", 2)
    assert sorted((r.i, r.j) for r in pairs.collect()) == sorted((i, j) for i, k, d in a for j, kk, e in b if k == kk and abs(d - e) <= 2)
    q = spark.createDataFrame([(1, "h", 2.0), (1, "a", 2.0), (2, "h", 2.0), (3, "h", 2.0), (3, "a", 1.5), (3, "d", 9.0), (4, "h", 2.0), (4, "h", 3.0), (4, "a", 2.0)], "m int, s string, p double")
    assert [(r.m, r.p_a) for r in joins.two_sided(q, ["m"], "s", "p", ("h", "a")).collect()] == [(1, 0.5)]


def test_redirect_chains(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("p", "q")], "c string, p string")
    assert {r.id: r.target for r in joins.resolved(links, "c", "p").collect()} == {"a": "d", "b": "d", "c": "d", "p": "q", "x": None, "y": None}


def test_long_redirect_chains_and_circles(spark):
    links = [(i, i + 1) for i in range(1000)] + [(5000 + i, 5000 + (i + 1) % 77) for i in range(77)] + [(6000 + i, 5000 + i) for i in range(5)] + [(9000, 9000)]
    got = {r.id: r.target for r in joins.resolved(spark.createDataFrame(links, "c long, p long"), "c", "p").collect()}
    assert got == {i: 1000 if i < 1000 else None for i, _ in links}
    assert joins.resolved(spark.createDataFrame([], "c long, p long"), "c", "p").count() == 0


def test_last_rows_equal_brute_force(spark):
    rnd = random.Random(21)
    rows = [(rnd.choice("abc"), rnd.randint(0, 25), i, float(rnd.randint(0, 9))) for i in range(200)]
    for r in asof.last_rows(spark.createDataFrame(rows, "k string, day int, id int, x double"), "k", "day", ["id"], "x", 5).collect():
        assert r["last"] == [x for d, i, x in sorted((d, i, x) for k, d, i, x in rows if k == r.k and d < r.day)][-5:]


def test_shrunk_and_null_rules(spark):
    df = spark.createDataFrame([(60.0, 100.0, 600.0), (None, 5.0, 60.0), (7.0, 5.0, 60.0)], "l double, a double, s double")
    accuracy = metrics.Shrunk("x", "l", "a", 0.5, 50, bounded=True)
    assert df.agg(accuracy.column()).first()[0] == pytest.approx((60 + 25) / 150)
    rate = metrics.Shrunk("x", "l", "s", 3.0, 30 * 60.0, 60.0)
    assert df.agg(rate.column()).first()[0] == pytest.approx((67 + 3 * 30) / (11 + 30))
    assert df.agg(metrics.all_or_null("l").alias("x"), metrics.all_or_null("a").alias("y")).first() == (None, 110.0)
    assert df.where("false").agg(accuracy.column()).first()[0] == 0.5
    assert df.agg(metrics.paired_ratio(F.col("l"), F.col("s"), 60.0)).first()[0] == pytest.approx(67 / 11)


def fold(rows, k, by_date):
    rating, out, held, date = {}, {}, {}, None
    for day, event, bout, a, b, s in sorted(rows):
        if by_date and day != date:
            for w, c in held.items():
                rating[w] = rating.get(w, 1500) + c
            held, date = {}, day
        ra, rb = rating.get(a, 1500), rating.get(b, 1500)
        p = 1 / (1 + 10 ** ((rb - ra) / 400))
        out[bout] = ra, rb
        if s is not None:
            for w, c in ((a, k * (s - p)), (b, -k * (s - p))):
                if by_date:
                    held[w] = held.get(w, 0) + c
                else:
                    rating[w] = rating.get(w, 1500) + c
    return out


@pytest.mark.parametrize("by_date", [False, True])
def test_elo(spark, by_date):
    rnd = random.Random(4)
    rows = [(dt.date(2020, 1, 1 + rnd.randint(0, 20)), rnd.randint(0, 3), i, *rnd.sample("abcdef", 2), rnd.choice([1.0, 0.0, 0.5, None])) for i in range(150)]
    frame = spark.createDataFrame([("p", *r) for r in rows] + [("q", *r) for r in rows[:40]], "pool string, event_date date, event_id int, bout_id int, a string, b string, score double")
    got = folds.elo(frame, "pool", 32.0, by_date=by_date).collect()
    for pool, part in (("p", rows), ("q", rows[:40])):
        want = fold(part, 32.0, by_date)
        for r in got:
            if r.pool == pool:
                assert (r.rating_a, r.rating_b) == pytest.approx(want[r.bout_id])


def test_market_rules(spark):
    rows = spark.createDataFrame([(1, i, float(9 - i), 30.0) for i in range(5)], "e int, i int, ev double, used double")
    got = [r.stake for r in market.allocate(rows, "e", [F.desc("ev")], 25.0, 100.0, "used").orderBy("i").collect()]
    assert got == [25.0, 25.0, 20.0]
    with pytest.raises(ValueError):
        market.disagreement(F.lit(0.5), F.lit(0.5), 2.0)
    paid = spark.createDataFrame([("won",), ("lost",), ("void",), ("open",)], "s string").select(market.payout(F.col("s"), F.lit(10.0), F.lit(2.5)).alias("p"))
    assert [r.p for r in paid.collect()] == [25.0, 0.0, 10.0, None]


def test_evaluation(spark):
    rows = spark.createDataFrame([(0.5, 1), (0.9, 1), (0.2, 0), (0.7, 0)], "p double, y int")
    m = rows.agg(*evaluate.binary_metrics(F.col("p"), F.col("y"))).first()
    assert m.n == 4 and m.accuracy == 0.75 and m.brier == pytest.approx((0.25 + 0.01 + 0.04 + 0.49) / 4)
    assert [(r.bin, r.n) for r in evaluate.calibration(rows, "p", "y").orderBy("bin").collect()] == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 1)]
    rnd = random.Random(5)
    data = [(rnd.gauss(0, 1), rnd.gauss(0, 1)) for _ in range(400)]
    frame = spark.createDataFrame([(a, b, int(rnd.random() < 1 / (1 + math.exp(-a + 0.5 * b)))) for a, b in data], "a double, b double, y int")
    w = evaluate.logistic(frame, ["a", "b"], "y", 0.02)
    assert 0.4 < w["a"] < 1.4 and -0.9 < w["b"] < -0.1
    flipped = evaluate.logistic(frame.selectExpr("-a a", "-b b", "1 - y y"), ["a", "b"], "y", 0.02)
    assert flipped["a"] == pytest.approx(w["a"], abs=1e-6)
    z = frame.select((1 / (1 + F.exp(-2 * (F.col("a") - 0.5 * F.col("b"))))).alias("p"), "y")
    assert 0.3 < evaluate.temperature(z, "p", "y") < 0.8
    assert evaluate.temperature(z.limit(10), "p", "y") == 1.0
    blocks = evaluate.block_sums(spark.createDataFrame([(d, float(d % 2)) for d in range(20) for _ in range(5)], "d int, v double"), "d", [F.col("v")])
    low, high = evaluate.bootstrap(blocks, "d", repeats=300)
    assert low < 0.5 < high and (low, high) == evaluate.bootstrap(blocks, "d", repeats=300)


def url(kind, n):
    return f"http://stats.example.org/{kind}/{n:016x}"


def stats(**kw):
    base = {"kd": "0", "sub_attempts": "0", "reversals": "0", "control": "1:00"} | dict.fromkeys(normalize.PAIRED, "3 of 5")
    return base | kw


@pytest.fixture(scope="module")
def built(spark):
    ev = [("E1", "March 5, 2021", url("event-details", 1)), ("E1 alias", "March 5, 2021", url("event-details", 1)), ("E2", "April 2, 2022", url("event-details", 2))]
    people = [(n, '70"' if n != "D" else "--", url("fighter-details", i)) for i, n in enumerate("ABCDEF")] + [("Same", "--", url("fighter-details", 90)), ("Same", "--", url("fighter-details", 91))]
    res = [
        ("E1", "A vs. B", "W/L", "x", "2", "2:00", "3 Rnd (5-5-5)", url("fight-details", 1)), ("E1 alias", "A vs. B", "W/L", "x", "2", "2:00", "3 Rnd (5-5-5)", url("fight-details", 1)),
        ("E1", "C vs. D", "D/D", "x", "1", "5:00", "3 Rnd (5-5-5)", url("fight-details", 2)), ("E2", "E vs. F", "W/L", "x", "1", "1:00", "Mystery", url("fight-details", 3)),
        ("E2", "A vs. Same", "W/L", "x", "1", "1:00", "3 Rnd (5-5-5)", url("fight-details", 4)), ("E9", "A vs. C", "W/L", "x", "1", "1:00", "3 Rnd (5-5-5)", url("fight-details", 5)),
        ("E2", "A vs. D", "?", "x", "1", "1:00", "3 Rnd (5-5-5)", url("fight-details", 6)), ("E2", "B vs. C", "W/L", "x", "1", "1:00", "3 Rnd (5-5-5)", url("fight-details", 7)), ("E2", "B vs. C", "L/W", "x", "1", "1:00", "3 Rnd (5-5-5)", url("fight-details", 7)),
    ]
    rnd = []
    for event, bout, rounds in (("E1", "A vs. B", 2), ("E2", "E vs. F", 1)):
        for name in bout.split(" vs. "):
            for k in range(1, rounds + 1):
                rnd.append({"event": event, "bout": bout, "round": f"Round {k}", "fighter": name, **stats(control="9:00" if name == "B" else "--" if name == "E" else "1:00")})
    rnd.append(rnd[0])  # a repeat is tolerated
    rnd.append({"event": "E1", "bout": "C vs. D", "round": "Round 1", "fighter": "C", **stats()})  # D is missing
    frames = [
        spark.createDataFrame(ev, "event string, date string, url string"),
        spark.createDataFrame(res, "event string, bout string, outcome string, weightclass string, round string, time string, time_format string, url string"),
        spark.createDataFrame(rnd), spark.createDataFrame(people, "fighter string, reach string, url string"),
    ]
    return normalize.build(*frames, "stats.example.org")


def test_normalisation_holds_what_is_ambiguous(built):
    got = {int(r.bout_id[-2:], 16): (r.status, r.reason, r.duration) for r in built["contests"].collect()}
    assert got[1] == ("usable", None, 420)
    assert got[2][:2] == ("held", "missing_or_conflicting_rounds")
    assert got[3] == ("usable", None, None)
    assert got[4][1] == "unknown_or_ambiguous_fighter" and got[5][1] == "unknown_or_ambiguous_event" and got[6][1] == "unsupported_outcome" and got[7][1] == "conflicting_duplicate_url"


def test_normalisation_totals(built):
    facts = {(int(r.bout_id[-2:], 16), int(r.fighter_id[-2:], 16)): r for r in built["facts"].collect()}
    assert len(facts) == 4 and facts[1, 0].sig_landed == 6 and facts[1, 0].control_seconds == 120
    assert facts[1, 1].control_seconds is None and facts[3, 4].control_seconds is None and facts[3, 5].sig_attempted == 5
    gaps = {(r.kind, r.field, r.reason) for r in built["gaps"].collect()}
    assert ("contest", "duration", "unknown_schedule_or_time") in gaps and ("fact", "control_seconds", "missing_component") in gaps


def test_csv_and_manifest(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_bytes('﻿FIGHTER,REACH,URL\n"Ann ""A"" B","70""",u\n'.encode())
    assert archive.read_csv(spark, str(path), "profiles").collect() == [('Ann "A" B', '70"', "u")]
    with pytest.raises(ValueError):
        archive.read_csv(spark, str(path), "events")
    import hashlib

    good = hashlib.sha256(path.read_bytes()).hexdigest()
    check = lambda rows: [r.name for r in archive.mismatches(spark, [str(path)], spark.createDataFrame(rows, "name string, sha256 string")).collect()]
    assert check([("p.csv", good)]) == [] and check([("p.csv", "x")]) == ["p.csv"] and check([("p.csv", good), ("q.csv", "y")]) == ["q.csv"]


def test_odds_flatten(spark):
    def event(outcomes, update="2024-01-01T00:00:00Z", key="h2h"):
        return {"id": "e", "home_team": "H", "away_team": "A", "commence_time": "2024-01-02T00:00:00Z", "bookmakers": [{"key": "b", "last_update": update, "markets": [{"key": key, "outcomes": [{"name": n, "price": p} for n, p in outcomes]}]}]}

    good = [("H", 1.5), ("A", 2.5)]
    payloads = [event(good), event([("H", 1.5)]), event([*good, ("Draw", 9.0)]), event(good, "2024-01-01T09:00:00Z"), event(good, "2024-01-01T00:00:00"), event(good, key="totals"), event([("H", 1.0), ("A", 2.0)])]
    frame = spark.createDataFrame([(json.dumps([p]), "2024-01-01T01:00:00Z") for p in payloads] + [("nonsense", "2024-01-01T01:00:00Z"), (None, None)], "payload string, captured_at string")
    assert [(r.home_price, r.away_price) for r in odds.head_to_head(frame).collect()] == [(1.5, 2.5)]


def test_markup(spark):
    html = "<title>a &amp; b</title><script>var t='</p>'</script><a href='/x'>one <b>two</b><h1>Head<img src=i.png alt=pic>"
    rows = markup.elements(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).collect()
    assert [(r.page_id, r.kind, r.target, r.text) for r in rows] == [(1, "title", None, "a & b"), (1, "a", "/x", "one twoHead"), (1, "h1", None, "Head"), (1, "img", "i.png", "pic")]


def test_store(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    store.publish({"t": first}, root, "r1", "s1")
    store.publish({"t": first.limit(1)}, root, "r2", "s2")
    assert store.active(spark, root) == "r2" and store.read(spark, root, "t").count() == 1 and store.read(spark, root, "t", "r1").count() == 2
    store.publish({"t": first}, root, "r1", "s1")
    assert store.active(spark, root) == "r1"
    with pytest.raises(ValueError):
        store.publish({"t": first}, root, "r1", "other")
    new = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "k int, v string")
    assert sorted(store.upsert(first, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    fresh, conflicts = store.insert_new(first, new, ["k"])
    assert [r.k for r in fresh.collect()] == [3] and sorted(r.k for r in conflicts.collect()) == [1, 2]
    assert store.fingerprint(first) == store.fingerprint(first.orderBy("v").repartition(3)) != store.fingerprint(new)
    assert store.schema_differences(first, new.schema) == [] and store.schema_differences(first, first.drop("v").schema)


def test_store_claims_documents_and_rollback(spark, tmp_path):
    root = str(tmp_path / "s")
    frame = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    store.publish({"t": frame}, root, "r1", "s1")
    store.publish({"t": frame.limit(1)}, root, "r2", "s2")
    assert store.rollback(spark, root, "r2") == "r1" == store.active(spark, root) and store.rollback(spark, root, "r2") == "r1"
    at, system = store.files(spark, f"{root}/_claims/4")
    assert system.createNewFile(at)  # another publisher holds the next number
    store.activate(spark, root, "r2", "s2")
    assert store.active(spark, root) == "r2" and store.versions(spark, root).agg(F.max("sequence")).first()[0] == 5
    assert store.key_problems(frame, ["k"], ["v"]) == {"repeats": 1, "null:k": 0, "null:v": 1}
    kind = "kind string, key string, identity string, captured_at int, payload string"
    fresh, refused = store.publish_document(spark.createDataFrame([("d", "x", "i", 5, "p")], kind), spark.createDataFrame([("d", "x", "i", 6, "q"), ("d", "x", "j", 7, "q"), ("d", "x", "i", 5, "q"), ("d", "y", "z", 1, "q")], kind))
    assert sorted((r.key, r.captured_at) for r in fresh.collect()) == [("x", 6), ("y", 1)] and sorted(r.problem for r in refused.collect()) == ["not_later", "other_identity"]
    store.write_new(frame, str(tmp_path / "new"))
    with pytest.raises(Exception, match="exist"):
        store.write_new(frame, str(tmp_path / "new"))


def test_ledger(spark):
    entries = spark.createDataFrame([], "c string, number int, payload string, previous_sha256 string, entry_sha256 string")
    for k in range(3):
        entries = spark.createDataFrame(entries.union(ledger.append(entries, "c", spark.createDataFrame([("x", f"p{k}"), ("y", f"q{k}")], "c string, payload string"))).collect(), entries.schema)
    assert ledger.verify(entries, "c").where("problem is not null").count() == 0
    bent = entries.withColumn("payload", F.when((F.col("c") == "x") & (F.col("number") == 2), "other").otherwise(F.col("payload")))
    assert [(r.c, r.number, r.problem) for r in ledger.verify(bent, "c").where("problem is not null").collect()] == [("x", 2, "wrong_digest")]
    assert ledger.verify(entries.where("number <> 2"), "c").where("problem = 'gap'").count() == 2
    assert ledger.is_prefix(entries.where("number < 3"), entries, "c") and not ledger.is_prefix(bent.withColumn("entry_sha256", F.lit("z")), entries, "c")


def test_streamed_quotes(spark, tmp_path):
    rows = [(1, "b", "h", 2.0, "2024-01-01 00:10:00", "2024-01-01 00:10:01"), (1, "b", "h", 2.0, "2024-01-01 00:10:00", "2024-01-01 00:10:01"), (2, "b", "h", 3.0, "2024-01-01 00:20:00", "2024-01-01 00:20:01"), (3, "b", "h", 9.0, "2024-01-01 00:30:00", "2024-01-01 00:20:01"), (4, "b", "h", 1.0, "2024-01-01 00:30:00", "2024-01-01 00:40:01")]
    schema = "quote_id long, book string, side string, price double, ts timestamp, captured_at timestamp"
    frame = spark.createDataFrame(rows, "quote_id long, book string, side string, price double, ts string, captured_at string").withColumn("ts", F.to_timestamp("ts")).withColumn("captured_at", F.to_timestamp("captured_at"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = quotes.by_window(quotes.fresh(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    batch = quotes.by_window(frame.where("price > 1 and ts <= captured_at").dropDuplicates(["quote_id"])).collect()
    assert [(r.n, r.last_price, r.mean_price) for r in batch] == [(2, 3.0, 2.5)]
    assert query.exception() is None


def test_registry_has_sql_for_what_sql_can_say():
    entry = importlib.import_module("__spark_entry__")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 60 and "past_only_rate" in queries


def test_command_line(spark, tmp_path, capsys):
    from tallyspark.__main__ import main

    assert main(["--list"]) == 0 and "past_only_rate" in capsys.readouterr().out
    assert main(["annual_rollup", "/root/testdata/sf0.001", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    with pytest.raises(SystemExit):
        main(["annual_rollup"])


def test_history_reads_only_what_it_needs(spark):
    """Filters and columns reach the scan; history features shuffle by entity, without a range join."""
    from tallyspark.plans import registry

    plan = registry.QUERIES["semi_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,400000.0)" in plan and "o_orderpriority" not in plan
    for name in ("last5_with_ties_shrunk", "strict_prior_running", "recent_form", "opponent_adjusted", "asof_latest_quote"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and "Pandas" not in plan


def test_history_features_scan_once(spark):
    """The facts are one pass over the lines; last-N features add one shuffle by participant and no join of the facts with themselves."""
    from tallyspark.plans import registry

    at, key = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        for name, most in (("last5_with_ties_shrunk", 3), ("recent_form", 3), ("strict_prior_running", 3), ("opponent_history", 2), ("opponent_adjusted", 4)):
            plan = registry.QUERIES[name](spark, at)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("lineitem.parquet") <= 2 and plan.count("Exchange hashpartitioning") == most and plan.count("SortMergeJoin") == 1, name
    finally:
        spark.conf.set(key, old)


def test_future_rows_change_nothing(spark):
    """Adding later, same-day and next-day rows leaves the features of earlier ones as they were."""
    rnd = random.Random(11)
    rows = [(rnd.choice("ab"), rnd.randint(0, 30), i, 1.0 * rnd.randint(0, 9)) for i in range(80)]
    more = [("a", 40, 900, 5.0), ("b", 33, 901, 5.0), ("a", 31, 902, 5.0)]
    schema = "k string, day int, id int, x double"
    run = lambda data: {r.id: (r.n_last, r.last_x) for r in asof.last_with_ties(spark.createDataFrame(data, schema), "k", "day", "id", ["x"], 5, 3).collect()}
    small, large = run(rows), run(rows + more)
    assert all(large[i] == small[i] for i in small)
