"""Fits against plain numpy, what a forecast may not see, frozen selections, draws of dates."""

import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspark.operators import forecast


def plain(x, y, l2, centre=0.0):
    """Newton with all rows in memory."""
    w = np.full(x.shape[1], centre)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) / len(y) + l2 * (w - centre)
        h = (x.T * (p * (1 - p))) @ x / len(y) + l2 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def made(n=600, width=3, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, width)), 3)
    y = (rng.random(n) < 1 / (1 + np.exp(-x @ np.array([0.8, -0.4, 0.2])[:width]))).astype(float)
    return x, y, np.arange(n) // 6


def frame(spark, x, y, day, first=0):
    rows = [(first + i, int(d), None if np.isnan(b) else float(b), [float(v) for v in a]) for i, (a, b, d) in enumerate(zip(x, y, day))]
    return spark.createDataFrame(rows, "bout_id long, day int, y double, x array<double>").repartition(3)


def test_many_fits_in_shared_passes_equal_plain_ones(spark):
    x, y, day = made()
    rows = frame(spark, x, y, day)
    fits = [forecast.Fit(0, 100, (0, 1, 2), 0.02), forecast.Fit(20, 60, (2, 0), 0.1), forecast.Fit(500, 600, (0,), 0.02), forecast.Fit(0, 100, (1,), 1e-6)]
    got = forecast.newton(rows, fits)
    for fit, (n, w) in zip(fits, got):
        mine = (day >= fit.first) & (day < fit.last)
        assert n == mine.sum()
        want = plain(x[mine][:, fit.columns], y[mine], fit.l2) if n else np.zeros(1)
        assert np.abs(w - want).max() < 1e-7
    z = x @ got[0][1]
    heat = forecast.scales(rows, [forecast.temperature_of(fits[0], got[0][1], 60, 100), forecast.temperature_of(fits[0], got[0][1], 0, 4)])
    late = day >= 60
    assert abs(heat[0] - plain(z[late][:, None], y[late], 0.004, 1.0)[0]) < 1e-6
    assert heat[1] == 1.0  # 24 rows are too few
    p = rows.select("bout_id", forecast.probability(F.col("x"), (0, 1, 2), got[0][1], heat[0]).alias("p")).orderBy("bout_id").toPandas().p
    assert np.abs(p - 1 / (1 + np.exp(-heat[0] * z))).max() < 1e-9


def test_hand_checked_weight(spark):
    """One difference, always right: the weight solves 1 / (1 + exp(w)) = l2 * w."""
    rows = frame(spark, np.array([[1.0], [-1.0]]), np.array([1.0, 0.0]), np.array([1, 2]))
    w = forecast.newton(rows, [forecast.Fit(0, 9, (0,), 0.02)])[0][1][0]
    assert abs(1 / (1 + np.exp(w)) - 0.02 * w) < 1e-9 and abs(w - 2.818) < 1e-3  # 0.02 * 2.818 = 0.05636 = 1 / 17.743


def test_separated_rows_need_damped_steps(spark):
    x = np.concatenate([np.full((50, 1), 40.0), np.full((50, 1), -0.01)])
    rows = frame(spark, x, np.concatenate([np.ones(50), np.ones(50)]), np.arange(100))
    w = forecast.newton(rows, [forecast.Fit(0, 100, (0,), 1e-4)])[0][1][0]
    at = lambda v: np.log1p(np.exp(-x[:, 0] * v)).mean() + 0.5e-4 * v * v
    assert at(w) <= min(at(w - 1e-4), at(w + 1e-4)) + 1e-12


@pytest.fixture(scope="module")
def history(spark):
    x, y, day = made()
    return frame(spark, x, y, day).cache()


def run(history, targets, as_of=100, **rule):
    return forecast.live(history, targets, ["a", "b", "c"], as_of, forecast.LiveRule(**rule))


def targets(spark):
    return frame(spark, np.array([[0.1, 0.2, 0.3], [0.0, 0.0, 0.0]]), np.array([np.nan, np.nan]), np.array([100, 101]), first=9000)


def test_live_forecasts(spark, history):
    a = run(history, targets(spark))
    got = {r.bout_id: r.p for r in a.forecasts.collect()}
    assert set(got) == {9000, 9001} and got[9001] == 0.5 and 0 < got[9000] < 1
    assert a.training["dates"] == 80 and a.calibration["first"] == 80 and a.calibration["rows"] == 120 and a.training["last"] == 79
    assert a.version.startswith("logistic:") and len(a.version) == 25
    x, y, day = made()
    assert np.abs(np.array(a.weights) - plain(x[day < 80], y[day < 80], 0.02)).max() < 1e-7
    # what happens on the day or later changes nothing; what happened before does
    later = history.unionByName(frame(spark, np.ones((30, 3)), np.ones(30), np.full(30, 100), first=5000)).unionByName(frame(spark, np.ones((3, 3)), np.full(3, np.nan), np.full(3, 50), first=6000))
    b = run(later, targets(spark))
    assert (b.version, b.weights, b.scale) == (a.version, a.weights, a.scale)
    amended = history.withColumn("y", F.when(F.col("bout_id") == 7, 1 - F.col("y")).otherwise(F.col("y")))
    assert run(amended, targets(spark)).version != a.version
    assert run(history, targets(spark).where("bout_id = 9000")).version != a.version
    assert run(history, targets(spark), l2=0.03).version != a.version


def test_live_forecasts_refuse(spark, history):
    with pytest.raises(ValueError, match="decided contests"):
        run(history.where("day < 16"), targets(spark))
    with pytest.raises(ValueError, match="on 9"):
        run(history.withColumn("day", F.col("day") % 9), targets(spark))
    with pytest.raises(ValueError, match="split leaves"):
        run(history.where("day < 20"), targets(spark), training_rows=91)
    with pytest.raises(ValueError, match="earlier than the forecast"):
        run(history, targets(spark), as_of=101)
    with pytest.raises(ValueError, match="began at or after"):
        run(history.withColumn("start", F.when(F.col("bout_id") == 3, 100).otherwise(F.col("day"))), targets(spark))
    proven = history.withColumn("available", F.lit(2)).withColumn("observed", F.lit(2))
    aims = targets(spark).withColumn("available", F.lit(1)).withColumn("observed", F.lit(1))
    assert run(proven, aims).version == run(history, targets(spark)).version
    for h, t, part in ((proven.withColumn("observed", F.when(F.col("bout_id") == 1, None).otherwise(2)), aims, "training"), (proven, aims.withColumn("observed", F.lit(0)), "target"), (proven.withColumn("observed", F.when(F.col("day") == 90, 1).otherwise(2)), aims, "calibration")):
        with pytest.raises(ValueError, match=part):
            run(h, t)


PROTOCOL = forecast.Protocol("test", (forecast.Candidate("first", (0,)), forecast.Candidate("all", (0, 1, 2)), forecast.Candidate("third", (2,), 0.1, 0.1)), (forecast.Fold("a", 60, 70), forecast.Fold("b", 70, 80)), "third")


def test_selection_is_frozen_verified_and_evaluated(spark, history, tmp_path):
    document = forecast.select(history, PROTOCOL)
    assert document["selected"] == min(document["trials"], key=lambda k: document["trials"][k]["log_loss"]) != "third" and document["improved"]
    assert {t["n"] for t in document["trials"].values()} == {120}
    x, y, day = made()
    cell = next(c for c in document["folds"] if (c["candidate"], c["fold"]) == ("all", "b"))
    border = sorted(set(day[day < 70]))[-int(70 * 0.15)]
    assert cell["border"] == border and np.abs(np.array(cell["weights"]) - plain(x[day < border], y[day < border], 0.02)).max() < 1e-6
    back = next(c for c in document["folds"] if (c["candidate"], c["fold"]) == ("third", "a"))
    assert back["first"] == 60 - 36
    path = forecast.freeze(spark, document, f"file://{tmp_path}")
    assert forecast.freeze(spark, document, f"file://{tmp_path}") == path and forecast.thaw(spark, path) == document
    assert forecast.problems(document, PROTOCOL, history, again=True) == []
    # rows that no fold sees may change, others not
    assert forecast.problems(document, PROTOCOL, history.withColumn("y", F.when(F.col("day") >= 80, 0.0).otherwise(F.col("y")))) == []
    changed = history.withColumn("y", F.when(F.col("bout_id") == 5, 1 - F.col("y")).otherwise(F.col("y")))
    assert forecast.problems(document, PROTOCOL, changed) == ["the inputs have changed"]
    for key, value, problem in (("selected", "third", "the choice"), ("labels_before", 75, "a fold sees"), ("trials", {}, "another search")):
        bent = {k: v for k, v in (document | {key: value}).items() if k != "sha256"}
        found = forecast.problems(bent | {"sha256": forecast.digest(bent)}, PROTOCOL)
        assert any(problem in p for p in found), (key, found)
    assert "the content does not have its digest" in forecast.problems(document | {"selected": "third"}, PROTOCOL)
    assert forecast.problems(document, forecast.Protocol("other", PROTOCOL.candidates, PROTOCOL.folds, "third")) == ["another protocol"]
    place = Path(path.removeprefix("file://"))
    (place.parent / f".{place.name}.crc").unlink()
    with open(place, "w") as file:
        json.dump(document | {"selected": "third"}, file)
    with pytest.raises(ValueError, match="something else"):
        forecast.freeze(spark, document, f"file://{tmp_path}")
    report = forecast.evaluated(history, document, PROTOCOL, forecast.Fold("fixed", 80, 100), (forecast.Fold("a", 80, 90), forecast.Fold("b", 90, 100)))
    assert report["fixed"][document["selected"]]["n"] == 120 and report["accepted"] is (report["fixed"][document["selected"]]["log_loss"] < report["fixed"]["third"]["log_loss"] and report["fixed"][document["selected"]]["accuracy"] >= report["fixed"]["third"]["accuracy"])
    assert report == forecast.evaluated(history, document, PROTOCOL, forecast.Fold("fixed", 80, 100), (forecast.Fold("a", 80, 90), forecast.Fold("b", 90, 100)))
    with pytest.raises(ValueError, match="does not verify"):
        forecast.evaluated(changed, document, PROTOCOL, forecast.Fold("fixed", 80, 100), ())
    with pytest.raises(ValueError, match="among the labels"):
        forecast.evaluated(history, document, PROTOCOL, forecast.Fold("fixed", 79, 100), ())


def test_paired_intervals(spark):
    rnd = random.Random(3)
    rows = [("u" if d % 4 else "v", d, float(rnd.random() < 0.6), 0.5, 0.6) for d in range(40) for _ in range(rnd.randint(1, 4))] + [("u", 1, None, 0.5, 0.5), ("u", 2, 1.0, None, 0.4)]
    data = spark.createDataFrame(rows, "cohort string, day int, y double, p0 double, p1 double")
    got = {r.cohort: r for r in forecast.paired(data, "day", "y", "p0", "p1", "cohort", repeats=200).collect()}
    for name in "uv":
        mine = [(d, y) for c, d, y, a, _ in rows if c == name and y is not None and a is not None]
        each = [-np.log(0.6 if y else 0.4) + np.log(0.5) for _, y in mine]
        r = got[name]
        assert r.n == len(mine) and r.dates == len({d for d, _ in mine}) and abs(r.loss_delta - np.mean(each)) < 1e-12
        assert r.loss_low <= r.loss_delta <= r.loss_high and r.brier_low <= r.brier_delta <= r.brier_high and r.loss_low < r.loss_high


def test_vector_models_equal_plain_fits(spark):
    from tallyspark.plans.forecasts import vector_models

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (300, 56)), 3)
    y = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0] - x[:, 20]))).astype(float)
    day = np.arange(300) // 3
    got = vector_models(frame(spark, x, y, day), 80).orderBy("bout_id").toPandas()
    border = sorted(set(day[day < 80]))[-int(80 * 0.15)]
    for name, places in (("base", range(13)), ("reduced", range(13, 24)), ("rich", range(13, 34)), ("whole", range(13, 56))):
        own = x[:, list(places)]
        w = plain(own[day < border], y[day < border], 0.02)
        tail = (day >= border) & (day < 80)
        s = min(4.0, max(0.25, plain((own[tail] @ w)[:, None], y[tail], 0.004, 1.0)[0]))
        assert np.abs(got[f"p_{name}"] - 1 / (1 + np.exp(-s * own[day >= 80] @ w))).max() < 1e-6


def test_a_feature_that_vectors_share_is_stored_once():
    from tallyspark.operators import features
    from tallyspark.plans import forecasts

    base, hinge, recent, context = [f"b_{n}" for n in features.BASE], ["b_age_decline"], [f"r{i}" for i in range(10)], [f"c{i}" for i in range(22)]
    reduced = [f"b_{n}" for n in features.REDUCED]
    twice, once = [*base, *reduced, *recent, *context], [*base, *hinge, *recent, *context]
    assert len(once) == len(set(once)) == 46
    for kind, places in forecasts.PLACES.items():
        assert [once[i] for i in forecasts.ONCE[kind]] == [twice[i] for i in places] and len(places) == forecasts.KINDS[kind]
