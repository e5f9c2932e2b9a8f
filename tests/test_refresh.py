"""A refresh from CSV folders to the active version: what it publishes, what it refuses, how little it shuffles."""

import re

import pytest
from pyspark.sql import functions as F
from tallyspark.operators import normalize, refresh, store
from tallyspark.plans import refresh as plan
from tallyspark.sources import archive

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark):
    return plan.written(spark, AT)


def copied(spark, folder, tmp_path, **change):
    """Another archive, with some kinds changed."""
    out = f"file://{tmp_path}/archive"
    for kind in refresh.KINDS:
        df = archive.read_csv(spark, f"{folder}/{kind}", kind)
        archive.write_csv(change[kind](df) if kind in change else df, f"{out}/{kind}", kind)
    return out


def test_csv_folders_read_back(spark, folder):
    raw = plan.archive(spark, AT)
    for kind in refresh.KINDS:
        back = archive.read_csv(spark, f"{folder}/{kind}", kind)
        assert back.exceptAll(raw[kind].select(*back.columns)).count() == 0 and back.count() == raw[kind].count()


def test_refresh_publishes_once_and_refuses_regressions(spark, folder, tmp_path):
    root = f"file://{tmp_path}/published"
    run = refresh.refresh(spark, folder, root, plan.HOST, archive.digests(spark, [f"{folder}/{k}" for k in refresh.KINDS]))
    assert store.active(spark, root) == run
    contests = store.read(spark, root, "contests")
    counts = refresh.observed({"contests": contests, "fighters": store.read(spark, root, "fighters")})
    assert counts["contests"] == contests.select("bout_id").distinct().count() > counts["usable_contests"] > 0
    assert store.read(spark, root, "facts").count() == 2 * counts["usable_contests"]
    assert store.read(spark, root, "gaps").where("kind = 'contest' and field is null").count() == counts["contests"] - counts["usable_contests"]
    assert refresh.refresh(spark, folder, root, plan.HOST) == run and store.versions(spark, root).count() == 2  # the same files: made active again, not built

    with pytest.raises(ValueError, match="differ from the manifest"):
        refresh.refresh(spark, folder, root, plan.HOST, archive.digests(spark, [f"{folder}/events"]))
    with pytest.raises(ValueError, match="nonempty_fighters"):
        refresh.refresh(spark, copied(spark, folder, tmp_path / "a", profiles=lambda d: d.where("false")), root, plan.HOST)
    with pytest.raises(ValueError, match="retained_contests"):
        refresh.refresh(spark, copied(spark, folder, tmp_path / "b", results=lambda d: d.where(F.crc32(F.col("url").cast("binary")) % 2 == 0)), root, plan.HOST)
    one = contests.where("status = 'usable'").orderBy("bout_id").first().bout_id[-16:]
    fewer = copied(spark, folder, tmp_path / "c", results=lambda d: d.where(~F.col("url").contains(one)))
    with pytest.raises(ValueError, match="lacks a contest"):
        refresh.refresh(spark, fewer, root, plan.HOST)
    assert store.active(spark, root) == run and store.versions(spark, root).count() == 2
    at, system = store.files(spark, f"{root}/contests")
    assert len(list(system.listStatus(at))) == 1  # refused versions leave nothing behind
    # a contest that is held now is still there, so it is published
    held = copied(spark, folder, tmp_path / "d", results=lambda d: d.withColumn("outcome", F.when(F.col("url").contains(one), "?").otherwise(F.col("outcome"))))
    other = refresh.refresh(spark, held, root, plan.HOST)
    assert other != run and store.active(spark, root) == other and store.read(spark, root, "contests").where(F.col("bout_id").endswith(one)).first().reason == "unsupported_outcome"
    assert store.rollback(spark, root, other) == run
    with pytest.raises(ValueError):
        refresh.gates(counts, None, 1.5)


def test_each_source_is_normalised_once(spark, folder):
    """All exchanges of all steps, before adaptive execution and without broadcasts."""
    seen = []

    def keep(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return store.stored(df, name)

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    first = normalize.stored
    try:
        normalize.stored = keep
        raw = {k: archive.read_csv(spark, f"{folder}/{k}", k) for k in refresh.KINDS}
        normalize.build(raw["events"], raw["results"], raw["rounds"], raw["profiles"], plan.HOST, keep)
    finally:
        normalize.stored = first
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    exchanges = {name: len(re.findall(r"Exchange (?:hash|range|Single)", p)) for name, p in seen}
    assert sum(exchanges.values()) <= 20, exchanges
    assert exchanges["rounds"] == 1 and exchanges["gaps"] == exchanges["fighters"] == 0
    assert sum(p.count("Scan csv") for _, p in seen) == 4


def test_many_copies_and_a_second_event(spark):
    """A row of rounds that is repeated is one row; an event that has other rounds spoils the contest, one without rounds does not."""
    base = {"kd": "0", "sub_attempts": "0", "reversals": "0", "control": "1:00"} | dict.fromkeys(normalize.PAIRED, "3 of 5")
    people = spark.createDataFrame([("Ann", "--", "http://h.org/fighter-details/" + "0" * 15 + "1"), ("BÖB", "--", "http://h.org/fighter-details/" + "0" * 15 + "2")], "fighter string, reach string, url string")
    address = lambda kind, n: f"http://h.org/{kind}/{n:016x}"
    events = spark.createDataFrame([(e, "March 5, 2021", address("event-details", 1)) for e in ("E", "F", "G")], "event string, date string, url string")
    results = spark.createDataFrame([(e, bout, "W/L", "x", "1", "2:00", "3 Rnd (5-5-5)", address("fight-details", n)) for n, e, bout in ((1, "E", "Ann vs. böb"), (1, "F", "Ann vs. böb"), (2, "G", "Ann vs. böb"), (2, "E", "Ann vs. böb"), (3, "G", "böb vs. Ann"))], "event string, bout string, outcome string, weightclass string, round string, time string, time_format string, url string")

    def rounds(*rows):
        return spark.createDataFrame([{"event": e, "bout": b, "round": r, "fighter": f, **base, **more} for e, b, r, f, more in rows])

    both = [("E", "Ann vs. böb", "Round 1", f, {}) for f in (" ann", "Böb")]
    got = lambda *more: {int(r.bout_id[-2:], 16): r.reason for r in normalize.build(events, results, rounds(*both, *more), people, "h.org")["contests"].collect()}
    assert got(*both * 50) == {1: None, 2: None, 3: "missing_or_conflicting_rounds"}
    assert got(("F", "Ann vs. böb", "Round 1", "Ann", {}), ("F", "Ann vs. böb", "Round 1", "Böb", {"kd": "1"}))[1] == "missing_or_conflicting_rounds"
    assert got(("E", "Ann vs. böb", "Round 1", "Ann", {"kd": "1"}))[1] == "missing_or_conflicting_rounds"
    assert got(("E", "Ann vs. böb", "Round 2", "Ann", {}), ("E", "Ann vs. böb", "Round 2", "Böb", {}))[1] == "missing_or_conflicting_rounds"
    assert got(("F", "Ann vs. böb", "Round 1", "Cy", {}), ("F", "Ann vs. böb", "Round 1", "Ann", {}))[1] == "missing_or_conflicting_rounds"
    assert got(("E", "Ann vs. böb", None, "Ann", {}))[1] == "missing_or_conflicting_rounds"


def test_the_archive_makes_its_contests_once(spark):
    """Events and results read the stored contests; only rounds read the lines again."""
    raw = plan.archive(spark, AT)
    reads = {kind: df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") for kind, df in raw.items()}
    assert reads["events"] == reads["results"] == 0 and reads["rounds"] == 1
