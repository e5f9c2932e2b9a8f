"""A refresh from end to end: verify the archive, normalise it, gate the result against the version before, publish it, or leave the old version active."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import archive
from . import normalize, store

KINDS = ("events", "results", "rounds", "profiles")
#: What must not be empty, and what must not shrink below a share of the version before.
NONEMPTY, RETAINED = ("cards", "fighters", "contests", "usable_contests"), ("cards", "contests", "usable_contests")


def observed(tables: dict[str, DataFrame]) -> dict[str, int]:
    c = tables["contests"].agg(F.countDistinct("event_id").alias("cards"), F.count("*").alias("contests"), F.count_if(F.col("status") == "usable").alias("usable_contests")).first()
    return {"cards": c.cards, "fighters": tables["fighters"].count(), "contests": c.contests, "usable_contests": c.usable_contests}


def gates(now: dict[str, int], before: dict[str, int] | None, share: float = 0.9) -> list[tuple[str, int, float, bool]]:
    """A34. (check, observed, least, passed): nothing empty, and no less than a share of the version before. Held contests alone fail nothing."""
    if not 0 <= share <= 1:
        raise ValueError("the share lies between 0 and 1")
    checks = [(f"nonempty_{k}", now[k], 1, now[k] >= 1) for k in NONEMPTY]
    return checks + [(f"retained_{k}", now[k], before[k] * share, now[k] >= before[k] * share) for k in RETAINED if before]


def source_digest(manifest: DataFrame) -> str:
    """One digest of all files, whatever their order: of the number of files and the sum of their digests' beginnings."""
    n, total = manifest.agg(F.count("*"), F.sum(F.conv(F.left(F.sha2(F.concat_ws(" ", "name", "sha256"), 256), F.lit(15)), 16, 10).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{n}:{total}".encode()).hexdigest()


def refresh(spark: SparkSession, folder: str, root: str, host: str, manifest: DataFrame | None = None, share: float = 0.9) -> str:
    """Publish what the archive in `folder` (a folder of CSV files for each kind) says as a version below `root`, and return the version's name.

    With a manifest (name, sha256) every file must be in it with its digest. A version is named by the digest of its files: the same archive again only makes that version the active one. A result that
    fails a gate, or that lacks a contest which the active version can use (unless it holds it now), is not published: ValueError, and the old version stays active. So it is where publishing fails
    half-way; a version that was activated and then cannot be read back is rolled back."""
    paths = [f"{folder}/{kind}" for kind in KINDS]
    found = archive.digests(spark, paths).persist()
    try:
        if manifest is not None:
            wrong = manifest.select("name", F.col("sha256").alias("stated")).join(found, "name", "full").where(~F.col("stated").eqNullSafe(F.col("sha256"))).limit(5).collect()
            if wrong:
                raise ValueError("files differ from the manifest: " + ", ".join(sorted(r.name for r in wrong)))
        source = source_digest(found)
    finally:
        found.unpersist()
    run = source[:24]
    active = store.active(spark, root)
    if run in {r.run_id for r in store.versions(spark, root).select("run_id").distinct().collect()}:  # a row for each publication
        store.activate(spark, root, run, source)
        return run
    raw = {kind: archive.read_csv(spark, path, kind) for kind, path in zip(KINDS, paths, strict=True)}
    made: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        """A table of the new version, which nobody reads before it is active."""
        path = store.version(root, name, run)
        made.append(path)
        return store.write_counted(df, path)

    try:
        tables = normalize.build(raw["events"], raw["results"], raw["rounds"], raw["profiles"], host, keep)
        before = {t: store.read(spark, root, t, active) for t in ("fighters", "contests")} if active else None
        failed = [f"{name}: {n}, at least {least:g}" for name, n, least, passed in gates(observed(tables), observed(before) if before else None, share) if not passed]
        if failed:
            raise ValueError("the result fails its gates: " + "; ".join(failed))
        if before and before["contests"].where("status = 'usable'").join(tables["contests"], "bout_id", "left_anti").limit(1).count():
            raise ValueError("the result lacks a contest that the active version can use")
    except Exception:
        for path in made:
            store.remove(spark, path)
        raise
    store.activate(spark, root, run, source)
    try:
        store.read(spark, root, "contests").limit(1).collect()
    except Exception:
        store.rollback(spark, root, run)
        raise
    return run
