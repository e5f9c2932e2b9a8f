"""Identities of the sides of imported contests, in tiers, closed where any is in doubt.

A linked title names a page, through redirects; a name without a link may have a reviewed decision for exactly this event, position and name, made on exactly this revision and
receipt. Names alone never identify anyone. A contest with one unresolved side is skipped whole, and everything that was left out comes back with its reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins


def pages_of(titles: DataFrame, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """title and page_id of the titles that name one proper page, directly or at the end of their redirects. pages: title, page_id, and `disambiguation`;
    redirects: title, target (one for each title). A circle of redirects names nothing, neither does a title that pages have twice."""
    proper = pages.where(F.col("page_id") > 0).groupBy("title").agg(F.min("page_id").alias("page_id"), F.max("page_id").alias("_other"), F.max(F.coalesce("disambiguation", F.lit(False))).alias("_many"))
    proper = proper.where("page_id = _other and not _many").select(F.col("title").alias("target"), "page_id")
    ends = joins.resolved(redirects.groupBy("title").agg(F.min("target").alias("target")), "title", "target").select(F.col("id").alias("title"), F.col("target").alias("_end"), F.lit(True).alias("_moved"))
    named = titles.select("title").where("title is not null").distinct().join(ends, "title", "left")
    named = named.select("title", F.when(F.col("_moved"), F.col("_end")).otherwise(F.col("title")).alias("target"))
    return named.join(proper, "target").select("title", "page_id")


def decision_problems(decisions: DataFrame, events: DataFrame, sides: DataFrame, pages: DataFrame) -> DataFrame:
    """decisions (event_id, position, name, fighter_id, page_title, revision_id, receipt_sha256, reviewed_by) with `problem`: twice, unreviewed, other_revision, no_such_side (absent, or linked), other_page; null for
    one that may be used. Decisions on events that are not imported are left out."""
    keys = ["event_id", "position", "name"]
    count = decisions.groupBy(*keys).agg(F.count("*").alias("_n"))
    unlinked = sides.where("title is null").select(*keys).distinct().withColumn("_side", F.lit(True))
    rows = decisions.join(events.select("event_id", F.col("revision_id").alias("_revision"), F.col("receipt_sha256").alias("_receipt")), "event_id")
    rows = rows.join(count, keys).join(unlinked, keys, "left").join(pages.select(F.col("title").alias("page_title"), F.col("page_id").alias("_page")), "page_title", "left")
    foreign = F.startswith("fighter_id", F.lit("page:")) & ~F.coalesce(F.col("fighter_id") == F.concat(F.lit("page:"), F.col("_page").cast("string")), F.lit(False))
    same = (F.col("revision_id") == F.col("_revision")) & (F.col("receipt_sha256") == F.col("_receipt"))
    problem = F.when(F.col("_n") > 1, "twice").when(F.coalesce("reviewed_by", F.lit("")) == "", "unreviewed").when(~F.coalesce(same, F.lit(False)), "other_revision").when(F.col("_side").isNull(), "no_such_side").when(foreign, "other_page")
    return rows.select(*decisions.columns, problem.alias("problem"))


def resolve(sides: DataFrame, events: DataFrame, pages: DataFrame, redirects: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J34. sides (event_id, position, side a or b, name, title or null). Returns the sides with fighter_id, tier (linked, reviewed) and `reason` (missing_page, unlinked_name), and the contests
    with a_id, b_id and `reason`: unresolved_identity, one_id_twice, missing_side, or null for one that may be imported.

    A linked side is never looked up among the decisions, and a decision with a problem is as none. A side that is there twice makes its contest missing_side."""
    names = sides.select("title").unionByName(decisions.select(F.col("page_title").alias("title")))
    known = pages_of(names, pages, redirects)
    usable = decision_problems(decisions, events, sides, known).where("problem is null").select("event_id", "position", "name", F.col("fighter_id").alias("_reviewed"))
    rows = sides.join(known, "title", "left").join(usable, ["event_id", "position", "name"], "left")
    linked = F.col("title").isNotNull()
    fighter = F.when(linked, F.when(F.col("page_id").isNotNull(), F.concat(F.lit("page:"), F.col("page_id").cast("string")))).otherwise(F.col("_reviewed"))
    tier = F.when(fighter.isNotNull(), F.when(linked, "linked").otherwise("reviewed"))
    reason = F.when(fighter.isNull(), F.when(linked, "missing_page").otherwise("unlinked_name"))
    told = rows.select("event_id", "position", "side", "name", "title", fighter.alias("fighter_id"), tier.alias("tier"), reason.alias("reason"))
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("fighter_id"))).alias(f"{s}_id")
    contests = told.groupBy("event_id", "position").agg(of("a"), of("b"), F.count("*").alias("_n"), F.countDistinct("side").alias("_sides"), F.count_if(F.col("fighter_id").isNull()).alias("_open"))
    why = F.when((F.col("_n") != 2) | (F.col("_sides") != 2), "missing_side").when(F.col("_open") > 0, "unresolved_identity").when(F.col("a_id") == F.col("b_id"), "one_id_twice")
    return told, contests.select("event_id", "position", F.when(why.isNull(), F.col("a_id")).alias("a_id"), F.when(why.isNull(), F.col("b_id")).alias("b_id"), why.alias("reason"))


def absent(old: DataFrame, contests: DataFrame) -> DataFrame:
    """Contests (event_id, position) that an earlier import had and this one leaves out or cannot resolve any more: a reason to refuse the import."""
    return old.join(contests.where("reason is null").select("event_id", "position"), ["event_id", "position"], "left_anti")
