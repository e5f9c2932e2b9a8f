"""Daily summaries: nested JSON with one entry for each contest, as contests and as cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

SCHEMA = """summaries array<struct<
    sport_event struct<id string, start_time string, replaced_by string,
        sport_event_context struct<category struct<id string>, season struct<id string, name string, start_date string>, competition struct<name string>>,
        competitors array<struct<id string, name string, qualifier string, virtual boolean>>>,
    sport_event_status struct<status string, winner string, winner_id string, weight_class string, scheduled_length int, method string>>>"""
#: States of the provider.
CANCELLED, FINISHED = ("cancelled",), ("closed", "ended")
WAITING = ("not_started", "match_about_to_start", "live", "delayed", "postponed", "interrupted", "suspended", "start_delayed")


def contests(payloads: DataFrame, category: str) -> DataFrame:
    """payloads (payload) -> a row for each contest of the category, with `problem` where it can't be used: duplicate_id,
    no_date, unknown_status, competitors, unresolved_winner, inconsistent_date; null otherwise. A finished contest
    without a result counts as scheduled (`incomplete`)."""
    rows = payloads.select(F.explode(F.from_json("payload", SCHEMA).getField("summaries")).alias("s"))
    event, status = F.col("s.sport_event"), F.col("s.sport_event_status")
    context = event["sport_event_context"]
    real = F.filter(event["competitors"], lambda c: ~F.coalesce(c["virtual"], F.lit(False)))
    rows = rows.where(context["category"]["id"] == category).select(
        event["id"].alias("bout_id"), context["season"]["id"].alias("event_id"), F.coalesce(context["season"]["name"], context["competition"]["name"]).alias("name"),
        scalar.utc(event["start_time"]).alias("start"), F.try_to_date(context["season"]["start_date"], "yyyy-MM-dd").alias("_day"), event["replaced_by"].alias("replaced_by"),
        status["status"].alias("source_status"), status["winner"].alias("_winner"), status["winner_id"].alias("_winner_id"), status["weight_class"].alias("weight_class"),
        status["scheduled_length"].alias("scheduled_rounds"), status["method"].alias("method"), F.coalesce(real, F.array()).alias("sides"),
    )
    rows = rows.withColumn("event_date", F.coalesce("_day", F.to_date("start")))
    side = lambda q: F.filter("sides", lambda c: c["qualifier"] == q)
    declared = F.when(F.col("_winner") == "home_team", side("home")).when(F.col("_winner") == "away_team", side("away"))
    by_name = F.when(F.size(declared) == 1, F.get(declared, F.lit(0))["id"])
    winner = F.coalesce("_winner_id", by_name)
    finished = F.col("source_status").isin(*FINISHED)
    known = F.exists("sides", lambda c: c["id"] == winner)
    plain = F.col("_winner").isin("draw", "no_contest")
    outcome = F.when(finished & plain & F.col("_winner_id").isNull(), F.col("_winner")).when(finished & winner.isNotNull() & F.coalesce(known, F.lit(False)), "win")
    ids = F.transform("sides", lambda c: c["id"])
    state = F.when(F.col("source_status").isin(*CANCELLED) | F.col("replaced_by").isNotNull(), "cancelled").when(F.col("source_status").isin(*WAITING), "scheduled").when(finished & outcome.isNotNull(), "completed").when(finished, "scheduled")
    contradicts = finished & ((plain & F.col("_winner_id").isNotNull()) | (F.col("_winner").isNotNull() & outcome.isNull() & ~plain) | (by_name != F.col("_winner_id")))
    dates = Window.partitionBy("event_id")
    problem = first(
        ("duplicate_id", F.count("*").over(Window.partitionBy("bout_id")) > 1),
        ("no_date", F.col("event_date").isNull()),
        ("inconsistent_date", F.min("event_date").over(dates) != F.max("event_date").over(dates)),
        ("unknown_status", state.isNull()),
        ("competitors", ~F.size("sides").isin(0, 2) | (F.size(F.array_distinct(ids)) != F.size("sides"))),
        ("unresolved_winner", F.coalesce(contradicts, F.lit(False)) | (finished & F.col("replaced_by").isNotNull())),
    )
    return rows.select("bout_id", "event_id", "name", "event_date", "start", state.alias("status"), "source_status", ids.alias("side_ids"), outcome.alias("outcome"), F.when(outcome == "win", winner).alias("winner_id"), (finished & outcome.isNull()).alias("incomplete"), "weight_class", "scheduled_rounds", "method", problem.alias("problem"))


def first(*rules: tuple[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def cards(rows: DataFrame) -> DataFrame:
    """Usable contests nested in their event, with the earliest start."""
    usable = rows.where("problem is null")
    return usable.groupBy("event_id").agg(F.min("name").alias("name"), F.min("event_date").alias("event_date"), F.min("start").alias("start"), F.sort_array(F.collect_list("bout_id")).alias("bouts"))
