"""Nested price documents, flattened to one row for each two-sided market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

SCHEMA = """array<struct<id string, home_team string, away_team string, commence_time string, bookmakers array<struct<key string, last_update string,
    markets array<struct<key string, last_update string, outcomes array<struct<name string, price double>>>>>>>>"""


def head_to_head(captures: DataFrame) -> DataFrame:
    """captures (payload, captured_at) -> event, book, sides, prices and times of each `h2h` market with exactly the two
    teams, finite prices above 1, and an update not after the capture. Payloads that are no such document give no rows."""
    event = captures.select(F.col("captured_at").cast("timestamp").alias("captured_at"), F.explode(F.from_json("payload", SCHEMA)).alias("e"))
    book = event.select("captured_at", "e.id", "e.home_team", "e.away_team", scalar.utc(F.col("e.commence_time")).alias("commence"), F.explode("e.bookmakers").alias("b"))
    market = book.select("captured_at", "id", "home_team", "away_team", "commence", F.col("b.key").alias("book"), F.col("b.last_update").alias("_update"), F.explode("b.markets").alias("m")).where("m.key = 'h2h'")
    price = lambda side: F.filter("m.outcomes", lambda o: o["name"] == F.col(side))
    rows = market.withColumn("h", price("home_team")).withColumn("a", price("away_team")).where("size(m.outcomes) = 2 and size(h) = 1 and size(a) = 1 and home_team <> away_team")
    rows = rows.select("id", "book", "home_team", "away_team", F.get("h", F.lit(0)).getField("price").alias("home_price"), F.get("a", F.lit(0)).getField("price").alias("away_price"), "commence", scalar.utc(F.coalesce("m.last_update", "_update")).alias("updated_at"), "captured_at")
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 1) & (F.col(c) < float("inf"))
    return rows.where(fine("home_price") & fine("away_price") & (F.col("updated_at") <= F.col("captured_at")))
