"""Forward replay: what was known at a saved capture, over two times: when a contest took place and when its result was captured.

A revision of a result counts from the later of its capture and the day after the contest, until the next revision replaces it. As changes of
running sums by participant, in order of that day, the state at any cutoff is the last sum at or before it: one sort by participant for all
targets, instead of a rebuild of the history for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof
from .market import no_vig

HELD = "held_incomplete_history"


def states(contests: DataFrame, revisions: DataFrame) -> DataFrame:
    """fighter_id, day, and from that day on: contests that took place (required), those with a captured result (proven), and scored and total points
    by the newest captured revisions.

    contests: bout_id, fighter_id, day. revisions: bout_id, fighter_id, captured, number (order of revisions captured at one time), points (null: no
    contest). Of a repeated number the greater points count; a revision of an unknown contest is ignored, one captured before its contest counts from the day after it."""
    day_after = contests.select("bout_id", "fighter_id", (F.col("day") + 1).alias("after"))
    known = revisions.groupBy("bout_id", "fighter_id", "captured", "number").agg(F.max("points").alias("points")).join(day_after, ["bout_id", "fighter_id"])
    order = Window.partitionBy("bout_id", "fighter_id").orderBy("captured", "number")
    counts, points = F.col("points").isNotNull().cast("int"), F.coalesce("points", F.lit(0.0))
    steps = known.select(
        "fighter_id", F.greatest("captured", "after").alias("day"), F.lit(0).alias("required"), (F.row_number().over(order) == 1).cast("int").alias("proven"),
        (counts - F.coalesce(F.lag(counts).over(order), F.lit(0))).alias("scored"), (points - F.coalesce(F.lag(points).over(order), F.lit(0.0))).alias("total"),
    )
    held = day_after.select("fighter_id", F.col("after").alias("day"), F.lit(1).alias("required"), F.lit(0).alias("proven"), F.lit(0).alias("scored"), F.lit(0.0).alias("total"))
    columns = ["required", "proven", "scored", "total"]
    daily = steps.unionByName(held).groupBy("fighter_id", "day").agg(*[F.sum(c).alias(c) for c in columns])
    upto = Window.partitionBy("fighter_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("fighter_id", "day", *[F.sum(c).over(upto).alias(c) for c in columns])


def books(quotes: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (bout_id, a, b, day, cutoff) and book, the market of the newest capture at or before the cutoff, if it has exactly one price for each of both
    sides, updated at the same time and not after the capture. A newer capture that is no such market hides older ones.

    quotes: bout_id, book, side (a participant), price, updated, captured. Prices that are null or at most 1 spoil their capture."""
    seen = quotes.join(targets.select("bout_id", "a", "b", "cutoff"), "bout_id").where(F.col("captured") <= F.col("cutoff"))
    price = lambda s: F.max(F.when(F.col("side") == F.col(s), F.col("price")))
    good = F.coalesce((F.col("price") > 1) & (F.col("updated") <= F.col("captured")) & ((F.col("side") == F.col("a")) | (F.col("side") == F.col("b"))), F.lit(False))
    each = seen.groupBy("bout_id", "book", "captured").agg(
        F.count("*").alias("rows"), F.count_if(good).alias("good"), F.countDistinct("updated").alias("times"), F.max("updated").alias("updated"), price("a").alias("price_a"), price("b").alias("price_b"),
    )
    newest = each.groupBy("bout_id", "book").agg(F.max_by(F.struct(*each.columns), "captured").alias("m")).select("m.*")
    market = newest.where("rows = 2 and good = 2 and times = 1 and price_a is not null and price_b is not null")
    return market.select("bout_id", "book", "captured", "updated", "price_a", "price_b", no_vig(F.col("price_a"), F.col("price_b")).alias("p_a"))


def replay(targets: DataFrame, contests: DataFrame, revisions: DataFrame, quotes: DataFrame, start: Column | None = None) -> DataFrame:
    """Each target (bout_id, card, a, b, day, cutoff) with its status, forecast and saved markets.

    One earlier contest of any side on the card whose result was not captured by the cutoff holds every forecast of the card, as a partial history is
    none. A forecast weighs both sides' earlier points per contest. odds_status: started_at_capture (by `start`, an expression over the target), no_two_sided_book
    or two_sided. Nothing is written back, and nothing captured after the cutoff is seen."""
    known = states(contests, revisions).withColumnRenamed("day", "at")
    sides = targets.select("bout_id", "card", "cutoff", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("fighter_id")), F.struct(F.lit("b").alias("side"), F.col("b").alias("fighter_id")))).alias("s")).select("bout_id", "card", "cutoff", "s.*")
    columns = ["required", "proven", "scored", "total"]
    state = asof.asof_join(sides, known, ["fighter_id"], "cutoff", "at", columns)
    state = state.select("bout_id", "card", "side", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])
    open_cards = state.groupBy("card").agg(F.sum(F.col("required") - F.col("proven")).alias("unproven"))
    of = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")
    pair = state.groupBy("bout_id").agg(*[of(c, s) for c in ("scored", "total") for s in "ab"])
    saved = books(quotes, targets).groupBy("bout_id").agg(F.count("*").alias("books"), F.avg("p_a").alias("market_p"), F.max("updated").alias("updated"))
    rows = targets.join(open_cards, "card").join(pair, "bout_id").join(saved, "bout_id", "left")
    weight = lambda s: (F.col(f"total_{s}") + 1) / (F.col(f"scored_{s}") + 2)
    status = F.when(F.col("unproven") > 0, HELD).otherwise("exploratory")
    started = F.coalesce(start if start is not None else F.lit(False), F.lit(False))
    odds = F.when(started, "started_at_capture").when(F.col("books") > 0, "two_sided").otherwise("no_two_sided_book")
    return rows.select(
        "bout_id", "card", "unproven", status.alias("status"), F.when(F.col("unproven") == 0, weight("a") / (weight("a") + weight("b"))).alias("p"), F.col("scored_a").alias("prior_a"), F.col("scored_b").alias("prior_b"),
        odds.alias("odds_status"), F.when(odds == "two_sided", F.col("books")).otherwise(F.lit(0)).alias("books"), F.when(odds == "two_sided", F.col("market_p")).alias("market_p"), F.when(odds == "two_sided", F.col("cutoff") - F.col("updated")).alias("age"),
    )
