"""Joins that keep what is ambiguous: unique matches with holds, unordered pairs, date bands, two-sided markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .store import forget, stored


def pair(a: str, b: str) -> list[Column]:
    """The key of an unordered pair."""
    return [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]


def unique_match(left: DataFrame, right: DataFrame, keys: list[str], right_id: str) -> DataFrame:
    """left with the right id where its key occurs once on either side; else null and a reason: `absent` or `ambiguous`.
    Keys are counted before the join, so a key that is frequent on both sides never multiplies."""
    n = left.groupBy(*keys).agg(F.count("*").alias("_nl"))
    m = right.groupBy(*keys).agg(F.count("*").alias("_nr"), F.min(right_id).alias("_id"))
    joined = left.join(n, keys, "left").join(m, keys, "left")
    only = (F.col("_nl") == 1) & (F.col("_nr") == 1)
    reason = F.when(F.col("_nr").isNull(), "absent").when(~only, "ambiguous")
    return joined.withColumn("matched_id", F.when(only, F.col("_id"))).withColumn("hold", reason).drop("_nl", "_nr", "_id")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, days: int) -> DataFrame:
    """Pairs of rows with equal keys at most `days` apart. Right rows are sent to the three day buckets that
    may hold a partner; so a key with a long history meets a stretch of it, not all."""
    size = 2 * days + 1
    a = left.withColumn("_bucket", F.floor(F.col(left_day) / size))
    b = right.withColumn("_bucket", F.explode(F.array_distinct(F.array(F.floor((F.col(right_day) - days) / size), F.floor((F.col(right_day) + days) / size)))))
    return a.join(b, [*keys, "_bucket"]).where(F.abs(F.col(left_day) - F.col(right_day)) <= days).drop("_bucket")


def two_sided(quotes: DataFrame, market: list[str], side: str, price: str, sides: tuple[str, str]) -> DataFrame:
    """Markets with exactly one distinct price on each of two sides, and the probabilities without the margin."""
    one = [F.collect_set(F.when(F.col(side) == s, F.col(price))) for s in sides]
    rows = quotes.groupBy(*market).agg(one[0].alias("_a"), one[1].alias("_b"), F.countDistinct(side).alias("_n"))
    rows = rows.where("size(_a) = 1 and size(_b) = 1 and _n = 2").withColumn("price_a", F.get("_a", F.lit(0))).withColumn("price_b", F.get("_b", F.lit(0)))
    inverse = 1 / F.col("price_a"), 1 / F.col("price_b")
    return rows.drop("_a", "_b", "_n").withColumn("p_a", inverse[0] / (inverse[0] + inverse[1])).withColumn("overround", inverse[0] + inverse[1] - 1)


def orphans(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str]) -> DataFrame:
    """Child rows whose foreign key is wholly given and has no parent."""
    given = child
    for k in child_keys:
        given = given.where(F.col(k).isNotNull())
    return given.join(parent.select(*[F.col(p).alias(c) for c, p in zip(child_keys, parent_keys, strict=True)]), child_keys, "left_anti")


def share_one(left: DataFrame, event: str, low: str, high: str, row: str) -> DataFrame:
    """Pairs of contests of one event that share exactly one participant, found by an equi-join on (event, participant)."""
    sides = left.select(F.col(event), F.col(row), F.explode(F.array(low, high)).alias("who"))
    other = sides.withColumnRenamed(row, "other")
    return sides.join(other, [event, "who"]).where(F.col(row) < F.col("other")).groupBy(event, row, "other").agg(F.count("*").alias("shared"), F.min("who").alias("who")).where("shared = 1").drop("shared")


def resolved(links: DataFrame, child: str, parent: str) -> DataFrame:
    """The end of each chain of redirects (child -> parent), null where it runs in a circle. Pointer doubling: a chain of length n takes
    log n rounds, each a table in the shared folder. While any chain is left, every round ends at least one (its member just
    beyond the reach so far); so what no round ends any more runs in circles. A child has one parent."""
    step = links.select(F.col(child).alias("id"), F.col(parent).alias("at"))
    step = step.join(step.select(F.col("id").alias("at"), F.lit(True).alias("open")), "at", "left").select("id", "at", F.coalesce("open", F.lit(False)).alias("open"))
    left = last = None
    while True:
        watch = Observation()
        step = stored(step.observe(watch, F.count_if("open").alias("n")), "redirects")
        if last is not None:
            forget(last)
        last = step
        now = watch.get["n"]
        if now == 0 or now == left:
            return step.select("id", F.when(~F.col("open"), F.col("at")).alias("target"))
        left = now
        to = step.select(F.col("id").alias("at"), F.col("at").alias("_next"), F.col("open").alias("_on"))
        step = step.join(to, "at", "left").select("id", F.when(F.col("open"), F.col("_next")).otherwise(F.col("at")).alias("at"), (F.col("open") & F.col("_on")).alias("open"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("duplicate", F.count("*").over(Window.partitionBy(*keys)) > 1)
