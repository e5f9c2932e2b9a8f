"""Reads of a published history: profiles, cards, earlier contests, rounds and aggregates of one participant, event or contest, and of all.

Each table is laid out by the key it is asked for: rows are dealt to buckets by the key's hash, a bucket is a folder, and within a file rows are sorted by
the key. A lookup names its bucket, so that Spark lists one folder of `BUCKETS`, and the file's statistics leave one row group to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import asof
from .metrics import all_or_null

BUCKETS = 64
#: The key that each table is asked for by, and what its rows are sorted by after it.
KEYS = {
    "profiles": ("fighter_id", []),
    "links": ("research_id", []),
    "events": ("event_id", []),
    "bouts": ("event_id", ["bout_id"]),
    "facts": ("fighter_id", ["day", "bout_id"]),
    "rounds": ("bout_id", ["number", "fighter_id"]),
}


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def lay_out(tables: dict[str, DataFrame], root: str, buckets: int = BUCKETS) -> None:
    """Write the tables (some of KEYS). A table of any size makes a few files in each bucket: rows go to tasks by bucket and a hash of their other
    keys, so that a hot key's rows are spread over its bucket's files."""
    for name, df in tables.items():
        key, order = KEYS[name]
        rows = df.withColumn("bucket", bucket(F.col(key), buckets))
        spread = F.pmod(F.xxhash64(*order), F.lit(4)) if order else F.lit(0)
        rows.repartition(F.col("bucket"), spread).sortWithinPartitions("bucket", key, *order).write.partitionBy("bucket").parquet(f"{root}/{name}")


def aggregates(fields: list[str]) -> list[Column]:
    """Totals that are null where any component is, the same of the opponent (o_...), missing values by field, and known time."""
    out = [F.count("*").alias("bouts"), all_or_null("elapsed").alias("elapsed"), F.coalesce(F.sum("elapsed"), F.lit(0)).alias("known_elapsed"), F.count("elapsed").alias("duration_bouts")]
    out += [all_or_null(f).alias(f) for f in fields] + [all_or_null(f"o_{f}").alias(f"o_{f}") for f in fields]
    return out + [F.count_if(F.col(f).isNull()).alias(f"missing_{f}") for f in fields]


def aggregates_before(facts: DataFrame, fields: list[str]) -> DataFrame:
    """Every row's bout_id, fighter_id and the same aggregates over the participant's rows of earlier dates: one sort by participant for all targets."""
    before = asof.earlier(["fighter_id"], "day")
    n = F.count(F.lit(1)).over(before)

    def total(c: str) -> Column:
        return F.when((n > 0) & (F.count(c).over(before) == n), F.sum(c).over(before))

    out = [n.alias("bouts"), total("elapsed").alias("elapsed"), F.coalesce(F.sum("elapsed").over(before), F.lit(0)).alias("known_elapsed"), F.count("elapsed").over(before).alias("duration_bouts")]
    out += [total(f).alias(f) for f in fields] + [total(f"o_{f}").alias(f"o_{f}") for f in fields]
    return facts.select("bout_id", "fighter_id", *out, *[(n - F.count(f).over(before)).alias(f"missing_{f}") for f in fields])


def paired_rounds(rounds: DataFrame) -> DataFrame:
    """Rounds (bout_id, number, fighter_id, elapsed, control_seconds, ...); control beyond the round's time is null."""
    over = F.coalesce(F.col("control_seconds") > F.col("elapsed"), F.lit(False))
    return rounds.withColumn("control_seconds", F.when(~over, F.col("control_seconds")))


def event_coverage(events: DataFrame, bouts: DataFrame, profiles: DataFrame, links: DataFrame) -> DataFrame:
    """Every event with its contests, usable ones, those with a duration, held ones, those with both identities and both reaches, and its research id."""
    reach = profiles.select("fighter_id", "reach_cm")
    rows = bouts
    for s in "ab":
        rows = rows.join(reach.select(F.col("fighter_id").alias(s), F.col("reach_cm").alias(f"reach_{s}")), s, "left")
    usable = F.col("status") == "usable"
    counts = {
        "bouts": F.lit(True), "paired_stat_bouts": usable, "duration_stat_bouts": usable & F.col("elapsed").isNotNull(), "held_bouts": F.col("status") == "held",
        "identity_resolved_bouts": F.col("a").isNotNull() & F.col("b").isNotNull(), "both_reach_bouts": F.col("reach_a").isNotNull() & F.col("reach_b").isNotNull(),
    }
    found = rows.groupBy("event_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    out = events.join(found, "event_id", "left").join(links.withColumnRenamed("id", "event_id"), "event_id", "left")
    return out.select(*events.columns, "research_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


def fighter_coverage(profiles: DataFrame, facts: DataFrame, links: DataFrame) -> DataFrame:
    """Every profile with its contests that have statistics, those with a duration, the first and the last date, and its research id."""
    found = facts.groupBy("fighter_id").agg(F.count("*").alias("paired_stat_bouts"), F.count("elapsed").alias("duration_stat_bouts"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    out = profiles.join(found, "fighter_id", "left").join(links.withColumnRenamed("id", "fighter_id"), "fighter_id", "left")
    return out.select(*profiles.columns, "research_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("paired_stat_bouts", "duration_stat_bouts")], "first_day", "last_day")


def crosswalk(facts: DataFrame, bouts: DataFrame, fighters: DataFrame) -> DataFrame:
    """Facts with the research ids of the contest, the participant and the opponent, null where there is no link. bouts and fighters: id, research_id; an id
    linked twice is ambiguous and gets none, so that rows never multiply."""
    one = lambda links, own, other: links.groupBy("id").agg(F.when(F.min("research_id") == F.max("research_id"), F.min("research_id")).alias(other)).withColumnRenamed("id", own)
    out = facts.join(one(bouts, "bout_id", "research_bout_id"), "bout_id", "left")
    out = out.join(one(fighters, "fighter_id", "research_fighter_id"), "fighter_id", "left")
    return out.join(one(fighters, "opponent_id", "research_opponent_id"), "opponent_id", "left")


class History:
    """Lookups in a laid-out history. Results are DataFrames that read one bucket; an unknown key gives no rows."""

    def __init__(self, spark: SparkSession, root: str, fields: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.fields, self.buckets = spark, root, fields, buckets

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}").drop("bucket")

    def of(self, name: str, value) -> DataFrame:
        key, _ = KEYS[name]
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        return rows.where((F.col("bucket") == bucket(F.lit(value), self.buckets)) & (F.col(key) == value)).drop("bucket")

    def fighter_id(self, value):
        """The participant that an id names: its own, or else the one that a research id is linked to; None where there is none, or several."""
        if self.of("profiles", value).limit(1).count():
            return value
        found = {r.fighter_id for r in self.of("links", value).select("fighter_id").distinct().limit(2).collect()}
        return found.pop() if len(found) == 1 else None

    def fighter_profile(self, value) -> DataFrame:
        return self.of("profiles", self.fighter_id(value))

    def event(self, event_id) -> DataFrame:
        return self.of("events", event_id)

    def event_bouts(self, event_id) -> DataFrame:
        return self.of("bouts", event_id).orderBy("bout_id")

    def prior_fighter_bouts(self, value, before: int) -> DataFrame:
        """The participant's contests of earlier days, oldest first."""
        return self.of("facts", self.fighter_id(value)).where(F.col("day") < before).orderBy("day", "bout_id")

    def last_bouts(self, value, before: int, n: int) -> DataFrame:
        """The last n of them: a sort that keeps n rows."""
        return self.of("facts", self.fighter_id(value)).where(F.col("day") < before).orderBy(F.desc("day"), F.desc("bout_id")).limit(n)

    def bout_rounds(self, bout_id) -> DataFrame:
        return paired_rounds(self.of("rounds", bout_id)).orderBy("number", "fighter_id")

    def fighter_aggregate(self, value, before: int) -> DataFrame:
        """One row, also where there is no earlier contest (0 bouts, null totals)."""
        rows = self.of("facts", self.fighter_id(value)).where(F.col("day") < before)
        out = rows.agg(*aggregates(self.fields))
        known = {"bouts", "known_elapsed", "duration_bouts", *(f"missing_{f}" for f in self.fields)}
        return out.select(*[c if c in known else F.when(F.col("bouts") > 0, F.col(c)).alias(c) for c in out.columns])


def numbered(bouts: DataFrame) -> DataFrame:
    """Contests of an event in order, from 1."""
    return bouts.withColumn("position", F.row_number().over(Window.partitionBy("event_id").orderBy("bout_id")))
