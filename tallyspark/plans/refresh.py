"""The whole refresh: the test tables written as the archive's four kinds of CSV files, then read, normalised, gated and published.

An order is a contest on a card of its own customer and date; its two sides are its least and its greatest supplier, whose lines are their rounds.
Some contests are spoiled: an outcome that is none, a repeated address with other values, a side without a profile or with two, a clock
beyond its round, an unknown schedule. SQL tells what must come out without reading a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import refresh, store
from ..sources import archive as source
from .domain import CONTESTS, paired, table
from .domain import rounds as rounds_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HOST = "stats.example.org"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def address(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"http://{HOST}/{kind}/"), F.lpad(F.lower(F.hex(number)), 16, "0"))


def archive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """events, results, rounds and profiles as the CSV files have them: text alone. The contests, with the last round of each, are made once and stored."""
    key = F.col("bout_id")
    both = paired(spark, sf_dir, rounds_of(spark, sf_dir).select("bout_id", "fighter_id"), [F.count("*").alias("n")]).where("own.fighter_id < other.fighter_id")
    c = store.stored(both.select("bout_id", "event_date", "outcome", "division", "event_id", "day", F.col("own.fighter_id").alias("a"), F.col("other.fighter_id").alias("b"), F.greatest("own.n", "other.n").alias("finish")), "contests")
    c = c.withColumn("event", F.concat_ws(" ", F.lit("Card"), F.col("event_id").cast("string"), F.col("day").cast("string")))
    name = lambda x: F.concat(F.lit("Fighter "), x.cast("string"))
    c = c.withColumn("bout", F.concat(name(F.col("a")), F.lit(" vs. "), name(F.col("b")))).withColumn("card", F.col("event_id") * 100_000 + F.col("day"))
    events = c.select("event", F.date_format("event_date", "MMMM d, yyyy").alias("date"), address("event-details", F.col("card")).alias("url")).distinct()
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bout_id"), F.col("l_suppkey").alias("fighter_id"), "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_partkey")
    lines = lines.join(c.select("bout_id", "event", "bout", "a", "b"), "bout_id").where("fighter_id = a or fighter_id = b")
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("bout_id", "fighter_id").orderBy("l_linenumber")))
    whole = lambda x: x.cast("long").cast("string")
    pair = F.concat(whole(F.floor(F.col("l_quantity") * (1 - F.col("l_discount")))), F.lit(" of "), whole(F.col("l_quantity")))
    sig = F.when(F.col("l_returnflag") == "R", "unreadable").otherwise(pair)
    control = F.when(F.col("l_partkey") % 7 == 0, "--").otherwise(F.concat(F.floor(F.col("l_partkey") % 300 / 60).cast("string"), F.lit(":"), F.lpad((F.col("l_partkey") % 60).cast("string"), 2, "0")))
    rounds = lines.select("event", "bout", F.concat(F.lit("Round "), F.col("n").cast("string")).alias("round"), name(F.col("fighter_id")).alias("fighter"), F.lit("0").alias("kd"), sig.alias("sig"), pair.alias("total"), F.lit("1 of 2").alias("td"), F.lit("0").alias("sub_attempts"), F.lit("0").alias("reversals"), control.alias("control"), *[F.lit("0 of 0").alias(x) for x in ("head", "body", "leg", "distance", "clinch", "ground")])
    outcome = F.when(key % 13 == 1, "?").when(F.col("outcome") == "win", "W/L").when(F.col("outcome") == "draw", "D/D").otherwise("NC/NC")
    form = F.when(key % 17 == 2, "Unknown").otherwise("5 Rnd (5-5-5-5-5)")
    results = c.select("event", "bout", outcome.alias("outcome"), F.col("division").alias("weightclass"), F.col("finish").cast("string").alias("round"), F.when(key % 19 == 3, "6:00").otherwise("2:30").alias("time"), form.alias("time_format"), address("fight-details", key).alias("url"), key)
    again = results.where(key % 23 == 4).withColumn("time", F.lit("1:11"))  # the same address with another value
    results = results.unionByName(again).drop("bout_id")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    rows = s.where("id % 29 <> 5").unionByName(s.where("id % 31 = 6").withColumn("id", F.col("id")))  # some are missing, some there twice
    profiles = rows.select(name(F.col("id")).alias("fighter"), F.when(F.col("id") % 5 == 0, "--").otherwise('70"').alias("reach"), address("fighter-details", F.col("id")).alias("url"))
    return {"events": events, "results": results, "rounds": rounds, "profiles": profiles}


def written(spark: SparkSession, sf_dir: str) -> str:
    """The archive as folders of CSV files in the shared folder."""
    folder = store.scratch(spark, "archive")
    for kind, df in archive(spark, sf_dir).items():
        source.write_csv(df, f"{folder}/{kind}", kind)
    return folder


def refreshed(spark: SparkSession, sf_dir: str, table_name: str) -> DataFrame:
    """A table of the version that a whole refresh publishes: CSV files are written, digested, read, normalised, gated and published in a place of their own."""
    folder, root = written(spark, sf_dir), store.scratch(spark, "published")
    refresh.refresh(spark, folder, root, HOST)
    store.remove(spark, folder)
    return store.read(spark, root, table_name)


def number(column: str) -> Column:
    return F.conv(F.right(column, F.lit(16)), 16, 10).cast("long")


EXPECTED = f"""WITH {CONTESTS}, l AS (SELECT l_orderkey AS bout_id, l_suppkey AS fighter_id, c.bout_id * 0 + CASE WHEN l_suppkey = a THEN 0 ELSE 1 END AS side, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS n,
        CASE WHEN l_returnflag <> 'R' THEN floor(l_quantity * (1 - l_discount))::BIGINT END AS sig_landed, floor(l_quantity * (1 - l_discount))::BIGINT AS total_landed, CASE WHEN l_partkey % 7 <> 0 THEN floor(l_partkey % 300 / 60)::BIGINT * 60 + l_partkey % 60 END AS control
        FROM lineitem JOIN contests c ON c.bout_id = l_orderkey AND l_suppkey IN (a, b)),
    f AS (SELECT bout_id, max(n) AS finish, count(*) AS have, bool_and(sig_landed IS NOT NULL) AS readable FROM l GROUP BY bout_id),
    people AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 29 = 5 THEN 0 ELSE 1 END + CASE WHEN s_suppkey % 31 = 6 THEN 1 ELSE 0 END AS n FROM supplier),
    x AS (SELECT c.bout_id, c.event_date, c.a, c.b, outcome, finish, CASE WHEN c.bout_id % 23 = 4 THEN 'conflicting_duplicate_url' WHEN p.n <> 1 OR q.n <> 1 THEN 'unknown_or_ambiguous_fighter' WHEN c.bout_id % 13 = 1 THEN 'unsupported_outcome'
        WHEN have <> 2 * finish OR NOT (SELECT count(*) = 2 FROM (SELECT side FROM l WHERE l.bout_id = c.bout_id GROUP BY side)) THEN 'missing_or_conflicting_rounds' END AS reason,
        CASE WHEN c.bout_id % 17 <> 2 AND c.bout_id % 19 <> 3 AND finish <= 5 THEN (finish - 1) * 300 + 150 END AS duration
        FROM contests c JOIN f USING (bout_id) JOIN people p ON p.id = a JOIN people q ON q.id = b)"""


@query(f"""{EXPECTED} SELECT bout_id, reason, CASE WHEN reason IS NULL THEN 'usable' ELSE 'held' END AS status, CASE WHEN reason IS NULL THEN duration END AS duration, finish::BIGINT AS finish FROM x""")
def refresh_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.14, S1, S2, K5, A34: every contest of the archive, usable or held with the first reason that holds."""
    rows = refreshed(spark, sf_dir, "contests")
    return rows.select(number("bout_id").alias("bout_id"), "reason", "status", F.when(F.col("status") == "usable", F.col("duration")).alias("duration"), F.col("finish").cast("long").alias("finish"))


@query(f"""{EXPECTED} SELECT l.bout_id, l.fighter_id, CASE WHEN count(sig_landed) = count(*) THEN sum(sig_landed) END::BIGINT AS sig_landed, sum(total_landed)::BIGINT AS total_landed,
    CASE WHEN count(control) = count(*) AND sum(control) <= coalesce(any_value(duration), 1099511627776) THEN sum(control) END::BIGINT AS control_seconds FROM l JOIN x USING (bout_id) WHERE reason IS NULL GROUP BY ALL""")
def refresh_facts(spark, sf_dir):
    """2.14: totals of both sides of the usable contests; a total is null where any round's value is, or where control exceeds the time fought."""
    rows = refreshed(spark, sf_dir, "facts")
    return rows.select(number("bout_id").alias("bout_id"), number("fighter_id").alias("fighter_id"), "sig_landed", "total_landed", "control_seconds")
