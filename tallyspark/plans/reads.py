"""Reads of the whole history: aggregates before each contest, rounds, coverage of events and participants, research ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from .domain import CONTESTS, PEOPLE, RECORDS, contests, people, records, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FIELDS = ["sig_landed", "sig_attempted", "td_landed", "td_attempted", "kd", "control_seconds"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def totals_sql() -> str:
    total = lambda c: f"CASE WHEN count(p.bout_id) > 0 AND count(p.{c}) = count(p.bout_id) THEN sum(p.{c}) END AS {c}"
    columns = [total("elapsed"), "coalesce(sum(p.elapsed), 0)::DOUBLE AS known_elapsed", "count(p.elapsed) AS duration_bouts"]
    columns += [total(f) for f in FIELDS] + [total(f"o_{f}") for f in FIELDS] + [f"count(p.bout_id) - count(p.{f}) AS missing_{f}" for f in FIELDS]
    return f"WITH {RECORDS} SELECT f.bout_id, f.fighter_id, count(p.bout_id) AS bouts, {', '.join(columns)} FROM records f LEFT JOIN records p ON p.fighter_id = f.fighter_id AND p.day < f.day GROUP BY f.bout_id, f.fighter_id"


@query(totals_sql())
def fighter_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: what `History.fighter_aggregate` says of each side before every contest, in one pass."""
    return history.aggregates_before(records(spark, sf_dir), FIELDS)


@query(f"""WITH {CONTESTS}, r AS (SELECT l_orderkey AS bout_id, l_suppkey AS fighter_id, l_linenumber AS number, (l_linenumber % 4) * 60.0 AS elapsed, l_partkey % 300 AS control FROM lineitem)
    SELECT bout_id, fighter_id, number, nullif(elapsed, 0)::DOUBLE AS elapsed, CASE WHEN control > nullif(elapsed, 0) THEN NULL ELSE control END::DOUBLE AS control_seconds FROM r JOIN contests USING (bout_id) WHERE fighter_id IN (a, b)""")
def bout_rounds(spark, sf_dir):
    """Q12: the rounds of both sides of every contest; control beyond the round's time is not shown."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bout_id"), F.col("l_suppkey").alias("fighter_id"), F.col("l_linenumber").alias("number"), F.nullif(F.col("l_linenumber") % 4 * 60, F.lit(0)).cast("double").alias("elapsed"), (F.col("l_partkey") % 300).cast("double").alias("control_seconds"))
    both = line.join(contests(spark, sf_dir).select("bout_id", "a", "b"), "bout_id").where("fighter_id in (a, b)").drop("a", "b")
    return history.paired_rounds(both)


def bouts(spark, sf_dir) -> DataFrame:
    """Contests with a status, and identities that some lack."""
    key = F.col("bout_id")
    rows = contests(spark, sf_dir)
    elapsed = F.when(key % 4 != 0, (key % 4) * 300.0)
    return rows.select("bout_id", "event_id", "day", F.when(key % 7 != 3, F.col("a")).alias("a"), "b", F.when((key % 7 == 3) | (key % 11 == 0), "held").otherwise("usable").alias("status"), elapsed.alias("elapsed"))


BOUTS = f"""{CONTESTS}, {PEOPLE}, bouts AS (SELECT bout_id, event_id, day, CASE WHEN bout_id % 7 <> 3 THEN a END AS a, b, CASE WHEN bout_id % 7 = 3 OR bout_id % 11 = 0 THEN 'held' ELSE 'usable' END AS status, CASE WHEN bout_id % 4 <> 0 THEN bout_id % 4 * 300.0 END AS elapsed FROM contests)"""


@query(f"""WITH {BOUTS} SELECT c_custkey AS event_id, CASE WHEN c_custkey % 3 = 0 THEN 'R' || c_custkey END AS research_id, count(bout_id) AS bouts, count(*) FILTER (WHERE status = 'usable') AS paired_stat_bouts, count(*) FILTER (WHERE status = 'usable' AND elapsed IS NOT NULL) AS duration_stat_bouts,
    count(*) FILTER (WHERE status = 'held') AS held_bouts, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS identity_resolved_bouts, count(*) FILTER (WHERE x.reach_cm IS NOT NULL AND y.reach_cm IS NOT NULL) AS both_reach_bouts
    FROM customer LEFT JOIN bouts ON event_id = c_custkey LEFT JOIN people x ON x.fighter_id = a LEFT JOIN people y ON y.fighter_id = b GROUP BY c_custkey""")
def event_coverage(spark, sf_dir):
    """Q12, A4: every event, also those without a contest."""
    events = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"))
    links = events.where("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.concat(F.lit("R"), F.col("event_id").cast("string")).alias("research_id"))
    return history.event_coverage(events, bouts(spark, sf_dir), people(spark, sf_dir), links)


@query(f"""WITH {RECORDS}, {PEOPLE} SELECT p.fighter_id, p.reach_cm, CASE WHEN p.fighter_id % 2 = 0 THEN 'R' || p.fighter_id END AS research_id, count(r.bout_id) AS paired_stat_bouts, count(r.elapsed) AS duration_stat_bouts, min(r.day) AS first_day, max(r.day) AS last_day
    FROM people p LEFT JOIN records r USING (fighter_id) GROUP BY ALL""")
def fighter_coverage(spark, sf_dir):
    """Q12: every participant, also those without a contest."""
    profiles = people(spark, sf_dir).select("fighter_id", "reach_cm")
    links = profiles.where("fighter_id % 2 = 0").select(F.col("fighter_id").alias("id"), F.concat(F.lit("R"), F.col("fighter_id").cast("string")).alias("research_id"))
    return history.fighter_coverage(profiles, records(spark, sf_dir), links)


@query(f"""WITH {RECORDS}, b AS (SELECT o_orderkey AS id, 'B' || o_orderkey AS rid FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'C' || o_orderkey FROM orders WHERE o_orderkey % 10 = 0),
    f AS (SELECT s_suppkey AS id, 'F' || s_suppkey AS rid FROM supplier WHERE s_suppkey % 3 <> 0), bo AS (SELECT id, min(rid) AS rid FROM b GROUP BY id HAVING count(DISTINCT rid) = 1)
    SELECT r.bout_id, r.fighter_id, r.opponent_id, bo.rid AS research_bout_id, x.rid AS research_fighter_id, y.rid AS research_opponent_id FROM records r LEFT JOIN bo ON bo.id = r.bout_id LEFT JOIN f x ON x.id = r.fighter_id LEFT JOIN f y ON y.id = r.opponent_id""")
def research_ids(spark, sf_dir):
    """The research ids of every side of a contest; an id with two links has none."""
    key, who = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    name = lambda letter: F.concat(F.lit(letter), F.col("id").cast("string")).alias("research_id")
    links = key.where("id % 2 = 0").select("id", name("B")).unionByName(key.where("id % 10 = 0").select("id", name("C")))
    return history.crosswalk(records(spark, sf_dir).select("bout_id", "fighter_id", "opponent_id"), links, who.where("id % 3 <> 0").select("id", name("F")))
