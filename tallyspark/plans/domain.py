"""The driver's tables read as contests, participants, quotes and forecasts; the same as SQL.

An order is a contest, its date the contest's date and its status the outcome. The least and the greatest
supplier of an order are its two sides; orders with one supplier have none. Lines are rounds: quantity is attempts,
quantity less discount is what landed (missing for returned lines), the line number gives a duration that may be missing.
Events are quotes: the user is the bookmaker, the type the side, the value the decimal price.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import store
from ..operators.asof import day_number


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outcome(status):
    return F.when(status == "F", "win").when(status == "O", "draw").otherwise("no_contest")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("bout_id"), F.col("l_suppkey").alias("fighter_id"), F.col("l_linenumber").alias("round"), F.col("l_quantity").alias("attempted"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity") * (1 - F.col("l_discount"))).alias("landed"), (F.nullif(F.col("l_linenumber") % 4, F.lit(0)) * 60).cast("double").alias("seconds"),
    )


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contest with its two sides, where it has two."""
    sides = rounds(spark, sf_dir).groupBy("bout_id").agg(F.min("fighter_id").alias("a"), F.max("fighter_id").alias("b")).where("a <> b")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bout_id"), F.to_date("o_orderdate").alias("event_date"), outcome(F.col("o_orderstatus")).alias("outcome"), F.col("o_orderpriority").alias("division"), F.col("o_custkey").alias("event_id"))
    return orders.join(sides, "bout_id").withColumn("day", day_number("event_date"))


#: Bytes of the lines' files for each partition by contest: what one task sorts and aggregates does not grow with the table.
LINE_BYTES = 8 << 20


def dealt(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Lines (or fewer rows) shuffled by contest: as adaptive execution has it while that gives each core and each partition at most LINE_BYTES, else into
    as many partitions as keep to them."""
    parts, shuffled = math.ceil(store.size(spark, f"{sf_dir}/lineitem.parquet") / LINE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if parts <= min(spark.sparkContext.defaultParallelism, shuffled):
        return lines.repartition("bout_id")
    return lines.repartition(max(parts, shuffled), "bout_id")


def paired(spark: SparkSession, sf_dir: str, lines: DataFrame, totals: list) -> DataFrame:
    """One row for each side of a contest with its totals as `own` and the opponent's as `other`. Lines are shuffled once, by contest: totals by side,
    both sides of a contest and the join with the orders all follow that partitioning. A line without a participant is on no side."""
    sides = dealt(spark, sf_dir, lines.where("fighter_id is not null")).groupBy("bout_id", "fighter_id").agg(*totals)
    side = F.struct("fighter_id", *[c for c in sides.columns if c not in ("bout_id", "fighter_id")])
    both = sides.groupBy("bout_id").agg(F.min(side).alias("a"), F.max(side).alias("b")).where("a.fighter_id <> b.fighter_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bout_id"), F.to_date("o_orderdate").alias("event_date"), outcome(F.col("o_orderstatus")).alias("outcome"), F.col("o_orderpriority").alias("division"), F.col("o_custkey").alias("event_id"))
    rows = orders.join(both, "bout_id").withColumn("day", day_number("event_date"))
    pairs = F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))
    return rows.select("bout_id", "event_date", "outcome", "division", "event_id", "day", F.inline(pairs))


def round_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds of both sides of a contest (bout_id, fighter_id, round, mine) with the opponent's same round as `theirs`; a round without a number has none.
    Lines are shuffled once, by contest, and sorted once: sums, sides and pairs follow that partitioning and order."""
    lines = rounds(spark, sf_dir).where("fighter_id is not null").select("bout_id", "fighter_id", "round", "attempted")
    contest = Window.partitionBy("bout_id").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = dealt(spark, sf_dir, lines).groupBy("bout_id", "fighter_id", "round").agg(F.sum("attempted").alias("mine"))
    sides = sides.withColumns({"a": F.min("fighter_id").over(contest), "b": F.max("fighter_id").over(contest)}).where("a <> b and fighter_id in (a, b)")
    of = lambda side: F.max(F.when(F.col("fighter_id") == F.col(side), F.col("mine"))).over(Window.partitionBy("bout_id", "round"))
    theirs = F.when(F.col("fighter_id") == F.col("a"), of("b")).otherwise(of("a"))
    return sides.select("bout_id", "fighter_id", "round", "mine", F.when(F.col("round").isNotNull(), theirs).alias("theirs"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each side of a contest; totals are null where any round's value is."""
    from ..operators.metrics import all_or_null

    totals = [F.count("*").alias("rounds"), F.sum("attempted").alias("attempted"), all_or_null("landed").alias("landed"), all_or_null("seconds").alias("seconds")]
    rows = paired(spark, sf_dir, rounds(spark, sf_dir), totals)
    return rows.select("bout_id", "own.fighter_id", "own.rounds", "own.attempted", "own.landed", "own.seconds", "event_date", "outcome", "division", "event_id", "day", F.col("other.fighter_id").alias("opponent_id"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of every contest with a full set of statistics from its lines, and the opponent's as o_...: what operators.features reads."""
    from ..operators.metrics import all_or_null

    landed = F.when(F.col("l_returnflag") != "R", F.floor(F.col("l_quantity") * (1 - F.col("l_discount"))))
    # the lines go as they are; the statistics are made where they are added up, as a row of them is more than twice as wide
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bout_id"), F.col("l_suppkey").alias("fighter_id"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"), landed.alias("landed"), (F.col("l_linestatus") == "F").alias("final"))
    q, p, control = F.col("q"), F.col("p"), F.when(F.col("final"), F.col("p") % 90)
    part = lambda k: F.floor(q / k)
    made = {"sig_attempted": (q, q), "sig_landed": (F.col("landed"), F.col("landed")), "control_seconds": (control, control)}
    made |= {n: (x, p) for n, x in {"kd": (p % 11 == 0).cast("int"), "td_attempted": p % 7, "td_landed": F.least(p % 7, p % 5), "sub_attempts": p % 3}.items()}
    made |= {n: (x, q) for n, x in {"clinch_attempted": part(5), "ground_attempted": part(4), "body_attempted": part(3), "leg_attempted": part(6), "distance_attempted": q - part(5) - part(4), "head_attempted": q - part(3) - part(6)}.items()}
    stats = list(made)
    rows = paired(spark, sf_dir, line, [all_or_null(x.cast("double"), given).alias(n) for n, (x, given) in made.items()])
    key, first = F.col("bout_id"), F.col("own.fighter_id") < F.col("other.fighter_id")
    points = F.when(F.col("outcome") == "draw", 0.5).when(F.col("outcome") == "win", ((key % 2 == 0) == first).cast("double"))
    method = F.element_at(F.array(*map(F.lit, ("ko_tko", "submission", "decision_unanimous", "decision_split", "other"))), (key % 5 + 1).cast("int"))
    return rows.select("bout_id", "own.fighter_id", F.col("other.fighter_id").alias("opponent_id"), "day", "event_date", "event_id", "outcome", points.alias("points"), F.when(key % 4 != 0, (key % 4) * 300.0).alias("elapsed"), method.alias("method"), *[F.col(f"own.{c}") for c in stats], *[F.col(f"other.{c}").alias(f"o_{c}") for c in stats])


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """birth_day and reach_cm of participants, each missing for some."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("fighter_id"), F.when(k % 4 != 0, (k % 300 * 30 - 4000).cast("int")).alias("birth_day"), F.when(k % 5 != 0, (F.lit(150) + k % 60).cast("double")).alias("reach_cm"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("quote_id"), F.col("user_id").alias("book"), F.col("event_type").alias("side"), F.col("value").alias("price"), F.col("ts"), F.get_json_object("props", "$.k").cast("long").alias("receipt"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability for each labelled document, from its length; the label is the outcome."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = (F.col("n_chars") % 1000) / 1000
    return l.join(d.select("doc_id", "n_chars", "source", "lang"), "doc_id").select("doc_id", "source", "lang", p.alias("p"), F.col("quality").cast("int").alias("y"))


ROUNDS = """rounds AS (SELECT l_orderkey AS bout_id, l_suppkey AS fighter_id, l_linenumber AS round, l_quantity AS attempted,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity * (1 - l_discount) END AS landed,
    CAST(nullif(l_linenumber % 4, 0) * 60 AS DOUBLE) AS seconds FROM lineitem)"""
CONTESTS = ROUNDS + """,
sides AS (SELECT bout_id, min(fighter_id) AS a, max(fighter_id) AS b FROM rounds GROUP BY bout_id HAVING min(fighter_id) <> max(fighter_id)),
contests AS (SELECT o_orderkey AS bout_id, CAST(o_orderdate AS DATE) AS event_date,
    CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'draw' ELSE 'no_contest' END AS outcome, o_orderpriority AS division,
    o_custkey AS event_id, a, b, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day
    FROM orders JOIN sides ON o_orderkey = bout_id)"""
FACTS = CONTESTS + """,
totals AS (SELECT bout_id, fighter_id, count(*) AS rounds, sum(attempted) AS attempted,
    CASE WHEN count(landed) = count(*) THEN sum(landed) END AS landed,
    CASE WHEN count(seconds) = count(*) THEN sum(seconds) END AS seconds FROM rounds GROUP BY ALL),
facts AS (SELECT bout_id, fighter_id, rounds, attempted, landed, seconds, event_date, outcome, division, event_id, day,
    CASE WHEN fighter_id = a THEN b ELSE a END AS opponent_id FROM totals JOIN contests USING (bout_id) WHERE fighter_id IN (a, b))"""
STATS = ("sig_attempted", "sig_landed", "control_seconds", "kd", "td_attempted", "td_landed", "sub_attempts", "clinch_attempted", "ground_attempted", "body_attempted", "leg_attempted", "distance_attempted", "head_attempted")
RECORDS = CONTESTS + f""",
lines AS (SELECT l_orderkey AS bout_id, l_suppkey AS fighter_id, l_quantity AS q, l_partkey AS p, CASE WHEN l_returnflag <> 'R' THEN floor(l_quantity * (1 - l_discount)) END AS landed, l_linestatus AS s FROM lineitem),
stats AS (SELECT bout_id, fighter_id, sum(q)::DOUBLE AS sig_attempted, CASE WHEN count(landed) = count(*) THEN sum(landed) END::DOUBLE AS sig_landed,
    CASE WHEN count(*) FILTER (WHERE s = 'F') = count(*) THEN sum(p % 90) END::DOUBLE AS control_seconds, count(*) FILTER (WHERE p % 11 = 0)::DOUBLE AS kd, sum(p % 7)::DOUBLE AS td_attempted,
    sum(least(p % 7, p % 5))::DOUBLE AS td_landed, sum(p % 3)::DOUBLE AS sub_attempts, sum(floor(q / 5))::DOUBLE AS clinch_attempted, sum(floor(q / 4))::DOUBLE AS ground_attempted, sum(floor(q / 3))::DOUBLE AS body_attempted,
    sum(floor(q / 6))::DOUBLE AS leg_attempted, sum(q - floor(q / 5) - floor(q / 4))::DOUBLE AS distance_attempted, sum(q - floor(q / 3) - floor(q / 6))::DOUBLE AS head_attempted FROM lines GROUP BY ALL),
records AS (SELECT c.bout_id, x.fighter_id, y.fighter_id AS opponent_id, day, event_date, event_id, outcome,
    CASE outcome WHEN 'draw' THEN 0.5 WHEN 'win' THEN CASE WHEN (c.bout_id % 2 = 0) = (x.fighter_id < y.fighter_id) THEN 1.0 ELSE 0.0 END END::DOUBLE AS points,
    CASE WHEN c.bout_id % 4 <> 0 THEN (c.bout_id % 4) * 300.0 END::DOUBLE AS elapsed, ['ko_tko', 'submission', 'decision_unanimous', 'decision_split', 'other'][c.bout_id % 5 + 1] AS method,
    {", ".join(f"x.{c}, y.{c} AS o_{c}" for c in STATS)}
    FROM contests c JOIN stats x ON x.bout_id = c.bout_id AND x.fighter_id IN (a, b) JOIN stats y ON y.bout_id = c.bout_id AND y.fighter_id IN (a, b) AND y.fighter_id <> x.fighter_id)"""
PEOPLE = """people AS (SELECT s_suppkey AS fighter_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 300 * 30 - 4000 END AS birth_day, CASE WHEN s_suppkey % 5 <> 0 THEN 150 + s_suppkey % 60 END::DOUBLE AS reach_cm FROM supplier)"""
QUOTES = """quotes AS (SELECT event_id AS quote_id, user_id AS book, event_type AS side, value AS price, ts,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS receipt FROM events)"""
FORECASTS = """forecasts AS (SELECT doc_id, source, lang, (n_chars % 1000) / 1000 AS p, CAST(quality AS INTEGER) AS y FROM labels JOIN documents USING (doc_id))"""
