"""Relational core: coverage, quality, opponents, set operations, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import joins, metrics
from .domain import CONTESTS, FACTS, ROUNDS, contests, facts, paired, rounds, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x, name=None):
    out = F.round(x, 6) + F.lit(0.0)
    return out.alias(name) if name else out


@query("""SELECT c_mktsegment AS card, n_name, count(*) AS n, count(DISTINCT o_custkey) AS events, min(CAST(o_orderdate AS DATE)) AS first_date,
    max(CAST(o_orderdate AS DATE)) AS last_date, count(*) FILTER (WHERE o_orderstatus = 'F') AS wins, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def card_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and date ranges by card, over broadcast dimensions where they are small."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("c_mktsegment").alias("card"), "n_name").agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("events"), F.min(F.to_date("o_orderdate")).alias("first_date"), F.max(F.to_date("o_orderdate")).alias("last_date"),
        F.count_if(F.col("o_orderstatus") == "F").alias("wins"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )


@query(f"""WITH {FACTS} SELECT fighter_id, count(*) AS bouts, count(landed) AS with_landed, count(seconds) AS with_seconds,
    count(*) FILTER (WHERE outcome = 'no_contest') AS no_contests, min(event_date) AS first_date, max(event_date) AS last_date FROM facts GROUP BY fighter_id""")
def entity_coverage(spark, sf_dir):
    """A4."""
    return facts(spark, sf_dir).groupBy("fighter_id").agg(F.count("*").alias("bouts"), F.count("landed").alias("with_landed"), F.count("seconds").alias("with_seconds"), F.count_if(F.col("outcome") == "no_contest").alias("no_contests"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


GAPS = f"""WITH {FACTS}, gaps AS (SELECT 'fact' AS kind, 'landed' AS field, 'missing_round' AS reason FROM facts WHERE landed IS NULL
    UNION ALL SELECT 'fact', 'seconds', 'unknown_duration' FROM facts WHERE seconds IS NULL
    UNION ALL SELECT 'contest', 'sides', 'one_side' FROM (SELECT bout_id FROM rounds GROUP BY bout_id HAVING min(fighter_id) = max(fighter_id)))"""


@query(GAPS + " SELECT kind, field, reason, count(*) AS n FROM gaps GROUP BY ALL ORDER BY n DESC, kind, field")
def gap_histogram(spark, sf_dir):
    """Gaps of three kinds, counted and ordered; each branch is counted before the union moves anything."""
    f = facts(spark, sf_dir)
    one = rounds(spark, sf_dir).groupBy("bout_id").agg(F.min("fighter_id").alias("a"), F.max("fighter_id").alias("b")).where("a = b")
    parts = [("fact", "landed", "missing_round", f.where("landed is null")), ("fact", "seconds", "unknown_duration", f.where("seconds is null")), ("contest", "sides", "one_side", one)]
    rows = [d.select(F.lit(k).alias("kind"), F.lit(c).alias("field"), F.lit(r).alias("reason")) for k, c, r, d in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("kind", "field", "reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "field")


@query(f"""WITH {ROUNDS} SELECT bout_id, fighter_id, count(*) AS rounds, sum(attempted) AS attempted, round(CASE WHEN count(landed) = count(*) THEN sum(landed) END, 6) + 0.0 AS landed,
    CASE WHEN count(seconds) = count(*) THEN sum(seconds) END AS seconds FROM rounds GROUP BY ALL""")
def all_or_null_total(spark, sf_dir):
    """A total is null if any component is."""
    return rounds(spark, sf_dir).groupBy("bout_id", "fighter_id").agg(F.count("*").alias("rounds"), F.sum("attempted").alias("attempted"), r6(metrics.all_or_null("landed"), "landed"), metrics.all_or_null("seconds").alias("seconds"))


@query(f"""WITH {FACTS} SELECT f.bout_id, f.fighter_id, f.opponent_id, f.attempted, o.attempted AS opponent_attempted, round(f.landed, 6) + 0.0 AS landed, round(o.landed, 6) + 0.0 AS opponent_landed,
    round(60.0 * f.attempted / nullif(f.seconds, 0), 6) + 0.0 AS attempted_per_minute FROM facts f JOIN facts o ON f.bout_id = o.bout_id AND o.fighter_id = f.opponent_id""")
def opponent_history(spark, sf_dir):
    """Each side with the other side's totals. Both sides of a contest meet in one group, so the
    self-join needs no second scan."""
    totals = [F.sum("attempted").alias("attempted"), metrics.all_or_null("landed").alias("landed"), metrics.all_or_null("seconds").alias("seconds")]
    f = paired(spark, sf_dir, rounds(spark, sf_dir), totals)
    return f.select("bout_id", "own.fighter_id", F.col("other.fighter_id").alias("opponent_id"), "own.attempted", F.col("other.attempted").alias("opponent_attempted"), r6("own.landed", "landed"), r6("other.landed", "opponent_landed"), r6(60.0 * F.col("own.attempted") / F.nullif("own.seconds", F.lit(0)), "attempted_per_minute"))


@query(f"""WITH {FACTS} SELECT fighter_id, count(*) FILTER (WHERE outcome = 'win' AND fighter_id < opponent_id) AS wins, count(*) FILTER (WHERE outcome = 'win' AND fighter_id > opponent_id) AS losses,
    count(*) FILTER (WHERE outcome = 'draw') AS draws, count(*) FILTER (WHERE outcome = 'no_contest') AS no_contests FROM facts GROUP BY fighter_id""")
def record_pivot(spark, sf_dir):
    """Results from each side's point of view, as columns."""
    result = F.when(F.col("outcome") != "win", F.col("outcome")).when(F.col("fighter_id") < F.col("opponent_id"), "won").otherwise("lost")
    is_ = lambda x: F.count_if(F.col("result") == x)
    return facts(spark, sf_dir).withColumn("result", result).groupBy("fighter_id").agg(is_("won").alias("wins"), is_("lost").alias("losses"), is_("draw").alias("draws"), is_("no_contest").alias("no_contests"))


@query(f"""WITH {FACTS} SELECT field, CAST(missing AS BIGINT) AS missing FROM (SELECT count(*) FILTER (WHERE landed IS NULL) AS landed, count(*) FILTER (WHERE seconds IS NULL) AS seconds,
    count(*) FILTER (WHERE attempted IS NULL) AS attempted FROM facts) UNPIVOT (missing FOR field IN (landed, seconds, attempted))""")
def missing_fields(spark, sf_dir):
    """Nulls of each field, in one pass."""
    return facts(spark, sf_dir).agg(metrics.missing(["landed", "seconds", "attempted"]).alias("m")).select(F.inline("m"))


@query("SELECT year(o_orderdate) AS year, count(*) AS n, count(DISTINCT CAST(o_orderdate AS DATE)) AS dates, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 1")
def annual_rollup(spark, sf_dir):
    """A29."""
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"), F.countDistinct(F.to_date("o_orderdate")).alias("dates"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy("year")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark, sf_dir):
    """Contests without any round."""
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    """Customers with an expensive order; the filter reaches the scan."""
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(rich, "c_custkey", "left_semi")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 7 <> 0 AND NOT EXISTS
    (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5) """)
def fk_orphans(spark, sf_dir):
    """Keys that are given and have no parent (null keys are no orphans)."""
    child = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey")).alias("l_partkey"))
    return joins.orphans(child, table(spark, sf_dir, "part").where("p_size > 5"), ["l_partkey"], ["p_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'none' ELSE o_orderstatus END AS status
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000""")
def left_join_predicates(spark, sf_dir):
    """Conditions of the outer side stay in the join."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 100000").select("o_custkey", "o_orderkey", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey", F.when(F.col("o_orderkey").isNull(), "none").otherwise(F.col("o_orderstatus")).alias("status"))


@query("""WITH l AS (SELECT c_custkey, 'Part ' || (c_custkey % 300) AS k FROM customer), r AS (SELECT s_suppkey, 'Part ' || (s_suppkey % 400) AS k FROM supplier),
    nl AS (SELECT k, count(*) AS n FROM l GROUP BY k), nr AS (SELECT k, count(*) AS m, min(s_suppkey) AS id FROM r GROUP BY k)
    SELECT c_custkey, CASE WHEN n = 1 AND m = 1 THEN id END AS matched_id, CASE WHEN m IS NULL THEN 'absent' WHEN n > 1 OR m > 1 THEN 'ambiguous' END AS hold
    FROM l JOIN nl USING (k) LEFT JOIN nr USING (k)""")
def unique_match_hold(spark, sf_dir):
    """Matches only where the key is unique on both sides; the rest is held with a reason."""
    left = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Part "), F.col("c_custkey") % 300).alias("k"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Part "), F.col("s_suppkey") % 400).alias("k"))
    return joins.unique_match(left, right, ["k"], "s_suppkey").select("c_custkey", "matched_id", "hold")


@query(f"""WITH {CONTESTS} SELECT least(a, b) AS low, greatest(a, b) AS high, event_date, count(*) AS n, min(bout_id) AS first_bout FROM contests GROUP BY ALL""")
def unordered_pair(spark, sf_dir):
    """Contests by date and unordered pair."""
    return contests(spark, sf_dir).select("bout_id", "event_date", *joins.pair("a", "b")).groupBy("low", "high", "event_date").agg(F.count("*").alias("n"), F.min("bout_id").alias("first_bout"))


@query(f"""WITH {CONTESTS}, x AS (SELECT bout_id, event_id, a, b FROM contests), s AS (SELECT event_id, bout_id, unnest([a, b]) AS who FROM x)
    SELECT l.event_id, l.bout_id, r.bout_id AS other, min(l.who) AS who FROM s l JOIN s r ON l.event_id = r.event_id AND l.who = r.who AND l.bout_id < r.bout_id GROUP BY ALL HAVING count(*) = 1""")
def substitution_pairs(spark, sf_dir):
    """Contests of one event that share exactly one side."""
    return joins.share_one(contests(spark, sf_dir).select("event_id", "bout_id", "a", "b"), "event_id", "a", "b", "bout_id")


@query(f"""WITH {CONTESTS} SELECT c.bout_id, d.bout_id AS near_id, c.day - d.day AS days FROM contests c JOIN contests d ON c.a = d.a AND c.b = d.b AND abs(c.day - d.day) <= 30 AND c.bout_id <> d.bout_id""")
def date_band_join(spark, sf_dir):
    """The same pair within 30 days."""
    c = contests(spark, sf_dir).select("bout_id", "a", "b", "day")
    d = c.select(F.col("bout_id").alias("near_id"), "a", "b", F.col("day").alias("near_day"))
    return joins.band_join(c, d, ["a", "b"], "day", "near_day", 30).where("bout_id <> near_id").select("bout_id", "near_id", (F.col("day") - F.col("near_day")).alias("days"))


@query("""WITH s(name, lo, hi) AS (VALUES ('early', DATE '1900-01-01', DATE '1994-12-31'), ('middle', DATE '1995-01-01', DATE '1996-12-31'), ('late', DATE '1997-01-01', DATE '2100-01-01'))
    SELECT name, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS accepted, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS share
    FROM s JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN lo AND hi GROUP BY name""")
def point_in_interval(spark, sf_dir):
    """Dates fall into fixed intervals (three rows, broadcast)."""
    s = spark.createDataFrame([("early", "1900-01-01", "1994-12-31"), ("middle", "1995-01-01", "1996-12-31"), ("late", "1997-01-01", "2100-01-01")], "name string, lo string, hi string").select("name", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), "o_orderstatus")
    return o.join(F.broadcast(s), (F.col("d") >= F.col("lo")) & (F.col("d") <= F.col("hi"))).groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("accepted")).withColumn("share", F.round(F.col("accepted") / F.col("n"), 6))


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'unlinked' WHEN b.k IS NULL THEN 'unreported' WHEN a.n <> b.n THEN 'changed' ELSE 'equal' END AS reason FROM a FULL JOIN b ON a.k = b.k""")
def reconciliation(spark, sf_dir):
    """Two views of the same contests with holds on both sides."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate")
    early, late = F.count_if(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp")), F.count_if(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp"))
    both = line.groupBy("k").agg(early.alias("a"), late.alias("b")).where("a > 0 or b > 0")
    return both.select("k", F.when(F.col("a") == 0, "unlinked").when(F.col("b") == 0, "unreported").when(F.col("a") != F.col("b"), "changed").otherwise("equal").alias("reason"))


@query(f"""WITH {CONTESTS} SELECT who AS fighter_id, count(*) AS contests FROM (SELECT a AS who, bout_id FROM contests UNION SELECT b, bout_id FROM contests) GROUP BY who""")
def union_distinct(spark, sf_dir):
    """Participants on either side."""
    return contests(spark, sf_dir).select("bout_id", F.explode(F.array("a", "b")).alias("fighter_id")).distinct().groupBy("fighter_id").agg(F.count("*").alias("contests"))


@query("SELECT DISTINCT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_difference(spark, sf_dir):
    """U3."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) > 1 AS conflict FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_conflicts(spark, sf_dir):
    """Repeated keys, and whether their rows differ."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), (F.countDistinct("l_partkey", "l_suppkey", "l_quantity") > 1).alias("conflict")).where("n > 1")


@query("""SELECT l_orderkey, l_suppkey, list_sort(list(DISTINCT l_linenumber)) = range(1, max(l_linenumber) + 1) AS complete FROM lineitem GROUP BY ALL""")
def consecutive_rounds(spark, sf_dir):
    """Rounds 1 to n, none missing. Distinct count, least and greatest say it without a list."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(((F.min("l_linenumber") == 1) & (F.countDistinct("l_linenumber") == F.max("l_linenumber"))).alias("complete"))


@query("SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS d FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def top_k(spark, sf_dir):
    """O2: a top-k report; each task keeps twelve rows."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("d")).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12)


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS least FROM orders GROUP BY 1""")
def arg_extremes(spark, sf_dir):
    """Arg-max and arg-min with declared ties, aggregated on the map side."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("least"))


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), lower('Brand#1')) AND p_size BETWEEN 5 AND 20 AND (p_retailprice > 1000 OR p_type LIKE 'STANDARD%')""")
def facet_search(spark, sf_dir):
    """Free text over several columns, with facets."""
    p = table(spark, sf_dir, "part")
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return p.where(text.contains("brand#1") & F.col("p_size").between(5, 20) & ((F.col("p_retailprice") > 1000) | F.col("p_type").startswith("STANDARD"))).select("p_partkey", "p_name")


@query("""SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS with_lines,
    CASE WHEN (SELECT count(*) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) THEN 'PASS' ELSE 'FAIL' END AS status""")
def reconciliation_checks(spark, sf_dir):
    """One-row frames side by side."""
    o = table(spark, sf_dir, "orders").agg(F.count("*").alias("orders"))
    line = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("lines"), F.countDistinct("l_orderkey").alias("with_lines"))
    return o.join(line, how="cross").withColumn("status", F.when(F.col("orders") == F.col("with_lines"), "PASS").otherwise("FAIL"))


@query("""SELECT o_custkey, count(*) AS n, CAST(sum(ok) AS BIGINT) AS agree, max(CAST(o_orderdate AS DATE)) AS last_date FROM (SELECT *, CASE WHEN o_orderstatus IS NOT DISTINCT FROM nullif(o_orderstatus, 'P') THEN 1 ELSE 0 END AS ok FROM orders) GROUP BY 1""")
def null_safe_compare(spark, sf_dir):
    """P8, P9."""
    same = F.col("o_orderstatus").eqNullSafe(F.nullif("o_orderstatus", F.lit("P")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), F.max(F.to_date("o_orderdate")).alias("last_date"))


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey - 1 END AS parent FROM customer),
    w AS (SELECT id, parent FROM l WHERE parent IS NOT NULL UNION ALL SELECT w.id, l.parent FROM w JOIN l ON w.parent = l.id WHERE l.parent IS NOT NULL)
    SELECT id, min(parent) AS target FROM w GROUP BY id""")
def alias_chains(spark, sf_dir):
    """Redirects followed to their end by pointer doubling."""
    links = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - 1).alias("parent"))
    return joins.resolved(links, "id", "parent")


@query("""SELECT o_orderkey, sha256(o_orderkey::VARCHAR) AS digest, CASE WHEN ('0x' || right(sha256(o_orderkey::VARCHAR), 1))::INTEGER % 2 = 1 THEN -1 ELSE 1 END AS sign FROM orders""")
def hash_orientation(spark, sf_dir):
    """The low bit of a digest decides the orientation."""
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return table(spark, sf_dir, "orders").select("o_orderkey", digest.alias("digest"), scalar.hash_sign(F.col("o_orderkey").cast("string")).alias("sign"))


@query("""SELECT s.s_suppkey, p.n_name AS a_nation, r.r_name AS region FROM supplier s JOIN nation p ON s.s_nationkey = p.n_nationkey JOIN region r ON p.n_regionkey = r.r_regionkey WHERE r.r_name IN ('ASIA', 'EUROPE')""")
def role_playing(spark, sf_dir):
    """Dimensions joined under aliases."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r.where(F.col("r_name").isin("ASIA", "EUROPE")), n.n_regionkey == F.col("r_regionkey")).select("s_suppkey", F.col("n_name").alias("a_nation"), F.col("r_name").alias("region"))


@query("""SELECT o_orderkey, coalesce(c_name, 'customer ' || o_custkey) AS who FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def tiered_identity(spark, sf_dir):
    """An external id where there is one, else a native one."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("customer "), F.col("o_custkey"))).alias("who"))


@query(f"""WITH {CONTESTS}, x AS (SELECT who, bout_id, day, division FROM (SELECT a AS who, * FROM contests UNION ALL SELECT b, * FROM contests))
    SELECT l.who, l.bout_id, r.bout_id AS other FROM x l JOIN x r ON l.who = r.who AND r.day - l.day BETWEEN 0 AND 20 AND l.division <> r.division AND l.bout_id <> r.bout_id""")
def near_other_division(spark, sf_dir):
    """Pairs of contests of a participant in different divisions within 20 days, as its SQL says; W13 is next_other_division."""
    x = contests(spark, sf_dir).select("bout_id", "day", "division", F.explode(F.array("a", "b")).alias("who"))
    y = x.select("who", F.col("bout_id").alias("other"), F.col("day").alias("other_day"), F.col("division").alias("other_division"))
    return joins.band_join(x, y, ["who"], "day", "other_day", 20).where("other_day >= day and division <> other_division and bout_id <> other").select("who", "bout_id", "other")


@query(f"""WITH {CONTESTS}, x AS (SELECT who, bout_id, day, division FROM (SELECT a AS who, * FROM contests UNION ALL SELECT b, * FROM contests)),
    p AS (SELECT l.who, l.bout_id, r.bout_id AS other, row_number() OVER (PARTITION BY l.who, l.bout_id ORDER BY r.day, r.bout_id) AS k FROM x l JOIN x r ON l.who = r.who AND r.day - l.day BETWEEN 0 AND 366 AND (r.day > l.day OR r.bout_id > l.bout_id) AND l.division <> r.division WHERE l.division <> '' AND r.division <> '')
    SELECT who, bout_id, other FROM p WHERE k = 1""")
def next_other_division(spark, sf_dir):
    """The first later contest of a participant in another division, within 366 days."""
    return other_divisions(contests(spark, sf_dir).select("bout_id", "day", "division", F.explode(F.array("a", "b")).alias("who")))


def other_divisions(x: DataFrame, days: int = 366) -> DataFrame:
    """For each (who, day, bout_id) the first contest after it with another division: it is the head of the next run of one
    division, which a window that goes backward carries along. Contests without a division don't count."""
    back = Window.partitionBy("who").orderBy(F.desc("day"), F.desc("bout_id"))
    head = F.when(F.lead("division").over(back) != F.col("division"), F.struct("day", "bout_id"))
    runs = x.where("division <> ''").withColumn("head", head)
    runs = runs.withColumn("next", F.last("head", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    return runs.where(F.col("next.day") - F.col("day") <= days).select("who", "bout_id", F.col("next.bout_id").alias("other"))


NESTED = """SELECT o_custkey, list_sort(list(o_orderkey)) AS bouts, count(*) AS n FROM orders GROUP BY 1"""


@query(NESTED)
def nested_groups(spark, sf_dir, since=None):
    """Contests nested in their event; `since`, where given, keeps those from a date on."""
    o = table(spark, sf_dir, "orders")
    return (o if since is None else o.where(F.col("o_orderdate") >= F.lit(since))).groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("bouts"), F.count("*").alias("n"))


@query(NESTED)
def nested_groups_all(spark, sf_dir):
    """The same as nested_groups, which once had a cutoff."""
    return nested_groups(spark, sf_dir)


@query("""SELECT p_name, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS brand, count(*) AS n FROM part GROUP BY 1""")
def one_value_or_none(spark, sf_dir):
    """The value all rows agree on, else null."""
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.when(F.min("p_brand") == F.max("p_brand"), F.min("p_brand")).alias("brand"), F.count("*").alias("n"))


@query("""SELECT (SELECT sum(CAST(('0x' || left(md5(o_orderkey || ':' || o_orderstatus), 8)) AS BIGINT)) FROM orders)::BIGINT AS fingerprint, (SELECT count(*) FROM orders) AS n""")
def table_fingerprint(spark, sf_dir):
    """A fingerprint that does not depend on the order of rows, so that it needs no sort."""
    part = F.conv(F.left(F.md5(F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus")), F.lit(8)), 16, 10).cast("long")
    return table(spark, sf_dir, "orders").agg(F.sum(part).alias("fingerprint"), F.count("*").alias("n"))
