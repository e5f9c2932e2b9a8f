"""Evidence: reviews, receipts, audits, upserts, rankings, views and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import evaluate, store
from .domain import CONTESTS, FACTS, FORECASTS, QUOTES, ROUNDS, contests, facts, forecasts, quotes, round_pairs, rounds, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {CONTESTS}, q AS (SELECT o_orderkey AS quote_id, o_custkey AS event_id, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS u, arg_max(l_suppkey, (l_linenumber, l_suppkey)) AS v, least(u, v) AS x, greatest(u, v) AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    c AS (SELECT event_id, bout_id, a, b FROM contests), j AS (SELECT quote_id, bout_id, CASE WHEN a = x AND b = y THEN 0 WHEN (a IN (x, y)) <> (b IN (x, y)) THEN 1 END AS tier FROM q JOIN c USING (event_id))
    SELECT quote_id, CASE WHEN count(*) FILTER (WHERE tier = 0) = 1 THEN 'exact' WHEN count(*) FILTER (WHERE tier = 0) > 1 THEN 'ambiguous' WHEN count(*) FILTER (WHERE tier = 1) > 0 THEN 'review' ELSE 'absent' END AS result FROM j GROUP BY quote_id""")
def tiered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote names the sides of its order's first and last line; an exact pair of the event matches, one that shares exactly one side
    is for review. Pairs and sides of an event are counted before joining, so no quote meets all contests of its event."""
    line, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    q = line.groupBy(F.col("l_orderkey").alias("quote_id")).agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("u"), F.max_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("v"))
    q = q.select("quote_id", F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).join(o.select(F.col("o_orderkey").alias("quote_id"), F.col("o_custkey").alias("event_id")), "quote_id")
    c = contests(spark, sf_dir).select("event_id", "a", "b")
    pairs = c.groupBy("event_id", F.col("a").alias("x"), F.col("b").alias("y")).agg(F.count("*").alias("e"))
    sides = c.select("event_id", F.explode(F.array("a", "b")).alias("who")).groupBy("event_id", "who").agg(F.count("*").alias("n"))
    of = lambda s: sides.withColumnRenamed("who", s).withColumnRenamed("n", f"n_{s}")
    got = q.join(c.select("event_id").distinct(), "event_id", "left_semi").join(pairs, ["event_id", "x", "y"], "left").join(of("x"), ["event_id", "x"], "left").join(of("y"), ["event_id", "y"], "left")
    e, n = F.coalesce("e", F.lit(0)), lambda s: F.coalesce(f"n_{s}", F.lit(0))
    half = F.when(F.col("x") == F.col("y"), n("x")).otherwise(n("x") + n("y") - 2 * e)
    return got.select("quote_id", F.when(e == 1, "exact").when(e > 1, "ambiguous").when(half > 0, "review").otherwise("absent").alias("result"))


@query(f"""WITH {QUOTES} SELECT quote_id FROM quotes q WHERE EXISTS (SELECT 1 FROM quotes r WHERE r.book = q.book AND r.receipt = q.receipt AND r.side <> q.side)""")
def receipt_links(spark, sf_dir):
    """Quotes whose receipt holds another side; counted per receipt, so no quote meets another."""
    sides = quotes(spark, sf_dir).groupBy("book", "receipt").agg(F.countDistinct("side").alias("n")).where("n > 1")
    return quotes(spark, sf_dir).join(sides, ["book", "receipt"], "left_semi").select("quote_id")


@query("""WITH r AS (SELECT o_custkey AS page, o_orderkey AS run, o_totalprice AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders), n AS (SELECT c_custkey AS page, c_acctbal FROM customer)
    SELECT page, run, coalesce(total > c_acctbal, false) AS agrees, bool_and(coalesce(total > c_acctbal, false)) OVER () AS section_ok FROM n JOIN r USING (page) WHERE k = 1""")
def latest_receipt_check(spark, sf_dir):
    """The latest receipt of each page against its count; one mismatch closes the section."""
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.max("o_orderkey").alias("run"), F.max_by("o_totalprice", "o_orderkey").alias("total"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), "c_acctbal").join(r, "page").select("page", "run", F.coalesce(F.col("total") > F.col("c_acctbal"), F.lit(False)).alias("agrees"))
    return rows.join(F.broadcast(rows.agg(F.bool_and("agrees").alias("section_ok"))), how="cross")


@query("""WITH r AS (SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part)
    SELECT kind, count(*) AS n, count(DISTINCT sha256(name)) AS digests FROM r GROUP BY kind""")
def receipt_histogram(spark, sf_dir):
    """Receipts of three kinds, counted by source."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.sha2(F.col(c), 256).alias("d")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("d").alias("digests"))


@query("""WITH t AS (SELECT s_nationkey AS division, s_suppkey AS id, CAST(floor(s_acctbal / 1000) AS BIGINT) AS points FROM supplier), r AS (SELECT *, rank() OVER (PARTITION BY division ORDER BY points DESC) AS place, count(*) OVER (PARTITION BY division, points) AS tie FROM t)
    SELECT division, id, place, tie > 1 AS tied, CASE WHEN tie > 1 THEN place + tie - 1 END AS last_slot FROM r""")
def competition_ranking(spark, sf_dir):
    """Places with ties, which skip the slots they share."""
    t = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("division"), F.col("s_suppkey").alias("id"), F.floor(F.col("s_acctbal") / 1000).alias("points"))
    place = F.rank().over(Window.partitionBy("division").orderBy(F.desc("points"))).cast("long")
    tie = F.count("*").over(Window.partitionBy("division", "points"))
    return t.select("division", "id", place.alias("place"), tie.alias("tie")).select("division", "id", "place", (F.col("tie") > 1).alias("tied"), F.when(F.col("tie") > 1, F.col("place") + F.col("tie") - 1).alias("last_slot"))


@query("""WITH have AS (SELECT DISTINCT s_nationkey AS division, CAST(floor(s_acctbal / 1000) AS BIGINT) AS slot FROM supplier) SELECT CAST(n_nationkey AS INTEGER) AS division, CAST(range AS BIGINT) AS slot FROM nation, range(0, 10) WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.division = n_nationkey AND have.slot = range)""")
def missing_slots(spark, sf_dir):
    """Slots that a division lacks; the slots are a fixed sequence."""
    have = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("division"), F.floor(F.col("s_acctbal") / 1000).alias("slot")).distinct()
    every = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("division"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("slot"))
    return every.join(have, ["division", "slot"], "left_anti")


@query("""SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v, coalesce(n.w, o.w) AS w FROM (SELECT c_custkey AS k, c_name AS v, c_acctbal AS w FROM customer WHERE c_custkey % 3 <> 0) o
    FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS v, c_acctbal + 1 AS w FROM customer WHERE c_custkey % 5 <> 0) n ON o.k = n.k""")
def upsert_rows(spark, sf_dir):
    """K2, K4: new values win unless they are null."""
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey k", "c_name v", "c_acctbal w")
    new = c.where("c_custkey % 5 <> 0").selectExpr("c_custkey k", "case when c_custkey % 2 = 0 then upper(c_name) end v", "c_acctbal + 1 w")
    return store.upsert(old, new, ["k"])


@query("""WITH o AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'other' ELSE c_name END AS v FROM customer WHERE c_custkey % 5 <> 0)
    SELECT 'new' AS kind, n.k FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = n.k) UNION ALL SELECT 'conflict', n.k FROM n JOIN o ON o.k = n.k WHERE o.v <> n.v""")
def insert_with_conflicts(spark, sf_dir):
    """Keys that are new, and keys whose values differ."""
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey k", "c_name v")
    new = c.where("c_custkey % 5 <> 0").selectExpr("c_custkey k", "case when c_custkey % 7 = 0 then 'other' else c_name end v")
    fresh, conflicts = store.insert_new(old, new, ["k"])
    return fresh.select(F.lit("new").alias("kind"), "k").unionByName(conflicts.select(F.lit("conflict").alias("kind"), "k"))


@query("""WITH u AS (SELECT 1 AS source, p_name AS key, p_partkey AS id FROM part WHERE p_size < 25 UNION ALL SELECT 2, p_name, p_partkey FROM part WHERE p_size >= 25), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, id) AS k FROM u)
    SELECT key, id, CASE WHEN k = 1 THEN 'kept' ELSE 'review' END AS status FROM r""")
def cross_source_dedup(spark, sf_dir):
    """The first occurrence stays, later ones are for review. The first is an aggregate, so a frequent key is no hot sort."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 25, 1).otherwise(2).alias("source"))
    first = p.groupBy("key").agg(F.min(F.struct("source", "id")).alias("first"))
    return p.join(first, "key").select("key", "id", F.when((F.col("first.source") == F.col("source")) & (F.col("first.id") == F.col("id")), "kept").otherwise("review").alias("status"))


@query(f"""WITH {ROUNDS}, issues AS (SELECT 'negative_quantity' AS code FROM rounds WHERE attempted < 0 UNION ALL SELECT 'landed_above_attempted' FROM rounds WHERE landed > attempted UNION ALL SELECT 'missing_duration' FROM rounds WHERE seconds IS NULL
    UNION ALL SELECT 'orphan_customer' FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) UNION ALL SELECT 'no_rounds' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) SELECT code, count(*) AS n FROM issues GROUP BY code""")
def audit(spark, sf_dir):
    """Issues by code. Rules on one table are counted in one pass over it."""
    codes = {"negative_quantity": F.col("attempted") < 0, "landed_above_attempted": F.col("landed") > F.col("attempted"), "missing_duration": F.col("seconds").isNull()}
    own = rounds(spark, sf_dir).agg(F.array(*[F.struct(F.lit(c).alias("code"), F.count_if(x).alias("n")) for c, x in codes.items()]).alias("a")).select(F.inline("a"))
    o = table(spark, sf_dir, "orders")
    lone = o.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").agg(F.lit("orphan_customer").alias("code"), F.count("*").alias("n"))
    bare = o.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").agg(F.lit("no_rounds").alias("code"), F.count("*").alias("n"))
    return own.unionByName(lone).unionByName(bare).where("n > 0")


@query(f"""WITH {FORECASTS} SELECT source, count(*) AS n, round(avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END), 6) AS observed, round(sum(CASE WHEN p >= 0.5 THEN 2.0 ELSE 1.0 END * y) / sum(CASE WHEN p >= 0.5 THEN 2.0 ELSE 1.0 END), 6) AS weighted FROM forecasts GROUP BY source""")
def evidence_coverage(spark, sf_dir):
    """Shares observed, and a weighted mean."""
    w = F.when(F.col("p") >= 0.5, 2.0).otherwise(1.0)
    return forecasts(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") > 0).cast("double")), 6).alias("observed"), F.round(F.sum(w * F.col("y")) / F.sum(w), 6).alias("weighted"))


@query(f"""WITH {FORECASTS}, saved AS (SELECT lang, count(*) + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS n, sum(y)::BIGINT AS ones, count(*) - sum(y)::BIGINT AS zeros, round(avg((p - y) * (p - y)), 9) + CASE WHEN lang = 'fr' THEN 0.01 ELSE 0 END AS brier, min(p) AS low, max(p) AS high FROM forecasts GROUP BY lang),
    again AS (SELECT lang, count(*) AS n, avg((p - y) * (p - y)) AS brier FROM forecasts GROUP BY lang)
    SELECT lang, s.n = ones + zeros AS outcomes_add_up, s.n = a.n AS rows_match, abs(s.brier - a.brier) < 1e-6 AS metrics_match, low >= 0 AND high <= 1 AND low <= high AS in_range FROM saved s JOIN again a USING (lang)""")
def report_invariants(spark, sf_dir):
    """A saved report by cohort against its own rules and against metrics recomputed from the forecasts. Two cohorts of the saved report are wrong."""
    rows, square = forecasts(spark, sf_dir), (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    off = lambda lang, by: F.when(F.col("lang") == lang, by).otherwise(0)
    saved = rows.groupBy("lang").agg((F.count("*")).alias("n"), F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros"), F.round(F.avg(square), 9).alias("brier"), F.min("p").alias("low"), F.max("p").alias("high"))
    return evaluate.report_problems(saved.withColumn("n", F.col("n") + off("de", 1)).withColumn("brier", F.col("brier") + off("fr", 0.01)), rows, "lang")


@query(f"""WITH {FORECASTS}, w AS (SELECT doc_id, 1.5 * (p - 0.5) AS c1, -0.8 * (doc_id % 7 / 7 - 0.4) AS c2, 0.3 * y AS c3 FROM forecasts),
    s AS (SELECT *, round(1 / (1 + exp(-(c1 + c2 + c3))), 6) + CASE WHEN doc_id % 50 = 3 THEN 0.01 ELSE 0 END AS saved FROM w)
    SELECT doc_id, abs(ln(saved / (1 - saved)) - (c1 + c2 + c3)) < 1e-4 AS explained, CASE WHEN abs(c1) >= abs(c2) AND abs(c1) >= abs(c3) THEN 'length' WHEN abs(c2) >= abs(c3) THEN 'key' ELSE 'quality' END AS largest FROM s""")
def explanation_check(spark, sf_dir):
    """Contributions (weight times feature) of a saved probability must add up to its logit; some saved ones are off. Also the largest."""
    rows = forecasts(spark, sf_dir).select("doc_id", (F.col("p") - 0.5).alias("length"), (F.col("doc_id") % 7 / 7 - 0.4).alias("key"), F.col("y").cast("double").alias("quality"))
    weights = {"length": 1.5, "key": -0.8, "quality": 0.3}
    saved = F.round(evaluate.score(weights), 6) + F.when(F.col("doc_id") % 50 == 3, 0.01).otherwise(0.0)
    rows = rows.withColumn("saved", saved).withColumn("top", evaluate.contributions(weights))
    total = F.aggregate("top", F.lit(0.0), lambda s, x: s + x["value"])
    return rows.select("doc_id", (F.abs(F.log(F.col("saved") / (1 - F.col("saved"))) - total) < 1e-4).alias("explained"), F.get("top", F.lit(0)).getField("name").alias("largest"))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'past' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'open' ELSE 'future' END AS phase, list_filter([CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END], lambda x: x IS NOT NULL) AS holds FROM orders""")
def review_queue(spark, sf_dir):
    """A temporal state and every reason that holds."""
    at = lambda s: F.lit(s).cast("timestamp")
    holds = F.array_compact(F.array(F.when(F.col("o_totalprice") > 300000, "large"), F.when(F.col("o_orderstatus") == "P", "pending")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderdate") < at("1995-01-01"), "past").when(F.col("o_orderdate") < at("1998-01-01"), "open").otherwise("future").alias("phase"), holds.alias("holds"))


@query(f"""WITH {CONTESTS}, d AS (SELECT event_date, count(*) AS n FROM contests GROUP BY 1), r AS (SELECT event_date, sum(n) OVER (ORDER BY event_date DESC) AS later, row_number() OVER (ORDER BY event_date DESC) AS k, sum(n) OVER () AS total FROM d)
    SELECT event_date, (later - (SELECT n FROM d WHERE d.event_date = r.event_date) < 0.2 * total OR k <= 2) AS reserved FROM r""")
def live_split(spark, sf_dir):
    """M9: whole dates from the end are reserved until they hold a fifth of the contests, two dates at least."""
    d = contests(spark, sf_dir).groupBy("event_date").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("event_date"))  # a row for each date
    return d.select("event_date", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.row_number().over(w).alias("k"), F.sum("n").over(Window.partitionBy()).alias("total")).select("event_date", ((F.coalesce("before", F.lit(0)) < 0.2 * F.col("total")) | (F.col("k") <= 2)).alias("reserved"))


@query(f"""WITH {CONTESTS}, y AS (SELECT DISTINCT year(event_date) AS year FROM contests) SELECT y.year, count(*) FILTER (WHERE year(c.event_date) < y.year AND year(c.event_date) >= y.year - 3) AS train, count(*) FILTER (WHERE year(c.event_date) = y.year) AS test FROM y, contests c GROUP BY y.year""")
def rolling_folds(spark, sf_dir):
    """Yearly folds with a lookback of three years, from yearly counts."""
    n = contests(spark, sf_dir).groupBy(F.year("event_date").alias("year")).agg(F.count("*").alias("test"))
    w = Window.orderBy("year").rangeBetween(-3, -1)  # a row for each year
    return n.select(F.col("year").cast("long").alias("year"), F.coalesce(F.sum("test").over(w), F.lit(0)).alias("train"), "test")


@query(f"""WITH {FORECASTS}, t AS (SELECT *, (SELECT avg(y) FROM forecasts WHERE doc_id % 5 <> 0) AS base FROM forecasts WHERE doc_id % 5 = 0), s AS (SELECT 'model' AS name, p, p AS model, y FROM t UNION ALL SELECT 'coin', 0.5, p, y FROM t UNION ALL SELECT 'base_rate', base, p, y FROM t)
    SELECT name, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg((model - y) * (model - y) - (p - y) * (p - y)), 6) + 0.0 AS delta FROM s GROUP BY name""")
def baselines(spark, sf_dir):
    """A model beside baselines on held-out rows, with paired differences. The base rate is learned from the other rows."""
    rows = forecasts(spark, sf_dir)
    base = rows.where("doc_id % 5 <> 0").agg(F.avg("y").alias("base_rate"))
    test = rows.where("doc_id % 5 = 0").join(F.broadcast(base), how="cross").withColumn("coin", F.lit(0.5)).withColumn("model", F.col("p"))  # one row
    square = lambda c: (F.col(c) - F.col("y")) * (F.col(c) - F.col("y"))
    names = ("model", "coin", "base_rate")
    one = test.agg(F.count("*").alias("n"), *[F.round(F.avg(square(k)), 6).alias(k) for k in names], *[(F.round(F.avg(square("model") - square(k)), 6) + 0.0).alias(f"delta_{k}") for k in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col("n"), F.col(k).alias("brier"), F.col(f"delta_{k}").alias("delta")) for k in names])))


@query(f"""WITH {FACTS}, m AS (SELECT fighter_id, count(*) AS bouts, avg(attempted) AS attempts, count(landed) AS contributing FROM facts GROUP BY 1)
    SELECT a.fighter_id AS a, b.fighter_id AS b, round(a.attempts, 6) AS attempts_a, round(b.attempts, 6) AS attempts_b, a.bouts - a.contributing AS excluded_a FROM m a JOIN m b ON b.fighter_id = a.fighter_id + 1""")
def card_report(spark, sf_dir):
    """Two participants side by side, with what was left out. The lines are aggregated once: each participant is the `a` of its own id and the `b` of the id before."""
    m = facts(spark, sf_dir).groupBy("fighter_id").agg(F.count("*").alias("bouts"), F.avg("attempted").alias("attempts"), F.count("landed").alias("contributing"))
    key, own, of = F.col("fighter_id"), F.col("own"), lambda side, value: F.max(F.when(side, value))
    places = F.array(F.struct(key.alias("a"), F.lit(True).alias("own")), F.struct((key - 1).alias("a"), F.lit(False).alias("own")))
    m = m.select("fighter_id", F.round("attempts", 6).alias("attempts"), (F.col("bouts") - F.col("contributing")).alias("excluded"), F.inline(places))
    pairs = m.groupBy("a").agg(F.count("*").alias("n"), of(~own, key).alias("b"), of(own, F.col("attempts")).alias("attempts_a"), of(~own, F.col("attempts")).alias("attempts_b"), of(own, F.col("excluded")).alias("excluded_a"))
    return pairs.where("n = 2").drop("n")


PAIRED = f"""WITH {FACTS}, r AS (SELECT bout_id, fighter_id, round, sum(attempted) AS attempted FROM rounds GROUP BY ALL) SELECT x.bout_id, x.fighter_id, x.round, x.attempted AS mine, o.attempted AS theirs FROM facts f
    JOIN r x ON x.bout_id = f.bout_id AND x.fighter_id = f.fighter_id LEFT JOIN r o ON o.bout_id = f.bout_id AND o.fighter_id = f.opponent_id AND o.round = x.round"""


@query(PAIRED)
def paired_rounds(spark, sf_dir):
    """Q14: each round of every participant beside the opponent's same round."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bout_id"))
    return round_pairs(spark, sf_dir).join(orders, "bout_id").select("bout_id", "fighter_id", "round", "mine", "theirs")


@query(PAIRED)
def paired_rounds_all(spark, sf_dir):
    """The same as paired_rounds, which once held one participant."""
    return paired_rounds(spark, sf_dir)


@query("""SELECT (SELECT count(*) FROM orders) AS contests, (SELECT count(*) FROM events) AS quotes, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS last_contest, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS flagged""")
def overview(spark, sf_dir):
    """Q16, Q19: one row of figures from several sections, each an aggregate of its own."""
    parts = [
        table(spark, sf_dir, "orders").agg(F.count("*").alias("contests"), F.max(F.to_date("o_orderdate")).alias("last_contest")), table(spark, sf_dir, "events").agg(F.count("*").alias("quotes")),
        table(spark, sf_dir, "documents").agg(F.count("*").alias("documents")), table(spark, sf_dir, "supplier").agg(F.count_if(F.col("s_acctbal") < 0).alias("flagged")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, how="cross")  # rows of one
    return out


@query("""SELECT o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS written, CAST(o_orderdate AS DATE) AS parsed FROM orders""")
def written_dates(spark, sf_dir):
    """C14: `Month D, YYYY` read back."""
    d = F.date_format("o_orderdate", "MMMM d, yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("written"), scalar.date(d).alias("parsed"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN (l_partkey % 120) * 2.54 BETWEEN 100 AND 250 THEN round((l_partkey % 120) * 2.54, 6) END::DOUBLE AS cm FROM lineitem""")
def reach_parsing(spark, sf_dir):
    """Inches as centimetres within bounds; other text is missing."""
    text = F.when(F.col("l_partkey") % 3 == 0, "--").otherwise(F.concat((F.col("l_partkey") % 120).cast("string"), F.lit('"')))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.reach_cm(text).alias("cm"))


@query(f"""WITH {CONTESTS}, s AS (SELECT a, b, event_date, bout_id, outcome FROM contests), p AS (SELECT o_orderkey AS fid, CAST(o_orderdate AS DATE) AS d, min(l_suppkey) AS x, max(l_suppkey) AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT fid, count(bout_id) AS matches, CASE WHEN count(bout_id) = 1 THEN min(outcome) END AS settled FROM p LEFT JOIN s ON s.a = p.x AND s.b = p.y AND s.event_date = p.d GROUP BY fid""")
def settle_forecasts(spark, sf_dir):
    """Forecasts settled by date and pair, only where one contest fits."""
    line, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fid"), F.to_date("o_orderdate").alias("event_date"))
    p = o.join(line.groupBy(F.col("l_orderkey").alias("fid")).agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b")), "fid")
    s = contests(spark, sf_dir).groupBy("a", "b", "event_date").agg(F.count("*").alias("matches"), F.min("outcome").alias("outcome"))
    return p.join(s, ["a", "b", "event_date"], "left").select("fid", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("outcome")).alias("settled"))
