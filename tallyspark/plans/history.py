"""Past-only features: embargoed summaries, running state, last five with ties, shrunk rates, ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, folds, metrics
from .domain import CONTESTS, FACTS, contests, facts, table
from .relational import r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TARGET = "1997-06-01"


@query(f"""WITH {FACTS} SELECT fighter_id, count(*) AS bouts, count(*) FILTER (WHERE landed IS NOT NULL AND seconds > 0) AS used,
    round(60.0 * sum(landed) FILTER (WHERE landed IS NOT NULL AND seconds > 0) / nullif(sum(seconds) FILTER (WHERE landed IS NOT NULL AND seconds > 0), 0), 6) + 0.0 AS landed_per_minute
    FROM facts WHERE event_date < DATE '{TARGET}' - INTERVAL 2 DAY GROUP BY fighter_id""")
def past_only_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates before a cutoff with an embargo of two days; numerator and denominator skip a row together."""
    past = facts(spark, sf_dir).where(F.col("event_date") < F.date_sub(F.lit(TARGET).cast("date"), 2))
    landed, seconds = F.col("landed"), F.col("seconds")
    _, _, n = metrics.paired_sums(landed, seconds)
    return past.groupBy("fighter_id").agg(F.count("*").alias("bouts"), n.alias("used"), r6(metrics.paired_ratio(landed, seconds, 60.0), "landed_per_minute"))


@query(f"""WITH {FACTS} SELECT f.bout_id, f.fighter_id, count(p.bout_id) AS prior, CAST(sum(CASE p.outcome WHEN 'win' THEN 1.0 WHEN 'draw' THEN 0.5 ELSE 0.0 END) FILTER (WHERE p.bout_id IS NOT NULL) AS DOUBLE) AS points,
    CAST(CASE WHEN count(p.day) > 0 THEN least(f.day - max(p.day), 730) END AS BIGINT) AS rest FROM facts f LEFT JOIN facts p ON p.fighter_id = f.fighter_id AND p.day < f.day GROUP BY f.bout_id, f.fighter_id, f.day""")
def strict_prior_running(spark, sf_dir):
    """Running state over strictly earlier dates, by a RANGE frame; peers of a date never count. Without an earlier date there is no rest."""
    w = asof.earlier(["fighter_id"], "day")
    points = F.when(F.col("outcome") == "win", 1.0).when(F.col("outcome") == "draw", 0.5).otherwise(0.0)
    return facts(spark, sf_dir).select("bout_id", "fighter_id", F.count("*").over(w).alias("prior"), F.sum(points).over(w).alias("points"), F.when(F.count("*").over(w) > 0, F.least(F.col("day") - F.max("day").over(w), F.lit(730))).cast("long").alias("rest"))


LAST5 = f"""WITH {FACTS}, past AS (SELECT f.bout_id, f.fighter_id, p.landed, p.attempted, p.seconds, rank() OVER (PARTITION BY f.bout_id, f.fighter_id ORDER BY p.day DESC) AS r
    FROM facts f JOIN facts p ON p.fighter_id = f.fighter_id AND p.day < f.day - 2),
    last5 AS (SELECT bout_id, fighter_id, count(*) AS n_last, coalesce(sum(landed) FILTER (WHERE seconds > 0), 0) AS l, coalesce(sum(seconds) FILTER (WHERE landed IS NOT NULL AND seconds > 0), 0) AS s,
        coalesce(sum(landed), 0) AS acc_l, coalesce(sum(attempted) FILTER (WHERE landed IS NOT NULL), 0) AS acc_a FROM past WHERE r <= 5 GROUP BY ALL)
    SELECT f.bout_id, f.fighter_id, coalesce(n_last, 0) AS n_last, round((round(coalesce(l, 0), 4) + 600::DOUBLE) / (coalesce(s, 0) + 1800::DOUBLE) * 60, 9) AS rate, round((round(coalesce(acc_l, 0), 4) + 45::DOUBLE) / (coalesce(acc_a, 0) + 50::DOUBLE), 9) AS accuracy
    FROM facts f LEFT JOIN last5 USING (bout_id, fighter_id)"""


@query(LAST5)
def last5_with_ties_shrunk(spark, sf_dir):
    """The last five contests with whole-date ties before a two-day embargo, as shrunk rates."""
    f = facts(spark, sf_dir).withColumn("l", F.when(F.col("seconds") > 0, F.col("landed"))).withColumn("s", F.when(F.col("landed").isNotNull(), F.col("seconds"))).withColumn("acc_a", F.when(F.col("landed").isNotNull(), F.col("attempted")))
    rows = asof.last_with_ties(f, "fighter_id", "day", "bout_id", ["l", "s", "landed", "acc_a"], 5, 3)
    rate = metrics.Shrunk("rate", "l", "s", 20.0, 30 * 60.0, 60.0).of_sums(F.round("last_l", 4), F.col("last_s"))
    accuracy = metrics.Shrunk("accuracy", "landed", "acc_a", 0.9, 50.0).of_sums(F.round("last_landed", 4), F.col("last_acc_a"))
    return rows.select("bout_id", "fighter_id", "n_last", rate, accuracy).withColumn("rate", F.round("rate", 9)).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH {FACTS}, o AS (SELECT f.fighter_id, f.landed, f.attempted, x.landed AS ol, x.attempted AS oa, f.seconds FROM facts f JOIN facts x ON x.bout_id = f.bout_id AND x.fighter_id = f.opponent_id)
    SELECT fighter_id, round((coalesce(sum(landed) FILTER (WHERE landed <= attempted), 0) + 0.5 * 20) / (coalesce(sum(attempted) FILTER (WHERE landed <= attempted), 0) + 20), 6) AS accuracy,
    round(1 - (coalesce(sum(ol) FILTER (WHERE ol <= oa), 0) + 0.5 * 20) / (coalesce(sum(oa) FILTER (WHERE ol <= oa), 0) + 20), 6) AS defense,
    round((coalesce(sum(landed) FILTER (WHERE seconds > 0), 0) + 0.25 * 60) / (coalesce(sum(seconds) FILTER (WHERE landed IS NOT NULL AND seconds > 0), 0) + 60), 6) AS control FROM o GROUP BY fighter_id""")
def shrunk_metrics(spark, sf_dir):
    """Declarative shrunk metrics over own and opponent totals."""
    w = Window.partitionBy("bout_id")
    f = facts(spark, sf_dir)
    f = f.withColumn("ol", F.when(F.col("fighter_id") < F.col("opponent_id"), F.max_by("landed", "fighter_id").over(w)).otherwise(F.min_by("landed", "fighter_id").over(w)))
    f = f.withColumn("oa", F.when(F.col("fighter_id") < F.col("opponent_id"), F.max_by("attempted", "fighter_id").over(w)).otherwise(F.min_by("attempted", "fighter_id").over(w)))
    specs = [metrics.Shrunk("accuracy", "landed", "attempted", 0.5, 20, bounded=True), metrics.Shrunk("defense", "ol", "oa", 0.5, 20, bounded=True, complement=True), metrics.Shrunk("control", "landed", "seconds", 0.25, 60)]
    return f.groupBy("fighter_id").agg(*[F.round(s.column(), 6).alias(s.name) for s in specs])


@query(f"""WITH {FACTS}, x AS (SELECT *, CASE outcome WHEN 'win' THEN 1.0 WHEN 'draw' THEN 0.5 ELSE 0.0 END AS points FROM facts),
    h AS (SELECT f.bout_id, f.fighter_id, p.points, row_number() OVER (PARTITION BY f.bout_id, f.fighter_id ORDER BY p.day DESC, p.event_id DESC, p.bout_id DESC) AS r FROM x f JOIN x p ON p.fighter_id = f.fighter_id AND p.day < f.day)
    SELECT f.bout_id, f.fighter_id, round((coalesce(sum(h.points) FILTER (WHERE r <= 5), 0) + 1) / (count(h.points) FILTER (WHERE r <= 5) + 2), 6) AS form FROM x f LEFT JOIN h USING (bout_id, fighter_id) GROUP BY ALL""")
def recent_form(spark, sf_dir):
    """Form over the last five contests of earlier dates."""
    f = facts(spark, sf_dir).withColumn("points", F.when(F.col("outcome") == "win", 1.0).when(F.col("outcome") == "draw", 0.5).otherwise(0.0))
    rows = asof.last_rows(f.select("bout_id", "fighter_id", "day", "event_id", "points"), "fighter_id", "day", ["event_id", "bout_id"], "points", 5)
    total = F.aggregate("last", F.lit(0.0), lambda s, x: s + x)
    return rows.select("bout_id", "fighter_id", F.round((total + 1) / (F.size("last") + 2), 6).alias("form"))


@query(f"""WITH {FACTS}, d AS (SELECT f.bout_id, f.fighter_id, f.opponent_id, f.day, f.landed, f.attempted, coalesce(sum(p.landed), 0) AS ol, coalesce(sum(p.attempted), 0) AS oa FROM facts f
      LEFT JOIN (SELECT opponent_id AS who, day, landed, attempted FROM facts WHERE landed IS NOT NULL) p ON p.who = f.opponent_id AND p.day < f.day GROUP BY ALL),
    r AS (SELECT bout_id, fighter_id, day, landed / attempted - (ol + 1) / (oa + 2) AS residual FROM d)
    SELECT a.bout_id, a.fighter_id, round(coalesce(sum(b.residual), 0) / (count(b.residual) + 2), 6) + 0.0 AS adjusted FROM r a LEFT JOIN r b ON b.fighter_id = a.fighter_id AND b.day < a.day GROUP BY a.bout_id, a.fighter_id""")
def opponent_adjusted(spark, sf_dir):
    """Accuracy beyond what the opponent's earlier opponents had, in two window passes."""
    f = facts(spark, sf_dir)
    given = F.col("landed").isNotNull()
    against = asof.earlier(["opponent_id"], "day")
    f = f.withColumn("ol", F.coalesce(F.sum(F.when(given, F.col("landed"))).over(against), F.lit(0.0))).withColumn("oa", F.coalesce(F.sum(F.when(given, F.col("attempted"))).over(against), F.lit(0.0)))
    f = f.withColumn("residual", F.col("landed") / F.col("attempted") - (F.col("ol") + 1) / (F.col("oa") + 2))
    w = asof.earlier(["fighter_id"], "day")
    return f.select("bout_id", "fighter_id", (F.round(F.coalesce(F.sum("residual").over(w), F.lit(0.0)) / (F.count("residual").over(w) + 2), 6) + 0.0).alias("adjusted"))


@query(f"""WITH {FACTS}, s AS (SELECT fighter_id, day, bout_id, attempted, row_number() OVER (PARTITION BY fighter_id ORDER BY day DESC, bout_id DESC) AS r FROM facts WHERE event_date < DATE '{TARGET}')
    SELECT fighter_id, bout_id, day, attempted FROM s WHERE r <= 3""")
def last_rows(spark, sf_dir):
    """The last three rows of each participant before a date, without ties."""
    f = facts(spark, sf_dir).where(F.col("event_date") < F.lit(TARGET).cast("date"))
    w = Window.partitionBy("fighter_id").orderBy(F.desc("day"), F.desc("bout_id"))
    return f.withColumn("r", F.row_number().over(w)).where("r <= 3").select("fighter_id", "bout_id", "day", "attempted")


@query("""WITH q AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click'), t AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
    SELECT t.event_id, q.event_id AS seen_id, q.value FROM t ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts >= q.ts""")
def asof_latest_quote(spark, sf_dir):
    """The latest quote at or before each decision, by one sort of both sides."""
    e = table(spark, sf_dir, "events")
    q = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("seen_id"), "value")
    t = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return asof.asof_join(t, q, ["user_id"], "ts", "seen_at", ["seen_id", "value"]).select("event_id", "seen_id", "value")


@query("""WITH q AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'), t AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
    SELECT t.event_id, q.event_id AS next_id FROM t ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts < q.ts""")
def asof_next_quote(spark, sf_dir):
    """The next quote strictly after each decision."""
    e = table(spark, sf_dir, "events")
    q = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("next_id"))
    t = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return asof.asof_join(t, q, ["user_id"], "ts", "seen_at", ["next_id"], forward=True, strict=True).select("event_id", "next_id")


@query("""SELECT o_custkey, arg_max(CASE WHEN o_totalprice > 100000 THEN o_orderkey END, (o_orderdate, o_orderkey)) FILTER (WHERE o_totalprice > 100000) AS price_from,
    arg_max(CASE WHEN o_orderstatus <> 'O' THEN o_orderkey END, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus <> 'O') AS status_from,
    count(DISTINCT o_orderkey) FILTER (WHERE o_totalprice > 100000 AND o_orderdate = md) > 1 AS price_from_conflict FROM orders LEFT JOIN (SELECT o_custkey AS k, max(o_orderdate) FILTER (WHERE o_totalprice > 100000) AS md FROM orders GROUP BY 1) ON k = o_custkey GROUP BY o_custkey""")
def latest_by_field(spark, sf_dir):
    """The latest non-null value of each field on its own, with conflicts at the same time flagged."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_orderkey")).alias("price_from"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey")).alias("status_from"))
    return asof.latest_by_field(o, ["o_custkey"], ["price_from", "status_from"], "o_orderdate", "o_orderkey").select("o_custkey", "price_from", "status_from", "price_from_conflict")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events), y AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value > 20)
    SELECT 'filter_first' AS mode, user_id, event_type, event_id FROM y WHERE r = 1 UNION ALL SELECT 'latest_first', user_id, event_type, event_id FROM x WHERE r = 1 AND value > 20""")
def latest_modes(spark, sf_dir):
    """J18, O7, §7.4.12: filter then latest, and latest then validate, are different operators."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    out = [asof.latest(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], F.col("value") > 20, first).select(F.lit(name).alias("mode"), "user_id", "event_type", "event_id") for first, name in ((True, "filter_first"), (False, "latest_first"))]
    return out[0].unionByName(out[1])


def scored(spark, sf_dir):
    points = F.when(F.col("outcome") == "win", 1.0).when(F.col("outcome") == "draw", 0.5)
    return contests(spark, sf_dir).select("division", "event_date", "event_id", "bout_id", "a", "b", points.alias("score"))


@query()
def elo_sequential(spark, sf_dir):
    """Ratings contest by contest within a division: a departure from F1 that parallelises; elo_one_pool is F1 (both against a plain fold in the tests)."""
    return folds.elo(scored(spark, sf_dir), "division", 32.0)


@query()
def elo_by_date(spark, sf_dir):
    """Ratings date by date within a division; elo_one_pool_by_date is F2."""
    return folds.elo(scored(spark, sf_dir), "division", 64.0, by_date=True)


@query(f"""WITH {FACTS}, s AS (SELECT f.*, coalesce(sum(p.attempted), 0) AS exp_attempts, count(p.bout_id) AS exp_bouts FROM facts f LEFT JOIN facts p ON p.fighter_id = f.fighter_id AND p.day < f.day GROUP BY ALL)
    SELECT c.bout_id, CAST(x.exp_bouts - y.exp_bouts AS BIGINT) AS bouts_diff, round(ln(1 + x.exp_attempts) - ln(1 + y.exp_attempts), 6) + 0.0 AS attempts_diff, x.exp_bouts > 0 AND y.exp_bouts > 0 AS covered FROM contests c
    JOIN s x ON x.bout_id = c.bout_id AND x.fighter_id = c.a JOIN s y ON y.bout_id = c.bout_id AND y.fighter_id = c.b""")
def difference_features(spark, sf_dir):
    """C25, F3, two differences and one coverage flag (feature_vectors has M1-M4 whole): antisymmetric differences of both sides' state before the date, with their coverage."""
    w = asof.earlier(["fighter_id"], "day")
    f = facts(spark, sf_dir).withColumn("attempts", F.coalesce(F.sum("attempted").over(w), F.lit(0.0))).withColumn("n", F.count("*").over(w))
    f = f.withColumn("sign", F.when(F.col("fighter_id") < F.col("opponent_id"), 1).otherwise(-1))
    return f.groupBy("bout_id").agg(F.sum(F.col("sign") * F.col("n")).alias("bouts_diff"), (F.round(F.sum(F.col("sign") * F.log1p("attempts")), 6) + 0.0).alias("attempts_diff"), F.bool_and(F.col("n") > 0).alias("covered"))


@query(f"""WITH {CONTESTS}, v AS (SELECT event_date, count(*) AS n FROM contests GROUP BY 1), w AS (SELECT event_date, sum(n) OVER (ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM v)
    SELECT event_date, CAST(coalesce(earlier, 0) AS BIGINT) AS required FROM w""")
def earlier_targets(spark, sf_dir):
    """How many earlier contests each target date needs; a running sum over dates instead of every pair."""
    dates = contests(spark, sf_dir).groupBy("event_date").agg(F.count("*").alias("n"))
    w = Window.orderBy("event_date").rowsBetween(Window.unboundedPreceding, -1)  # a row for each date
    return dates.select("event_date", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("required"))
