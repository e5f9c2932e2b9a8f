"""Decisions, reviewed imports and retained evidence over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, evaluate, evidence, features
from ..sources import reviewed, wikitext
from .domain import CONTESTS, RECORDS, contests, records, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NOW = 1_705_752_000  # the gate's time in the test rows, in seconds


def before(seconds) -> F.Column:
    return F.timestamp_seconds(F.lit(NOW) - seconds)


@query("""WITH e AS (SELECT event_id AS k, value AS price, (44 + event_id % 41)::DOUBLE / 128 AS p, CASE event_id % 13 WHEN 0 THEN 1.5 WHEN 1 THEN NULL ELSE 0.5 END::DOUBLE AS m, CASE WHEN event_id % 29 = 0 THEN 31 ELSE 30 END AS captured,
        CASE WHEN event_id % 37 = 0 THEN 35 ELSE event_id % 3 * 10 END AS as_of, 31 + event_id % 40 AS updated FROM events),
    g AS (SELECT k, price, p, CASE WHEN k % 17 = 0 THEN 'invalid_reference_time' WHEN k % 17 = 1 THEN 'event_started' WHEN m > 1 THEN 'invalid_market_probability' WHEN abs(p - m) > 0.1::DOUBLE THEN 'pass_market_disagreement' WHEN k % 7 = 0 THEN 'not_model_candidate'
        WHEN k % 19 = 0 THEN 'missing_quote' WHEN k % 23 = 0 THEN 'invalid_row_time' WHEN captured <> 30 THEN 'different_snapshot' WHEN updated < captured OR captured < as_of THEN 'invalid_time_order' WHEN updated > 60 THEN 'stale_data' WHEN k % 11 = 0 THEN 'invalid_probability'
        WHEN price IS NULL OR price <= 1 THEN 'invalid_odds' WHEN price - 0.05::DOUBLE <= 1 THEN 'price_drift_exhausts_odds' WHEN p * (price - 0.05::DOUBLE) - 1 < 0.03::DOUBLE THEN 'edge_below_floor' ELSE 'ok' END AS reason FROM e)
    SELECT k AS event_id, reason, reason = 'ok' AS eligible, CASE WHEN reason IN ('ok', 'edge_below_floor') THEN floor((price - 0.05::DOUBLE) * 10000 + 0.5) / 10000 END AS conservative_price,
        CASE WHEN reason IN ('ok', 'edge_below_floor') THEN floor((p * (price - 0.05::DOUBLE) - 1) * 10000 + 0.5) / 10000 END AS conservative_profit FROM g""")
def alert_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 15 outcomes of the gate, by faults planted in scored quotes."""
    k = F.col("event_id")
    p = (F.lit(44) + k % 41).cast("double") / 128
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(k % 17 != 0, F.timestamp_seconds(F.lit(NOW))).alias("now"), before(F.lit(30)).alias("snapshot_at"), before(F.when(k % 17 == 1, 0).otherwise(-3600)).alias("starts_at"), p.alias("model_p"), F.when(k % 11 == 0, 1.0).otherwise(p).alias("selection_p"),
        F.when(k % 13 == 0, 1.5).when(k % 13 != 1, 0.5).alias("market_p"), F.when(k % 7 == 0, "pass").otherwise("candidate").alias("decision"), F.when(k % 19 != 0, k).alias("quote_id"), F.col("user_id").alias("book"), F.col("value").alias("price"),
        before(F.when(k % 37 == 0, 35).otherwise(k % 3 * 10)).alias("as_of"), before(F.when(k % 29 == 0, 31).otherwise(30)).alias("captured_at"), F.when(k % 23 != 0, before(31 + k % 40)).alias("updated_at"),
    )
    r4 = lambda name: (F.floor(F.col(name) * 10_000 + 0.5) / 10_000).alias(name)
    return decisions.alert_gate(rows).select("event_id", F.col("alert_reason").alias("reason"), F.col("alert_eligible").alias("eligible"), r4("conservative_price"), r4("conservative_profit"))


@query("""WITH e AS (SELECT event_id AS k, (44 + event_id % 41)::DOUBLE / 128 AS p, CASE WHEN event_id % 5 > 1 THEN 0.5 END::DOUBLE AS m FROM events)
    SELECT k AS event_id, CASE WHEN coalesce(abs(p - m) > 0.1::DOUBLE, false) THEN 'pass_market_disagreement' WHEN k % 11 = 0 OR k % 13 = 0 THEN 'provider_status_blocked' WHEN k % 17 = 0 THEN 'bout_not_scheduled' WHEN k % 19 = 0 THEN 'event_start_unavailable' WHEN k % 23 = 0 THEN 'event_started'
        WHEN k % 7 = 0 THEN 'no_valid_prediction' WHEN k % 100 > 80 THEN 'stale_prediction' WHEN k % 3 = 0 THEN 'no_quote' WHEN k % 3 = 1 AND k % 4 = 0 THEN 'no_verified_fresh_quote' WHEN k % 2 = 0 THEN 'gate_' || CASE k % 6 WHEN 2 THEN 'accepted_recently' ELSE 'rejected' END ELSE 'requires_alert_gate' END AS availability FROM e""")
def availability_states(spark, sf_dir):
    """What may be shown of a contest, first state that holds."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(k % 11 == 0, "cancelled").when(k % 2 == 0, "scheduled").alias("event_provider"), F.when(k % 13 == 0, "live").otherwise("not_started").alias("bout_provider"), F.when(k % 17 == 0, "completed").otherwise("scheduled").alias("status"),
        F.when(k % 19 != 0, before(F.when(k % 23 == 0, 10).otherwise(-3600))).alias("starts_at"), F.when(k % 7 != 0, before(k % 100 * 10)).alias("predicted_at"), ((F.lit(44) + k % 41).cast("double") / 128).alias("model_p"), F.when(k % 5 > 1, 0.5).alias("market_p"),
        (k % 3).alias("quotes"), F.when((k % 3 == 1) & (k % 4 == 0), 0).otherwise(1).alias("fresh_quotes"), F.when(k % 6 == 2, "accepted_recently").when(k % 2 == 0, "rejected").alias("gate_status"),
    )
    return decisions.availability(rows, F.timestamp_seconds(F.lit(NOW)), 800).select("event_id", "availability")


def book_prices(spark, sf_dir):
    """The latest price of both sides of a contest at each book, and the probability of the first side without margin where there are both."""
    q = table(spark, sf_dir, "events").where("value > 1").select(F.col("event_id").alias("quote_id"), F.floor(F.col("event_id") / 3).alias("bout_id"), (F.col("user_id") % 2).alias("book"), (F.col("event_id") % 3 == 0).alias("first"), F.col("value").alias("price"), "ts")
    new = lambda side: F.max(F.when(side, F.struct("ts", "quote_id", "price")))
    books = q.groupBy("bout_id", "book").agg(new(F.col("first")).alias("a"), new(~F.col("first")).alias("b"))
    market = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), (1 / F.col("a.price")) / (1 / F.col("a.price") + 1 / F.col("b.price")))
    return books.withColumn("market", market)


@query(f"""WITH {CONTESTS}, q AS (SELECT event_id AS quote_id, event_id // 3 AS bout_id, user_id % 2 AS book, event_id % 3 = 0 AS first, value AS price, ts FROM events WHERE value > 1),
    l AS (SELECT bout_id, book, first, arg_max(struct_pack(price, quote_id, ts), (ts, quote_id)) AS q FROM q GROUP BY ALL),
    b AS (SELECT bout_id, book, max(q) FILTER (WHERE first) AS a, max(q) FILTER (WHERE NOT first) AS b FROM l GROUP BY ALL), m AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (1 / a.price) / (1 / a.price + 1 / b.price) END AS market FROM b),
    s AS (SELECT bout_id, book, market, a AS q, true AS first FROM m WHERE a IS NOT NULL UNION ALL SELECT bout_id, book, market, b, false FROM m WHERE b IS NOT NULL),
    x AS (SELECT c.bout_id, (32 + c.bout_id % 65)::DOUBLE / 128 AS p, s.book, market, q, first, CASE WHEN first THEN p ELSE 1 - p END * q.price - 1 AS ev FROM contests c LEFT JOIN s USING (bout_id)),
    best AS (SELECT *, row_number() OVER (PARTITION BY bout_id ORDER BY ev DESC NULLS LAST, q.quote_id) AS r, max(market) OVER (PARTITION BY bout_id, book) AS own FROM x),
    other AS (SELECT bout_id, arg_min(market, book) AS any_market FROM m WHERE market IS NOT NULL GROUP BY 1), d AS (SELECT bout_id, p, q, first, ev, coalesce(own, any_market) AS market FROM best LEFT JOIN other USING (bout_id) WHERE r = 1)
    SELECT bout_id, q.quote_id AS quote_id, round(market, 9) AS market_p, round(abs(p - market), 9) AS market_gap, round(ev, 9) + 0.0 AS expected_profit, round(1 / q.price, 9) AS break_even,
        CASE WHEN coalesce(abs(p - market) > 0.1::DOUBLE, false) THEN 'pass_market_disagreement' WHEN bout_id % 5 = 0 AND q.quote_id IS NOT NULL THEN 'research_only' WHEN ev >= 0.03::DOUBLE THEN 'candidate' WHEN q.quote_id IS NOT NULL THEN 'pass' ELSE 'no_quote' END AS decision FROM d""")
def score_events(spark, sf_dir):
    """Every contest's decision. The latest price of each book and side, each book's two-sided market, the best price by expected profit and that book's market (else
    the first book's) come from two aggregates by contest, so no contest meets its quotes in a join."""
    books = book_prices(spark, sf_dir)
    p = (F.lit(32) + F.col("bout_id") % 65).cast("double") / 128
    side = lambda name, chance: F.when(F.col(name).isNotNull(), F.struct((chance * F.col(f"{name}.price") - 1).alias("ev"), (-F.col(f"{name}.quote_id")).alias("order"), F.col(f"{name}.price").alias("price"), chance.alias("selection_p"), "market"))
    # greatest() skips nulls, max() too: one best price of a book, then of a contest
    best = books.withColumn("best", F.greatest(side("a", p), side("b", 1 - p))).groupBy("bout_id").agg(F.max("best").alias("best"), F.min_by("market", F.when(F.col("market").isNotNull(), F.col("book"))).alias("any_market"))
    rows = contests(spark, sf_dir).select("bout_id").join(best, "bout_id", "left")
    rows = rows.select("bout_id", p.alias("model_p"), F.coalesce("best.market", "any_market").alias("market_p"), "best.selection_p", "best.price", (-F.col("best.order")).alias("quote_id"))
    r9 = lambda name: F.round(name, 9).alias(name)
    out = decisions.decide(rows, F.col("bout_id") % 5 == 0)
    return out.select("bout_id", "quote_id", r9("market_p"), r9("market_gap"), (F.round("expected_profit", 9) + 0.0).alias("expected_profit"), r9("break_even"), "decision")


@query("""WITH r AS (SELECT o_orderkey AS k, CASE WHEN k % 31 = 0 THEN '' ELSE 'x' END AS event_id, CASE WHEN k % 29 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS event_date, k % 50 AS a, k % 49 AS b, CASE WHEN k % 41 = 0 THEN 'postponed' ELSE 'completed' END AS event_status,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'scheduled' ELSE 'delayed' END AS bout_status, CASE WHEN o_orderstatus = 'F' THEN CASE k % 5 WHEN 1 THEN 'draw' WHEN 2 THEN 'no_contest' WHEN 3 THEN NULL ELSE 'win' END WHEN k % 43 = 0 THEN 'win' END AS outcome,
        CASE WHEN o_orderstatus = 'F' AND k % 5 IN (0, 4) THEN CASE k % 3 WHEN 0 THEN k % 50 WHEN 1 THEN k % 49 ELSE 999 END WHEN o_orderstatus = 'F' AND k % 7 = 0 THEN k % 50 END AS winner FROM orders)
    SELECT k AS bout_id, event_date, CASE WHEN event_date IS NULL THEN 'event_date' WHEN event_id = '' THEN 'event_id_required' WHEN a = b THEN 'same_participant' WHEN event_status = 'postponed' THEN 'event_status' WHEN bout_status = 'delayed' THEN 'bout_status'
        WHEN bout_status = 'completed' AND outcome IS NULL THEN 'outcome' WHEN bout_status = 'completed' AND outcome = 'win' AND winner NOT IN (a, b) THEN 'winner_not_in_contest' WHEN bout_status = 'completed' AND outcome <> 'win' AND winner IS NOT NULL THEN 'winner_without_win'
        WHEN bout_status <> 'completed' AND (outcome IS NOT NULL OR winner IS NOT NULL) THEN 'result_before_end' END AS problem FROM r""")
def reviewed_contests(spark, sf_dir):
    """A reviewed file of contests, as text with faults planted, and the first rule each row breaks."""
    k, over = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    person = lambda n: F.concat(F.lit("p"), (k % n).cast("string"))
    date = F.when(k % 58 == 0, "1996-13-01").when(k % 29 == 0, "03/04/1996").otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    won = F.when(k % 3 == 0, person(50)).when(k % 3 == 1, person(49)).otherwise("p999")
    outcome = F.when(over, F.when(k % 5 == 1, "draw").when(k % 5 == 2, "no_contest").when(k % 5 == 3, "").otherwise("win")).otherwise(F.when(k % 43 == 0, "win").otherwise(" "))
    rows = table(spark, sf_dir, "orders").select(
        F.when(k % 31 == 0, " ").otherwise(F.concat(F.lit("e"), F.col("o_custkey").cast("string"))).alias("event_id"), F.lit("card").alias("event_name"), date.alias("event_date"), F.when(k % 41 == 0, "postponed").otherwise("completed").alias("event_status"), k.cast("string").alias("bout_id"),
        person(50).alias("fighter_a_id"), F.lit("A").alias("fighter_a_name"), person(49).alias("fighter_b_id"), F.lit("B").alias("fighter_b_name"), F.when(over, "completed").when(F.col("o_orderstatus") == "O", "scheduled").otherwise("delayed").alias("bout_status"), outcome.alias("outcome"),
        F.when(over & (k % 5).isin(0, 4), won).when(over & (k % 7 == 0), person(50)).otherwise("").alias("winner_fighter_id"),
    )
    return reviewed.contests(rows).select(F.col("bout_id").cast("long").alias("bout_id"), "event_date", "problem")


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS who, l_orderkey // 4 % 300 AS d, l_partkey % 200 + 80 AS reach, l_partkey % 7 AS kind, l_partkey % 11 AS fault FROM lineitem),
    t AS (SELECT k, n, who, d, CASE WHEN kind < 3 THEN NULL WHEN kind = 6 AND fault = 5 THEN NULL ELSE reach END AS reach, CASE WHEN fault = 0 THEN 'observed_at' WHEN fault = 1 THEN 'observed_in_future' WHEN fault = 2 THEN 'evidence_required' WHEN fault = 3 THEN 'birth_date' WHEN fault = 4 AND kind % 2 = 0 THEN 'born_after_observation'
        WHEN kind = 6 AND fault = 5 THEN 'reach_not_numeric' WHEN kind >= 3 AND reach NOT BETWEEN 100 AND 250 THEN 'reach_out_of_range' WHEN kind < 3 AND fault NOT IN (4, 6) THEN 'no_value' WHEN who % 10 = 9 THEN 'unknown_participant' END AS problem, CASE WHEN fault IN (4, 6) THEN 1 ELSE 0 END AS born FROM r),
    g AS (SELECT who, d, count(DISTINCT (coalesce(reach, -1), born)) > 1 AS differ FROM t WHERE problem IS NULL GROUP BY ALL)
    SELECT k AS l_orderkey, n AS l_linenumber, reach::DOUBLE AS reach_cm, coalesce(problem, CASE WHEN differ THEN 'conflicting_rows' END) AS problem FROM t LEFT JOIN g USING (who, d)""")
def reviewed_profiles(spark, sf_dir):
    """Dated observations of participants as text with faults planted; rows of one participant and time that differ are conflicts."""
    kind, fault = F.col("l_partkey") % 7, F.col("l_partkey") % 11
    at = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.floor(F.col("l_orderkey") / 4) % 300).cast("int")), "yyyy-MM-dd")
    reach = (F.col("l_partkey") % 200 + 80).cast("string")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("fighter_id"), F.when(fault == 0, at).when(fault == 1, "2031-01-01T00:00:00Z").otherwise(F.concat(at, F.lit("T02:00:00+02:00"))).alias("observed_at"), F.when(fault != 2, "https://example.org/e").alias("source_evidence_uri"),
        F.when(fault == 3, "1990-02-30").when((fault == 4) & (kind % 2 == 0), "2030-01-01").when(fault.isin(4, 6), "1990-01-01").alias("birth_date"), F.when(kind < 3, "").when((kind == 6) & (fault == 5), "long").otherwise(reach).alias("reach_cm"),
    )
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 9").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("fighter_id"))
    out = reviewed.profile_observations(rows, known, F.lit("2030-06-01T00:00:00Z").cast("timestamp"))
    return out.select("l_orderkey", "l_linenumber", "reach_cm", "problem")


@query(f"""WITH {CONTESTS}, r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS who, l_quantity::BIGINT AS attempted, CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN l_quantity::BIGINT + 1 ELSE l_quantity::BIGINT - l_partkey % 2 END AS landed, l_partkey % 5 AS late FROM lineitem),
    t AS (SELECT r.*, CASE WHEN landed IS NULL THEN 'landed' WHEN landed > attempted THEN 'landed_above_attempted' WHEN NOT coalesce(outcome <> 'no_contest' AND who IN (a, b), false) THEN 'no_finished_contest' WHEN late = 0 THEN 'observed_too_early' END AS problem FROM r LEFT JOIN contests c ON c.bout_id = r.k),
    g AS (SELECT k, who, late, count(DISTINCT (landed, attempted)) > 1 AS differ FROM t WHERE problem IS NULL GROUP BY ALL), s AS (SELECT k, who, late, max(attempted) AS m FROM r WHERE late = 3 GROUP BY ALL)
    SELECT k AS l_orderkey, n AS l_linenumber, landed, coalesce(t.problem, CASE WHEN differ THEN 'conflicting_rows' WHEN m IS NOT NULL THEN CASE WHEN landed = m AND attempted = m THEN 'stored_already' ELSE 'conflicts_with_stored' END END) AS problem FROM t LEFT JOIN g USING (k, who, late) LEFT JOIN s USING (k, who, late)""")
def reviewed_counts(spark, sf_dir):
    """Dated counts of a participant in a finished contest, against the contest and against what is stored already."""
    part, q = F.col("l_partkey"), F.col("l_quantity").cast("long")
    bouts = contests(spark, sf_dir).select(F.col("bout_id").cast("string").alias("bout_id"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), (F.col("outcome") != "no_contest").alias("over"), "event_date", F.lit(None).cast("timestamp").alias("starts_at"))
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("d")), "l_orderkey")
    at = F.date_add("d", (part % 5).cast("int"))
    rows = line.select(
        "l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("bout_id"), F.col("l_suppkey").cast("string").alias("fighter_id"), F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T12:00:00Z")).alias("observed_at"), F.lit("https://example.org/e").alias("source_evidence_uri"),
        F.when(part % 9 == 0, "-").when(part % 7 == 0, (q + 1).cast("string")).otherwise((q - part % 2).cast("string")).alias("landed"), q.cast("string").alias("attempted"),
    )
    stored = line.where("l_partkey % 5 = 3").groupBy(F.col("l_orderkey").cast("string").alias("bout_id"), F.col("l_suppkey").cast("string").alias("fighter_id"), at.cast("timestamp").alias("day")).agg(F.max(q).alias("attempted"))
    stored = stored.select("bout_id", "fighter_id", (F.col("day") + F.expr("INTERVAL 12 HOURS")).alias("at"), F.lit("https://example.org/e").alias("source_evidence_uri"), F.col("attempted").alias("landed"), "attempted")
    return reviewed.stat_observations(rows, bouts, F.lit("2030-01-01T00:00:00Z").cast("timestamp"), stored).select("l_orderkey", "l_linenumber", "landed", "problem")


@query("""WITH r AS (SELECT doc_id, source, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'raw/' || doc_id END AS path, CASE WHEN doc_id % 11 = 0 THEN 'none' WHEN doc_id % 7 = 0 THEN sha256('other') ELSE sha256(coalesce(text, '')) END AS sha, text FROM documents),
    p AS (SELECT CASE WHEN doc_id % 19 = 0 THEN 'moved/' ELSE 'raw/' END || doc_id AS path, sha256(coalesce(text, '')) AS actual FROM documents WHERE doc_id % 17 <> 0), c AS (SELECT r.source, CASE WHEN sha = 'none' THEN 'invalid_receipt_hash' WHEN r.path IS NULL THEN 'missing_payload_path'
        WHEN a.path IS NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.actual = r.sha) THEN 'missing_payload' WHEN a.actual <> sha THEN 'payload_hash_mismatch' END AS problem FROM r LEFT JOIN p a ON a.path = r.path)
    SELECT source, count(*) AS receipts, count(*) FILTER (WHERE problem IS NULL) AS verified, count(*) FILTER (WHERE problem = 'invalid_receipt_hash') AS invalid_receipt_hash, count(*) FILTER (WHERE problem = 'missing_payload_path') AS missing_payload_path, count(*) FILTER (WHERE problem = 'missing_payload') AS missing_payload,
        count(*) FILTER (WHERE problem = 'payload_hash_mismatch') AS payload_hash_mismatch FROM c GROUP BY source""")
def evidence_integrity(spark, sf_dir):
    """Every receipt against its retained payload, found by path, else by digest; planted are bad digests, lost, moved and altered payloads."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    actual = F.sha2(F.coalesce("text", F.lit("")), 256)
    receipts = d.select(k.alias("run_id"), "source", F.when(k % 13 != 0, F.concat(F.lit("raw/"), k.cast("string"))).alias("path"), F.when(k % 11 == 0, "none").when(k % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(actual).alias("sha256"))
    payloads = d.where("doc_id % 17 <> 0").select(F.concat(F.when(k % 19 == 0, "moved/").otherwise("raw/"), k.cast("string")).alias("path"), actual.alias("actual"))
    return evidence.receipt_summary(evidence.verify_receipts(receipts, payloads))


@query("""WITH o AS (SELECT o_custkey AS page_id, year(o_orderdate) AS year, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS r FROM orders)
    SELECT page_id, year, r AS row, CASE WHEN k % 8 <> 0 THEN r END AS number, CASE WHEN k % 9 <> 0 THEN 'Card ' || k END AS title, CASE WHEN k % 9 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'Card ' || k ELSE 'Night ' || k END END AS name, CASE WHEN k % 10 <> 0 THEN CASE WHEN k % 23 = 0 THEN d - INTERVAL 1 YEAR ELSE d END END::DATE AS event_date,
        CASE WHEN k % 8 = 0 THEN 'non_numeric_number' WHEN k % 9 = 0 THEN 'event_cell' WHEN k % 10 = 0 THEN 'event_date' WHEN k % 23 = 0 THEN 'other_year' END AS problem FROM o WHERE k % 8 <> 0 OR (k % 9 <> 0 AND k % 10 <> 0)""")
def year_tables(spark, sf_dir):
    """Pages of wiki text, one for each customer and year, scanned for the rows of their table of events."""
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    d = F.to_date("o_orderdate")
    d = F.when((k % 23 == 0), F.add_months(d, -12)).otherwise(d)
    key = k.cast("string")
    link = F.when(k % 9 == 0, "no link").when(k % 2 == 0, F.concat(F.lit("[[Card "), key, F.lit("]]"))).otherwise(F.concat(F.lit("{{sort|x|[[Card_"), key, F.lit("|Night "), key, F.lit("]]}}")))
    date = F.when(k % 10 == 0, "soon").when(k % 3 == 0, F.date_format(d, "MMM d, yyyy")).when(k % 3 == 1, F.date_format(d, "MMMM d, yyyy")).otherwise(F.concat(F.lit("{{dts|"), F.date_format(d, "yyyy|M|d"), F.lit("}}")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), year.alias("year"), k.alias("k"), link.alias("link"), date.alias("date"))
    pages = rows.groupBy("page_id", "year").agg(F.sort_array(F.collect_list(F.struct("k", "link", "date"))).alias("rows"))
    line = F.transform("rows", lambda x, i: F.concat(F.lit("|-\n| style=\"a\" | "), F.when(x["k"] % 8 == 0, "-").otherwise((i + 1).cast("string")), F.when(x["k"] % 4 == 1, " || ").otherwise("\n| "), x["link"], F.when(x["k"] % 4 == 1, " || ").otherwise("\n| "), x["date"], F.lit(" || Hall\n")))
    source = F.concat(F.lit("==Events==\n{| class=\"x\"\n! Other\n|-\n| 1\n|}\n{| class=\"y\"\n! scope=\"col\" | #\n! scope=\"col\" | Event\n! Date !! Place\n"), F.array_join(line, ""), F.lit("|}\nrest"))
    return wikitext.year_events(pages.select("page_id", "year", source.alias("source")))


HISTORY = f"""WITH {RECORDS}, s AS (SELECT f.bout_id, f.fighter_id, f.opponent_id, f.event_id, f.event_date, f.points, count(p.points) AS known, (coalesce(sum(p.points), 0) + 1) / (count(p.points) + 2) AS w FROM records f LEFT JOIN records p ON p.fighter_id = f.fighter_id AND p.day < f.day GROUP BY ALL),
    t AS (SELECT x.bout_id, x.event_id, x.event_date, x.fighter_id AS a, y.fighter_id AS b, x.known AS known_a, y.known AS known_b, x.w / (x.w + y.w) AS p, x.points AS y FROM s x JOIN s y ON y.bout_id = x.bout_id AND x.fighter_id < y.fighter_id)"""


def history_forecasts(spark, sf_dir):
    """bout_id, event, both sides, what is known of them, the first side's probability from both win rates before the date, and the result."""
    pairs = features.sides(features.state(records(spark, sf_dir)), ["points", "scored", "total", "event_date", "event_id"])
    weight = lambda s: (F.col(f"{s}.total") + 1) / (F.col(f"{s}.scored") + 2)
    return pairs.select("bout_id", "a.event_id", "a.event_date", F.col("a.fighter_id").alias("a"), F.col("b.fighter_id").alias("b"), F.col("a.scored").alias("known_a"), F.col("b.scored").alias("known_b"), (weight("a") / (weight("a") + weight("b"))).alias("p"), F.col("a.points").alias("y"))


@query(f"""{HISTORY}, d AS (SELECT event_date, row_number() OVER (ORDER BY event_date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT event_date FROM t WHERE y IN (0, 1))),
    q AS (SELECT event_id // 3 AS bout_id, user_id % 2 AS book, arg_max(value, (ts, event_id)) FILTER (WHERE event_id % 3 = 0) AS a, arg_max(value, (ts, event_id)) FILTER (WHERE event_id % 3 <> 0) AS b FROM events WHERE value > 1 GROUP BY ALL),
    m AS (SELECT bout_id, arg_min((1 / a) / (1 / a + 1 / b), book) AS market FROM q WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
    r AS (SELECT t.*, market FROM t JOIN d USING (event_date) LEFT JOIN m USING (bout_id) WHERE y IN (0, 1) AND k > floor(n * 0.85::DOUBLE)),
    x AS (SELECT 'coin' AS model, 0.5::DOUBLE AS p, y, market FROM r UNION ALL SELECT 'history', p, y, market FROM r UNION ALL SELECT 'book', market, y, market FROM r), c AS (SELECT *, 'all' AS cohort FROM x UNION ALL SELECT *, 'priced' FROM x WHERE market IS NOT NULL)
    SELECT model, cohort, count(*) AS asked, count(p) AS n, round(avg(CASE WHEN p IS NOT NULL THEN CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END END), 6) AS accuracy, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss FROM c GROUP BY ALL""")
def evaluated_models(spark, sf_dir):
    """Models on the last dates (held out whole), over all of their contests and over those with a market; a missing market is missing coverage, never
    an estimate."""
    rows = evaluate.split_by_date(history_forecasts(spark, sf_dir).where("y in (0, 1)"), "event_date").where("split = 'test'")
    market = book_prices(spark, sf_dir).where("market is not null").groupBy("bout_id").agg(F.min_by("market", "book").alias("market"))
    out = evaluate.compared(rows.join(market, "bout_id", "left"), {"coin": F.lit(0.5), "history": F.col("p"), "book": F.col("market")}, {"all": F.lit(True), "priced": F.col("market").isNotNull()}, "y")
    return out.select("model", "cohort", "asked", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "brier", "log_loss")])


@query(f"""{HISTORY}, n AS (SELECT event_id, event_date, who, count(*) AS n FROM (SELECT event_id, event_date, unnest([a, b]) AS who FROM t) GROUP BY ALL),
    r AS (SELECT t.*, CASE WHEN x.n > 1 OR z.n > 1 THEN 'repeated_participant' WHEN known_a = 0 AND known_b = 0 THEN 'no_history' WHEN known_a = 0 THEN 'no_history_a' WHEN known_b = 0 THEN 'no_history_b' END AS withheld FROM t JOIN n x ON (x.event_id, x.event_date, x.who) = (t.event_id, t.event_date, a) JOIN n z ON (z.event_id, z.event_date, z.who) = (t.event_id, t.event_date, b))
    SELECT event_id, event_date, count(*) AS listed, count(*) FILTER (WHERE withheld IS NULL) AS scored, count(*) FILTER (WHERE withheld = 'repeated_participant') AS repeated, round(min(p) FILTER (WHERE withheld IS NULL), 9) AS least_p, round(max(greatest(p, 1 - p)) FILTER (WHERE withheld IS NULL), 9) AS strongest,
        arg_max(bout_id, (greatest(round(p, 12), round(1 - p, 12)), -bout_id)) FILTER (WHERE withheld IS NULL) AS strongest_bout, count(*) FILTER (WHERE withheld IS NULL) > 0 AS publishable FROM r GROUP BY ALL""")
def forecast_reports(spark, sf_dir):
    """Q22: the report of every card: contests listed, scored and withheld (a side without history, or a participant listed twice), its strongest favourite, and
    whether there is anything to publish. Listings of a participant are counted by a map-side aggregate and joined."""
    t = history_forecasts(spark, sf_dir)
    twice = t.select("event_id", "event_date", F.explode(F.array("a", "b")).alias("who")).groupBy("event_id", "event_date", "who").agg(F.count("*").alias("n")).where("n > 1")
    of = lambda s: twice.select("event_id", "event_date", F.col("who").alias(s), F.lit(True).alias(f"twice_{s}"))
    rows = t.join(of("a"), ["event_id", "event_date", "a"], "left").join(of("b"), ["event_id", "event_date", "b"], "left")
    both = F.col("twice_a").isNotNull() | F.col("twice_b").isNotNull()
    rows = rows.withColumn("withheld", F.when(both, "repeated_participant").when((F.col("known_a") == 0) & (F.col("known_b") == 0), "no_history").when(F.col("known_a") == 0, "no_history_a").when(F.col("known_b") == 0, "no_history_b"))
    scored, strength = F.col("withheld").isNull(), F.greatest("p", 1 - F.col("p"))
    order = F.struct(F.greatest(F.round("p", 12), F.round(1 - F.col("p"), 12)), -F.col("bout_id"))
    return rows.groupBy("event_id", "event_date").agg(
        F.count("*").alias("listed"), F.count_if(scored).alias("scored"), F.count_if(F.col("withheld") == "repeated_participant").alias("repeated"), F.round(F.min(F.when(scored, F.col("p"))), 9).alias("least_p"),
        F.round(F.max(F.when(scored, strength)), 9).alias("strongest"), F.max_by(F.col("bout_id"), F.when(scored, order)).alias("strongest_bout"), (F.count_if(scored) > 0).alias("publishable"),
    )
