"""The audit over an operating store that is read out of the test tables, with faults of every kind at fixed places.

Suppliers are participants, customers events and their cards, orders contests, their least and greatest suppliers the sides (an order with one supplier is
a contest with itself), and each row of `events` two quotes, a prediction, and for some a bet or a paper bet on the order of the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators.store import forget, stored
from .domain import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-15T00:00:00Z"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    x = F.expr
    iso = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    s, c, e = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "events")
    fighters = s.select(
        x("s_suppkey fighter_id"), x("case when s_suppkey % 41 = 0 then '***' when s_suppkey % 37 = 0 then 'Sáme  Name' else s_name end name"),
        x("case when s_suppkey % 29 <> 0 then 'archive' end source"), x("s_suppkey source_id"),
    )
    c = c.selectExpr("c_custkey k", "date_add(date '2024-01-01', cast(c_custkey % 28 as int)) d")
    noon = iso.format("timestampadd(hour, {}, cast(d as timestamp))")
    events = c.select(
        x("k event_id"), x("case when k % 53 = 0 then 'soon' else cast(d as string) end event_date"), x(f"case when k % 31 = 0 then null when k % 59 = 0 then 'noon' else {noon.format(20)} end start"),
        x("case when k % 3 = 1 then 'scheduled' when k % 3 = 2 and k % 2 = 0 then 'cancelled' else 'completed' end status"), x("case when k % 47 = 0 then 'suspended' when k % 2 = 0 then 'scheduled' end provider_status"),
    )
    runs = c.where("k % 13 <> 0").select(x("k run_id"), x(f"{noon.format(6)} fetched"))
    cards = c.where("k % 4 <> 0").select(
        x("k card_id"), x("k event_id"), x("k run_id"), x(f"case when k % 17 = 0 then null when k % 19 = 0 then 'then' when k % 23 = 0 then {noon.format(21)} else {noon.format(5)} end observed"),
        x("case when k % 2 = 1 then 'reviewed_csv' else 'feed' end basis"), x("case when k % 7 <> 0 then 'https://example.org/card' end source_url"), x(f"case when k % 61 = 0 then 'later' else {noon.format(20)} end start"),
    )
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey k", "o_custkey event", "o_orderstatus status")
    # the tables below are projections of these three, which many rules read: each is made once
    sides = stored(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b")), "sides")
    o = stored(o.join(sides, "k"), "contests")
    bouts = o.select(
        x("k bout_id"), x("case when k % 101 = 0 then -1 else event end event_id"), x("a"), x("b"),
        x("case status when 'F' then 'completed' when 'O' then 'scheduled' else 'cancelled' end status"), x("case when k % 67 = 0 then 'delayed' end provider_status"),
    )
    results = o.where("(status = 'F' and k % 71 <> 0) or (status <> 'F' and k % 73 = 0)").select(
        x("k bout_id"), x("case when k % 5 = 0 then 'draw' else 'win' end outcome"), x("case when k % 5 = 0 then case when k % 83 = 0 then a end when k % 79 = 0 then 99999999 when k % 2 = 0 then a else b end winner"),
        x("case when k % 89 = 0 then 'yesterday' else '2024-02-01T00:00:00Z' end recorded"),
    )
    e = stored(e.select(x("event_id k"), x("user_id u"), x("value v"), x("cast(ts as timestamp) t")).join(sides, "k", "left"), "quoted")
    forget(sides)
    at = iso.format("t + interval {} hours")
    quotes = e.select("k", "u", "v", "t", F.explode(F.array(F.struct(x("2 * k id"), x("coalesce(a, -1L) who")), F.struct(x("2 * k + 1 id"), x("coalesce(b, -1L) who")))).alias("q")).select(
        x("q.id quote_id"), x("k bout_id"), x("u % 3 book"), x("case when q.id % 61 = 0 then -5 else q.who end selection"), x("v price"),
        x(f"case when k % 97 = 0 then 'bad' when k % 11 = 0 then {at.format(1)} when k % 10 = 0 then null else {at.format(-1)} end updated"), x(f"case when k % 103 = 0 then 'never' else {at.format(0)} end captured"),
    )
    predictions = e.where("k % 4 = 0").select(x("k prediction_id"), x("k bout_id"), x(f"case when k % 52 = 0 then '2024-01-01 10:00' else {at.format(0)} end cutoff"), x(f"case when k % 44 = 0 then {at.format(-2)} else {at.format(1)} end generated"))
    linked = "case when k % 24 = 0 then 2 * (k - 1) else 2 * k end"
    bets = e.where("k % 8 = 0").select(x("k bet_id"), x("case when k % 56 = 0 then -7 else k end prediction_id"), x(f"{linked} quote_id"), x("case when k % 40 = 0 then -9 else coalesce(a, -1) end selection"), x("case when k % 88 = 0 then 'soon' else '2024-01-20T00:00:00+01:00' end placed"))
    paper = e.where("k % 8 = 4").select(x("k paper_id"), x("k prediction_id"), x(f"{linked} quote_id"), x("case when k % 36 = 0 then k + 1 else k end bout_id"), x("case when k % 28 = 0 then -9 else coalesce(a, -1) end selection"), x("case when k % 20 = 0 then 'pending_review' else 'open' end settlement"))
    card_bouts = o.where("k % 3 <> 0").select(x("k row_id"), x("event card_id"), x("k bout_id"), x("case when k % 107 = 0 then a + 1 else a end a"), x("b"), x("case when k % 6 = 1 then 'cancelled' else 'scheduled' end status"))
    return {"fighters": fighters, "events": events, "bouts": bouts, "results": results, "quotes": quotes, "predictions": predictions, "bets": bets, "paper": paper, "runs": runs, "cards": cards, "card_bouts": card_bouts}


STORE = """WITH c AS (SELECT c_custkey AS k, DATE '2024-01-01' + (c_custkey % 28)::INTEGER AS d FROM customer),
    fighters AS (SELECT s_suppkey AS fighter_id, CASE WHEN s_suppkey % 41 = 0 THEN '***' WHEN s_suppkey % 37 = 0 THEN 'same name' ELSE s_name END AS name, s_suppkey % 29 <> 0 AS sourced FROM supplier),
    happenings AS (SELECT k AS event_id, k % 53 <> 0 AS dated, CASE WHEN k % 31 = 0 OR k % 59 = 0 THEN NULL ELSE d + INTERVAL 20 HOUR END AS start, k % 31 = 0 AS no_start, k % 59 = 0 AND k % 31 <> 0 AS bad_start,
        CASE WHEN k % 3 = 1 THEN 'scheduled' WHEN k % 3 = 2 AND k % 2 = 0 THEN 'cancelled' ELSE 'completed' END AS status, CASE WHEN k % 47 = 0 THEN 'suspended' WHEN k % 2 = 0 THEN 'scheduled' END AS provider FROM c),
    cards AS (SELECT k AS card_id, k AS event_id, k % 17 = 0 AS unseen, k % 19 = 0 AND k % 17 <> 0 AS bad_seen, CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN d + INTERVAL 21 HOUR ELSE d + INTERVAL 5 HOUR END AS seen,
        CASE WHEN k % 13 <> 0 THEN d + INTERVAL 6 HOUR END AS fetched, k % 2 = 1 AS reviewed, k % 7 = 0 AS no_url, CASE WHEN k % 61 <> 0 THEN d + INTERVAL 20 HOUR END AS start FROM c WHERE k % 4 <> 0),
    o AS MATERIALIZED (SELECT o_orderkey AS k, o_custkey AS event, o_orderstatus AS status, min(l_suppkey) AS a, max(l_suppkey) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    bouts AS MATERIALIZED (SELECT k AS bout_id, CASE WHEN k % 101 = 0 THEN -1 ELSE event END AS event_id, a, b, CASE status WHEN 'F' THEN 'completed' WHEN 'O' THEN 'scheduled' ELSE 'cancelled' END AS status, k % 67 = 0 AS delayed FROM o),
    results AS (SELECT k AS bout_id, CASE WHEN k % 5 = 0 THEN 'draw' ELSE 'win' END AS outcome, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 83 = 0 THEN a END WHEN k % 79 = 0 THEN 99999999 WHEN k % 2 = 0 THEN a ELSE b END AS winner, k % 89 = 0 AS untimed
        FROM o WHERE (status = 'F' AND k % 71 <> 0) OR (status <> 'F' AND k % 73 = 0)),
    e AS (SELECT event_id AS k, user_id AS u, value AS v, date_trunc('second', ts) AS t, a, b FROM events LEFT JOIN (SELECT l_orderkey AS ok, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1) ON ok = event_id),
    quotes AS MATERIALIZED (SELECT 2 * k + side AS quote_id, k AS bout_id, u % 3 AS book, CASE WHEN (2 * k + side) % 61 = 0 THEN -5 ELSE coalesce(CASE side WHEN 0 THEN a ELSE b END, -1) END AS selection, v AS price,
        k % 97 = 0 AS bad_update, CASE WHEN k % 97 = 0 THEN NULL WHEN k % 11 = 0 THEN t + INTERVAL 1 HOUR WHEN k % 10 = 0 THEN NULL ELSE t - INTERVAL 1 HOUR END AS updated, CASE WHEN k % 103 <> 0 THEN t END AS captured FROM e, (VALUES (0), (1)) s(side)),
    predictions AS (SELECT k AS prediction_id, k AS bout_id, CASE WHEN k % 52 <> 0 THEN t END AS cutoff, CASE WHEN k % 44 = 0 THEN t - INTERVAL 2 HOUR ELSE t + INTERVAL 1 HOUR END AS generated FROM e WHERE k % 4 = 0),
    bets AS (SELECT k AS bet_id, CASE WHEN k % 56 = 0 THEN -7 ELSE k END AS prediction_id, CASE WHEN k % 24 = 0 THEN 2 * (k - 1) ELSE 2 * k END AS quote_id, CASE WHEN k % 40 = 0 THEN -9 ELSE coalesce(a, -1) END AS selection, k % 88 = 0 AS untimed FROM e WHERE k % 8 = 0),
    paper AS (SELECT k AS paper_id, k AS prediction_id, CASE WHEN k % 24 = 0 THEN 2 * (k - 1) ELSE 2 * k END AS quote_id, CASE WHEN k % 36 = 0 THEN k + 1 ELSE k END AS bout_id, CASE WHEN k % 28 = 0 THEN -9 ELSE coalesce(a, -1) END AS selection, k % 20 = 0 AS pending FROM e WHERE k % 8 = 4),
    card_bouts AS (SELECT k AS row_id, event AS card_id, k AS bout_id, CASE WHEN k % 107 = 0 THEN a + 1 ELSE a END AS a, b, CASE WHEN k % 6 = 1 THEN 'cancelled' ELSE 'scheduled' END AS status FROM o WHERE k % 3 <> 0),
    seats AS (SELECT cb.row_id, cb.bout_id, cb.a, cb.b, cb.status, cards.event_id, cards.seen FROM card_bouts cb JOIN cards USING (card_id)),
    told AS (SELECT b.*, h.status AS event_status, h.provider AS event_provider, h.start, r.outcome, r.bout_id IS NOT NULL AS has_result FROM bouts b LEFT JOIN happenings h USING (event_id) LEFT JOIN results r USING (bout_id)),
    q AS MATERIALIZED (SELECT q.*, b.a, b.b, b.bout_id IS NOT NULL AS known, coalesce(q.selection IN (b.a, b.b), false) AS chosen, coalesce(price > 1 AND price < 'infinity'::DOUBLE, false) AS fair, h.start FROM quotes q LEFT JOIN bouts b USING (bout_id) LEFT JOIN happenings h USING (event_id)),
    cover AS (SELECT bout_id, a, b, CASE WHEN status = 'completed' AND outcome = 'win' AND start IS NOT NULL THEN 'past' WHEN event_status = 'scheduled' AND status = 'scheduled' AND coalesce(event_provider, 'scheduled') IN ('scheduled', 'not_started') AND NOT delayed AND (start IS NULL OR start > TIMESTAMP '2024-01-15') THEN 'live' END AS kind,
        CASE WHEN status = 'completed' AND outcome = 'win' AND start IS NOT NULL THEN start - INTERVAL 24 HOUR ELSE TIMESTAMP '2024-01-15' END AS stop FROM told WHERE kind IS NOT NULL),
    covered AS (SELECT c.bout_id, any_value(kind) AS kind, count(q.bout_id) > 0 AS quoted, coalesce(bool_or(chosen AND fair AND captured <= stop AND captured >= stop - INTERVAL 24 HOUR AND (updated IS NULL OR updated <= captured) AND (NOT bad_update) AND (updated IS NULL OR (updated <= stop AND updated >= stop - INTERVAL 24 HOUR))), false) AS fresh
        FROM cover c LEFT JOIN q USING (bout_id) GROUP BY c.bout_id),
    stories AS (SELECT event_id, bout_id, arg_min(a, row_id) AS a, arg_min(b, row_id) AS b, bool_or(status = 'cancelled') AS gone, bool_or(status <> 'cancelled') AS active, min(seen) FILTER (WHERE status = 'scheduled') AS seen FROM seats GROUP BY ALL),
    booked AS (SELECT event_id, bout_id, unnest(list_distinct([a, b])) AS who FROM told WHERE status = 'scheduled' AND event_status = 'scheduled')"""

RULES = """
    SELECT 'foreign_key_violation' AS code, 'bouts' AS entity_type, bout_id AS id FROM bouts WHERE event_id = -1
    UNION ALL SELECT 'foreign_key_violation', 'results', bout_id FROM results WHERE winner = 99999999
    UNION ALL SELECT 'foreign_key_violation', 'quotes', quote_id FROM q WHERE NOT known
    UNION ALL SELECT 'foreign_key_violation', 'quotes', quote_id FROM q WHERE selection < 0
    UNION ALL SELECT 'foreign_key_violation', 'predictions', prediction_id FROM predictions WHERE bout_id NOT IN (SELECT bout_id FROM bouts)
    UNION ALL SELECT 'foreign_key_violation', 'bets', bet_id FROM bets WHERE prediction_id NOT IN (SELECT prediction_id FROM predictions)
    UNION ALL SELECT 'foreign_key_violation', 'bets', bet_id FROM bets WHERE quote_id NOT IN (SELECT quote_id FROM quotes)
    UNION ALL SELECT 'foreign_key_violation', 'paper', paper_id FROM paper WHERE quote_id NOT IN (SELECT quote_id FROM quotes)
    UNION ALL SELECT 'foreign_key_violation', 'paper', paper_id FROM paper WHERE bout_id NOT IN (SELECT bout_id FROM bouts)
    UNION ALL SELECT 'foreign_key_violation', 'cards', card_id FROM cards WHERE fetched IS NULL
    UNION ALL SELECT 'foreign_key_violation', 'card_bouts', row_id FROM card_bouts WHERE card_id NOT IN (SELECT card_id FROM cards)
    UNION ALL SELECT 'empty_fighter_name', 'fighter', fighter_id FROM fighters WHERE name = '***'
    UNION ALL SELECT 'unstable_fighter_id', 'fighter', fighter_id FROM fighters WHERE NOT sourced
    UNION ALL SELECT 'ambiguous_fighter_name', 'fighter', min(fighter_id) FROM fighters WHERE name <> '***' GROUP BY name HAVING count(*) > 1
    UNION ALL SELECT 'event_provider_status_needs_review', 'event', event_id FROM happenings WHERE status = 'scheduled' AND provider = 'suspended'
    UNION ALL SELECT 'invalid_event_date', 'event', event_id FROM happenings WHERE NOT dated
    UNION ALL SELECT 'missing_event_start', 'event', event_id FROM happenings WHERE no_start AND status <> 'cancelled'
    UNION ALL SELECT 'invalid_event_start', 'event', event_id FROM happenings WHERE bad_start
    UNION ALL SELECT 'scheduled_event_start_passed', 'event', event_id FROM happenings WHERE status = 'scheduled' AND start <= TIMESTAMP '2024-01-15'
    UNION ALL SELECT 'missing_card_snapshot', 'event', event_id FROM happenings WHERE event_id % 4 = 0
    UNION ALL SELECT 'missing_roster_observation_time', 'card_snapshot', card_id FROM cards WHERE unseen
    UNION ALL SELECT 'invalid_roster_observation_time', 'card_snapshot', card_id FROM cards WHERE bad_seen
    UNION ALL SELECT 'roster_observation_after_ingestion', 'card_snapshot', card_id FROM cards WHERE seen IS NOT NULL AND (fetched IS NULL OR seen > fetched)
    UNION ALL SELECT 'roster_observation_source_missing', 'card_snapshot', card_id FROM cards WHERE reviewed AND seen IS NOT NULL AND no_url
    UNION ALL SELECT 'invalid_snapshot_event_start', 'card_snapshot', card_id FROM cards WHERE start IS NULL
    UNION ALL SELECT 'roster_observed_at_or_after_start', 'card_snapshot', card_id FROM cards WHERE seen >= start
    UNION ALL SELECT 'roster_snapshot_matchup_mismatch', 'card_snapshot', row_id FROM seats JOIN bouts USING (bout_id) WHERE seats.event_id <> bouts.event_id OR seats.a <> bouts.a OR seats.b <> bouts.b
    UNION ALL SELECT 'roster_possible_opponent_substitution', 'event', x.event_id FROM stories x JOIN stories y ON y.event_id = x.event_id AND x.bout_id < y.bout_id
        WHERE len(list_intersect(list_distinct([x.a, x.b]), list_distinct([y.a, y.b]))) = 1 AND ((x.gone AND y.active) OR (y.gone AND x.active) OR coalesce(x.seen <> y.seen, false))
    UNION ALL SELECT 'bout_provider_status_needs_review', 'bout', bout_id FROM bouts WHERE status = 'scheduled' AND delayed
    UNION ALL SELECT 'self_matchup', 'bout', bout_id FROM bouts WHERE a = b
    UNION ALL SELECT 'completed_bout_missing_result', 'bout', bout_id FROM told WHERE status = 'completed' AND NOT has_result
    UNION ALL SELECT 'result_on_noncompleted_bout', 'bout', bout_id FROM told WHERE status <> 'completed' AND has_result
    UNION ALL SELECT 'active_bout_on_cancelled_event', 'bout', bout_id FROM told WHERE event_status = 'cancelled' AND status <> 'cancelled'
    UNION ALL SELECT 'scheduled_bout_on_completed_event', 'bout', bout_id FROM told WHERE event_status = 'completed' AND status = 'scheduled'
    UNION ALL SELECT 'duplicate_active_matchup', 'bout', bout_id FROM (SELECT bout_id, row_number() OVER (PARTITION BY event_id, a, b ORDER BY bout_id) AS r FROM bouts WHERE status <> 'cancelled') WHERE r > 1
    UNION ALL SELECT 'fighter_double_booked', 'bout', bout_id FROM (SELECT bout_id, row_number() OVER (PARTITION BY event_id, who ORDER BY bout_id) AS r FROM booked) WHERE r > 1
    UNION ALL SELECT 'possible_opponent_substitution', 'event', x.event_id FROM bouts x JOIN bouts y ON y.event_id = x.event_id AND x.bout_id <> y.bout_id
        WHERE x.status = 'cancelled' AND y.status <> 'cancelled' AND len(list_intersect(list_distinct([x.a, x.b]), list_distinct([y.a, y.b]))) = 1
    UNION ALL SELECT 'winner_not_in_bout', 'bout', bout_id FROM results WHERE winner = 99999999
    UNION ALL SELECT 'nonbinary_result_has_winner', 'bout', bout_id FROM results WHERE outcome = 'draw' AND winner IS NOT NULL
    UNION ALL SELECT 'invalid_result_timestamp', 'bout', bout_id FROM results WHERE untimed
    UNION ALL SELECT 'quote_selection_not_in_bout', 'quote', quote_id FROM q WHERE known AND NOT chosen
    UNION ALL SELECT 'invalid_quote_price', 'quote', quote_id FROM q WHERE NOT fair
    UNION ALL SELECT 'invalid_quote_capture_time', 'quote', quote_id FROM q WHERE captured IS NULL
    UNION ALL SELECT 'invalid_bookmaker_update_time', 'quote', quote_id FROM q WHERE bad_update
    UNION ALL SELECT 'bookmaker_update_after_capture', 'quote', quote_id FROM q WHERE updated > captured
    UNION ALL SELECT 'quote_after_event_start', 'quote', quote_id FROM q WHERE captured >= start
    UNION ALL SELECT 'invalid_prediction_timestamp', 'prediction', prediction_id FROM predictions WHERE cutoff IS NULL
    UNION ALL SELECT 'prediction_before_feature_cutoff', 'prediction', prediction_id FROM predictions WHERE cutoff > generated
    UNION ALL SELECT 'prediction_after_event_start', 'prediction', prediction_id FROM predictions p JOIN bouts b USING (bout_id) JOIN happenings h USING (event_id) WHERE cutoff >= start
    UNION ALL SELECT 'bet_bout_mismatch', 'bet', bet_id FROM bets JOIN predictions p USING (prediction_id) JOIN quotes z USING (quote_id) WHERE p.bout_id <> z.bout_id
    UNION ALL SELECT 'bet_selection_mismatch', 'bet', bet_id FROM bets JOIN quotes z USING (quote_id) WHERE bets.selection <> z.selection
    UNION ALL SELECT 'invalid_bet_timestamp', 'bet', bet_id FROM bets WHERE untimed
    UNION ALL SELECT 'paper_bout_mismatch', 'paper_bet', paper_id FROM paper LEFT JOIN predictions p USING (prediction_id) LEFT JOIN quotes z USING (quote_id) WHERE coalesce(p.bout_id <> paper.bout_id, false) OR coalesce(z.bout_id <> paper.bout_id, false)
    UNION ALL SELECT 'paper_selection_mismatch', 'paper_bet', paper_id FROM paper JOIN quotes z USING (quote_id) WHERE paper.selection <> z.selection
    UNION ALL SELECT 'paper_settlement_pending_review', 'paper_bet', paper_id FROM paper WHERE pending
    UNION ALL SELECT 'stale_or_future_live_quote', 'bout', bout_id FROM covered WHERE kind = 'live' AND quoted AND NOT fresh"""


@query(f"""{STORE}, found AS ({RULES})
    SELECT code, entity_type, id::VARCHAR AS entity_id, count(*) AS n FROM found GROUP BY ALL
    UNION ALL SELECT CASE kind WHEN 'past' THEN 'historical_quote_coverage_gap' ELSE 'live_quote_coverage_gap' END, 'database', 'all', 1 FROM covered GROUP BY kind HAVING count(*) > count(*) FILTER (WHERE fresh)""")
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue of the 48 codes, by the row that it is about (evidence left out; `audit_summary` counts by code)."""
    found = audit.issues(store(spark, sf_dir), AS_OF)
    return found.groupBy("code", "entity_type", "entity_id").agg(F.count("*").alias("n"))


@query(f"""{STORE}, found AS ({RULES}), every AS (SELECT code, id::VARCHAR AS entity_id FROM found UNION ALL SELECT CASE kind WHEN 'past' THEN 'historical_quote_coverage_gap' ELSE 'live_quote_coverage_gap' END, 'all' FROM covered GROUP BY kind HAVING count(*) > count(*) FILTER (WHERE fresh))
    SELECT code, code IN ('{"', '".join(audit.ERRORS)}') AS error, count(*) AS n, list_sort(list(DISTINCT entity_id))[1:5] AS first FROM every GROUP BY code""")
def audit_summary(spark, sf_dir):
    """The number of issues of each code, and the first five ids; only the list is cut."""
    return audit.report(audit.issues(store(spark, sf_dir), AS_OF), 5).select("code", (F.col("severity") == "error").alias("error"), "n", "first")
