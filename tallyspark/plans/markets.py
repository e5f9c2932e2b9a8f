"""Quotes, markets, gates, stakes and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins, market
from ..operators import ledger as ledger_chain
from ..sources import odds
from .domain import QUOTES, quotes, table
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


@query(f"""WITH {QUOTES}, m AS (SELECT book, receipt, list(DISTINCT price) FILTER (WHERE side = 'click') AS pa, list(DISTINCT price) FILTER (WHERE side = 'view') AS pb FROM quotes WHERE side IN ('click', 'view') AND price > 1 GROUP BY ALL)
    SELECT book, receipt, pa[1] AS price_a, pb[1] AS price_b, round((1 / pa[1]) / (1 / pa[1] + 1 / pb[1]), 6) AS p_a, round(1 / pa[1] + 1 / pb[1] - 1, 6) + 0.0 AS overround FROM m WHERE len(pa) = 1 AND len(pb) = 1""")
def two_sided_no_vig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets with one price on each side, and the probability without margin."""
    q = quotes(spark, sf_dir).where("side in ('click', 'view') and price > 1")
    return joins.two_sided(q, ["book", "receipt"], "side", "price", ("click", "view")).select("book", "receipt", "price_a", "price_b", F.round("p_a", 6).alias("p_a"), r6("overround", "overround"))


@query(f"""WITH {QUOTES}, l AS (SELECT *, row_number() OVER (PARTITION BY book, side ORDER BY ts DESC, quote_id DESC) AS r FROM quotes WHERE price > 1),
    v AS (SELECT * FROM l WHERE r = 1 AND ts >= TIMESTAMP '2024-01-25'), e AS (SELECT side, book, quote_id, price, 0.3 * price - 1 AS ev FROM v)
    SELECT side, arg_max(quote_id, (ev, quote_id)) AS quote_id, round(max(ev), 6) AS ev FROM e GROUP BY side""")
def best_quote(spark, sf_dir):
    """Only the newest quote of a book and side counts, and only if it is fresh; then the best value."""
    q = quotes(spark, sf_dir).where("price > 1")
    w = Window.partitionBy("book", "side").orderBy(F.desc("ts"), F.desc("quote_id"))
    new = q.withColumn("r", F.row_number().over(w)).where("r = 1 and ts >= timestamp_ntz '2024-01-25 00:00:00'").withColumn("ev", market.expected_value(F.lit(0.3), F.col("price")))
    return new.groupBy("side").agg(F.max_by("quote_id", F.struct("ev", "quote_id")).alias("quote_id"), F.round(F.max("ev"), 6).alias("ev"))


@query(f"""WITH {QUOTES}, d AS (SELECT quote_id, book, ts, price FROM quotes WHERE side = 'purchase' AND price > 1), c AS (SELECT d.quote_id, max((q.ts, q.quote_id, q.price)) AS last FROM d JOIN quotes q ON q.book = d.book AND q.side = 'click' AND q.price > 1 AND q.ts > d.ts AND q.ts < TIMESTAMP '2024-01-30' GROUP BY 1)
    SELECT d.quote_id, last[3] AS closing, round(d.price / last[3] - 1, 6) + 0.0 AS clv FROM d JOIN c USING (quote_id)""")
def closing_line(spark, sf_dir):
    """The last quote of the same book before the start, if it is later than the decision. The start is one time for
    all, so each book has one closing quote and no decision meets all quotes."""
    q = quotes(spark, sf_dir).where("price > 1 and ts < timestamp_ntz '2024-01-30 00:00:00'")
    close = q.where("side = 'click'").groupBy("book").agg(F.max(F.struct("ts", "quote_id", "price")).alias("last"))
    d = quotes(spark, sf_dir).where("side = 'purchase' and price > 1").select("quote_id", "book", "ts", "price")
    return d.join(close, "book").where("last.ts > ts").select("quote_id", F.col("last.price").alias("closing"), r6(market.closing_value(F.col("price"), F.col("last.price")), "clv"))


@query(f"""WITH {QUOTES}, m AS (SELECT book, receipt, avg(price) FILTER (WHERE side = 'click') AS c, avg(price) FILTER (WHERE side = 'view') AS v FROM quotes WHERE price > 1 GROUP BY ALL)
    SELECT book, receipt, round(c / (c + v), 6) AS market_p, coalesce(abs(c / (c + v) - 0.5) > 0.2, false) AS disagrees FROM m""")
def market_guard(spark, sf_dir):
    """A missing market disagrees with nothing."""
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("price")))
    m = quotes(spark, sf_dir).where("price > 1").groupBy("book", "receipt").agg(mean("click").alias("c"), mean("view").alias("v"))
    p = F.col("c") / (F.col("c") + F.col("v"))
    return m.select("book", "receipt", F.round(p, 6).alias("market_p"), market.disagreement(p, F.lit(0.5), 0.2).alias("disagrees"))


@query(f"""WITH {QUOTES}, r AS (SELECT book, quote_id, price, row_number() OVER (PARTITION BY book ORDER BY price DESC, quote_id) AS r, (book % 3) * 40.0 AS used FROM quotes WHERE side = 'purchase')
    SELECT book, quote_id, CAST(greatest(least(25.0, 100.0 - used - (r - 1) * 25.0), 0.0) AS DOUBLE) AS stake FROM r WHERE greatest(least(25.0, 100.0 - used - (r - 1) * 25.0), 0.0) > 1e-10""")
def paper_allocation(spark, sf_dir):
    """Stakes in priority order under a cap for each and one for the event."""
    q = quotes(spark, sf_dir).where("side = 'purchase'").withColumn("used", (F.col("book") % 3) * 40.0)
    return market.allocate(q, "book", [F.desc("price"), F.col("quote_id")], 25.0, 100.0, "used").select("book", "quote_id", "stake")


LEDGER = """ledger AS (SELECT o_orderkey AS id, o_custkey % 50 AS account, CAST(o_orderdate AS DATE) AS settled_on, round(o_totalprice / 1000, 2) AS stake,
    CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'lost' ELSE 'open' END AS status, 1.5 + (o_orderkey % 20) / 10.0 AS odds FROM orders)"""


def ledger(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "won").when(F.col("o_orderstatus") == "O", "lost").otherwise("open")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("account"), F.to_date("o_orderdate").alias("settled_on"), F.round(F.col("o_totalprice") / 1000, 2).alias("stake"), status.alias("status"), (F.lit(1.5) + (F.col("o_orderkey") % 20) / 10.0).cast("double").alias("odds"))


@query(f"""WITH {LEDGER} SELECT account, count(*) AS n, count(*) FILTER (WHERE status = 'open') AS open_n, round(sum(stake), 2) AS staked, round(coalesce(sum(stake) FILTER (WHERE status = 'open'), 0), 2) AS exposure,
    round(sum(CASE status WHEN 'won' THEN stake * odds - stake WHEN 'lost' THEN -stake END), 2) AS profit, round(sum(CASE status WHEN 'won' THEN stake * odds - stake WHEN 'lost' THEN -stake END) / nullif(sum(stake) FILTER (WHERE status <> 'open'), 0), 6) AS roi FROM ledger GROUP BY account""")
def ledger_rollup(spark, sf_dir):
    """Stakes, exposure, profit and return of each account."""
    rows = ledger(spark, sf_dir)
    profit = F.when(F.col("status") != "open", market.payout(F.col("status"), F.col("stake"), F.col("odds")) - F.col("stake"))
    settled = F.sum(F.when(F.col("status") != "open", F.col("stake")))
    return rows.groupBy("account").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("open_n"), F.round(F.sum("stake"), 2).alias("staked"), F.round(F.coalesce(F.sum(F.when(F.col("status") == "open", F.col("stake"))), F.lit(0.0)), 2).alias("exposure"), F.round(F.sum(profit), 2).alias("profit"), F.round(F.sum(profit) / F.nullif(settled, F.lit(0)), 6).alias("roi"))


@query(f"""WITH {LEDGER} SELECT id, CASE WHEN status <> 'open' AND settled_on > DATE '1997-01-01' THEN 'unsettled_as_of' ELSE status END AS seen,
    CASE WHEN settled_on <= DATE '1997-01-01' THEN round(CASE status WHEN 'won' THEN stake * odds WHEN 'lost' THEN 0.0 END, 4) END AS payout FROM ledger""")
def ledger_as_of(spark, sf_dir):
    """What was not settled yet at the time is not shown as settled."""
    later = F.col("settled_on") > F.lit("1997-01-01").cast("date")
    paid = market.payout(F.col("status"), F.col("stake"), F.col("odds"))
    return ledger(spark, sf_dir).select("id", F.when((F.col("status") != "open") & later, "unsettled_as_of").otherwise(F.col("status")).alias("seen"), F.when(~later, F.round(paid, 4)).alias("payout"))


@query("""SELECT event_id, CASE WHEN value IS NULL THEN 'missing_price' WHEN value <= 1 THEN 'invalid_price' WHEN ts > TIMESTAMP '2024-01-25' THEN 'future' WHEN ts < TIMESTAMP '2024-01-05' THEN 'stale' WHEN event_type = 'view' THEN 'no_side' ELSE 'ok' END AS reason,
    CASE WHEN ts > TIMESTAMP '2024-01-25' THEN 'invalid' WHEN ts < TIMESTAMP '2024-01-05' THEN 'stale' ELSE 'fresh' END AS freshness FROM events""")
def gate_reasons(spark, sf_dir):
    """The first rule that holds gives the reason."""
    at = lambda s: F.expr(f"timestamp_ntz '{s} 00:00:00'")
    ts, v = F.col("ts"), F.col("value")
    rules = [("missing_price", v.isNull()), ("invalid_price", v <= 1), ("future", ts > at("2024-01-25")), ("stale", ts < at("2024-01-05")), ("no_side", F.col("event_type") == "view")]
    return table(spark, sf_dir, "events").select("event_id", market.gate(rules).alias("reason"), market.gate([("invalid", ts > at("2024-01-25")), ("stale", ts < at("2024-01-05"))], "fresh").alias("freshness"))


@query("""SELECT event_id, CASE WHEN abs(epoch(TIMESTAMP '2024-01-20') - epoch(ts) - 168 * 3600) <= 3600 THEN 'T-168h' WHEN abs(epoch(TIMESTAMP '2024-01-20') - epoch(ts) - 24 * 3600) <= 1800 THEN 'T-24h'
    WHEN abs(epoch(TIMESTAMP '2024-01-20') - epoch(ts) - 2 * 3600) <= 600 THEN 'T-2h' END AS slot FROM events WHERE slot IS NOT NULL""")
def capture_slots(spark, sf_dir):
    """Quotes near fixed distances from the start."""
    left = F.unix_timestamp(F.lit("2024-01-20").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    slot = F.when(F.abs(left - 168 * 3600) <= 3600, "T-168h").when(F.abs(left - 24 * 3600) <= 1800, "T-24h").when(F.abs(left - 2 * 3600) <= 600, "T-2h")
    return table(spark, sf_dir, "events").select("event_id", slot.alias("slot")).where("slot is not null")


CHAIN = """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number, event_id || ':' || event_type AS payload FROM events),
    c AS (SELECT user_id, event_id, number, payload, repeat('0', 64) AS previous, sha256(repeat('0', 64) || '|' || payload) AS entry FROM e WHERE number = 1
        UNION ALL SELECT e.user_id, e.event_id, e.number, e.payload, c.entry, sha256(c.entry || '|' || e.payload) FROM c JOIN e ON e.user_id = c.user_id AND e.number = c.number + 1),
    bent AS (SELECT user_id, event_id, number, CASE WHEN event_id % 97 = 5 THEN 'bent' ELSE payload END AS payload, CASE WHEN event_id % 83 = 7 THEN sha256('x') ELSE previous END AS previous, entry FROM c WHERE event_id % 89 <> 3),
    v AS (SELECT *, lag(number) OVER (PARTITION BY user_id ORDER BY number) AS before_number, lag(entry) OVER (PARTITION BY user_id ORDER BY number) AS before FROM bent)"""


@query(f"""{CHAIN} SELECT user_id, event_id, number, entry AS entry_sha256, CASE WHEN number <> coalesce(before_number, 0) + 1 THEN 'gap' WHEN previous <> coalesce(before, repeat('0', 64)) THEN 'broken_link' WHEN entry <> sha256(previous || '|' || payload) THEN 'wrong_digest' END AS problem FROM v""")
def chain_verification(spark, sf_dir):
    """Ledgers are built, then some payloads and links are bent and some entries taken out, and each entry is verified: its
    number, the link to the digest of the entry before it, and its own digest."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("payload"))
    entries = ledger_chain.chained(rows, "user_id", ["ts", "event_id"]).where("event_id % 89 <> 3")
    entries = entries.withColumn("payload", F.when(F.col("event_id") % 97 == 5, "bent").otherwise(F.col("payload"))).withColumn("previous_sha256", F.when(F.col("event_id") % 83 == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("previous_sha256")))
    return ledger_chain.verify(entries, "user_id").select("user_id", "event_id", "number", "entry_sha256", "problem")


@query("""WITH e AS (SELECT *, event_id % 11 AS c FROM events)
    SELECT event_id, 'book ' || user_id AS book, round(value, 2) AS home_price, round(value + 0.5, 2) AS away_price FROM e WHERE c NOT IN (1, 2, 3, 4, 5) AND round(value, 2) > 1""")
def odds_import(spark, sf_dir):
    """Price documents as a feed sends them (events, books, markets, outcomes, some of them one-sided, three-way, of another market, updated after
    the capture or without a zone), flattened to usable two-sided markets."""
    c, price = F.col("event_id") % 11, F.round("value", 2)
    one = lambda name, x: F.struct(F.lit(name).alias("name"), x.cast("double").alias("price"))
    home, away, draw = one("Home", price), one("Away", F.round(F.col("value") + 0.5, 2)), one("Draw", F.lit(9.0))
    outcomes = F.when(c == 1, F.array(home)).when(c == 2, F.array(home, away, draw)).otherwise(F.array(home, away))
    updated = F.when(c == 4, "2024-03-01T12:00:00Z").when(c == 5, "2024-02-01T12:00:00").otherwise("2024-02-01T12:00:00Z")
    markets = F.array(F.struct(F.when(c == 3, "totals").otherwise("h2h").alias("key"), updated.alias("last_update"), outcomes.alias("outcomes")))
    books = F.array(F.struct(F.concat(F.lit("book "), F.col("user_id").cast("string")).alias("key"), updated.alias("last_update"), markets.alias("markets")))
    event = F.struct(F.col("event_id").cast("string").alias("id"), F.lit("Home").alias("home_team"), F.lit("Away").alias("away_team"), F.lit("2024-03-02T00:00:00Z").alias("commence_time"), books.alias("bookmakers"))
    captures = table(spark, sf_dir, "events").select(F.to_json(F.array(event)).alias("payload"), F.lit("2024-02-01T13:00:00Z").alias("captured_at"))
    return odds.head_to_head(captures).select(F.col("id").cast("long").alias("event_id"), "book", "home_price", "away_price")


@query(f"""WITH {QUOTES}, d AS (SELECT quote_id, price, 0.5::DOUBLE + 0.001::DOUBLE * (quote_id % 400) AS p, 0.01::DOUBLE * (quote_id % 7) AS drift FROM quotes WHERE price > 1)
    SELECT quote_id, floor((p * price - 1) * 10000 + 0.5) / 10000 AS ev, floor((p * (price - drift) - 1) * 10000 + 0.5) / 10000 AS conservative_ev, floor(1 / p * 10000 + 0.5) / 10000 AS break_even FROM d""")
def conservative_value(spark, sf_dir):
    """Expected value, the same after the price has drifted, and the price that breaks even."""
    q, p = quotes(spark, sf_dir).where("price > 1"), 0.5 + 0.001 * (F.col("quote_id") % 400)
    drifted = F.col("price") - 0.01 * (F.col("quote_id") % 7)
    r4 = lambda x: F.floor(x * 10_000 + 0.5) / 10_000
    return q.select("quote_id", r4(market.expected_value(p, F.col("price"))).alias("ev"), r4(market.expected_value(p, drifted)).alias("conservative_ev"), r4(1 / p).alias("break_even"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') IS NOT NULL AS valid FROM events""")
def json_flatten(spark, sf_dir):
    """Typed fields out of JSON text."""
    k = F.from_json("props", "k long").getField("k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), k.isNotNull().alias("valid"))
