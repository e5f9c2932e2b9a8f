"""Audit of an operating store: rows (severity, code, entity_type, entity_id, evidence) for everything that needs review.

Each table is read once with all its rules: a row meets the few parents that its rules ask about (by key, one row each), and emits an array of what holds.
Rules over groups are aggregates; pairs of contests meet only by an event and a shared participant. Nothing is capped: `report` counts every
issue and lists the first few of each code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, scalar

#: Provider states of what may be scored before it starts (null too), and the codes that are errors; others are warnings.
BEFORE = ("scheduled", "not_started")
ERRORS = (
    "foreign_key_violation", "empty_fighter_name", "invalid_event_date", "invalid_event_start", "invalid_roster_observation_time", "roster_observation_after_ingestion", "invalid_snapshot_event_start",
    "roster_snapshot_matchup_mismatch", "self_matchup", "completed_bout_missing_result", "result_on_noncompleted_bout", "active_bout_on_cancelled_event", "duplicate_active_matchup", "fighter_double_booked",
    "winner_not_in_bout", "nonbinary_result_has_winner", "invalid_result_timestamp", "quote_selection_not_in_bout", "invalid_quote_price", "invalid_quote_capture_time", "invalid_bookmaker_update_time",
    "invalid_prediction_timestamp", "prediction_before_feature_cutoff", "bet_bout_mismatch", "bet_selection_mismatch", "invalid_bet_timestamp", "paper_bout_mismatch", "paper_selection_mismatch",
)
#: Children and the parents that their columns must name (null names none): table, its id, column, parent, the parent's id.
FOREIGN = (
    ("bouts", "bout_id", "event_id", "events", "event_id"), ("bouts", "bout_id", "a", "fighters", "fighter_id"), ("bouts", "bout_id", "b", "fighters", "fighter_id"),
    ("results", "bout_id", "bout_id", "bouts", "bout_id"), ("results", "bout_id", "winner", "fighters", "fighter_id"), ("quotes", "quote_id", "bout_id", "bouts", "bout_id"),
    ("quotes", "quote_id", "selection", "fighters", "fighter_id"), ("predictions", "prediction_id", "bout_id", "bouts", "bout_id"), ("bets", "bet_id", "prediction_id", "predictions", "prediction_id"),
    ("bets", "bet_id", "quote_id", "quotes", "quote_id"), ("paper", "paper_id", "prediction_id", "predictions", "prediction_id"), ("paper", "paper_id", "quote_id", "quotes", "quote_id"),
    ("paper", "paper_id", "bout_id", "bouts", "bout_id"), ("cards", "card_id", "event_id", "events", "event_id"), ("cards", "card_id", "run_id", "runs", "run_id"),
    ("card_bouts", "row_id", "card_id", "cards", "card_id"), ("card_bouts", "row_id", "bout_id", "bouts", "bout_id"),
)


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def parent(df: DataFrame, key: str, **columns: str) -> DataFrame:
    """One row for each key (the least, where a key repeats) with renamed columns, so that a join never multiplies rows."""
    row = F.min(F.struct(*[F.col(c).alias(n) for n, c in columns.items()])).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, "_row.*")


def emitted(rows: DataFrame, entity: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """An issue for each rule that holds for a row; evidence is that row's columns as JSON."""
    columns = [F.col(c) for c in rows.columns if not c.startswith("_")]
    cells = [F.when(holds(c), F.lit(code)) for code, c in rules.items()]
    found = rows.select(F.col(key).cast("string").alias("entity_id"), F.array_compact(F.array(*cells)).alias("_codes"), F.to_json(F.struct(*columns)).alias("evidence")).where(F.size("_codes") > 0)
    return found.select(F.explode("_codes").alias("code"), F.lit(entity).alias("entity_type"), "entity_id", "evidence")


def substitutions(events_bouts: DataFrame) -> DataFrame:
    """Pairs of contests (x, y) of an event that share exactly one participant. Rows: event_id, bout_id, a, b, and a struct `facts` that both sides carry. Contests
    meet by (event, participant), which pairs with two shared ones do twice."""
    who = events_bouts.select("event_id", "bout_id", "facts", F.explode(F.array_distinct(F.array("a", "b"))).alias("who"))
    x, y = who.select("event_id", "who", F.col("bout_id").alias("x"), F.col("facts").alias("fx")), who.select("event_id", "who", F.col("bout_id").alias("y"), F.col("facts").alias("fy"))
    shared = x.join(y, ["event_id", "who"]).where("x <> y")
    return shared.groupBy("event_id", "x", "y").agg(F.count("*").alias("n"), F.min("fx").alias("fx"), F.min("fy").alias("fy")).where("n = 1")


def issues(t: dict[str, DataFrame], as_of: str, decision_hours: float = 24.0, quote_hours: float = 24.0) -> DataFrame:
    """t: fighters (fighter_id, name, source, source_id), events (event_id, event_date, start, status, provider_status), bouts (bout_id, event_id, a, b, status,
    provider_status), results (bout_id, outcome, winner, recorded), quotes (quote_id, bout_id, book, selection, price, updated, captured), predictions
    (prediction_id, bout_id, cutoff, generated), bets (bet_id, prediction_id, quote_id, selection, placed), paper (paper_id, prediction_id, quote_id, bout_id, selection,
    settlement), runs (run_id, fetched), cards (card_id, event_id, run_id, observed, basis, source_url, start), card_bouts (row_id, card_id, bout_id, a, b, status).

    Times are text and count only with a zone. as_of is when live quotes are judged. Of contests that repeat a pair in an event, or a participant among an event's scheduled
    ones, every one but the least id is an issue, with that id as evidence; names with equal letters are one issue, at the least id. Null ids are no rows of a parent."""
    now = F.lit(as_of).cast("timestamp")
    start = parent(t["events"], "event_id", event_status="status", event_provider="provider_status", event_start="start")
    start = start.withColumn("_start", scalar.utc(F.col("event_start")))
    both = parent(t["bouts"], "bout_id", bout_event="event_id", bout_a="a", bout_b="b", bout_status="status", bout_provider="provider_status")
    known = both.join(start.select(F.col("event_id").alias("bout_event"), "event_status", "event_provider", "event_start", "_start"), "bout_event", "left")
    out = []

    for child, key, column, table, parent_key in FOREIGN:
        keys = t[table].select(F.col(parent_key).alias("_k")).where("_k is not null").distinct()
        lone = t[child].where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_k"), "left_anti")
        out.append(lone.select(F.lit("foreign_key_violation").alias("code"), F.lit(child).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), F.to_json(F.struct(F.lit(column).alias("column"), F.col(column).cast("string").alias("value"), F.lit(table).alias("parent"))).alias("evidence")))

    fighters = t["fighters"].withColumn("_key", names.bare_key(F.col("name")))
    out.append(emitted(fighters, "fighter", "fighter_id", {"empty_fighter_name": F.coalesce(F.col("_key"), F.lit("")) == "", "unstable_fighter_id": (F.coalesce("source", F.lit("")) == "") | (F.coalesce(F.col("source_id").cast("string"), F.lit("")) == "")}))
    same = fighters.where("_key <> ''").groupBy("_key").agg(F.count("*").alias("n"), F.min("fighter_id").alias("first"), F.max("fighter_id").alias("last")).where("n > 1")
    out.append(emitted(same, "fighter", "first", {"ambiguous_fighter_name": F.lit(True)}))

    provider = lambda c: F.col(c).isNotNull() & ~F.col(c).isin(*BEFORE)
    shown = t["cards"].select("event_id").where("event_id is not null").distinct().withColumn("_shown", F.lit(True))
    events = t["events"].join(shown, "event_id", "left").withColumn("_start", scalar.utc(F.col("start")))
    iso = F.col("event_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(F.col("event_date"), "yyyy-MM-dd").isNotNull()
    out.append(emitted(events, "event", "event_id", {
        "event_provider_status_needs_review": (F.col("status") == "scheduled") & provider("provider_status"), "invalid_event_date": ~F.coalesce(iso, F.lit(False)), "missing_event_start": F.col("start").isNull() & (F.col("status") != "cancelled"),
        "invalid_event_start": F.col("start").isNotNull() & F.col("_start").isNull(), "scheduled_event_start_passed": (F.col("status") == "scheduled") & (F.col("_start") <= now), "missing_card_snapshot": F.col("_shown").isNull(),
    }))

    cards = t["cards"].join(parent(t["runs"], "run_id", fetched="fetched"), "run_id", "left").withColumn("_seen", scalar.utc(F.col("observed"))).withColumn("_got", scalar.utc(F.col("fetched"))).withColumn("_start", scalar.utc(F.col("start")))
    out.append(emitted(cards, "card_snapshot", "card_id", {
        "missing_roster_observation_time": F.col("observed").isNull(), "invalid_roster_observation_time": F.col("observed").isNotNull() & F.col("_seen").isNull(),
        "roster_observation_after_ingestion": F.col("_seen").isNotNull() & (F.col("_got").isNull() | (F.col("_seen") > F.col("_got"))),
        "roster_observation_source_missing": (F.col("basis") == "reviewed_csv") & F.col("_seen").isNotNull() & (F.coalesce("source_url", F.lit("")) == ""),
        "invalid_snapshot_event_start": F.col("start").isNotNull() & F.col("_start").isNull(), "roster_observed_at_or_after_start": F.col("_seen") >= F.col("_start"),
    }))

    rows = t["card_bouts"].join(parent(t["cards"], "card_id", event_id="event_id", observed="observed"), "card_id").join(both.select("bout_id", "bout_event", "bout_a", "bout_b"), "bout_id", "left")
    out.append(emitted(rows, "card_snapshot", "row_id", {"roster_snapshot_matchup_mismatch": F.col("bout_a").isNotNull() & ~(F.col("bout_event").eqNullSafe(F.col("event_id")) & F.col("bout_a").eqNullSafe(F.col("a")) & F.col("bout_b").eqNullSafe(F.col("b")))}))
    stories = rows.groupBy("event_id", "bout_id").agg(
        F.min(F.struct("row_id", "a", "b")).alias("first"),
        F.struct(F.max((F.col("status") == "cancelled").cast("int")).alias("cancelled"), F.max((F.col("status") != "cancelled").cast("int")).alias("active"), F.min(F.when(F.col("status") == "scheduled", scalar.utc(F.col("observed")))).alias("seen")).alias("facts"),
    )
    pairs = substitutions(stories.select("event_id", "bout_id", F.col("first.a").alias("a"), F.col("first.b").alias("b"), "facts")).where("x < y")
    dated = F.coalesce(F.col("fx.seen") != F.col("fy.seen"), F.lit(False))
    pairs = pairs.where((holds(F.col("fx.cancelled") == 1) & holds(F.col("fy.active") == 1)) | (holds(F.col("fy.cancelled") == 1) & holds(F.col("fx.active") == 1)) | dated).select("event_id", "x", "y", dated.alias("dated"))
    out.append(emitted(pairs, "event", "event_id", {"roster_possible_opponent_substitution": F.lit(True)}))

    told = parent(t["results"], "bout_id", outcome="outcome", winner="winner").withColumn("_told", F.lit(True))
    bouts = t["bouts"].join(start.select("event_id", "event_status"), "event_id", "left").join(told, "bout_id", "left")
    out.append(emitted(bouts, "bout", "bout_id", {
        "bout_provider_status_needs_review": (F.col("status") == "scheduled") & provider("provider_status"), "self_matchup": F.col("a").eqNullSafe(F.col("b")),
        "completed_bout_missing_result": (F.col("status") == "completed") & F.col("_told").isNull(), "result_on_noncompleted_bout": (F.col("status") != "completed") & F.col("_told").isNotNull(),
        "active_bout_on_cancelled_event": (F.col("event_status") == "cancelled") & (F.col("status") != "cancelled"), "scheduled_bout_on_completed_event": (F.col("event_status") == "completed") & (F.col("status") == "scheduled"),
    }))
    active = t["bouts"].where("status <> 'cancelled'").select("event_id", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "bout_id")
    out.append(emitted(beyond_first(active, ["event_id", "low", "high"]), "bout", "bout_id", {"duplicate_active_matchup": F.lit(True)}))
    booked = bouts.where("event_status = 'scheduled' and status = 'scheduled'").select("event_id", "bout_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("who"))
    out.append(emitted(beyond_first(booked, ["event_id", "who"]), "bout", "bout_id", {"fighter_double_booked": F.lit(True)}))
    swapped = substitutions(t["bouts"].select("event_id", "bout_id", "a", "b", F.struct(F.col("status").alias("status")).alias("facts"))).where("fx.status = 'cancelled' and fy.status <> 'cancelled'").select("event_id", F.col("x").alias("cancelled"), F.col("y").alias("active"))
    out.append(emitted(swapped, "event", "event_id", {"possible_opponent_substitution": F.lit(True)}))

    results = t["results"].join(both.select("bout_id", "bout_a", "bout_b"), "bout_id", "left")
    out.append(emitted(results, "bout", "bout_id", {
        "winner_not_in_bout": F.col("bout_a").isNotNull() & (F.col("outcome") == "win") & ~holds((F.col("winner") == F.col("bout_a")) | (F.col("winner") == F.col("bout_b"))),
        "nonbinary_result_has_winner": (F.col("outcome") != "win") & F.col("winner").isNotNull(), "invalid_result_timestamp": scalar.utc(F.col("recorded")).isNull(),
    }))

    quotes = t["quotes"].join(known, "bout_id", "left").withColumn("_captured", scalar.utc(F.col("captured"))).withColumn("_updated", scalar.utc(F.col("updated")))
    chosen = holds((F.col("selection") == F.col("bout_a")) | (F.col("selection") == F.col("bout_b")))
    fair = holds((F.col("price") > 1) & (F.col("price") < float("inf")))  # NaN is greater than any number
    out.append(emitted(quotes, "quote", "quote_id", {
        "quote_selection_not_in_bout": F.col("bout_a").isNotNull() & ~chosen, "invalid_quote_price": ~fair, "invalid_quote_capture_time": F.col("_captured").isNull(),
        "invalid_bookmaker_update_time": F.col("updated").isNotNull() & F.col("_updated").isNull(), "bookmaker_update_after_capture": F.col("_updated") > F.col("_captured"), "quote_after_event_start": F.col("_captured") >= F.col("_start"),
    }))

    predictions = t["predictions"].join(known, "bout_id", "left").withColumn("_cutoff", scalar.utc(F.col("cutoff"))).withColumn("_generated", scalar.utc(F.col("generated")))
    out.append(emitted(predictions, "prediction", "prediction_id", {
        "invalid_prediction_timestamp": F.col("_cutoff").isNull() | F.col("_generated").isNull(), "prediction_before_feature_cutoff": F.col("_cutoff") > F.col("_generated"), "prediction_after_event_start": F.col("_cutoff") >= F.col("_start"),
    }))

    said, priced = parent(t["predictions"], "prediction_id", said_bout="bout_id"), parent(t["quotes"], "quote_id", quote_bout="bout_id", quote_selection="selection")
    bets = t["bets"].join(said, "prediction_id", "left").join(priced, "quote_id", "left")
    out.append(emitted(bets, "bet", "bet_id", {"bet_bout_mismatch": F.col("said_bout") != F.col("quote_bout"), "bet_selection_mismatch": F.col("selection") != F.col("quote_selection"), "invalid_bet_timestamp": scalar.utc(F.col("placed")).isNull()}))
    paper = t["paper"].join(said, "prediction_id", "left").join(priced, "quote_id", "left")
    out.append(emitted(paper, "paper_bet", "paper_id", {
        "paper_bout_mismatch": holds(F.col("said_bout") != F.col("bout_id")) | holds(F.col("quote_bout") != F.col("bout_id")), "paper_selection_mismatch": F.col("selection") != F.col("quote_selection"), "paper_settlement_pending_review": F.col("settlement") == "pending_review",
    }))

    cover = coverage(t, quotes.withColumn("_good", chosen & fair), known, told, now, decision_hours, quote_hours)
    out.append(emitted(cover.where("_kind = 'live' and not fresh and quoted").select("bout_id"), "bout", "bout_id", {"stale_or_future_live_quote": F.lit(True)}))
    counts = cover.groupBy("_kind").agg(F.count("*").alias("contests"), F.count_if("fresh").alias("with_quote")).where("contests > with_quote")
    for kind, code in (("past", "historical_quote_coverage_gap"), ("live", "live_quote_coverage_gap")):
        out.append(emitted(counts.where(F.col("_kind") == kind).withColumn("all", F.lit("all")), "database", "all", {code: F.lit(True)}))

    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    severity = F.when(F.col("code").isin(*ERRORS), "error").otherwise("warning")
    return every.select(severity.alias("severity"), "code", "entity_type", "entity_id", "evidence")


def beyond_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, bout_id) whose key has a lesser bout_id, with it as `first`; found by an aggregate, so that a frequent key is no sort."""
    first = rows.groupBy(*keys).agg(F.min("bout_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, keys).where("bout_id <> first")


def coverage(t: dict[str, DataFrame], quotes: DataFrame, known: DataFrame, told: DataFrame, now: Column, decision_hours: float, quote_hours: float) -> DataFrame:
    """Contests that a quote should cover, `past` (won, with a known start: at the start less the decision hours) and `live` (scheduled and not started: now), with
    whether any quote is there, whether one is fresh, and whether a book has fresh ones for both sides."""
    hours = lambda h: F.expr(f"interval {int(h * 3600)} seconds")
    rows = known.join(told.select("bout_id", "outcome"), "bout_id", "left")
    past = holds((F.col("bout_status") == "completed") & (F.col("outcome") == "win") & F.col("_start").isNotNull())
    allowed = lambda c: F.col(c).isNull() | F.col(c).isin(*BEFORE)
    live = holds((F.col("event_status") == "scheduled") & (F.col("bout_status") == "scheduled")) & allowed("event_provider") & allowed("bout_provider") & (F.col("_start").isNull() | (F.col("_start") > now))
    rows = rows.withColumn("_kind", F.when(past, "past").when(live, "live")).where("_kind is not null")
    rows = rows.select("bout_id", "_kind", "bout_a", "bout_b", F.when(F.col("_kind") == "past", F.col("_start") - hours(decision_hours)).otherwise(now).alias("_limit"))
    q = quotes.select("bout_id", "book", "selection", "_good", "_captured", "_updated", "updated").join(rows, "bout_id")
    on_time = lambda c: (F.col(c) <= F.col("_limit")) & (F.col(c) >= F.col("_limit") - hours(quote_hours))
    fresh = holds(F.col("_good") & on_time("_captured") & (F.col("_updated").isNull() | (F.col("_updated") <= F.col("_captured"))) & (F.col("updated").isNull() | on_time("_updated")))
    by_book = q.groupBy("bout_id", "book").agg(F.max(fresh.cast("int")).alias("fresh"), F.max((fresh & (F.col("selection") == F.col("bout_a"))).cast("int")).alias("on_a"), F.max((fresh & (F.col("selection") == F.col("bout_b"))).cast("int")).alias("on_b"))
    found = by_book.groupBy("bout_id").agg(F.max("fresh").alias("fresh"), F.max(F.col("on_a") * F.col("on_b")).alias("two_sided"))
    return rows.join(found, "bout_id", "left").select("_kind", "bout_id", F.col("fresh").isNotNull().alias("quoted"), (F.coalesce("fresh", F.lit(0)) == 1).alias("fresh"), (F.coalesce("two_sided", F.lit(0)) == 1).alias("two_sided"))


def report(found: DataFrame, listed: int = 20, parts: int = 64) -> DataFrame:
    """severity, code, n (every issue) and the first `listed` entity ids of each code in order of their text: first of each of `parts` shares of a
    code's ids, then of those, so that no task sorts all ids of a frequent code. Counts and lists both read the ids with their numbers, which are shuffled once."""
    every = found.groupBy("severity", "code", "entity_id").agg(F.count("*").alias("k"))
    ids = every.where("k > 0").select("code", "entity_id")  # as in the counts, so that the exchange is the same
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("entity_id"))
    ids = ids.withColumn("_part", F.pmod(F.xxhash64("entity_id"), F.lit(parts))).withColumn("_r", place("code", "_part")).where(F.col("_r") <= listed)
    first = ids.withColumn("_r", place("code")).where(F.col("_r") <= listed)
    lists = first.groupBy("code").agg(F.sort_array(F.collect_list("entity_id")).alias("first"))
    return every.groupBy("severity", "code").agg(F.sum("k").alias("n")).join(lists, "code").select("severity", "code", "n", "first")
