"""Decisions about scored contests: what a score allows, which alert passes the gate, what a reader may be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import market


def probability(p: Column) -> Column:
    """Whether p is a finite number between 0 and 1; false for null."""
    return F.coalesce(~F.isnan(p) & p.between(0, 1), F.lit(False))


def gap(model: Column, book: Column) -> Column:
    """Distance of two probabilities; null where there is no market or one of them is no probability."""
    return F.when(probability(model) & probability(book), F.abs(model - book))


def decide(rows: DataFrame, replay: Column, min_profit: float = 0.03, max_gap: float = 0.10) -> DataFrame:
    """M19. rows (model_p, market_p of the first side; selection_p, price, quote_id of the best quote, null without one) with
    market_gap, expected_profit, break_even and decision: the market disagrees, a replay of an old cutoff, a candidate, or no."""
    profit = market.expected_value(F.col("selection_p"), F.col("price"))
    quoted = F.col("quote_id").isNotNull()
    decision = market.gate(
        [("pass_market_disagreement", F.coalesce(gap(F.col("model_p"), F.col("market_p")) > max_gap, F.lit(False))), ("research_only", replay & quoted), ("candidate", quoted & (profit >= min_profit)), ("pass", quoted)],
        "no_quote",
    )
    return rows.select("*", gap(F.col("model_p"), F.col("market_p")).alias("market_gap"), profit.alias("expected_profit"), (1 / F.col("price")).alias("break_even"), decision.alias("decision"))


def alert_gate(rows: DataFrame, max_age: float = 60.0, drift: float = 0.05, min_edge: float = 0.03, max_gap: float = 0.10) -> DataFrame:
    """P18, C20. rows (now, snapshot_at, starts_at, as_of, captured_at, updated_at as timestamps, null where unusable; decision, model_p, market_p,
    quote_id, book, selection_p, price) with the first reason that holds, and for prices that pass it so far the price less its drift and its profit. All
    conditions are columns of the row itself: the gate is a projection and shuffles nothing."""
    if max_age <= 0 or drift < 0 or min_edge < 0 or not 0 <= max_gap <= 1:
        raise ValueError("limits of the gate are out of range")
    c, missing = F.col, lambda *names: F.greatest(*[F.col(n).isNull() for n in names])
    p, price, given = c("selection_p"), c("price") - drift, c("market_p").isNotNull()
    age = lambda name: F.unix_micros("now") - F.unix_micros(name) > max_age * 1e6
    profit = p * price - 1
    ordered = (c("updated_at") <= c("captured_at")) & (c("captured_at") <= c("as_of")) & (c("as_of") <= c("now")) & (c("now") < c("starts_at"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rules = [
        ("invalid_reference_time", missing("now", "snapshot_at", "starts_at")),
        ("event_started", c("now") >= c("starts_at")),
        ("invalid_market_probability", given & ~(probability(c("model_p")) & probability(c("market_p")))),
        ("pass_market_disagreement", (gap(c("model_p"), c("market_p")) > max_gap) | c("decision").eqNullSafe("pass_market_disagreement")),
        ("not_model_candidate", ~c("decision").eqNullSafe("candidate")),
        ("missing_quote", missing("quote_id", "book")),
        ("invalid_row_time", missing("as_of", "captured_at", "updated_at")),
        ("different_snapshot", c("captured_at") != c("snapshot_at")),
        ("invalid_time_order", ~ordered),
        ("stale_data", age("as_of") | age("captured_at") | age("updated_at")),
        ("invalid_probability", ~finite(p) | ~((p > 0) & (p < 1))),
        ("invalid_odds", ~finite(c("price")) | (c("price") <= 1)),
        ("price_drift_exhausts_odds", price <= 1),
        ("edge_below_floor", profit < min_edge),
    ]
    out = rows.withColumn("alert_reason", market.gate(rules))
    priced = F.col("alert_reason").isin("ok", "edge_below_floor")
    return out.withColumns({"alert_eligible": F.col("alert_reason") == "ok", "conservative_price": F.when(priced, price), "conservative_profit": F.when(priced, profit)})


def availability(rows: DataFrame, as_of: Column, max_age: float, max_gap: float = 0.10) -> DataFrame:
    """P16. rows (event_provider, bout_provider, status, starts_at, predicted_at, model_p, market_p, quotes, fresh_quotes, gate_status) with
    `availability`: the first state that holds; a recorded gate check gives its own state."""
    closed = lambda name: ~F.coalesce(F.col(name), F.lit("scheduled")).isin("scheduled", "not_started")
    gate = F.col("gate_status")
    rules = [
        ("pass_market_disagreement", F.coalesce(gap(F.col("model_p"), F.col("market_p")) > max_gap, F.lit(False))),
        ("provider_status_blocked", closed("event_provider") | closed("bout_provider")),
        ("bout_not_scheduled", ~F.col("status").eqNullSafe("scheduled")),
        ("event_start_unavailable", F.col("starts_at").isNull()),
        ("event_started", F.lit(as_of) >= F.col("starts_at")),
        ("no_valid_prediction", F.col("predicted_at").isNull()),
        ("stale_prediction", F.unix_micros(F.lit(as_of)) - F.unix_micros("predicted_at") > max_age * 1e6),
        ("no_quote", F.coalesce(F.col("quotes"), F.lit(0)) == 0),
        ("no_verified_fresh_quote", F.coalesce(F.col("fresh_quotes"), F.lit(0)) == 0),
    ]
    state = market.gate(rules, "open")
    return rows.withColumn("availability", F.when(state != "open", state).when(gate.isNotNull(), F.concat(F.lit("gate_"), gate)).otherwise("requires_alert_gate"))
