"""Prices: implied probability, expected value, disagreement, closing-line value, capped stakes, settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def no_vig(a: Column, b: Column) -> Column:
    return (1 / a) / (1 / a + 1 / b)


def expected_value(p: Column, odds: Column) -> Column:
    return p * odds - 1


def disagreement(market: Column, model: Column, threshold: float) -> Column:
    """Whether model and market differ by more than the threshold; false where there is no market."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie between 0 and 1")
    return F.coalesce(F.abs(market - model) > threshold, F.lit(False))


def closing_value(entry: Column, close: Column) -> Column:
    return entry / close - 1


def allocate(df: DataFrame, event: str, order: list[Column], cap: float, event_cap: float, used: str) -> DataFrame:
    """Stakes in priority order: each at most cap, all of an event at most event_cap less what is used already; stakes of
    at most 1e-10 are skipped. With equal caps the running rest has a closed form in the row number."""
    rank = F.row_number().over(Window.partitionBy(event).orderBy(*order))
    rest = F.lit(event_cap) - F.col(used) - (rank - 1) * F.lit(cap)
    return df.withColumn("stake", F.greatest(F.least(F.lit(cap), rest), F.lit(0.0))).where("stake > 1e-10")


def payout(status: Column, stake: Column, odds: Column) -> Column:
    return F.when(status == "won", stake * odds).when(status.isin("void", "push"), stake).when(status == "lost", F.lit(0.0))


def gate(rules: list[tuple[str, Column]], otherwise: str = "ok") -> Column:
    """The first rule that holds, in order."""
    out = F.lit(otherwise)
    for name, condition in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out
