"""Reviewed files of contests and dated observations: text rows checked one by one, each with the first rule it breaks.

Rows come as text (a file read with all columns as strings); blank cells count as missing. Every function returns all rows with `problem`
(null for a usable row), so that a caller may refuse a file with any problem or keep the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import market

STATUSES = ("scheduled", "completed", "cancelled")
OUTCOMES = ("win", "draw", "no_contest")
NEEDED = ("event_id", "event_name", "event_date", "event_status", "bout_id", "fighter_a_id", "fighter_a_name", "fighter_b_id", "fighter_b_name", "bout_status")
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.0+)?(Z|[+-]\d{2}:\d{2})$"


def cells(rows: DataFrame) -> DataFrame:
    """Text columns trimmed, blanks as nulls."""
    return rows.select(*[F.nullif(F.trim(F.col(n)), F.lit("")).alias(n) if t == "string" else F.col(n) for n, t in rows.dtypes])


def day(name: str) -> Column:
    return F.when(F.col(name).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(name).try_cast("date"))


def contests(rows: DataFrame) -> DataFrame:
    """event_date as a date, and the first rule broken: what is required, two participants, known states, a result where and only where the contest is over."""
    c, over = F.col, F.col("bout_status") == "completed"
    side = c("winner_fighter_id").eqNullSafe(c("fighter_a_id")) | c("winner_fighter_id").eqNullSafe(c("fighter_b_id"))
    rules = [
        ("event_date", day("event_date").isNull()),
        *[(f"{n}_required", c(n).isNull()) for n in NEEDED if n != "event_date"],
        ("same_participant", c("fighter_a_id") == c("fighter_b_id")),
        ("event_status", ~c("event_status").isin(*STATUSES)),
        ("bout_status", ~c("bout_status").isin(*STATUSES)),
        ("outcome", over & ~F.coalesce(c("outcome").isin(*OUTCOMES), F.lit(False))),
        ("winner_not_in_contest", over & (c("outcome") == "win") & ~side),
        ("winner_without_win", over & (c("outcome") != "win") & c("winner_fighter_id").isNotNull()),
        ("result_before_end", ~over & (c("outcome").isNotNull() | c("winner_fighter_id").isNotNull())),
    ]
    return cells(rows).withColumn("problem", F.nullif(market.gate(rules), F.lit("ok"))).withColumn("event_date", day("event_date"))


def stamped(rows: DataFrame, now: Column) -> tuple[DataFrame, list]:
    """`observed_at` as a timestamp, and the rules of when and where something was observed."""
    at = F.when(F.col("observed_at").rlike(STAMP), F.col("observed_at").try_cast("timestamp"))
    rules = [("observed_at", F.col("at").isNull()), ("observed_in_future", F.col("at") > now), ("evidence_required", F.col("source_evidence_uri").isNull())]
    return cells(rows).withColumn("at", at), rules


def settled(rows: DataFrame, key: list[str], values: list[str], stored: DataFrame | None) -> DataFrame:
    """The second pass over usable rows: rows of one key that differ are conflicts, as are rows that differ from what is stored; what is stored already is a
    repeat. Keys are settled by an aggregate that combines on the map side, so that one key or many unusable rows fill no task."""
    text = F.to_json(F.struct(*[F.coalesce(F.col(v).cast("string"), F.lit("")).alias(v) for v in values]))
    out = rows.withColumn("_value", text)
    found = out.where("problem is null").groupBy(*key).agg((F.min("_value") != F.max("_value")).alias("_differ"))
    if stored is not None:
        found = found.join(stored.select(*key, text.alias("_old")), key, "left")
    else:
        found = found.withColumn("_old", F.lit(None).cast("string"))
    rules = F.when(F.col("_differ"), "conflicting_rows").when(F.col("_old") != F.col("_value"), "conflicts_with_stored").when(F.col("_old").isNotNull(), "stored_already")
    return out.join(found, key, "left").withColumn("problem", F.coalesce(F.col("problem"), rules)).drop("_value", "_differ", "_old")


def profile_observations(rows: DataFrame, known: DataFrame, now: Column, stored: DataFrame | None = None) -> DataFrame:
    """Rows (fighter_id, observed_at, source_evidence_uri, birth_date, reach_cm) as typed columns with `problem`. `known` holds the participants (fighter_id);
    `stored` (fighter_id, at, source_evidence_uri, birth_date, reach_cm) never changes, so a row that differs from it is a conflict."""
    base, when = stamped(rows, now)
    reach = F.col("reach_cm").try_cast("double")
    people = known.select("fighter_id", F.lit(True).alias("_known")).distinct()
    rules = [
        ("fighter_id_required", F.col("fighter_id").isNull()), *when,
        ("birth_date", F.col("birth_date").isNotNull() & day("birth_date").isNull()),
        ("born_after_observation", day("birth_date") >= F.to_date("at")),
        ("reach_not_numeric", F.col("reach_cm").isNotNull() & reach.isNull()),
        ("reach_out_of_range", F.isnan(reach) | ~reach.between(100, 250)),
        ("no_value", F.col("birth_date").isNull() & F.col("reach_cm").isNull()),
        ("unknown_participant", F.col("_known").isNull()),
    ]
    checked = base.join(people, "fighter_id", "left").withColumn("problem", F.nullif(market.gate(rules), F.lit("ok"))).drop("_known")
    typed = checked.withColumns({"birth_date": day("birth_date"), "reach_cm": reach}).drop("observed_at")
    return settled(typed, ["fighter_id", "at"], ["source_evidence_uri", "birth_date", "reach_cm"], stored)


def stat_observations(rows: DataFrame, bouts: DataFrame, now: Column, stored: DataFrame | None = None) -> DataFrame:
    """Rows (bout_id, fighter_id, observed_at, source_evidence_uri, landed, attempted) as typed columns with `problem`. `bouts` (bout_id, a, b, over,
    event_date, starts_at): a count needs a finished contest of the participant, and an observation after its start, or on a later day where
    no start is known."""
    base, when = stamped(rows, now)
    count = lambda n: F.when(F.col(n).rlike("^[0-9]+$"), F.col(n).try_cast("long"))
    early = F.when(F.col("starts_at").isNotNull(), F.col("at") <= F.col("starts_at")).otherwise(F.to_date("at") <= F.col("event_date"))
    rules = [
        ("ids_required", F.col("bout_id").isNull() | F.col("fighter_id").isNull()), *when,
        ("landed", count("landed").isNull()), ("attempted", count("attempted").isNull()),
        ("landed_above_attempted", count("landed") > count("attempted")),
        ("no_finished_contest", ~F.coalesce(F.col("over") & F.col("fighter_id").isin(F.col("a"), F.col("b")), F.lit(False))),
        ("observed_too_early", early),
    ]
    checked = base.join(bouts.select("bout_id", "a", "b", "over", "event_date", "starts_at"), "bout_id", "left").withColumn("problem", F.nullif(market.gate(rules), F.lit("ok")))
    typed = checked.withColumns({n: count(n) for n in ("landed", "attempted")}).drop("observed_at", "a", "b", "over", "event_date", "starts_at")
    return settled(typed, ["bout_id", "fighter_id", "at"], ["source_evidence_uri", "landed", "attempted"], stored)
