"""From the raw archive to usable contests, their facts, and gaps for all that is held back; nothing is dropped."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, scalar
from .metrics import all_or_null
from .store import forget, stored

NAMESPACE = "stats"
PAIRED = ("sig", "total", "td", "head", "body", "leg", "distance", "clinch", "ground")
SINGLE = ("kd", "sub_attempts", "reversals")
#: The 22 statistics of a round.
STATS = tuple(f"{p}_{s}" for p in PAIRED for s in ("landed", "attempted")) + SINGLE + ("control_seconds",)


def profiles(raw: DataFrame, host: str) -> DataFrame:
    return raw.select(scalar.identity(F.col("url"), host, "fighter-details", NAMESPACE).alias("fighter_id"), F.trim("fighter").alias("name"), names.plain_name_key(F.col("fighter")).alias("name_key"), scalar.reach_cm(F.col("reach")).alias("reach_cm")).where("fighter_id is not null")


def events(raw: DataFrame, host: str) -> DataFrame:
    return raw.select(F.trim("event").alias("event"), scalar.identity(F.col("url"), host, "event-details", NAMESPACE).alias("event_id"), scalar.date(F.trim("date")).alias("event_date"))


def rounds(raw: DataFrame) -> DataFrame:
    """One row for each (event, bout, fighter_key, number) with its parsed statistics, the list of errors, how many raw rows said it, and `bad`: no round number,
    fighter or significant strikes, or raw rows with other values. Rows are dealt out by (event, bout), which later steps by contest follow; repeats are settled by an
    aggregate that combines on the map side, so a row that stands there a million times is one row."""
    out = raw.withColumn("number", F.regexp_extract("round", r"^Round (\d+)$", 1).try_cast("int")).withColumn("fighter_key", names.plain_name_key(F.col("fighter")))
    missing = F.col("number").isNull() | F.col("fighter_key").isNull() | (F.col("fighter_key") == "") | F.col("sig").isNull()
    texts = ["kd", "sub_attempts", "reversals", "control", *PAIRED]
    said = F.struct(*texts)
    one = out.groupBy("event", "bout", "fighter_key", "number").agg(F.min(said).alias("_said"), F.max(said).alias("_other"), F.max(missing).alias("_missing"), F.count("*").alias("copies"))
    out = one.select("event", "bout", "fighter_key", "number", "copies", (F.col("_missing") | ~F.col("_said").eqNullSafe(F.col("_other"))).alias("bad"), "_said.*")
    errors = []
    for p in PAIRED:
        out = out.withColumn(f"_{p}", scalar.counts(F.col(p)))
        errors.append(F.when(F.col(f"_{p}.error").isNotNull(), F.concat(F.lit(f"{p}:"), F.col(f"_{p}.error"))))
    over = F.coalesce(F.col("_sig.landed") > F.col("_total.landed"), F.lit(False))
    errors.append(F.when(over, "sig:above_total"))
    pairs = [F.when(~over, value).alias(name) if p == "sig" else value.alias(name) for p in PAIRED for s in ("landed", "attempted") for name, value in [(f"{p}_{s}", F.col(f"_{p}.{s}"))]]
    return out.select("event", "bout", "fighter_key", "number", "copies", "bad", *pairs, *[scalar.number(F.col(s)).alias(s) for s in SINGLE], scalar.seconds(F.col("control")).alias("control_seconds"), F.array_compact(F.array(*errors)).alias("errors"))


def summaries(parsed: DataFrame) -> DataFrame:
    """What the rounds under each (event, bout) say: their participants (two at most are told apart), the rounds of each, and a digest of all values."""
    value = F.xxhash64("fighter_key", "number", *STATS).cast("decimal(20,0)")
    each = parsed.groupBy("event", "bout", "fighter_key").agg(F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.max("bad").alias("bad"), F.sum(value).alias("digest"))
    return each.groupBy("event", "bout").agg(
        F.count("*").alias("sides"), F.min("fighter_key").alias("one"), F.max("fighter_key").alias("two"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("bad").alias("bad"), F.sum("digest").alias("digest"),
    )


def contests(raw_results: DataFrame, people: DataFrame, days: DataFrame, told: DataFrame, host: str) -> DataFrame:
    """Every contest (by its address), usable or held, with `source_event`: the first of its events that has its rounds."""
    kept = ["bout", "outcome", "weightclass", "round", "time", "time_format"]
    rows = raw_results.select(scalar.identity(F.col("url"), host, "fight-details", NAMESPACE).alias("bout_id"), F.trim("event").alias("event"), *kept).where("bout_id is not null")
    mark = F.xxhash64(*kept)
    alias = rows.groupBy("bout_id", "event").agg(*[F.min(c).alias(c) for c in kept], F.min(mark).alias("_low"), F.max(mark).alias("_high"), F.count("*").alias("copies"))
    # an event's name may stand for several events
    day = days.groupBy("event").agg(F.min(F.struct("event_id", "event_date")).alias("_first"), F.max(F.struct("event_id", "event_date")).alias("_last"), F.max(F.col("event_id").isNull() | F.col("event_date").isNull()).alias("_unknown"))
    alias = alias.join(day, "event", "left").join(told, ["event", "bout"], "left")
    has, first = F.col("sides").isNotNull(), F.struct("event_id", "event_date")
    both = alias.groupBy("bout_id").agg(
        *[F.min(c).alias(c) for c in kept], (F.min("_low") != F.max("_high")).alias("conflict"), F.sum("copies").alias("copies"), F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.max(F.coalesce("_unknown", F.lit(True))).alias("unknown"),
        F.min(F.when(has, F.col("event"))).alias("source_event"), F.min("sides").alias("fewest_sides"), F.max("sides").alias("most_sides"), F.min("one").alias("one"), F.max("one").alias("one_again"), F.min("two").alias("two"), F.max("two").alias("two_again"),
        F.min("fewest").alias("fewest"), F.max("most").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("bad").alias("bad"), F.min("digest").alias("digest"), F.max("digest").alias("digest_again"),
    )
    both = both.withColumn("names", scalar.sides(F.col("bout"))).withColumn("key_a", names.plain_name_key(F.get("names", F.lit(0)))).withColumn("key_b", names.plain_name_key(F.get("names", F.lit(1))))
    one = people.groupBy("name_key").agg(F.count("*").alias("n"), F.min("fighter_id").alias("fighter_id"))
    for side in ("a", "b"):
        both = both.join(one.select(F.col("name_key").alias(f"key_{side}"), F.col("n").alias(f"n_{side}"), F.col("fighter_id").alias(side)), f"key_{side}", "left")
    both = both.withColumn("winner", scalar.winner_side(F.col("outcome"))).withColumn("finish", F.col("round").try_cast("int"))
    # every event that has rounds must hold both participants in rounds 1 to the finish, and all of them the same values
    same = (F.col("one") == F.col("one_again")) & (F.col("two") == F.col("two_again")) & (F.col("digest") == F.col("digest_again"))
    pair = (F.least("key_a", "key_b") == F.col("one")) & (F.greatest("key_a", "key_b") == F.col("two"))
    whole = (F.col("fewest") == F.col("finish")) & (F.col("most") == F.col("finish")) & (F.col("low") == 1) & (F.col("high") == F.col("finish"))
    complete = ~F.col("bad") & (F.col("fewest_sides") == 2) & (F.col("most_sides") == 2) & same & pair & whole
    rules = [
        ("conflicting_duplicate_url", F.col("conflict")),
        ("unknown_or_ambiguous_event", F.col("unknown") | (F.col("_first") != F.col("_last"))),
        ("unknown_or_ambiguous_fighter", ~(F.col("n_a").eqNullSafe(1) & F.col("n_b").eqNullSafe(1)) | (F.col("a") == F.col("b"))),
        ("unsupported_outcome", F.col("winner").isNull()),
        ("missing_or_conflicting_rounds", ~F.coalesce(complete, F.lit(False))),
    ]
    reason = reduce(lambda rest, r: F.when(r[1], r[0]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
    duration = scalar.elapsed(F.col("finish"), F.col("time"), F.col("time_format"))
    out = both.select("bout_id", "_first.event_id", "_first.event_date", "a", "b", "winner", "weightclass", "finish", duration.alias("duration"), "copies", reason.alias("reason"), "source_event", "bout", "key_a", "key_b")
    return out.withColumn("status", F.when(F.col("reason").isNull(), "usable").otherwise("held"))


def build(raw_events: DataFrame, raw_results: DataFrame, raw_rounds: DataFrame, raw_profiles: DataFrame, host: str, keep: Callable[[DataFrame, str], DataFrame] = stored) -> dict[str, DataFrame]:
    """fighters, contests, facts (a row for each side of a usable contest), round_facts and gaps.

    A contest is held with the first reason that holds: conflicting_duplicate_url, unknown_or_ambiguous_event,
    unknown_or_ambiguous_fighter, unsupported_outcome, missing_or_conflicting_rounds. Totals are null where any round's value
    is; control time above the duration is null; an unknown schedule leaves counts and gives no duration. Each source is read and parsed once: `keep` stores the parsed
    rounds and every result as a table, and what follows reads that."""
    people = keep(profiles(raw_profiles, host), "fighters")
    parsed = stored(rounds(raw_rounds), "rounds")
    known = keep(contests(raw_results, people, events(raw_events, host), summaries(parsed), host), "contests")
    usable = known.where("status = 'usable'")
    mine = parsed.drop("copies", "bad").join(usable.select("bout_id", F.col("source_event").alias("event"), "bout", "duration", "a", "b", "key_a", "key_b"), ["event", "bout"])
    side = F.when(F.col("fighter_key") == F.col("key_a"), F.col("a")).when(F.col("fighter_key") == F.col("key_b"), F.col("b"))
    round_facts = keep(mine.select("bout_id", side.alias("fighter_id"), "number", *STATS, "errors", "duration"), "round_facts")
    forget(parsed)
    totals = round_facts.groupBy("bout_id", "fighter_id", "duration").agg(*[all_or_null(s).alias(s) for s in STATS])
    totals = keep(totals.withColumn("control_seconds", F.when(F.col("control_seconds") <= F.coalesce("duration", F.lit(1 << 40)), F.col("control_seconds"))), "facts")
    held, late = F.col("status") == "held", F.col("duration").isNull()
    gaps = known.where(held | late).select(F.lit("contest").alias("kind"), "bout_id", F.when(~held, "duration").alias("field"), F.when(held, F.col("reason")).otherwise("unknown_schedule_or_time").alias("reason"))
    gone = F.filter(F.array(*[F.struct(F.lit(s).alias("field"), F.col(s).isNull().alias("gone")) for s in STATS]), lambda x: x["gone"])
    lost = totals.select("bout_id", F.explode(F.transform(gone, lambda x: x["field"])).alias("field"))
    gaps = keep(gaps.unionByName(lost.select(F.lit("fact").alias("kind"), "bout_id", "field", F.lit("missing_component").alias("reason"))), "gaps")
    return {"fighters": people, "contests": known, "round_facts": round_facts, "facts": totals, "gaps": gaps}
