"""Matchup context: the last earlier contests of both sides, nested, with what they measure and what was left out.

Every row is one side of a contest. Its history is the rows of the same participant at least `gap` days earlier: the target itself, others of its date
and the embargoed days before are counted as left out, never read. Held rows stay visible in the history and enter no figure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof, store
from .features import STYLE

FIGHTS = 5


REASONS = ("n", "no_count", "no_exposure", "above_exposure")


def figures(fights: int, counts: bool = True) -> dict[str, Column]:
    """Sums and (with counts) counts of every style metric over the eligible ones of a participant's last `fights` rows, this one included: num and den of the rows that count, n, and rows left
    out without a count, without an exposure, and with a count above the exposure. One sliding frame for all of them, no nested rows to go over again for each metric."""
    last = Window.partitionBy("fighter_id").orderBy("day", "bout_id").rowsBetween(1 - fights, 0)
    good = F.coalesce("eligible", F.lit(False))
    out = {}
    for i, m in enumerate(STYLE):
        num, den = F.expr(m.num).cast("double"), F.expr(m.den).cast("double")
        why = F.when(num.isNull(), 1).when(~F.coalesce(den > 0, F.lit(False)), 2).when((num > den) & F.expr(m.valid), 3).otherwise(0)
        out |= {f"num_{i}": F.sum(F.when(good & (why == 0), num)).over(last), f"den_{i}": F.sum(F.when(good & (why == 0), den)).over(last)}
        if counts:
            out |= {f"{k}_{i}": F.count_if(good & (why == reason)).over(last).cast("int") for reason, k in enumerate(REASONS)}
    return out


def style(found: str, counts: bool = True) -> Column:
    """The metrics of a struct of figures (null: no rows): name, value and, with counts, numerator, denominator, n, and rows left out by reason."""

    def metric(i: int, m) -> Column:
        of = lambda k: F.col(f"{found}.{k}_{i}")
        value = of("num") / of("den") * m.unit
        more = [of("num").alias("numerator"), of("den").alias("denominator"), *[F.coalesce(of(k), F.lit(0)).alias(k) for k in REASONS]] if counts else []
        return F.struct(F.lit(m.name).alias("name"), (1 - value if m.complement else value).alias("value"), *more)

    return F.array(*[metric(i, m) for i, m in enumerate(STYLE)])


def strengths(records: DataFrame) -> DataFrame:
    """bout_id, fighter_id, and the record (wins, losses, draws, no_contests) before the date, over eligible rows."""
    before = asof.earlier(["fighter_id"], "day")
    counts = {"wins": F.col("points") == 1, "losses": F.col("points") == 0, "draws": F.col("points") == 0.5, "no_contests": F.col("points").isNull()}
    return records.select("bout_id", "fighter_id", *[F.count_if(F.col("eligible") & c).over(before).alias(n) for n, c in counts.items()])


def opponents(records: DataFrame, ratings: DataFrame | None) -> DataFrame:
    """bout_id, fighter_id, opponent_id, day and `strength`, the opponent's record then (and rating), where the opponent has a row."""
    own = strengths(records)
    if ratings is not None:
        own = own.join(ratings, ["bout_id", "fighter_id"], "left")
    else:
        own = own.withColumn("rating", F.lit(None).cast("double"))
    other = own.select("bout_id", F.col("fighter_id").alias("opponent_id"), F.struct("wins", "losses", "draws", "no_contests", "rating").alias("strength")).dropDuplicates(["bout_id", "opponent_id"])
    return records.select("bout_id", "fighter_id", "opponent_id", "day").join(other, ["bout_id", "opponent_id"]).select("bout_id", "fighter_id", "opponent_id", "day", "strength")


def contexts(records: DataFrame, ratings: DataFrame | None = None, gap: int = 3, fights: int = FIGHTS, brief: bool = False) -> DataFrame:
    """bout_id, fighter_id, opponent_id, day, available (earlier contests), left_out (other contests of the embargo and the date), fights (the last ones, oldest
    first: bout_id, day, opponent_id, result, method, eligible, the opponent's record and, with ratings (bout_id, fighter_id, rating), rating then), eligible, style,
    methods (method, wins, losses, draws, no_contests over eligible ones) and the opponents' means. brief: fights without day, opponent_id and method, style without its counts, no methods.

    records: as operators.features reads them, with `eligible`; of a repeated (bout_id, fighter_id) each row is a contest of its own. They are read twice: a stored table is best. The opponents'
    records are a stored step of narrow rows, which then go to the participant along with the records, so that these are shuffled once."""
    told = store.stored(opponents(records, ratings), "strengths")
    rows = records.withColumn("_row", F.lit(True)).unionByName(told, allowMissingColumns=True).repartition("fighter_id")  # the rows go, not what is made of them below
    same = Window.partitionBy("fighter_id", "day", "bout_id", "opponent_id")
    rows = rows.withColumn("strength", F.max("strength").over(same)).where("_row")
    result = F.when(F.col("outcome").isin("draw", "no_contest"), F.col("outcome")).when(F.col("points") == 1, "win").when(F.col("points") == 0, "loss").otherwise("unknown")
    fight = F.struct("bout_id", *([] if brief else ["day", "opponent_id"]), result.alias("result"), *([] if brief else ["method"]), F.coalesce("eligible", F.lit(False)).alias("eligible"), "strength")
    order = Window.partitionBy("fighter_id").orderBy("day", "bout_id")
    rows = rows.withColumns({"_last": F.collect_list(fight).over(order.rowsBetween(1 - fights, 0))} | (sums := figures(fights, not brief)))
    past = asof.earlier(["fighter_id"], "day", gap)
    near = Window.partitionBy("fighter_id").orderBy("day").rangeBetween(1 - gap, 0)
    rows = rows.select(
        "bout_id", "fighter_id", "opponent_id", "day", F.count("*").over(past).alias("available"), (F.count("*").over(near) - 1).alias("left_out"),
        F.max_by(F.struct("_last", *sums), F.struct("day", "bout_id")).over(past).alias("_found"),
    )
    empty = F.array().cast(rows.schema["_found"].dataType["_last"].dataType)
    rows = rows.withColumn("_past", F.coalesce("_found._last", empty))
    good = F.filter("_past", lambda f: f["eligible"])
    known = F.filter(good, lambda f: F.coalesce(f["strength"]["wins"] + f["strength"]["losses"] + f["strength"]["draws"] > 0, F.lit(False)))
    rate = lambda f: (f["strength"]["wins"] + 0.5 * f["strength"]["draws"]) / (f["strength"]["wins"] + f["strength"]["losses"] + f["strength"]["draws"])
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs))
    means = [mean(F.transform(known, rate)).alias("opponent_win_rate"), mean(F.transform(F.filter(known, lambda f: f["strength"]["rating"].isNotNull()), lambda f: f["strength"]["rating"])).alias("opponent_rating")]
    shown = ["bout_id", "fighter_id", "opponent_id", "day", "available", "left_out", F.col("_past").alias("fights"), F.size(good).alias("eligible"), style("_found", not brief).alias("style")]
    if brief:
        return rows.select(*shown, *means)
    kinds = F.array_sort(F.array_distinct(F.transform(good, lambda f: F.coalesce(f["method"], F.lit("unknown")))))
    count = lambda k, r: F.size(F.filter(good, lambda f: (F.coalesce(f["method"], F.lit("unknown")) == k) & (f["result"] == r)))
    methods = F.transform(kinds, lambda k: F.struct(k.alias("method"), *[count(k, r).alias(n) for r, n in (("win", "wins"), ("loss", "losses"), ("draw", "draws"), ("no_contest", "no_contests"))]))
    return rows.select(*shown, methods.alias("methods"), *means)


def matchups(records: DataFrame, ratings: DataFrame | None = None, gap: int = 3, fights: int = FIGHTS) -> DataFrame:
    """bout_id, both sides' contexts as a and b (a has the lesser id), and `differences`: metric, a less b where both have a value."""
    pairs = paired(contexts(records, ratings, gap, fights))
    differences = F.zip_with("a.style", "b.style", lambda x, y: F.struct(x["name"].alias("name"), (x["value"] - y["value"]).alias("value")))
    return pairs.withColumn("differences", differences)


def paired(side: DataFrame) -> DataFrame:
    """bout_id, day, and what both sides' rows have besides, as a and b (a has the lesser id)."""
    one = F.struct("fighter_id", *[c for c in side.columns if c not in ("bout_id", "fighter_id", "opponent_id", "day")])
    first = F.col("fighter_id") < F.col("opponent_id")
    return side.groupBy("bout_id").agg(F.min("day").alias("day"), F.max_by(one, F.when(first, F.col("fighter_id"))).alias("a"), F.max_by(one, F.when(~first, F.col("fighter_id"))).alias("b"))
