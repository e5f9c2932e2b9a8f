"""Feature vectors of contests from what both sides did on earlier dates.

Records have a row for each side of a contest: bout_id, fighter_id, opponent_id, day, event_id, points (1, 0.5 or 0; null for no contest),
elapsed seconds, method, and statistics of the side and (under o_...) of its opponent. Everything is a window by participant or
opponent, or a regrouping by contest; metrics are declared as ratios.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof, store


@dataclass(frozen=True)
class Ratio:
    """(sum of num + prior * weight / unit) / (sum of den + weight) * unit over the rows where `valid` holds; complement: 1 less that. All
    are SQL expressions over a record. `counted` says which valid rows make the metric observed; differences are divided by scale."""

    name: str
    num: str
    den: str
    valid: str
    prior: float
    weight: float
    unit: float = 1.0
    scale: float = 1.0
    complement: bool = False
    counted: str = "true"

    def value(self, num: Column, den: Column) -> Column:
        out = (num + self.prior * self.weight / self.unit) / (den + self.weight) * self.unit
        return 1 - out if self.complement else out

    def measures(self) -> list[Column]:
        valid = F.expr(self.valid)
        return [F.when(valid, F.expr(self.num)).cast("double").alias(f"{self.name}_num"), F.when(valid, F.expr(self.den)).cast("double").alias(f"{self.name}_den"), F.when(valid & F.expr(self.counted), 1.0).alias(f"{self.name}_n")]


def rate(name: str, num: str, prior: float, unit: float, scale: float) -> Ratio:
    return Ratio(name, num, "elapsed / 60", f"{num} is not null and elapsed > 0", prior, 30.0, unit, scale)


def accuracy(name: str, num: str, den: str, prior: float, weight: float, complement: bool = False) -> Ratio:
    return Ratio(name, num, den, f"{num} <= {den}", prior, weight, 1.0, 0.25, complement, f"{den} > 0")


def share(name: str, num: str, prior: float) -> Ratio:
    return Ratio(name, num, "sig_attempted", f"sig_attempted > 0 and {num} <= sig_attempted", prior, 50.0, 1.0, 0.25)


def finish(name: str, method: str, points: int, prior: float) -> Ratio:
    return Ratio(name, f"case when method = '{method}' and points = {points} then 1 else 0 end", "1", COMBAT, prior, 4.0, 1.0, 0.25)


#: Methods that end a contest in combat, priors, weights and scales of the metrics.
COMBAT = "points in (0, 1) and method in ('ko_tko', 'submission', 'decision', 'decision_unanimous', 'decision_split', 'decision_majority')"
RECENT = (
    rate("sig_landed_per_minute", "sig_landed", 3.0, 1.0, 5.0),
    rate("sig_absorbed_per_minute", "o_sig_landed", 3.0, 1.0, 5.0),
    accuracy("sig_accuracy", "sig_landed", "sig_attempted", 0.5, 50.0),
    accuracy("sig_defence", "o_sig_landed", "o_sig_attempted", 0.5, 50.0, True),
    rate("knockdowns_per_15", "kd", 0.1, 15.0, 1.0),
    rate("takedowns_per_15", "td_landed", 1.0, 15.0, 3.0),
    accuracy("takedown_accuracy", "td_landed", "td_attempted", 0.4, 10.0),
    accuracy("takedown_defence", "o_td_landed", "o_td_attempted", 0.4, 10.0, True),
    rate("submission_attempts_per_15", "sub_attempts", 0.5, 15.0, 2.0),
    Ratio("control_share", "control_seconds", "elapsed", "elapsed > 0 and control_seconds <= elapsed", 0.25, 1800.0, 1.0, 0.5),
)
CONTEXT = (
    share("clinch_share", "clinch_attempted", 0.10),
    share("ground_share", "ground_attempted", 0.15),
    share("body_share", "body_attempted", 0.20),
    share("leg_share", "leg_attempted", 0.15),
    rate("takedown_attempts_per_15", "td_attempted", 2.5, 15.0, 5.0),
    finish("ko_win_share", "ko_tko", 1, 0.15),
    finish("ko_loss_share", "ko_tko", 0, 0.15),
    finish("submission_win_share", "submission", 1, 0.10),
    finish("submission_loss_share", "submission", 0, 0.10),
    Ratio("opponent_win_rate", "o_rate", "1", "o_rate is not null", 0.5, 2.0, 1.0, 0.25),
)
OPPONENT_ELO = Ratio("opponent_elo", "o_elo", "1", "o_rate is not null", 1500.0, 2.0, 1.0, 400.0)
#: Names of the vectors: 13 differences, the 11 without coverage flags but with the age hinge, 10 recent metrics, 11 context metrics twice.
COVERAGE = ("known_age", "known_reach", "known_accuracy")
BASE = ("elo", "log_contests", "win_rate", "rest_years", "known_rest", "form", "age", "known_age", "reach", "known_reach", "adjusted_accuracy", "known_accuracy", "log_stat_contests")
REDUCED = (*[n for n in BASE if n not in COVERAGE], "age_decline")
#: What each participant's style is described by: own or the opponent's counts over attempts or time, without shrinkage.
STYLE = (
    *[Ratio(f"{x}_share", f"{x}_attempted", "sig_attempted", "true", 0.0, 0.0) for x in ("distance", "clinch", "ground", "head", "body", "leg")],
    Ratio("striking_accuracy", "sig_landed", "sig_attempted", "true", 0.0, 0.0),
    Ratio("takedown_accuracy", "td_landed", "td_attempted", "true", 0.0, 0.0),
    *[Ratio(n, x, "elapsed", "false", 0.0, 0.0, u) for n, x, u in (("sig_landed_per_minute", "sig_landed", 60.0), ("sig_absorbed_per_minute", "o_sig_landed", 60.0), ("takedown_attempts_per_15", "td_attempted", 900.0), ("takedowns_per_15", "td_landed", 900.0), ("submission_attempts_per_15", "sub_attempts", 900.0), ("knockdowns_per_15", "kd", 900.0))],
    Ratio("striking_defence", "o_sig_landed", "o_sig_attempted", "true", 0.0, 0.0, complement=True),
    Ratio("takedown_defence", "o_td_landed", "o_td_attempted", "true", 0.0, 0.0, complement=True),
    Ratio("control_share", "control_seconds", "elapsed", "true", 0.0, 0.0),
)


def metrics_before(records: DataFrame, metrics: tuple[Ratio, ...], n: int = 5, gap: int = 3, keep: list[str] | None = None) -> DataFrame:
    """records (or their columns `keep`) with the value and the number of observations of each metric over the last n contests (whole boundary dates) at least `gap` days
    earlier: the embargo of two days before a contest."""
    keep = records.columns if keep is None else keep
    found = metric_arrays(records, metrics, keep, n, gap)
    return found.select(*keep, "n_last", *[F.get("metrics", F.lit(i)).alias(m.name) for i, m in enumerate(metrics)], *[F.get("metrics", F.lit(len(metrics) + i)).cast("long").alias(f"{m.name}_n") for i, m in enumerate(metrics)])


def metric_arrays(records: DataFrame, metrics: tuple[Ratio, ...], keep: list[str], n: int = 5, gap: int = 3, numbers: tuple[Ratio, ...] | None = None, shuffled: bool = False) -> DataFrame:
    """`metrics_before` as one array, `metrics`: all values, then the numbers of observations of all metrics (or of those in `numbers`). A wide row of columns costs more in every later
    step. shuffled: rows are by participant already (see `sums_before`)."""
    counted = [3 * i + 2 for i, m in enumerate(metrics) if numbers is None or m in numbers]

    def finish(sums: np.ndarray) -> np.ndarray:
        values = [m.value(sums[:, 3 * i], sums[:, 3 * i + 1]) for i, m in enumerate(metrics)]
        return np.column_stack([*values, sums[:, counted]])

    out = asof.sums_before(records, "fighter_id", "day", "bout_id", [c for m in metrics for c in m.measures()], n, gap, keep, finish, shuffled)
    return out.withColumnRenamed("_last", "metrics")


def style(records: DataFrame) -> DataFrame:
    """fighter_id, metric, value, numerator, denominator, n and why rows were left out, in one pass. A ratio needs a count, a positive exposure and (where
    `valid` says so: not for counts over time) a count of at most the exposure."""
    parts = []
    for m in STYLE:
        num, den = F.expr(m.num).cast("double"), F.expr(m.den).cast("double")
        exposed = num.isNotNull() & F.coalesce(den > 0, F.lit(False))
        over = exposed & (num > den) & F.expr(m.valid)
        ok = exposed & ~over
        parts.append(F.struct(F.lit(m.name).alias("metric"), F.sum(F.when(ok, num)).alias("numerator"), F.sum(F.when(ok, den)).alias("denominator"), F.count_if(ok).alias("n"), F.count_if(num.isNull()).alias("no_count"), F.count_if(num.isNotNull() & ~F.coalesce(den > 0, F.lit(False))).alias("no_exposure"), F.count_if(over).alias("above_exposure"), F.lit(m.unit).alias("unit"), F.lit(m.complement).alias("complement")))
    rows = records.groupBy("fighter_id").agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).select("fighter_id", F.inline(F.array(*[f"p{i}" for i in range(len(parts))])))
    value = F.col("numerator") / F.nullif("denominator", F.lit(0.0)) * F.col("unit")
    return rows.select("fighter_id", "metric", F.when(F.col("complement"), 1 - value).otherwise(value).alias("value"), "numerator", "denominator", "n", "no_count", "no_exposure", "above_exposure")


def so_far(records: DataFrame) -> DataFrame:
    """records, shuffled by participant, with contests scored, points, day of the last one and recent form of each side before the date."""
    before = asof.earlier(["fighter_id"], "day")
    scored = F.col("points").isNotNull()
    rows = asof.last_rows(records.repartition("fighter_id"), "fighter_id", "day", ["event_id", "bout_id"], "points", 5, scored)
    rows = rows.withColumn("scored", F.count("points").over(before)).withColumn("total", F.coalesce(F.sum("points").over(before), F.lit(0.0)))
    rows = rows.withColumn("last_day", F.max(F.when(scored, F.col("day"))).over(before))
    return rows.withColumn("form", (F.aggregate("last", F.lit(0.0), lambda s, x: s + x) + 1) / (F.size("last") + 2)).drop("last")


#: Whether a contest counts for strike accuracies: it was scored and both sides' statistics show. The same for both sides.
SHOWN = "points is not null and sig_landed is not null and o_sig_landed is not null and sig_attempted > 0 and o_sig_attempted > 0"


def adjusted(rows: DataFrame) -> DataFrame:
    """rows with stat_n and adjusted instead of residual: the number and the shrunken mean of the side's earlier ones."""
    before = asof.earlier(["fighter_id"], "day")
    rows = rows.withColumn("stat_n", F.count("residual").over(before))
    return rows.withColumn("adjusted", F.coalesce(F.sum("residual").over(before), F.lit(0.0)) / (F.col("stat_n") + 2)).drop("residual")


def state(records: DataFrame) -> DataFrame:
    """records with what is known of each side before the date: contests scored, points, day of the last one, recent form, and the
    strike accuracy beyond what earlier opponents of the opponent had (which counts only what both sides' statistics show)."""
    rows, shown = so_far(records), F.expr(SHOWN)
    against = asof.earlier(["opponent_id"], "day")
    given = [F.coalesce(F.sum(F.when(shown, F.col(c))).over(against), F.lit(0.0)) for c in ("sig_landed", "sig_attempted")]
    return adjusted(rows.withColumn("residual", F.when(shown, F.col("sig_landed") / F.col("sig_attempted") - (given[0] + 1) / (given[1] + 2))))


def sides(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each contest: bout_id, day, and the columns of the side with the lesser id as `a`, of the other as `b`."""
    one = F.struct("fighter_id", *columns)
    first = F.col("fighter_id") < F.col("opponent_id")
    return rows.groupBy("bout_id").agg(F.min("day").alias("day"), F.max(F.when(first, one)).alias("a"), F.max(F.when(~first, one)).alias("b"))


def differences(pairs: DataFrame) -> dict[str, Column]:
    """The 13 differences a - b (and the age hinge) over what `sides` gives of `state`, elo, birth_day and reach_cm. Swapping the sides negates each."""
    diff = lambda f: f("a") - f("b")
    both = lambda c, x: F.when(F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNotNull(), x).otherwise(0.0)
    known = lambda c: diff(lambda s: F.col(f"{s}.{c}").isNotNull().cast("double"))
    rest = lambda s: F.when(F.col(f"{s}.last_day").isNotNull(), F.least(F.col("day") - F.col(f"{s}.last_day"), F.lit(730)) / 365.0).otherwise(0.0)
    age = lambda s: (F.col("day") - F.col(f"{s}.birth_day")) / 365.2425
    hinge = lambda s: F.greatest(age(s) - 32, F.lit(0.0))
    return {
        "elo": diff(lambda s: F.col(f"{s}.elo")) / 400,
        "log_contests": diff(lambda s: F.log1p(f"{s}.scored")),
        "win_rate": diff(lambda s: (F.col(f"{s}.total") + 1) / (F.col(f"{s}.scored") + 2)),
        "rest_years": diff(rest),
        "known_rest": known("last_day"),
        "form": diff(lambda s: F.col(f"{s}.form")),
        "age": both("birth_day", diff(age) / 10),
        "known_age": known("birth_day"),
        "reach": both("reach_cm", diff(lambda s: F.col(f"{s}.reach_cm")) / 20),
        "known_reach": known("reach_cm"),
        "adjusted_accuracy": diff(lambda s: F.col(f"{s}.adjusted")),
        "known_accuracy": diff(lambda s: (F.col(f"{s}.stat_n") > 0).cast("double")),
        "log_stat_contests": diff(lambda s: F.log1p(f"{s}.stat_n")),
        "age_decline": both("birth_day", diff(hinge) / 5),
    }


def vectors(records: DataFrame, ratings: DataFrame, strengths: DataFrame | None = None) -> DataFrame:
    """bout_id with the vectors `base` (13), `reduced` (11), `rich` (reduced and 10 recent metrics) and `whole` (rich and 11 context metrics, each with
    the difference of its being observed: 43). See `vector_parts`."""
    parts = vector_parts(records, ratings, strengths)
    return parts.select("bout_id", "base", "reduced", F.concat("reduced", "recent").alias("rich"), F.concat("reduced", "recent", "context").alias("whole"))


def vector_parts(records: DataFrame, ratings: DataFrame, strengths: DataFrame | None = None) -> DataFrame:
    """bout_id with what the vectors are made of: base (13), reduced (11), recent (10) and context (22). ratings (bout_id, elo_a, elo_b): ratings before the date; strengths (bout_id, strong_a,
    strong_b): those by whole dates, which describe past opponents (None: ratings has them too). Records also have birth_day and reach_cm. Records are read twice: a stored table is best.
    What is known of each side, then what follows from it for a contest, is stored on the way: the shuffles of a step end with it."""
    ids = ["bout_id", "fighter_id", "opponent_id", "day"]
    known = so_far(records.select(*ids, "event_id", "points", "sig_landed", "sig_attempted", "o_sig_landed", "o_sig_attempted", "birth_day", "reach_cm"))
    # what earlier opponents of the opponent had is what the opponent's own row lets through: it comes from there with the other figures of the opponent, and the rows are not shuffled by opponent
    before, shown = asof.earlier(["fighter_id"], "day"), F.expr(SHOWN)
    let = {f"let_{c}": F.coalesce(F.sum(F.when(shown, F.col(f"o_sig_{c}"))).over(before), F.lit(0.0)) for c in ("landed", "attempted")}
    known = known.select(*ids, "scored", "total", "last_day", "form", "birth_day", "reach_cm", F.when(shown, F.col("sig_landed") / F.col("sig_attempted")).alias("accuracy"), *[c.alias(n) for n, c in let.items()])
    mine = F.col("fighter_id") < F.col("opponent_id")
    rates = ratings if strengths is None else ratings.join(strengths, "bout_id")
    known = known.join(rates, "bout_id")
    known = known.withColumn("elo", F.when(mine, F.col("elo_a")).otherwise(F.col("elo_b"))).withColumn("o_elo", F.when(mine, F.col("strong_b")).otherwise(F.col("strong_a")))
    own = F.struct("fighter_id", "scored", "total", *let)
    two = Window.partitionBy("bout_id")
    other = F.when(mine, F.max(F.when(~mine, own)).over(two)).otherwise(F.max(F.when(mine, own)).over(two))
    known = known.withColumn("_other", other).withColumn("o_rate", F.when(F.col("_other.scored") > 0, F.col("_other.total") / F.col("_other.scored")))
    known = known.withColumn("residual", F.col("accuracy") - (F.col("_other.let_landed") + 1) / (F.col("_other.let_attempted") + 2))
    columns = ["elo", "scored", "total", "last_day", "form", "birth_day", "reach_cm"]
    kept = store.stored(known.select(*ids, *columns, "residual", "o_rate", "o_elo"), "known")
    # the metrics of the records' own statistics need no state: the wide rows meet none of the steps above
    every = (*RECENT, *CONTEXT, OPPONENT_ELO)
    late = [m for m in every if m.name in ("opponent_win_rate", "opponent_elo")]
    early = [m for m in every if m not in late]
    flagged = [m for m in early if m in CONTEXT]  # whether they were observed is a feature
    columns += ["adjusted", "stat_n"]
    pairs = sides(metric_arrays(adjusted(kept), tuple(late), [*ids, *columns], shuffled=True), [*columns, "metrics"])
    plain = sides(metric_arrays(records, tuple(early), ids, numbers=tuple(flagged)), ["metrics"])

    def of(m: Ratio) -> Column:
        at = (late if m in late else early).index(m)
        return (F.get("a.metrics", F.lit(at)) - F.get("b.metrics", F.lit(at))) / m.scale

    def seen(m: Ratio) -> Column:
        at = len(late) + late.index(m) if m in late else len(early) + flagged.index(m)
        observed = lambda s: (F.get(f"{s}.metrics", F.lit(at)) > 0).cast("double")
        return observed("a") - observed("b")

    d = differences(pairs)
    found = store.stored(pairs.select("bout_id", *[c.alias(n) for n, c in d.items()], *[x for i, m in enumerate(late) for x in (of(m).alias(f"_of_{i}"), seen(m).alias(f"_seen_{i}"))]), "differences")
    store.forget(kept)
    out = plain.select("bout_id", F.array(*map(of, RECENT)).alias("recent"), F.array(*[x for m in flagged for x in (of(m), seen(m))]).alias("_context")).join(found, "bout_id")
    context = F.concat("_context", F.array(*[f"_{c}_{i}" for i in range(len(late)) for c in ("of", "seen")]))  # the late ones are the last of the context metrics
    return out.select("bout_id", F.array(*BASE).alias("base"), F.array(*REDUCED).alias("reduced"), "recent", context.alias("context"))
