"""Logistic forecasts from what was known at a time: many fits at once, temperature on reserved dates, versions, frozen selections.

Rows have bout_id, day, y (1 or 0; null where nothing was decided) and x, an array of differences. Fits are rounds of damped Newton steps; a round is
one pass over the rows for all fits that are still open. A task adds up gradient and Hessian of its rows for each fit, Spark adds up the tasks, and the
driver solves systems as wide as x. No row leaves its task.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import CLIP, MOST_DATES, binary_metrics, loss
from .store import files

ROWS = "bout_id", "day", "y", "x"
#: Penalty on the squared distance of a temperature from 1, its bounds, and the rows that it needs.
PULL, COOLEST, HOTTEST, LEAST_CALIBRATION = 0.002, 0.25, 4.0, 30


@dataclass(frozen=True)
class Fit:
    """Rows with first <= day < last and places `columns` of x. The mean log loss plus half l2 times the squared distance of the weights from
    `centre` is made least. through: weights of another fit, whose logit is then the only feature (a temperature)."""

    first: int
    last: int
    columns: tuple[int, ...]
    l2: float
    centre: float = 0.0
    through: tuple[float, ...] | None = None

    @property
    def width(self) -> int:
        return 1 if self.through else len(self.columns)


def temperature_of(fit: Fit, weights: np.ndarray, first: int, last: int) -> Fit:
    return Fit(first, last, fit.columns, 2 * PULL, 1.0, tuple(float(w) for w in weights))


def totals(rows: DataFrame, fits: dict[int, tuple[Fit, np.ndarray]]) -> dict[int, np.ndarray]:
    """By fit: number of rows, sum of the losses, gradient and Hessian (row by row) at these weights. One job."""

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            day, y = batch.column("day").to_numpy(), batch.column("y").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(batch), -1) if len(batch) else np.zeros((0, 0))
            for number, (fit, w) in fits.items():
                mine = (day >= fit.first) & (day < fit.last)
                if not mine.any():
                    continue
                z, label = x[mine][:, fit.columns], y[mine]
                if fit.through:
                    edge = np.log((1 - CLIP) / CLIP)
                    z = np.clip(z @ np.array(fit.through), -edge, edge)[:, None]
                score = z @ w
                each = np.maximum(score, 0) + np.log1p(np.exp(-np.abs(score))) - label * score
                p = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
                part = np.concatenate([[len(z), each.sum()], z.T @ (p - label), ((z.T * (p * (1 - p))) @ z).ravel()])
                found[number] = found.get(number, 0) + part
        sums = [v.tolist() for v in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(sums, pa.list_(pa.float64()))], ["fit", "sums"])

    parts = rows.select(F.col("day").cast("int").alias("day"), F.col("y").cast("double").alias("y"), F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "fit int, sums array<double>")
    out = {k: np.zeros(2 + f.width + f.width**2) for k, (f, _) in fits.items()}
    for number, at, value in parts.select("fit", F.posexplode("sums")).groupBy("fit", "pos").agg(F.sum("col")).collect():  # a row for each fit and number
        out[number][at] = value
    return out


def newton(rows: DataFrame, fits: list[Fit], tolerance: float = 1e-9, rounds: int = 100) -> list[tuple[int, np.ndarray]]:
    """(rows, weights) of each fit; without rows the weights stay at the centre. A step is halved until the objective doesn't rise."""
    now = [np.full(f.width, f.centre) for f in fits]
    best, step, trial, count = [np.inf] * len(fits), [None] * len(fits), [w.copy() for w in now], [0] * len(fits)
    share, open_fits = [1.0] * len(fits), set(range(len(fits)))
    for _ in range(rounds):
        if not open_fits:
            break
        for k, got in totals(rows, {k: (fits[k], trial[k]) for k in open_fits}).items():
            fit, n = fits[k], int(got[0])
            count[k] = n
            if n == 0:
                open_fits.discard(k)
                continue
            away = trial[k] - fit.centre
            value = got[1] / n + 0.5 * fit.l2 * float(away @ away)
            if value <= best[k] + 1e-13 * abs(value):
                now[k], best[k], share[k] = trial[k], value, 1.0
                gradient = got[2 : 2 + fit.width] / n + fit.l2 * away
                hessian = got[2 + fit.width :].reshape(fit.width, fit.width) / n + fit.l2 * np.eye(fit.width)
                step[k] = np.linalg.solve(hessian, gradient)
                if np.abs(gradient).max() < tolerance:
                    open_fits.discard(k)
                    continue
            else:
                share[k] /= 2
            if share[k] < 1e-8 or np.abs(share[k] * step[k]).max() < tolerance:
                open_fits.discard(k)
                continue
            trial[k] = now[k] - share[k] * step[k]
    return list(zip(count, now, strict=True))


def scales(rows: DataFrame, fits: list[Fit], tolerance: float = 1e-9) -> list[float]:
    """Temperatures (see `temperature_of`): the best within the bounds, as the objective is convex; 1 with too few rows."""
    return [1.0 if n < LEAST_CALIBRATION else float(min(HOTTEST, max(COOLEST, w[0]))) for n, w in newton(rows, fits, tolerance)]


def probability(x: Column, columns: tuple[int, ...], weights, scale: float = 1.0) -> Column:
    """The calibrated probability of side a, as an expression over x."""
    terms = F.array(*[F.get(x, F.lit(c)) * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)])
    edge = float(np.log((1 - CLIP) / CLIP))
    logit = F.greatest(F.least(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v), F.lit(edge)), F.lit(-edge))
    return 1 / (1 + F.exp(-F.lit(scale) * logit))


def fingerprint(rows: DataFrame) -> dict:
    """Number of the rows and a sum of their hashes, which doesn't depend on their order. x counts to nine decimals: sums of windows may differ beyond."""
    exact = F.xxhash64(F.col("bout_id").cast("string"), F.col("day").cast("int"), F.col("y").cast("double"), F.transform("x", lambda v: F.round(v, 9) + 0.0))
    n, total = rows.agg(F.count("*"), F.sum(exact.cast("decimal(38,0)"))).first()
    return {"rows": n, "hashes": str(total or 0)}


def digest(document: dict) -> str:
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def per_day(rows: DataFrame) -> list[tuple[int, int]]:
    """(day, rows) in order: at most a row for each date of three centuries."""
    found = rows.groupBy("day").agg(F.count("*").alias("n")).orderBy("day").limit(MOST_DATES + 1).collect()
    if len(found) > MOST_DATES:
        raise ValueError(f"more than {MOST_DATES} dates")
    return [(r.day, r.n) for r in found]


@dataclass(frozen=True)
class LiveRule:
    """What a forecast needs at least, and the share of rows that calibrate it."""

    rows: int = 100
    dates: int = 10
    training_rows: int = 50
    training_dates: int = 5
    calibration_rows: int = 30
    calibration_dates: int = 2
    calibration_share: float = 0.20
    l2: float = 0.02
    evidence: float = 1.0


def reserved_from(days: list[tuple[int, int]], rule: LiveRule) -> int:
    """The first day of the reserved tail: whole dates from the end until there are enough rows and dates in it."""
    rows, dates = sum(n for _, n in days), len(days)
    if rows < rule.rows or dates < rule.dates:
        raise ValueError(f"no forecast: {rule.rows} earlier decided contests on {rule.dates} dates are needed, there are {rows} on {dates}")
    wanted, have, kept = max(rule.calibration_rows, -(-rows * int(rule.calibration_share * 100) // 100)), 0, 0
    for day, n in reversed(days):
        if have >= wanted and kept >= rule.calibration_dates:
            break
        first, have, kept = day, have + n, kept + 1
    if rows - have < rule.training_rows or dates - kept < rule.training_dates or have < rule.calibration_rows or kept < rule.calibration_dates:
        raise ValueError(f"no forecast: the split leaves {rows - have} contests on {dates - kept} dates to train and {have} on {kept} to calibrate")
    return first


@dataclass(frozen=True)
class LiveRun:
    """Forecasts (bout_id, p) and what they rest on. The version changes with any row, weight or rule behind them."""

    forecasts: DataFrame
    weights: tuple[float, ...]
    scale: float
    version: str
    training: dict
    calibration: dict


def evidence_of(rows: DataFrame) -> tuple[int, int]:
    """Earlier results that the rows could use, and those that a source shows: each counts for every row that could use it."""
    available, observed = rows.agg(F.sum("available"), F.sum(F.coalesce("observed", F.lit(0)))).first()
    return available or 0, observed or 0


def live(history: DataFrame, targets: DataFrame, names: list[str], as_of: int, rule: LiveRule = LiveRule(), algorithm: str = "logistic") -> LiveRun:
    """Forecasts of the targets (bout_id, day, x) from contests decided before the day `as_of`. history is a stored table: it is read a few times.

    Rows without a result, and rows from `as_of` on, teach nothing and change nothing. A row that says (in `start`) that it began at or after as_of,
    although its day is earlier, stops the forecast, as do a target before as_of, too few rows, and (where history and targets have
    `available` and `observed`) earlier results without a source. Every such case is a ValueError."""
    if "start" in history.columns and history.where((F.col("day") < as_of) & (F.col("start") >= as_of)).limit(1).count():
        raise ValueError("no forecast: history holds a contest that began at or after the forecast")
    if targets.where(F.col("day") < as_of).limit(1).count():
        raise ValueError("no forecast: a target is earlier than the forecast")
    known = history.where((F.col("day") < as_of) & F.col("y").isNotNull())
    days = per_day(known)
    border = reserved_from(days, rule)
    training, calibration = known.where(F.col("day") < border), known.where(F.col("day") >= border)
    if "available" in history.columns:
        for part, rows in (("training", training), ("calibration", calibration), ("target", targets)):
            available, observed = evidence_of(rows)
            if not available or observed < rule.evidence * available:
                raise ValueError(f"no forecast: {observed} of {available} earlier results of the {part} rows have a source")
    fit = Fit(days[0][0], border, tuple(range(len(names))), rule.l2)
    _, weights = newton(known, [fit])[0]
    scale = scales(known, [temperature_of(fit, weights, border, as_of)])[0]
    parts = {"training": training, "calibration": calibration}
    facts = {k: {"dates": sum((d < border) == (k == "training") for d, _ in days), **fingerprint(v)} for k, v in parts.items()}
    facts["training"]["last"], facts["calibration"]["first"], facts["calibration"]["last"] = max(d for d, _ in days if d < border), border, days[-1][0]
    document = {"algorithm": algorithm, "names": names, "as_of": as_of, "rule": asdict(rule), **facts, "targets": fingerprint(targets.withColumn("y", F.lit(None).cast("double"))), "weights": [round(float(w), 9) for w in weights], "scale": round(scale, 7)}
    forecasts = targets.select("bout_id", probability(F.col("x"), fit.columns, weights, scale).alias("p"))
    return LiveRun(forecasts, tuple(map(float, weights)), scale, f"{algorithm}:{digest(document)[:16]}", facts["training"], facts["calibration"])


@dataclass(frozen=True)
class Candidate:
    """A policy that may be chosen: the places of x that it uses, its penalty, and how many years back it learns (None: from the earliest year on)."""

    name: str
    columns: tuple[int, ...]
    l2: float = 0.02
    lookback: int | None = None


@dataclass(frozen=True)
class Fold:
    """Contests with origin <= day < until are forecast. The last 15 % of the dates before origin (that the policy looks back to) calibrate."""

    name: str
    origin: int
    until: int


@dataclass(frozen=True)
class Protocol:
    """What is laid down before any candidate is tried. lookbacks: the day from which a policy with so many years learns at each fold."""

    version: str
    candidates: tuple[Candidate, ...]
    folds: tuple[Fold, ...]
    baseline: str
    tail: float = 0.15
    rules: dict = field(default_factory=dict, hash=False)

    def definitions(self) -> dict:
        return json.loads(json.dumps(asdict(self)))


def border_of(days: list[int], tail: float) -> int:
    if len(days) < 3:
        raise ValueError("a policy needs three earlier dates")
    return days[-max(1, int(len(days) * tail))]


def fitted(rows: DataFrame, protocol: Protocol, folds: tuple[Fold, ...], candidates: tuple[Candidate, ...]) -> list[dict]:
    """Weights and temperature of every candidate in every fold: all fits share the passes over the rows."""
    days = [d for d, _ in per_day(rows.where("y is not null"))]
    cells, fits, tails = [], [], []
    for c in candidates:
        for f in folds:
            low = days[0] if c.lookback is None else f.origin - int(c.lookback * 365.2425)
            eligible = [d for d in days if low <= d < f.origin]
            border = border_of(eligible, protocol.tail)
            cells.append({"candidate": c.name, "fold": f.name, "first": eligible[0], "border": border, "origin": f.origin, "until": f.until, "columns": c.columns})
            fits.append(Fit(eligible[0], border, c.columns, c.l2))
            tails.append((border, f.origin))
    known = rows.where("y is not null")
    weights = newton(known, fits)
    heat = scales(known, [temperature_of(f, w, *t) for f, (_, w), t in zip(fits, weights, tails, strict=True)])
    return [cell | {"training": n, "weights": [float(x) for x in w], "scale": s} for cell, (n, w), s in zip(cells, weights, heat, strict=True)]


def predicted(rows: DataFrame, cells: list[dict]) -> DataFrame:
    """bout_id, day, y, candidate, fold and p of every row that a fold forecasts; each row meets only the fold of its own day."""
    each = [F.when((F.col("day") >= c["origin"]) & (F.col("day") < c["until"]), F.struct(F.lit(c["candidate"]).alias("candidate"), F.lit(c["fold"]).alias("fold"), probability(F.col("x"), tuple(c["columns"]), c["weights"], c["scale"]).alias("p"))) for c in cells]
    return rows.where("y is not null").select("bout_id", "day", "y", F.inline(F.array_compact(F.array(*each))))


def scored(rows: DataFrame, cells: list[dict]) -> dict[str, dict]:
    """Number and pooled figures of each candidate over all folds; every candidate forecasts the same rows."""
    n, accuracy, brier, pooled = binary_metrics(F.col("p"), F.col("y"))
    found = predicted(rows, cells).groupBy("candidate").agg(n, accuracy, brier, pooled).collect()  # a row for each candidate
    return {r.candidate: {"n": r.n, "accuracy": round(r.accuracy, 9), "brier": round(r.brier, 9), "log_loss": round(r.log_loss, 9)} for r in found}


def chosen(protocol: Protocol, trials: dict[str, dict]) -> str:
    """The least pooled loss; of equal ones the candidate that was declared first."""
    return min(enumerate(protocol.candidates), key=lambda c: (trials[c[1].name]["log_loss"], c[0]))[1].name


def select(rows: DataFrame, protocol: Protocol) -> dict:
    """Every candidate is tried on the folds alone; what was found is a document that names its inputs and, as `sha256`, itself."""
    last = max(f.until for f in protocol.folds)
    seen = rows.where(F.col("day") < last)
    cells = fitted(seen, protocol, protocol.folds, protocol.candidates)
    trials = scored(seen, cells)
    if len({t["n"] for t in trials.values()}) != 1:
        raise ValueError("candidates forecast different rows")
    best = chosen(protocol, trials)
    document = {"protocol": protocol.definitions(), "inputs": fingerprint(seen), "labels_before": last, "folds": [{k: (round(v, 7) if k == "scale" else [round(x, 7) for x in v] if k == "weights" else v) for k, v in c.items()} for c in cells]}
    document |= {"trials": trials, "selected": best, "improved": trials[best]["log_loss"] < trials[protocol.baseline]["log_loss"]}
    document = json.loads(json.dumps(document))
    return document | {"sha256": digest(document)}


def freeze(spark, document: dict, root: str) -> str:
    """Write the document under its own digest, where nothing may be yet; the path. The same document again is the same file."""
    path = f"{root}/{document['sha256']}.json"
    at, system = files(spark, path)
    if not system.exists(at):
        out = system.create(at, False)  # fails where another writer was faster
        out.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        out.close()
    elif thaw(spark, path) != document:
        raise ValueError(f"{path} holds something else")
    return path


def thaw(spark, path: str) -> dict:
    return json.loads(bytes(spark.read.format("binaryFile").load(path).first().content))


def problems(document: dict, protocol: Protocol, rows: DataFrame | None = None, again: bool = False) -> list[str]:
    """What is wrong with a frozen selection: its digest, its protocol, its folds (which must not see the dates they forecast), its choice, its inputs
    where rows are given and, with `again`, what selecting once more finds."""
    out = []
    body = {k: v for k, v in document.items() if k != "sha256"}
    if digest(body) != document.get("sha256"):
        out.append("the content does not have its digest")
    if document.get("protocol") != protocol.definitions():
        out.append("another protocol")
    if any(not c["first"] < c["border"] < c["origin"] < c["until"] or c["until"] > document["labels_before"] for c in document["folds"]):
        out.append("a fold sees dates that it forecasts")
    if set(document["trials"]) != {c.name for c in protocol.candidates}:
        out.append("another search")
    else:
        best = chosen(protocol, document["trials"])
        if document["selected"] != best or document["improved"] is not (document["trials"][best]["log_loss"] < document["trials"][protocol.baseline]["log_loss"]):
            out.append("the choice does not follow from the trials")
    if rows is not None and fingerprint(rows.where(F.col("day") < document["labels_before"])) != document["inputs"]:
        out.append("the inputs have changed")
    if again and not out and select(rows, protocol)["sha256"] != document["sha256"]:
        out.append("selecting again finds something else")
    return out


def evaluated(rows: DataFrame, document: dict, protocol: Protocol, fixed: Fold, years: tuple[Fold, ...]) -> dict:
    """The frozen choice against the baseline, on a fixed later period and on yearly folds. Nothing is chosen here: the selection must verify, and its
    inputs must be as they were. The candidate is accepted if it was better when selected, has less loss on the fixed period and no less accuracy."""
    if wrong := problems(document, protocol, rows):
        raise ValueError("the selection does not verify: " + "; ".join(wrong))
    if fixed.origin < document["labels_before"]:
        raise ValueError("the fixed period begins among the labels of the selection")
    pair = tuple(c for c in protocol.candidates if c.name in (protocol.baseline, document["selected"]))
    report = {"selection": document["sha256"], "inputs": fingerprint(rows), "baseline": protocol.baseline, "selected": document["selected"]}
    for name, folds in (("fixed", (fixed,)), ("rolling", years)):
        cells = fitted(rows, protocol, folds, pair)
        report[name] = scored(rows, cells)
    base, own = report["fixed"][protocol.baseline], report["fixed"][document["selected"]]
    report["accepted"] = document["improved"] and own["log_loss"] < base["log_loss"] and own["accuracy"] >= base["accuracy"]
    report = json.loads(json.dumps(report))
    return report | {"sha256": digest(report)}


def paired(rows: DataFrame, day: str, y: str, baseline: str, candidate: str, cohort: str, repeats: int = 2000, seed: int = 20260926) -> DataFrame:
    """By cohort, both models' figures over the same rows, the differences candidate less baseline, and 95 % intervals by drawing whole dates.

    Date i of a cohort is drawn in each repeat by the hash of (seed, repeat, draw), so draws are rows of a join with the dates' sums, and a repeat is
    an aggregate: what grows is repeats times dates, spread over the cluster, and nothing but the result is gathered."""
    own, other, label = F.col(candidate), F.col(baseline), F.col(y)
    square = lambda p: (p - label) * (p - label)
    both = rows.where(label.isNotNull() & own.isNotNull() & other.isNotNull())
    blocks = both.groupBy(cohort, day).agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in {"l0": loss(other, label), "l1": loss(own, label), "b0": square(other), "b1": square(own)}.items()])
    number = F.row_number().over(Window.partitionBy(cohort).orderBy(day)) - 1  # a row for each date
    blocks = blocks.withColumn("at", number.cast("long")).select(cohort, "at", "n", "l0", "l1", "b0", "b1")
    whole = blocks.groupBy(cohort).agg(F.count("*").alias("dates"), *[F.sum(c).alias(c) for c in ("n", "l0", "l1", "b0", "b1")])
    draws = whole.select(cohort, "dates", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")).repartition(F.col(cohort), F.col("repeat"))
    draws = draws.select(cohort, "dates", "repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dates") - 1)).alias("draw"))
    drawn = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("repeat").cast("string"), F.col("draw").cast("string"))), F.lit(12)), 16, 10).cast("long") % F.col("dates")
    means = draws.select(cohort, "repeat", drawn.alias("at")).join(blocks, [cohort, "at"]).groupBy(cohort, "repeat").agg(((F.sum("l1") - F.sum("l0")) / F.sum("n")).alias("dl"), ((F.sum("b1") - F.sum("b0")) / F.sum("n")).alias("db"))
    low, high = int(0.025 * (repeats - 1)) + 1, int(0.975 * (repeats - 1)) + 1
    at = lambda c, k: F.element_at(F.sort_array(F.collect_list(c)), k)  # noqa: E731  (as many numbers as repeats)
    ends = means.groupBy(cohort).agg(at("dl", low).alias("loss_low"), at("dl", high).alias("loss_high"), at("db", low).alias("brier_low"), at("db", high).alias("brier_high"))
    per = lambda c: F.col(c) / F.col("n")
    return whole.join(ends, cohort).select(cohort, "n", "dates", per("l0").alias("baseline_loss"), per("l1").alias("candidate_loss"), (per("l1") - per("l0")).alias("loss_delta"), "loss_low", "loss_high", (per("b1") - per("b0")).alias("brier_delta"), "brier_low", "brier_high")
