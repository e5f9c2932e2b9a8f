"""Scalar rules as Column functions; all of them stay in the JVM but for the Unicode keys in names.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def counts(text: Column) -> Column:
    """`X of Y` as a struct (landed, attempted, error); landed above attempted or any other form gives nulls and an error."""
    landed = F.regexp_extract(text, r"^\s*(\d+) of (\d+)\s*$", 1).try_cast("long")
    attempted = F.regexp_extract(text, r"^\s*(\d+) of (\d+)\s*$", 2).try_cast("long")
    good = landed.isNotNull() & attempted.isNotNull() & (landed <= attempted)
    error = F.when(landed.isNull() | attempted.isNull(), "unparsed").when(landed > attempted, "landed_above_attempted")
    return F.struct(F.when(good, landed).alias("landed"), F.when(good, attempted).alias("attempted"), error.alias("error"))


def number(text: Column) -> Column:
    """A whole count, also written with a zero fraction; else null."""
    return F.when(text.rlike(r"^[0-9]+(\.0+)?$"), F.split_part(text, F.lit("."), F.lit(1)).try_cast("long"))


def seconds(text: Column) -> Column:
    """`M:SS` in seconds; else null."""
    ok = text.rlike(r"^[0-9]+:[0-5][0-9]$")
    return F.when(ok, F.split_part(text, F.lit(":"), F.lit(1)).try_cast("long") * 60 + F.split_part(text, F.lit(":"), F.lit(2)).try_cast("long"))


def schedule(form: Column) -> Column:
    """Minutes of each scheduled round from `3 Rnd (5-5-5)` or `1 Rnd + OT (12-3)`; null for forms without a list."""
    inner = F.regexp_extract(form, r"\(([0-9]+(?:-[0-9]+)*)\)", 1)
    return F.when(inner != "", F.transform(F.split(inner, "-"), lambda x: x.cast("long")))


def elapsed(round_: Column, time: Column, form: Column) -> Column:
    """Seconds fought: whole rounds before the last plus the time in it. Null where the time exceeds its round, the round is
    not on the schedule, or the form is unknown; without a time limit only round 1 is known."""
    at, plan = seconds(time), schedule(form)
    before = F.aggregate(F.slice(plan, F.lit(1), F.greatest(round_ - 1, F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda s, x: s + x * 60)
    known = (round_ >= 1) & (round_ <= F.size(plan)) & (at <= F.try_element_at(plan, round_.cast("int")) * 60)
    return F.when(form == "No Time Limit", F.when(round_ == 1, at)).when(plan.isNotNull() & known, before + at)


def reach_cm(text: Column) -> Column:
    """`70"` in centimetres, if between 100 and 250."""
    cm = F.regexp_extract(text, r'^\s*([0-9]+(?:\.[0-9]+)?)\s*"\s*$', 1).try_cast("double") * 2.54
    return F.when(cm.between(100, 250), F.round(cm, 6))


def identity(url: Column, host: str, kind: str, namespace: str) -> Column:
    """namespace:kind:hex16 of an http(s) address on the host without query or user; else null."""
    found = F.regexp_extract(url, rf"^https?://(?:www\.)?{host.replace('.', chr(92) + '.')}/{kind}/([0-9a-f]{{16}})/?$", 1)
    return F.when(found != "", F.concat(F.lit(f"{namespace}:{kind}:"), found))


def winner_side(code: Column) -> Column:
    """W/L, L/W, D/D, NC/NC as a, b, draw, no_contest; else null."""
    return F.when(code == "W/L", "a").when(code == "L/W", "b").when(code == "D/D", "draw").when(code == "NC/NC", "no_contest")


def sides(bout: Column) -> Column:
    """The two names of `A vs. B`; null unless there are two."""
    parts = F.split(bout, r"\s+vs\.\s+")
    return F.when(F.size(parts) == 2, F.transform(parts, lambda x: F.trim(x)))


def date(text: Column) -> Column:
    """`Month DD, YYYY`, `DD Month YYYY`, ISO, {{start date|Y|M|D}} or {{dts|Y|M|D}}."""
    template = F.regexp_extract(text, r"\{\{(?:start date|dts)\|(\d{4})\|(\d{1,2})\|(\d{1,2})", 0)
    parts = F.split(template, r"\|")
    return F.coalesce(F.try_to_date(text, "MMMM d, yyyy"), F.try_to_date(text, "d MMMM yyyy"), F.try_to_date(text, "yyyy-MM-dd"), F.when(template != "", F.try_to_date(F.concat_ws("-", parts[1], parts[2], parts[3]), "yyyy-M-d")))


def utc(text: Column) -> Column:
    """A timestamp whose text names its zone; else null."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), text.try_cast("timestamp"))


def hash_sign(text: Column) -> Column:
    """1 or -1 by the low bit of the text's SHA-256."""
    return F.when(F.conv(F.right(F.sha2(text, 256), F.lit(1)), 16, 10).cast("int") % 2 == 1, -1).otherwise(1)


def csv_safe(x: Column) -> Column:
    """A value that a spreadsheet does not read as a formula."""
    return F.when(F.ltrim(x).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def html_escape(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def rank_label(x: Column) -> Column:
    """`3`, `T-3`, `3 (tied)` as (rank, tied)."""
    found = F.regexp_extract(x, r"(\d+)", 1)
    return F.struct(F.when(found != "", found.cast("int")).alias("rank"), F.lower(x).rlike(r"^t-|tied").alias("tied"))


def favourite(p: Column) -> Column:
    top = F.greatest(p, 1 - p)
    return F.when(top == 0.5, "even").when(top < 0.55, "near even").when(top < 0.6, "small").when(top < 0.7, "clear").otherwise("strong")


def age_hinge(a: Column, b: Column, from_: float = 32.0) -> Column:
    return (F.greatest(a - from_, F.lit(0.0)) - F.greatest(b - from_, F.lit(0.0))) / 5


#: Groups of result methods and what their text says, first match first.
METHODS = (
    ("doctor_stoppage", "doctor|medical"),
    ("disqualification", "^dq|disqualif"),
    ("could_not_continue", "could not continue"),
    ("overturned", "overturned"),
    ("decision_unanimous", "^decision.*unanimous"),
    ("decision_split", "^decision.*split"),
    ("decision_majority", "^decision.*majority"),
    ("decision", "^decision"),
    ("submission", "^submission|^sub$"),
    ("ko_tko", r"^t?ko(\b|/)"),
)


def method_group(method: Column, outcome: Column) -> Column:
    """The group of a result's method; no_contest goes by the outcome, an empty method is unknown, any other is other."""
    text = F.trim(F.regexp_replace(F.lower(method), r"\s+", " "))
    out = F.lit("other")
    for name, pattern in reversed(METHODS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.when(outcome.eqNullSafe("no_contest"), "no_contest").when(text.isNull() | (text == ""), "unknown").otherwise(out)


def result_of(outcome: Column, winner: Column, me: Column, other: Column) -> Column:
    """A result from one side's point of view."""
    return F.when(outcome.isin("draw", "no_contest"), outcome).when((outcome == "win") & (winner == me), "win").when((outcome == "win") & (winner == other), "loss").otherwise("unknown")
