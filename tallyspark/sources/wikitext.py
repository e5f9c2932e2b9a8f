"""Result templates in wiki text: balanced braces, parameters, contests of an event page."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, scalar
from ..operators import asof

PARTS = "page_id long, position int, template string, parts array<string>"
BRACES = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
COMMENT = re.compile(r"<!--.*?-->", re.S)


def templates(text: str) -> list[list[str]]:
    """The parameters of each outermost template, nested markup kept whole; a template that never closes is left out."""
    out: list[list[str]] = []
    stack: list[str] = []
    begin, parts = 0, []
    text = COMMENT.sub("", text)
    for m in BRACES.finditer(text):
        mark = m[0]
        if mark == "{{":
            if not stack:
                begin, parts = m.end(), []
            stack.append("}}")
        elif mark == "[[" and stack:
            stack.append("]]")
        elif stack and mark == stack[-1]:
            stack.pop()
            if not stack:
                out.append([*parts, text[begin : m.start()].strip()])
        elif mark == "|" and len(stack) == 1:
            parts.append(text[begin : m.start()].strip())
            begin = m.end()
    return out


def scan(pages: DataFrame, wanted: str) -> DataFrame:
    """pages (page_id, source) -> the parameters of every template of the wanted name, in order; templates inside a template are scanned too."""

    def found(text: str):
        todo = [text]
        while todo:
            for parts in templates(todo.pop(0)):
                if " ".join(parts[0].split()).casefold() == wanted.casefold():
                    yield parts
                elif any("{{" in p for p in parts):
                    todo.append("|".join(parts))

    def run(frames):
        for frame in frames:
            rows = [(page, k, parts[0], parts[1:]) for page, source in zip(frame["page_id"], frame["source"], strict=True) for k, parts in enumerate(found(source or ""), 1)]
            yield pd.DataFrame(rows, columns=["page_id", "position", "template", "parts"])

    return pages.select("page_id", "source").mapInPandas(run, PARTS)


def contests(pages: DataFrame, template: str = "MMAevent bout") -> DataFrame:
    """A row for each result template: weight class, both names (and link titles), outcome, method, and `problem`: shape,
    identical_names or ambiguous_result, else null."""
    parts = scan(pages, template)
    part = lambda k: F.trim(F.get("parts", F.lit(k)))
    link = lambda k: F.regexp_extract(part(k), r"^\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", 1)
    shown = lambda k: F.regexp_extract(part(k), r"^\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", 2)
    plain = lambda k: F.trim(F.regexp_replace(part(k), r"(?i)\s*\((?:c|ic)\)$", ""))
    name = lambda k: F.when(link(k) == "", plain(k)).otherwise(F.coalesce(F.nullif(F.trim(shown(k)), F.lit("")), F.translate(link(k), "_", " ")))
    marker, method = F.lower(part(2)), F.lower(part(4))
    versus = marker.isin("vs.", "vs", "v.", "v")
    void = method.startswith("no contest") | method.startswith("nc")
    outcome = F.when(marker.isin("def.", "def") & ~method.startswith("draw") & ~void, "win").when(versus & method.startswith("draw"), "draw").when((versus | (marker == "nc")) & void, "no_contest")
    problem = F.when((F.size("parts") < 5) | (part(0) == "") | (method == ""), "shape").when(F.lower(name(1)) == F.lower(name(3)), "identical_names").when(outcome.isNull(), "ambiguous_result")
    title = lambda k: F.nullif(F.translate(link(k), "_", " "), F.lit(""))
    return parts.select("page_id", "position", part(0).alias("weight_class"), name(1).alias("a"), title(1).alias("a_title"), name(3).alias("b"), title(3).alias("b_title"), outcome.alias("outcome"), part(4).alias("method"), problem.alias("problem"))


def event_fields(pages: DataFrame, infobox: str = "Infobox MMA event") -> DataFrame:
    """Name and date of each page's event box."""
    box = scan(pages, infobox).where("position = 1")
    field = lambda key: F.get(F.filter(F.transform("parts", lambda p: F.regexp_extract(p, rf"(?is)^{key}\s*=\s*(.*)$", 1)), lambda v: v != ""), F.lit(0))
    return box.select("page_id", field("name").alias("name"), scalar.date(F.trim(field("date"))).alias("event_date"))


HEADINGS = "page_id long, position int, level int, name string, start int, end int"
HEADING = re.compile(r"^[^\S\n]*(={2,6})([^=\n](?:[^\n]*[^=\n])?)(={2,6})[^\S\n]*$", re.M)


def headings(pages: DataFrame) -> DataFrame:
    """Level, name and place of every heading whose two sides are equally long; `end` is where its section ends: at the next
    heading of its level or a higher one."""

    def run(frames):
        for frame in frames:
            rows = []
            for page, source in zip(frame["page_id"], frame["source"], strict=True):
                found = [(len(m[1]), m[2].strip(), m.start()) for m in HEADING.finditer(source or "") if len(m[1]) == len(m[3]) and m[2].strip()]
                for k, (level, name, start) in enumerate(found):
                    end = next((s for depth, _, s in found[k + 1 :] if depth <= level), len(source))
                    rows.append((page, k + 1, level, name, start, end))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADINGS.split(", ")])

    return pages.select("page_id", "source").mapInPandas(run, HEADINGS)


def latest_revisions(revisions: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """revisions (page_id, revision_id, stamped, content, sha1) and cutoffs (page_id, cutoff) -> each page's latest revision at or before its
    cutoff, and whether the content has the stated SHA-1 (hexadecimal or to the base of 36)."""
    found = asof.asof_join(cutoffs.select("page_id", "cutoff"), revisions, ["page_id"], "cutoff", "stamped", ["revision_id", "content", "sha1"])
    digest = F.sha1("content")
    return found.withColumn("verified", F.coalesce(F.lower("sha1").isin(digest) | (F.lower("sha1") == names.base36_key(digest)), F.lit(False)))


YEARS = "page_id long, year int, row int, number string, event string, stated string"
ROW = re.compile(r"^\|-[^\n]*\n", re.M)
ATTRIBUTES = re.compile(r"^(?:\s*[a-zA-Z-]+\s*=\s*(?:\"[^\"]*\"|\S+))+\s*\|(?!\|)")
MARKS = re.compile(r"\{\{|\[\[|\}\}|\]\]|\|\||\n[|!]")


def cells(row: str) -> list[str]:
    """The cells of one table row, on one line or several; bars within links and templates divide nothing."""
    out, depth, begin = [], 0, 0
    row = "\n" + row.strip()
    for m in MARKS.finditer(row):
        if m[0] in ("{{", "[["):
            depth += 1
        elif m[0] in ("}}", "]]"):
            depth = max(depth - 1, 0)
        elif depth == 0:
            out.append(row[begin : m.start()])
            begin = m.end()
    return [ATTRIBUTES.sub("", c.strip()).strip() for c in [*out, row[begin:]][1:]]


def year_events(pages: DataFrame) -> DataFrame:
    """S14. pages (page_id, year, source) -> the rows of each page's first table that has columns #, Event and Date: number, title, shown name, date, and `problem`:
    non_numeric_number (a cancelled card), event_cell (not one link to a page), event_date, other_year, else null. Rows without a number, a link and a date are
    no events."""

    def table(source: str) -> str:
        for part in source.split("{|")[1:]:
            head, body = part.split("\n|}", 1)[0], ROW.search(part)
            titles = {ATTRIBUTES.sub("", x.strip()).strip() for line in head[: body.start() if body else None].split("\n") if line.startswith("!") for x in line[1:].split("!!")}
            if {"#", "Event", "Date"} <= titles:
                return head
        return ""

    def run(frames):
        for frame in frames:
            rows = []
            for page, year, source in zip(frame["page_id"], frame["year"], frame["source"], strict=True):
                for k, text in enumerate(ROW.split(table(COMMENT.sub("", source or "")))[1:], 1):
                    if found := cells(text)[:3]:
                        rows.append((page, year, k, *found, *[""] * (3 - len(found))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in YEARS.split(", ")])

    rows = pages.select("page_id", F.col("year").cast("int"), "source").mapInPandas(run, YEARS)
    link = F.regexp_replace("event", r"(?is)^\{\{\s*sort\s*\|[^|{}]*\|\s*(.*?)\s*\}\}$", "$1")
    part = lambda k: F.trim(F.regexp_extract(link, r"^\[\[([^\[\]|#:][^\[\]|#]*)(?:\|([^\[\]|]+))?\]\]$", k))
    rows = rows.withColumns({"title": F.nullif(F.translate(part(1), "_", " "), F.lit("")), "shown": F.nullif(part(2), F.lit("")), "event_date": table_date(F.col("stated"))})
    numbered, linked, dated = F.col("number").rlike("^[0-9]+$"), F.col("title").isNotNull(), F.col("event_date").isNotNull()
    problem = F.when(~numbered, "non_numeric_number").when(~linked, "event_cell").when(~dated, "event_date").when(F.year("event_date") != F.col("year"), "other_year")
    out = rows.where(numbered | (linked & dated))
    return out.select("page_id", "year", "row", F.when(numbered, F.col("number").try_cast("int")).alias("number"), "title", F.coalesce("shown", "title").alias("name"), "event_date", problem.alias("problem"))


def table_date(text):
    """{{dts|2024|1|20}}, {{dts|2024|January|20}}, Jan 20, 2024 or January 20, 2024."""
    mark = lambda k: F.regexp_extract(text, r"(?i)^\{\{\s*dts\s*\|\s*(?:format=[^|]*\|\s*)?(\d{4})\s*\|\s*(\w+)\s*\|\s*(\d{1,2})\s*(?:\|[^{}]*)?\}\}$", k)
    word = F.regexp_extract(text, r"^([A-Z][a-z]+) (\d{1,2}), (\d{4})$", 1)
    month = F.when(mark(2).rlike("^[0-9]+$"), mark(2).try_cast("int")).otherwise(month_number(mark(2)))
    stamp = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    written = stamp(F.regexp_extract(text, r", (\d{4})$", 1), F.coalesce(month_number(word).cast("string"), F.lit("")), F.regexp_extract(text, r" (\d{1,2}),", 1))
    return F.when(mark(1) != "", stamp(mark(1), F.coalesce(month.cast("string"), F.lit("")), mark(3))).when(word != "", written)


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def month_number(text):
    """1 to 12 for a month's English name or its first three letters, else null."""
    name = F.lower(text)
    return F.coalesce(*[F.when(name.isin(m, m[:3]), k) for k, m in enumerate(MONTHS, 1)])
