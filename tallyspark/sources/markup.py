"""Tolerant reading of HTML columns: titles, links, images and headings, batch by batch."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENTS = "page_id long, position int, kind string, target string, text string"


class Reader(HTMLParser):
    """Collects (kind, target, text); script and style contents are passed over, unclosed elements end with the page."""

    KINDS = {"a": "href", "h1": None, "h2": None, "h3": None, "title": None}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open: list[list] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "img":
            self.found.append(["img", given.get("src"), given.get("alt") or ""])
        elif tag in self.KINDS:
            entry = [tag, given.get(self.KINDS[tag]) if self.KINDS[tag] else None, ""]
            self.found.append(entry)
            self.open.append(entry)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        for entry in self.open:
            entry[2] += data


def read(html: str | None) -> list[list]:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return [[kind, target, " ".join(text.split())] for kind, target, text in reader.found]


def elements(pages: DataFrame) -> DataFrame:
    """page_id, html -> a row for each element; pages without any (or null) have none."""

    def run(frames):
        for frame in frames:
            rows = [(i, k, *e) for i, html in zip(frame["page_id"], frame["html"], strict=True) for k, e in enumerate(read(html))]
            yield pd.DataFrame(rows, columns=["page_id", "position", "kind", "target", "text"])

    return pages.select("page_id", "html").mapInPandas(run, ELEMENTS)


def plain_title(html: Column) -> Column:
    """The text of the first plain `<title>`, up to the next tag, with runs of white space as one blank; of the references only &lt;, &gt; and &amp; are resolved. Null without any text."""
    text = F.regexp_replace(F.regexp_extract(html, "<title>([^<]*)", 1), r"[\t\n\f\r ]+", " ")
    text = F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")
    for written, meant in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(written), F.lit(meant))
    return F.nullif(text, F.lit(""))


def titles(pages: DataFrame) -> DataFrame:
    """page_id and the first title of each page, or null, whatever the case, attributes and references of its markup."""

    def run(frames):
        for frame in frames:
            found = [next((e[2] for e in read(html) if e[0] == "title"), None) for html in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "title": found})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string")
