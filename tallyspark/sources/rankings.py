"""Published rankings: rows of HTML tables, ties, skipped places and vacancies."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

PLACES = 15
ROWS = "page_id long, division string, position int, label string, name string, link string"


class Tables(HTMLParser):
    """Rows of tables with a caption: the first cell is the place, the second the name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.caption, self.cells, self.link, self.into = "", [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.caption = ""
        elif tag == "caption":
            self.into = "caption"
        elif tag == "tr":
            self.cells, self.link = [], None
        elif tag in ("td", "th"):
            self.cells.append("")
            self.into = "cell"
        elif tag == "a" and self.into == "cell" and len(self.cells) == 2:
            self.link = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag == "tr" and len(self.cells) >= 2:
            label, name = (" ".join(c.split()) for c in self.cells[:2])
            self.rows.append((" ".join(self.caption.split()), label, name, self.link))
            self.cells = []
        if tag in ("caption", "td", "th", "tr"):
            self.into = None

    def handle_data(self, data):
        if self.into == "caption":
            self.caption += data
        elif self.into == "cell" and self.cells:
            self.cells[-1] += data


def rows(pages: DataFrame) -> DataFrame:
    """page_id, html -> a row for each table row with a place and a name."""

    def run(frames):
        for frame in frames:
            out = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                reader = Tables()
                reader.feed(html or "")
                reader.close()
                out += [(page, division, k, label, name, link) for k, (division, label, name, link) in enumerate(reader.rows)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    return pages.select("page_id", "html").mapInPandas(run, ROWS)


def placed(found: DataFrame) -> DataFrame:
    """Contenders with place, ties and problems: a place outside the top, a repeated name, or a place that a tie above fills."""
    label = scalar.rank_label(F.col("label"))
    out = found.withColumn("rank", label["rank"]).withColumn("marked", label["tied"]).where(~F.lower("name").isin("vacant", "unassigned"))
    group = ["page_id", "division"]
    out = out.withColumn("tie_size", F.count("*").over(Window.partitionBy(*group, "rank"))).withColumn("tied", (F.col("tie_size") > 1) | F.col("marked"))
    reach = F.max(F.col("rank") + F.col("tie_size") - 1).over(Window.partitionBy(*group).orderBy("rank").rangeBetween(Window.unboundedPreceding, -1))
    names = F.count("*").over(Window.partitionBy(*group, F.coalesce("link", F.lower("name"))))
    problem = F.when(F.col("rank").isNull() | ~F.col("rank").between(1, PLACES), "outside").when(names > 1, "repeated_athlete").when(F.col("rank") <= reach, "overlaps_a_tie")
    return out.select(*group, "position", "rank", "name", "link", "tied", "tie_size", problem.alias("problem"))


def gaps(found: DataFrame) -> DataFrame:
    """Places of each division that no contender has, and why: a tie skips it, it is vacant, or it is not published."""
    group = ["page_id", "division"]
    ranked = placed(found)
    every = found.select(*group).distinct().select(*group, F.explode(F.sequence(F.lit(1), F.lit(PLACES))).alias("rank"))
    filled = ranked.select(*group, F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("tie_size").cast("int") - 1)).alias("rank")).distinct().withColumn("skipped", F.lit(True))
    vacant = found.where(F.lower("name").isin("vacant", "unassigned")).select(*group, scalar.rank_label(F.col("label"))["rank"].alias("rank")).distinct().withColumn("vacant", F.lit(True))
    missing = every.join(ranked.select(*group, "rank").distinct(), [*group, "rank"], "left_anti")
    joined = missing.join(filled, [*group, "rank"], "left").join(vacant, [*group, "rank"], "left")
    return joined.select(*group, "rank", F.when(F.col("skipped"), "tie_skips_rank").when(F.col("vacant"), "vacancy").otherwise("not_published").alias("reason"))
