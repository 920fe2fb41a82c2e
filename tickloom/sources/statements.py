"""Statement tables in stored pages: rows of text out of HTML, and their turn from item by period to period by item."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "page_id long, table_id string, row_no int, cells map<string,string>, mismatch boolean"


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append((dict(attrs).get("id") or "", [], []))
        elif self.tables and tag == "tr":
            self.tables[-1][2].append([])
        elif self.tables and tag in ("th", "td"):
            self.cell = (tag, [])

    def handle_data(self, data):
        if self.cell:
            self.cell[1].append(data)

    def handle_endtag(self, tag):
        if self.cell and tag in ("th", "td", "tr", "table"):
            text, self.cell = " ".join("".join(self.cell[1]).split()), (self.cell[0], None)
            (self.tables[-1][1] if self.cell[0] == "th" else self.tables[-1][2][-1] if self.tables[-1][2] else []).append(text)
            self.cell = None


def distinct_names(names: list[str]) -> list[str]:
    """x, x_1, x_2 for headers that repeat."""
    seen: Counter = Counter()
    out = []
    for n in names:
        out.append(f"{n}_{seen[n]}" if seen[n] else n)
        seen[n] += 1
    return out


def extract_tables(pages: DataFrame, wanted: str | None = None) -> DataFrame:
    """One row per body row of each table with headers: cells by header name, and whether their number differs from the headers'."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for page, html in zip(part["page_id"], part["html"]):
                parser = _Tables()
                parser.feed(html or "")
                parser.close()
                for name, headers, body in parser.tables:
                    heads = distinct_names(headers)
                    for i, cells in enumerate(r for r in body if r):
                        if heads and (wanted is None or name == wanted):
                            rows.append((page, name, i, dict(zip(heads, cells)), len(cells) != len(heads)))
            yield pd.DataFrame(rows, columns=["page_id", "table_id", "row_no", "cells", "mismatch"])

    return pages.select("page_id", "html").mapInPandas(run, ROWS)


def by_period(rows: DataFrame, item: str, items: list[str]) -> DataFrame:
    """Rows (cells by header; ``item`` heads the item names) turned so that each period is a row and each of ``items`` a column; the first value that is not blank counts."""
    long = rows.select("page_id", "row_no", F.trim(F.col("cells")[item]).alias("item"), F.explode(F.map_filter("cells", lambda k, _: k != item)).alias("period", "value"))
    long = long.withColumn("value", F.nullif(F.regexp_replace(F.trim("value"), ",", ""), F.lit("")))
    first = [F.min_by(F.when(F.col("item") == i, F.col("value")), F.when((F.col("item") == i) & F.col("value").isNotNull(), F.col("row_no"))).alias(i) for i in items]
    return long.groupBy("page_id", "period").agg(*first)
