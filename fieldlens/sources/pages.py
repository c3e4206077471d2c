"""Fetched pages -> rows.

The HTTP fetching of the reference is out of scope; these operators take a
table of already fetched pages (key, html) and parse it with JVM regex
functions, so parsing is partitioned like any other projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import expr as E

BORDER_TABLE = r"""(?is)<table[^>]*\bborder\s*=\s*["']?1\b[^>]*>(.*?)</table>"""
ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<td[^>]*>(.*?)</td>"


def _text(c: Column) -> Column:
    """Text of a cell, its pieces joined by a blank; only cells with markup
    are cut into pieces."""
    text = F.when(c.rlike("[<&]"), F.array_join(E.text_pieces(c), " ")).otherwise(E.strip(c))
    return E.strip(F.regexp_replace(text, r"\s+", " "))


def _stripped_text(c: Column) -> Column:
    """Text of a cell with every text piece stripped and the pieces joined
    without a separator; only cells with markup are cut into pieces."""
    return F.when(c.rlike("[<&]"), F.array_join(E.text_pieces(c), "")).otherwise(E.strip(c))


# first <td> of a row, never crossing the row's </tr>, in a closed row
_IN_ROW = r"(?:(?!</tr>).)"
FIRST_CELLS = r"(?is)<tr[^>]*>" + _IN_ROW + r"*?<td[^>]*>(" + _IN_ROW + r"*?)</td>" + _IN_ROW + r"*</tr>"


def serials_in_page(html: Column) -> Column:
    """Serial list of a page: first table with border=1, rows after the
    header, text of the first <td>, blanks dropped.

    The header row is cut off up to its </tr>, then one regex pass returns
    the first cell of every remaining closed row (rows without a <td> give
    nothing), instead of listing the rows and parsing each one again.
    """
    return _serials_in_table(_serial_table(html))


def _serial_table(html: Column) -> Column:
    return F.regexp_extract(F.coalesce(html, F.lit("")), BORDER_TABLE, 1)


def _serials_in_table(table: Column) -> Column:
    closed = F.instr(F.lower(table), "</tr>")
    body = table.substr(closed + 5, F.length(table))
    cells = F.when(closed > 0, F.regexp_extract_all(body, F.lit(FIRST_CELLS), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(cells, _stripped_text), lambda s: s != "")


#: A row longer than this is left to the tokenizer: the regex of first cells recurses over its characters.
LONG_ROW = 1000


def _is_nested_table(table: Column) -> Column:
    return (F.length(table) > 0) & (table.rlike("(?i)<table") | (
        (F.length(table) > LONG_ROW) & F.exists(F.split(table, "(?i)</tr>"), lambda r: F.length(r) > LONG_ROW)))


#: A table with a border, and another one after it.
FOLLOWED = r"""(?is)<table[^>]*\bborder\s*=\s*["']?1\b.*<table"""


def is_nested(html: Column) -> Column:
    """Pages that a regex cannot read: a table inside the serial table, or a
    very long row.  The table is cut out, once, only of long pages and those
    where another table follows one with a border."""
    look = F.coalesce((F.length(html) > LONG_ROW) | html.rlike(FOLLOWED), F.lit(False))
    return F.when(look, F.exists(F.array(_serial_table(html)), _is_nested_table)).otherwise(F.lit(False))


def _pieces(html: Column) -> Column:
    """The markup without comments, cut at table, row and cell tags."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    return F.split(bare, r"(?i)(?=</?(?:table|tr|td)\b)")


def _first_cells(pieces: Column) -> Column:
    """The texts of the first cells of the rows of the serial table, by one
    pass over the pieces that keeps the depth of tables and cells.

    The serial table is the first one with a border and ends with the tag that
    closes it; every row in it but the first counts, those of inner tables
    too, and a cell holds all pieces up to the tag that closes it.  ``open``
    holds the first cells that are not closed yet, at most one for each depth,
    ``done`` the pieces [from, upto) of the others."""
    none, zero = F.lit(None).cast("int"), F.lit(0)
    start = {"tables": zero, "cells": zero, "depth": none, "ended": F.lit(False), "row": none, "header": none, "filled": none,
             "open": F.array().cast("array<struct<level:int,from:int>>"), "done": F.array().cast("array<struct<from:int,upto:int>>")}
    tagged = F.transform(pieces, lambda p, i: F.struct(
        i.alias("at"), F.lower(F.regexp_extract(F.left(p, F.lit(8)), r"(?i)^<(/?(?:table|tr|td))\b", 1)).alias("tag"), p.alias("text")))

    def step(s: Column, x: Column) -> Column:
        tag, at = x["tag"], x["at"]

        def but(**new: Column) -> Column:
            return F.struct(*[new.get(n, s[n]).alias(n) for n in start])

        def closed(cells: Column) -> Column:
            return F.concat(s["done"], F.transform(cells, lambda c: F.struct(c["from"].alias("from"), at.alias("upto"))))

        bordered = x["text"].rlike(r"""(?i)^<table[^>]*\bborder\s*=\s*["']?1\b""")
        opens = but(tables=s["tables"] + 1, depth=F.when(s["depth"].isNull() & bordered, s["tables"] + 1).otherwise(s["depth"]))
        ends = but(ended=F.lit(True), open=start["open"], done=closed(s["open"]))
        first = s["depth"].isNotNull() & (s["cells"] >= 0) & (s["row"] > s["header"]) & ~s["filled"].eqNullSafe(s["row"])
        cell = F.struct((s["cells"] + 1).alias("level"), at.alias("from"))
        here = lambda c: c["level"] == s["cells"]
        return (F.when(s["ended"], s)
                .when((tag == "td") & first, but(cells=s["cells"] + 1, filled=s["row"], open=F.concat(s["open"], F.array(cell))))
                .when(tag == "td", but(cells=s["cells"] + 1))
                .when((tag == "/td") & F.exists(s["open"], here),
                      but(cells=s["cells"] - 1, open=F.filter(s["open"], lambda c: ~here(c)), done=closed(F.filter(s["open"], here))))
                .when(tag == "/td", but(cells=s["cells"] - 1))
                .when((tag == "tr") & s["depth"].isNotNull(), but(row=at, header=F.coalesce(s["header"], at)))
                .when(tag == "table", opens)
                .when((tag == "/table") & (s["tables"] == s["depth"]), ends)
                .when(tag == "/table", but(tables=s["tables"] - 1)).otherwise(s))

    def ranges(s: Column) -> Column:
        to_the_end = F.transform(s["open"], lambda c: F.struct(c["from"].alias("from"), F.size(pieces).alias("upto")))
        return F.array_sort(F.concat(s["done"], to_the_end))  # in page order

    found = F.aggregate(tagged, F.struct(*[c.alias(n) for n, c in start.items()]), step, ranges)
    return F.transform(found, lambda c: F.array_join(F.slice(pieces, c["from"] + 1, c["upto"] - c["from"]), ""))


def nested_serials(pages: DataFrame, key: str) -> DataFrame:
    """(key, _serials) of pages with tables in tables, by their tags, without
    the pages that list none.  A page is read where it lies, so neither its
    text nor its pieces are shuffled."""
    p = pages.select(key, F.explode(F.array(_pieces(F.col("html")))).alias("_pieces"))
    return p.select(key, _serials_by_tags(F.col("_pieces")).alias("_serials")).where(F.size("_serials") > 0)


def _serials_by_tags(pieces: Column) -> Column:
    return F.filter(F.transform(_first_cells(pieces), _stripped_text), lambda s: s != "")


def page_serials(pages: DataFrame, key: str = "page_key", fetched: str | None = None) -> DataFrame:
    """(key, _serials) of the page of each key: the one fetched last
    (``fetched``), else the one whose text has the greatest hash, so that the
    choice is the same in every run.

    Pages are read once and where they lie, plain ones by one regex pass and
    the others by their tags; what is shuffled to pick a page is its serials
    and a hash, not its text.
    """
    rank = [F.col(fetched).alias("at")] if fetched else []
    rank = F.struct(*rank, F.unhex(F.md5("html")).alias("hash")).alias("_rank")
    # exploded from arrays of one, so that the table is cut out of a page once, and the pieces, too, of the pages that need them
    p = pages.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), rank, F.col("html").alias("_html"))
    p = p.select("*", F.explode(F.array(_serial_table(F.col("_html")))).alias("_table"))
    p = p.select("_key", "_rank", "_table", F.explode(F.array(F.when(_is_nested_table(F.col("_table")), _pieces(F.col("_html"))))).alias("_pieces"))
    serials = F.when(F.col("_pieces").isNotNull(), _serials_by_tags(F.col("_pieces"))).otherwise(_serials_in_table(F.col("_table")))
    p = p.select("_key", F.struct("_rank", serials.alias("_serials")).alias("_page"))
    return p.groupBy(F.col("_key").alias(key)).agg(F.max("_page").alias("_page")).select(key, F.col("_page._serials").alias("_serials"))


def unpack_serials(lines: DataFrame, pages: DataFrame, on: str, page_key: str = "page_key",
                   fetched: str | None = None) -> DataFrame:
    """One row per (line, serial); a line whose page lists no serial
    gets one row with ''; a line without a fetched page gets no row (it is
    retried on the next run).  Repeated lines and repeated pages of one key
    are reduced to one before the join, so that no key multiplies rows."""
    p = page_serials(pages, page_key, fetched).withColumnRenamed(page_key, "_pk")
    d = lines.distinct()
    j = d.join(p, d[on] == p["_pk"], "inner")
    x = j.select(*lines.columns, F.explode_outer("_serials").alias("Serial"))
    return x.withColumn("Serial", F.coalesce(F.col("Serial"), F.lit("")))


def report_rows(pages: DataFrame, key: str = "page_key") -> DataFrame:
    """The data rows of a report page (first <table>), dropping the
    header and the trailing totals row; cells as an array of texts."""
    table = F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"(?is)<table[^>]*>(.*?)</table>", 1)
    # exploded from an array of one, so that the rows are cut out of a page once
    rows = pages.select(key, F.explode(F.array(F.regexp_extract_all(table, F.lit(ROW), F.lit(1)))).alias("_rows"))
    x = rows.select(key, F.posexplode("_rows").alias("pos", "row"), F.size("_rows").alias("_n"))
    x = x.where((F.col("pos") > 0) & (F.col("pos") < F.col("_n") - 1))
    return x.select(key, "pos", F.transform(F.regexp_extract_all("row", F.lit(CELL), F.lit(1)), _text).alias("cells"))


def page_flags(pages: DataFrame, key: str) -> DataFrame:
    """F20 + F21 per page: RTM flag from BLUETOOTH text and the warranty sentence."""
    return pages.select(key, E.bluetooth_flag("html").alias("RTM"),
                        E.warranty_sentence("html").alias("GARANTIA_TEXTO"))
