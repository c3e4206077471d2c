"""HTML extraction (operator 10): site template removal.

A page is read once into pieces of text and elements that cover ranges of them; broken markup is closed as browsers do
in the usual cases (a paragraph ends at the next block, an article ends an open menu, ...).

1. *Templates.*  Every element of the page with text, inside the article and outside, whatever its name, is hashed with
   its whole subtree.  Spark counts, for each host, the different pages (copies of one page count once) that hold a
   subtree; subtrees that are on ``MIN_PAGES`` and on ``SHARE`` of the host's different pages at least belong to the
   site and are left out.
2. *Own marks*, for what recurs too rarely to be counted: elements that say by their name, role, class or id that they
   are a menu, header, footer, sidebar, notice, advert, form, script, style or reader comments are left out.  Words that
   name content as well (related work, discussion, an alert box, ...) count outside of articles only.
3. The text is that of the articles of the page (else of its main elements, else of its body): character references
   decoded, white space within a block one space, blocks in page order joined by one space.

The counts are combined before the shuffle; a host's templates are at most 1 / SHARE times the subtrees of a page.

Results for odd input: null or empty html gives an empty text; a page without a host (null or broken url) has no
templates; pages that come twice are returned twice; broken and very deep markup, unknown references and markup that
never ends are read as far as they go; an empty table gives an empty result; other columns are carried along, but for
those named ``text`` or ``n_chars``, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.llm.common import materialize, text_chunks

MIN_PAGES, SHARE = 5, 0.3
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset(
    "head script style noscript template nav header footer aside form button select textarea input dialog menu iframe "
    "object svg canvas math audio video".split())
#: Words of a class, id or role that mark what is not the article.
MARKS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination header masthead topbar footer sidebar aside "
    "complementary contentinfo banner notice notices cookie cookies consent gdpr alert popup modal overlay ad ads advert "
    "adverts advertisement advertisements advertising sponsor sponsored promo promotion newsletter subscribe signup login "
    "form search comment comments disqus discussion replies reply respond share sharing social related recommended "
    "widget skip".split())
#: Of these, the words that an article uses for its own parts; inside of one they mark nothing.
ARTICLE_WORDS = frozenset(
    "header masthead footer aside complementary contentinfo banner alert form search discussion share sharing social related "
    "recommended widget skip overlay respond reply promo promotion".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]), "head": frozenset(["body", "article", "main", "p", "div", "nav"])}
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]),
         "td": frozenset(["table"]), "th": frozenset(["table"]), "option": frozenset(["select"]), "p": frozenset(["td", "th", "li"]),
         "head": frozenset()}
ROOTS = frozenset(["html", "body", "article", "main"])
CLOSES = {tag: [other for other, by in CLOSED_BY.items() if tag in by] for tag in frozenset().union(*CLOSED_BY.values())}
BEFORE_ARTICLE = frozenset(["nav", "header", "head", "aside", "footer"])


class Element:
    __slots__ = ("tag", "start", "end", "out", "hash", "digest", "text")

    def __init__(self, tag: str, start: int, out: bool):
        self.tag, self.start, self.end, self.out, self.text = tag, start, -1, out, False
        self.hash, self.digest = None, b""


class Page(HTMLParser):
    """``pieces`` of text and the ``elements`` that cover ranges of them, with hashes of their subtrees if asked for."""

    def __init__(self, html: str, hashed: bool):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.elements: list[Element] = []
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}  # of each tag, its places among the open elements
        self.articles = 0  # open article and main elements
        self.hashed = hashed
        comment = html.rfind("<!--")
        self.feed(html + "-->" * (comment >= 0 and html.find("-->", comment) < 0))  # an open comment takes the rest
        self.close()
        while self.open:
            self._end()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        root = tag in ("article", "main")
        if root:  # an article does not stand in a menu that was never closed
            while any(self.places.get(t) for t in BEFORE_ARTICLE):
                self._end()
        for other in CLOSES.get(tag, ()):
            self._end_last(other, SCOPE[other])
        label = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v) if attrs else ""
        marks = MARKS.intersection(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", label).lower())) if label else ()
        if self.articles and not root:
            marks = set(marks) - ARTICLE_WORDS
        out = tag in LEFT_OUT and (tag != "header" or not self.articles or bool(marks))
        if marks and not out:
            out = bool({"comment", "comments", "reply", "ad", "ads"} & marks) if root else tag not in ROOTS
        if attrs and not out:
            out = self._hidden(attrs)
        if tag not in INLINE:
            self.pieces.append(" ")
        element = Element(tag, len(self.pieces), out)
        if self.hashed:
            element.hash = blake2b(f"{tag} {label}".encode(errors="replace"), digest_size=8)
        self.elements.append(element)
        if tag in VOID:
            element.end = len(self.pieces)
        else:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(element)
            self.articles += root

    @staticmethod
    def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
        return any(k == "hidden" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
        self._end_last(tag, frozenset())

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        if self.hashed and self.open and not data.isspace():
            self.open[-1].text = True
            self.open[-1].hash.update(" ".join(data.split()).encode(errors="replace"))

    def _end_last(self, tag: str, scope: frozenset[str]) -> None:
        """Close the last open ``tag`` and what is open in it, if it is open within ``scope``."""
        at = self.places.get(tag)
        if not at or any(self.places.get(t) and self.places[t][-1] > at[-1] for t in scope):
            return
        last = at[-1]
        while len(self.open) > last:
            self._end()

    def _end(self) -> None:
        element = self.open.pop()
        self.places[element.tag].pop()
        element.end = len(self.pieces)
        self.articles -= element.tag in ("article", "main")
        if element.tag not in INLINE:
            self.pieces.append(" ")
        if self.hashed:
            element.digest = element.hash.digest()
            if self.open:
                self.open[-1].text |= element.text
                self.open[-1].hash.update(b"<" + element.digest)


def _ranges(elements: list[Element]) -> list[tuple[int, int]]:
    """Ranges of pieces without those in other ranges."""
    ranges: list[tuple[int, int]] = []
    for e in sorted(elements, key=lambda e: (e.start, -e.end)):
        if not ranges or e.start >= ranges[-1][1]:
            ranges.append((e.start, e.end))
    return ranges


def _parts(page: Page) -> tuple[list[tuple[int, int]], list[Element]]:
    """The ranges of the article, and its elements that are not left out by their own marks."""
    inside, kept = 0, []
    for e in page.elements:  # in the order of their starts: a range left out covers all that starts in it
        if e.start >= inside:
            if e.out:
                inside = max(inside, e.end)
            else:
                kept.append(e)
    for root in ("article", "main", "body"):
        roots = [e for e in kept if e.tag == root]
        if roots:
            return _ranges(roots), kept
    return [(0, len(page.pieces))], kept


def subtrees(html: str) -> tuple[list[int], int]:
    """Hashes of all subtrees with text, and one of the whole article."""
    page = Page(html, hashed=True)
    ranges, _ = _parts(page)
    found = {e.digest for e in page.elements if e.text and e.tag not in ROOTS}
    whole = blake2b(" ".join("".join("".join(page.pieces[a:b]) for a, b in ranges).split()).encode(errors="replace"), digest_size=8)
    return [int.from_bytes(d, "big", signed=True) for d in found], int.from_bytes(whole.digest(), "big", signed=True)


def main_text(html: str, templates: frozenset[int]) -> str:
    page = Page(html, hashed=bool(templates))
    ranges, kept = _parts(page)
    gone = [e for e in page.elements if e.out]
    if templates:
        gone += [e for e in kept if e.text and e.tag not in ROOTS
                 and int.from_bytes(e.digest, "big", signed=True) in templates]
    cut, out, at = _ranges(gone), [], 0
    for a, b in ranges:
        while at < len(cut) and cut[at][1] <= a:
            at += 1
        k = at
        while k < len(cut) and cut[k][0] < b:
            x, y = cut[k]
            out += page.pieces[a: max(a, x)]
            out.append(" " if y > x else "")
            a = max(a, y)
            k += 1
        out += page.pieces[a:b]
        out.append(" ")
    return " ".join("".join(out).split())


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches, "html"):
        hosts, trees, pages = [], [], []
        for host, html in zip(chunk.column("host").to_pylist(), chunk.column("html").to_pylist()):
            found, whole = subtrees(html)
            hosts += [host] * (len(found) + 1)
            trees += [None, *found]  # null: the page itself
            pages += [whole] * (len(found) + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(trees, pa.int64()), pa.array(pages, pa.int64())], ["host", "subtree", "page"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches, "html"):
        last, templates, texts = None, frozenset(), []
        for html, found in zip(chunk.column("html"), chunk.column("__templates")):
            found = found.as_py() or ()
            if found != last:
                last, templates = found, frozenset(found)
            texts.append(main_text(html.as_py() or "", templates))
        yield (chunk.drop_columns(["html", "__templates"]).append_column("text", pa.array(texts, pa.string()))
               .append_column("n_chars", pa.array([len(t) for t in texts], pa.int64())))


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)", 1))
    return F.when(host != "", host)


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, templates): hashes of the subtrees that belong to a host's site."""
    counts = (pages.where("host is not null and html is not null").select("host", "html")
              .mapInArrow(_subtrees, "host string, subtree long, page long").distinct()
              .groupBy("host", "subtree").agg(F.count("*").alias("n")))
    counts = materialize(counts.where((F.col("n") >= min_pages) | F.col("subtree").isNull()), "subtrees")
    all_pages = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    often = counts.where("subtree is not null").join(all_pages, "host").where(F.col("n") >= share * F.col("pages"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("templates"))


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``pages`` (url, html, ...) with text and n_chars instead of html."""
    rows = pages.drop("text", "n_chars").withColumns({"html": F.col("html").cast("string"), "__host": host_of(F.col("url"))})
    templates = materialize(site_templates(rows.select(F.col("__host").alias("host"), "html"), min_pages, share)
                            .select(F.col("host").alias("__host"), F.col("templates").alias("__templates")), "templates")
    names = [c for c in rows.columns if c not in ("__host", "html")]
    schema = T.StructType(rows.select(*names).schema.fields).add("text", "string").add("n_chars", "long")
    return rows.join(templates, "__host", "left").select(*names, "html", "__templates").mapInArrow(_extract, schema)


def html_text_query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


ORACLE = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)(</article>|$)', 1, 's') AS h FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(b|i|em|strong|a|span)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
x AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '),
             '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS text FROM t)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM x
"""
