"""Silver tables: cleaned tickets and units, partitioned by year.

The raw feeds are cleaned once (C1, C2) and written partitioned by year, so a
year range is a partition filter, and sorted within each file, so Parquet's
minima and maxima skip row groups.  A refresh overwrites only the years that
have new rows.

Tickets are also dealt into blocks.  Beside them lies a trigram index: for
each block, the hashes of all three-character runs of its texts.  A search
reads only blocks that hold every trigram of the term; the regex then decides
row by row, so the result is that of a scan.  Terms with regex operators or
under three characters scan all blocks.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.operators import filters
from fieldlens.plans import jobs
from fieldlens.session import checkpoint_dir, released_shuffles
from fieldlens.sources import views
from fieldlens.sources.tables import Tables
from fieldlens.streaming.published import AlreadyPublished, Published

#: Blocks of tickets per year; choose them so that a block holds a few hundred MB.
BLOCKS = 8
TICKET_YEAR, UNIT_YEAR = "ANO", "ANO_NF"
#: The driver tables are cleaned in slices of about so many bytes of lines and orders, at most so many.
SLICE_BYTES, MOST_SLICES = 16 << 20, 16


# ------------------------------------------------------------------ writing
def write_partitioned(df: DataFrame, path: str, parts: list[str], sort: list[str]) -> None:
    """``df`` partitioned by ``parts``, rows sorted within each file.  Of a
    table that is there already, only the partitions that ``df`` has rows of
    are replaced (dynamic overwrite); ``df`` must not read ``path``."""
    (df.repartition(*parts).sortWithinPartitions(*parts, *sort).write.partitionBy(*parts)
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))


def _block(ss: Column, tarefa: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(ss, tarefa), F.lit(blocks)).cast("int")


def ticket_rows(tickets: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    return tickets.withColumns({TICKET_YEAR: F.year("INICIO"), "_block": _block(F.col("SS"), F.col("TAREFA"), blocks)})


def write_tickets(tickets: DataFrame, path: str, blocks: int = BLOCKS) -> None:
    write_partitioned(ticket_rows(tickets, blocks), path, [TICKET_YEAR, "_block"], ["INICIO"])


def write_ticket_slices(t: Tables, path: str, as_of: dt.date, blocks: int, slices: int) -> None:
    """``write_tickets`` of all tickets of the driver tables, one slice of
    the orders after the other; the shuffle files of a slice go before the
    next.  ``path`` is new; each slice adds files to it."""
    parts = [TICKET_YEAR, "_block"]

    def deal(rows: DataFrame) -> DataFrame:  # as write_partitioned
        at = _block(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), blocks)
        dealt = rows.withColumns({TICKET_YEAR: F.year("l_shipdate"), "_block": at})
        return dealt.repartition(*parts).sortWithinPartitions(*parts, "l_shipdate")

    for k in range(slices):
        with released_shuffles(t.spark):
            rows = jobs.build_ticket_slice(t, as_of, k, slices, deal, parts)
            rows.write.partitionBy(*parts).mode("append").parquet(path)


def write_units(units: DataFrame, path: str) -> None:
    write_partitioned(units, path, [UNIT_YEAR], ["NUM_SERIAL"])


def text_index(tickets: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(year, block, trigram): one row per block and different trigram hash.
    Equal texts of a block are folded and cut once."""
    names = columns or [c for c in tickets.columns if c not in (TICKET_YEAR, "_block")]
    texts = F.array(*[filters.as_text(tickets, c) for c in names])
    distinct = (tickets.select(TICKET_YEAR, "_block", F.explode(texts).alias("_text")).where(F.length("_text") >= 3)
                .distinct().select(TICKET_YEAR, "_block", folded(F.col("_text")).alias("_text")).where(F.length("_text") >= 3))
    # cut by plain rows and not by a lambda over an array, which is interpreted
    starts = distinct.select("*", F.explode(F.sequence(F.lit(1), F.length("_text") - 2)).alias("_at"))
    index = starts.select(TICKET_YEAR, "_block", F.xxhash64(F.col("_text").substr(F.col("_at"), F.lit(3))).alias("trigram"))
    return index.distinct()


def write_text_index(tickets: DataFrame, path: str, columns: list[str] | None = None, slices: int = 1) -> None:
    """The index of silver tickets at ``path``, which is new: one slice of the
    blocks after the other; the shuffle files of a slice go before the next."""
    for k in range(slices):
        with released_shuffles(tickets.sparkSession):
            index = text_index(tickets.where(F.col("_block") % slices == k) if slices > 1 else tickets, columns)
            index.repartitionByRange("trigram").sortWithinPartitions("trigram").write.mode("append").parquet(path)


def folded(c: Column) -> Column:
    """The text as a case-insensitive match sees it: characters that match
    each other become equal.  (The replacement in between also keeps the
    optimizer from dropping the upper-casing.)  ASCII texts, which have as
    many bytes as characters, need the lower-casing only."""
    upper = F.translate(F.upper(c), "\u0130", "I")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(F.lower(upper), "\u03c2", "\u03c3"))


# ------------------------------------------------------------------ reading
def between(tickets: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """P4 on silver tickets: the start bounds the year, too, so earlier years
    are not read.  (The end bounds FIM, which says nothing about the year.)"""
    if start is not None:
        tickets = tickets.where(F.col(TICKET_YEAR) >= start.year)
    return filters.date_window(tickets, start, end)


def search(tickets: DataFrame, index: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """P5 on silver tickets: rows whose ``columns`` match ``term``; all must be
    in the index.  Blocks without the term's trigrams are not read."""
    names = columns or [c for c in tickets.columns if c not in (TICKET_YEAR, "_block")]
    if len(term) >= 3 and re.fullmatch(r"[\w @,;:/#-]+", term):
        blocks = candidate_blocks(index, term)
        same = tickets[TICKET_YEAR].eqNullSafe(blocks["_y"]) & (tickets["_block"] == blocks["_b"])
        tickets = tickets.join(blocks, same, "left_semi")
    return filters.search_any_column(tickets, term, names)


def candidate_blocks(index: DataFrame, term: str) -> DataFrame:
    """(_y, _b) of the blocks that hold every trigram of the literal ``term``."""
    cut = F.transform(F.sequence(F.lit(1), F.length("_t") - 2), lambda i: F.xxhash64(F.col("_t").substr(i, F.lit(3))))
    one = index.sparkSession.range(1).select(folded(F.lit(term)).alias("_t"))
    wanted = [r[0] for r in one.where("length(_t) >= 3").select(F.explode(F.array_distinct(cut))).collect()]  # of one term
    blocks = index.select(F.col(TICKET_YEAR).alias("_y"), F.col("_block").alias("_b"), "trigram")
    if not wanted:
        return blocks.select("_y", "_b").distinct()
    found = blocks.where(F.col("trigram").isin(wanted)).groupBy("_y", "_b").agg(F.count(F.lit(1)).alias("_n"))
    return found.where(F.col("_n") == len(wanted)).select("_y", "_b")


# ----------------------------------------------------- of the driver tables
def _files(t: Tables, names: list[str]) -> list[tuple[str, int, int]]:
    """(file, bytes, time of change) of the tables' files."""
    jvm, conf = t.spark._jvm, t.spark._jsparkSession.sessionState().newHadoopConf()
    seen = []
    for file in sorted(f for n in names for f in getattr(t, n).inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.append((file, status.getLen(), status.getModificationTime()))
    return seen


def _fingerprint(t: Tables, names: list[str]) -> str:
    """Changes when a file of one of the tables does."""
    return hashlib.sha256("|".join(f"{f}:{n}:{at}" for f, n, at in _files(t, names)).encode()).hexdigest()[:16]


def _slices(t: Tables) -> int:
    size = sum(n for _, n, _ in _files(t, ["lineitem", "orders"]))
    return max(1, min(MOST_SLICES, -(-size // SLICE_BYTES)))


class Silver:
    """Tickets, units and the text index of a folder's tables, written when
    first asked for and again when one of the input files has changed."""

    SOURCES = ["lineitem", "orders", "supplier", "part", "customer", "nation", "region"]

    def __init__(self, t: Tables, as_of: dt.date = views.AS_OF, blocks: int = BLOCKS):
        self.spark = t.spark
        store = Published(t.spark, f"{checkpoint_dir(t.spark)}/fieldlens-silver-{_fingerprint(t, self.SOURCES)}")
        version, content = store.latest()
        if not version:
            content = self._build(t, store, as_of, blocks)
        self.paths = content

    @staticmethod
    def _build(t: Tables, store: Published, as_of: dt.date, blocks: int) -> dict:
        content = {n: store.new_folder(n) for n in ("tickets", "units", "index")}
        slices = _slices(t)
        write_ticket_slices(t, content["tickets"], as_of, blocks, slices)
        with released_shuffles(t.spark):
            write_units(jobs.build_installed_base(t, as_of), content["units"])
        write_text_index(t.spark.read.parquet(content["tickets"]), content["index"], slices=min(slices, blocks))
        try:
            store.publish(content, 0)
        except AlreadyPublished:
            content = store.latest()[1]
        return content

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name])

    @property
    def tickets(self) -> DataFrame:
        return self._read("tickets")

    @property
    def units(self) -> DataFrame:
        return self._read("units")

    @property
    def index(self) -> DataFrame:
        return self._read("index")


def silver_of(t: Tables) -> Silver:
    if not hasattr(t, "_silver"):
        t._silver = Silver(t)
    return t._silver
