"""Aggregations behind the dashboard charts and option lists.

Top-N reports use ``orderBy(...).limit(n)`` (TakeOrderedAndProject: each
task keeps its own top N, so only N rows per task reach the final merge).
Ties are broken by the key so the cut-off is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import dims
from fieldlens.functions import expr as E


def value_counts_top(df: DataFrame, field: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent non-null values of ``field``."""
    return (df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value"))
            .agg(F.count(F.lit(1)).alias("quantidade"))
            .orderBy(F.desc("quantidade"), F.asc("value")).limit(n))


def mean_aging_by(df: DataFrame, field: str) -> DataFrame:
    return (df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value"))
            .agg(F.avg(F.col("AGING").cast("double")).alias("aging_medio")))


def aging_top_desc(df: DataFrame, field: str, n: int = 20) -> DataFrame:
    """The ``n`` groups with the highest mean aging."""
    return mean_aging_by(df, field).orderBy(F.desc_nulls_last("aging_medio"), F.asc("value")).limit(n)


def aging_best(df: DataFrame, field: str, n: int = 20) -> DataFrame:
    """A10: the ``n`` groups with the lowest mean aging."""
    return mean_aging_by(df, field).orderBy(F.asc_nulls_last("aging_medio"), F.asc("value")).limit(n)


def aging_buckets(df: DataFrame) -> DataFrame:
    """Ticket counts in the three aging buckets; every bucket is present."""
    counts = (df.select(E.aging_bucket("AGING").alias("bucket")).where(F.col("bucket").isNotNull())
              .groupBy("bucket").agg(F.count(F.lit(1)).alias("quantidade")))
    # fixed three-row frame: a bounded broadcast
    b = F.broadcast(dims.aging_bucket_dim(df.sparkSession))
    return (b.join(counts, "bucket", "left")
            .select("bucket", "bucket_order", F.coalesce("quantidade", F.lit(0)).cast("long").alias("quantidade")))


def tag_counts(df: DataFrame, n: int | None = 20, column: str = "TAGS") -> DataFrame:
    """Tag frequencies (count desc, tag asc); ``n=None`` gives all tags."""
    out = (df.select(F.explode(column).alias("tag")).groupBy("tag")
           .agg(F.count(F.lit(1)).alias("quantidade")).orderBy(F.desc("quantidade"), F.asc("tag")))
    return out.limit(n) if n else out


def aging_month_trend(df: DataFrame, field: str, n: int = 10, date_col: str = "DATA") -> DataFrame:
    """Mean aging per (month, field) for the ``n`` categories present in
    the most months (ties by name); null months and null means dropped."""
    m = (df.where(F.col(date_col).isNotNull() & F.col(field).isNotNull())
         .groupBy(E.month_text(date_col).alias("ano_mes"), F.col(field).alias("value"))
         .agg(F.avg(F.col("AGING").cast("double")).alias("aging"))
         .where(F.col("aging").isNotNull()))
    top = (m.groupBy("value").agg(F.count(F.lit(1)).alias("_months"))
           .orderBy(F.desc("_months"), F.asc("value")).limit(n).select("value"))
    return m.join(top, "value", "left_semi")


def state_share(units: DataFrame, column: str = "UF") -> DataFrame:
    """Units per state, share of total (1 decimal), label shown when >= 1%."""
    c = units.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("uf")).agg(
        F.count(F.lit(1)).alias("quantidade"))
    total = c.agg(F.sum("quantidade").alias("_tot"))
    share = F.round(F.col("quantidade") / F.col("_tot") * F.lit(100.0), 1)
    return (c.crossJoin(F.broadcast(total))
            .select("uf", "quantidade", share.alias("percentual"), (share >= 1.0).alias("mostrar_rotulo")))


MOST_CENTROIDS = 10_000


def state_points(units: DataFrame, centroids: DataFrame, column: str = "UF") -> DataFrame:
    """``state_share`` with name and label point of each state.

    ``centroids`` (UF, NOME, LON, LAT) is a fixed dimension given by the caller;
    more than ``MOST_CENTROIDS`` rows or a repeated UF are an error, so its broadcast is bounded
    and no share is doubled.  States without a centroid keep their row with null point and no label.
    """
    known = centroids.select(F.col("UF").alias("uf"), F.col("NOME").alias("nome"), F.col("LON").cast("double").alias("lon"),
                             F.col("LAT").cast("double").alias("lat")).where("uf IS NOT NULL")
    head = known.limit(MOST_CENTROIDS + 1).agg(F.count(F.lit(1)), F.count_distinct("uf")).first()
    if head[0] > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    if head[0] != head[1]:
        raise ValueError("a state has several centroids")
    s = state_share(units, column).join(F.broadcast(known), "uf", "left")
    label = F.concat(F.coalesce("nome", "uf"), F.lit(" "), F.format_string("%.1f%%", "percentual"))
    shown = F.col("mostrar_rotulo") & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return s.select("uf", "nome", "quantidade", "percentual", "lon", "lat", F.when(shown, label).alias("rotulo"))


# ------------------------------------------------------------ option lists
TICKET_OPTION_COLUMNS = ["ESPECIALISTA", "PROPRIETARIO", "MANTENEDOR", "RTM", "GARANTIA", "TIPO", "SERVICO", "MODELO"]


def filter_options(df: DataFrame, columns: list[str] | None = None, tags_column: str | None = "TAGS") -> DataFrame:
    """L2: distinct non-null values per filter column as (field, value) rows,
    plus the tag vocabulary; one pass and one shuffle for all columns."""
    return _option_rows(df, columns, tags_column).distinct()


def _option_rows(df: DataFrame, columns: list[str] | None, tags_column: str | None) -> DataFrame:
    cols = [c for c in (columns or TICKET_OPTION_COLUMNS) if c in df.columns]
    pairs = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols]
    arr = F.array(*pairs)
    if tags_column and tags_column in df.columns:
        arr = F.concat(arr, F.transform(F.col(tags_column), lambda t: F.struct(F.lit("TAGS").alias("field"), t.alias("value"))))
    return (df.select(F.explode(arr).alias("p")).select("p.field", "p.value")
            .where(F.col("value").isNotNull()))


def option_counts(df: DataFrame, columns: list[str] | None = None, tags_column: str | None = "TAGS") -> DataFrame:
    """(field, value, n): how many rows hold each option.  Unlike the lists themselves the counts of two batches can be
    added, and rows that left or changed taken out, so that a nightly update reads its own rows only."""
    return _option_rows(df, columns, tags_column).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_option_counts(counts: DataFrame, added: DataFrame | None = None, retracted: DataFrame | None = None) -> DataFrame:
    """The counts after ``added`` came and ``retracted`` went (each as ``option_counts`` gives them).

    A value that no row holds any more disappears.  Taking out more than there is leaves a negative count, which
    ``options_of`` does not show: the batches may come in any order.
    """
    parts = [counts]
    if added is not None:
        parts.append(added)
    if retracted is not None:
        parts.append(retracted.withColumn("n", -F.col("n")))
    rows = parts[0].select("field", "value", "n")
    for p in parts[1:]:
        rows = rows.unionByName(p.select("field", "value", "n"))
    return rows.groupBy("field", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def options_of(counts: DataFrame) -> DataFrame:
    """L2/L4 from merged counts: the same (field, value) rows as ``filter_options`` of all rows."""
    return counts.where("n > 0").select("field", "value")


def error_options(errors: DataFrame) -> DataFrame:
    """L4: distinct non-blank values of the four error columns."""
    from fieldlens.operators.filters import ERROR_FILTER_COLUMNS
    out = filter_options(errors, ERROR_FILTER_COLUMNS, tags_column=None)
    return out.where(E.strip("value") != "")


def installed_base_options(units: DataFrame, tickets: DataFrame) -> DataFrame:
    """L3: RTM choices (TODOS first), invoice-year range (default 2000-2030)
    and call-count range over the distinct serials (no tickets -> 0)."""
    flags = tickets.where(F.col("CHASSI").isNotNull()).groupBy("CHASSI").agg(F.count(F.lit(1)).alias("n"))
    serials = units.select("NUM_SERIAL").where(F.col("NUM_SERIAL").isNotNull()).distinct()
    sc = serials.join(flags, serials.NUM_SERIAL == flags.CHASSI, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    calls = sc.agg(F.min("n").alias("chamados_min"), F.max("n").alias("chamados_max"))
    # the RTM domain is a handful of flag values, so collecting it is bounded
    rest = units.agg(
        F.concat_ws(",", F.lit("TODOS"), F.array_join(F.array_sort(F.collect_set("RTM")), ",")).alias("rtm_options"),
        F.coalesce(F.min("ANO_NF"), F.lit(2000)).cast("int").alias("ano_min"),
        F.coalesce(F.max("ANO_NF"), F.lit(2030)).cast("int").alias("ano_max"))
    return rest.crossJoin(calls)


def model_bars(share: DataFrame) -> DataFrame:
    """Model shares > 0 as rows, descending, 'Others' last."""
    cols = [c for c in share.columns if c.startswith("pct_")]
    stacked = share.select(F.explode(F.array(*[F.struct(F.lit(c[4:]).alias("modelo"), F.col(c).alias("pct"))
                                               for c in cols])).alias("s")).select("s.*")
    return stacked.where(F.col("pct") > 0).orderBy((F.col("modelo") == "others").asc(), F.desc("pct"))

