"""Maintainer relationship matrix.

Medians over maintainers are exact and found by narrowing ranges
(``medians``), so no task holds all maintainers, of a month or at all.
Global cut-offs and spans are one-row aggregates joined back with a broadcast of
that single row; the monthly cut-offs are one row per calendar month.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import dims
from fieldlens.functions import expr as E
from fieldlens.operators.medians import medians


def prepare_candidates(tickets: DataFrame, as_of: dt.date) -> DataFrame:
    """A15 without the global decision: (MANTENEDOR, DATA_BASE, CHAMADO_KEY,
    AGING_A, AGING_F) where AGING_A is the recorded aging and AGING_F the
    fallback from FIM (or ``as_of``), both clipped at 0.

    Without a FIM column there is no fallback: a ticket whose end is unknown
    has no aging.  The ticket key is CHAMADO, else SS.  The fallback counts
    only when *no* row has an aging value;
    deciding that needs a global aggregate, so the candidates keep both and
    the aggregates below decide on their own (small) output instead of a
    second pass over the tickets.  Rows without a maintainer or start date
    are dropped; an empty ticket key falls back to a generated row id.
    """
    date_col = "INICIO" if "INICIO" in tickets.columns else "DATA"
    aging = F.col("AGING").cast("double") if "AGING" in tickets.columns else F.lit(None).cast("double")
    has_end = "FIM" in tickets.columns
    fim = F.col("FIM").cast("timestamp_ntz") if has_end else F.lit(None).cast("timestamp_ntz")
    key = next((E.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("CHAMADO", "SS") if c in tickets.columns), F.lit(""))
    base = tickets.select(
        E.strip(F.coalesce(F.col("MANTENEDOR").cast("string"), F.lit(""))).alias("MANTENEDOR"),
        F.col(date_col).cast("timestamp_ntz").alias("DATA_BASE"), aging.alias("_aging"), fim.alias("_fim"),
        key.alias("_key"))
    fallback = F.floor(E.seconds_between(F.col("DATA_BASE"),
                                         F.coalesce("_fim", E.as_of_lit(as_of).cast("timestamp_ntz"))) / 86400)
    if not has_end:
        fallback = F.lit(None)
    out = base.select(
        "MANTENEDOR", "DATA_BASE",
        F.when(F.col("_key") == "", F.monotonically_increasing_id().cast("string")).otherwise(F.col("_key")).alias("CHAMADO_KEY"),
        E.clip_zero(F.col("_aging")).alias("AGING_A"), E.clip_zero(fallback.cast("double")).alias("AGING_F"))
    return out.where((F.col("MANTENEDOR") != "") & F.col("DATA_BASE").isNotNull()
                     & (F.col("AGING_A").isNotNull() | F.col("AGING_F").isNotNull()))


def resolve(candidates: DataFrame) -> DataFrame:
    """Row-level A15 result (MANTENEDOR, DATA_BASE, AGING_NUM, CHAMADO_KEY):
    one global flag (a one-row aggregate, broadcast) picks the variant."""
    flag = candidates.agg(F.bool_or(F.col("AGING_A").isNotNull()).alias("_any"))
    j = candidates.crossJoin(F.broadcast(flag))
    aging = F.when(F.coalesce("_any", F.lit(False)), F.col("AGING_A")).otherwise(F.col("AGING_F"))
    return j.select("MANTENEDOR", "DATA_BASE", aging.alias("AGING_NUM"), "CHAMADO_KEY").where(
        F.col("AGING_NUM").isNotNull())


def prepare_source(tickets: DataFrame, as_of: dt.date) -> DataFrame:
    """(MANTENEDOR, DATA_BASE, AGING_NUM, CHAMADO_KEY) rows; rows that are
    prepared already are returned as they are."""
    done = ["MANTENEDOR", "DATA_BASE", "AGING_NUM", "CHAMADO_KEY"]
    if set(done) <= set(tickets.columns):
        return tickets.select(*done)
    return resolve(prepare_candidates(tickets, as_of))


def _volume_aging(df: DataFrame, keys: list) -> DataFrame:
    """Distinct tickets and mean aging per group.

    Two grouped passes instead of ``count_distinct`` (which expands every
    row once per distinct aggregate): (group, ticket) first, carrying sums
    and counts, then the group.  Both levels combine map-side, so a hot
    maintainer is reduced before it moves.  On candidate rows both aging
    variants are aggregated together and the variant is chosen from a flag
    computed over the aggregated groups.
    """
    if "AGING_A" not in df.columns:
        df = df.withColumn("AGING_A", F.col("AGING_NUM")).withColumn("AGING_F", F.lit(None).cast("double"))
    a, f = F.col("AGING_A"), F.col("AGING_F")
    per_ticket = df.groupBy(*keys, "CHAMADO_KEY").agg(
        F.sum(a).alias("_sa"), F.count(a).alias("_ca"), F.sum(f).alias("_sf"), F.count(f).alias("_cf"))
    g = per_ticket.groupBy(*keys).agg(
        F.count_if(F.col("_ca") > 0).alias("_va"), (F.sum("_sa") / F.sum("_ca")).alias("_aa"),
        F.count_if(F.col("_cf") > 0).alias("_vf"), (F.sum("_sf") / F.sum("_cf")).alias("_af"),
        (F.sum("_ca") > 0).alias("_ha"))
    flag = g.agg(F.bool_or("_ha").alias("_any"))
    use_a = F.coalesce(F.col("_any"), F.lit(False))
    j = g.crossJoin(F.broadcast(flag))
    out = j.select(*keys, F.when(use_a, F.col("_va")).otherwise(F.col("_vf")).alias("VOLUME"),
                   F.when(use_a, F.col("_aa")).otherwise(F.col("_af")).alias("AGING_MEDIO_DIAS"))
    return out.where(F.col("VOLUME") > 0)


def matrix(prepared: DataFrame) -> DataFrame:
    """Volume (distinct tickets) and mean aging per maintainer, cut-offs
    at the medians over maintainers, score 1-4 and label; mean rounded to 1."""
    m = _volume_aging(prepared, ["MANTENEDOR"])
    cuts = medians(m, [], {"VOLUME": "VOLUME_CORTE", "AGING_MEDIO_DIAS": "AGING_CORTE"})
    j = m.crossJoin(F.broadcast(cuts))
    score = E.relationship_score("VOLUME", "AGING_MEDIO_DIAS", "VOLUME_CORTE", "AGING_CORTE")
    return j.select("MANTENEDOR", "VOLUME", F.round("AGING_MEDIO_DIAS", 1).alias("AGING_MEDIO_DIAS"),
                    score.alias("SCORE"), E.score_label(score).alias("PERFIL"),
                    "VOLUME_CORTE", "AGING_CORTE").orderBy("SCORE", F.desc("VOLUME"), "MANTENEDOR")  # L5


def monthly_scores(prepared: DataFrame) -> DataFrame:
    """The same score per (month, maintainer) with per-month median cut-offs; by month and name."""
    m = _volume_aging(prepared.withColumn("ANO_MES", E.month_start("DATA_BASE")), ["ANO_MES", "MANTENEDOR"])
    cuts = medians(m, ["ANO_MES"], {"VOLUME": "VOLUME_CORTE_MES", "AGING_MEDIO_DIAS": "AGING_CORTE_MES"})
    m = m.join(F.broadcast(cuts), "ANO_MES")  # one row per calendar month
    score = E.relationship_score("VOLUME", "AGING_MEDIO_DIAS", "VOLUME_CORTE_MES", "AGING_CORTE_MES")
    return m.select("ANO_MES", "MANTENEDOR", "VOLUME", F.round("AGING_MEDIO_DIAS", 1).alias("AGING_MEDIO_DIAS"),
                    "VOLUME_CORTE_MES", "AGING_CORTE_MES", score.alias("SCORE"), E.score_label(score).alias("PERFIL")
                    ).orderBy("ANO_MES", "MANTENEDOR")


def plot_points(mat: DataFrame) -> DataFrame:
    """Spread maintainers that share a point symmetrically by 1.2% of the
    axis span (span floored at 1.0); the order inside a point is by name."""
    grp = Window.partitionBy("VOLUME", "AGING_MEDIO_DIAS")
    spans = mat.agg(F.greatest(F.max("VOLUME") - F.min("VOLUME"), F.lit(1.0)).alias("_xs"),
                    F.greatest(F.max("AGING_MEDIO_DIAS") - F.min("AGING_MEDIO_DIAS"), F.lit(1.0)).alias("_ys"))
    p = (mat.withColumn("DUP_COUNT", F.count(F.lit(1)).over(grp))
         .withColumn("DUP_IDX", F.row_number().over(grp.orderBy("MANTENEDOR")) - 1)
         .crossJoin(F.broadcast(spans)))
    off = F.col("DUP_IDX") - (F.col("DUP_COUNT") - 1) / 2
    return p.select("MANTENEDOR", "VOLUME", "AGING_MEDIO_DIAS", "SCORE", "DUP_COUNT", "DUP_IDX",
                    (F.col("VOLUME") + off * F.col("_xs") * dims.JITTER_FRACTION).alias("VOLUME_PLOT"),
                    (F.col("AGING_MEDIO_DIAS") + off * F.col("_ys") * dims.JITTER_FRACTION).alias("AGING_PLOT"))
