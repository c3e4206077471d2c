"""Installed-base and ticket KPIs.

Percentages are ``100.0 * numerator / denominator`` in double precision and
zero when the denominator is zero.  All sets of serials of the reference
become per-serial flag columns produced by one grouped pass over the
tickets and attached with a single left join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import dims
from fieldlens.functions import expr as E
from fieldlens.operators import dedup, joins


def pct(num: Column, den: Column) -> Column:
    return F.when(den > 0, F.lit(100.0) * num / den).otherwise(F.lit(0.0))


def is_startup(service: str = "SERVICO") -> Column:
    """Start-up service (case-sensitive contains; null -> false)."""
    return F.coalesce(F.col(service).contains(dims.STARTUP_SERVICE), F.lit(False))


def is_excluded(summary: str = "SUMARIO") -> Column:
    """Ticket tagged [STB] (any case)."""
    return F.coalesce(F.col(summary).rlike(dims.EXCLUDE_TAG_PATTERN), F.lit(False))


def unit_ticket_flags(tickets: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per serial: start-up set, warranty-call set, error set and call counts.

    One aggregation over the tickets (partial aggregation before the
    shuffle on the serial).  ``has_call``: a non-[STB] ticket that is not a
    start-up; ``has_error``: a ticket whose trimmed SS is in the error base;
    ``n_calls``: all tickets; ``n_valid_calls``: non-[STB] tickets.
    """
    t = tickets.where(F.col("CHASSI").isNotNull()).select("CHASSI", "SS", "SERVICO", "SUMARIO")
    if errors is not None:
        err = errors.select(E.strip(F.col("SS").cast("string")).alias("_ess")).where(F.col("_ess").isNotNull()).distinct()
        t = t.join(err, E.strip(t.SS) == err._ess, "left")
        has_err = F.bool_or(F.col("_ess").isNotNull())
    else:
        has_err = F.lit(False)
    startup = is_startup()
    stb = is_excluded()
    return t.groupBy("CHASSI").agg(
        F.bool_or(startup).alias("has_startup"),
        F.bool_or(~stb & ~startup).alias("has_call"),
        has_err.alias("has_error"),
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(~stb).alias("n_valid_calls"),
    )


def _attach_flags(units: DataFrame, flags: DataFrame, per_serial: bool = True) -> DataFrame:
    """Units with the flags of their serial.  ``per_serial``: ``units`` is
    grouped itself (a few rows per serial), else a serial can have any share
    of the rows."""
    if per_serial:
        f = flags.withColumnRenamed("CHASSI", "_fk")
        j = units.join(f, units.NUM_SERIAL == f._fk, "left")
    else:
        j = joins.join_dimension(units, flags, "NUM_SERIAL", "CHASSI")
    return j.select(*units.columns,
                    *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("has_startup", "has_call", "has_error")],
                    *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_calls", "n_valid_calls")])


YEAR_COLUMNS = ["ano", "units_sales", "start_up_own", "pct_with_tickets", "pct_under_warranty",
                "pct_under_electronic_warranty", "pct_error_rtm_ticket"]


def rtm_analysis_by_year(units: DataFrame, tickets: DataFrame, errors: DataFrame, rtm: str,
                         as_of: dt.date) -> DataFrame:
    """Per invoice year + a Total row for the units with ``RTM == rtm``.

    Per year: distinct serials (first row per (year, serial) by invoice date,
    then order key), % with start-up, % with a warranty call, % under
    warranty (DENTRO, or no status and inside the electronic warranty), %
    under electronic warranty, % with a monitoring-error ticket.
    Total: units = sum of the yearly units; percentages over the serials
    deduplicated across all years (first row overall).
    """
    base = units.where((F.col("RTM") == rtm) & F.col("NUM_SERIAL").isNotNull()).select(
        "ANO_NF", "NUM_SERIAL", "DT_NUM_NF", "ORDER_KEY", "STATUS_GARANTIA")
    firsts = dedup.first_per_key(base, ["ANO_NF", "NUM_SERIAL"], [F.col("DT_NUM_NF"), F.col("ORDER_KEY")])
    j = _attach_flags(firsts, unit_ticket_flags(tickets, errors))
    j = j.withColumn("elec", E.electronic_warranty_active("DT_NUM_NF", as_of)) \
         .withColumn("warr", E.effective_warranty("STATUS_GARANTIA", "DT_NUM_NF", as_of))

    def metrics(prefix: str, n: Column) -> list[Column]:
        return [
            pct(F.count_if(F.col(f"{prefix}has_startup")), n).alias("start_up_own"),
            pct(F.count_if(F.col(f"{prefix}has_call")), n).alias("pct_with_tickets"),
            pct(F.count_if(F.col(f"{prefix}warr")), n).alias("pct_under_warranty"),
            pct(F.count_if(F.col(f"{prefix}elec")), n).alias("pct_under_electronic_warranty"),
            pct(F.count_if(F.col(f"{prefix}has_error")), n).alias("pct_error_rtm_ticket"),
        ]

    # the null-year group is dropped *after* aggregating, through an
    # aggregate output: a filter on the key would be pushed below the join,
    # making this branch differ from the Total branch, and the shared join
    # (scans and shuffles) would then be computed twice instead of reused
    per_year = (j.groupBy("ANO_NF")
                .agg(F.count(F.lit(1)).alias("units_sales"), *metrics("", F.count(F.lit(1))),
                     F.bool_or(F.col("ANO_NF").isNotNull()).alias("_has_year"))
                .where(F.col("_has_year"))
                .select(F.col("ANO_NF").cast("string").alias("ano"), *YEAR_COLUMNS[1:]))
    # overall first row per serial = the smallest of its per-year first rows
    packed = F.struct(F.col("DT_NUM_NF").isNull().alias("_n"), F.col("DT_NUM_NF").alias("_d"),
                      F.col("ORDER_KEY").alias("_k"), "has_startup", "has_call", "has_error", "elec", "warr")
    per_serial = j.groupBy("NUM_SERIAL").agg(F.min(packed).alias("f"),
                                              F.count_if(F.col("ANO_NF").isNotNull()).alias("n_years"))
    total = (per_serial.agg(F.sum("n_years").alias("units_sales"), *metrics("f.", F.count(F.lit(1))),
                            F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") > 0)
             .select(F.lit("Total").alias("ano"), *YEAR_COLUMNS[1:]))
    return per_year.unionByName(total)


def rtm_summary(units: DataFrame, tickets: DataFrame, rtm: str, as_of: dt.date) -> DataFrame:
    """Total units (sum of per-year distinct serials), active 36-month
    warranties, active electronic warranties and units with any ticket
    (over serials deduplicated across years)."""
    base = units.where((F.col("RTM") == rtm) & F.col("NUM_SERIAL").isNotNull()).select(
        "ANO_NF", "NUM_SERIAL", "DT_NUM_NF", "ORDER_KEY", "STATUS_GARANTIA", "GARANTIA")
    firsts = dedup.first_per_key(base, ["ANO_NF", "NUM_SERIAL"], [F.col("DT_NUM_NF"), F.col("ORDER_KEY")])
    called = tickets.where(F.col("CHASSI").isNotNull()).select(F.col("CHASSI").alias("_c")).distinct()
    j = firsts.join(called, firsts.NUM_SERIAL == called._c, "left")
    packed = F.struct(F.col("DT_NUM_NF").isNull().alias("_n"), F.col("DT_NUM_NF").alias("_d"),
                      F.col("ORDER_KEY").alias("_k"),
                      ((F.col("GARANTIA") == dims.WARRANTY_PERIODS["36_MESES"]) & (F.col("STATUS_GARANTIA") == "DENTRO")).alias("w36"),
                      E.electronic_warranty_active("DT_NUM_NF", as_of).alias("elec"))
    per_serial = j.groupBy("NUM_SERIAL").agg(F.min(packed).alias("f"),
                                              F.count_if(F.col("ANO_NF").isNotNull()).alias("n_years"),
                                              F.bool_or(F.col("_c").isNotNull()).alias("known"))
    return per_serial.agg(
        F.coalesce(F.sum("n_years"), F.lit(0)).cast("long").alias("total_units"),
        F.count_if(F.coalesce(F.col("f.w36"), F.lit(False))).alias("chassis_36m_warranty"),
        F.count_if(F.col("f.elec")).alias("chassis_under_electronic_warranty"),
        F.count_if(F.col("known")).alias("installed_base_known"),
    )


def installed_base_kpis(units: DataFrame, tickets: DataFrame) -> DataFrame:
    """A3: seven percentages over the filtered installed base.

    Denominator: rows.  Numerators: distinct serials in a set (start-up,
    warranty call, RTM, DENTRO, FORA) except third-party start-up, which
    counts rows classified 'SIM - TERCEIRO' (F22 on valid call counts).
    The units are grouped per serial before they meet the ticket flags, so a
    serial with many rows joins as one, and the overall counts need no
    ``count_distinct``, which would expand every row five times.
    """
    grouped = units.groupBy("NUM_SERIAL").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.bool_or(F.coalesce(F.col("RTM") == "SIM", F.lit(False))).alias("_rtm"),
        F.bool_or(F.coalesce(F.col("STATUS_GARANTIA") == "DENTRO", F.lit(False))).alias("_in"),
        F.bool_or(F.coalesce(F.col("STATUS_GARANTIA") == "FORA", F.lit(False))).alias("_out"))
    third = E.startup_status("has_startup", "n_valid_calls") == dims.STARTUP_THIRD_PARTY
    per_serial = _attach_flags(grouped, unit_ticket_flags(tickets)).withColumns({
        "_third": F.when(third, F.col("_rows")).otherwise(0), "_su": F.col("has_startup"), "_call": F.col("has_call"),
        "_nocall": ~F.col("has_call")})
    n = F.coalesce(F.sum("_rows"), F.lit(0))
    known = F.col("NUM_SERIAL").isNotNull()

    def serials(flag: str) -> Column:
        return F.count_if(known & F.col(flag))

    return per_serial.agg(
        pct(serials("_su"), n).alias("pct_com_partida_propria"),
        pct(F.coalesce(F.sum("_third"), F.lit(0)), n).alias("pct_com_partida_terceiros"),
        pct(serials("_call"), n).alias("pct_com_chamado"),
        pct(serials("_nocall"), n).alias("pct_sem_chamado"),
        pct(serials("_rtm"), n).alias("pct_rtm"),
        pct(serials("_in"), n).alias("pct_em_garantia"),
        pct(serials("_out"), n).alias("pct_fora_garantia"),
    )


def startup_status_counts(units: DataFrame, tickets: DataFrame) -> DataFrame:
    """F22 per row, counted by class."""
    j = _attach_flags(units.groupBy("NUM_SERIAL").agg(F.count(F.lit(1)).alias("_rows")), unit_ticket_flags(tickets))
    return (j.select(E.startup_status("has_startup", "n_valid_calls").alias("partida_inicial"), "_rows")
            .groupBy("partida_inicial").agg(F.sum("_rows").alias("n")))


def warranty_distribution(units: DataFrame, column: str = "GARANTIA") -> DataFrame:
    """A4: share of each standard period among rows with a numeric warranty."""
    g = F.col(column).cast("string").try_cast("double")
    n = F.count(g)
    return units.agg(*[pct(F.count_if(g == d), n).alias(f"pct_{m}m")
                       for m, d in ((6, 183), (12, 365), (18, 548), (24, 730), (36, 1095))])


def error_value_summary(errors: DataFrame) -> DataFrame:
    """A5: mean and sum of the error values (null/empty -> 0)."""
    tot = F.col("VALOR_TOTAL").cast("double")
    peca = F.col("VALOR_PECA").cast("double")
    return errors.agg(
        F.coalesce(F.avg(tot), F.lit(0.0)).alias("media_valor_total"),
        F.coalesce(F.avg(peca), F.lit(0.0)).alias("media_valor_peca"),
        F.coalesce(F.sum(tot), F.lit(0.0)).alias("soma_valor_total"),
        F.coalesce(F.sum(peca), F.lit(0.0)).alias("soma_valor_peca"),
    )


def ticket_kpis(tickets: DataFrame) -> DataFrame:
    """A1: total, open, closed (null status counts as closed), mean aging,
    % with GARANTIA = DENTRO, % with RTM = SIM."""
    n = F.count(F.lit(1))
    return tickets.agg(
        n.alias("total"),
        F.count_if(F.col("STATUS") == dims.STATUS_OPEN).alias("abertos"),
        F.count_if(~F.col("STATUS").eqNullSafe(dims.STATUS_OPEN)).alias("fechados"),
        F.avg(F.col("AGING").cast("double")).alias("aging_medio"),
        pct(F.count_if(F.col("GARANTIA") == "DENTRO"), n).alias("pct_garantia"),
        pct(F.count_if(F.col("RTM") == "SIM"), n).alias("pct_rtm"),
    )


def ticket_unit_kpis(tickets: DataFrame, units: DataFrame) -> DataFrame:
    """A1 over J10: the ticket KPIs with the warranty status of each ticket's
    unit.  The tickets are summed per serial before they meet the units, so a
    serial with any share of the tickets joins as one row."""
    aging = F.col("AGING").cast("double")
    grouped = tickets.groupBy("CHASSI").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("STATUS") == dims.STATUS_OPEN).alias("_open"),
        F.count_if(~F.col("STATUS").eqNullSafe(dims.STATUS_OPEN)).alias("_closed"),
        F.sum(aging).alias("_aging"), F.count(aging).alias("_aged"), F.count_if(F.col("RTM") == "SIM").alias("_rtm"))
    first = unit_of_serial(units).withColumnRenamed("NUM_SERIAL", "_u")
    j = grouped.join(first, grouped.CHASSI == first._u, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n = total("_n")
    return j.agg(
        n.alias("total"), total("_open").alias("abertos"), total("_closed").alias("fechados"),
        F.try_divide(F.sum("_aging"), F.sum("_aged")).alias("aging_medio"),
        pct(total(F.when(F.col("GARANTIA") == "DENTRO", F.col("_n"))), n).alias("pct_garantia"),
        pct(total("_rtm"), n).alias("pct_rtm"),
    )


def model_share(df: DataFrame, column: str = "MODELO") -> DataFrame:
    """A2: % of rows per main model (0 if absent) and % of other non-null models."""
    n = F.count(F.lit(1))
    m = F.col(column)
    return df.agg(*[pct(F.count_if(m == x), n).alias(f"pct_{x.lower()}") for x in dims.MAIN_MODELS],
                  pct(F.count_if(m.isNotNull() & ~m.isin(*dims.MAIN_MODELS)), n).alias("pct_others"))


def unit_of_serial(units: DataFrame) -> DataFrame:
    """(NUM_SERIAL, MODELO, GARANTIA) of the first invoice of each serial."""
    first = dedup.first_per_key(units.select("NUM_SERIAL", "DT_NUM_NF", "ORDER_KEY", "MODELO", "STATUS_GARANTIA"),
                                ["NUM_SERIAL"], [F.col("DT_NUM_NF"), F.col("ORDER_KEY")])
    return first.select("NUM_SERIAL", "MODELO", F.col("STATUS_GARANTIA").alias("GARANTIA"))


#: The columns that tell tickets apart.
TICKET_ID = ["SS", "TAREFA"]
#: What ``tickets_with_units`` adds to a ticket.
UNIT_COLUMNS = ["MODELO", "GARANTIA"]


def tickets_with_units(tickets: DataFrame, units: DataFrame) -> DataFrame:
    """Each ticket gets the model and warranty status of its unit (first
    invoice per serial); tickets of unknown units get NULLs."""
    return joins.join_dimension(tickets, unit_of_serial(units), "CHASSI", "NUM_SERIAL",
                                [c for c in TICKET_ID if c in tickets.columns])
