"""Scalar expressions (Column -> Column), all JVM-side built-ins.

None of these use Python UDFs, so every projection stays inside whole-stage
codegen.  Time-dependent expressions take ``as_of`` explicitly.
"""

from __future__ import annotations

import datetime as dt
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.functions import dims

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: ASCII white space, no-break space and the other blanks that a text export may hold
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2007\u202f\u3000\ufeff"


def strip(c: ColumnOrName, cheap: bool | None = None) -> Column:
    """The text without white space of any kind at its ends.

    Trimming by a set looks every character up, at twice the cost of a plain
    trim, so a text is trimmed only if its first or last character is blank.
    That names ``c`` several times: it is done for a column name, or where
    ``cheap`` says that ``c`` costs nothing to evaluate again.
    """
    s = _c(c)
    trimmed = F.trim(s, F.lit(BLANKS))
    if not (isinstance(c, str) if cheap is None else cheap):
        return trimmed
    blank = F.contains(F.lit(BLANKS), F.left(s, F.lit(1))) | F.contains(F.lit(BLANKS), F.right(s, F.lit(1)))
    return F.when(blank, trimmed).otherwise(s)


def as_of_lit(as_of: dt.date) -> Column:
    return F.lit(as_of).cast("date")


# F1 ----------------------------------------------------------------------
def clean_serial(c: ColumnOrName, legacy: bool = False) -> Column:
    """Serial clean-up: null -> '', trim, drop '.0', '' -> 'N/A'.

    Canonical mode removes only a trailing '.0' (a float-formatted integer);
    ``legacy=True`` removes every '.0' substring.
    """
    s = strip(F.coalesce(_c(c).cast("string"), F.lit("")))
    s = F.replace(s, F.lit(".0"), F.lit("")) if legacy else F.regexp_replace(s, r"\.0$", "")
    return F.when(s == "", F.lit("N/A")).otherwise(s)


# F2 ----------------------------------------------------------------------
def rtm_flag_from_text(c: ColumnOrName) -> Column:
    """'SIM' when the text contains RTM (any case), else 'NÃO' (null too)."""
    return F.when(F.coalesce(F.upper(_c(c)).contains("RTM"), F.lit(False)), "SIM").otherwise("NÃO")


# F3 ----------------------------------------------------------------------
def trim_strings(df, upper: bool = False):
    """Trim (optionally upper-case) every string column of ``df``."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.simpleString() == "string":
            e = strip(f.name)
            cols.append((F.upper(e) if upper else e).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# F4 ----------------------------------------------------------------------
# (shape of the text, pattern that parses it) of the usual texts; the shape
# test is a cheap regex, so every row tries one pattern instead of failing
# through several
DAY_FIRST_FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "d/M/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "d/M/yyyy H:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
]
# every other text that is a date: year first, or day first with a year of
# two or four digits; one separator; hours and minutes, seconds, a fraction
OTHER_DATES = (r"^(\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3(\d{4}|\d{2}))"
               r"([ T]+\d{1,2}:\d{2}(:\d{2}([.,]\d{1,9})?)?Z?)?$")
#: Two-digit years from here on are of the last century.
CENTURY = 69


def _date_from_fields(s: Column) -> Column:
    """The fields of a text of the shape ``OTHER_DATES`` as a timestamp (NULL if there is no such day or time)."""
    fields = F.split(F.regexp_replace(s, "[^0-9]+", " "), " ")
    number = lambda i: F.try_element_at(fields, F.lit(i + 1)).try_cast("int")
    year_first = s.rlike(r"^\d{4}")
    year = F.when(year_first, number(0)).otherwise(number(2))
    short = ~year_first & s.rlike(r"^\d+\D\d+\D\d{2}(\D|$)")
    year = F.when(short, year + F.when(year >= CENTURY, 1900).otherwise(2000)).otherwise(year)
    zero = F.lit(0)
    fraction = F.coalesce(F.rpad(F.try_element_at(fields, F.lit(7)), 6, "0").substr(1, 6), F.lit("0"))
    seconds = F.concat(F.coalesce(number(5), zero).cast("string"), F.lit("."), fraction).try_cast("decimal(16,6)")
    return F.try_make_timestamp(year, number(1), F.when(year_first, number(2)).otherwise(number(0)),
                                F.coalesce(number(3), zero), F.coalesce(number(4), zero), seconds)


def parse_day_first(c: ColumnOrName) -> Column:
    """Date text -> timestamp; the day comes first unless the year does.

    ``15/3/2023``, ``15-03-2023``, ``15.03.2023``, ``5/1/24``, ``2024/05/01``
    and ``2024-05-01``, each alone or with ``10:30``, ``10:30:15`` or
    ``10:30:15.25``; anything else is NULL.  Two-digit years are 1969 to 2068.
    """
    s = strip(_c(c).cast("string"))
    out = None
    for shape, pattern in DAY_FIRST_FORMATS:
        txt = F.regexp_replace(s, "T", " ") if "T" in shape else s
        parsed = F.try_to_timestamp(txt, F.lit(pattern))
        out = F.when(s.rlike(shape), parsed) if out is None else out.when(s.rlike(shape), parsed)
    return out.when(s.rlike(OTHER_DATES), _date_from_fields(s))


# F5 ----------------------------------------------------------------------
def decimal_comma_number(c: ColumnOrName) -> Column:
    """'1234,5' -> 1234.5; null or junk -> 0."""
    s = F.replace(strip(_c(c).cast("string")), F.lit(","), F.lit("."))
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


# F6 ----------------------------------------------------------------------
def lenient_int(c: ColumnOrName) -> Column:
    """Number-or-0 truncated to int ('365.7' -> 365, 'x' -> 0)."""
    return F.coalesce(_c(c).cast("string").try_cast("double").try_cast("int"), F.lit(0))


# F7 ----------------------------------------------------------------------
def year_from_text(c: ColumnOrName) -> Column:
    """Year from the first run of four digits in the text."""
    return F.regexp_extract(_c(c).cast("string"), r"(\d{4})", 1).try_cast("int")


# F8 / F9 -----------------------------------------------------------------
def state_from_address(c: ColumnOrName) -> Column:
    return F.nullif(F.regexp_extract(_c(c), r",\s*([A-Z]{2}),\s*BR", 1), F.lit(""))


def country_from_address(c: ColumnOrName) -> Column:
    return F.nullif(F.regexp_extract(strip(_c(c)), r",\s*([A-Z]{2})\s*$", 1), F.lit(""))


# F10 ---------------------------------------------------------------------
def extract_tags(c: ColumnOrName) -> Column:
    """All '[x]' tags, trimmed, upper-cased, distinct and sorted; none -> ['Sem Tags'].

    Empty tags ('[]') are dropped before the 'Sem Tags' default applies.
    """
    raw = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(r"\[(.*?)\]"), F.lit(1))
    tags = F.array_sort(F.array_distinct(F.filter(F.transform(raw, lambda t: F.upper(strip(t, cheap=True))),
                                                  lambda t: t != "")))
    return F.when(F.size(tags) == 0, F.array(F.lit(dims.NO_TAGS))).otherwise(tags)


# F11 ---------------------------------------------------------------------
def pump_code(c: ColumnOrName) -> Column:
    """Second '-' part of a metering-pump description, else ''."""
    s = strip(_c(c))
    part = strip(F.try_element_at(F.split(s, "-"), F.lit(2)))
    return F.coalesce(F.when(s.startswith(dims.PUMP_DESCRIPTION_PREFIX), part), F.lit(""))


# F12 ---------------------------------------------------------------------
def seconds_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Elapsed seconds between two wall-clock timestamps (``timestamp_ntz``).

    Computed as calendar days x 86400 plus the time-of-day difference, so no
    session time zone (and no daylight-saving day of 23 or 25 hours) enters
    the result.
    """
    s, e = _c(start).cast("timestamp_ntz"), _c(end).cast("timestamp_ntz")

    def tod(x: Column) -> Column:
        return (F.hour(x) * 3600 + F.minute(x) * 60).cast("double") + F.extract(F.lit("SECOND"), x).cast("double")

    return F.date_diff(e.cast("date"), s.cast("date")).cast("double") * 86400 + (tod(e) - tod(s))


def aging_days(start: ColumnOrName, end: ColumnOrName, status: ColumnOrName, as_of: dt.date) -> Column:
    """Whole elapsed 24-hour periods; open tickets without an end run to ``as_of``."""
    end_c = F.when(_c(end).isNull() & (_c(status) == dims.STATUS_OPEN),
                   as_of_lit(as_of).cast("timestamp_ntz")).otherwise(_c(end).cast("timestamp_ntz"))
    return F.floor(seconds_between(start, end_c) / F.lit(86400)).cast("int")


# F13 ---------------------------------------------------------------------
def warranty_end(invoice_date: ColumnOrName, days: ColumnOrName) -> Column:
    return F.date_add(_c(invoice_date).cast("date"), _c(days).cast("int"))


def warranty_status(invoice_date: ColumnOrName, days: ColumnOrName, as_of: dt.date) -> Column:
    """DENTRO if end >= as_of, FORA if before, '' if end unknown."""
    end = warranty_end(invoice_date, days)
    return (F.when(end.isNull(), F.lit(""))
            .when(end >= as_of_lit(as_of), F.lit("DENTRO")).otherwise(F.lit("FORA")))


# F14 ---------------------------------------------------------------------
def electronic_warranty_end(invoice_date: ColumnOrName) -> Column:
    return F.date_add(_c(invoice_date).cast("date"), dims.ELECTRONIC_WARRANTY_DAYS)


def electronic_warranty_active(invoice_date: ColumnOrName, as_of: dt.date) -> Column:
    return F.coalesce(electronic_warranty_end(invoice_date) >= as_of_lit(as_of), F.lit(False))


def electronic_warranty_status(invoice_date: ColumnOrName, as_of: dt.date) -> Column:
    """DENTRO / FORA; an unknown invoice date counts as FORA."""
    return F.when(electronic_warranty_active(invoice_date, as_of), "DENTRO").otherwise("FORA")


# F15 ---------------------------------------------------------------------
def spreadsheet_date_text(c: ColumnOrName) -> Column:
    """Spreadsheet day number (decimal comma ok) -> dd/MM/yyyy; dates formatted; other text kept."""
    s = _c(c).cast("string")
    num = F.replace(strip(s), F.lit(","), F.lit(".")).try_cast("double")
    num = F.when(F.abs(num) < float("inf"), num)  # 'NaN' and 'inf' are text like any other
    from_serial = F.date_format(F.date_add(F.lit(dims.SPREADSHEET_EPOCH).cast("date"),
                                           F.floor(num).try_cast("int")), "dd/MM/yyyy")
    from_text = F.date_format(parse_day_first(s), "dd/MM/yyyy")
    return F.coalesce(F.when(num.isNotNull(), from_serial), from_text, s, F.lit(""))


# F16 ---------------------------------------------------------------------
def item_prefix(c: ColumnOrName) -> Column:
    """Upper-cased, trimmed text before the first '-'."""
    return F.upper(strip(F.split(F.coalesce(_c(c).cast("string"), F.lit("")), "-").getItem(0)))


def model_from_prefix(prefix: ColumnOrName) -> Column:
    """Map an item prefix to its model with a literal map (25 entries, no join needed)."""
    m = F.create_map(*[F.lit(x) for kv in dims.MODEL_MAPPING.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _c(prefix)), F.lit(dims.OTHER_MODEL))


# F17 ---------------------------------------------------------------------
def warranty_label(c: ColumnOrName, text: bool = False) -> Column:
    """Duration label from a warranty value.

    Missing -> 'Não informado' (numeric column: null, NaN or 0; text column:
    null or '').  Junk, NaN/inf text, < 0, > 3650 or a non-standard period ->
    'Outros'.  So text '0' is 'Outros' while numeric 0 is 'Não informado'.
    """
    col = _c(c)
    if text:
        num = strip(col).try_cast("double")
        missing = col.isNull() | (col == "")
    else:
        num = col.cast("double")
        missing = col.isNull() | F.isnan(num) | (num == 0)
    valid = num.isNotNull() & ~F.isnan(num) & (num >= 0) & (num <= dims.MAX_WARRANTY_DAYS)
    days = F.when(valid, num.cast("int"))
    label = F.lit(dims.WARRANTY_OTHER)
    for d, txt in sorted(dims.WARRANTY_LABELS.items(), reverse=True):
        label = F.when(days == d, F.lit(txt)).otherwise(label)
    return F.when(missing, F.lit(dims.WARRANTY_NOT_INFORMED)).otherwise(label)


# F18 / F19 ---------------------------------------------------------------
def _strip_warranty_prefixes(c: Column) -> Column:
    s = strip(F.upper(c.cast("string")))
    for p in dims.WARRANTY_TEXT_PREFIXES:
        s = strip(F.replace(s, F.lit(p), F.lit("")))
    return s


def _pattern_days(s: Column, longest_first: bool, boundary: bool) -> Column:
    items = list(dims.WARRANTY_TEXT_TO_DAYS.items())
    if longest_first:
        items = sorted(items, key=lambda kv: len(kv[0]), reverse=True)
    out = None
    for pat, days in reversed(items):
        hit = s.rlike(r"(^|\D)" + pat) if boundary else s.contains(pat)
        out = F.when(hit, F.lit(days)) if out is None else F.when(hit, F.lit(days)).otherwise(out)
    return out


def _warranty_parts(col: Column) -> dict[str, Column]:
    s = _strip_warranty_prefixes(col)
    txt = strip(col.cast("string"))
    return {
        "blank": col.isNull() | (txt == "") | (F.upper(txt) == dims.NOT_FOUND),
        "s": s,
        "months": F.regexp_extract(s, r"(\d+)[\s\u00a0]*(MES|MONTH|M)", 1).try_cast("int"),
        "years": F.regexp_extract(s, r"(\d+)[\s\u00a0]*(ANO|YEAR|Y)", 1).try_cast("int"),
        "numeric": F.replace(txt, F.lit(","), F.lit(".")).try_cast("double"),
    }


def _warranty_days_from(p: dict[str, Column], mode: str) -> Column:
    blank, s, months, years, numeric = p["blank"], p["s"], p["months"], p["years"], p["numeric"]
    if mode == "numeric":
        return F.coalesce(numeric.try_cast("int"), F.lit(0))
    if mode == "legacy":
        val = F.coalesce(
            numeric.try_cast("int"),
            _pattern_days(s, longest_first=False, boundary=False),
            F.floor(months * F.lit(dims.DAYS_PER_MONTH)).try_cast("int"),
            (years.cast("long") * 365).try_cast("int"),
            F.lit(0),
        )
        return F.when(blank, F.lit(0)).otherwise(val)
    if mode != "canonical":
        raise ValueError(f"unknown warranty mode {mode!r}")
    mdays = F.floor(months * F.lit(dims.DAYS_PER_MONTH))
    *steps, last = sorted(dims.WARRANTY_LABELS)
    snapped = F.lit(last)
    for step in reversed(steps):
        snapped = F.when(mdays <= step, step).otherwise(snapped)
    by_years = F.when(years == 1, 365).when(years == 2, 730).when(years == 3, 1095)
    # a purely numeric text can match no pattern, so trying it first is
    # equivalent and skips every regex for the common numeric values
    val = F.coalesce(numeric.try_cast("int"), _pattern_days(s, longest_first=True, boundary=True),
                     F.when(months.isNotNull(), snapped), by_years)
    return F.when(blank, F.lit(None).cast("int")).otherwise(val.try_cast("int"))


def warranty_text_to_days(c: ColumnOrName, mode: str = "canonical") -> Column:
    """Warranty text -> days (as int; unparseable -> NULL in canonical mode).

    ``canonical``: a plain number is taken as days; else longest pattern
    first with a digit boundary, then N months snapped up to
    183/365/548/730/1095, then 1/2/3 years.
    ``legacy``: numeric first, patterns in dictionary order (so '36 MESES'
    hits '6 MESES'), months x 30.44 and years x 365 unsnapped, else 0.
    ``numeric``: number-or-0.

    ``coalesce`` stops at the first non-null branch, so cheap checks run
    first and the regex branches only for texts that need them.
    """
    return _warranty_days_from(_warranty_parts(_c(c)), mode)


# character references -------------------------------------------------------
_REFERENCES = r"(?s)&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});?|[^&]+|&"


def _code_point(cp: Column) -> Column:
    """The character of a number; 128 to 159 are read as Windows-1252, as browsers do; no character: U+FFFD."""
    windows = {n: bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}
    in_windows = F.create_map(*[F.lit(x) for kv in windows.items() for x in kv])
    valid = (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    return (F.when(cp.between(128, 159), F.try_element_at(in_windows, cp))
            .when(valid, F.decode(F.unhex(F.lpad(F.hex(cp.cast("long")), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd")))


def decode_references(c: ColumnOrName) -> Column:
    """HTML character references as the characters they stand for: decimal,
    hexadecimal and the names of HTML 4; unknown names stay as they are."""
    names = F.create_map(*[F.lit(x) for name, cp in sorted(name2codepoint.items()) for x in (name, chr(cp))])

    def one(t: Column) -> Column:
        name = F.regexp_extract(t, "^&([A-Za-z][A-Za-z0-9]*);?$", 1)
        number = F.when(t.rlike("^&#[0-9]"), F.regexp_extract(t, "([0-9]+)", 1).try_cast("int")) \
            .when(t.rlike("^&#[xX]"), F.conv(F.regexp_extract(t, "^&#[xX]([0-9a-fA-F]+)", 1), 16, 10).try_cast("int"))
        return F.when(~t.startswith("&"), t).when(number.isNotNull(), _code_point(number)).otherwise(F.coalesce(F.try_element_at(names, name), t))

    text = _c(c)
    return F.when(text.contains("&"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_REFERENCES), F.lit(0)), one), "")).otherwise(text)


def text_pieces(c: ColumnOrName) -> Column:
    """The texts between the tags of some markup, decoded and stripped, without the empty ones."""
    return F.filter(F.transform(F.split(_c(c), "<[^>]*>"), lambda t: strip(decode_references(t))), lambda t: t != "")


# F20 / F21 ---------------------------------------------------------------
def bluetooth_flag(html: ColumnOrName) -> Column:
    return F.when(F.coalesce(F.upper(_c(html)).rlike("BLUETOOTH|BLUETOOH"), F.lit(False)), "SIM").otherwise("NAO")


def warranty_sentence(html: ColumnOrName) -> Column:
    """Text of the first <td> starting with GARANTIA/WARRANTY, else 'NAO ENCONTRADO'."""
    cells = F.regexp_extract_all(F.coalesce(_c(html), F.lit("")), F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    near = F.filter(cells, lambda t: t.rlike(r"(?i)garantia|warranty|&"))  # the others cannot begin with either word
    texts = F.transform(near, lambda t: strip(F.regexp_replace(F.array_join(text_pieces(t), " "), r"\s+", " ")))
    hits = F.filter(texts, lambda t: F.upper(t).startswith("GARANTIA") | F.upper(t).startswith("WARRANTY"))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(dims.NOT_FOUND))


# F22 ---------------------------------------------------------------------
def startup_status(in_startup_set: ColumnOrName, call_count: ColumnOrName) -> Column:
    return (F.when(F.coalesce(_c(in_startup_set), F.lit(False)), F.lit(dims.STARTUP_OWN))
            .when(F.coalesce(_c(call_count), F.lit(0)) > 0, F.lit(dims.STARTUP_THIRD_PARTY))
            .otherwise(F.lit(dims.STARTUP_NONE)))


# F23 ---------------------------------------------------------------------
def aging_bucket(aging: ColumnOrName) -> Column:
    a = _c(aging)
    return (F.when(a.isNull() | (a < 0), F.lit(None).cast("string"))
            .when(a <= 7, F.lit(dims.AGING_LABELS[0]))
            .when(a <= 14, F.lit(dims.AGING_LABELS[1]))
            .otherwise(F.lit(dims.AGING_LABELS[2])))


# F24 / F25 ---------------------------------------------------------------
def relationship_score(volume: ColumnOrName, aging: ColumnOrName,
                       volume_cut: ColumnOrName, aging_cut: ColumnOrName) -> Column:
    v, a, vc, ac = _c(volume), _c(aging), _c(volume_cut), _c(aging_cut)
    high_volume = v >= vc
    fast = a <= ac
    return (F.when(v.isNull() | a.isNull(), F.lit(3))
            .when(high_volume & fast, F.lit(1))
            .when(~high_volume & fast, F.lit(2))
            .when(~high_volume & ~fast, F.lit(3))
            .otherwise(F.lit(4)))


def score_label(score: ColumnOrName) -> Column:
    m = F.create_map(*[F.lit(x) for kv in dims.RELATIONSHIP_SCORE_LABELS.items() for x in kv])
    return F.try_element_at(m, _c(score))


# F26 ---------------------------------------------------------------------
def clip_zero(c: ColumnOrName) -> Column:
    return F.when(_c(c).isNull(), None).otherwise(F.greatest(_c(c), F.lit(0)))


# F27 ---------------------------------------------------------------------
def currency_text(c: ColumnOrName) -> Column:
    """R$ 1.234,56 (swap the separators of format_number)."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(_c(c), 2), ",.", ".,"))


# F28 ---------------------------------------------------------------------
def fill_rtm_before_year(rtm: ColumnOrName, year: ColumnOrName, target_year: int) -> Column:
    blank = _c(rtm).isNull() | (strip(_c(rtm)) == "")
    return F.when(blank & (_c(year) < target_year), F.lit("NAO")).otherwise(_c(rtm))


# F31 ---------------------------------------------------------------------
def month_text(c: ColumnOrName) -> Column:
    return F.date_format(_c(c), "yyyy-MM")


def month_start(c: ColumnOrName) -> Column:
    return F.trunc(_c(c).cast("date"), "MM")


# F32 ---------------------------------------------------------------------
def blank_aware_coalesce(inline: ColumnOrName, lookup: ColumnOrName, default) -> Column:
    v = _c(inline)
    keep = F.when(~(v.isNull() | (strip(v) == "") | (strip(v) == dims.NOT_FOUND)), v)
    return F.coalesce(keep, _c(lookup), F.lit(default))


# F33 ---------------------------------------------------------------------
def effective_warranty(status: ColumnOrName, invoice_date: ColumnOrName, as_of: dt.date) -> Column:
    """DENTRO, or no status at all and still within the electronic warranty."""
    st = _c(status)
    missing = st.isNull() | (st == "")
    return F.coalesce(st == "DENTRO", F.lit(False)) | (missing & electronic_warranty_active(invoice_date, as_of))
