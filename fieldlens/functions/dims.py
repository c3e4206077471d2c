"""Fixed lookup values and tiny dimension tables.

The literal values below are fixed values: they must equal the business
rules being reproduced (model prefixes, warranty periods, labels), so they
are stated plainly and together.  Every table built here has a fixed,
proven size (tens of rows), which is what makes broadcasting it safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: pump models -------------------------------------------
MAIN_MODELS = ["HELIX", "VISTA", "CENTURY", "3G", "E123", "7502A"]

# item prefix (text before the first '-') -> model; 25 entries
MODEL_MAPPING = {
    "W7E123": "E123",
    "W7HX2": "HELIX",
    "W7HXH": "HELIX",
    "3G2209P": "3G",
    "W7HX6": "HELIX",
    "W7HX1": "HELIX",
    "3G2203P": "3G",
    "3G3389P": "3G",
    "3G3390P": "3G",
    "3G2201P": "3G",
    "3G3394P": "3G",
    "3G3490P": "3G",
    "E123LARLA3": "E123",
    "3G2204P": "3G",
    "3G2202P": "3G",
    "3G3384P": "3G",
    "3G2207P": "3G",
    "3G3494P": "3G",
    "3G2221P": "3G",
    "W7GCEN": "CENTURY",
    "W7GVIS": "VISTA",
    "W9000001": "HELIX",
    "7502A": "7502A",
    "N3G2201PO": "3G",
    "3GV3490P": "3G",
}
OTHER_MODEL = "OUTROS"

# --- fixed values: warranty ------------------------------------------------
WARRANTY_PERIODS = {"6_MESES": 183, "12_MESES": 365, "18_MESES": 548, "24_MESES": 730, "36_MESES": 1095}
ELECTRONIC_WARRANTY_DAYS = 365
MAX_WARRANTY_DAYS = 3650
WARRANTY_LABELS = {
    183: "6 meses (183 dias)",
    365: "12 meses (365 dias)",
    548: "18 meses (548 dias)",
    730: "24 meses (730 dias)",
    1095: "36 meses (1095 dias)",
}
WARRANTY_NOT_INFORMED = "Não informado"
WARRANTY_OTHER = "Outros"
NOT_FOUND = "NAO ENCONTRADO"

# warranty text -> days, in the order the dictionary lists them
WARRANTY_TEXT_TO_DAYS = {
    "6 MESES": 183,
    "6 MONTHS": 183,
    "12 MESES": 365,
    "12 MONTHS": 365,
    "1 ANO": 365,
    "1 YEAR": 365,
    "18 MESES": 548,
    "18 MONTHS": 548,
    "24 MESES": 730,
    "24 MONTHS": 730,
    "2 ANOS": 730,
    "2 YEARS": 730,
    "36 MESES": 1095,
    "36 MONTHS": 1095,
    "3 ANOS": 1095,
    "3 YEARS": 1095,
}
WARRANTY_TEXT_PREFIXES = ["GARANTIA", "WARRANTY", "-", ":"]
DAYS_PER_MONTH = 30.44

# --- fixed values: tickets ---------------------------------------------------
STATUS_OPEN = "ABERTO"
STATUS_CLOSED = "FECHADO"
STARTUP_SERVICE = "PARTIDA INICIAL"
EXCLUDE_TAG_PATTERN = r"(?i)\[STB\]"
NO_TAGS = "Sem Tags"
AGING_LABELS = ["Até 7", "8 a 14", ">14"]
STARTUP_OWN = "SIM - DFS"
STARTUP_THIRD_PARTY = "SIM - TERCEIRO"
STARTUP_NONE = "NÃO"
PUMP_DESCRIPTION_PREFIX = "BOMBA MEDIDORA DE COMBUSTIVEIS LIQUIDOS"
SPREADSHEET_EPOCH = "1899-12-30"

# --- fixed values: relationship matrix ---------------------------------------
RELATIONSHIP_SCORE_LABELS = {
    1: "1 · Alto volume + alta rapidez",
    2: "2 · Baixo volume + alta rapidez",
    3: "3 · Baixo volume + baixa rapidez",
    4: "4 · Alto volume + baixa rapidez",
}
JITTER_FRACTION = 0.012


def aging_bucket_dim(spark: SparkSession) -> DataFrame:
    """The three aging buckets, in display order (3 rows)."""
    schema = T.StructType([T.StructField("bucket", T.StringType(), False),
                           T.StructField("bucket_order", T.IntegerType(), False)])
    return spark.createDataFrame([(b, i) for i, b in enumerate(AGING_LABELS)], schema)


# The order types (TIPO) of equipment sold at home and abroad.
EQUIPMENT_TYPES = ("WBP EQUIPAMENTO DOMESTICO", "WBP EQUIPAMENTO EXPORTACAO")
