import random

import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words with a fixed seed: prose(n words, language number)."""
    rng = random.Random(7)
    parts = [["the", "an", "er", "on", "re", "he", "in", "ed", "nd", "ha"], ["le", "eau", "oi", "ère", "é", "tion", "que"],
             ["der", "sch", "ung", "keit", "ä", "ver", "ein"], ["la", "ción", "ado", "os", "ñ", "ar", "que"]]

    def make(n: int, language: int = 0) -> str:
        return " ".join("".join(rng.choices(parts[language], k=rng.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names used inside."""
    same, twice, long = prose(60), prose(40), prose(30_000)
    rows = [
        (1, same, "en", "a", 1), (2, same, "en", "a", 1), (3, twice, "en", "b", 2), (3, twice, "en", "b", 2),
        (4, None, "en", "a", None), (5, "", "fr", "a", 0), (6, " \t\n", None, "a", 3), (7, long, "en", None, None),
        (8, "word", "en", "", 4), (9, "A.", "en", "c", 2), (10, "123 &&& 456", "de", "c", 5),
        (None, same, None, None, None), (None, None, None, None, None),
        (11, prose(50, 1), "fr", "c", 1), (12, prose(50, 2), "de", "c", 1), (13, prose(50, 3), "es", "c", 1),
        (14, same + " " + prose(30), "en", "a", 1), (15, "\x00 � " + same.upper(), "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOC)
    extra = ["key", "text_hash", "row", "place", "marks", "size", "weight", "rate", "parts", "cdf", "source_key", "h", "kept",
             "language", "component", "n_words", "kept_text", "n", "host", "blocks"]
    return docs.withColumns({c: F.lit(7) for c in extra}).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture()
def folder(tmp_path):
    """Writes tables as the driver lays them out: folder(name=df) -> path."""

    def write(**tables) -> str:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
