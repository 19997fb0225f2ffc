import pytest
from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potions near cold rivers and green hills under quiet stars".split()


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(WORDS[(k * k + k // 7) % len(WORDS)] for k in range(60_000))
    rows = [(1, "Ärger über die Brücke, die Straße und das Mädchen", "de"), (2, None, None), (3, "", "en"), (4, " \t\n", "en"), (5, long, "en"), (6, "twice twice", "en"), (6, "twice twice", "en"), (None, "no id", None), (7, "日本語 12 🙂", "en"), (8, "1234 !!", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({"source": F.lit("s"), "n_chars": F.lit(1).cast("long"), "fp": F.lit("x"), "key": F.lit("y"), "run": F.lit(0), "sig": F.lit(0), "a": F.lit(0), "spans": F.lit(0)})
