import pytest
from pyspark.sql import functions as F

LONG = "word and the other " * 40_000
HARD = [
    (1, "The quick brown fox and the lazy dog are in the garden of the house, and it is late."), (2, ""), (3, None), (None, "no id at all, but the text is here"), (5, " \n\t "), (6, LONG),
    (7, "same text twice in this table"), (7, "same text twice in this table"), (8, "same text twice in this table"), (9, "ß ẞ İ ıl naïve 漢字かな交じり文 🙂🙂 é‍ \x00 \x1c"), (10, "x"), (11, "a\nb\n\n\nc\r\nd"), (12, "'s 't 'LL don't we've 1234 ½ ٣"),
]
CLASHES = "id sig root alone rank count n times value length bucket bound batch place shard offset tokens n_tokens start end type votes bits format score q t w terms tfs size stays first chars words failed kept quality lines row old new i k at hub members node links group_id h __nd_hash __sr_new __qr_here __row __id".split()


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns with names that operators use themselves."""
    df = spark.createDataFrame(HARD, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text")})
    return df.withColumns({c: F.lit(f"mine {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def none(hard):
    return hard.limit(0)
