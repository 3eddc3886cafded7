import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows and a clashing extra column."""
    long = " ".join(f"w{i * 7919 % 30_011}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (None, "no id here at all", "en", "a", 17), (None, None, None, None, None),
        (4, "one two three four five six seven eight nine ten", "en", "a", 9), (5, "one two three four five six seven eight nine ten", "en", "b", 9),
        (6, "short", "de", None, 5), (6, "short", "de", None, 5), (7, long, "en", "a", len(long)), (8, long + " tail", "en", "a", len(long) + 5), (9, "É𝒳 straße ſK <|endoftext|> ok", "fr", "c", 30),
    ]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, DOCS)
    return frame.withColumns({"size": F.lit("x"), "shard": F.lit(1), "kept": F.lit("y"), "x0": F.lit(0), "label": F.lit("z"), "target": F.lit(2)})


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
