import pytest

EDGES = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 3), (4, "word", "en", "b", 4), (5, "word", "en", "b", 4),
    (6, "Two Words", "en", "a", 9), (6, "Two Words", "en", "a", 9), (None, "no id here at all", "en", "c", 17), (7, "é▁😀  x" * 3, "fr", "c", 15), (8, "long " * 30_000, "en", "a", 150_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and extra columns with names that operators use."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(EDGES, SCHEMA)
    return frame.withColumns({c: F.lit(1) for c in ("size", "shard", "slot", "target", "id", "th", "n", "a", "b", "score", "component_id", "copies")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
