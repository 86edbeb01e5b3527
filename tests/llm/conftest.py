import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, texts and labels, empty, blank and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(25_000))
    plain = "the quick brown fox jumps over the lazy dog and runs away from it again " * 4
    return [
        (1, None, None, None, None),
        (None, "a text without an id that is long enough to be looked at", "en", "src1", 5),
        (2, "", "en", "src1", 0),
        (3, " \n\t ", None, "", 4),
        (4, long, "en", "src2", len(long)),
        (5, long + " end", "en", None, 1),
        (6, plain, "en", "https://Host.example:80/x", None),
        (6, plain, "en", "https://Host.example:80/x", None),
        (7, plain, "fr", "src1", 3),
        (None, plain, "en", "src1", 3),
        (8, "été à la plage, où ça? ÉTÉ! token: abcdefgh12345 " + "0123456789abcdef" * 2, "fr", "src3", 10),
        (9, "12345 67890 !!!", "en", "src3", 15),
        (10, "日本語の文章です", "ja", "src3", 8),
        (11, "x" * 5000, "en", "src4", 5000),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names operators could use themselves."""
    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(("text_bytes", "text_key", "blob", "fp", "host", "component_id", "kept_id", "mf_blob", "score", "size", "shard", "label", "spans"))})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away from it"), (2, None), (None, "quick brown"), (3, ""), (4, "lazy dog"), (4, "lazy dog")], "item_id long, text string")
