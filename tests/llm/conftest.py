import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Nulls, empty and blank texts, ties, repeated rows and clashing names that every operator must take.
ODD = [
    (1, "the cat sat on the mat and the dog lay on the rug", "en", "a", 10),
    (1, "the cat sat on the mat and the dog lay on the rug", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n\r ", "en", "b", 5),
    (None, "a text without a key", "en", None, 20),
    (5, "one", None, "a", 3),
    (6, "x" * 5000, "en", "a", 5000),
    (7, "naïve café — 漢字 😀 ▁ end", "fr", "b", 3),
    (8, "word " * 3000, "en", "b", 15000),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """doc_id and text of the small table, in Python."""
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Tests name a checkpoint folder of their own if the session has none."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
