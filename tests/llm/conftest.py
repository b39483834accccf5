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


@pytest.fixture
def docs(spark):
    """(id, text[, lang, source]) tuples -> documents."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], *((*r[2:], None, None)[:2]), len(r[1] or "")) for r in rows], DOCS)

    return make


@pytest.fixture
def clashing(docs):
    """documents with extra columns whose names operators might use inside."""

    def make(rows):
        df = docs(rows)
        for name in ("id", "content", "digest", "salt", "n", "key", "tokens", "target", "__x", "Value"):
            df = df.withColumn(name, df["doc_id"])
        return df

    return make


@pytest.fixture
def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
