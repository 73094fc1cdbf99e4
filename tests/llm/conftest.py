import zlib

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def crc(value, base):
    return zlib.crc32(str(value).encode()) % base


@pytest.fixture(scope="session")
def docs(spark):
    """A function from texts, or (doc_id, text), to a documents table."""
    def make(texts, lang="en", source="s"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in rows], DOCS)

    return make
