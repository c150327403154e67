import pytest
from pyspark.sql import functions as F


@pytest.fixture
def docs_of(spark):
    """Documents from texts: with a null id, repeated rows and columns whose names clash with inner ones."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", None) for i, t in zip(ids, texts, strict=True)]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        return frame.withColumns({"_result": F.lit("mine"), "_row": F.lit(1), "row": F.lit(2), "fp": F.lit(3)})

    return make
