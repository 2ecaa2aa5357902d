import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes tables to a folder of their own and gives its path."""
    def write(**frames):
        d = str(tmp_path_factory.mktemp("tables"))
        for name, df in frames.items():
            df.write.parquet(f"{d}/{name}.parquet")
        return d

    return write


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="session")
def odd(spark, tables):
    """Nulls, empty and long texts, repeated rows and ids, columns whose names clash with the operators' own."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en"), (1, "The quick brown fox jumps over the lazy dog", "en"), (2, None, None), (3, "", "en"), (None, "no id here, call +1 (555) 123-4567", "en"),
        (5, "long " * 30_000, "en"), (6, "word", None), (7, "two words", "de"), (8, "ünïcödé 😀 text\twith\x0bblanks\x1c", "fr"), (9, "a@b.cd " * 400, "en"), (9, "other text, same id", "en"), (10, "x" * 70_000, "en"),
    ]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)
    for c in ("fp", "row", "spans", "th", "base", "found", "_text", "group", "kept", "length", "c", "n"):
        from pyspark.sql import functions as F

        docs = docs.withColumn(c, F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 0)], LABELS)
    return tables(documents=docs, labels=labels)


@pytest.fixture(scope="session")
def nothing(spark, tables):
    talk = "conv_id bigint, turn bigint, role string, text string"
    return tables(documents=spark.createDataFrame([], DOCS), labels=spark.createDataFrame([], LABELS), conversations=spark.createDataFrame([], talk))
