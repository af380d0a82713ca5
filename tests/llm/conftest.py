import pytest
from pyspark.sql import types as T

pytest.importorskip("twinsieve.llm")

#: Columns of documents, and some that bear the names that operators use inside.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in ("score", "h", "d", "id", "size", "copies", "spans", "left", "gone", "lane", "__row", "n", "a b.c")),
])
SENTENCE = "The quick brown fox number {} jumps over the lazy dog while it rains. "


def row(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), *("x",) * (len(SCHEMA) - 5))


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame([row(*r) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = "".join(SENTENCE.format(i) for i in range(4000))
    base = [(1, None), (2, ""), (3, "   "), (4, "word"), (5, long), (6, long), (7, "same text of seven words in all"), (7, "same text of seven words in all"), (7, "another text under the same id here"), (None, "no id at all"), (None, None), (8, "same text of seven words in all"), (9, "null source", None), (10, "ünï 日本語 \U0001f600 text\nline\n\n", "t", None), (-5, "negative id")]
    return base
