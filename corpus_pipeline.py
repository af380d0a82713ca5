"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents.

1. quality_classifier: documents that the classifier, trained on the labels, rejects go.
2. line_dedup: later repeats of passages are deleted from the texts; a document that was nothing else goes.
3. jaccard_join: of each group of near-duplicates the document with the smallest doc_id stays.
4. source_mixing: each document comes as often as the mix takes it (0 to 3 times), in training order.
5. byte_level_bpe: doc_id, number of ids, digests and the ids of every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinsieve.llm import bpe, jaccard, lines, mixing, quality
from twinsieve.llm.common import cut, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go; all other rows stay as they are.

    Null and empty texts are scored like any other, by the feature that all texts have; very long ones whole; repeated rows and
    rows without a doc_id each.  Without labels of both classes the score is the smoothed share of the good ones for all.
    An empty table gives an empty table; extra columns are kept, whatever their names.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of a passage are deleted from the texts, and a document that was nothing else goes.

    Null and empty texts stay as they are; very long texts are cut whole; rows that repeat doc_id and text are one
    document and all get the same text.  A null doc_id comes first.  An empty table gives an empty table; extra columns are
    kept, whatever their names.
    """
    return lines.without_repeats(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of the smallest doc_id.

    Null and empty texts are copies of each other; rows without a doc_id all stay; rows that share a doc_id are judged by their
    own texts, and of repeated rows one stays.  Very long texts are compared whole.  An empty table gives an empty
    table; extra columns are kept, whatever their names.
    """
    return jaccard.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row comes as often as the mix takes it (0 to 3 times), in training order.

    Texts without words, null ones too, are no part of a mix; a null source is one of its own; repeated rows count each, and
    rows due at once follow the hash of doc_id, then that of the text.  Very long texts are counted whole.  An empty table gives an empty table; extra columns are kept, whatever their names.
    """
    return mixing.training_order(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, digests and the ids of every row, repeated rows and null doc_ids included.

    Null texts count as empty and have no ids; very long texts are encoded whole.  An empty table gives an empty table; columns
    but doc_id and text are not looked at.
    """
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [(f.__name__, f) for f in (quality_classifier, line_dedup, jaccard_join, source_mixing, byte_level_bpe)]

#: The classifier and the ordering of the mix can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; what each other stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
