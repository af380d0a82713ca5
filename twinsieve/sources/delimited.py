"""Relations and gold standards from delimited text, parquet or any DataFrame.

All values are strings.  In delimited text a missing field at the end of a row is absent (null), an empty one is ``''``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DetectConfig
from ..scratch import cut

RID = "_rid"
RAW = "_raw"


def attribute_names(spark: SparkSession, path: str, cfg: DetectConfig) -> list[str]:
    """The header's names, trimmed, or _c0, _c1, ... without a header."""
    first = _reader(spark, cfg).option("header", cfg.header).option("enforceSchema", True).csv(path)
    return [c.strip() for c in first.columns][: cfg.max_attributes]


def _reader(spark: SparkSession, cfg: DetectConfig):
    options = {"sep": cfg.separator, "quote": '"', "escape": "\\", "encoding": cfg.encoding, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "mode": "PERMISSIVE"}
    return spark.read.options(**options)


def read_relation(spark: SparkSession, path: str, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """The relation, parsed and kept in the shared folder, as strings with ``_rid`` (order in the file) and ``_ragged``; at most ``max_attributes`` columns."""
    names = [c.strip() for c in _reader(spark, cfg).option("header", cfg.header).csv(path).columns]
    schema = T.StructType([*(T.StructField(f"c{i}", T.StringType()) for i in range(len(names))), T.StructField(RAW, T.StringType())])
    rows = _reader(spark, cfg).option("header", cfg.header).option("columnNameOfCorruptRecord", RAW).schema(schema).csv(path)
    # A raw record is kept for rows that are too short or too long; the number of its fields tells empty from absent.
    plain = F.regexp_replace(F.col(RAW), r'"(?:[^"\\]|\\.)*"', "")
    fields = F.when(F.col(RAW).isNull(), len(names)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(cfg.separator), F.lit(""))) + 1)
    rows = rows.select("*", fields.alias("_fields"), F.monotonically_increasing_id().alias(RID))
    values = [F.when(F.col("_fields") > i, F.coalesce(F.col(f"c{i}"), F.lit(""))).alias(c) for i, c in enumerate(names[: cfg.max_attributes])]
    # Parsed once: a run scans its relation many times, each time a few columns, and its _rid must not change.
    return cut(rows.select(RID, F.col(RAW).isNotNull().alias("_ragged"), *values), "relation")


def as_relation(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, max_attributes: int = 100) -> DataFrame:
    """Any typed DataFrame as strings.  ``_rid`` is the one integer column of ``order``, or increases in its order."""
    columns = list(columns or df.columns)[:max_attributes]
    values = [F.col(c).cast("string").alias(c) for c in columns]
    if len(order) == 1 and dict(df.dtypes)[order[0]] in ("int", "bigint", "smallint", "tinyint"):
        return df.select(F.col(order[0]).cast("long").alias(RID), F.lit(False).alias("_ragged"), *values)
    # Ids by partition of a sorted frame; written, as sampled range bounds may differ from one run to the next.
    return cut(df.orderBy(*order).select(F.monotonically_increasing_id().alias(RID), F.lit(False).alias("_ragged"), *values), "relation")


def attributes(relation: DataFrame) -> list[str]:
    return [c for c in relation.columns if c not in (RID, "_ragged")]


def well_formed(relation: DataFrame) -> DataFrame:
    """What the profilers see: no ragged rows, blanks before a value ignored, empty values null."""
    value = lambda c: F.when(F.ltrim(F.col(f"`{c}`")) != "", F.ltrim(F.col(f"`{c}`"))).alias(c)
    return relation.where(~F.col("_ragged")).select(*(value(c) for c in attributes(relation)))


def columns_trimmed(relation: DataFrame) -> DataFrame:
    return relation.select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in attributes(relation)))


def project(relation: DataFrame, places: Iterable[int]) -> DataFrame:
    """Columns by place; beyond the last one, and where absent, ``''``."""
    names = attributes(relation)
    pick = lambda i: F.coalesce(F.col(f"`{names[i]}`"), F.lit("")) if i < len(names) else F.lit("")
    return relation.select(RID, *(pick(i).alias(names[i] if i < len(names) else f"_c{i}") for i in places))


def lookup(relation: DataFrame, rids: DataFrame) -> DataFrame:
    """The records of the given ``_rid`` values."""
    return relation.join(rids.select(RID).distinct(), RID, "left_semi")


def row_count(relation: DataFrame) -> int:
    return relation.count()


def ids(relation: DataFrame, id_col: str | None = None) -> DataFrame:
    return relation.select(F.col(id_col or attributes(relation)[0]).alias("id")).distinct()


def canonical(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2")]


def read_gold(spark: SparkSession, path: str, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """id1, id2: the two-column file's pairs, whatever its header, smaller id first."""
    rows = _reader(spark, cfg).option("header", True).schema("id1 string, id2 string").csv(path)
    return rows.select(*canonical(F.col("id1"), F.col("id2"))).where("id1 is not null and id2 is not null").distinct()


def gold_within(gold: DataFrame, known: DataFrame | None) -> DataFrame:
    """Gold pairs of which both ids occur in ``known`` (id); all of them without it."""
    pairs = gold.select(*canonical(F.col("id1"), F.col("id2"))).distinct()
    if known is None:
        return pairs
    for end in ("id1", "id2"):
        pairs = pairs.join(known.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return pairs.select("id1", "id2")


def blocks(positions: DataFrame, block_size: int, start: int | None = None, end: int | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """``positions`` (k, rid, pos) with ``block``; a range of blocks [start, end), or the chosen (k, block) or (block) rows."""
    rows = positions.withColumn("block", F.expr(f"pos div {block_size}"))
    if start is not None:
        rows = rows.where(F.col("block") >= start)
    if end is not None:
        rows = rows.where(F.col("block") < end)
    return rows if chosen is None else rows.join(chosen.distinct(), [c for c in ("k", "block") if c in chosen.columns], "left_semi")
