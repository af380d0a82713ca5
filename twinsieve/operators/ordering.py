"""Sort keys and positions in their order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut


def attribute_key(value: Column) -> Column:
    return F.lower(F.coalesce(value, F.lit("")))


def interlaced_key(values: Sequence[Column], longest: int = 100) -> Column:
    """The values' characters in turn, ``#`` where one has ended, ``longest`` div n rounds, in lower case."""
    rounds = longest // len(values)
    if not rounds:
        return F.lit("")
    pick = lambda v, i: F.when(F.length(v) > i, F.substring(v, i + 1, F.lit(1))).otherwise("#")
    row = lambda i: F.concat(*(pick(F.coalesce(v, F.lit("")), i) for v in values))
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), row), ""))


def keyed(relation: DataFrame, keys: Mapping[int, Column] | Sequence[Column], rid: str = "_rid") -> DataFrame:
    """k, rid, key: a row for each record and key."""
    items = keys.items() if isinstance(keys, Mapping) else enumerate(keys)
    each = F.array(*(F.struct(F.lit(k).alias("k"), c.alias("key")) for k, c in items))
    return relation.select(F.col(rid).alias("rid"), F.explode(each).alias("x")).select("x.k", "rid", "x.key")


def positions(rows: DataFrame) -> DataFrame:
    """k, rid, pos: 0-based place of each record in the order of (key, rid), for every k at once.

    Rows are range-partitioned and numbered within their part; a part's offset comes from the parts' counts
    (a row for each part and key).  No task holds a whole order.
    """
    parts = rows.repartitionByRange("k", "key", "rid").withColumn("part", F.spark_partition_id())
    parts = cut(parts, "order")  # range bounds are sampled; from here on the parts are fixed
    counts = parts.groupBy("k", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("k", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("k", "part").orderBy("key", "rid")
    placed = parts.withColumn("n", F.row_number().over(inner) - 1).join(counts, ["k", "part"])
    return placed.select("k", "rid", (F.col("n") + F.col("offset")).cast("long").alias("pos"))


def smallest(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` first records of an order (TakeOrderedAndProject)."""
    return rows.orderBy("key", "rid").limit(k)


def block_pair_order(results: DataFrame) -> DataFrame:
    """Block pairs (first, second, duplicates) by promise: most duplicates first, then the nearest blocks."""
    return results.orderBy(F.desc("duplicates"), F.col("second") - F.col("first"), "first")
