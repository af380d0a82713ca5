"""Candidate pairs from positions.  All are equi-joins on derived buckets; none is a nested loop.

``rank`` is the place of a comparison in the progressive order, worked out from distance and position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` over all configured shuffle partitions.

    Pairs are few bytes and much work to compare; left to itself, adaptive execution would merge small shuffles
    into a few tasks.  Window and block buckets hold a bounded number of records, so none is hot.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _side(carry: Sequence[str], end: int) -> list[Column]:
    return [F.col(c).alias(f"{c}_{end}") for c in carry]


def _both(carry: Sequence[str]) -> list[str]:
    return [f"{c}_{end}" for end in (1, 2) for c in carry]


def band_pairs(placed: DataFrame, window: int, carry: Sequence[str] = ()) -> DataFrame:
    """k, rid1, rid2, distance, pos (of the first): pairs at most window - 1 places apart.

    Columns to ``carry`` come along as ``<name>_1`` and ``<name>_2``.
    """
    d = max(window - 1, 1)
    a = placed.select("k", F.col("rid").alias("rid1"), F.col("pos").alias("p1"), F.expr(f"pos div {d}").alias("bucket"), *_side(carry, 1))
    b = placed.select("k", F.col("rid").alias("rid2"), F.col("pos").alias("p2"), F.explode(F.array(F.expr(f"pos div {d}"), F.expr(f"pos div {d} - 1"))).alias("bucket"), *_side(carry, 2))
    pairs = spread(a, "k", "bucket").join(spread(b, "k", "bucket"), ["k", "bucket"]).where((F.col("p2") - F.col("p1")).between(1, window - 1))
    return pairs.select("k", "rid1", "rid2", (F.col("p2") - F.col("p1")).alias("distance"), F.col("p1").alias("pos"), *_both(carry))


def distance_pairs(placed: DataFrame, distance: int) -> DataFrame:
    """Pairs exactly ``distance`` places apart."""
    a = placed.select("k", F.col("rid").alias("rid1"), F.col("pos").alias("p1"), (F.col("pos") + distance).alias("at"))
    b = placed.select("k", F.col("rid").alias("rid2"), F.col("pos").alias("at"))
    return a.join(b, ["k", "at"]).select("k", "rid1", "rid2", F.lit(distance).cast("long").alias("distance"), F.col("p1").alias("pos"))


def prepass_pairs(placed: DataFrame, interval: int) -> DataFrame:
    """Pairs of the pre-pass: 1 to ``interval`` places apart."""
    return band_pairs(placed, interval + 1)


def block_pairs(placed: DataFrame, block_size: int, block_range: int, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs of the same block or of blocks at most ``block_range`` apart; distance in blocks; ``carry`` as above."""
    rows = placed.withColumn("block", F.expr(f"pos div {block_size}"))
    a = rows.select("k", F.col("rid").alias("rid1"), F.col("pos").alias("p1"), "block", *_side(carry, 1))
    near = F.sequence(F.greatest(F.col("block") - block_range, F.lit(0).cast("long")), F.col("block"))
    b = rows.select("k", F.col("rid").alias("rid2"), F.col("pos").alias("p2"), F.col("block").alias("own"), F.explode(near).alias("block"), *_side(carry, 2))
    pairs = spread(a, "k", "block").join(spread(b, "k", "block"), ["k", "block"]).where("p1 < p2")
    return pairs.select("k", "rid1", "rid2", (F.col("own") - F.col("block")).alias("distance"), F.col("p1").alias("pos"), *_both(carry))


def within_blocks(placed: DataFrame, block_size: int) -> DataFrame:
    return block_pairs(placed, block_size, 0)


def window_rank(n: int, keys: int, window: int, concurrent: bool = False) -> Column:
    """Ordinal of a window comparison: key by key, or (concurrent) distance by distance over all keys."""
    d, pos, k = F.col("distance"), F.col("pos"), F.col("k")
    before = (d - 1) * n - F.expr("distance * (distance - 1) div 2")
    if concurrent:
        return (before * keys + k * (n - d) + pos + 1).cast("long")
    widest = min(window - 1, max(n - 1, 0))
    return (k * (widest * n - widest * (widest + 1) // 2) + before + pos + 1).cast("long")


def block_rank(n: int, keys: int, block_size: int, block_range: int, concurrent: bool = False) -> Column:
    """As ``window_rank`` for block pairs; places within a pair of blocks are dealt by the first record's position."""
    area, blocks = block_size * block_size, -(-max(n, 1) // block_size)
    layer = F.col("distance") * blocks * area
    inner = F.expr(f"pos div {block_size}") * area + F.expr(f"pos % {block_size}") * block_size + 1
    if concurrent:
        return (layer * keys + F.col("k") * blocks * area + inner).cast("long")
    return (F.col("k") * (block_range + 1) * blocks * area + layer + inner).cast("long")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """rid1 < rid2, rank: each pair once, at its first comparison."""
    return pairs.groupBy(F.least("rid1", "rid2").alias("rid1"), F.greatest("rid1", "rid2").alias("rid2")).agg(F.min("rank").alias("rank"))
