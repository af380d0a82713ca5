"""Mixing sources to target weights along a time-varying curriculum (operator 7).

Budget: the words of all documents.  Each source gets a share by weight, at most ``MOST`` times its own words;
what lies above is shared anew by weight until no source is above (water-filling, in closed form over the sources
sorted by words per weight).  A source's weight over training time t in [0, 1] is a line with mean 1,
1 + r (2 t - 1).  Its integral F(t) = (1 - r) t + r t^2 is the demand so far; a document's place in its source's
stream (epochs over a hashed order) inverted through F gives the time at which each of its copies is due.  The copies
range-sorted by due time are the mix; the words before a copy there, about the demand of all sources together at that
time, are its training position.  ``training_order`` returns the mix itself, ``mix`` what it holds of each document.

Prefix sums are two-level (hash buckets within a source, then rows within a bucket), so a source with most of
the rows is spread over many tasks; only bucket totals are ordered per source.

Edge cases: null text has size 0; a document of size 0 is taken 0 words; a null source is a source of its own,
last in order; repeated rows each count; what isn't taken has no first_due or first_position.  An empty table gives an empty result.  Only doc_id, text and source
are read; other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, cut, table, text_or_empty, whole_row

WEIGHTS = (5.0, 2.0, 1.0)
#: Slopes of the weight schedules, dealt to the sources like the weights: early, level, late.
RAMPS = (-0.5, 0.0, 0.5)
#: How often a document may be taken.
MOST = 3
#: Hex digits of the order's digest that name a bucket within a source: 4,096 buckets of equal share.
BUCKET_DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str | Column = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def dealt(values: Sequence[float], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, ramps: Sequence[float] = RAMPS, most: int = MOST) -> DataFrame:
    """source, source_size, target, ramp from rows (source, source_size), one a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("place", F.row_number().over(order) - 1)
    placed = placed.withColumns({"weight": dealt(weights, F.col("place")), "ramp": dealt(ramps, F.col("place"))})
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    upto, every = filled.rowsBetween(Window.unboundedPreceding, 0), filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = placed.withColumns({
        "all_size": F.sum("source_size").over(every),
        "all_weight": F.sum("weight").over(every),
        "size_before": F.sum("source_size").over(upto) - F.col("source_size"),
        "weight_before": F.sum("weight").over(upto) - F.col("weight"),
    })
    # A source is full iff the level that the sources before it leave would lift it above its cap.
    level = (F.col("all_size") - most * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before"))
    sums = sums.withColumns({"level": level, "full": most * F.col("source_size") <= level * F.col("weight")})
    # Full sources come first; from the first one on that isn't, the levels fall, so its own is the largest.
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(common * F.col("weight"))
    return sums.select("source", "source_size", target.alias("target"), "ramp")


def placed_rows(rows: DataFrame, weights: Sequence[float], ramps: Sequence[float], most: int, bucket_digits: int) -> DataFrame:
    """``rows`` (source, size, h, tie) with source_size, target, ramp, and ``before``: the words of the source's rows before.

    A null source is told apart by ``none``, so all joins and windows go by plain equality and share one shuffle of the rows.
    """
    key = ["s", "none", "bucket"]
    rows = rows.withColumns({"s": F.coalesce("source", F.lit("")), "none": F.col("source").isNull(), "bucket": F.substring("h", 1, bucket_digits)}).drop("source")
    by_bucket = rows.groupBy(*key).agg(F.sum("size").alias("bucket_size"))
    source = F.when(~F.col("none"), F.col("s"))
    goals = targets(by_bucket.groupBy("s", "none").agg(F.sum("bucket_size").alias("source_size")).select(source.alias("source"), "source_size"), weights, ramps, most)
    goals = goals.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "source_size", "target", "ramp")
    ahead = Window.partitionBy("s", "none").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    known = by_bucket.select(*key, F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("buckets_before")).join(goals, ["s", "none"])
    inner = Window.partitionBy(*key).orderBy("h", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(known, key)
    return rows.withColumns({"before": F.col("within") + F.col("buckets_before"), "source": source}).drop(*key, "within", "buckets_before")


def copies() -> Column:
    """Epochs in which the document's middle lies within the target."""
    left = (F.col("target") - F.col("before") - F.col("size") / 2) / F.col("source_size")
    return F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(F.greatest(F.ceil(left), F.lit(0)), F.lit(MOST))).cast("long")


def due(epoch: Column) -> Column:
    """Training time in [0, 1] at which the copy of that epoch is due: the inverse of the integrated schedule."""
    u = F.least(F.greatest((F.col("before") + F.col("size") / 2 + epoch * F.col("source_size")) / F.col("target"), F.lit(0.0)), F.lit(1.0))
    r = F.col("ramp")
    return F.when(r == 0, u).otherwise((r - 1 + F.sqrt((1 - r) * (1 - r) + 4 * r * u)) / (2 * F.when(r == 0, 1.0).otherwise(r)))


def order_key() -> Column:
    """The hashed order of documents within a source; null ids hash as the empty text."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def _prepared(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size"), order_key().alias("h"), F.xxhash64(text).alias("tie"))


def in_training_order(copies: DataFrame) -> DataFrame:
    """Rows (due, h, tie and more), one a copy, range-sorted by due time; ranges hold about equal counts whatever the source."""
    return copies.repartitionByRange("due", "h", "tie").sortWithinPartitions("due", "h", "tie")


def numbered(order: DataFrame) -> DataFrame:
    """``order`` (part, due, h, tie, source, size and more) with ``position``: the words of the copies before, over parts and then within a part."""
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = order.groupBy("part").agg(F.sum("size").alias("part_size")).select("part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("parts_before"))
    inner = Window.partitionBy("part").orderBy("due", "h", "tie", "source").rowsBetween(Window.unboundedPreceding, -1)
    order = order.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(parts, "part")
    return order.withColumn("position", F.col("within") + F.col("parts_before")).drop("within", "parts_before")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ramps: Sequence[float] = RAMPS, most: int = MOST, bucket_digits: int = BUCKET_DIGITS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, first_due, first_position for every document.

    The copies that the mix takes are written in training order, and the last four columns are those of the document's copies there.
    """
    if not 0 < most <= MOST:
        raise ValueError("most must be from 1 to 3")
    out = placed_rows(_prepared(docs), weights, ramps, most, bucket_digits).withColumn("copies", copies())
    out = out.withColumn("epoch", F.explode_outer(F.when(F.col("copies") > 0, F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))).drop("copies")
    out = out.withColumn("due", F.when(F.col("epoch").isNotNull(), due(F.col("epoch"))))
    order = cut(in_training_order(out).withColumn("part", F.spark_partition_id()), "mix")  # range bounds are sampled; from here on the parts are fixed
    document = ["doc_id", "source", "size", "source_size", "target"]
    # A row that is taken has words, so it is the only one of its source with these before it.
    taken = numbered(order.where("epoch IS NOT NULL")).groupBy(*document, "before").agg(F.sum("size").alias("taken"), F.count("*").alias("copies"), F.min("due").alias("first_due"), F.min("position").alias("first_position"))
    left = order.where("epoch IS NULL").select(*document, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("double").alias("first_due"), F.lit(None).cast("long").alias("first_position"))
    return taken.drop("before").unionByName(left)


def training_order(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ramps: Sequence[float] = RAMPS, most: int = MOST, bucket_digits: int = BUCKET_DIGITS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, range-sorted by training position, columns unchanged.

    Documents without words are not part of a mix.
    """
    rows = docs.select(whole_row(docs), F.col("source").cast("string").alias("source"), size_of().alias("size"), order_key().alias("h"), F.xxhash64(text_or_empty()).alias("tie"))
    out = placed_rows(rows, weights, ramps, most, bucket_digits).withColumn("copies", copies()).where("copies > 0")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    return in_training_order(out.select(ROW, due(F.col("epoch")).alias("due"), "h", "tie")).select(f"{ROW}.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "first_due")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS weight, [-0.5, 0.0, 0.5][place % 3 + 1]::DOUBLE AS ramp FROM s),
c AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
         sum(source_size) OVER o - source_size AS size_before, sum(weight) OVER o - weight AS weight_before
  FROM w WINDOW o AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT *, (all_size - 3 * size_before)::DOUBLE / (all_weight - weight_before) AS level FROM c),
f AS (SELECT *, 3 * source_size <= level * weight AS is_full FROM l),
g AS (SELECT *, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE max(CASE WHEN NOT is_full THEN level END) OVER () * weight END AS target FROM f),
r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.ramp,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
t AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(greatest(ceil((target - before - size / 2) / source_size), 0), 3) END::BIGINT AS copies,
         least(greatest((before + size / 2) / target, 0), 1) AS u
  FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies,
       CASE WHEN copies > 0 THEN CASE WHEN ramp = 0 THEN u ELSE (ramp - 1 + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u)) / (2 * ramp) END END AS first_due
FROM t
"""
