"""Document fingerprints by a homomorphic multiset hash (operator 3), in SQL functions only.

A paragraph (line) has two wide vectors: ``digest``, 8 hashes of the whole paragraph, and ``counts``, 96 lanes that
count its word triples by hash.  A document's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo
2^32 for digest and 2^20 for counts.  It doesn't depend on the order of paragraphs; a paragraph is inserted or deleted
by adding or subtracting its own fingerprint.  Equal digests mean equal multisets of paragraphs (256 bits); the
correlation of two counts estimates how much of two documents is the same (0 to 1).  A row's vectors are worked out
within the row.  An edited text takes over the vectors of the paragraphs before the edit; only what comes after it is
hashed anew.

Edge cases: a null text is the empty one.  Two empty texts have likeness 1, an empty and another one about 0.  Texts
are taken whole, however long; lanes of more than 2^20 triples wrap around, so equality, insertion and deletion stay
exact and only the likeness of such texts is off.  An empty table gives an empty result.
The next document is the one of the next smaller doc_id, after the last the first; null ids come last (an id of
-2^63 counts as null), ids that repeat are ordered by hash of text.  Rows that repeat both id and text are one place
in that order and get the same result each.  Texts of one document only: its next is itself.
Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, let, table, text_or_empty

DIGEST_LANES, DIGEST_BITS = 8, 32
LANES, LANE_BITS = 96, 20
#: Paragraphs of fewer words count single words.
SHORT = 8
NO_ID = -(1 << 63)


def digest(paragraphs: Column) -> Column:
    """The digest lanes of an array of paragraphs, as array<long>: sums of the halves of four hashes of each."""
    mask = F.lit((1 << DIGEST_BITS) - 1)
    hashes = F.transform(paragraphs, lambda p: F.array(*(F.xxhash64(p, F.lit(i)) for i in range(DIGEST_LANES // 2))))
    half = lambda h, i: F.shiftrightunsigned(F.get(h, F.lit(i // 2)), DIGEST_BITS * (i % 2)).bitwiseAND(mask)
    lane = lambda hs, i: F.aggregate(hs, F.lit(0).cast("long"), lambda a, h: (a + half(h, i)).bitwiseAND(mask))
    return let(hashes, lambda hs: F.array(*(lane(hs, i) for i in range(DIGEST_LANES))))


def lanes(paragraphs: Column) -> Column:
    """The lane of each word triple of each paragraph, array<int>; the last words of a paragraph make shorter ones, short paragraphs count by word."""
    lane = lambda *w: F.coalesce(F.pmod(F.xxhash64(*w), F.lit(LANES)).cast("int"), F.lit(0))
    triple = lambda ws: F.when(F.size(ws) < SHORT, F.transform(ws, lambda w: lane(w))).otherwise(F.transform(ws, lambda w, i: lane(w, F.get(ws, i + 1), F.get(ws, i + 2))))
    return F.flatten(F.transform(F.transform(paragraphs, lambda p: F.split(p, " ")), triple))


def counted(lanes: Column) -> Column:
    """How often each lane occurs, array<long> modulo 2^20: with each lane put in once more, the ends of the runs of the sorted lanes."""
    every = F.array(*(F.lit(i) for i in range(LANES)))
    ends = lambda xs: F.filter(F.transform(xs, lambda x, i: F.when(x != F.coalesce(F.get(xs, i + 1), F.lit(-1)), i)), lambda i: i.isNotNull())
    mask = F.lit((1 << LANE_BITS) - 1)
    steps = lambda es: F.transform(es, lambda e, k: (e - F.coalesce(F.get(es, k - 1), F.lit(-1)) - 1).cast("long").bitwiseAND(mask))
    return let(let(F.sort_array(F.concat(lanes, every)), ends), steps)


def vectors(paragraphs: Column) -> Column:
    """struct<digest, counts> of an array of paragraphs; of none, zeros."""
    return F.struct(digest(paragraphs).alias("digest"), counted(lanes(paragraphs)).alias("counts"))


def plus(a: Column, b: Column, bits: int) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit((1 << bits) - 1)))


def minus(a: Column, b: Column, bits: int) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit((1 << bits) - 1)))


def insert(fingerprint: Column, part: Column) -> Column:
    """The fingerprint (struct of digest and counts) after the paragraphs of ``part`` are inserted."""
    return F.struct(plus(fingerprint["digest"], part["digest"], DIGEST_BITS).alias("digest"), plus(fingerprint["counts"], part["counts"], LANE_BITS).alias("counts"))


def delete(fingerprint: Column, part: Column) -> Column:
    return F.struct(minus(fingerprint["digest"], part["digest"], DIGEST_BITS).alias("digest"), minus(fingerprint["counts"], part["counts"], LANE_BITS).alias("counts"))


def encoded(fingerprint: Column) -> Column:
    """The fingerprint as text: digest lanes in hex, then counts in hex."""
    hex_ = lambda xs, n: F.array_join(F.transform(xs, lambda x: F.lpad(F.hex(x), n, "0")), "")
    return F.lower(F.concat(hex_(fingerprint["digest"], DIGEST_BITS // 4), F.lit("-"), hex_(fingerprint["counts"], LANE_BITS // 4)))


def likeness(a: Column, b: Column) -> Column:
    """Correlation of the counts' square roots (a phrase said often weighs less), at least 0; 1 for equal fingerprints."""
    x, y, zero = a["counts"], b["counts"], F.lit(0.0)
    roots = lambda v: F.aggregate(v, zero, lambda s, e: s + F.sqrt(e))
    whole = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda s, e: s + e).cast("double")
    cross = F.aggregate(F.zip_with(x, y, lambda p, q: F.sqrt(p * q)), zero, lambda s, e: s + e)

    def ratio(m: Column) -> Column:
        norm = (m["xx"] - m["x"] * m["x"] / LANES) * (m["yy"] - m["y"] * m["y"] / LANES)
        return F.when(norm > 0, (m["xy"] - m["x"] * m["y"] / LANES) / F.sqrt(F.when(norm > 0, norm).otherwise(1.0))).otherwise(zero)

    found = let(F.struct(roots(x).alias("x"), roots(y).alias("y"), whole(x).alias("xx"), whole(y).alias("yy"), cross.alias("xy")), ratio)
    return F.when((a["digest"] == b["digest"]) & (x == y), F.lit(1.0)).otherwise(F.least(F.greatest(found, zero), F.lit(1.0)))


def fingerprints(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys`` and ``fingerprint`` struct<digest, counts> of each row's text."""
    rows = rows.select(*keys, F.split(F.col(text), "\n").alias("__paragraphs"))
    return rows.select(*keys, vectors(F.col("__paragraphs")).alias("fingerprint"))


def ordered(docs: DataFrame) -> DataFrame:
    """d, h, n_chars, and the key (next_d, next_h) of the next document, for each distinct key of ``docs``."""
    ids = docs.groupBy("d", "h").agg(F.max(F.length("text")).alias("n_chars"))
    ids = ids.withColumn("down", F.bitwise_not("d")).repartitionByRange("down", "h").withColumn("part", F.spark_partition_id())
    ids = cut(ids, "order")  # the parts are fixed from here on
    key = F.struct("down", "h")
    edges = ids.groupBy("part").agg(F.min(key).alias("first"))
    along = Window.orderBy("part")  # a row for each part
    first = F.first("first").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = edges.select("part", F.coalesce(F.lead("first").over(along), first).alias("edge"))
    ids = ids.withColumn("following", F.lead(key).over(Window.partitionBy("part").orderBy("down", "h")))
    ids = ids.join(edges, "part").withColumn("following", F.coalesce("following", "edge"))
    return ids.select("d", "h", "n_chars", F.bitwise_not("following.down").alias("next_d"), F.col("following.h").alias("next_h"))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, the fingerprints of text and edited text and of the next document, for every row."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    order = ordered(docs)
    size = F.floor(F.col("n_chars") / 3).cast("int")
    # The order is renamed, not the documents, so both joins use one shuffle of the texts.
    receivers = order.select(F.col("next_d").alias("d"), F.col("next_h").alias("h"), F.col("d").alias("to_d"), F.col("h").alias("to_h"), "n_chars")
    heads = docs.join(receivers, ["d", "h"]).select(F.col("to_d").alias("d"), F.col("to_h").alias("h"), "n_chars", F.col("d").alias("next_d"), F.col("h").alias("next_h"), F.substring("text", F.lit(1), size).alias("head"))
    # Rows that repeat give their head each; one is enough.
    heads = heads.groupBy("d", "h", "n_chars", "next_d", "next_h").agg(F.min("head").alias("head"))
    own = ["d", "h", "n_chars", "next_d", "next_h"]
    rows = docs.join(heads, ["d", "h"]).select(*own, "text", "head", F.substring("text", F.lit(1), F.col("n_chars").cast("int") - size).alias("before"))
    rows = rows.select(*own, F.sha2(F.concat("before", "head").cast("binary"), 256).alias("sha"), F.split("text", "\n").alias("all"), F.split("before", "\n").alias("begun"), "head")
    # Paragraphs that end before the edit stay; the one it begins in and what follows are replaced.
    stays, last = F.size("begun") - 1, F.element_at("begun", -1)
    rows = rows.select(*own, "sha", F.slice("all", F.lit(1), stays).alias("stay"), F.slice("all", stays + 1, F.size("all")).alias("go"), F.split(F.concat(last, "head"), "\n").alias("come"))
    rows = rows.select(*own, "sha", *(vectors(F.col(c)).alias(c) for c in ("stay", "go", "come")))
    prints = cut(rows.select(*own, "sha", insert(F.col("stay"), F.col("go")).alias("fingerprint"), insert(F.col("stay"), F.col("come")).alias("edited")), "prints")
    nexts = prints.select(F.col("d").alias("next_d"), F.col("h").alias("next_h"), F.col("fingerprint").alias("next")).dropDuplicates(["next_d", "next_h"])
    doc_id = F.when(F.col("d") != NO_ID, F.col("d"))
    return prints.join(nexts, ["next_d", "next_h"]).select(doc_id.alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), "fingerprint", "edited", "next")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(table(spark, sf_dir, "documents"))
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return rows.select("doc_id", "n_chars", "edited_sha256", encoded(F.col("fingerprint")).alias("fingerprint"), encoded(F.col("edited")).alias("edited_fingerprint"), near("edited").alias("near_edited"), near("next").alias("near_next"))
