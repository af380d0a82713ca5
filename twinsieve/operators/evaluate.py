"""Found pairs against a gold standard."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from ..sources.delimited import canonical


def pair_set(pairs: DataFrame) -> DataFrame:
    """id1 <= id2, each unordered pair once."""
    return pairs.select(*canonical(F.col("id1"), F.col("id2"))).distinct()


def true_positives(found: DataFrame, gold: DataFrame) -> DataFrame:
    return pair_set(found).intersect(pair_set(gold))


def false_positives(found: DataFrame, gold: DataFrame) -> DataFrame:
    return pair_set(found).subtract(pair_set(gold))


def false_negatives(found: DataFrame, gold: DataFrame) -> DataFrame:
    return pair_set(gold).subtract(pair_set(found))


def union_pairs(*passes: DataFrame) -> DataFrame:
    """Pairs of several passes, each once, at its first rank."""
    rows = passes[0]
    for more in passes[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*canonical(F.col("id1"), F.col("id2"))).agg(F.min("progress_rank").alias("progress_rank"))


def confusion(found: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, fp, fn in one row, by one full outer join."""
    a, b = pair_set(found).withColumn("f", F.lit(1)), pair_set(gold).withColumn("g", F.lit(1))
    rows = a.join(b, ["id1", "id2"], "full")
    both = F.col("f").isNotNull() & F.col("g").isNotNull()
    return rows.agg(F.count_if(both).alias("tp"), F.count_if(F.col("f").isNotNull() & F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))


def metrics(found: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1; a ratio without cases is NaN."""
    ratio = lambda a, b: F.when(b == 0, F.lit(float("nan"))).otherwise(a / F.greatest(b, F.lit(1)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion(found, gold).select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fn + fp).alias("f1"))


def progress_curve(found: DataFrame, gold: DataFrame, interval: int, include_tail: bool = False) -> DataFrame:
    """t, cum_tp: true positives with progress_rank <= t, for t = interval, 2 interval, ... below the last one's rank.

    With ``include_tail`` also the first t at or after it.  True positives are counted by interval first; only
    the intervals' counts are summed in order.
    """
    hits = union_pairs(found.select("id1", "id2", "progress_rank")).join(pair_set(gold), ["id1", "id2"], "left_semi")
    slot = F.greatest(F.ceil(F.col("progress_rank") / interval), F.lit(1)).cast("long")
    counts = cut(hits.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")), "slots")
    # The curve holds its value over intervals without a true positive.
    along = Window.orderBy("slot")
    steps = counts.select("slot", F.sum("n").over(along).alias("cum_tp"), F.lead("slot").over(along).alias("next"))
    last = F.col("slot") if include_tail else F.col("slot") - 1
    later = steps.select("cum_tp", F.explode(F.sequence("slot", F.coalesce(F.col("next") - 1, last))).alias("slot")) if include_tail else steps.where("next is not null").select("cum_tp", F.explode(F.sequence("slot", F.col("next") - 1)).alias("slot"))
    first = counts.agg(F.min("slot").alias("m")).where("m > 1").select(F.lit(0).cast("long").alias("cum_tp"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m") - 1)).alias("slot"))
    return later.unionByName(first).select((F.col("slot") * interval).alias("t"), "cum_tp")


def integral_quality(curve: DataFrame, gold_size: int, horizon: int) -> DataFrame:
    """quality: area under the step curve up to the horizon, over gold_size * horizon (one row, in double precision)."""
    along = Window.orderBy("t")
    rows = curve.where(F.col("t") <= horizon)
    # Each point's count holds until the next point, the last one's until the horizon.
    steps = rows.select(((F.coalesce(F.lead("t").over(along), F.lit(horizon)) - F.col("t")) * F.col("cum_tp")).alias("area"))
    return steps.agg((F.coalesce(F.sum("area"), F.lit(0)) / (float(gold_size) * horizon)).alias("quality"))


def threshold_sweep(scored: DataFrame, gold: DataFrame, thresholds: Iterable[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 for each threshold, from one pass over scored pairs (id1, id2, sim)."""
    values = sorted(set(thresholds))
    pairs = scored.where(~F.isnan("sim")).groupBy(*canonical(F.col("id1"), F.col("id2"))).agg(F.max("sim").alias("sim"))
    rows = pairs.join(pair_set(gold).withColumn("g", F.lit(1)), ["id1", "id2"], "left")
    cuts = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if((F.col("sim") >= t) & F.col("g").isNotNull()).alias("tp"), F.count_if((F.col("sim") >= t) & F.col("g").isNull()).alias("fp")) for t in values]
    counts = rows.agg(F.array(*cuts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    total = pair_set(gold).count()
    ratio = lambda a, b: F.when(b == 0, F.lit(float("nan"))).otherwise(a / F.greatest(b, F.lit(1)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.lit(total) - F.col("tp")
    return counts.select("threshold", "tp", "fp", fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, F.lit(total)).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def sweep_rows(table: DataFrame, parameter: str = "threshold") -> list[Mapping[str, float]]:
    """A sweep's rows (one a parameter value) as ``write_sweep`` takes them."""
    return [{"value": r[parameter], "precision": r["precision"], "recall": r["recall"], "f1_score": r["f1"]} for r in table.orderBy(parameter).collect()]
