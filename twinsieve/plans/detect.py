"""A detection run: profile, choose attributes, generate candidates, score them, keep the similar ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DetectConfig
from ..functions.similarity import Similarity, at_least, lev_bound, lev_sim, record_sim
from ..operators import candidates as C
from ..operators.ordering import attribute_key, interlaced_key, keyed, positions
from ..operators.profile import quoted
from ..operators.weights import AttributeWeight, attribute_weights
from ..scratch import cut
from ..sources.delimited import RID, attributes


@dataclass
class Run:
    """Scored candidates are lazy: rid1, rid2, rank, sim."""

    attributes: list[AttributeWeight]
    scored: DataFrame
    duplicates: DataFrame


def _named(relation: DataFrame, which: int | str) -> str:
    return which if isinstance(which, str) else attributes(relation)[which]


def _generated(placed: DataFrame, n: int, keys: int, cfg: DetectConfig, concurrent: bool, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs of each key with their rank, repeats across keys included."""
    if cfg.algorithm == "PSNM":
        return C.band_pairs(placed, cfg.window_size, carry).withColumn("rank", C.window_rank(n, keys, cfg.window_size, concurrent))
    if cfg.algorithm == "PB":
        return C.block_pairs(placed, cfg.block_size, cfg.max_block_range, carry).withColumn("rank", C.block_rank(n, keys, cfg.block_size, cfg.max_block_range, concurrent))
    return C.band_pairs(placed, 1, carry).withColumn("rank", F.lit(0).cast("long"))


def candidate_pairs(relation: DataFrame, keys: Sequence[Column], cfg: DetectConfig, concurrent: bool = False) -> DataFrame:
    """rid1, rid2, rank: the distinct candidate pairs of all keys, each at its first comparison."""
    placed = cut(positions(keyed(relation, keys)), "positions")
    return C.distinct_pairs(_generated(placed, relation.count(), len(keys), cfg, concurrent))


class Scoring:
    """What pairs are compared by: the columns that a record brings along, and the similarity of two such records."""

    def __init__(self, relation: DataFrame, chosen: Sequence[AttributeWeight], cfg: DetectConfig, weighted: bool, similarity: Similarity = lev_sim):
        self.relation, self.cfg, self.similarity = relation, cfg, similarity
        self.names = [a.attribute for a in chosen]
        self.weights = [a.weight for a in chosen] if weighted else None
        self.source = _named(relation, cfg.two_in_one) if cfg.two_in_one is not None else None

    @property
    def carried(self) -> list[str]:
        return [f"v{i}" for i in range(len(self.names))] + ["source"] * (self.source is not None)

    def values(self) -> DataFrame:
        """rid and the carried columns; for edit distances no more of a value than is compared."""
        value = (lambda c: F.substring(F.lower(c), 1, self.cfg.max_value_length)) if self.similarity is lev_sim else (lambda c: c)
        columns = [value(F.col(quoted(c))).alias(f"v{i}") for i, c in enumerate(self.names)]
        return self.relation.select(F.col(RID).alias("rid"), *columns, *([F.col(quoted(self.source)).alias("source")] if self.source else []))

    def scored(self, pairs: DataFrame) -> DataFrame:
        """rid1 < rid2, rank, sim of pairs with carried columns.

        Where lengths alone put a pair below the threshold, sim is that bound; where the edit distance of a single
        attribute is beyond what the threshold allows, sim is 0.
        """
        cfg = self.cfg
        if self.source:
            pairs = pairs.where(~F.col("source_1").eqNullSafe(F.col("source_2")))
        both = [(F.col(f"v{i}_1"), F.col(f"v{i}_2")) for i in range(len(self.names))]
        if self.similarity is lev_sim:
            longest, nan = cfg.max_value_length, F.lit(float("nan"))
            most = int((1 - cfg.similarity_threshold) * longest + 1e-9) if len(both) == 1 and self.weights is None else None
            bound = record_sim(both, self.weights, lambda a, b: lev_bound(a, b, longest))
            sim = record_sim(both, self.weights, lambda a, b: lev_sim(a, b, longest, most))
            # The bound is cheap; distances are worked out only where they can matter.
            sim = F.when(F.isnan(bound), nan).when(bound < cfg.similarity_threshold - 1e-9, bound).otherwise(sim)
        else:
            sim = record_sim(both, self.weights, self.similarity)
        return pairs.select(F.least("rid1", "rid2").alias("rid1"), F.greatest("rid1", "rid2").alias("rid2"), "rank", sim.alias("sim"))

    def of_pairs(self, pairs: DataFrame) -> DataFrame:
        """Scores rid pairs: both records are looked up."""
        side = lambda end: self.values().select(F.col("rid").alias(f"rid{end}"), *(F.col(c).alias(f"{c}_{end}") for c in self.carried))
        return self.scored(C.spread(pairs.join(side(1), "rid1"), "rid2").join(C.spread(side(2), "rid2"), "rid2"))

    def of_one_key(self, key: Column, concurrent: bool) -> DataFrame:
        """Scores the pairs of one order as they are generated: records carry their values through the pair join."""
        placed = cut(positions(keyed(self.relation, [key])), "positions")
        return self.scored(_generated(placed.join(self.values(), "rid"), self.relation.count(), 1, self.cfg, concurrent, self.carried))


def run(
    relation: DataFrame,
    cfg: DetectConfig,
    id_col: str | None = None,
    chosen: Sequence[AttributeWeight] | None = None,
    keys: Sequence[Column] | None = None,
    concurrent: bool = False,
    similarity: Similarity = lev_sim,
    absent: bool = False,
) -> Run:
    """The whole run.  ``chosen`` attributes are taken as given; else they are profiled, or the config's without a profiler.

    Sort keys are the chosen attributes (weight 0 included) unless ``keys`` are given.
    """
    if chosen is None:
        if cfg.use_profiler:
            chosen = attribute_weights(relation, cfg, absent)
        else:
            names = attributes(relation)
            chosen = [AttributeWeight(names.index(_named(relation, a)), _named(relation, a)) for a in cfg.similarity_attributes]
    weighted = cfg.use_profiler and cfg.use_weights
    keys = [attribute_key(F.col(quoted(a.attribute))) for a in chosen] if keys is None else list(keys)
    id_col = id_col or attributes(relation)[0]
    if not chosen or not keys:
        none = relation.sparkSession.createDataFrame([], "rid1 long, rid2 long, rank long, sim double")
        return Run(list(chosen), none, named_pairs(relation, none, id_col))
    scoring = Scoring(relation, chosen, cfg, weighted, similarity)
    scored = scoring.of_one_key(keys[0], concurrent) if len(keys) == 1 else scoring.of_pairs(candidate_pairs(relation, keys, cfg, concurrent))
    return Run(list(chosen), scored, named_pairs(relation, scored.where(at_least(F.col("sim"), cfg.similarity_threshold)), id_col))


def named_pairs(relation: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """id1, id2, sim, progress_rank by business id, smaller id first."""
    names = relation.select(F.col(RID), F.col(quoted(id_col)).alias("name"))
    rows = found.join(names.select(F.col(RID).alias("rid1"), F.col("name").alias("a")), "rid1").join(names.select(F.col(RID).alias("rid2"), F.col("name").alias("b")), "rid2")
    return rows.select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "sim", F.col("rank").alias("progress_rank"))


def detect(relation: DataFrame, cfg: DetectConfig, **how: object) -> DataFrame:
    """The duplicates of a run: id1, id2, sim, progress_rank."""
    return run(relation, cfg, **how).duplicates


def psnm(relation: DataFrame, cfg: DetectConfig, **how: object) -> DataFrame:
    return detect(relation, cfg.but(algorithm="PSNM"), **how)


def pb(relation: DataFrame, cfg: DetectConfig, **how: object) -> DataFrame:
    return detect(relation, cfg.but(algorithm="PB"), **how)


def single_key(relation: DataFrame, cfg: DetectConfig, key_attributes: Sequence[str], **how: object) -> DataFrame:
    """A run over one sort key: an attribute's, or the interlaced key of several."""
    columns = [F.col(quoted(c)) for c in key_attributes]
    key = attribute_key(columns[0]) if len(columns) == 1 else interlaced_key(columns, cfg.interlaced_key_length)
    return detect(relation, cfg, keys=[key], **how)
