"""Selection and weighting of attributes from metadata.  All inputs are lists of at most a few rows a column."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectConfig
from ..sources.delimited import attributes, well_formed
from . import profile as P


@dataclass(frozen=True)
class AttributeWeight:
    index: int
    attribute: str
    weight: float = 0.0


@dataclass
class Metadata:
    """What the profilers found; fds and uccs (of more than one column) are minimal over the whole relation."""

    columns: list[str]
    rows: int
    nulls: dict[str, int]
    keys: list[str]
    uccs: list[P.Columns]
    fds: list[P.FD]
    inds: list[P.IND]
    sinds: list[P.IND]


def profile(relation: DataFrame, cfg: DetectConfig, absent: bool = False) -> Metadata:
    """All profilers, in their order: similarity INDs, INDs, keys, FDs, UCCs."""
    columns = attributes(relation)
    formed = well_formed(relation)
    used = cfg.use_fd or cfg.filter_pk or cfg.use_ucc
    nulls = P.null_counts(relation, columns, absent)
    sinds = P.sinds(formed, columns, cfg.sind_threshold) if cfg.filter_ind else []
    inds = P.inds(formed, columns) if cfg.filter_ind else []
    lattice = P.Lattice(formed, columns) if used else None
    keys = P.keys(lattice) if cfg.filter_pk else []
    fds = P.by_gpdep(lattice, P.fds(lattice, cfg.max_fd_determinant), cfg.gpdep_threshold) if cfg.use_fd else []
    uccs = [s for s in P.uccs(lattice, cfg.max_ucc_determinant) if len(s) > 1] if cfg.use_ucc else []
    return Metadata(columns, relation.count(), nulls, keys, uccs, fds, inds, sinds)


def kept_occurrences(names: Iterable[str], enough: set[str], keys: set[str], dependent: set[str], cfg: DetectConfig) -> Counter[str]:
    """How often each attribute occurs in dependencies, filtered attributes left out (each filter only if it is on)."""
    drop = lambda c: (cfg.filter_missing and c not in enough) or (cfg.filter_pk and c in keys) or (cfg.filter_ind and c in dependent)
    return Counter(c for c in names if not drop(c))


def select_attributes(meta: Metadata, cfg: DetectConfig) -> list[AttributeWeight]:
    """The attributes that are left, heaviest first, ties in column order.

    Filters come in the order missing, inclusion, key, FD.  A weight is the attribute's share of all counted
    occurrences in FD determinants and UCCs, those of attributes that the FD filter drops included.
    """
    left = list(meta.columns)
    enough = P.below_null_threshold(meta.nulls, meta.rows, cfg.null_threshold)
    keys: set[str] = set()
    dependent: set[str] = set()
    if cfg.filter_missing:
        left = [c for c in left if c in enough]
    if cfg.filter_ind:
        dependent = {i.dep for i in [*meta.sinds, *P.without_mirrors(meta.inds, meta.columns)]}
        left = [c for c in left if c not in dependent]
    if cfg.filter_pk:
        keys = set(meta.keys)
        left = [c for c in left if c not in keys]
    in_fds: Counter[str] = Counter()
    in_uccs: Counter[str] = Counter()
    if cfg.use_fd:
        in_fds = kept_occurrences((c for f in meta.fds for c in f.lhs), enough, keys, dependent, cfg)
        if cfg.filter_fd:
            left = [c for c in left if c in in_fds]
    if cfg.use_ucc:
        in_uccs = kept_occurrences((c for s in meta.uccs for c in s), enough, keys, dependent, cfg)
    place = {c: i for i, c in enumerate(meta.columns)}
    out = [AttributeWeight(place[c], c) for c in left]
    if cfg.use_weights:
        every = sum(in_fds.values()) + sum(in_uccs.values())
        out = [AttributeWeight(a.index, a.attribute, (in_fds[a.attribute] + in_uccs[a.attribute]) / every if every else 0.0) for a in out]
        out.sort(key=lambda a: (-a.weight, a.index))
    return out


def attribute_weights(relation: DataFrame, cfg: DetectConfig, absent: bool = False) -> list[AttributeWeight]:
    return select_attributes(profile(relation, cfg, absent), cfg)


def occurrences(sets: DataFrame, column: str) -> DataFrame:
    """attribute, n: in how many of the column sets each attribute is."""
    return sets.select(F.explode(column).alias("attribute")).groupBy("attribute").agg(F.count("*").alias("n"))


def dependents(fds: DataFrame) -> DataFrame:
    """attribute, n: how often each attribute is the determined one."""
    return fds.groupBy(F.col("rhs").alias("attribute")).agg(F.count("*").alias("n"))


def weight_table(fds: DataFrame, uccs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """index, attribute, weight, as rows: counts of both kinds over their sum."""
    both = occurrences(fds, "lhs").unionByName(occurrences(uccs, "cols")).groupBy("attribute").agg(F.sum("n").alias("n"))
    total = both.agg(F.sum("n")).first()[0] or 1
    names = fds.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "index int, attribute string")
    out = names.join(both, "attribute", "left")
    return out.select("index", "attribute", F.coalesce(F.col("n") / total, F.lit(0.0)).alias("weight")).orderBy(F.desc("weight"), "index")
