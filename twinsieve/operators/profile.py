"""Metadata of a relation: missing values, unique column combinations, functional and inclusion dependencies.

Only metadata (a number for each set of columns, a row for each dependency) reaches the driver.  The lattice of
column sets is gone through level by level; a level is a few GROUPING SETS jobs, with supersets of what is found pruned.
Exact FDs and UCCs that a few rows contradict are not counted at all.  Null equals null in FDs and UCCs, and is no
value in INDs.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Columns = frozenset[str]
#: Column sets in one GROUPING SETS job.
SETS_A_JOB = 24
#: Rows that refute candidates before all rows are counted; 8 bytes a value of them reach the driver.
SAMPLE = 20_000


@dataclass(frozen=True)
class FD:
    lhs: Columns
    rhs: str


@dataclass(frozen=True)
class IND:
    dep: str
    ref: str


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def null_counts(relation: DataFrame, columns: Sequence[str], absent: bool = True) -> dict[str, int]:
    """Values that are empty after trimming; null ones too unless ``absent`` is false (absent fields of text rows)."""
    missing = lambda c: F.count_if(F.coalesce(F.trim(F.col(quoted(c)).cast("string")) == "", F.lit(absent))).alias(c)
    return relation.agg(*map(missing, columns)).first().asDict() if columns else {}


def below_null_threshold(nulls: dict[str, int], rows: int, threshold: float) -> set[str]:
    return {c for c, n in nulls.items() if rows and not n / rows >= threshold}


class Sample:
    """Numbers of distinct rows of column sets among a few rows, by hashes of the values.

    Rows can refute what they contradict, never confirm it: which rows they are doesn't matter.  Two values of one
    hash would have to meet (chance 1e-11 a column) for a set to be refuted wrongly.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], most: int):
        rows = df.select(*(F.xxhash64(F.col(quoted(c))).alias(c) for c in df.columns)).limit(most).toArrow()
        self.rows = rows.num_rows
        self.codes = {c: np.unique(rows.column(i).to_numpy(), return_inverse=True)[1] for i, c in enumerate(columns)}
        self.groups: dict[Columns, np.ndarray] = {frozenset(): np.zeros(self.rows, np.int64)}
        self.cards: dict[Columns, int] = {}

    def group(self, s: Columns) -> np.ndarray:
        """The number of each row's group; kept for sets of up to two columns."""
        if s in self.groups:
            return self.groups[s]
        last = max(s)
        both = self.group(s - {last}) * max(self.rows, 1) + self.codes[last]
        out = np.unique(both, return_inverse=True)[1]
        if len(s) <= 2:
            self.groups[s] = out
        return out

    def card(self, s: Columns) -> int:
        if s not in self.cards:
            self.cards[s] = int(self.group(s).max()) + 1 if self.rows else 0
        return self.cards[s]

    def not_unique(self, s: Columns) -> bool:
        return self.card(s) < self.rows

    def broken(self, x: Columns, a: str) -> bool:
        """Whether rows that agree in ``x`` differ in ``a``."""
        return self.card(x) < self.card(x | {a})


class Lattice:
    """Numbers of distinct rows (and, where asked for, sums of squared group sizes) of column sets, each worked out once."""

    def __init__(self, df: DataFrame, columns: Sequence[str] | None = None, sample: int = SAMPLE):
        self.columns = list(columns or df.columns)
        self.df = df.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(self.columns)))
        self.place = {c: i for i, c in enumerate(self.columns)}
        self.rows = df.count()
        self.sample = Sample(self.df, self.columns, sample)
        self.cards: dict[Columns, int] = {frozenset(): 1 if self.rows else 0}
        self.sums: dict[Columns, int] = {frozenset(): self.rows**2}

    def load(self, sets: Iterable[Columns], squares: bool = False) -> None:
        known = self.sums if squares else self.cards
        todo = [s for s in dict.fromkeys(sets) if s not in known]
        for at in range(0, len(todo), SETS_A_JOB):
            self._job(todo[at : at + SETS_A_JOB], squares)

    def _job(self, sets: list[Columns], squares: bool) -> None:
        used = sorted({self.place[c] for s in sets for c in s})
        names = [f"c{i}" for i in used]
        if len(names) > 60:  # grouping_id has 64 bits
            half = len(sets) // 2
            for part in (sets[:half], sets[half:]) if half else ():
                self._job(part, squares)
            if not half:
                raise ValueError("a column set of more than 60 columns")
            return
        spec = ", ".join("(" + ", ".join(f"c{self.place[c]}" for c in sorted(s)) + ")" for s in sets)
        view = f"lattice_{uuid.uuid4().hex}"
        self.df.createOrReplaceTempView(view)
        try:
            found = self.df.sparkSession.sql(f"""
                SELECT gid, count(*) AS card{", sum(cast(n AS decimal(38, 0)) * n) AS squares" if squares else ""}
                FROM (SELECT grouping_id() AS gid{", count(*) AS n" if squares else ""} FROM {view}
                      GROUP BY {", ".join(names)} GROUPING SETS ({spec})) GROUP BY gid""").collect()
        finally:
            self.df.sparkSession.catalog.dropTempView(view)
        by_id = {r["gid"]: r for r in found}
        for s in sets:
            gid = sum(1 << (len(names) - 1 - k) for k, i in enumerate(used) if self.columns[i] not in s)
            self.cards[s] = by_id[gid]["card"] if gid in by_id else 0
            if squares:
                self.sums[s] = int(by_id[gid]["squares"]) if gid in by_id else 0

    def card(self, s: Columns) -> int:
        return self.cards[s]

    def squares(self, s: Columns) -> int:
        return self.sums[s]


def _unless_covered(candidates: Iterable[Columns], found: list[Columns]) -> list[Columns]:
    return [s for s in candidates if not any(f <= s for f in found)]


def uccs(lattice: Lattice, most: int, error: float = 0.0) -> list[Columns]:
    """Minimal unique column combinations of at most ``most`` columns; with ``error``, approximate ones.

    The error is the share of ordered row pairs that agree, sum c (c - 1) / (N (N - 1)).
    """
    n, found = lattice.rows, []
    for level in range(1, most + 1):
        todo = _unless_covered(map(frozenset, combinations(lattice.columns, level)), found)
        if not error:
            todo = [s for s in todo if not lattice.sample.not_unique(s)]
        lattice.load(todo, squares=bool(error))
        ok = (lambda s: lattice.card(s) == n) if not error else (lambda s: (lattice.squares(s) - n) <= error * n * (n - 1))
        found += [s for s in todo if n and ok(s)]
    return found


def keys(lattice: Lattice) -> list[str]:
    return [next(iter(s)) for s in uccs(lattice, 1)]


def fds(lattice: Lattice, most: int, error: float = 0.0) -> list[FD]:
    """Minimal non-trivial functional dependencies with at most ``most`` determining columns, the empty set included.

    With ``error``: approximate ones by g1, (sum |X|^2 - sum |XA|^2) / (N^2 - N).
    """
    n, found = lattice.rows, []
    minimal: dict[str, list[Columns]] = defaultdict(list)
    if not n:
        return []
    for level in range(most + 1):
        todo = [(x, a) for x in map(frozenset, combinations(lattice.columns, level)) for a in lattice.columns if a not in x and not any(m <= x for m in minimal[a])]
        if not error:
            todo = [(x, a) for x, a in todo if not lattice.sample.broken(x, a)]
        lattice.load([s for x, a in todo for s in (x, x | {a})], squares=bool(error))
        for x, a in todo:
            both = x | {a}
            holds = lattice.card(x) == lattice.card(both) if not error else (lattice.squares(x) - lattice.squares(both)) <= error * (n * n - n)
            if holds:
                minimal[a].append(x)
                found.append(FD(x, a))
    return found


def pdep(lattice: Lattice, column: str) -> float:
    """Chance that two rows drawn at random agree in the column."""
    lattice.load([frozenset([column])], squares=True)
    return lattice.squares(frozenset([column])) / float(lattice.rows) ** 2


def epdep(lattice: Lattice, fd: FD) -> float:
    """What pdep of a dependency would be expected to be by chance."""
    lattice.load([fd.lhs])
    p = pdep(lattice, fd.rhs)
    return p + (lattice.card(fd.lhs) - 1) / (lattice.rows - 1) * (1 - p) if lattice.rows > 1 else 1.0


def gpdep(lattice: Lattice, fd: FD) -> float:
    """Genuineness of an exact dependency: how far its pdep of 1 is above chance."""
    return 1 - epdep(lattice, fd)


def by_gpdep(lattice: Lattice, found: list[FD], threshold: float) -> list[FD]:
    return [f for f in found if gpdep(lattice, f) >= threshold] if threshold > 0 else found


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns and n: how often each combination of their values occurs, nulls being a value."""
    return df.groupBy(*(F.col(quoted(c)) for c in columns)).agg(F.count("*").alias("n"))


def column_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """c (place of the column), value: distinct non-null values."""
    columns = list(columns or df.columns)
    each = F.array(*(F.struct(F.lit(i).alias("c"), F.col(quoted(c)).cast("string").alias("value")) for i, c in enumerate(columns)))
    return df.select(F.explode(each).alias("x")).select("x.c", "x.value").where("value is not null").distinct()


def shared_values(values: DataFrame) -> DataFrame:
    """dep, ref, n: how many distinct values of dep occur in ref (dep = ref: all of them).

    A value's columns are gathered, at most one entry for each column, so no value is a large group.
    """
    rows = values.groupBy("value").agg(F.sort_array(F.collect_set("c")).alias("cs"))
    rows = rows.groupBy("cs").count()  # a row for each set of columns
    rows = rows.select("count", "cs", F.explode("cs").alias("dep")).select("count", "dep", F.explode("cs").alias("ref"))
    return rows.groupBy("dep", "ref").agg(F.sum("count").alias("n"))


def inds(df: DataFrame, columns: Sequence[str] | None = None) -> list[IND]:
    """Unary inclusion dependencies within the relation, trivial ones and columns without values left out."""
    columns = list(columns or df.columns)
    n = {(r["dep"], r["ref"]): r["n"] for r in shared_values(column_values(df, columns)).collect()}
    return [IND(columns[d], columns[r]) for (d, r), k in sorted(n.items()) if d != r and k == n[d, d]]


def without_mirrors(found: Sequence[IND], columns: Sequence[str]) -> list[IND]:
    """Of A in B and B in A the one whose dependent column comes first stays."""
    place = {c: i for i, c in enumerate(columns)}
    every = set(found)
    return [i for i in found if IND(i.ref, i.dep) not in every or place[i.dep] < place[i.ref]]


def _numbered_grams(value: str, q: int) -> F.Column:
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - (q - 1), F.lit(1))), lambda i: F.substring(value, i, F.lit(q)))
    return F.array_sort(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g))))


def sinds(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.75, q: int = 2) -> list[IND]:
    """Similarity inclusion dependencies: each value of dep has one in ref of normalised Levenshtein similarity >= threshold.

    Values that ref holds as they are need no partner.  For the others, two values within the distance that the
    threshold allows (k = (1 - threshold) longer length) share all but k q of their distinct q-grams, so they share one
    of the first k q + 1 in any fixed order; only such values of fitting length are compared.
    """
    columns = list(columns or df.columns)
    values = column_values(df, columns).persist()
    try:
        n = {(r["dep"], r["ref"]): r["n"] for r in shared_values(values).collect()}
        totals = {d: k for (d, r), k in n.items() if d == r}
        pairs = df.sparkSession.createDataFrame([(d, r) for d in totals for r in totals if d != r], "dep int, ref int")
        grams = _numbered_grams("value", q)
        size = F.length("value")
        k = F.floor((1 - threshold) * size / threshold + 1e-9)  # the partner may be longer
        rows = values.select("c", "value", size.alias("n"), F.when(size - (q - 1) - k * q < 1, F.array(F.lit(0).cast("long"))).otherwise(F.slice(grams, F.lit(1), (k * q + 1).cast("int"))).alias("prefix"), (size - (q - 1) - k * q < 1).alias("short"))
        # Values too short for a q-gram bound are compared with all of fitting length that are short as well or within its reach.
        deps = rows.select(F.col("c").alias("dep"), F.col("value").alias("v"), F.col("n").alias("m"), "short", "prefix").join(F.broadcast(pairs), "dep")
        held = values.select(F.col("c").alias("ref"), F.col("value").alias("v"))
        deps = deps.join(held, ["ref", "v"], "left_anti")
        refs = rows.select(F.col("c").alias("ref"), "value", "n", F.col("short").alias("short_ref"), F.col("prefix").alias("prefix_ref"))
        fits = (F.col("n") >= F.col("m") * threshold - 1e-9) & (F.col("n") <= F.col("m") / threshold + 1e-9)
        near = fits & (1 - F.levenshtein("v", "value") / F.greatest("n", "m", F.lit(1)) >= threshold - 1e-12)
        lengths = F.sequence(F.ceil(F.col("m") * threshold - 1e-9).cast("int"), F.floor(F.col("m") / threshold + 1e-9).cast("int"))
        long = deps.where("not short").select("dep", "ref", "v", "m", F.explode("prefix").alias("g")).join(refs.where("not short_ref").select("ref", "value", "n", F.explode("prefix_ref").alias("g")), ["ref", "g"])
        mixed = deps.where("short").select("dep", "ref", "v", "m", F.explode(lengths).alias("n")).join(refs.select("ref", "value", "n"), ["ref", "n"])
        other = deps.where("not short").select("dep", "ref", "v", "m", F.explode(lengths).alias("n")).join(refs.where("short_ref").select("ref", "value", "n"), ["ref", "n"])
        hits = [x.where(near).select("dep", "ref", "v") for x in (long, mixed, other)]
        matched = hits[0].unionByName(hits[1]).unionByName(hits[2]).distinct().groupBy("dep", "ref").count()
        extra = {(r["dep"], r["ref"]): r["count"] for r in matched.collect()}
    finally:
        values.unpersist()
    ok = lambda d, r: n.get((d, r), 0) + extra.get((d, r), 0) == totals[d]
    return [IND(columns[d], columns[r]) for d in sorted(totals) for r in sorted(totals) if d != r and ok(d, r)]


def fd_table(spark, found: Sequence[FD]) -> DataFrame:
    return spark.createDataFrame([(sorted(f.lhs), f.rhs) for f in found], "lhs array<string>, rhs string")


def ucc_table(spark, found: Sequence[Columns]) -> DataFrame:
    return spark.createDataFrame([(sorted(s),) for s in found], "cols array<string>")


def ind_table(spark, found: Sequence[IND]) -> DataFrame:
    return spark.createDataFrame([(i.dep, i.ref) for i in found], "dep string, ref string")
