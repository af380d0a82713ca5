"""What the operators of this subpackage share: scratch tables in the cluster's folder, rows kept whole."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut as cut

#: Name of the struct that carries a whole input row, so that no input column can clash with a computed one.
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(shared: Broadcast, make: Callable[[Any], Any]) -> Any:
    """What ``make`` makes of a broadcast value, kept beside it: a worker process has one for all its tasks."""
    if not hasattr(shared, "_made"):
        shared._made = make(shared.value)
    return shared._made


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body uses it.

    The optimizer may put a column's expression in place of the column, even within a lambda, where it would be
    worked out for each element; it leaves the variable of a lambda alone.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_row(df: DataFrame, but: Sequence[str] = ()) -> Column:
    """The row's columns (but some) as one struct."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns if c not in but]).alias(ROW)
