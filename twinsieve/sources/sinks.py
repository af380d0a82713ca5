"""Results as delimited text: progress curves, sweeps over a parameter, pairs, spilled relations."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one_file(path: str, lines: Iterable[str]) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{line}\n" for line in lines)


def write_progress_curve(curve: DataFrame, path: str, horizon: int) -> None:
    """``Time,Number of duplicates``, then (0,0), then the points up to the horizon: a bounded number of lines."""
    rows = curve.where(F.col("t") <= horizon).orderBy("t").collect()
    _one_file(path, ["Time,Number of duplicates", "(0,0)", *(f"{r['t']},{r['cum_tp']}" for r in rows)])


def write_sweep(rows: Iterable[Mapping[str, float]], directory: str, parameter: str = "Threshold") -> None:
    """One file for each of precision, recall, f1_score and number_of_attributes, a line for each value of the parameter."""
    rows = list(rows)
    for metric in ("precision", "recall", "f1_score", "number_of_attributes"):
        if rows and metric in rows[0]:
            _one_file(os.path.join(directory, f"{metric}.csv"), [f"{parameter},{metric}", *(f"{r['value']},{r[metric]}" for r in rows)])


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def write_relation(relation: DataFrame, path: str, encoding: str = "ISO-8859-1") -> None:
    """A relation (or a part of it) as ``;``-separated text that ``read_relation`` reads."""
    relation.drop("_rid", "_ragged").write.mode("overwrite").option("header", True).option("sep", ";").option("encoding", encoding).option("emptyValue", "").csv(path)


def log_lines(metrics: Mapping[str, float]) -> list[str]:
    return [f"{name}: {value}" for name, value in metrics.items()]
