"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op10_bpe_round_trip
from .fingerprints import op3_fingerprints
from .jaccard import op2_jaccard_join
from .licenses import op8_licenses
from .lines import op4_line_dedup
from .mixing import OP7_SQL, op7_mixing
from .quality import op1_quality
from .secrets import op9_secrets
from .topk import OP6_SQL, op6_maxscore_topk
from .urls import OP5_SQL, op5_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_jaccard_join, op3_fingerprints, op4_line_dedup, op5_url_filter, op6_maxscore_topk, op7_mixing, op8_licenses, op9_secrets, op10_bpe_round_trip)
}

ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": OP5_SQL,
    "op6_maxscore_topk": OP6_SQL,
    "op7_mixing": OP7_SQL,
}
