"""Exact top-k search by integer inner product with MaxScore (operator 6).

A term is a dimension; its postings in a shard are the column of that dimension.  A query bounds a term's part
of the score by its weight times the shard's largest (or, for a negative weight, smallest) value.  Terms in
order of bound are split: the tail whose bounds add up to less than the k-th score so far is non-essential.  The
essential postings are traversed term by term; rows that still could enter the top k with all non-essential
bounds added are probed in the other terms, from the largest bound on, and dropped as soon as they can't.
Each shard is gone through in blocks, so the threshold rises early.  A shard's best k rows per query are merged.

Shards of rows and blocks of queries are of fixed size, so a task's memory is bounded, and each shard meets each
block of queries in one task.  The work is queries x rows by the nature of the question.

Edge cases: vectors that are null, or hold null or non-finite components, take no part, neither as queries nor
as candidates; shorter vectors count as padded with zeros.  Of rows that share a vec_id each is a candidate, and each a
query of its own, but none is a candidate of a query with its id.  Rows whose vec_id is null take no part.  Components
are whole numbers of 64 bits, and so are scores: beyond that (floats above 2^57) both are cut off.  An empty table gives an empty result.  Fewer than k candidates: all of them.  Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows of a shard, queries of a block, and rows of a shard between two looks at the threshold.
SHARD_ROWS, BLOCK_QUERIES, STRIDE = 16_384, 2_048, 4_096


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component, for the vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e * scale).cast("long"))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


class Shard:
    """The postings of one shard: for each term its values over the rows, ordered by vec_id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, stride: int = STRIDE):
        order = np.argsort(ids, kind="stable")
        self.ids, self.terms = ids[order], np.ascontiguousarray(rows[order].T)
        self.blocks = [(a, min(a + stride, len(ids))) for a in range(0, len(ids), stride)]
        self.high = np.array([self.terms[:, a:b].max(axis=1) for a, b in self.blocks])
        self.low = np.array([self.terms[:, a:b].min(axis=1) for a, b in self.blocks])

    def search(self, own: int, q: np.ndarray, k: int, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the best k rows but the query's own, by score, then vec_id."""
        best_ids, best, floor = np.empty(0, np.int64), np.empty(0, np.int64), None
        used = np.flatnonzero(q)
        for (a, b), high, low in zip(self.blocks, self.high, self.low):
            bounds = np.where(q[used] > 0, q[used] * high[used], q[used] * low[used])
            order = used[np.argsort(-bounds, kind="stable")]
            bounds = np.sort(bounds)[::-1]
            # after[i]: the most that terms i, i+1, ... can add
            after = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]])
            essential = len(order) if floor is None else int(np.argmax(after < floor)) if (after < floor).any() else len(order)
            if floor is not None and after[0] < floor:
                continue  # no row of this block can enter
            essential = max(essential, 1) if len(order) else 0
            score = np.zeros(b - a, np.int64) if not essential else (q[order[:essential]] @ self.terms[order[:essential], a:b])
            alive = np.arange(a, b) if floor is None else a + np.flatnonzero(score + after[essential] >= floor)
            score = score[alive - a]
            for i in range(essential, len(order)):
                score = score + q[order[i]] * self.terms[order[i], alive]
                if i % 4 == 3:
                    keep = score + after[i + 1] >= floor
                    alive, score = alive[keep], score[keep]
            if stats is not None:
                stats["probed"] = stats.get("probed", 0) + len(alive)
            keep = self.ids[alive] != own
            if floor is not None:
                keep &= score >= floor
            best_ids, best = np.concatenate([best_ids, self.ids[alive[keep]]]), np.concatenate([best, score[keep].astype(np.int64)])
            if len(best) > k:
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
            if len(best) == k:
                floor = int(best.min())
        top = np.lexsort((best_ids, -best))[:k]
        return best_ids[top], best[top]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact_type(most: int, other: int, width: int) -> type:
    """The fastest type in which all scores are whole."""
    top = most * other * width
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64


def search(vectors: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score; ``vectors`` as ``integer_vectors`` returns them."""
    vectors = cut(vectors.withColumn("key", F.monotonically_increasing_id()), "vectors")  # written, the keys are fixed
    n, m = vectors.select(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil((m or 0) / block_queries))
    rows = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "key", F.lit(1)), F.lit(shards)).cast("int"))
    queries = vectors.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", "key", F.lit(2)), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"key": [], "query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            width = max(map(len, [*left.v, *right.v]))
            q, x = _matrix(left.v, width), _matrix(right.v, width)
            kind = _exact_type(int(np.abs(q).max(initial=0)), int(np.abs(x).max(initial=0)), max(width, 1))
            shard = Shard(right.vec_id.to_numpy(), x.astype(kind))
            for key, own, one in zip(left.key, left.vec_id, q.astype(kind)):
                ids, scores = shard.search(own, one, k)
                out["key"].append(np.full(len(ids), key))
                out["query_id"].append(np.full(len(ids), own))
                out["vec_id"].append(ids)
                out["score"].append(scores)
        return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()}).astype("int64")

    found = queries.groupBy("block", "shard").cogroup(rows.groupBy("block", "shard")).applyInPandas(run, "key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, 20)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT q.key, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
