"""Registered queries and, beside each, SQL that gives the same rows.

Text is folded to ASCII where edit distances are compared, as the two engines count bytes and characters.  Doubles
are rounded to nine places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DetectConfig
from ..functions import similarity as S
from ..operators import candidates as C
from ..operators import evaluate as E
from ..operators import ordering as O
from ..operators import profile as P
from ..operators import weights as W
from ..operators.weights import AttributeWeight
from ..scratch import cut, own_dir
from ..sources import delimited as D
from ..sources import sinks as K
from . import detect as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_text(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^\x00-\x7F]", "?")


def rounded(c: Column) -> Column:
    return F.round(c, 9)


DOCS_SQL = r"docs AS (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '?', 'g') AS t FROM documents)"
#: Levenshtein similarity of lower-cased values, cut to 200 characters.
LEV_SQL = "(1 - levenshtein(left(lower({a}), 200), left(lower({b}), 200))::DOUBLE / greatest(least(length({a}), 200), least(length({b}), 200)))"


def lev_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 'NaN'::DOUBLE ELSE {LEV_SQL.format(a=a, b=b)} END)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and text of every document as a relation."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", ascii_text("text").alias("t"))
    return D.as_relation(rows, ["doc_id"])


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.as_relation(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ["p_partkey"])


ON_TEXT = [AttributeWeight(2, "t", 1.0)]
PLAIN = DetectConfig(use_weights=False, similarity_threshold=0.65)


def by_key(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("id1").cast("long").alias("id1"), F.col("id2").cast("long").alias("id2"), *([rounded(F.col("sim")).alias("sim")] if "sim" in pairs.columns else []), *(["progress_rank"] if "progress_rank" in pairs.columns else []))


def ordered_ids(pairs: DataFrame) -> DataFrame:
    """Pairs by numeric id, smaller first."""
    a, b = F.col("id1").cast("long"), F.col("id2").cast("long")
    return pairs.select(F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2"), *(c for c in pairs.columns if c not in ("id1", "id2")))


PSNM_PAIRS_SQL = f"""
{DOCS_SQL},
o AS (SELECT *, row_number() OVER (ORDER BY lower(t), doc_id) - 1 AS pos FROM docs),
n AS (SELECT count(*) AS n FROM docs),
p AS (SELECT a.doc_id AS d1, b.doc_id AS d2, a.t AS t1, b.t AS t2, a.source AS s1, b.source AS s2, b.pos - a.pos AS d, a.pos AS p
      FROM o a JOIN o b ON b.pos BETWEEN a.pos + 1 AND a.pos + 19)"""
SIM_OF_TEXTS = lev_sql("t1", "t2")


def psnm_run(spark: SparkSession, sf_dir: str, cfg: DetectConfig = PLAIN) -> DataFrame:
    return ordered_ids(X.psnm(documents(spark, sf_dir), cfg, id_col="doc_id", chosen=ON_TEXT)).withColumn("sim", rounded(F.col("sim")))


PSNM_SQL = f"""
WITH {PSNM_PAIRS_SQL},
s AS (SELECT least(d1, d2) AS id1, greatest(d1, d2) AS id2, {SIM_OF_TEXTS} AS sim, ((d - 1) * n - d * (d - 1) // 2 + p + 1)::BIGINT AS progress_rank FROM p, n)
SELECT id1, id2, round(sim, 9) AS sim, progress_rank FROM s WHERE NOT isnan(sim) AND sim >= 0.65"""


@query(PSNM_SQL)
def psnm_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted neighbourhood over one key: window pairs, similarity, threshold, progressive rank."""
    return psnm_run(spark, sf_dir)


@query(f"""
WITH {DOCS_SQL},
o AS (SELECT *, row_number() OVER (ORDER BY lower(t), doc_id) - 1 AS pos FROM docs),
p AS (SELECT a.doc_id AS d1, b.doc_id AS d2, a.t AS t1, b.t AS t2 FROM o a JOIN o b ON a.pos < b.pos AND b.pos // 4 - a.pos // 4 BETWEEN 0 AND 4),
s AS (SELECT least(d1, d2) AS id1, greatest(d1, d2) AS id2, {SIM_OF_TEXTS} AS sim FROM p)
SELECT id1, id2, round(sim, 9) AS sim FROM s WHERE NOT isnan(sim) AND sim >= 0.65""")
def pb_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progressive blocking over one key."""
    return ordered_ids(X.pb(documents(spark, sf_dir), PLAIN, id_col="doc_id", chosen=ON_TEXT)).select("id1", "id2", rounded(F.col("sim")).alias("sim"))


@query(f"""
WITH {PSNM_PAIRS_SQL}
SELECT least(d1, d2) AS id1, greatest(d1, d2) AS id2, round(sim, 9) AS sim
FROM (SELECT *, {SIM_OF_TEXTS} AS sim FROM p WHERE s1 IS DISTINCT FROM s2) WHERE NOT isnan(sim) AND sim >= 0.65""")
def cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted neighbourhood where both records must be of different sources."""
    return psnm_run(spark, sf_dir, PLAIN.but(two_in_one="source")).drop("progress_rank")


def _placed(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    return O.positions(O.keyed(parts(spark, sf_dir), [O.attribute_key(F.col(c)) for c in names]))


PART_KEYS = ["p_name", "p_brand", "p_type"]
PART_ORDER_SQL = "o AS (" + " UNION ALL ".join(f"SELECT {i} AS k, p_partkey AS rid, row_number() OVER (ORDER BY lower({c}), p_partkey) - 1 AS pos FROM part" for i, c in enumerate(PART_KEYS)) + ")"


@query(f"WITH {PART_ORDER_SQL} SELECT k, rid, pos FROM o")
def key_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of each record in the order of each sort key."""
    return _placed(spark, sf_dir, PART_KEYS).select("k", "rid", "pos")


@query(f"WITH {PART_ORDER_SQL} SELECT DISTINCT least(a.rid, b.rid) AS rid1, greatest(a.rid, b.rid) AS rid2 FROM o a JOIN o b ON a.k = b.k AND b.pos BETWEEN a.pos + 1 AND a.pos + 19")
def psnm_multikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the window pairs of three keys, each pair once."""
    return X.candidate_pairs(parts(spark, sf_dir), [O.attribute_key(F.col(c)) for c in PART_KEYS], PLAIN).select("rid1", "rid2")


@query(f"WITH {PART_ORDER_SQL} SELECT DISTINCT least(a.rid, b.rid) AS rid1, greatest(a.rid, b.rid) AS rid2 FROM o a JOIN o b ON a.k = b.k AND b.pos > a.pos AND b.pos // 4 - a.pos // 4 <= 4")
def pb_multikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the block pairs of three keys, each pair once."""
    return X.candidate_pairs(parts(spark, sf_dir), [O.attribute_key(F.col(c)) for c in PART_KEYS], PLAIN.but(algorithm="PB")).select("rid1", "rid2")


@query(f"""
WITH {PART_ORDER_SQL}, n AS (SELECT count(*) AS n FROM part),
p AS (SELECT a.k, a.rid AS r1, b.rid AS r2, b.pos - a.pos AS d, a.pos AS p FROM o a JOIN o b ON a.k = b.k AND b.pos BETWEEN a.pos + 1 AND a.pos + 19)
SELECT least(r1, r2) AS rid1, greatest(r1, r2) AS rid2, min(((d - 1) * n - d * (d - 1) // 2) * 3 + k * (n - d) + p + 1)::BIGINT AS rank FROM p, n GROUP BY 1, 2""")
def psnm_concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs in the attribute-concurrent order: all keys advance a distance at a time."""
    return X.candidate_pairs(parts(spark, sf_dir), [O.attribute_key(F.col(c)) for c in PART_KEYS], PLAIN, concurrent=True)


CUSTOMER_ORDER_SQL = "o AS (SELECT c_custkey AS rid, row_number() OVER (ORDER BY lower(c_mktsegment), c_custkey) - 1 AS pos FROM customer)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.as_relation(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"])
    return cut(O.positions(O.keyed(rows, [O.attribute_key(F.col("c_mktsegment"))])), "positions")


@query(f"WITH {CUSTOMER_ORDER_SQL} SELECT a.rid AS rid1, b.rid AS rid2 FROM o a JOIN o b ON b.pos = a.pos + 7")
def single_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs exactly seven places apart."""
    return C.distance_pairs(_customers(spark, sf_dir), 7).select("rid1", "rid2")


@query(f"WITH {CUSTOMER_ORDER_SQL} SELECT a.rid AS rid1, b.rid AS rid2, b.pos - a.pos AS distance FROM o a JOIN o b ON b.pos BETWEEN a.pos + 1 AND a.pos + 3")
def psnm_prepass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the sort-phase pre-pass with an interval of three."""
    return C.prepass_pairs(_customers(spark, sf_dir), 3).select("rid1", "rid2", "distance")


@query(f"WITH {CUSTOMER_ORDER_SQL} SELECT a.rid AS rid1, b.rid AS rid2 FROM o a JOIN o b ON a.pos < b.pos AND a.pos // 4 = b.pos // 4")
def within_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the same block (basic blocking pass)."""
    return C.within_blocks(_customers(spark, sf_dir), 4).select("rid1", "rid2")


@query(f"WITH {CUSTOMER_ORDER_SQL} SELECT pos // 4 AS block, count(*) AS n, min(rid) AS least, max(rid) AS most FROM o WHERE pos // 4 BETWEEN 2 AND 9 GROUP BY 1")
def block_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks 2 to 9 of an order (a range of blocks is the feature)."""
    rows = D.blocks(_customers(spark, sf_dir), 4, 2, 10)
    return rows.groupBy("block").agg(F.count("*").alias("n"), F.min("rid").alias("least"), F.max("rid").alias("most"))


CHOSEN_BLOCKS_SQL = f"WITH {PART_ORDER_SQL} SELECT o.k, pos // 4 AS block, count(*) AS n FROM o JOIN (VALUES (0, 3), (1, 5), (2, 0)) c(k, block) ON o.k = c.k AND pos // 4 = c.block GROUP BY 1, 2"


@query(CHOSEN_BLOCKS_SQL)
def chosen_blocks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen (key, block) pairs across several orders."""
    chosen = spark.createDataFrame([(0, 3), (1, 5), (2, 0)], "k int, block long")
    return D.blocks(_placed(spark, sf_dir, PART_KEYS), 4, chosen=chosen).groupBy("k", "block").agg(F.count("*").alias("n"))


PART_PAIRS_SQL = """
pairs AS (SELECT a.p_partkey AS id1, b.p_partkey AS id2, a.p_name AS n1, b.p_name AS n2, a.p_brand AS b1, b.p_brand AS b2, a.p_type AS t1, b.p_type AS t2
          FROM (SELECT *, row_number() OVER (ORDER BY lower(p_name), p_partkey) - 1 AS pos FROM part) a
          JOIN (SELECT *, row_number() OVER (ORDER BY lower(p_name), p_partkey) - 1 AS pos FROM part) b ON b.pos BETWEEN a.pos + 1 AND a.pos + 4)"""


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts up to four places apart by name, with their values."""
    rows = parts(spark, sf_dir)
    pairs = C.band_pairs(_placed(spark, sf_dir, ["p_name"]), 5)
    side = lambda e: rows.select(F.col("_rid").alias(f"rid{e}"), F.col("p_name").alias(f"n{e}"), F.col("p_brand").alias(f"b{e}"), F.col("p_type").alias(f"t{e}"))
    return pairs.join(side(1), "rid1").join(side(2), "rid2").withColumnsRenamed({"rid1": "id1", "rid2": "id2"}).drop("k", "distance", "pos")


def _value_pairs() -> list[tuple[Column, Column]]:
    return [(F.col(f"{c}1"), F.col(f"{c}2")) for c in "nbt"]


@query(f"WITH {PART_PAIRS_SQL} SELECT id1, id2, round(({lev_sql('n1', 'n2')} + {lev_sql('b1', 'b2')} + {lev_sql('t1', 't2')}) / 3, 9) AS sim FROM pairs")
def record_sim_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Levenshtein similarity over three attributes."""
    return part_pairs(spark, sf_dir).select("id1", "id2", rounded(S.record_sim(_value_pairs())).alias("sim"))


@query(f"WITH {PART_PAIRS_SQL} SELECT id1, id2, round({lev_sql('n1', 'n2')} * 0.5 + {lev_sql('b1', 'b2')} * 0.3 + {lev_sql('t1', 't2')} * 0.1, 9) AS sim FROM pairs")
def record_sim_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sum; weights need not add up to one."""
    return part_pairs(spark, sf_dir).select("id1", "id2", rounded(S.record_sim(_value_pairs(), [0.5, 0.3, 0.1])).alias("sim"))


@query("""
SELECT a.n_name AS a, b.n_name AS b, round(1 - levenshtein(lower(a.n_name), lower(b.n_name))::DOUBLE / greatest(length(a.n_name), length(b.n_name)), 9) AS sim
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def lev_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised Levenshtein similarity of nation names within a region."""
    n = read(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_name").alias(x), "n_regionkey", F.col("n_nationkey").alias(f"k{x}")) for x in "ab")
    return a.join(b, "n_regionkey").where("ka < kb").select("a", "b", rounded(S.lev_sim(F.lower("a"), F.lower("b"))).alias("sim"))


GRAMS_SQL = "[substr({v}, i::BIGINT, {q}) FOR i IN range(1, greatest(length({v}) - {q} + 2, 1))]"
PADDED_SQL = "[substr('$$' || {v} || '$$', i::BIGINT, 3) FOR i IN range(1, length({v}) + 3)]"


@query(f"SELECT p_partkey, array_to_string({GRAMS_SQL.format(v='p_name', q=2)}, '|') AS bigrams, array_to_string({PADDED_SQL.format(v='p_name')}, '|') AS padded_trigrams FROM part")
def qgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q-grams of part names, plain and padded."""
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(S.qgrams(F.col("p_name")), "|").alias("bigrams"), F.array_join(S.qgrams(F.col("p_name"), 3, padded=True), "|").alias("padded_trigrams"))


JACCARD_SQL = f"WITH {PART_PAIRS_SQL}, g AS (SELECT id1, id2, {GRAMS_SQL.format(v='n1', q=2)} AS x, {GRAMS_SQL.format(v='n2', q=2)} AS y FROM pairs) "


@query(JACCARD_SQL + "SELECT id1, id2, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 9) AS sim FROM g")
def jaccard_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of bigram sets."""
    return part_pairs(spark, sf_dir).select("id1", "id2", rounded(S.jaccard(2)(F.col("n1"), F.col("n2"))).alias("sim"))


@query(JACCARD_SQL + "SELECT id1, id2, round(list_sum([least(len([1 FOR q IN x IF q = t]), len([1 FOR q IN y IF q = t])) FOR t IN list_distinct(x)])::DOUBLE / (len(x) + len(y)), 9) AS sim FROM g")
def jaccard_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag Jaccard similarity of bigrams."""
    return part_pairs(spark, sf_dir).select("id1", "id2", rounded(S.jaccard(2, bag=True)(F.col("n1"), F.col("n2"))).alias("sim"))


@query(f"WITH {PART_PAIRS_SQL} SELECT id1, id2, round(jaro_winkler_similarity(lower(t1), lower(t2)), 9) AS sim FROM pairs")
def jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaro-Winkler similarity of part types."""
    return part_pairs(spark, sf_dir).select("id1", "id2", rounded(S.jaro_winkler_mean([(F.col("t1"), F.col("t2"))])).alias("sim"))


@query("""
SELECT p_partkey, lower(array_to_string([
  (CASE WHEN length(p_name) > i THEN substr(p_name, i::BIGINT + 1, 1) ELSE '#' END) || (CASE WHEN length(p_brand) > i THEN substr(p_brand, i::BIGINT + 1, 1) ELSE '#' END)
  FOR i IN range(0, 50)], '')) AS key FROM part""")
def interlaced_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interlaced sort key of two attributes, 100 characters."""
    return read(spark, sf_dir, "part").select("p_partkey", O.interlaced_key([F.col("p_name"), F.col("p_brand")]).alias("key"))


@query("SELECT lower(p_name) AS key, p_partkey AS rid FROM part ORDER BY 1, 2 LIMIT 100")
def smallest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 first keys of an order (a bounded top-k is the feature)."""
    return O.smallest(O.keyed(parts(spark, sf_dir), [O.attribute_key(F.col("p_name"))]), 100).select("key", "rid")


# Profiling


def with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left").select("doc_id", "lang", "source", "quality", "toxic")


MISSING = ["doc_id", "lang", "source", "quality", "toxic"]
MISSING_SQL = "WITH j AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) "
MISSING_ROWS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS attribute, count(*) FILTER (WHERE {c} IS NULL OR trim({c}::VARCHAR) = '') AS nulls, round(count(*) FILTER (WHERE {c} IS NULL OR trim({c}::VARCHAR) = '') / count(*)::DOUBLE, 9) AS ratio FROM j" for c in MISSING)


@query(MISSING_SQL + MISSING_ROWS_SQL)
def null_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values of each attribute, counted in one pass."""
    rows = with_labels(spark, sf_dir)
    n = rows.count()
    return spark.createDataFrame([(c, k, round(k / n, 9) if n else None) for c, k in P.null_counts(rows, MISSING).items()], "attribute string, nulls long, ratio double")


@query(MISSING_SQL + f"SELECT attribute FROM ({MISSING_ROWS_SQL}) WHERE NOT ratio >= 0.05")
def missing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes whose share of missing values is below the threshold."""
    rows = with_labels(spark, sf_dir)
    kept = P.below_null_threshold(P.null_counts(rows, MISSING), rows.count(), 0.05)
    return spark.createDataFrame([(c,) for c in MISSING if c in kept], "attribute string")


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _sets(names: list[str], most: int, least: int = 1) -> list[tuple[str, ...]]:
    from itertools import combinations

    return [s for k in range(least, most + 1) for s in combinations(names, k)]


def _cards_sql(table: str, names: list[str], most: int) -> str:
    """cards(cols, n, squares): distinct rows and sum of squared group sizes of each column set, the empty one included."""
    rows = [f"SELECT []::VARCHAR[] AS cols, 1 AS n, (count(*) * count(*))::DOUBLE AS squares FROM {table}"]
    rows += [f"SELECT {sorted(s)} AS cols, count(*) AS n, sum(c * c)::DOUBLE AS squares FROM (SELECT count(*) AS c FROM {table} GROUP BY {', '.join(s)})" for s in _sets(names, most)]
    return "cards AS (" + " UNION ALL ".join(rows) + f"), total AS (SELECT count(*) AS rows FROM {table})"


def _ucc_sql(table: str, names: list[str], most: int) -> str:
    return f"{_cards_sql(table, names, most)}, u AS (SELECT cols FROM cards, total WHERE n = rows AND len(cols) > 0), uccs AS (SELECT cols FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE list_has_all(u.cols, v.cols) AND len(v.cols) < len(u.cols)))"


def _fd_sql(table: str, names: list[str], most: int) -> str:
    attrs = ", ".join(f"('{c}')" for c in names)
    return f"""{_cards_sql(table, names, most + 1)}, attrs(a) AS (VALUES {attrs}),
f AS (SELECT x.cols AS lhs, a AS rhs FROM cards x JOIN attrs ON NOT list_contains(x.cols, a) JOIN cards y ON y.cols = list_sort(list_append(x.cols, a)) WHERE x.n = y.n AND len(x.cols) <= {most}),
fds AS (SELECT lhs, rhs FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.rhs = f.rhs AND list_has_all(f.lhs, g.lhs) AND len(g.lhs) < len(f.lhs)))"""


def _lattice(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> P.Lattice:
    return P.Lattice(read(spark, sf_dir, name), columns)


def _joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


@query(f"WITH {_ucc_sql('customer', CUSTOMER, 1)} SELECT cols[1] AS attribute FROM uccs")
def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unary keys."""
    return spark.createDataFrame([(c,) for c in P.keys(_lattice(spark, sf_dir, "customer", CUSTOMER))], "attribute string")


@query(f"WITH {_ucc_sql('customer', CUSTOMER, 3)} SELECT array_to_string(cols, ',') AS cols FROM uccs")
def ucc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal unique column combinations of up to three columns."""
    return P.ucc_table(spark, P.uccs(_lattice(spark, sf_dir, "customer", CUSTOMER), 3)).select(_joined("cols"))


@query(f"WITH {_fd_sql('orders', ORDERS, 2)} SELECT array_to_string(lhs, ',') AS lhs, rhs FROM fds")
def fds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal functional dependencies with up to two determining columns."""
    return P.fd_table(spark, P.fds(_lattice(spark, sf_dir, "orders", ORDERS), 2)).select(_joined("lhs"), "rhs")


@query(f"WITH {_fd_sql('nation', ['n_nationkey', 'n_name', 'n_regionkey'], 2)} SELECT array_to_string(lhs, ',') AS lhs, rhs FROM fds")
def fds_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal functional dependencies of a small relation."""
    return P.fd_table(spark, P.fds(_lattice(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"]), 2)).select(_joined("lhs"), "rhs")


@query(f"""WITH {_cards_sql('customer', CUSTOMER, 2)},
u AS (SELECT cols FROM cards, total WHERE len(cols) > 0 AND squares - rows <= 0.05 * rows * (rows - 1))
SELECT array_to_string(cols, ',') AS cols FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE list_has_all(u.cols, v.cols) AND len(v.cols) < len(u.cols))""")
def approximate_ucc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate unique column combinations: at most 5 % of row pairs agree."""
    return P.ucc_table(spark, P.uccs(_lattice(spark, sf_dir, "customer", CUSTOMER), 2, error=0.05)).select(_joined("cols"))


@query(f"""WITH {_cards_sql('orders', ORDERS, 3)}, attrs(a) AS (VALUES {', '.join(f"('{c}')" for c in ORDERS)}),
f AS (SELECT x.cols AS lhs, a AS rhs FROM cards x JOIN attrs ON NOT list_contains(x.cols, a) JOIN cards y ON y.cols = list_sort(list_append(x.cols, a)), total
      WHERE len(x.cols) <= 2 AND x.squares - y.squares <= 0.01 * (rows * rows - rows))
SELECT array_to_string(lhs, ',') AS lhs, rhs FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.rhs = f.rhs AND list_has_all(f.lhs, g.lhs) AND len(g.lhs) < len(f.lhs))""")
def approximate_fds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate functional dependencies: g1 error of at most 1 %."""
    return P.fd_table(spark, P.fds(_lattice(spark, sf_dir, "orders", ORDERS), 2, error=0.01)).select(_joined("lhs"), "rhs")


@query(f"""WITH {_fd_sql('orders', ORDERS, 2)}, p AS (SELECT cols[1] AS a, squares / (rows::DOUBLE * rows) AS pdep FROM cards, total WHERE len(cols) = 1)
SELECT array_to_string(lhs, ',') AS lhs, rhs, round(pdep, 9) AS pdep, round(pdep + (c.n - 1) / (rows - 1)::DOUBLE * (1 - pdep), 9) AS epdep,
       round(1 - (pdep + (c.n - 1) / (rows - 1)::DOUBLE * (1 - pdep)), 9) AS gpdep
FROM fds JOIN p ON p.a = rhs JOIN cards c ON c.cols = lhs, total""")
def gpdep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genuineness of each functional dependency."""
    lattice = _lattice(spark, sf_dir, "orders", ORDERS)
    rows = [(",".join(sorted(f.lhs)), f.rhs, round(P.pdep(lattice, f.rhs), 9), round(P.epdep(lattice, f), 9), round(P.gpdep(lattice, f), 9)) for f in P.fds(lattice, 2)]
    return spark.createDataFrame(rows, "lhs string, rhs string, pdep double, epdep double, gpdep double")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def frequency_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of one column's values."""
    return P.frequencies(read(spark, sf_dir, "orders"), ["o_orderpriority"]).withColumnRenamed("o_orderpriority", "value")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def frequency_map_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of a column set's values, kept apart."""
    return P.frequencies(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def _ind_sql(names: list[str], table: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS c, {i} AS i, {c}::VARCHAR AS v FROM {table}" for i, c in enumerate(names))
    return f"""v AS (SELECT DISTINCT c, i, v FROM ({rows}) WHERE v IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM v GROUP BY 1),
inds AS (SELECT a.c AS dep, b.c AS ref, a.i AS di, b.i AS ri FROM v a JOIN v b ON a.v = b.v AND a.c <> b.c JOIN n ON n.c = a.c GROUP BY a.c, b.c, a.i, b.i, n.n HAVING count(*) = n.n)"""


LABELS = ["doc_id", "quality", "toxic"]
LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


@query(f"WITH {_ind_sql(LABELS, 'labels')} SELECT dep, ref FROM inds")
def inds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unary inclusion dependencies, mirrored ones included."""
    return P.ind_table(spark, P.inds(read(spark, sf_dir, "labels"), LABELS))


@query(f"WITH {_ind_sql(LINE_KEYS, 'lineitem')} SELECT dep, ref FROM inds")
def inds_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unary inclusion dependencies of a larger relation."""
    return P.ind_table(spark, P.inds(read(spark, sf_dir, "lineitem"), LINE_KEYS))


@query(f"WITH {_ind_sql(LABELS, 'labels')} SELECT dep, ref FROM inds a WHERE di < ri OR NOT EXISTS (SELECT 1 FROM inds b WHERE b.dep = a.ref AND b.ref = a.dep)")
def ind_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion dependencies without the mirrored ones."""
    return P.ind_table(spark, P.without_mirrors(P.inds(read(spark, sf_dir, "labels"), LABELS), LABELS))


SIND_COLUMNS = ["p_name", "p_alias", "p_brand"]


@query(f"""WITH r AS (SELECT p_name, p_name || 's' AS p_alias, p_brand FROM part),
v AS (SELECT DISTINCT c, v FROM ({' UNION ALL '.join(f"SELECT '{c}' AS c, {c} AS v FROM r" for c in SIND_COLUMNS)})),
n AS (SELECT c, count(*) AS n FROM v GROUP BY 1)
SELECT a.c AS dep, b.c AS ref FROM v a JOIN v b ON a.c <> b.c AND 1 - levenshtein(a.v, b.v)::DOUBLE / greatest(length(a.v), length(b.v)) >= 0.75 - 1e-12
JOIN n ON n.c = a.c GROUP BY a.c, b.c, n.n HAVING count(DISTINCT a.v) = n.n""")
def sinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity inclusion dependencies between names, names with an ending, and brands."""
    rows = read(spark, sf_dir, "part").select("p_name", F.concat("p_name", F.lit("s")).alias("p_alias"), "p_brand")
    return P.ind_table(spark, P.sinds(rows, SIND_COLUMNS))


WEIGHTS_SQL = f"""{_fd_sql('orders', ORDERS, 2)}, u AS (SELECT cols FROM cards, total WHERE n = rows AND len(cols) BETWEEN 1 AND 2),
uccs AS (SELECT cols FROM u WHERE len(cols) > 1 AND NOT EXISTS (SELECT 1 FROM u v WHERE list_has_all(u.cols, v.cols) AND len(v.cols) < len(u.cols))),
n AS (SELECT attribute, count(*) AS n FROM (SELECT unnest(lhs) AS attribute FROM fds UNION ALL SELECT unnest(cols) FROM uccs) GROUP BY 1),
names(index, attribute) AS (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(ORDERS))})"""


@query(f"WITH {WEIGHTS_SQL} SELECT index, attribute, round(coalesce(n / (SELECT sum(n) FROM n)::DOUBLE, 0), 9) AS weight FROM names LEFT JOIN n USING (attribute)")
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute weights from FD determinants and multi-column UCCs, without filters."""
    lattice = _lattice(spark, sf_dir, "orders", ORDERS)
    found = [s for s in P.uccs(lattice, 2) if len(s) > 1]
    table = W.weight_table(P.fd_table(spark, P.fds(lattice, 2)), P.ucc_table(spark, found), ORDERS)
    return table.select("index", "attribute", rounded(F.col("weight")).alias("weight"))


@query(f"""WITH {WEIGHTS_SQL.replace("names(index", f"keyed AS (SELECT cols[1] AS attribute FROM cards, total WHERE n = rows AND len(cols) = 1), kept AS (SELECT * FROM n WHERE attribute NOT IN (SELECT attribute FROM keyed)), names(index")}
SELECT index, attribute, round(coalesce(kept.n / (SELECT sum(n) FROM kept)::DOUBLE, 0), 9) AS weight FROM names JOIN kept USING (attribute)""")
def selected_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and FD filters, then weights."""
    cfg = DetectConfig(filter_missing=False, filter_ind=False, max_fd_determinant=2, max_ucc_determinant=2)
    lattice = _lattice(spark, sf_dir, "orders", ORDERS)
    meta = W.Metadata(ORDERS, lattice.rows, {}, P.keys(lattice), [s for s in P.uccs(lattice, 2) if len(s) > 1], P.fds(lattice, 2), [], [])
    return spark.createDataFrame([(a.index, a.attribute, round(a.weight, 9)) for a in W.select_attributes(meta, cfg)], "index int, attribute string, weight double")


@query(f"WITH {_fd_sql('orders', ORDERS, 2)} SELECT rhs AS attribute, count(*) AS n FROM fds GROUP BY 1")
def dependent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each attribute is determined by others."""
    return W.dependents(P.fd_table(spark, P.fds(_lattice(spark, sf_dir, "orders", ORDERS), 2)))


# Evaluation


def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the first one of the same folded text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.xxhash64(ascii_text("text")).alias("h"), F.length(ascii_text("text")).alias("n"))
    firsts = docs.groupBy("h", "n").agg(F.min("doc_id").alias("id1"))
    return docs.join(firsts, ["h", "n"]).where("id1 < doc_id").select("id1", F.col("doc_id").alias("id2"))


GOLD_SQL = "gold AS (SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY t) AS id1, doc_id AS id2 FROM docs) WHERE id1 < id2)"
FOUND_SQL = f"{PSNM_PAIRS_SQL}, found AS (SELECT least(d1, d2) AS id1, greatest(d1, d2) AS id2, sim, ((d - 1) * n - d * (d - 1) // 2 + p + 1)::BIGINT AS rank FROM (SELECT *, {SIM_OF_TEXTS} AS sim FROM p), n WHERE NOT isnan(sim) AND sim >= 0.65), {GOLD_SQL}, hits AS (SELECT f.* FROM found f JOIN gold g USING (id1, id2))"
CONFUSION_SQL = "(SELECT count(*) FROM hits) AS tp, (SELECT count(*) FROM found) - (SELECT count(*) FROM hits) AS fp, (SELECT count(*) FROM gold) - (SELECT count(*) FROM hits) AS fn"


@query(f"WITH {FOUND_SQL} SELECT {CONFUSION_SQL}")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True positives, false positives, false negatives of a run against equal texts."""
    return E.confusion(psnm_run(spark, sf_dir), gold_pairs(spark, sf_dir))


@query(f"WITH {FOUND_SQL}, c AS (SELECT {CONFUSION_SQL}) SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / (tp + fn)::DOUBLE, 9) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1 FROM c")
def prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1."""
    row = E.metrics(psnm_run(spark, sf_dir), gold_pairs(spark, sf_dir))
    return row.select("tp", "fp", "fn", *(rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {FOUND_SQL} SELECT id1, id2 FROM gold EXCEPT SELECT id1, id2 FROM found")
def false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.false_negatives(psnm_run(spark, sf_dir), gold_pairs(spark, sf_dir))


@query(f"WITH {FOUND_SQL} SELECT id1, id2 FROM found EXCEPT SELECT id1, id2 FROM gold")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.false_positives(psnm_run(spark, sf_dir), gold_pairs(spark, sf_dir))


@query(f"WITH {FOUND_SQL} SELECT id1, id2 FROM found INTERSECT SELECT id1, id2 FROM gold")
def true_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.true_positives(psnm_run(spark, sf_dir), gold_pairs(spark, sf_dir))


@query("SELECT g.doc_id AS id1, g.other AS id2 FROM (SELECT doc_id, doc_id + 1 AS other FROM labels) g WHERE g.other IN (SELECT doc_id FROM labels)")
def gold_within_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold pairs of which both ids occur in the data."""
    labels = read(spark, sf_dir, "labels")
    gold = labels.select(F.col("doc_id").alias("id1"), (F.col("doc_id") + 1).alias("id2"))
    return D.gold_within(gold, labels.select(F.col("doc_id").alias("id")))


INTERVAL = 500
CURVE_SQL = f"""{FOUND_SQL}, slots AS (SELECT unnest(range(1, (SELECT max(greatest(ceil(rank / {INTERVAL}.0), 1)) FROM hits)::BIGINT)) AS k),
curve AS (SELECT k * {INTERVAL} AS t, (SELECT count(*) FROM hits WHERE rank <= k * {INTERVAL}) AS cum_tp FROM slots)"""


@query(f"WITH {CURVE_SQL} SELECT t, cum_tp FROM curve")
def progress_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True positives found after every 500 comparisons."""
    return E.progress_curve(psnm_run(spark, sf_dir), gold_pairs(spark, sf_dir), INTERVAL)


@query(f"""WITH {CURVE_SQL}, kept AS (SELECT * FROM curve WHERE t <= 10000),
steps AS (SELECT (t - lag(t, 1, 0) OVER (ORDER BY t)) * lag(cum_tp, 1, 0) OVER (ORDER BY t) AS a FROM kept)
SELECT round((coalesce((SELECT sum(a) FROM steps), 0) + (10000 - coalesce((SELECT max(t) FROM kept), 0)) * coalesce((SELECT max_by(cum_tp, t) FROM kept), 0)) / ((SELECT count(*) FROM gold) * 10000.0::DOUBLE), 9) AS quality""")
def integral_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progressive quality up to 10,000 comparisons."""
    gold = gold_pairs(spark, sf_dir)
    curve = E.progress_curve(psnm_run(spark, sf_dir), gold, INTERVAL)
    return E.integral_quality(curve, gold.count(), 10_000).select(rounded(F.col("quality")).alias("quality"))


THRESHOLDS = (0.5, 0.65, 0.8, 0.95)


@query(f"""WITH {PSNM_PAIRS_SQL}, {GOLD_SQL}, s AS (SELECT least(d1, d2) AS id1, greatest(d1, d2) AS id2, {SIM_OF_TEXTS} AS sim FROM p),
r AS (SELECT threshold, count(*) FILTER (WHERE g.id1 IS NOT NULL) AS tp, count(*) FILTER (WHERE g.id1 IS NULL) AS fp
      FROM (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) v(threshold) JOIN s ON NOT isnan(sim) AND sim >= threshold LEFT JOIN gold g USING (id1, id2) GROUP BY 1)
SELECT threshold, tp, fp, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / (SELECT count(*) FROM gold)::DOUBLE, 9) AS recall FROM r""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall at several thresholds from one scoring pass."""
    relation = documents(spark, sf_dir)
    done = X.run(relation, PLAIN.but(similarity_threshold=min(THRESHOLDS)), id_col="doc_id", chosen=ON_TEXT)
    scored = ordered_ids(X.named_pairs(relation, done.scored, "doc_id"))
    out = E.threshold_sweep(scored, gold_pairs(spark, sf_dir), THRESHOLDS)
    return out.select("threshold", "tp", "fp", rounded(F.col("precision")).alias("precision"), rounded(F.col("recall")).alias("recall"))


# Reading and projecting


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_type, '' AS _c9 FROM part")
def positional_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by place; beyond the last one an empty string."""
    return D.project(parts(spark, sf_dir), [0, 3, 9]).drop("_rid")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50) ON l_partkey = p_partkey")
def record_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of given ids."""
    wanted = read(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").cast("long").alias("_rid"))
    return D.lookup(parts(spark, sf_dir), wanted).select("p_partkey", "p_name")


@query("SELECT count(*) AS n_rows, 4 AS n_attributes FROM part")
def relation_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and attributes of a relation."""
    relation = parts(spark, sf_dir)
    return relation.agg(F.count("*").alias("n_rows")).withColumn("n_attributes", F.lit(len(D.attributes(relation))))


@query("SELECT DISTINCT c_mktsegment AS id FROM customer")
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ids(D.as_relation(read(spark, sf_dir, "customer"), ["c_custkey"]), "c_mktsegment")


@query("SELECT trim(c_name) AS c_name, trim(c_mktsegment) AS c_mktsegment FROM customer")
def trimmed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.columns_trimmed(D.as_relation(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"])).select("c_name", "c_mktsegment")


@query()
def profiled_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over customers: profile, choose and weigh attributes, pair, score, keep (no SQL: the profile decides the plan)."""
    relation = D.as_relation(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), ["c_custkey"])
    cfg = DetectConfig(filter_pk=False, filter_ind=False, filter_fd=False, max_fd_determinant=2, max_ucc_determinant=2, similarity_threshold=0.9)
    return ordered_ids(X.detect(relation, cfg, id_col="c_custkey", absent=True))


# Filters, single keys, orders and files of which no query above makes use


@query(f"""WITH {_fd_sql('orders', ORDERS, 2)}, p AS (SELECT cols[1] AS a, squares / (rows::DOUBLE * rows) AS pdep FROM cards, total WHERE len(cols) = 1),
g AS (SELECT array_to_string(lhs, ',') AS lhs, rhs, 1 - (pdep + (c.n - 1) / (rows - 1)::DOUBLE * (1 - pdep)) AS gpdep FROM fds JOIN p ON p.a = rhs JOIN cards c ON c.cols = lhs, total)
SELECT lhs, rhs FROM g WHERE gpdep >= 0.00001""")
def genuine_fds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functional dependencies that are genuine enough."""
    lattice = _lattice(spark, sf_dir, "orders", ORDERS)
    return P.fd_table(spark, P.by_gpdep(lattice, P.fds(lattice, 2), 0.00001)).select(_joined("lhs"), "rhs")


IND_ONLY = DetectConfig(filter_missing=False, filter_ind=True, filter_pk=False, filter_fd=False, use_fd=False, use_ucc=False, use_weights=False, sind_threshold=0.75)


@query(f"""WITH {_ind_sql(SIND_COLUMNS, 'r').replace('v AS (', 'r AS (SELECT p_name, p_name || chr(115) AS p_alias, p_brand FROM part), v AS (', 1)},
s AS (SELECT a.c AS dep FROM v a JOIN v b ON a.c <> b.c AND 1 - levenshtein(a.v, b.v)::DOUBLE / greatest(length(a.v), length(b.v)) >= 0.75 - 1e-12 JOIN n ON n.c = a.c GROUP BY a.c, b.c, n.n HAVING count(DISTINCT a.v) = n.n),
d AS (SELECT dep FROM inds a WHERE di < ri OR NOT EXISTS (SELECT 1 FROM inds b WHERE b.dep = a.ref AND b.ref = a.dep) UNION SELECT dep FROM s),
names(index, attribute) AS (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(SIND_COLUMNS))})
SELECT index, attribute FROM names WHERE attribute NOT IN (SELECT dep FROM d)""")
def attributes_without_inds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter of dependent attributes, by similarity and exact inclusion dependencies together."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat("p_name", F.lit("s")).alias("p_alias"), "p_brand")
    chosen = W.attribute_weights(D.as_relation(rows, ["p_partkey"], SIND_COLUMNS), IND_ONLY)
    return spark.createDataFrame([(a.index, a.attribute) for a in chosen], "index int, attribute string")


ON_NAME = [AttributeWeight(1, "p_name", 1.0)]
NAME_SQL = f"""n AS (SELECT p_partkey AS id, regexp_replace(coalesce(p_name, ''), '[^\\x00-\\x7F]', '?', 'g') AS t FROM part),
o AS (SELECT id, t, row_number() OVER (ORDER BY lower(t), id) - 1 AS pos FROM n)"""


def _single_key(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", ascii_text("p_name").alias("p_name"))
    found = X.single_key(D.as_relation(rows, ["p_partkey"]), PLAIN.but(algorithm=algorithm), ["p_name"], id_col="p_partkey", chosen=ON_NAME, concurrent=algorithm == "PB")
    return ordered_ids(found).select("id1", "id2", rounded(F.col("sim")).alias("sim"))


@query(f"WITH {NAME_SQL}, p AS (SELECT least(a.id, b.id) AS id1, greatest(a.id, b.id) AS id2, {lev_sql('a.t', 'b.t')} AS sim FROM o a JOIN o b ON b.pos BETWEEN a.pos + 1 AND a.pos + 19) SELECT id1, id2, round(sim, 9) AS sim FROM p WHERE NOT isnan(sim) AND sim >= 0.65")
def psnm_single_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted neighbourhood over a named attribute's key."""
    return _single_key(spark, sf_dir, "PSNM")


@query(f"WITH {NAME_SQL}, p AS (SELECT least(a.id, b.id) AS id1, greatest(a.id, b.id) AS id2, {lev_sql('a.t', 'b.t')} AS sim FROM o a JOIN o b ON a.pos < b.pos AND b.pos // 4 - a.pos // 4 <= 4) SELECT id1, id2, round(sim, 9) AS sim FROM p WHERE NOT isnan(sim) AND sim >= 0.65")
def pb_single_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progressive blocking over a named attribute's key, in the concurrent order."""
    return _single_key(spark, sf_dir, "PB")


def _block_rank_sql(rank: str) -> str:
    return f"""WITH {PART_ORDER_SQL}, c AS (SELECT (count(*) + 3) // 4 AS blocks FROM part),
p AS (SELECT a.k, a.rid AS r1, b.rid AS r2, b.pos // 4 - a.pos // 4 AS d, (a.pos // 4) * 16 + (a.pos % 4) * 4 + 1 AS inside FROM o a JOIN o b ON a.k = b.k AND b.pos > a.pos AND b.pos // 4 - a.pos // 4 <= 4)
SELECT least(r1, r2) AS rid1, greatest(r1, r2) AS rid2, min({rank})::BIGINT AS rank FROM p, c GROUP BY 1, 2"""


@query(_block_rank_sql("k * 5 * blocks * 16 + d * blocks * 16 + inside"))
def pb_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block pairs of three keys with their place in the order key by key, nearest blocks first."""
    return X.candidate_pairs(parts(spark, sf_dir), [O.attribute_key(F.col(c)) for c in PART_KEYS], PLAIN.but(algorithm="PB"))


@query(_block_rank_sql("d * blocks * 16 * 3 + k * blocks * 16 + inside"))
def pb_concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs in the attribute-concurrent order."""
    return X.candidate_pairs(parts(spark, sf_dir), [O.attribute_key(F.col(c)) for c in PART_KEYS], PLAIN.but(algorithm="PB"), concurrent=True)


@query(f"""WITH {CUSTOMER_ORDER_SQL}, f AS (SELECT least(a.rid, b.rid) AS id1, greatest(a.rid, b.rid) AS id2 FROM o a JOIN o b ON b.pos = a.pos + 7)
SELECT c_custkey - 1 AS id1, c_custkey AS id2 FROM customer WHERE c_custkey - 1 IN (SELECT c_custkey FROM customer) EXCEPT SELECT id1, id2 FROM f""")
def missed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold pairs (neighbouring ids) that pairs of one distance miss."""
    found = C.distance_pairs(_customers(spark, sf_dir), 7).select(F.col("rid1").alias("id1"), F.col("rid2").alias("id2"))
    ids = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    gold = ids.select((F.col("id") - 1).alias("id1"), F.col("id").alias("id2"))
    return E.false_negatives(ordered_ids(found), D.gold_within(gold, ids)).select("id1", "id2")


@query(f"""WITH {CUSTOMER_ORDER_SQL}, f AS (SELECT a.pos // 50 AS first, b.pos // 50 AS second, count(*) AS duplicates FROM o a JOIN o b ON b.pos = a.pos + 7 WHERE a.rid % 3 = b.rid % 3 GROUP BY 1, 2)
SELECT first, second, duplicates, row_number() OVER (ORDER BY duplicates DESC, second - first, first) AS place FROM f ORDER BY place LIMIT 10""")
def promising_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most promising pairs of blocks: most duplicates, then the nearest."""
    placed = _customers(spark, sf_dir)
    at = placed.select(F.col("rid").alias("rid2"), F.expr("pos div 50").alias("second"))
    pairs = C.distance_pairs(placed, 7).where("rid1 % 3 = rid2 % 3").join(at, "rid2").withColumn("first", F.expr("pos div 50"))
    best = O.block_pair_order(pairs.groupBy("first", "second").agg(F.count("*").alias("duplicates"))).limit(10).collect()
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(best)], "first long, second long, duplicates long, place long")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type FROM part")
def delimited_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation written as delimited text and read again."""
    path = f"{own_dir(spark)}/delimited-{uuid.uuid4().hex}"
    K.write_relation(parts(spark, sf_dir), path)
    return D.read_relation(spark, path).select("p_partkey", "p_name", "p_brand", "p_type")


HALF = ["c_name", "c_mktsegment", "c_half"]
NULLS_ONLY = IND_ONLY.but(filter_missing=True, filter_ind=False, null_threshold=0.25, similarity_threshold=0.9)
_half_sim = lambda c: lev_sql(f"x.{c}", f"y.{c}")
_half_w = lambda c: f"(SELECT count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE < 0.25 FROM h)"


@query(f"""WITH h AS (SELECT c_custkey AS id, c_name, c_mktsegment, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS c_half FROM customer),
w AS (SELECT {', '.join(f"{_half_w(c)} AS w_{c}" for c in HALF)}),
o AS ({' UNION ALL '.join(f"SELECT {i} AS k, id, row_number() OVER (ORDER BY lower({c}), id) - 1 AS pos FROM h, w WHERE w_{c}" for i, c in enumerate(HALF))}),
p AS (SELECT DISTINCT least(a.id, b.id) AS id1, greatest(a.id, b.id) AS id2 FROM o a JOIN o b ON a.k = b.k AND b.pos BETWEEN a.pos + 1 AND a.pos + 19),
s AS (SELECT id1, id2, ({' + '.join(f"CASE WHEN w_{c} THEN {_half_sim(c)} ELSE 0 END" for c in HALF)}) / ({' + '.join(f"w_{c}::INT" for c in HALF)}) AS sim
      FROM p JOIN h x ON x.id = id1 JOIN h y ON y.id = id2, w)
SELECT id1, id2, round(sim, 9) AS sim FROM s WHERE NOT isnan(sim) AND sim >= 0.9 - 1e-12""")
def profiled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profiled run: the attributes with few missing values are the keys and what is compared; SQL works them out, too."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 1, F.col("c_name")).alias("c_half"))
    relation = D.as_relation(rows, ["c_custkey"], HALF)
    found = X.run(relation, NULLS_ONLY, chosen=W.attribute_weights(relation, NULLS_ONLY, absent=True))
    return found.scored.where("not isnan(sim) and sim >= 0.9 - 1e-12").select(F.col("rid1").alias("id1"), F.col("rid2").alias("id2"), rounded(F.col("sim")).alias("sim"))
