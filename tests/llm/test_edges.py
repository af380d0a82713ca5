"""Every operator and stage on edge cases and on empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinsieve.llm import bpe, fingerprints, jaccard, lines, mixing, quality, secrets, topk, urls

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda spark, docs: quality.score(docs, quality.fit(docs, labels_of(spark, [(4, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, 0), (7, 1, 0), (7, 0, 0)]))),
    "jaccard": lambda spark, docs: jaccard.join(docs),
    "fingerprints": lambda spark, docs: fingerprints.compared(docs),
    "lines": lambda spark, docs: lines.dedup(docs),
    "mixing": lambda spark, docs: mixing.mix(docs),
    "secrets": lambda spark, docs: secrets.scan(docs),
    "bpe": lambda spark, docs: bpe.encode(docs, VOCABULARY, P.PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_keeps_every_row(spark, make, edge_rows, name):
    assert OPERATORS[name](spark, make(edge_rows)).count() == len(edge_rows)
    assert OPERATORS[name](spark, make([])).count() == 0
    assert OPERATORS[name](spark, make([(1, None)])).count() == 1


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_on_edges(spark, make, edge_rows, tmp_path, stage):
    labels_of(spark, [(4, 1, 0), (5, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = make(edge_rows)
    out = run(spark, docs, str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert out.count() > 0
    empty = run(spark, make([]), str(tmp_path))
    assert empty.count() == 0


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "no scheme", "x"), (None, "http://a.com/", "x"), (3, "http://a.com/", "x"), (4, "http://" + "a." * 3000 + "com/" + "x" * 9000, "x")], "page_id long, url string, host string")
    out = urls.judge(pages).collect()
    assert len(out) == 6 and all(r.verdict in ("allow", "block") for r in out)
    assert [(r.host, r.path, r.rule) for r in out if r.page_id == 1] == [("", "", None)]
    assert urls.judge(pages.limit(0)).count() == 0
    vectors = spark.createDataFrame([(20, [1.0, 2.0], 0), (1, None, 0), (2, [None, 1.0], 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (5, [1.0, 1.0], 0), (5, [1.0, 1.0], 0), (6, [1.0], 0)], "vec_id long, embedding array<float>, rank int")
    out = topk.search(topk.integer_vectors(vectors), F.col("vec_id") % 20 == 0, 20).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"])] == [(20, 1, 5, 64 * 64 * 3), (20, 2, 5, 64 * 64 * 3), (20, 3, 6, 64 * 64)]
    assert topk.search(topk.integer_vectors(vectors.limit(0)), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_fingerprints_of_very_long_repeated_rows(spark):
    long = " ".join(["same"] * 500_000)
    docs = spark.createDataFrame([(1, long)] * 20 + [(0, "short")], "doc_id long, text string").repartition(4)
    out = fingerprints.compared(docs).collect()
    assert len(out) == 21 and len({str(r.fingerprint) for r in out}) == 2 and {sum(r.fingerprint.counts) for r in out} == {500_000, 1}


def test_fingerprint_lanes_wrap_apart(spark):
    n = 1_100_000
    rows = spark.createDataFrame([("a", " ".join(["w"] * n)), ("b", "x y z"), ("ab", " ".join(["w"] * n) + "\nx y z")], "k string, t string")
    f = {r.k: r.fingerprint for r in fingerprints.fingerprints(rows, "t", ["k"]).collect()}
    whole = (1 << fingerprints.LANE_BITS)
    assert sorted(c for c in f["a"].counts if c)[-1] == (n - 2) % whole or n % whole in f["a"].counts
    assert [(x + y) % whole for x, y in zip(f["a"].counts, f["b"].counts)] == list(f["ab"].counts)
    back = fingerprints.fingerprints(rows, "t", ["k"]).groupBy().pivot("k").agg(F.first("fingerprint"))
    assert back.select((fingerprints.delete(fingerprints.insert(F.col("b"), F.col("a")), F.col("a")) == F.col("b")).alias("x"), (fingerprints.delete(F.col("ab"), F.col("b")) == F.col("a")).alias("y")).first() == (True, True)


def test_vectors_of_one_id_all_take_part(spark):
    vectors = spark.createDataFrame([(20, [1.0, 1.0]), (20, [2.0, 0.0]), (5, [1.0, 1.0]), (5, [3.0, 3.0]), (6, [0.0, 1.0])], "vec_id long, embedding array<float>")
    out = topk.search(topk.integer_vectors(vectors), F.col("vec_id") % 20 == 0, 20).collect()
    k = 64 * 64
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score // k) for r in out) == [(20, 1, 5, 6), (20, 1, 5, 6), (20, 2, 5, 2), (20, 2, 5, 2), (20, 3, 6, 0), (20, 3, 6, 1)]


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))


def test_what_stages_make_of_edges(spark, make, edge_rows, tmp_path):
    stages, docs = dict(corpus_pipeline.STAGES), make(edge_rows)
    every = ids(docs.collect())
    labels_of(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    assert ids(stages["quality_classifier"](spark, docs, str(tmp_path)).collect()) == every
    cut = stages["line_dedup"](spark, docs, "").collect()
    assert ids(cut) == [i for i in every if i != 6] and {r.doc_id: r.text for r in cut if r.doc_id in (1, 2)} == {1: None, 2: ""}
    assert ids(stages["jaccard_join"](spark, docs, "").collect()) == [None, None, -5, 1, 3, 4, 5, 7, 7, 9, 10]
    mixed = stages["source_mixing"](spark, docs, "").collect()
    assert all((r.text or "").split() for r in mixed) and {5, 6} <= {r.doc_id for r in mixed}
    assert max(Counter((r.doc_id, r.text) for r in mixed).values()) <= 6  # three times a row; one comes twice
    ended = stages["byte_level_bpe"](spark, docs, "").collect()
    assert ids(ended) == every and {r.n_tokens for r in ended if r.doc_id in (1, 2)} == {0}
