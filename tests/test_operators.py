"""Operators against brute force and on edge cases."""

import math
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinsieve.config import DetectConfig
from twinsieve.functions import similarity as S
from twinsieve.operators import candidates as C
from twinsieve.operators import evaluate as E
from twinsieve.operators import ordering as O
from twinsieve.operators import profile as P
from twinsieve.operators.weights import AttributeWeight
from twinsieve.plans import detect as X
from twinsieve.sources import delimited as D
from twinsieve.sources import sinks

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def placed(spark, n, k=0):
    return spark.range(n).select(F.lit(k).alias("k"), F.col("id").alias("rid"), F.col("id").alias("pos"))


@QUIET
@given(n=st.integers(0, 60), window=st.integers(1, 12))
def test_band_is_exact(spark, n, window):
    got = {(r.rid1, r.rid2) for r in C.band_pairs(placed(spark, n), window).collect()}
    assert got == {(a, b) for a, b in combinations(range(n), 2) if b - a <= window - 1}


@QUIET
@given(n=st.integers(0, 60), size=st.integers(1, 5), reach=st.integers(0, 5))
def test_blocks_are_exact(spark, n, size, reach):
    rows = [(r.rid1, r.rid2) for r in C.block_pairs(placed(spark, n), size, reach).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(a, b) for a, b in combinations(range(n), 2) if b // size - a // size <= reach}


def test_window_ranks_are_the_order_of_comparisons(spark):
    n, w = 17, 5
    both = placed(spark, n).unionByName(placed(spark, n, 1))
    for concurrent in (False, True):
        ranks = C.band_pairs(both, w).withColumn("rank", C.window_rank(n, 2, w, concurrent)).collect()
        order = sorted(ranks, key=lambda r: (r.distance, r.k, r.pos) if concurrent else (r.k, r.distance, r.pos))
        assert [r["rank"] for r in order] == list(range(1, len(order) + 1))


def test_positions_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "A", None, "a", "", "B", "a"] * 30)], "_rid long, v string")
    got = {r.rid: r.pos for r in O.positions(O.keyed(rows, [O.attribute_key(F.col("v"))])).collect()}
    expected = sorted(range(210), key=lambda i: ((["b", "A", None, "a", "", "B", "a"] * 30)[i] or "").lower().encode() + b"\0" + i.to_bytes(4, "big"))
    assert [got[i] for i in expected] == list(range(210))


@pytest.mark.parametrize("a, b, expected", [("", "", math.nan), ("", "ab", 0.0), ("kitten", "sitting", 1 - 3 / 7), ("a" * 300, "a" * 200 + "b" * 100, 1.0), ("é", "e", 0.0)])
def test_levenshtein(spark, a, b, expected):
    got = one(spark, S.lev_sim(F.lit(a), F.lit(b)))
    assert math.isnan(got) if math.isnan(expected) else got == pytest.approx(expected)


def test_nan_is_never_similar(spark):
    assert not one(spark, S.at_least(F.lit(float("nan")), 0.5))


def test_record_similarity_of_absent_attributes(spark):
    rows = spark.createDataFrame([("x", None, None, None)], "a string, b string, c string, d string")
    pairs = [(F.col("a"), F.col("a")), (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))]
    assert rows.select(S.record_sim(pairs).alias("s")).first()["s"] == pytest.approx(0.5)
    assert rows.select(S.record_sim(pairs, [0.5, 0.25, 0.25]).alias("s")).first()["s"] == pytest.approx(0.5)
    assert math.isnan(rows.select(S.record_sim([(F.col("c"), F.col("d"))]).alias("s")).first()["s"])


def test_qgrams_and_jaccard(spark):
    assert one(spark, S.qgrams(F.lit("abcab"))) == ["ab", "bc", "ca", "ab"]
    assert one(spark, S.qgrams(F.lit("a"), 2)) == []
    assert one(spark, S.qgrams(F.lit("a"), 2, padded=True)) == ["$a", "a$"]
    assert one(spark, S.jaccard(2)(F.lit("abab"), F.lit("abc"))) == pytest.approx(1 / 3)
    assert one(spark, S.jaccard(2, bag=True)(F.lit("abab"), F.lit("abab"))) == pytest.approx(0.5)
    assert math.isnan(one(spark, S.jaccard(2)(F.lit(None).cast("string"), F.lit(""))))


def test_jaro_winkler(spark):
    rows = spark.createDataFrame([("martha", "marhta"), ("dixon", "dicksonx"), ("", "a"), (None, "a"), ("abc", "xyz")], "a string, b string")
    got = [r[0] for r in rows.select(S.jaro_winkler("a", "b")).collect()]
    assert got[:3] == pytest.approx([0.9611111, 0.8133333, 0.0]) and got[3] is None and got[4] == 0


def test_interlaced_key(spark):
    assert one(spark, O.interlaced_key([F.lit("Abc"), F.lit("xY")], 9)) == "axbyc###"


def brute_cards(rows, columns):
    return {frozenset(s): len({tuple(r[columns.index(c)] for c in sorted(s)) for r in rows}) for k in range(len(columns) + 1) for s in combinations(columns, k)}


@QUIET
@given(rows=st.lists(st.tuples(*[st.sampled_from([None, "a", "b", "c"])] * 4), min_size=1, max_size=9))
def test_lattice_against_brute_force(spark, rows):
    columns = list("wxyz")
    cards = brute_cards(rows, columns)
    df = spark.createDataFrame(rows, "w string, x string, y string, z string")
    lattice = P.Lattice(df)
    unique = [s for s in cards if s and cards[s] == len(rows)]
    assert set(P.uccs(lattice, 4)) == {s for s in unique if not any(t < s for t in unique)}
    holds = [(s, a) for s in cards for a in columns if a not in s and len(s) <= 3 and cards[s] == cards[s | {a}]]
    assert {(f.lhs, f.rhs) for f in P.fds(lattice, 3)} == {(s, a) for s, a in holds if not any(t < s and b == a for t, b in holds)}


@pytest.mark.parametrize("sample", [0, 3, 40, 1000])
def test_a_sample_only_refutes(spark, sample):
    rows = [(i, i // 2, i % 3 if i else None, "same" if i < 39 else "other") for i in range(40)]
    lattice = P.Lattice(spark.createDataFrame(rows, "a long, b long, c long, d string").coalesce(1), sample=sample)
    assert lattice.sample.rows == min(sample, 40)
    assert set(P.uccs(lattice, 2)) == {frozenset("a"), frozenset("bc")}
    assert {(f.lhs, f.rhs) for f in P.fds(lattice, 2)} >= {(frozenset("a"), x) for x in "bcd"}
    assert not any(f.lhs == frozenset() or f == P.FD(frozenset("b"), "d") for f in P.fds(lattice, 2))


@QUIET
@given(rows=st.lists(st.tuples(*[st.sampled_from([None, "", "a", "ab", "abc", "abcdefgh", "abcdefgx", "abcd"])] * 3), min_size=1, max_size=8))
def test_inclusion_against_brute_force(spark, rows):
    columns = list("xyz")
    df = spark.createDataFrame(rows, "x string, y string, z string")
    values = {c: {r[i] for r in rows if r[i] is not None} for i, c in enumerate(columns)}

    def distance(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            line = [last := i, *(last := min(last + 1, line[j] + 1, line[j - 1] + (x != y)) for j, y in enumerate(b, 1))]
        return line[-1]

    alike = lambda a, b: a == b or 1 - distance(a, b) / max(len(a), len(b)) >= 0.75
    pairs = [(d, r) for d in columns for r in columns if d != r and values[d] and values[r]]
    assert {(i.dep, i.ref) for i in P.inds(df)} == {(d, r) for d, r in pairs if values[d] <= values[r]}
    assert {(i.dep, i.ref) for i in P.sinds(df)} == {(d, r) for d, r in pairs if all(any(alike(v, w) for w in values[r]) for v in values[d])}


def test_mirrored_inclusion():
    found = [P.IND("a", "b"), P.IND("b", "a"), P.IND("c", "a")]
    assert P.without_mirrors(found, ["a", "b", "c"]) == [P.IND("a", "b"), P.IND("c", "a")]


def test_ragged_rows(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('a;b;c\n1;;3\n2;x\n3;"";z;extra\n"4;4";"q\\"q";\n')
    rows = D.read_relation(spark, str(path), DetectConfig())
    got = {r.a: (r.b, r.c, r._ragged) for r in rows.collect()}
    assert got == {"1": ("", "3", False), "2": ("x", None, True), "3": ("", "z", True), "4;4": ('q"q', "", False)}
    assert P.null_counts(rows, ["a", "b", "c"], absent=False) == {"a": 0, "b": 2, "c": 1}
    assert D.well_formed(rows).count() == 2


def test_gold_and_round_trip(spark, tmp_path):
    (tmp_path / "g.csv").write_text('"x_id";"y_id"\n"2";"1"\n"1";"2"\n"3";"9"\n')
    gold = D.read_gold(spark, str(tmp_path / "g.csv"))
    assert {(r.id1, r.id2) for r in gold.collect()} == {("1", "2"), ("3", "9")}
    assert D.gold_within(gold, spark.createDataFrame([("1",), ("2",), ("3",)], "id string")).count() == 1
    relation = D.as_relation(spark.createDataFrame([(1, "ä"), (2, "b")], "id long, v string"), ["id"])
    sinks.write_relation(relation, str(tmp_path / "out"))
    assert {(r.id, r.v) for r in D.read_relation(spark, str(tmp_path / "out")).collect()} == {("1", "ä"), ("2", "b")}


def test_relation_in_any_order(spark):
    rows = spark.createDataFrame([(v, i) for i, v in enumerate("hdbeagfc" * 5)], "v string, i int").repartition(5)
    got = D.as_relation(rows, ["v", "i"]).orderBy("_rid").collect()
    assert [(r.v, int(r.i)) for r in got] == sorted((v, i) for i, v in enumerate("hdbeagfc" * 5))


def test_metrics_curve_and_sinks(spark, tmp_path):
    found = spark.createDataFrame([("a", "b", 3), ("b", "a", 9), ("c", "d", 12), ("e", "f", 1), ("g", "h", 31)], "id1 string, id2 string, progress_rank long")
    gold = spark.createDataFrame([("b", "a"), ("c", "d"), ("g", "h"), ("y", "z")], "id1 string, id2 string")
    row = E.metrics(found, gold).first()
    assert (row.tp, row.fp, row.fn) == (3, 1, 1) and row.precision == 0.75 and row.f1 == pytest.approx(0.75)
    curve = E.progress_curve(found, gold, 10)
    assert sorted((r.t, r.cum_tp) for r in curve.collect()) == [(10, 1), (20, 2), (30, 2)]
    assert sorted((r.t, r.cum_tp) for r in E.progress_curve(found, gold, 10, include_tail=True).collect())[-1] == (40, 3)
    assert E.integral_quality(curve, 4, 40).first()["quality"] == pytest.approx((0 * 10 + 1 * 10 + 2 * 10 + 2 * 10) / 160)
    sinks.write_progress_curve(curve, str(tmp_path / "curve.csv"), 20)
    assert (tmp_path / "curve.csv").read_text() == "Time,Number of duplicates\n(0,0)\n10,1\n20,2\n"
    sinks.write_sweep([{"value": 0.5, "precision": 1.0, "recall": 0.5, "f1_score": 2 / 3}], str(tmp_path / "s"))
    assert (tmp_path / "s" / "recall.csv").read_text() == "Threshold,recall\n0.5,0.5\n"


def test_metrics_without_pairs(spark):
    none = spark.createDataFrame([], "id1 string, id2 string, progress_rank long")
    row = E.metrics(none, none).first()
    assert row.tp == 0 and math.isnan(row.precision)
    assert E.progress_curve(none, none, 10).count() == 0
    assert E.integral_quality(E.progress_curve(none, none, 10), 1, 40).first()["quality"] == 0


def brute_detect(rows, window, threshold):
    order = sorted(rows, key=lambda r: (r[1].lower(), r[0]))
    out = set()
    for i, a in enumerate(order):
        for b in order[i + 1 : i + window]:
            if a[1] or b[1]:
                x, y = a[1].lower(), b[1].lower()
                line = list(range(len(y) + 1))
                for k, c in enumerate(x, 1):
                    line = [last := k, *(last := min(last + 1, line[j] + 1, line[j - 1] + (c != d)) for j, d in enumerate(y, 1))]
                if 1 - line[-1] / max(len(x), len(y)) >= threshold:
                    out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


@QUIET
@given(values=st.lists(st.text("abAB", max_size=5), max_size=25))
def test_detection_against_brute_force(spark, values):
    rows = list(enumerate(values))
    relation = D.as_relation(spark.createDataFrame(rows, "id long, v string"), ["id"])
    cfg = DetectConfig(use_weights=False, window_size=4, similarity_threshold=0.6)
    got = X.psnm(relation, cfg, chosen=[AttributeWeight(1, "v")]).collect()
    assert {tuple(sorted((int(r.id1), int(r.id2)))) for r in got} == brute_detect(rows, 4, 0.6)


def test_variants_find_the_same(spark):
    rows = spark.createDataFrame([(i, f"name{i % 7}", f"city{i % 5}", "ab"[i % 2]) for i in range(40)], "id long, n string, c string, s string")
    relation = D.as_relation(rows, ["id"]).cache()
    chosen = [AttributeWeight(1, "n", 0.6), AttributeWeight(2, "c", 0.4)]
    cfg = DetectConfig(window_size=6, similarity_threshold=0.9)
    pairs = lambda df: {(r.id1, r.id2) for r in df.collect()}
    assert pairs(X.psnm(relation, cfg, chosen=chosen)) == pairs(X.psnm(relation, cfg, chosen=chosen, concurrent=True))
    assert pairs(X.pb(relation, cfg, chosen=chosen)) == pairs(X.pb(relation, cfg, chosen=chosen, concurrent=True))
    across = X.psnm(relation, cfg.but(two_in_one="s"), chosen=chosen).collect()
    assert all((int(r.id1) - int(r.id2)) % 2 for r in across)
    assert pairs(X.single_key(relation, cfg, ["n", "c"], chosen=chosen)) and X.detect(relation, cfg.but(algorithm="NONE"), chosen=chosen).count() == 0


def test_no_attributes_left(spark):
    relation = D.as_relation(spark.createDataFrame([(1, "a")], "id long, v string"), ["id"])
    assert X.detect(relation, DetectConfig(), chosen=[]).count() == 0
