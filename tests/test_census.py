"""End-to-end results on the census relation, if CENSUS_DIR names a folder that holds it."""

import os

import pytest

from twinsieve.config import PRESETS
from twinsieve.functions.similarity import at_least
from twinsieve.operators.evaluate import metrics
from twinsieve.plans.detect import named_pairs, run
from twinsieve.sources.delimited import gold_within, ids, read_gold, read_relation

DATA = os.environ.get("CENSUS_DIR", "")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{DATA}/census.csv"), reason="no census relation")
#: algorithm, profiler, weights: pairs compared, NaN pairs, found, tp, fp, fn
GOLDENS = [
    ("PSNM", True, True, 43_212, 2_579, 351, 283, 68, 93),
    ("PSNM", True, False, 43_212, 2_579, 480, 297, 183, 79),
    ("PSNM", False, False, 30_283, 2_401, 383, 298, 85, 78),
    ("PB", True, True, 39_814, 2_414, 351, 283, 68, 93),
    ("PB", True, False, 39_814, 2_414, 480, 297, 183, 79),
    ("PB", False, False, 27_942, 2_235, 382, 298, 84, 78),
]


@pytest.mark.parametrize("algorithm, profiler, weights, pairs, nans, found, tp, fp, fn", GOLDENS)
def test_census(spark, algorithm, profiler, weights, pairs, nans, found, tp, fp, fn):
    cfg = PRESETS["CENSUS"].but(algorithm=algorithm, use_profiler=profiler, use_weights=weights)
    relation = read_relation(spark, f"{DATA}/census.csv", cfg).cache()
    gold = gold_within(read_gold(spark, f"{DATA}/census_DPL.csv", cfg), ids(relation))
    done = run(relation, cfg)
    if profiler:
        assert {a.attribute: round(a.weight, 6) for a in done.attributes} == ({"first_name": 0.4, "last_name": 0.3, "zip_code": 0.3} if weights else {"first_name": 0, "last_name": 0, "zip_code": 0})
    scored = done.scored.cache()
    assert scored.count() == pairs
    assert scored.where("isnan(sim)").count() == nans
    duplicates = named_pairs(relation, scored.where(at_least(scored["sim"], cfg.similarity_threshold)), "id").cache()
    assert duplicates.count() == found
    row = metrics(duplicates, gold).first()
    assert (row["tp"], row["fp"], row["fn"]) == (tp, fp, fn)
