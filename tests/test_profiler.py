"""The seven profiler cases on four-row relations: attribute list with weights, in order."""

import pytest

from twinsieve.config import DetectConfig
from twinsieve.operators.weights import AttributeWeight as A
from twinsieve.operators.weights import attribute_weights
from twinsieve.sources.delimited import read_relation

OFF = DetectConfig(filter_missing=False, filter_fd=False, filter_pk=False, filter_ind=False, use_weights=False, use_fd=False, use_ucc=False, max_fd_determinant=3, null_threshold=0.05)
CASES = {
    "missing": ("Attribute1;Attribute2\n1;5\n2;4\n3;5\n3;;\n", dict(filter_missing=True), [A(0, "Attribute1")]),
    "fd_filter": ("Attribute1;Attribute2\n1;5\n2;4\n3;5\n3;5\n", dict(filter_fd=True, use_fd=True), [A(0, "Attribute1")]),
    "pk_filter": ("Attribute1;Attribute2\n1;1\n2;2\n3;3\n4;3\n", dict(filter_pk=True), [A(1, "Attribute2")]),
    "ind_filter": ("Attribute1;Attribute2;Attribute3\n1;3;6\n2;3;7\n3;3;8\n3;3;9\n", dict(filter_ind=True), [A(0, "Attribute1"), A(2, "Attribute3")]),
    "fd_weight": ("Attribute1;Attribute2\n1;5\n2;4\n3;5\n3;5\n", dict(filter_missing=True, use_weights=True, use_fd=True), [A(0, "Attribute1", 1.0), A(1, "Attribute2", 0.0)]),
    "ucc_weight": ("Attribute1;Attribute2;Attribute3\n1;5;5\n2;5;4\n3;5;5\n3;5;4\n", dict(filter_missing=True, use_weights=True, use_ucc=True), [A(0, "Attribute1", 0.5), A(2, "Attribute3", 0.5), A(1, "Attribute2", 0.0)]),
    "fd_ucc_weight": (
        "Attribute1;Attribute2;Attribute3;Attribute4\n1;5;5;6\n2;5;4;7\n3;5;5;6\n3;5;4;6\n",
        dict(filter_missing=True, use_weights=True, use_fd=True, use_ucc=True),
        [A(0, "Attribute1", 2 / 3), A(2, "Attribute3", 1 / 3), A(1, "Attribute2", 0.0), A(3, "Attribute4", 0.0)],
    ),
}


@pytest.mark.parametrize("case", CASES)
def test_profiler(spark, tmp_path, case):
    text, flags, expected = CASES[case]
    path = tmp_path / f"{case}.csv"
    path.write_text(text)
    assert attribute_weights(read_relation(spark, str(path)), OFF.but(**flags)) == expected
