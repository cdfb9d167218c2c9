import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators.rules import DETECTIONS
from maskwright.operators.spans import apply_replacements, merge_spans, propagate_persons


def spans(*pairs):
    return [(a, b, "x" * (b - a), "T", str(i), i) for i, (a, b) in enumerate(pairs)]


def merged(spark, found):
    df = spark.createDataFrame([(found,)], f"d {DETECTIONS}").select(merge_spans(F.col("d")).alias("m"))
    return [(d["start"], d["end"], d["rule_name"]) for d in df.first()["m"]]


@pytest.mark.parametrize(
    "given, kept",
    [
        ([(10, 20), (30, 41)], [(10, 20), (30, 41)]),
        ([(10, 14), (10, 20)], [(10, 20)]),
        ([(10, 20), (15, 23)], [(10, 20)]),
        ([(0, 10), (5, 20), (12, 18)], [(5, 20)]),
        ([(0, 10), (5, 12), (11, 20)], [(0, 10), (11, 20)]),
        ([(0, 5), (5, 9)], [(0, 5), (5, 9)]),
        ([(3, 9), (3, 9)], [(3, 9)]),
        ([], []),
    ],
)
def test_merge(spark, given, kept):
    assert [m[:2] for m in merged(spark, spans(*given))] == kept


def test_ties_keep_the_first_detector(spark):
    assert merged(spark, spans((3, 9), (3, 9)))[0][2] == "0"


def test_merged_are_disjoint_and_sorted(spark):
    rng = random.Random(7)
    cases = [spans(*[(a, a + rng.randint(1, 12)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 12)))]) for _ in range(60)]
    df = spark.createDataFrame([(c,) for c in cases], f"d {DETECTIONS}").select(merge_spans(F.col("d")).alias("m"))
    for (m,) in df.collect():
        assert all(x["end"] <= y["start"] for x, y in zip(m, m[1:]))


def test_bytes_decide_length(spark):
    found = [(0, 4, "éééé", "T", "wide", 0), (2, 8, "éaaaaa", "T", "long", 1)]
    assert merged(spark, found)[0][2] == "wide"


def propagated(spark, text, names):
    found = [(text.index(n), text.index(n) + len(n), n, "PERSON", "r", 0) for n in names]
    df = spark.createDataFrame([(text, found)], f"text string, d {DETECTIONS}").select(propagate_persons(F.col("text"), F.col("d")).alias("m"))
    return [(d["start"], d["end"], d["matched_text"], d["rule_name"]) for d in df.first()["m"]]


def test_propagation(spark):
    text = "Ann Lee wrote. ANN LEE and Joann Leeds and ann lee."
    assert [p[2] for p in propagated(spark, text, ["Ann Lee"])] == ["Ann Lee", "ANN LEE", "ann Lee", "ann lee"]
    assert len(propagated(spark, "nothing here", [])) == 0


def test_propagation_of_special_characters(spark):
    assert [p[0] for p in propagated(spark, "A (b* c, a (B* C", ["A (b*"])] == [0, 9]


def applied(spark, text, found):
    df = spark.createDataFrame([(text, found)], "text string, d array<struct<start:int,end:int,replacement:string,accepted:boolean>>")
    return df.select(apply_replacements(F.col("text"), F.col("d"))).first()[0]


def test_apply(spark):
    text = "Name: Jo, SSN: 123-45-6789"
    both = [(15, 26, "900-00-0000", True), (6, 8, "Alexander Blackwood", True)]
    assert applied(spark, text, both) == "Name: Alexander Blackwood, SSN: 900-00-0000"
    assert applied(spark, text, [(6, 8, "X", False)]) == text
    assert applied(spark, text, []) == text
