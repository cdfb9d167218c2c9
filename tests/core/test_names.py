import pytest
from pyspark.sql import functions as F

from maskwright.operators.names import common_words_of, dictionary_detector, find_names, line_words, name_words


def persons(text):
    return [text[a:b] for a, b, kind in find_names(text) if kind == "PERSON"]


@pytest.mark.parametrize(
    "text, names",
    [
        ("Please contact John Smith regarding the matter.", ["John Smith"]),
        ("End of sentence. Robert Johnson walked to the store.", []),
        ("We received a Direct Deposit from the bank.", []),
        ("End of sentence. Then John Smith appeared.", ["John Smith"]),
        ("We met with Mary Jane Watson at the office.", ["Mary Jane Watson"]),
        ("I spoke with John about the project.", []),
        ("Statement for ROBERT JOHNSON dated today.", ["ROBERT JOHNSON"]),
        ("Contact Vanguard Brokerage Services for help.", []),
        ("Member of FINRA SIPC and covered.", []),
        ("Your Personal Investor account is ready.", []),
        ("JOHN SMHX rose today", []),
        ("signed by JOHN SMHX today", ["JOHN SMHX"]),
        ("we saw Jürgen Braun there", []),
        ("", []),
    ],
)
def test_persons(text, names):
    assert persons(text) == names


def test_addresses():
    assert ("ADDRESS", "123 Oak Lane") in [(k, "She lives at 123 Oak Lane in the suburbs."[a:b]) for a, b, k in find_names("She lives at 123 Oak Lane in the suburbs.")]
    assert [k for *_, k in find_names("at 12 Élm Street")] == []


def test_words():
    assert line_words("Hi, there! You ...") == [(0, 2, "Hi", True), (4, 9, "there", False), (11, 14, "You", True)]


def test_detector_and_words_agree_on_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "by John Smith")], "id int, text string")
    got = {r["id"]: r["d"] for r in df.select("id", dictionary_detector()(F.col("text")).alias("d")).collect()}
    assert got[1] == [] and got[2] == [] and got[3][0]["matched_text"] == "John Smith"
    words = {r["id"]: r["w"] for r in df.select("id", name_words(F.col("text")).alias("w")).collect()}
    assert words[1] is None and words[2] == [] and [w["capitalised"] for w in words[3]] == [False, True, True]


def test_flags_agree_with_the_arrow_side(spark, small):
    texts = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").where("text IS NOT NULL").collect()][:40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in df.select("id", name_words(F.col("text")).alias("w")).collect():
        want = [(n, w, fresh) for n, line in enumerate(texts[r["id"]].split("\n")) for _, _, w, fresh in line_words(line)]
        assert [(w["line"], w["word"], w["sentence_start"]) for w in r["w"]] == want


def test_common_words(spark):
    df = spark.createDataFrame([("the The the the cat",), ("Cat the",)], "text string")
    assert [r[0] for r in common_words_of(df).collect()] == ["the"]
