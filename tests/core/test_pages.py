import pytest
from pyspark.sql import functions as F

from maskwright.operators import pages


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize("text, clean", [("V Vanguard B Brokerage S Services", "Vanguard Brokerage Services"), ("8 877", "877"), ("a and b", "a and b"), ("I saw it", "I saw it"), ("J\nJASON", "\nJASON"), ("A\nA AB", "A\nAB"), ("é É Éa", "é É Éa"), ("", "")])
def test_clean(spark, text, clean):
    assert one(spark, text, pages.clean_extracted_text) == clean


def test_pages(spark):
    df = spark.createDataFrame([([" a \n", "b"],)], "p array<string>")
    text = df.select(pages.join_pages(F.col("p"))).first()[0]
    assert text == "a\n\n--- Page Break ---\n\nb" and one(spark, text, pages.split_pages) == ["a", "b"]


def test_hocr(spark):
    lines = [
        "<span class='ocrx_word' id='1' title='bbox 10 20 110 50; x_wconf 90'>A&amp;lt;B</span>",
        "<span class='ocr_line' title='bbox 1 2 3 4'>no word</span>",
        "<span class='ocrx_word' title='bbox 10 20 5 50'> </span>",
        "<span class='ocrx_word' title='bbox 10 20'>short</span>",
        "<span class='ocrx_word' title='bbox 10 20 5 50'><em>thin</em></span>",
    ]
    got = one(spark, "\n".join(lines[:4]), pages.parse_hocr)
    assert [tuple(w) for w in got] == [("A<B", 10, 20, 100, 30)]


def test_window(spark):
    df = spark.createDataFrame([(["Mr", "JOHN", "smith", "John", "Smith,"], "John  Smith"), ([], "x"), (["a"], " ")], "w array<string>, o string")
    assert [r[0] for r in df.select(pages.page_matches(F.col("w"), F.col("o"))).collect()] == [[1], [], []]
    assert [r[0] for r in df.select(pages.page_has_match(F.col("w"), F.col("o"))).collect()] == [True, False, False]


def test_boxes(spark):
    df = spark.createDataFrame([([("a", 2, 10, 20, 8), ("b", 30, 12, 10, 8)],)], f"w array<{pages.WORD}>")
    assert tuple(df.select(pages.redaction_box(F.col("w"), F.lit(0), F.lit(2))).first()[0]) == (0, 6, 44, 18)
    assert df.select(pages.is_rotated(F.col("w"))).first()[0] is False


def test_wrap(spark):
    assert pages.wrap_line("a" * 90) == ["a" * 90]
    assert pages.wrap_line("a" * 80 + " " + "b" * 20) == ["a" * 80, "b" * 20]
    assert pages.wrap_line("é" * 50) == ["é" * 45, "é" * 5]
    assert pages.wrap_line("") == [""]
    df = spark.createDataFrame([(1, "\n".join(map(str, range(120)))), (2, ""), (3, None)], "doc_id bigint, text string")
    got = pages.wrap_and_paginate(df).groupBy("doc_id", "page").count().orderBy("doc_id", "page").collect()
    assert [tuple(r) for r in got] == [(1, 0, 50), (1, 1, 50), (1, 2, 20), (2, 0, 1)]


def decoded(spark, text, labels, offsets, names):
    df = spark.createDataFrame([(text, labels, offsets, names)], "t string, l array<int>, o array<struct<start:int,end:int>>, m array<string>")
    return [(d["start"], d["end"], d["entity_type"], d["matched_text"]) for d in df.select(pages.decode_bio(F.col("t"), F.col("l"), F.col("o"), F.col("m"))).first()[0]]


def test_bio(spark):
    names = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC", "B-EMAIL", "I-EMAIL"]
    assert decoded(spark, "Contact John Smith today", [0, 0, 1, 2, 0, 0], [(0, 0), (0, 7), (8, 12), (13, 18), (19, 24), (0, 0)], names) == [(8, 18, "PERSON", "John Smith")]
    assert decoded(spark, "Hello John Smith", [0, 0, 2, 2, 0], [(0, 0), (0, 5), (6, 10), (11, 16), (0, 0)], names) == [(6, 16, "PERSON", "John Smith")]
    assert decoded(spark, "Bob in Paris with a@b.io", [1, 0, 3, 0, 5], [(0, 3), (4, 6), (7, 12), (13, 17), (18, 24)], names) == [(18, 24, "EMAIL", "a@b.io")]
    assert decoded(spark, "john smith", [1, 2], [(0, 4), (5, 10)], names) == []
    assert decoded(spark, "x", [], [], names) == [] and decoded(spark, "Jane Mary", [1, 1, 9], [(0, 4), (0, 99), (1, 2)], names) == []
