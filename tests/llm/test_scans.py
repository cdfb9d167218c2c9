import math

import pytest

from maskwright.functions.filters import may_hold, may_hold_one, value_filter
from maskwright.llm.blocks import text_hash
from maskwright.llm.scans import as_cased, body_tokens, channel, difference, first_guess, fold, form_keys, layout, page_lines, rebuilt, repaired_texts, scan_repairs

CLEAN = "Their western clerk declined the final invoice because another full-time tariff was accepted during the evening. " * 30
PAGES = "\n".join(
    [
        "Western Forecast Minutes    6", "", "Tbeir westerri clerk dedined the final invoice bec-", "ause another full-", "time tariff was accepted durlng", "", "--- Page Break ---", "",
        "7    Westerri Forecast Minutes", "", "the evening.", "", "Another clerk declined.", "", "[7]",
    ]
)
WORDS = "word_id bigint, scan_id bigint, page int, text string, x int, y int, w int, h int"


@pytest.mark.parametrize("seen, meant", [("tbeir", "their"), ("durlng", "during"), ("westerri", "western"), ("dedined", "declined"), ("becau5e", "because"), ("tvvofold", "twofold"), ("la6oratory", "laboratory"), ("eastem", "eastern"), ("outsicle", "outside"), ("afternoori", "afternoon")])
def test_confusions_share_a_key(seen, meant):
    assert fold(seen) == fold(meant) and channel(seen, meant, first_guess()) > -math.inf


def test_channel():
    table = first_guess()
    assert channel("cat", "dog", table) == -math.inf and channel("the", "the", table) > channel("tbe", "the", table)
    assert channel("tne", "the", table) == -math.inf < channel("tne", "the", table | {("h", "n"): 0.01})


@pytest.mark.parametrize("seen, meant, segment", [("tne", "the", ("h", "n")), ("tlie", "the", ("h", "li")), ("vear", "year", ("y", "v")), ("moming", "morning", ("rn", "m")), ("the", "the", None), ("cat", "dog", None)])
def test_one_segment(seen, meant, segment):
    assert difference(seen, meant) == segment
    assert segment is None or set(form_keys(seen)) & set(form_keys(meant))


def test_layout():
    assert layout(PAGES.split("\n"), [False] * 15) == ["header", "blank", "body", "body", "body", "blank", "marker", "blank", "header", "blank", "body", "blank", "body", "blank", "page_number"]


def test_halves_are_joined_over_the_page():
    lines = ["an app-", "", "- 3 -", "", "HEAD LINE", "", "ointment. Next"]
    kinds = ["body", "blank", "page_number", "blank", "header", "blank", "body"]
    assert [(t[2], t[3]) for t in body_tokens(lines, kinds)] == [("an", ""), ("app", "app-ointment"), ("Next", "")]


def test_case():
    assert [as_cased("Tbeir", "their", False), as_cased("0ur", "our", True), as_cased("THEIR", "their", False), as_cased("tbe", "the", True)] == ["Their", "Our", "THEIR", "the"]


def frames(spark, texts, words=()):
    return spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(list(words), WORDS), spark.createDataFrame([(CLEAN,), (None,)], "text string")


def test_repairs(spark):
    got = {(r["defect"], r["repaired"]) for r in scan_repairs(*frames(spark, [(1, PAGES), (2, None), (3, " ")])).collect()}
    assert got == {
        ("header", "Western Forecast Minutes    6"), ("header", "7    Westerri Forecast Minutes"), ("page_number", "[7]"), ("hyphen", "because"), ("hyphen", "full-time"),
        ("misread", "Their"), ("misread", "western"), ("misread", "declined"), ("misread", "during"),
    }


def test_words_by_their_boxes(spark):
    words = [(5, 9, 1, "bec-", 100, 54, 40, 20), (4, 9, 1, "durlng", 10, 50, 60, 20), (6, 9, 1, "ause", 10, 90, 40, 20), (1, 9, 1, "HEAD", 10, 10, 40, 20), (2, 9, 1, "LINE", 60, 12, 40, 20), (7, 9, 1, "-", 10, 130, 5, 20), (8, 9, 1, "4", 20, 130, 5, 20), (9, 9, 1, None, 1, 1, 1, 1), (10, None, 1, "x", 1, 1, 1, 1)]
    got = {(r["row_id"], r["defect"], r["repaired"]) for r in scan_repairs(*frames(spark, [], words)).collect()}
    assert got == {(1, "header", "HEAD"), (2, "header", "LINE"), (4, "misread", "during"), (5, "hyphen", "because"), (7, "page_number", "-"), (8, "page_number", "4")}


def test_paragraphs(spark):
    want = "Their western clerk declined the final invoice because another full-time tariff was accepted during the evening.\n\nAnother clerk declined."
    got = {r["doc_id"]: r["repaired_text"] for r in repaired_texts(*frames(spark, [(1, PAGES), (2, "")])).collect()}
    assert got == {1: want, 2: ""}
    assert rebuilt("", {}) == ""


def test_empty(spark):
    assert scan_repairs(*frames(spark, [])).count() == 0


def test_confusions_that_are_on_no_list_are_fitted(spark):
    """Held-out confusions of the channel: each is seen in a few words and must then be undone in all of them."""
    meant = "the year house first other theory yellow yesterday horse thirst burst north".split()
    clean = spark.createDataFrame([(" ".join(meant) + ".",)] * 400, "text string")
    misread = {"h": "n", "y": "v", "r": "i"}
    lines, want = [], set()
    for k in range(240):
        word = meant[k % len(meant)]
        at = next(i for i, c in enumerate(word) if c in misread)
        lines.append("the year house first " + word[:at] + misread[word[at]] + word[at + 1 :] + " north other burst.")
        want.add(word)
    scan = spark.createDataFrame([(1, "\n\n".join(lines))], "doc_id bigint, text string")
    got = {r["repaired"] for r in scan_repairs(scan, spark.createDataFrame([], WORDS), clean).where("defect = 'misread'").collect()}
    assert got == want
    fine = spark.createDataFrame([(1, "The yean house. The northy burst.")], "doc_id bigint, text string")
    assert scan_repairs(fine, spark.createDataFrame([], WORDS), clean).count() == 0  # no evidence, no confusion


def test_lines_of_a_page():
    assert page_lines([(10, 50, 2, 8, "b"), (12, 10, 1, 8, "a"), (30, 5, 3, 8, "c")]) == [[("a", 1), ("b", 2)], [("c", 3)]]


def test_files_of_many_pages_are_read_in_volumes(spark):
    words = [(p * 10 + k, 5, p, t, 10 + 60 * k, 10 + 40 * (p % 2), 40, 20) for p in range(0, 1203, 1) for k, t in enumerate(["durlng", "tbe."])]
    got = scan_repairs(*frames(spark, [], words)).where("defect = 'misread'").collect()
    assert len(got) == 2 * 1203


def test_filter_loses_nothing(spark):
    values = [f"w{i}é" for i in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "v string").selectExpr("v", "xxhash64(v) AS h")
    assert {r["v"]: r["h"] & (2**64 - 1) for r in frame.collect()} == {v: text_hash(v) for v in values}
    held = value_filter(frame, "h", 16)
    import numpy as np

    inside, outside = np.array([text_hash(v) for v in values], np.uint64), np.array([text_hash(f"x{i}") for i in range(3000)], np.uint64)
    assert may_hold(held, inside).all() and may_hold(held, outside).mean() < 0.2
    assert [may_hold_one(held, int(h)) for h in outside[:100]] == may_hold(held, outside[:100]).tolist()
