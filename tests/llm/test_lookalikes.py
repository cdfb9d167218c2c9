import unicodedata

import pytest

from maskwright.llm.lookalikes import INVISIBLE, LOOKALIKES, consistent_forms, value_lookup

SCHEMA = "src string, row_id bigint, value string"


def plain(spark, *values):
    got = {r["row_id"]: r["plain"] for r in consistent_forms(spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], SCHEMA)).collect()}
    return [got.get(i) for i in range(len(values))]


@pytest.mark.parametrize(
    "value, form",
    [
        ("ａｂ－９＠ｘ．ｔｅｓｔ", "ab-9@x.test"),
        ("𝟓𝟓𝟓-𝟸𝟾", "555-28"),
        ("Ke‌n­ny﻿", "Kenny"),
        ("555 682　0442", "555 682 0442"),
        ("7424‐7271‑3678", "7424-7271-3678"),
        ("René Córdaveс", "René Córdavec"),
        ("YОLАNDΑ", "YOLANDA"),
        ("Jürgen", "Jürgen"),
        ("ﬁne oﬀer", "fine offer"),
        ("А. Smith", "A. Smith"),
    ],
)
def test_forms(spark, value, form):
    assert plain(spark, value) == [form]


def test_no_cases(spark):
    assert plain(spark, "René Löwendrun", "Ждана Бурковец", "Φαίδων Ζαλιώτης", "plain", "", None) == [None] * 6


def brute(text):
    """The same form by plain Python over characters."""
    kept = "".join(c for c in text if not (unicodedata.category(c) == "Cf" or c in "͏ᅟᅠ" or 0xFE00 <= ord(c) <= 0xFE0F))
    out = ""
    for c in kept:
        tag = unicodedata.decomposition(c).partition(" ")[0]
        n = unicodedata.normalize("NFKC", c)
        out += "-" if c in "‐‑‒–—−﹘﹣－" else " " if unicodedata.category(c) == "Zs" else n if n.isascii() and (tag in ("<wide>", "<narrow>", "<font>") or "ﬀ" <= c <= "ﬆ") else c
    out = unicodedata.normalize("NFC", out)
    latin = lambda w: any(unicodedata.name(c, "").startswith("LATIN") for c in w)
    words, word = [], ""
    for c in out + " ":
        if c.isalpha() or unicodedata.combining(c):
            word += c
        else:
            words += [word, c]
            word = ""
    return unicodedata.normalize("NFC", "".join("".join(LOOKALIKES.get(c, c) for c in w) if latin(w) or (len(w) == 1 and latin(out)) else w for w in words))[:-1]


def test_against_brute_force(spark, small):
    a = spark.read.parquet(f"{small}/mappings.parquet").selectExpr("'m' AS src", "mapping_id AS row_id", "original AS value")
    b = spark.read.parquet(f"{small}/detections.parquet").selectExpr("'d' AS src", "det_id AS row_id", "matched_text AS value")
    rows = a.union(b)
    want = {(r["src"], r["row_id"], brute(r["value"])) for r in rows.collect() if r["value"] and brute(r["value"]) != r["value"]}
    assert {tuple(r) for r in consistent_forms(rows).collect()} == want
    assert INVISIBLE


def test_lookup(spark):
    seen = spark.createDataFrame([("d", 1, "Ke‌n"), ("d", 2, "Ken"), ("d", 3, None), ("d", 4, "other")], SCHEMA)
    stored = spark.createDataFrame([("m", 7, "Ken"), ("m", 5, "Ｋｅｎ"), ("m", 1, None)], SCHEMA)
    assert sorted(tuple(r) for r in value_lookup(seen, stored).collect()) == [(1, 5, 2), (2, 5, 2)]
    assert value_lookup(seen.where("false"), stored).count() == 0
