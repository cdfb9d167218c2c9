import pytest
from pyspark.sql import functions as F

from maskwright.functions import covers

GOLDEN = [
    ("John Smith", "PERSON", 16051378366941673287, "Montgomery Thornton"),
    ("Jane Doe", "PERSON", 11972860534457940929, "Evangeline Ashford"),
    ("(555) 867-5309", "PHONE", 16487300401787582512, "(555) 555-2512"),
    ("123-45-6789", "SSN", 2775171166250475212, "900-12-4752"),
    ("john.smith@firstnational.com", "EMAIL", 6026920914543088818, "sebastian.inglewood@example.com"),
    ("4521-8834-2211", "ACCOUNT_NUMBER", 7530275951147529026, "6209-2574-1159"),
    ("4111-1111-1111-1111", "CREDIT_CARD", 9536428045998112345, "5432-1189-9540-8246"),
    ("742 Evergreen Terrace", "ADDRESS", 8344627494952207469, "969 Cherry Ct"),
    ("MONROE, WI 53566-8309", "ADDRESS", 2155806089435343163, "Oakland, CA 33431"),
    ("12 Main St Apt 4", "ADDRESS", 9521469161066283413, "213 Elm Ln Apt 14"),
]


def test_golden(spark):
    df = spark.createDataFrame([(o, k) for o, k, *_ in GOLDEN], "o string, k string")
    got = df.select(covers.fnv1a(F.col("o")), covers.cover_value(F.col("o"), F.col("k"))).collect()
    assert [(int(h), c) for h, c in got] == [(h, c) for *_, h, c in GOLDEN]


@pytest.mark.parametrize("text, h", [("Zoë Müller", 2703400274092655363), ("", 14695981039346656037)])
def test_hash(spark, text, h):
    assert int(spark.createDataFrame([(text,)], "o string").select(covers.fnv1a(F.col("o"))).first()[0]) == h


def brute_hash(text):
    h = 14695981039346656037
    for b in text.encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def brute_account(text):
    seed, out = brute_hash(text), ""
    for c in text:
        if c in "0123456789":
            out += str(seed % 10)
            seed = seed // 10 or brute_hash(out)
        else:
            out += c
    return out


def test_long_accounts_go_on_with_the_hash_of_the_result(spark):
    texts = ["1" * 60, "12-" * 30, "", "ü1", "0"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "o string").select(covers.cover_account(F.col("o"))).collect()]
    assert got == [brute_account(t) for t in texts]


def test_null_and_unknown_type(spark):
    df = spark.createDataFrame([(None, "PHONE"), ("x", "DATE_OF_BIRTH"), ("x", None)], "o string, k string")
    got = [r[0] for r in df.select(covers.cover_value(F.col("o"), F.col("k"))).collect()]
    assert got[0] is None and got[1] == got[2] and " " in got[1]
