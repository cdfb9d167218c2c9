import pytest
from pyspark.sql import functions as F

from maskwright.functions.text import context_of, from_utf16_offset, utf16_offset
from maskwright.operators import rules


def scan(spark, text, held=rules.BUILT_IN):
    df = spark.createDataFrame([(text,)], "text string").select(rules.scan_rules(F.col("text"), held).alias("d"))
    return [(d["entity_type"], d["matched_text"], d["start"], d["end"], d["rule_name"]) for d in df.first()["d"] or []]


@pytest.mark.parametrize(
    "text, kind, matched",
    [
        ("My SSN is 123-45-6789 and that's private.", "SSN", "123-45-6789"),
        ("Call me at (555) 123-4567 anytime.", "PHONE", "555) 123-4567"),
        ("Phone: 555.123.4567 is the number.", "PHONE", "555.123.4567"),
        ("Phone: 5551234567 is the number.", "PHONE", "5551234567"),
        ("Contact me at john.doe@example.com for details.", "EMAIL", "john.doe@example.com"),
        ("Card: 4111-1111-1111-1111 expires 12/25.", "CREDIT_CARD", "4111-1111-1111-1111"),
        ("Payment with 5500 0000 0000 0004.", "CREDIT_CARD", "5500 0000 0000 0004"),
        ("Your Account #: 1234-5678-9012 is active.", "ACCOUNT_NUMBER", "Account #: 1234-5678-9012"),
        ("Acct #1234567890", "ACCOUNT_NUMBER", "Acct #1234567890"),
        ("742 EVERGREEN AVE APT 4", "ADDRESS", "742 EVERGREEN AVE APT 4"),
        ("Monroe, WI 53566-8309", "ADDRESS", "Monroe, WI 53566-8309"),
        ("I lived in Monroe, WI 53566", "ADDRESS", "I lived in Monroe, WI 53566"),
        ("DOB: 01/02/1990", "DATE_OF_BIRTH", "DOB: 01/02/1990"),
        ("passport A1234567", "ID_DOCUMENT", "passport A1234567"),
        ("Driver's License D1234567", "ID_DOCUMENT", "Driver's License D1234567"),
        ("routing 021000021", "ACCOUNT_NUMBER", "routing 021000021"),
        ("Medicare ID 1EG4TE5MK73", "ID_DOCUMENT", "Medicare ID 1EG4TE5MK73"),
        ("123-45-6789", "SSN", "123-45-6789"),
    ],
)
def test_found(spark, text, kind, matched):
    assert (kind, matched) in [(k, m) for k, m, *_ in scan(spark, text)]


@pytest.mark.parametrize("text", ["Not an SSN: 12-34-5678 or 1234-56-7890.", "This is a normal paragraph with numbers like 42 and 100.", "Call 800-555-1234", "", "123-45-6789é"])
def test_nothing(spark, text):
    assert scan(spark, text) == []


def test_toll_free_without_separators_is_still_a_long_number(spark):
    assert [d[4] for d in scan(spark, "Call 8005551234")] == ["Long Number Sequence"]


def test_order_and_null(spark):
    found = scan(spark, "SSN: 987-65-4321, email: test@example.com, phone: 555-123-4567")
    assert [d[4] for d in found] == ["SSN", "ITIN", "Email", "Phone (US)"]
    assert scan(spark, None) == []


def test_custom_rules(spark):
    own = rules.Rule("member", "MEMBER_ID", r"(?i)member\s*id\s*:?\s*(\w{6,12})")
    off = rules.Rule("off", "X", "Your", enabled=False)
    found = scan(spark, "Your Member ID: ABC123XYZ is on file.", rules.active_rules((off, own)))
    assert ("MEMBER_ID", "Member ID: ABC123XYZ") in [(k, m) for k, m, *_ in found]


def test_rules_before_an_invalid_one_are_kept(spark):
    good, bad, late = rules.Rule("a", "A", "a+"), rules.Rule("b", "B", "[unclosed"), rules.Rule("c", "C", "c+")
    assert [r.name for r in rules.active_rules((good, bad, late))][len(rules.BUILT_IN) :] == ["a"]
    with pytest.raises(rules.InvalidPattern):
        rules.RuleStore().add(bad)


def test_rule_store(spark):
    store = rules.RuleStore()
    store.add(rules.Rule("a", "A", "a"))
    store.add(rules.Rule("b", "B", "b"))
    store.add(rules.Rule("a", "A2", "a"))
    assert [(r.name, r.entity_type) for r in store.list()] == [("b", "B"), ("a", "A2")]
    assert store.remove("b") and not store.remove("b")


def test_pattern_test_has_no_filters(spark):
    df = spark.createDataFrame([("800-555-1234",)], "text string").select(rules.test_pattern(F.col("text"), r"\d+").alias("d"))
    assert [d["matched_text"] for d in df.first()["d"]] == ["800", "555", "1234"]


def test_filters(spark):
    df = spark.createDataFrame([("1-800-555-1234",), ("855 555 1234",), ("555-1234",), ("2-800-555-1234",)], "t string")
    assert [r[0] for r in df.select(rules.is_toll_free(F.col("t"))).collect()] == [True, True, False, False]
    bad = spark.createDataFrame([("12 Elm St",), ("12 Élm St",), ("!!!! 1",)], "t string")
    assert [r[0] for r in bad.select(rules.is_garbage_address(F.col("t"))).collect()] == [False, True, True]


def context(spark, text, start, end):
    df = spark.createDataFrame([(text, start, end)], "text string, s int, e int")
    return df.select(context_of(F.col("text"), F.col("s"), F.col("e"))).first()[0]


def test_context(spark):
    assert context(spark, "ab cd", 3, 5) == "ab cd"
    text = "x" * 50 + "HIT" + "y" * 50
    assert context(spark, text, 50, 53) == "..." + "x" * 40 + "HIT" + "y" * 40 + "..."
    wide = "é" * 50 + "HIT" + "é" * 19
    assert context(spark, wide, 50, 53) == "..." + "é" * 20 + "HIT" + "é" * 19


def test_utf16(spark):
    df = spark.createDataFrame([("a😀b",)], "t string")
    assert df.select(utf16_offset(F.col("t"), F.lit(2)), from_utf16_offset(F.col("t"), F.lit(3))).first() == (3, 2)


def test_very_long_text(spark):
    text = "word " * 200_000 + "a@b.example"
    assert scan(spark, text)[0][1] == "a@b.example"


def test_pattern_that_can_match_nothing(spark):
    line = rules.Rule("line", "LINE", r"(?m)^.*$")
    df = spark.createDataFrame([("ab\n\ncd",), (None,)], "text string").select(rules.rule_spans(F.col("text"), line).alias("d"))
    assert [[(d["start"], d["matched_text"]) for d in r[0] or []] for r in df.collect()] == [[(0, "ab"), (4, "cd")], []]


def test_hints_see_the_characters_that_the_patterns_see(spark):
    """Full-width digits are digits to the pattern; a ZIP after a non-breaking space is found and then filtered as not ASCII."""
    number = "\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19"
    zip_rule = next(r for r in rules.BUILT_IN if r.name == "City State Zip")
    df = spark.createDataFrame([(f"routing {number}", "Salem, OR\u00a097301")], "a string, b string")
    found = df.select(rules.scan_rules(F.col("a")).alias("a"), rules.scan_rules(F.col("b")).alias("b"), rules.test_pattern(F.col("b"), zip_rule.pattern).alias("raw")).first()
    assert ("Routing Number", f"routing {number}") in [(d["rule_name"], d["matched_text"]) for d in found["a"]]
    assert found["b"] == [] and [d["matched_text"] for d in found["raw"]] == ["Salem, OR\u00a097301"]
