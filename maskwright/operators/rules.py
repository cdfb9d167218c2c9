"""Rules: named patterns that find one type of entity, their filters, and the scan of a text column by all of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.text import context_of, match_spans, unicode_pattern

DETECTION = "struct<start:int,end:int,matched_text:string,entity_type:string,rule_name:string,ord:int>"
DETECTIONS = f"array<{DETECTION}>"


@dataclass(frozen=True)
class Rule:
    name: str
    entity_type: str
    pattern: str
    description: str = ""
    enabled: bool = True
    built_in: bool = False
    created: datetime = field(default_factory=lambda: datetime(1970, 1, 1, tzinfo=timezone.utc))
    #: A cheap pattern that every text with a match also has.
    hint: str = ""


_STATE_CODES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"

# Names, entity types and patterns of the built-in rules, in their order.
BUILT_IN = (
    Rule("SSN", "SSN", r"\b\d{3}-\d{2}-\d{4}\b", "social security number"),
    Rule("Phone (US)", "PHONE", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "phone number, toll-free ones excluded"),
    Rule("Email", "EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "mail address", hint="@"),
    Rule("Credit Card", "CREDIT_CARD", r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "card number of sixteen digits"),
    Rule("Account Number", "ACCOUNT_NUMBER", r"(?i)(?:account|acct)[\s#:]*(\d[\d\s-]{4,20}\d)", "number after an account label"),
    Rule("Long Number Sequence", "ACCOUNT_NUMBER", r"\b\d{8,20}\b", "eight to twenty digits in a row"),
    Rule("Street Address", "ADDRESS", r"(?im)^\d{1,5}\s+[A-Za-z0-9 ]+(?:ST|STREET|AVE|AVENUE|BLVD|BOULEVARD|DR|DRIVE|LN|LANE|RD|ROAD|CT|COURT|PL|PLACE|WAY|CIR|CIRCLE)\b[, ]*(?:(?:APT|SUITE|STE|UNIT|#)\s*[A-Za-z0-9]*)?", "street line"),
    Rule("City State Zip", "ADDRESS", rf"(?i)\b[A-Z][A-Za-z ]+,?\s+(?:{_STATE_CODES})\s+\d{{5}}(?:-\d{{4}})?\b", "city, state and postal code", hint=r"\s\d{5}"),
    Rule("Date of Birth", "DATE_OF_BIRTH", r"(?i)(?:d\.?o\.?b\.?|date of birth|born|birthday)[\s:]*(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})", "date after a birth label"),
    Rule("Passport Number", "ID_DOCUMENT", r"(?i)(?:passport)[\s#:]*([A-Z0-9]{6,9})", "passport number"),
    Rule("Driver's License", "ID_DOCUMENT", r"(?i)(?:driver'?s?\s*(?:license|licence|lic)|DL)[\s#:]*([A-Z0-9]{4,15})", "driving licence number"),
    Rule("Routing Number", "ACCOUNT_NUMBER", r"(?i)(?:routing|aba|ach)[\s#:]*(\d{9})\b", "bank routing number", hint=r"\d{9}"),
    Rule("ITIN", "SSN", r"\b9\d{2}-\d{2}-\d{4}\b", "taxpayer number"),
    Rule("Medicare/Insurance ID", "ID_DOCUMENT", r"(?i)(?:medicare|medicaid|member|subscriber|policy|group)[\s#:]*(?:id|number|no)?[\s#:]*([A-Z0-9]{6,15})", "insurance number"),
)
BUILT_IN = tuple(replace(r, built_in=True) for r in BUILT_IN)

#: Area codes of toll-free numbers.
TOLL_FREE = ("800", "833", "844", "855", "866", "877", "888")


class InvalidPattern(ValueError):
    """A rule's pattern is no regular expression."""


def check_pattern(pattern: str, spark: SparkSession | None = None) -> str:
    """The pattern, if the engine that will run it compiles it."""
    spark = spark or SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark._jvm.java.util.regex.Pattern.compile(unicode_pattern(pattern))
        else:
            re.compile(pattern)
    except Exception as e:
        raise InvalidPattern(f"{pattern!r} is no valid pattern") from e
    return pattern


class RuleStore:
    """The user's own rules in order; a rule added under a known name replaces it and moves to the end."""

    def __init__(self, rules: tuple[Rule, ...] = ()):
        self.rules = list(rules)

    def add(self, rule: Rule) -> None:
        check_pattern(rule.pattern)
        self.rules = [r for r in self.rules if r.name != rule.name] + [replace(rule, built_in=False)]

    def remove(self, name: str) -> bool:
        kept = [r for r in self.rules if r.name != name]
        removed = len(kept) < len(self.rules)
        self.rules = kept
        return removed

    def list(self) -> list[Rule]:
        return list(self.rules)


def active_rules(custom: tuple[Rule, ...] = ()) -> tuple[Rule, ...]:
    """Built-in rules and then the enabled custom ones up to the first with an invalid pattern."""
    kept = []
    for rule in custom:
        if not rule.enabled:
            continue
        try:
            check_pattern(rule.pattern)
        except InvalidPattern:
            break
        kept.append(rule)
    return BUILT_IN + tuple(kept)


def rules_frame(spark: SparkSession, rules: tuple[Rule, ...] = BUILT_IN) -> DataFrame:
    """One row per rule."""
    rows = [(r.name, r.description, r.pattern, r.entity_type, r.enabled, r.built_in, r.created) for r in rules]
    return spark.createDataFrame(rows, "name string, description string, pattern string, entity_type string, enabled boolean, built_in boolean, created timestamp")


def is_toll_free(number: Column) -> Column:
    """Ten digits or more (eleven with a leading 1) whose area code is toll-free."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    area = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 3)).when(F.length(digits) >= 10, F.substring(digits, 1, 3))
    return F.coalesce(area.isin(*TOLL_FREE), F.lit(False))


def is_garbage_address(address: Column) -> Column:
    """Not ASCII, or more than half of it neither letters, digits, blanks nor usual punctuation."""
    odd = F.length(F.regexp_replace(address, r"[A-Za-z0-9 \-,.#]", ""))
    return address.rlike(r"[^\x00-\x7F]") | (odd * 2 > F.length(address))


def rule_spans(text: Column, rule: Rule, order: int = 0) -> Column:
    """Detections of one rule; the whole match is the span, labels included."""
    spans = match_spans(text, rule.pattern)
    if rule.hint:
        spans = F.when(text.rlike(unicode_pattern(rule.hint)), spans).when(text.isNotNull(), F.array().cast("array<struct<start:int,end:int,matched_text:string>>"))
    if rule.entity_type == "PHONE":
        spans = F.filter(spans, lambda s: ~is_toll_free(s["matched_text"]))
    elif rule.entity_type == "ADDRESS":
        spans = F.filter(spans, lambda s: ~is_garbage_address(s["matched_text"]))
    full = lambda s: F.struct(s["start"], s["end"], s["matched_text"], F.lit(rule.entity_type).alias("entity_type"), F.lit(rule.name).alias("rule_name"), F.lit(order).alias("ord"))
    return F.transform(spans, full)


def scan_rules(text: Column, rules: tuple[Rule, ...] = BUILT_IN) -> Column:
    """Detections of all enabled rules in order of start, at one start in the order of the rules. Null text gives null."""
    found = F.concat(*(rule_spans(text, r, i) for i, r in enumerate(rules) if r.enabled))
    key = lambda d: F.struct(d["start"], d["ord"], d["end"], d["matched_text"], d["entity_type"], d["rule_name"])
    back = lambda k: F.struct(k["start"], k["end"], k["matched_text"], k["entity_type"], k["rule_name"], k["ord"])
    return F.transform(F.array_sort(F.transform(found, key)), back)


def test_pattern(text: Column, pattern: str) -> Column:
    """What a pattern would find: detections of type TEST without any filter."""
    check_pattern(pattern)
    full = lambda s: F.struct(s["start"], s["end"], s["matched_text"], F.lit("TEST").alias("entity_type"), F.lit("test").alias("rule_name"), F.lit(0).alias("ord"))
    return F.transform(match_spans(text, pattern), full)


test_pattern.__test__ = False  # a query, no test case


def with_context(detection: Column, text: Column) -> Column:
    return detection.withField("context", context_of(text, detection["start"], detection["end"]))
