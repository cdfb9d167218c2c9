"""Deterministic cover values: a 64-bit hash of the original picks the replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.text import let

# Given names of cover persons.
FIRST_NAMES = """
Alexander Beatrice Cassius Diana Eleanor Frederick Genevieve Hamilton Isabella Jasper Katherine Leopold Madeline
Nathaniel Ophelia Percival Quinn Rosalind Sebastian Theodora Ulysses Victoria Wellington Xenophon Yolanda Zacharias
Ambrose Cordelia Desmond Evangeline Florence Gideon Harriet Ignatius Josephine Kingston Lavinia Montgomery Nicolette
Octavian Penelope Quentin Reginald Seraphina Thaddeus Ursula Valentine Winifred Xander Yvette
""".split()

# Family names of cover persons.
LAST_NAMES = """
Ashworth Blackwood Cromwell Darlington Fairfax Gladstone Hartwell Ironside Kingsley Lancaster Montague Northcott
Pemberton Radcliffe Sinclair Thornton Underwood Whitmore Ashford Beaumont Carlisle Drummond Eastwood Fitzgerald Grayson
Holloway Inglewood Jennings Kensington Lockhart Merriweather Nightingale Ogilvie Pennington Queensbury Ravenswood
Stanhope Templeton Vanburen Wainwright Abernathy Burlington Castleton Devereaux Ellington Foxworth Grimshaw Hawthorne
Islington Jeffords
""".split()

# Parts of cover addresses.
STREETS = "Maple Oak Cedar Elm Pine Birch Walnut Cherry Willow Spruce Ash Holly Laurel Hazel Ivy".split()
STREET_TYPES = "St Ave Blvd Dr Ln Rd Ct Pl Way".split()
CITIES = "Springfield Riverdale Fairview Madison Georgetown Clinton Arlington Burlington Chester Franklin Greenville Lexington Milton Oakland Salem".split()
STATES = "CA TX FL NY IL PA OH GA NC MI NJ VA WA AZ MA".split()

# Offset basis and low part of the prime (2^40 + 435) of the 64-bit FNV-1a hash.
OFFSET_HIGH, OFFSET_LOW, PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
_MASK = 0xFFFFFFFF


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as DECIMAL(20, 0).

    The state is kept as two 32-bit halves in BIGINTs, so no step overflows and none needs decimals: a product with
    2^40 + 435 is the low half times 435 with its carry, and the high half takes the low one shifted by eight more.
    """
    high, low, mask = (F.lit(x).cast("bigint") for x in (OFFSET_HIGH, OFFSET_LOW, _MASK))
    digits = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))

    def step(acc: Column, pair: Column) -> Column:
        mixed = acc["low"].bitwiseXOR(F.conv(pair, 16, 10).cast("bigint"))
        product = mixed * PRIME_LOW
        upper = acc["high"] * PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(mixed, 8)
        return F.struct(upper.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    whole = lambda acc: (acc["high"].cast("decimal(10,0)") * F.lit(1 << 32).cast("decimal(10,0)") + acc["low"].cast("decimal(10,0)")).cast("decimal(20,0)")
    return F.aggregate(digits, F.struct(high.alias("high"), low.alias("low")), step, whole)


def _part(h: Column, divisor: int, modulus: int) -> Column:
    """floor(h / divisor) mod modulus as BIGINT, exactly."""
    below = h - h % divisor if divisor > 1 else h
    return F.floor(below % (divisor * modulus) / divisor).cast("bigint")


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _name_of(h: Column) -> Column:
    return F.concat(_pick(FIRST_NAMES, _part(h, 1, len(FIRST_NAMES))), F.lit(" "), _pick(LAST_NAMES, _part(h, len(FIRST_NAMES), len(LAST_NAMES))))


def cover_name(original: Column) -> Column:
    return let(fnv1a(original), _name_of)


def cover_phone(original: Column) -> Column:
    return let(fnv1a(original), lambda h: F.concat(F.lit("(555) 555-"), _padded(_part(h, 1, 10_000), 4)))


def cover_ssn(original: Column) -> Column:
    return let(fnv1a(original), lambda h: F.concat(F.lit("900-"), _padded(_part(h, 1, 100), 2), F.lit("-"), _padded(_part(h, 100, 10_000), 4)))


def cover_email(original: Column) -> Column:
    return let(fnv1a(original), lambda h: F.concat(F.replace(F.lower(_name_of(h)), F.lit(" "), F.lit(".")), F.lit("@example.com")))


def cover_account(original: Column) -> Column:
    """Every ASCII digit is replaced by the next decimal digit of the hash; used up, the hash of the result so far goes on.

    All other characters stay, so the format is kept.
    """
    zero = F.lit(0).cast("decimal(20,0)")
    tenth = lambda n: ((n - n % 10) / 10).cast("decimal(20,0)")

    def step(acc: Column, ch: Column) -> Column:
        digit = F.concat(acc["out"], (acc["seed"] % 10).cast("int").cast("string"))
        left = tenth(acc["seed"])
        fresh = F.when(left == zero, fnv1a(digit)).otherwise(left)
        return F.when(ch.rlike("^[0-9]$"), F.struct(fresh.alias("seed"), digit.alias("out"))).otherwise(F.struct(acc["seed"].alias("seed"), F.concat(acc["out"], ch).alias("out")))

    return F.aggregate(F.split(original, ""), F.struct(fnv1a(original).alias("seed"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def cover_address(original: Column) -> Column:
    """City form for values with a state code or five digits that don't begin with a number, street form for all others."""
    digits = F.length(F.regexp_replace(original, "[^0-9]", ""))
    placed = original.rlike("|".join(STATES)) | (digits >= 5)
    numbered = F.trim(original).rlike(r"(?U)^[0-9]+(\s|$)")

    def build(h: Column) -> Column:
        city = F.concat(_pick(CITIES, _part(h, 1, 15)), F.lit(", "), _pick(STATES, _part(h, 15, 15)), F.lit(" "), (_part(h, 100, 90_000) + 10_000).cast("string"))
        street = F.concat_ws(" ", (_part(h, 1, 900) + 100).cast("string"), _pick(STREETS, _part(h, 1000, 15)), _pick(STREET_TYPES, _part(h, 100_000, 9)))
        unit = F.when(F.upper(original).rlike("APT|UNIT|STE"), F.concat(F.lit(" Apt "), (_part(h, 1, 20) + 1).cast("string"))).otherwise(F.lit(""))
        return F.when(placed & ~numbered, city).otherwise(F.concat(street, unit))

    return let(fnv1a(original), build)


def cover_value(original: Column, entity_type: Column) -> Column:
    """The cover for a value of a type; types without a form of their own get a name. A null original stays null."""
    made = (
        F.when(entity_type == "PHONE", cover_phone(original))
        .when(entity_type == "SSN", cover_ssn(original))
        .when(entity_type == "EMAIL", cover_email(original))
        .when(entity_type.isin("ACCOUNT_NUMBER", "CREDIT_CARD"), cover_account(original))
        .when(entity_type == "ADDRESS", cover_address(original))
        .otherwise(cover_name(original))
    )
    return F.when(original.isNotNull(), made)
