"""Page-level operators: cleanup of extracted text, hOCR words, matches on pages, wrapping and pagination, model labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import folded, let

PAGE_BREAK = "\n\n--- Page Break ---\n\n"
LINE_BYTES, PAGE_LINES = 90, 50
WORD = "struct<text:string,x:int,y:int,w:int,h:int>"

#: Character entities of hOCR, decoded in this order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


#: A capital or digit at a boundary, a blank or line feed, and the same character again before a letter, digit or the end.
DOUBLED = r"(?<![^ \t\n\r\f])(?:([A-Z0-9]) (?=\1(?:[A-Za-z0-9]|\z))|([A-Z0-9])(?=\n\2(?:[A-Za-z0-9]|\z)))"


def clean_extracted_text(text: Column) -> Column:
    """Text without the doubled first letters that some documents yield: "V Vanguard" is "Vanguard".

    A capital or digit at a boundary, a blank or line feed, and the same character again before a letter, digit or the
    end. One pass from left to right; other characters, non-ASCII ones too, stay as they are.
    """
    return F.regexp_replace(text, DOUBLED, "")


def join_pages(pages: Column) -> Column:
    """Trimmed pages of a document in one text with page-break marks."""
    return F.array_join(F.transform(pages, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), PAGE_BREAK)


def split_pages(text: Column) -> Column:
    return F.split(text, r"\n\n--- Page Break ---\n\n", -1)


def parse_hocr(hocr: Column) -> Column:
    """Words with their boxes out of hOCR, line by line; words without text or with fewer than four numbers are left out."""
    lines = F.filter(F.split(hocr, "\n"), lambda s: s.contains("ocrx_word") & s.rlike(r"bbox \d+\s+\d+\s+\d+\s+\d+") & s.contains("</span>"))
    box = lambda s, i: F.regexp_extract(s, r"bbox (\d+)\s+(\d+)\s+(\d+)\s+(\d+)", i).cast("int")

    def word(s: Column) -> Column:
        text = F.trim(F.regexp_extract(s, r".*>([^>]*)</span>", 1))
        for code, char in ENTITIES:
            text = F.replace(text, F.lit(code), F.lit(char))
        size = lambda a, b: F.greatest(b - a, F.lit(0)).cast("int")
        return F.struct(text.alias("text"), box(s, 1).alias("x"), box(s, 2).alias("y"), size(box(s, 1), box(s, 3)).alias("w"), size(box(s, 2), box(s, 4)).alias("h"))

    return F.filter(F.transform(lines, word), lambda w: w["text"] != "").cast(f"array<{WORD}>")


def page_matches(words: Column, original: Column) -> Column:
    """Positions (from 0) at which the words of ``original`` stand in a row, letter case of ASCII letters aside."""
    target = F.split(F.lower(F.regexp_replace(original, r"(?U)^\s+|\s+$", "")), r"(?U)\s+")
    low = F.transform(words, lambda w: F.lower(w))
    last = F.size(low) - F.size(target)
    at = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(low, i + 1, F.size(target)) == target)
    return F.when(F.trim(original) != "", at).otherwise(F.array().cast("array<int>"))


def page_has_match(words: Column, original: Column) -> Column:
    return F.size(page_matches(words, original)) > 0


def redaction_box(words: Column, at: Column, n: Column, pad: int = 4) -> Column:
    """Box around ``n`` words from position ``at`` with a margin; not left of or above the page."""
    part = F.slice(words, at + 1, n)
    x, y = F.array_min(F.transform(part, lambda w: w["x"])), F.array_min(F.transform(part, lambda w: w["y"]))
    right, below = F.array_max(F.transform(part, lambda w: w["x"] + w["w"])), F.array_max(F.transform(part, lambda w: w["y"] + w["h"]))
    left, top = F.greatest(x - pad, F.lit(0)), F.greatest(y - pad, F.lit(0))
    return F.struct(left.alias("x"), top.alias("y"), (right + pad - left).alias("w"), (below + pad - top).alias("h"))


def is_rotated(words: Column) -> Column:
    """More than a third of the words are more than twice as high as wide."""
    return F.size(F.filter(words, lambda w: w["h"] > 2 * w["w"])) * 3 > F.size(words)


def wrap_line(line: str, width: int = LINE_BYTES) -> list[str]:
    """A line cut after the last blank within ``width`` bytes, else at the last whole character; chunks lose blanks at their end."""
    out = []
    while len(line.encode()) > width:
        head = line.encode()[:width].decode(errors="ignore") or line[0]
        at = head.rfind(" ") + 1 or len(head)
        out.append(line[:at].rstrip())
        line = line[at:]
    return [*out, line] if line or not out else out


def _wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, text in zip(pdf["doc_id"], pdf["text"]):
            body = text[:-1] if text.endswith("\n") else text
            lines = [chunk for line in body.split("\n") for chunk in wrap_line(line.removesuffix("\r"))] if text else [""]
            rows += [(key, i // PAGE_LINES, i % PAGE_LINES, line) for i, line in enumerate(lines)]
        yield pd.DataFrame(rows, columns=["doc_id", "page", "line", "content"])


def wrap_and_paginate(documents: DataFrame) -> DataFrame:
    """(doc_id, page, line, content): lines of at most 90 bytes on pages of 50; an empty text has one empty line."""
    return documents.where("text IS NOT NULL").select("doc_id", "text").mapInPandas(_wrap, "doc_id bigint, page int, line int, content string")


# ---- labels of token classifiers ----------------------------------------------------------------------------------

#: Label categories and the entity type each stands for; others are dropped.
LABEL_TYPES = {
    "PERSON": "PER PERSON GIVENNAME1 GIVENNAME2 LASTNAME1 LASTNAME2 LASTNAME3 first_name last_name",
    "EMAIL": "EMAIL email",
    "PHONE": "TEL phone_number fax_number",
    "ADDRESS": "STREET SECADDRESS BUILDING street_address",
    "SSN": "SOCIALNUMBER ssn national_id tax_id",
    "ACCOUNT": "account_number bank_routing_number credit_debit_card cvv swift_bic",
    "DATE": "date_of_birth BOD",
    "ID_DOCUMENT": "PASSPORT DRIVERLICENSE IDCARD certificate_license_number license_plate vehicle_identifier",
    "IP_ADDRESS": "IP ipv4 ipv6 mac_address",
    "CREDENTIAL": "PASS USERNAME password pin api_key http_cookie user_name",
    "MEDICAL": "health_plan_beneficiary_number medical_record_number biometric_identifier",
    "ID": "customer_id employee_id",
}
#: Fewest bytes of a trimmed entity of a type; two for all others.
LEAST_BYTES = {"PERSON": 5, "ADDRESS": 5, "EMAIL": 5, "PHONE": 7, "SSN": 9, "ACCOUNT": 4}


def decode_bio(text: Column, labels: Column, offsets: Column, label_map: Column) -> Column:
    """Entities out of begin/inside labels of tokens with code-point offsets.

    B opens an entity, I goes on with one of its category and opens one otherwise, anything else closes; a token at
    (0, 0) that isn't the first closes too. Short fragments and persons that aren't capitalised are left out.
    """
    entity = "struct<category:string,start:int,end:int>"
    tokens = F.transform(F.arrays_zip(labels.alias("label"), offsets.alias("span")), lambda t, i: F.struct(F.coalesce(F.try_element_at(label_map, t["label"] + 1), F.lit("O")).alias("label"), t["span"]["start"].alias("start"), t["span"]["end"].alias("end"), i.alias("i")))
    none = F.lit(None).cast(entity)

    def step(entity_open: Column, out: Column, t: Column) -> Column:
        category = F.regexp_replace(t["label"], "^[BI]-", "")
        fresh = F.struct(category.alias("category"), t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end")).cast(entity)
        longer = F.struct(entity_open["category"].alias("category"), entity_open["start"].alias("start"), t["end"].cast("int").alias("end")).cast(entity)
        special = (t["start"] == 0) & (t["end"] == 0) & (t["i"] > 0)
        goes_on = F.coalesce(~special & t["label"].startswith("I-") & (entity_open["category"] == category), F.lit(False))
        now = F.when(goes_on, longer).when(~special & t["label"].rlike("^[BI]-"), fresh).otherwise(none)
        closed = F.when(goes_on | entity_open.isNull(), out).otherwise(F.concat(out, F.array(entity_open)))
        return F.struct(now.alias("state"), closed.alias("out"))

    finish = lambda r: F.when(r["state"].isNull(), r["out"]).otherwise(F.concat(r["out"], F.array(r["state"])))
    entities = let(tokens, lambda t: let(folded(t, none, entity, step), finish))
    types = F.create_map(*(F.lit(x) for kind, names in LABEL_TYPES.items() for name in names.split() for x in (name, kind)))
    typed = lambda e: F.struct(e["start"], e["end"], F.substring(text, e["start"] + 1, e["end"] - e["start"]).alias("matched_text"), F.try_element_at(types, e["category"]).alias("entity_type"))
    inside = F.filter(entities, lambda e: (e["start"] < e["end"]) & (e["end"] <= F.length(text)))
    return F.filter(F.transform(inside, typed), _plausible)


def _plausible(e: Column) -> Column:
    trimmed = F.regexp_replace(e["matched_text"], r"(?U)^\s+|\s+$", "")
    least = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in LEAST_BYTES.items() for x in pair)), e["entity_type"]), F.lit(2))
    cased = trimmed.contains(" ") | trimmed.rlike(r"(?U)^.\p{Ll}*$") | ~trimmed.rlike(r"\p{Ll}")
    person = trimmed.rlike(r"^\p{Lu}") & cased
    return e["entity_type"].isNotNull() & (F.octet_length(trimmed) >= least) & ((e["entity_type"] != "PERSON") | person)
