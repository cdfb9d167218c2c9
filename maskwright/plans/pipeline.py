"""The whole pipeline as one lazy plan: detect, merge, propagate, filter, resolve, rewrite.

Detection and rewriting are narrow. The rules run in the JVM before the name detector, whose Arrow stage also keeps the
optimiser from evaluating them twice; folds over one array bind it once. Only ignore list and mappings are joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.covers import cover_value
from maskwright.functions.filters import passes, value_filter
from maskwright.functions.text import let, with_bytes
from maskwright.operators.names import dictionary_detector
from maskwright.operators.resolve import resolve_inline
from maskwright.operators.rules import DETECTIONS, BUILT_IN, Rule, scan_rules, with_context
from maskwright.operators.spans import apply_replacements, merge_spans, propagate_persons
from maskwright.runtime import cut, exploded, written

Detector = Callable[[Column], Column]


def detect(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BUILT_IN, detectors: list[Detector] | None = None) -> DataFrame:
    """``documents`` with ``detections``: rules and detectors merged, names propagated, merged again.

    A detector is any function from a text column to a detections column. Null text gives an empty array.
    """
    detectors = [dictionary_detector()] if detectors is None else detectors
    found = documents.withColumn("_rules", F.coalesce(scan_rules(F.col(text), rules), F.array().cast(DETECTIONS)))
    for i, detector in enumerate(detectors):
        found = found.withColumn(f"_names{i}", detector(F.col(text)))
    every = F.concat("_rules", *(f"_names{i}" for i in range(len(detectors))))
    merged = let(merge_spans(every), lambda m: F.when(F.exists(m, lambda d: d["entity_type"] == "PERSON"), propagate_persons(F.col(text), m)).otherwise(m))
    return found.withColumn("detections", F.coalesce(merged, F.array().cast(DETECTIONS))).drop("_rules", *(f"_names{i}" for i in range(len(detectors))))


def detection_rows(detected: DataFrame, key: list[str], text: str = "text", context: bool = True) -> DataFrame:
    """One row per detection: key, offsets in code points and bytes, matched text, type, rule and context."""
    item = (lambda d: with_context(d, F.col(text))) if context else (lambda d: d)
    rows = exploded(detected, key, F.transform(with_bytes(F.col(text), F.col("detections")), item))
    cols = ["matched_text", "entity_type", "rule_name", "start", "end", *(["context"] if context else []), "start_byte", "end_byte"]
    return rows.select(*key, *(F.col(f"d.{c}").alias(c) for c in cols))


def anonymise(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BUILT_IN, detectors: list[Detector] | None = None) -> DataFrame:
    """``documents`` with ``detections`` and ``output_text``, all detections accepted with generated covers; no shuffle."""
    found = detect(documents, text, rules, detectors)
    return found.withColumn("output_text", apply_replacements(F.col(text), resolve_inline(F.col("detections"))))


def anonymise_with_stores(documents: DataFrame, key: str, mappings: DataFrame, ignored: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BUILT_IN, detectors: list[Detector] | None = None) -> DataFrame:
    """(key, text, output_text, accepted): covers from ``mappings(original, stored)`` first, ignored texts left alone.

    Detections are kept with their texts in a table. The distinct values that occur meet the stores; documents with a
    value that is stored or ignored, which a filter of fixed size tells, are shuffled to meet it. All others are rewritten
    where they lie.
    """
    found = written(detect(documents, text, rules, detectors).select(key, text, "detections"))
    own = exploded(found, [key], F.col("detections.matched_text"), "matched_text").distinct()
    values = own.select("matched_text").distinct()
    listed = ignored.where("text IS NOT NULL").select(F.lower("text").alias("low"), F.lit(True).alias("listed")).distinct()
    known = values.join(mappings.toDF("matched_text", "stored"), "matched_text", "left").join(listed, F.lower("matched_text") == F.col("low"), "left").where("stored IS NOT NULL OR listed")
    said = cut(own.join(known, "matched_text").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("matched_text", F.struct("stored", "listed")))).alias("said")))
    row = F.xxhash64(key)
    concerned = passes(value_filter(said.select(row.alias("h")), "h"), row)
    near = found.where(concerned).join(said, key, "left")
    far = found.where(~concerned).withColumn("said", F.lit(None).cast(said.schema["said"].dataType))
    every = near.select(far.columns).unionByName(far)

    def covered(d: Column) -> Column:
        own = F.try_element_at("said", d["matched_text"])
        cover = F.coalesce(own["stored"], cover_value(d["matched_text"], d["entity_type"]))
        return F.struct(d["start"], d["end"], cover.alias("replacement"), own["listed"].isNull().alias("accepted"))

    spans = F.filter(F.transform("detections", covered), lambda d: d["accepted"])
    return every.select(key, text, spans.alias("spans")).select(key, text, apply_replacements(F.col(text), F.col("spans")).alias("output_text"), F.coalesce(F.size("spans"), F.lit(0)).alias("accepted"))
