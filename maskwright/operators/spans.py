"""Span algebra: overlap merge, propagation of person names, rewriting of text by spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.text import folded, in_parts, let
from maskwright.operators.rules import DETECTION, DETECTIONS

#: Order of detections found by propagation, after all detectors.
PROPAGATED = 1_000


def _sorted(detections: Column) -> Column:
    key = lambda d: F.struct(d["start"], (-d["end"]).alias("minus_end"), d["ord"], d["end"], d["matched_text"], d["entity_type"], d["rule_name"])
    back = lambda k: F.struct(k["start"], k["end"], k["matched_text"], k["entity_type"], k["rule_name"], k["ord"]).cast(DETECTION)
    return F.transform(F.array_sort(F.transform(detections, key)), back)


def merge_spans(detections: Column) -> Column:
    """Disjoint detections: of two overlapping ones the longer in bytes stays, at a tie the earlier.

    Sorted by start, longer first, then by the order of detectors, the spans are folded; each is compared with the last
    kept one only, so the result isn't transitive. Touching spans don't overlap. Null gives null.
    """

    def step(last: Column, out: Column, d: Column) -> Column:
        longer = F.octet_length(d["matched_text"]) > F.octet_length(last["matched_text"])
        held = lambda s, o: F.struct(s.cast(DETECTION).alias("state"), o.alias("out"))
        return F.when(last.isNull(), held(d, out)).when(d["start"] >= last["end"], held(d, F.concat(out, F.array(last)))).when(longer, held(d, out)).otherwise(held(last, out))

    whole = let(_sorted(detections), lambda s: let(folded(s, F.lit(None).cast(DETECTION), DETECTION, step), lambda r: F.concat(r["out"], F.array(r["state"]))))
    return F.when(F.size(detections) < 2, detections).otherwise(whole)


def _positions(low: Column, name: Column) -> Column:
    """Start of every occurrence of ``name`` in ``low``, overlapping ones included."""
    literal = F.regexp_replace(name, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    pieces = F.split(F.concat(F.lit("\u0001"), low), F.concat(F.lit("(?="), literal, F.lit(")")), -1)
    walk = lambda at, out, p: F.struct((at + F.length(p)).cast("int").alias("state"), F.concat(out, F.array((at + F.length(p)).cast("int"))).alias("out"))
    return let(pieces, lambda p: folded(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.lit(-1), "int", walk)["out"])


def propagate_persons(text: Column, merged: Column) -> Column:
    """Every further occurrence of a detected person's name, in any case and inside words too, unless a detection covers it.

    The result is merged again. Where lower case changes the length of the text, names are looked for as they stand.
    """
    safe = F.when(F.length(F.lower(text)) == F.length(text), F.lower(text)).otherwise(text)
    persons = F.filter(merged, lambda d: (d["entity_type"] == "PERSON") & (F.length(d["matched_text"]) > 0))

    def extra(low: Column) -> Column:
        names = F.array_distinct(F.transform(persons, lambda d: F.when(F.length(F.lower(text)) == F.length(text), F.lower(d["matched_text"])).otherwise(d["matched_text"])))

        def of(name: Column) -> Column:
            span = lambda at: F.struct(
                at.alias("start"), (at + F.length(name)).cast("int").alias("end"), F.substring(text, at + 1, F.length(name)).alias("matched_text"),
                F.lit("PERSON").alias("entity_type"), F.lit("Global match").alias("rule_name"), F.lit(PROPAGATED).alias("ord"),
            )
            covered = lambda s: F.exists(merged, lambda d: (d["start"] <= s["start"]) & (d["end"] >= s["end"]))
            return F.filter(F.transform(_positions(low, name), span), lambda s: ~covered(s))

        return F.flatten(F.transform(names, of))

    more = F.when(F.size(persons) > 0, let(safe, extra)).otherwise(F.array().cast(DETECTIONS))
    return let(more.cast(DETECTIONS), lambda m: F.when(F.size(m) == 0, merged).otherwise(merge_spans(F.concat(merged, m))))


def apply_replacements(text: Column, resolved: Column) -> Column:
    """``text`` with the accepted spans replaced; ``resolved`` are disjoint structs with start, end, replacement, accepted.

    Pieces are cut from left to right, in parts of the text. Spans that aren't accepted, and texts without any, stay.
    """
    spans = F.array_sort(F.transform(F.filter(resolved, lambda d: d["accepted"]), lambda d: F.struct(d["start"], d["end"], d["replacement"])))
    step = lambda at, out, d, part, base: F.struct(d["end"].cast("int").alias("at"), F.concat(out, F.substring(part, at - base + 1, d["start"] - at), d["replacement"]).alias("out"))

    def rewritten(part: Column, base: Column, mine: Column) -> Column:
        return F.aggregate(mine, F.struct(base.alias("at"), F.lit("").alias("out")), lambda acc, d: step(acc["at"], acc["out"], d, part, base), lambda acc: acc["out"])

    whole = lambda s: F.concat(F.array_join(in_parts(text, s, rewritten), ""), F.substring(text, F.element_at(s, -1)["end"] + 1, F.length(text)))
    return let(spans, lambda s: F.when(F.size(s) > 0, whole(s)).otherwise(text))
