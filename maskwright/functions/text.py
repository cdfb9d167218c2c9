"""Column expressions on text: spans of a pattern, contexts, byte offsets, let-bindings."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of context on either side of a match.
CONTEXT_BYTES = 40


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unicode_pattern(pattern: str) -> str:
    """The pattern with Unicode-aware classes and boundaries in Java's dialect."""
    return "(?U)" + pattern


#: Elements that a fold takes at a time.
BLOCK = 64


def folded(items: Column, state: Column, out: str, step: Callable[[Column, Column, Column], Column]) -> Column:
    """Stateful pass over an array: struct of the last ``state`` and the list ``out`` (of the given element type).

    ``step(state, out, item)`` gives ``struct(state, out)``. The engine copies an accumulator at every step, so the list
    grows in blocks: a fold over blocks of folds copies it once a block, not once an item.
    """
    none = F.array().cast(f"array<{out}>")
    held = lambda s, o: F.struct(s.alias("state"), o.alias("out"))
    inner = lambda s, block: F.aggregate(block, held(s, none), lambda acc, x: step(acc["state"], acc["out"], x))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(items, i, BLOCK))
    outer = lambda acc, block: let(inner(acc["state"], block), lambda r: held(r["state"], F.concat(acc["out"], r["out"])))
    return F.when(F.size(items) <= BLOCK, inner(state, items)).otherwise(F.aggregate(blocks, held(state, none), outer))


SPAN = "struct<start:int,end:int,matched_text:string>"
SPANS = "array<struct<start:int,end:int,matched_text:string>>"


def can_be_empty(pattern: str) -> bool:
    """The pattern matches the empty string; patterns of Java's dialect alone are taken not to."""
    try:
        return re.search(pattern, "") is not None
    except re.error:
        return False


def _spans_in_arrow(pattern: str) -> Callable[[Column], Column]:
    compiled = re.compile(pattern)

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[(m.start(), m.end(), m.group()) for m in compiled.finditer(t) if m.end() > m.start()] if t is not None else None for t in texts])

    return run


def match_spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, matched_text>>`` of all matches, in code points, end exclusive.

    The matches and the gaps between them come from two built-in regular-expression functions; running lengths give the
    offsets. Null text gives null; texts without a match cost one test. Patterns that can match nothing would put gaps and
    matches out of step; they run over Arrow batches, and their empty matches are left out.
    """
    if can_be_empty(pattern):
        return _spans_in_arrow(pattern)(text)
    java = unicode_pattern(pattern)
    pairs = F.arrays_zip(F.split(text, java, -1).alias("gap"), F.regexp_extract_all(text, F.lit(java), F.lit(0)).alias("hit"))

    def step(at: Column, out: Column, pair: Column) -> Column:
        begin = at + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        span = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), pair["hit"].alias("matched_text"))
        return F.struct(end.cast("int").alias("state"), F.concat(out, F.array(span)).alias("out"))

    hits = F.filter(pairs, lambda p: p["hit"].isNotNull())
    found = let(hits, lambda h: folded(h, F.lit(0), SPAN, step)["out"])
    return F.when(text.rlike(java), found).when(text.isNotNull(), F.array().cast(SPANS))


def _edge(near: Column, take: Callable[[Column, Column], Column]) -> Column:
    """Fewest characters of ``near``, next to the match, that make at least ``CONTEXT_BYTES`` bytes; all if it has fewer."""
    counted = F.filter(F.sequence(F.lit(1), F.lit(CONTEXT_BYTES)), lambda k: F.octet_length(take(near, k)) >= CONTEXT_BYTES)
    return F.when(F.octet_length(near) == F.length(near), near).otherwise(F.coalesce(take(near, F.try_element_at(counted, F.lit(1))), near))


def context_of(text: Column, start: Column, end: Column) -> Column:
    """The match with 40 bytes on either side, widened outward to whole characters; ``...`` where text is cut off."""
    first = F.greatest(start - CONTEXT_BYTES, F.lit(0))
    near = F.substring(text, first + 1, end - first + CONTEXT_BYTES)  # the one place where the whole text is walked
    length = F.length(text)

    def framed(part: Column) -> Column:
        head, tail = _edge(F.left(part, start - first), F.right), _edge(F.substring(part, end - first + 1, F.lit(CONTEXT_BYTES)), F.left)
        middle = F.substring(part, start - first + 1, end - start)
        cut_head = F.when(F.length(head) < start, F.lit("...")).otherwise(F.lit(""))
        cut_tail = F.when(F.length(tail) < length - end, F.lit("...")).otherwise(F.lit(""))
        return F.concat(cut_head, head, middle, tail, cut_tail)

    return let(near, framed)


def byte_offset(text: Column, at: Column) -> Column:
    """UTF-8 offset of the code-point offset ``at``."""
    return F.octet_length(F.substring(text, F.lit(1), at))


def in_parts(text: Column, spans: Column, of: Callable[[Column, Column, Column], Column]) -> Column:
    """``of(part, base, group)`` for the spans in groups of ``BLOCK``, as an array: disjoint spans in order of place.

    ``part`` is the text from ``base``, the end of the group before, to the end of the group. To find a place in a text
    costs its length; so the text is walked once for each group, and for each span only the group's part.
    """

    def group(i: Column) -> Column:
        mine = F.slice(spans, i, BLOCK)
        base = F.when(i > 1, F.try_element_at(spans, F.when(i > 1, i - 1).otherwise(1))["end"]).otherwise(F.lit(0))
        return let(F.struct(base.cast("int").alias("base"), mine.alias("mine"), F.substring(text, base + 1, F.element_at(mine, -1)["end"] - base).alias("part")), lambda g: of(g["part"], g["base"], g["mine"]))

    return F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(BLOCK)), group)


def with_bytes(text: Column, spans: Column) -> Column:
    """Disjoint spans in order, each with ``start_byte`` and ``end_byte``."""

    def placed(part: Column, base: Column, mine: Column) -> Column:
        def one(at: Column) -> Column:
            def full(d: Column) -> Column:
                begin = at + F.octet_length(F.left(part, d["start"] - base))
                return d.withField("start_byte", begin.cast("int")).withField("end_byte", (begin + F.octet_length(d["matched_text"])).cast("int"))

            return F.transform(mine, full)

        return let(byte_offset(text, base), one)

    return F.when(F.size(spans) > 0, F.flatten(in_parts(text, spans, placed)))


def utf16_offset(text: Column, at: Column) -> Column:
    """UTF-16 code units before the code-point offset ``at``."""
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), at), "UTF-16BE")) / 2).cast("int")


def from_utf16_offset(text: Column, at: Column) -> Column:
    """Code-point offset of a UTF-16 offset: units less the surrogate pairs before it."""
    units = F.transform(F.split(text, ""), lambda c: (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))
    begin = F.struct(F.lit(0).alias("units"), F.lit(0).alias("points"))
    step = lambda acc, u: F.when(acc["units"] + u <= at, F.struct((acc["units"] + u).alias("units"), (acc["points"] + 1).alias("points"))).otherwise(F.struct((at + 1).cast("int").alias("units"), acc["points"].alias("points")))
    return F.aggregate(F.filter(units, lambda u: u > 0), begin, step, lambda acc: acc["points"])
