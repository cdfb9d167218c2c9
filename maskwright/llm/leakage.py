"""Problem 8: passages of held-out items inside corpus documents.

Template canonicalisation: numbers, units and names become typed placeholders, by their own form on either side, so no
word list has to travel. Windows of template words are hashed and joined, a table of the items' windows with the windows
of the documents; a hit gives a diagonal (document, item, offset), on which the words are then compared one by one. For
questions asked again with other names and numbers the slots are compared too: what the item names alike the document
must name alike.

One narrow pass reads the corpus. A filter of fixed size over the items' windows decides which documents leave it, as
hashes of their words; the others, nearly all, are never shuffled. Items are only ever tables.

Words are compared in lower case, so two forms of template are made: one of single words without names, which no
difference in case can break, and one in which names, however many words long, are one placeholder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.filters import FILTER_BITS, may_hold, value_filter
from maskwright.llm.blocks import text_hash
from maskwright.runtime import written

#: Words of a window. Twenty running words with at most one in eight altered always hold six unaltered ones in a row.
WINDOW = 6
#: Words of a window that must be no slots; with fewer, as in columns of figures, the words themselves are hashed.
LEAST_PLAIN = 3
#: Words of a passage that make a leak, and the words of them for each altered one.
MIN_WORDS, PER_ALTERED = 20, 8
#: The windows of the items are dealt out to so many copies each, so a window or item met by a third of all documents
#: is joined in as many tasks.
SALTS = 4

_TOKEN = re.compile(r"[^\W_]+|[.?!:;](?=\s)")
#: Words of measure.
UNITS = frozenset("mm cm m km kg g mg lb lbs oz inch inches foot feet mile miles metre metres meter litre litres liter percent dollars dollar euros euro pounds cents".split())

PLAIN, NUMBER, NAME, UNIT, STOP = 0, 1, 2, 3, 9


def kind_of(word: str) -> int:
    """Type of a word by its own form; a capitalised word is a name unless it begins a sentence, which the caller sees."""
    if not word[0].isalnum():
        return STOP
    if word.isdigit():
        return NUMBER
    if word.lower() in UNITS:
        return UNIT
    return NAME if len(word) > 1 and word[0].isupper() and word[1:].islower() else PLAIN


class Lexicon(dict):
    """Place, hash and type of each word met by a task, worked out once; forgotten when there are too many."""

    LIMIT = 300_000

    def __init__(self) -> None:
        super().__init__()
        self.raw, self.kind = np.empty(1024, np.uint64), np.empty(1024, np.int8)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.raw):
            self.raw, self.kind = np.concatenate([self.raw, self.raw]), np.concatenate([self.kind, self.kind])
        self.raw[at], self.kind[at] = text_hash(word.lower()), kind_of(word)
        self[word] = at
        return at

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.LIMIT:
            self.clear()
        index = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.raw[index], self.kind[index]


def take_apart(text: str, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, their types, parts, their types): hashes of single words, and of the same with each run of names as one."""
    raw, kind = lexicon.of(_TOKEN.findall(text))
    stop = kind == STOP
    begins = np.concatenate([[True], stop[:-1]]) if len(stop) else stop
    kind = np.where(begins & (kind == NAME), PLAIN, kind)[~stop]
    raw = raw[~stop]
    if not len(raw):
        return raw, kind, raw, kind
    starts = np.flatnonzero(~((kind == NAME) & np.concatenate([[False], kind[:-1] == NAME])))
    with np.errstate(over="ignore"):
        parts = np.add.reduceat(raw, starts)
    return raw, np.where(kind == NAME, PLAIN, kind), parts, kind[starts]


def _mixed(symbols: np.ndarray, salt: int) -> np.ndarray:
    n = len(symbols) - WINDOW + 1
    h = np.full(n, salt, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + symbols[k : k + n] * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
    return h


def windows(raw: np.ndarray, kind: np.ndarray, salt: int) -> np.ndarray:
    """Hash of each window of template symbols; ``salt`` keeps the two forms of template apart."""
    if len(raw) < WINDOW:
        return np.empty(0, np.uint64)
    h = _mixed(np.where(kind == PLAIN, raw, kind.astype(np.uint64)), salt)
    slots = np.cumsum(np.concatenate([[0], kind != PLAIN]))
    bare = slots[WINDOW:] - slots[:-WINDOW] > WINDOW - LEAST_PLAIN
    return np.where(bare, _mixed(raw, salt + 2), h) if bare.any() else h


def _both(text: str, lexicon: Lexicon) -> tuple[tuple, np.ndarray, np.ndarray]:
    """What is compared later, and hashes and places of all windows; places of the second form are 2 * n + 1."""
    words, kinds, parts, types = take_apart(text, lexicon)
    a, b = windows(words, kinds, 1), windows(parts, types, 2)
    return (words, parts, types), np.concatenate([a, b]), np.concatenate([2 * np.arange(len(a)), 2 * np.arange(len(b)) + 1])


def longest_stretch(words: np.ndarray, passage: np.ndarray, offset: int) -> int:
    """Longest stretch of the diagonal with at most one word in ``PER_ALTERED`` altered; it starts and ends with a match."""
    a, b = max(0, -offset), min(len(passage), len(words) - offset)
    if b - a < MIN_WORDS:
        return 0
    same = words[a + offset : b + offset] == passage[a:b]
    # MIN_WORDS words in a row of any stretch have at most four altered: with n words and n // 8 altered, below 40 words
    # there are four at most, from 40 on the stretch falls into rows of MIN_WORDS of which one has no more than the mean
    equal = np.cumsum(same)
    if equal[-1] < MIN_WORDS - 4 or (equal[MIN_WORDS - 1 :] - np.concatenate([[0], equal[:-MIN_WORDS]])).max() < MIN_WORDS - 4:
        return 0
    # position k has height PER_ALTERED * (altered before k) - k; a stretch i..j is allowed if height[j] <= height[i]
    height = np.concatenate([[0], np.cumsum(np.where(same, -1, PER_ALTERED - 1))])
    best_before = np.maximum.accumulate(height)
    best = 0
    for j in range(MIN_WORDS, len(height)):
        if best_before[j - MIN_WORDS] >= height[j]:
            i = int(np.searchsorted(best_before[: j - MIN_WORDS + 1], height[j]))
            best = max(best, j - i)
    return best


def longest_template(doc: np.ndarray, doc_types: np.ndarray, item: np.ndarray, item_types: np.ndarray, offset: int) -> tuple[int, int]:
    """(parts, changed slots) of the longest stretch of the diagonal in which plain words are equal and slots consistent.

    Consistent: of the same type, and within the stretch the same value of the item always has the same value in the
    document and the other way round. At least half of the parts must be plain words.
    """
    a, b = max(0, -offset), min(len(item), len(doc) - offset)
    if b - a < MIN_WORDS:
        return 0, 0
    x, tx, y, ty = doc[a + offset : b + offset], doc_types[a + offset : b + offset], item[a:b], item_types[a:b]
    fits = (tx == ty) & ((tx != PLAIN) | (x == y))
    edges = np.flatnonzero(np.concatenate([[True], ~fits, [True]]))
    best = (0, 0)
    for k in np.flatnonzero(np.diff(edges) > MIN_WORDS).tolist():
        run = slice(int(edges[k]), int(edges[k + 1]) - 1)
        best = max(best, _consistent(x[run], y[run], np.flatnonzero(tx[run] != PLAIN)))
    return best


def _consistent(x: np.ndarray, y: np.ndarray, slots: np.ndarray) -> tuple[int, int]:
    """``longest_template`` within a run that fits in its types and plain words."""
    best, start = (0, 0), 0
    there: dict[int, tuple[int, int]] = {}
    back: dict[int, tuple[int, int]] = {}

    def closed(end: int) -> tuple[int, int]:
        own, n = slots[(slots >= start) & (slots < end)], end - start
        return (n, int((x[own] != y[own]).sum())) if n >= MIN_WORDS and 2 * len(own) <= n else (0, 0)

    for k in slots.tolist():
        u, v = int(y[k]), int(x[k])
        clash = max((at for held, key, value in ((there, u, v), (back, v, u)) if key in held for other, at in [held[key]] if other != value), default=-1)
        if clash >= start:
            best, start = max(best, closed(k)), clash + 1
        there[u], back[v] = (v, k), (u, k)
    return max(best, closed(len(x)))


_HELD = "id bigint, key bigint, words binary, parts binary, types binary, hashes array<bigint>, places array<int>"
_NAMES = [c.split()[0] for c in _HELD.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _windows(held: np.ndarray | None):
    """Texts as hashes with their windows; with a filter only windows that pass it, and only texts that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            rows = []
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                compared, hashes, places = _both(text, lexicon)
                if held is not None and len(hashes):
                    hit = may_hold(held, hashes)
                    hashes, places = hashes[hit], places[hit]
                if len(hashes):
                    words, parts, types = compared
                    key = np.uint64(text_hash(text)).astype(np.int64)
                    rows.append((row_id, key, words.tobytes(), parts.tobytes(), types.astype(np.int8).tobytes(), hashes.view(np.int64), places.astype(np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, item_id, words, parts, types, i_words, i_parts, i_types, diagonals in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = np.frombuffer(words, np.uint64), np.frombuffer(i_words, np.uint64)
            p, q = np.frombuffer(parts, np.uint64), np.frombuffer(i_parts, np.uint64)
            tp, tq = np.frombuffer(types, np.int8), np.frombuffer(i_types, np.int8)
            best, template = 0, (0, 0)
            for d in diagonals:
                if d & 1:
                    template = max(template, longest_template(p, tp, q, tq, d >> 1))
                else:
                    best = max(best, longest_stretch(a, b, d >> 1))
            if best or template[0]:
                rows.append((doc_id, item_id, best, *template))
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "words", "template_words", "changed_slots"])


def passage_matches(documents: DataFrame, items: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, words, template_words, changed_slots) of ``documents(doc_id, text)`` and ``items(item_id, passage)``.

    ``words``: the longest stretch of the passage, word for word but for one in ``PER_ALTERED``; ``template_words``: the
    longest one as a template with consistent slots, of which ``changed_slots`` have other values. 0 where there is none
    of ``MIN_WORDS``; at least one of the two is more. Null or short texts and passages give no row; of rows with the
    same id the longest counts. ``filter_bits`` is the binary logarithm of the filter's bits, for more items than 2^20
    windows; fewer bits let more documents through to the join and lose none.
    """
    asked = items.where("passage IS NOT NULL").select(F.col("item_id").cast("bigint"), "passage")
    held = written(asked.mapInArrow(_windows(None), _HELD).withColumnsRenamed({"id": "item_id", "key": "item_key"}))
    ours = held.select("item_id", "item_key", F.explode(F.arrays_zip("hashes", "places")).alias("w")).select("item_id", "item_key", F.col("w.hashes").alias("h"), F.col("w.places").alias("j"))
    keep = value_filter(ours.select("h"), "h", filter_bits)
    texts = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    docs = written(texts.mapInArrow(_windows(keep), _HELD).withColumnsRenamed({"id": "doc_id", "key": "doc_key"}))
    salt = F.pmod(F.xxhash64("doc_id", "doc_key"), F.lit(SALTS)).cast("int").alias("salt")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    theirs = docs.select("doc_id", "doc_key", salt, F.explode(F.arrays_zip("hashes", "places")).alias("w")).select("doc_id", "doc_key", "salt", F.col("w.hashes").alias("h"), F.col("w.places").alias("i"))
    # both places are even or both odd, as the forms are hashed apart: the difference halved is the offset
    diagonal = (F.shiftright("i", 1) - F.shiftright("j", 1)) * 2 + F.col("i").bitwiseAND(1)
    met = theirs.join(ours.select("*", copies), ["h", "salt"]).select("doc_id", "doc_key", "item_id", "item_key", "salt", diagonal.alias("d"))
    pairs = met.groupBy("doc_id", "doc_key", "item_id", "item_key", "salt").agg(F.collect_set("d").alias("diagonals"))
    passages = held.select("item_id", "item_key", F.col("words").alias("i_words"), F.col("parts").alias("i_parts"), F.col("types").alias("i_types"), copies)
    bodies = docs.select("doc_id", "doc_key", "words", "parts", "types")
    full = pairs.join(passages, ["item_id", "item_key", "salt"]).join(bodies, ["doc_id", "doc_key"])
    checked = full.select("doc_id", "item_id", "words", "parts", "types", "i_words", "i_parts", "i_types", "diagonals").mapInArrow(_verify, "doc_id bigint, item_id bigint, words int, template_words int, changed_slots int")
    best = F.max(F.struct("template_words", "changed_slots"))
    return checked.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), best.alias("t")).select("doc_id", "item_id", "words", "t.template_words", "t.changed_slots")


def leaked_passages(documents: DataFrame, items: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, words): each document that holds a stretch of an item, word for word but for one in ``PER_ALTERED``."""
    return passage_matches(documents, items, filter_bits).where("words > 0").select("doc_id", "item_id", "words")


def refilled_templates(documents: DataFrame, items: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, template_words, changed_slots): documents that ask an item again with other names, numbers or units."""
    return passage_matches(documents, items, filter_bits).where("changed_slots > 0").select("doc_id", "item_id", "template_words", "changed_slots")
