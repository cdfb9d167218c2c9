"""Problem 4: noise in text from scanned pages.

Noisy channel: what a word should be is the vocabulary word with the highest product of character confusion
probabilities and n-gram likelihood, decoded by Viterbi over the candidates of each line. Counts come from the whole
text of files that weren't scanned (and, weakly, of the scanned ones).

The confusion probabilities are fitted to the scans themselves by expectation maximisation over unknown forms and the
known words that one confused segment explains, whatever its characters; a few usual confusions only give the first
guess. The pages are taken apart once and kept as one compact row a file. Decisions are made per distinct form, not per
token: forms meet candidates by an equi-join, and a filter of fixed size then tells a second, cheap pass over the kept
files which tokens are concerned. Only these, a few in a hundred, are joined with their candidates and decoded.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.filters import may_hold_one, value_filter
from maskwright.llm.blocks import text_hash
from maskwright.llm.names import lcs_ratio
from maskwright.runtime import cut, written

# Characters as printed and as misread, the first guess of the channel.
CONFUSIONS = [tuple(p.split(":")) for p in "o:0 l:1 i:1 i:l s:5 b:6 b:8 g:9 e:c t:f h:b d:cl cl:d m:rn n:ri w:vv rn:m z:2 a:o u:v".split()]
#: Folding of usual confusions: single characters into one of their class, then pairs of classes that look like one.
_SINGLE = str.maketrans("015689clbf2v", "oishhgeihtzu")
_PAIRS = [("ri", "n"), ("rn", "m"), ("ei", "d"), ("uu", "w")]

TOKEN = re.compile(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*-?")
CLEAN = re.compile(r"[a-z]+(?:['-][a-z]+)*")
MARKER = re.compile(r"^\s*-{3} Page Break -{3}\s*$")
PAGE_NUMBER = re.compile(r"^\W*(?:p(?:age|g)?\b\.?\s*)?(?:\d{1,4}|[ivxlc]{1,7})(?:\s*(?:of|/)\s*\d{1,4})?\W*$", re.IGNORECASE)
_NUMBER_AT_END = re.compile(r"^\s*\W*\d{1,4}\W*\s{2,}|\s{2,}\W*\d{1,4}\W*\s*$")

#: First guess of the probability that a segment is misread as a given other: usual confusions, and any others.
P_CONFUSED, P_OTHER = 0.004, 0.0004
#: Printed segments that the first guess weighs as much as, and rounds of expectation maximisation.
PRIOR, ROUNDS = 200.0, 2
#: Confusions that are none of the usual ones count if they are expected so often at least.
LEAST_EXPECTED = 5.0
#: Weight of a scanned word, which may itself be misread; of a form that is no known word, as a count.
SCAN_WEIGHT, UNKNOWN = 0.01, 0.02
#: A vocabulary word must outweigh a known word that stands there by this factor.
MARGIN = 2.0
#: Pages of one file that are taken apart together; the headers of a file with more are looked for in each such part.
VOLUME = 500


def fold(word: str) -> str:
    """Key in which all confusable spellings of a word agree."""
    word = word.lower().translate(_SINGLE)
    for many, one in _PAIRS:
        word = word.replace(many, one)
    return word


def first_guess() -> dict[tuple[str, str], float]:
    return {c: P_CONFUSED for c in CONFUSIONS}


def difference(seen: str, meant: str) -> tuple[str, str] | None:
    """(printed, read) where the words differ in one segment of one or two characters, one of them on one side at least."""
    i, n = 0, min(len(seen), len(meant))
    while i < n and seen[i] == meant[i]:
        i += 1
    j = 0
    while j < n - i and seen[-1 - j] == meant[-1 - j]:
        j += 1
    read, printed = seen[i : len(seen) - j], meant[i : len(meant) - j]
    if not printed and not read:
        return None
    if not printed or not read:  # a letter more or less: together with its neighbour, two are read as one or one as two
        if i:
            i -= 1
        elif j:
            j -= 1
        read, printed = seen[i : len(seen) - j], meant[i : len(meant) - j]
    return (printed, read) if 2 <= len(printed) + len(read) <= 3 and printed and read else None


def channel(seen: str, meant: str, table: dict[tuple[str, str], float]) -> float:
    """Log probability of reading ``seen`` where ``meant`` is printed; -inf if the table's confusions can't explain it."""
    one = difference(seen, meant)
    if one is not None:
        known = table.get(one)
        if known:
            return math.log(known)
    best: list[dict[int, float]] = [{} for _ in range(len(meant) + 1)]
    best[0][0] = 0.0
    for i in range(len(meant) + 1):
        for j, p in best[i].items():
            if i < len(meant) and j < len(seen) and meant[i] == seen[j]:
                best[i + 1][j + 1] = max(best[i + 1].get(j + 1, -math.inf), p)
            for a in (1, 2):
                for b in (1, 2) if a == 1 else (1,):
                    if i + a <= len(meant) and j + b <= len(seen):
                        known = table.get((meant[i : i + a], seen[j : j + b]))
                        if known:
                            best[i + a][j + b] = max(best[i + a].get(j + b, -math.inf), p + math.log(known))
    return best[len(meant)].get(len(seen), -math.inf)


def form_keys(word: str) -> list[str]:
    """Keys of which a word and its misread forms share one: the folded word, and the same with any segment left open.

    Any number of usual confusions and one of any other kind keep a key. Words of one or two letters have no open ones.
    """
    g = fold(word)
    n = len(g)
    return [g, *({g[:i] + "*" + g[i + w :] for w in (1, 2) for i in range(n - w + 1)} if n > 2 else ())]


def _header_key(line: str) -> str:
    plain = _NUMBER_AT_END.sub(" ", line)
    return " ".join(fold(w) for w in re.findall(r"[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*", plain))


def layout(lines: list[str], breaks: list[bool]) -> list[str]:
    """Kind of each line: blank, marker, page_number, header or body. ``breaks[i]``: a page is known to begin at i."""
    n = len(lines)
    kinds = ["blank" if not s.strip() else "marker" if MARKER.match(s) else "body" for s in lines]
    open_before = [i == 0 or kinds[i - 1] != "body" or breaks[i] for i in range(n)]
    open_after = [i == n - 1 or kinds[i + 1] != "body" or breaks[i + 1] for i in range(n)]
    for i, s in enumerate(lines):
        if kinds[i] == "body" and PAGE_NUMBER.match(s) and (open_before[i] or open_after[i]):
            kinds[i] = "page_number"
    texts = [i for i in range(n) if kinds[i] in ("body", "page_number")]
    first = set(texts[:1])
    for a, b in zip(texts, texts[1:]):
        if kinds[a] == "page_number" or any(breaks[a + 1 : b + 1]) or any(kinds[k] == "marker" for k in range(a, b)):
            first.add(b)
    short = {i: _header_key(lines[i]) for i in texts if kinds[i] == "body" and len(lines[i].split()) <= 9 and lines[i].rstrip()[-1:] not in ".,;?!-" and (breaks[i] or open_before[i] and open_after[i])}
    times = Counter(k for k in short.values() if k)
    known = {k for k, c in times.items() if c >= 2}
    for i, k in short.items():
        words = re.findall(r"[A-Za-z]+", lines[i])
        title = len(words) >= 2 and all(w[0].isupper() for w in words) and i in first
        if k in known or title or any(lcs_ratio(k, h) >= 0.85 for h in known):
            kinds[i] = "header"
    return kinds


_STOP = frozenset(".?!")


def body_tokens(lines: list[str], kinds: list[str]) -> list[tuple[int, int, str, str, bool]]:
    """(line, index in line, whole token, joined form or '', begins a sentence) of the running text, words over two lines joined."""
    tokens: list[tuple[int, int, str, str, bool]] = []
    fresh, waiting = True, False  # waiting: the last token is the first half of a broken word
    for i, s in enumerate(lines):
        if kinds[i] != "body":
            fresh = fresh or (kinds[i] == "blank" and not waiting)
            continue
        at, k, last = 0, -1, None
        for k, m in enumerate(TOKEN.finditer(s)):
            last = m
            a, b = m.span()
            word = m.group()
            gap = s[at:a]
            at = b
            if word[-1] == "-":
                word = word.rstrip("-")
            if waiting:
                waiting = False
                if k == 0 and (not gap or gap.isspace()) and (word[0].islower() or word[0].isdigit()):
                    li, lk, lw, _, ls = tokens[-1]
                    tokens[-1] = (li, lk, lw, f"{lw}-{word}", ls)
                    continue
            tokens.append((i, k, word, "", fresh or not _STOP.isdisjoint(gap)))
            fresh = False
        if last is not None and last.group()[-1] == "-" and tokens and tokens[-1][:2] == (i, k) and tokens[-1][2].isalnum() and not s[at:].strip():
            waiting = True
        fresh = s.rstrip(" \t\"')]")[-1:] in _STOP if s.strip() else fresh
    return tokens


def as_cased(seen: str, meant: str, start: bool) -> str:
    """``meant`` (lower case) in the letter case of ``seen``."""
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return meant.upper()
    if seen[:1].isupper() or (seen[:1].isdigit() and start):
        return meant[:1].upper() + meant[1:]
    return meant


# ---- files taken apart ---------------------------------------------------------------------------------------------

#: Rows of three kinds: furniture (a line or a word of one), counts of forms, and the tokens of one file in one row.
PARTS = "what string, src string, doc_id bigint, row_id bigint, line int, pos int, text string, times bigint, places binary, ids binary, halves string"
_NAMES = [c.split()[0] for c in PARTS.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
_SEP, _SUB = "\x1f", "\x1e"

#: Distinct forms held by a task before their counts are handed on, and rows of one outgoing batch.
MAX_FORMS, BATCH_ROWS = 200_000, 20_000


class Parts:
    """Rows of ``PARTS`` of the files of one task; counts of forms are combined before they leave it."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.forms: Counter = Counter()

    def add(self, src: str, doc_id: int, lines: list[str], breaks: list[bool], ids: list[list[tuple[str, int]]] | None) -> None:
        kinds = layout(lines, breaks)
        for i, kind in enumerate(kinds):
            if kind in ("header", "page_number"):
                for k, (word, row) in enumerate([(lines[i], doc_id)] if ids is None else ids[i]):
                    self.rows.append((kind, src, doc_id, row, i, k, word, 0, None, None, None))
        tokens = body_tokens(lines, kinds)
        if not tokens:
            return
        line, pos, word, halves, start = zip(*tokens)
        low = _SEP.join(word).lower().split(_SEP)
        broken = [(i, h) for i, h in enumerate(halves) if h]
        self.forms.update(low)
        for i, h in broken:  # a first half alone is no form of its own
            self.forms[low[i]] -= 1
            for joined in (h.lower(), h.lower().replace("-", "")):
                self.forms[joined] += 0
        places = (np.array(line, np.int64) << 32) | (np.array(pos, np.int64) << 1) | np.array(start, np.int64)
        rows = None
        if ids is not None:
            boxes = {i: token_ids(lines[i], ids[i]) for i in set(line)}
            rows = np.array([boxes[i][k] for i, k in zip(line, pos)], np.int64).tobytes()
        self.rows.append(("tokens", src, doc_id, None, None, None, _SEP.join(word), len(word), places.tobytes(), rows, _SEP.join(f"{i}{_SUB}{h}" for i, h in broken)))

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if last or len(self.forms) > MAX_FORMS:
            self.rows += [("form", None, None, None, None, None, f, n, None, None, None) for f, n in self.forms.items()]
            self.forms.clear()
        if self.rows and (last or len(self.rows) >= BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), _TYPES)], _NAMES)
            self.rows = []


def token_ids(line: str, ids: list[tuple[str, int]]) -> list[int]:
    """The box in which each token of a line begins."""
    out, i, end = [], 0, len(ids[0][0])
    for m in TOKEN.finditer(line):
        while m.start() > end and i + 1 < len(ids):
            i += 1
            end += len(ids[i][0]) + 1
        out.append(ids[i][1])
    return out


def split_lines(text: str) -> list[str]:
    return re.split(r"\r\n|\n|\r|\f", text)


def _scan_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = Parts()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = split_lines(text)
            parts.add("scan", doc_id, lines, [False] * len(lines), None)
        yield from parts.batches()
    yield from parts.batches(last=True)


def page_lines(words: list[tuple[int, int, int, int, str]]) -> list[list[tuple[str, int]]]:
    """Lines of (text, word_id) of one page's words (y, x, word_id, h, text) in order of y: a step of more than 0.6 of the
    median height begins a line, within a line the order is that of x."""
    heights = sorted(w[3] for w in words)
    middle = len(heights) // 2
    pitch = max(1.0, 0.6 * (heights[middle] if len(heights) % 2 else (heights[middle - 1] + heights[middle]) / 2))
    lines: list[list[tuple[int, int, str]]] = []
    last = None
    for y, x, word_id, _, text in words:
        if last is None or y - last > pitch:
            lines.append([])
        lines[-1].append((x, word_id, text))
        last = y
    return [[(text, word_id) for _, word_id, text in sorted(line)] for line in lines]


def _word_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words sorted by file, volume, page, y, x and id: each volume is taken apart when its last word has been read."""
    parts = Parts()
    now: tuple | None = None
    pages: dict[int, list] = {}

    def close() -> None:
        lines, breaks, ids = [], [], []
        for page in pages.values():  # in order of page
            for k, line in enumerate(page_lines(page)):
                lines.append(" ".join(t for t, _ in line))
                breaks.append(k == 0)
                ids.append(line)
        parts.add("word", now[0], lines, breaks, ids)

    for batch in batches:
        for scan_id, volume, page, y, x, word_id, h, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (scan_id, volume) != now:
                if now is not None:
                    close()
                now, pages = (scan_id, volume), {}
            pages.setdefault(page, []).append((y, x, word_id, h, text))
        yield from parts.batches()
    if now is not None:
        close()
    yield from parts.batches(last=True)


def page_parts(scans: DataFrame, words: DataFrame) -> DataFrame:
    """``PARTS`` of ``scans(doc_id, text)`` and of ``words(word_id, scan_id, page, text, y, x, h)``.

    Null and blank texts and words without a scan give no row. Words come in reading order by a sort within partitions of
    whole volumes (``VOLUME`` pages of a file), which are read as a stream, one volume in memory at a time.
    """
    a = scans.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scan_parts, PARTS)
    held = words.where("trim(text) <> '' AND scan_id IS NOT NULL").select(F.col("scan_id").cast("bigint").alias("scan_id"), F.coalesce("page", F.lit(0)).cast("int").alias("page"), "y", "x", F.col("word_id").cast("bigint").alias("word_id"), "h", F.trim("text").alias("text")).fillna(0, ["x", "y", "h"])
    key = ["scan_id", "volume"]
    held = held.withColumn("volume", F.floor(F.col("page") / VOLUME).cast("int")).select(*key, "page", *(F.col(c).cast("int").alias(c) for c in ("y", "x")), "word_id", F.col("h").cast("int").alias("h"), "text")
    return a.unionByName(held.repartition(*key).sortWithinPartitions(*key, "page", "y", "x", "word_id").mapInArrow(_word_parts, PARTS))


# ---- counts, candidates, decoding ---------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one: Counter = Counter()
    two: Counter = Counter()

    def full() -> pa.RecordBatch:
        words, pairs = list(one), list(two)
        hashes = [text_hash(f"{u} {v}") for u, v in pairs]
        columns = [pa.array(words + [None] * len(pairs), pa.string()), pa.array(np.array([0] * len(words) + hashes, np.uint64).view(np.int64)), pa.array([*one.values(), *two.values()], pa.int64())]
        one.clear(), two.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "pair", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for sentence in re.split(r"[.?!;:]\s|\n\s*\n", text.lower()):
                found = CLEAN.findall(sentence)
                one.update(found)
                two.update(zip(found, found[1:]))
        if len(one) + len(two) > 500_000:
            yield full()
    yield full()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, pair, n): counts of words, and of pairs of neighbours by their hash (word null), over ``texts(text)``.

    Combined within each task only; readers add them up.
    """
    return texts.where("text IS NOT NULL").select("text").mapInArrow(_count, "word string, pair bigint, n bigint")


def _options(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that one segment explains, with the segment; others with null if usual confusions may explain them."""
    usual = first_guess()
    for pdf in batches:
        rows = []
        for seen, own, times, meant, n in zip(pdf["seen"], pdf["own"], pdf["times"], pdf["meant"], pdf["n"]):
            if seen == meant:
                continue
            one = difference(seen, meant)
            if one is None and channel(seen, meant, usual) == -math.inf and fold(seen) == fold(meant):
                continue
            if own and one not in usual and fold(seen) != fold(meant):
                continue
            rows.append((seen, own, times, meant, n, *(one or (None, None))))
        yield pd.DataFrame(rows, columns=["seen", "own", "times", "meant", "n", "printed", "read"])


def _keyed(df: DataFrame, word: str, wide) -> DataFrame:
    """``df`` once for each key of ``word``; where ``wide`` is false, under the folded word alone."""

    @F.pandas_udf("array<string>")
    def run(words: pd.Series, all_keys: pd.Series) -> pd.Series:
        return pd.Series([form_keys(w) if every else [fold(w)] for w, every in zip(words, all_keys)])

    keyed = df.withColumn("keys", run(F.col(word), wide))
    return keyed.select(*df.columns, F.explode("keys").alias("key"))


def repair_options(forms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(seen, own, times, meant, n, printed, read): what each form may be misread from.

    ``forms(seen, own, times)``: distinct forms, their count as known words and in the scans; ``vocabulary(meant, n)``.
    Known words are compared under the folded key alone, unknown ones under all keys.
    """
    a = _keyed(forms, "seen", F.col("own") == 0)
    b = _keyed(vocabulary, "meant", F.lit(True))
    pairs = a.join(b, "key").select("seen", "own", "times", "meant", "n").distinct()
    return pairs.mapInPandas(_options, "seen string, own double, times bigint, meant string, n double, printed string, read string")


def _expected(table: dict[tuple[str, str], float]):
    """How often each confusion is expected under the table: each unknown form is shared out over its explanations and
    the chance that it is a word of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str], float] = {}
        for pdf in batches:
            for times, options in zip(pdf["times"], pdf["options"]):
                weights = [o["n"] * table.get((o["printed"], o["read"]), P_OTHER) for o in options]
                whole = sum(weights) + UNKNOWN
                for o, w in zip(options, weights):
                    c = (o["printed"], o["read"])
                    sums[c] = sums.get(c, 0.0) + times * w / whole
        yield pd.DataFrame([(*c, e) for c, e in sums.items()], columns=["printed", "read", "expected"])

    return run


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: Counter = Counter()
    for pdf in batches:
        for word, times in zip(pdf["seen"], pdf["times"]):
            if times > 0:
                for w in (1, 2):
                    for i in range(len(word) - w + 1):
                        sums[word[i : i + w]] += times
    yield pd.DataFrame(list(sums.items()), columns=["segment", "n"])


def fitted_channel(forms: DataFrame, options: DataFrame, rounds: int = ROUNDS) -> dict[tuple[str, str], float]:
    """Probability of each confusion (printed, read), by expectation maximisation over the unknown forms of the scans.

    What comes to the driver are sums per segment and per confusion, at most 38 + 38^2 and 38^2 + 2 * 38^3 rows by the
    size of the alphabet, however long the texts are. Usual confusions keep their first guess as prior; others need
    ``LEAST_EXPECTED`` expected cases, so that words which happen to look alike teach nothing.
    """
    seen = {r["segment"]: r["n"] for r in forms.mapInPandas(_segments, "segment string, n bigint").groupBy("segment").agg(F.sum("n").alias("n")).collect()}
    grouped = cut(options.where("own = 0 AND times > 0 AND printed IS NOT NULL").groupBy("seen").agg(F.max("times").alias("times"), F.collect_list(F.struct("printed", "read", "n")).alias("options")))
    usual = first_guess()
    table = dict(usual)
    for _ in range(rounds):
        sums = grouped.mapInPandas(_expected(table), "printed string, read string, expected double").groupBy("printed", "read").agg(F.sum("expected").alias("expected")).collect()
        expected = {(r["printed"], r["read"]): r["expected"] for r in sums}
        table = {c: (expected.get(c, 0.0) + PRIOR * p) / (seen.get(c[0], 0) + PRIOR) for c, p in usual.items()}
        table |= {c: e / (seen.get(c[0], 0) + PRIOR) for c, e in expected.items() if c not in usual and e >= LEAST_EXPECTED}
    return table


def _candidates(table: dict[tuple[str, str], float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for seen, own, meant, n in zip(pdf["seen"], pdf["own"], pdf["meant"], pdf["n"]):
                score = math.log(n) + channel(seen, meant, table)
                if score > math.log(own + UNKNOWN) + (math.log(MARGIN) if own else 0):
                    rows.append((seen, meant, score))
            yield pd.DataFrame(rows, columns=["seen", "meant", "score"])

    return run


HITS = "src string, doc_id bigint, row_id bigint, line int, pos int, defect string, seen string, halves string, start boolean, before string, after string"


class _Memo(dict):
    """Whether a form may be among those with candidates; asked once a form."""

    def __init__(self, held: np.ndarray):
        self.held = held

    def __missing__(self, form: str) -> bool:
        if len(self) > 1_000_000:
            self.clear()
        self[form] = hit = may_hold_one(self.held, text_hash(form))
        return hit


def _hits(held: np.ndarray):
    """Tokens of kept files whose form may have candidates, and all broken words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(held)
        for batch in batches:
            rows = []
            for src, doc_id, text, places, ids, halves in zip(*(c.to_pylist() for c in batch.columns)):
                words, low = text.split(_SEP), text.lower().split(_SEP)
                joined = {int(i): h for i, h in (p.split(_SUB) for p in halves.split(_SEP))} if halves else {}
                chosen = sorted({i for i, hit in enumerate(map(memo.__getitem__, low)) if hit} | set(joined))
                if not chosen:
                    continue
                at = np.frombuffer(places, np.int64)
                own = np.frombuffer(ids, np.int64) if ids else None
                fresh = lambda i: i >= len(words) or bool(at[i] & 1)
                form = lambda i: joined[i].lower() if i in joined else low[i]
                for i in chosen:
                    before = form(i - 1) if i and not fresh(i) else ""
                    after = "" if fresh(i + 1) else form(i + 1)
                    rows.append((src, doc_id, doc_id if own is None else int(own[i]), int(at[i] >> 32), int(at[i] & 0xFFFFFFFF) >> 1, "hyphen" if i in joined else "", words[i], joined.get(i, ""), bool(at[i] & 1), before, after))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _HIT_TYPES)], _HIT_NAMES)

    return run


_HIT_NAMES = [c.split()[0] for c in HITS.split(", ")]
_HIT_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]


def _decode(pdf: pd.DataFrame) -> pd.DataFrame:
    """Viterbi over the hits of each line; neighbours that are no hits are fixed."""
    out = []
    for row in pdf.itertuples(index=False):
        pairs = {(p["u"], p["v"]): p["n"] for p in row.pairs} if row.pairs is not None else {}
        hits = sorted(row.hits, key=lambda h: h["pos"])
        link = lambda u, v: math.log(pairs.get((u, v), 0) + 0.1) if u and v else 0.0
        states: list[dict[str, tuple[float, str | None]]] = []
        for k, h in enumerate(hits):
            now: dict[str, tuple[float, str | None]] = {}
            tied = k > 0 and hits[k - 1]["pos"] == h["pos"] - 1 and bool(h["before"])
            follows = k + 1 < len(hits) and hits[k + 1]["pos"] == h["pos"] + 1
            for c in h["cands"]:
                step = c["score"] + (0.0 if follows else link(c["meant"], h["after"]))
                if tied:
                    u = max(states[-1], key=lambda u: states[-1][u][0] + link(u, c["meant"]))
                    now[c["meant"]] = (states[-1][u][0] + link(u, c["meant"]) + step, u)
                elif states:
                    u = max(states[-1], key=lambda u: states[-1][u][0])
                    now[c["meant"]] = (states[-1][u][0] + link(h["before"], c["meant"]) + step, u)
                else:
                    now[c["meant"]] = (link(h["before"], c["meant"]) + step, None)
            states.append(now)
        word = max(states[-1], key=lambda u: states[-1][u][0])
        for k in range(len(hits) - 1, -1, -1):
            h = hits[k]
            out.append((row.src, row.doc_id, h["row_id"], row.line, h["pos"], h["defect"], as_cased(h["seen"], word, h["start"])))
            word = states[k][word][1]
    return pd.DataFrame(out, columns=["src", "doc_id", "row_id", "line", "pos", "defect", "repaired"])


def _viterbi(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield _decode(pdf)


REPAIR = "src string, doc_id bigint, row_id bigint, line int, pos int, defect string, repaired string"


def placed_repairs(scans: DataFrame, words: DataFrame, clean: DataFrame) -> DataFrame:
    """(src, doc_id, row_id, line, pos, defect, repaired): every repair with its place.

    ``scans(doc_id, text)``, ``words`` as for ``page_parts``, ``clean(text)`` texts without noise for the counts. A word
    that no vocabulary word explains stays as it is; a broken word that is unknown in both forms is joined without hyphen.
    """
    parts = written(page_parts(scans, words))
    furniture = parts.where("what IN ('header', 'page_number')").select("src", "doc_id", "row_id", "line", "pos", F.col("what").alias("defect"), F.col("text").alias("repaired"))

    counts = written(word_counts(clean))
    known = counts.where("word IS NOT NULL").groupBy(F.col("word").alias("meant")).agg(F.sum("n").cast("double").alias("n"))
    # every form that stands in the text, counted once: whole words, joined halves with and without their hyphen
    counted = parts.where("what = 'form'").groupBy("text").agg(F.sum("times").alias("times")).where("text RLIKE '[a-z]'")
    forms = cut(counted.join(known, F.col("text") == known["meant"], "left").select(F.col("text").alias("seen"), "times", F.coalesce("n", F.lit(0.0)).alias("own")))
    only_scanned = forms.where("own = 0 AND times > 0 AND NOT seen RLIKE '[0-9]'").select(F.col("seen").alias("meant"), (F.col("times") * SCAN_WEIGHT).alias("n"))
    options = cut(repair_options(forms, known.unionByName(only_scanned)))
    table = fitted_channel(forms, options)
    meant = cut(options.select("seen", "own", "meant", "n").mapInPandas(_candidates(table), "seen string, meant string, score double"))

    held = value_filter(meant.select(F.xxhash64("seen").alias("h")), "h")
    kept = parts.where("what = 'tokens'").select("src", "doc_id", "text", "places", "ids", "halves")
    body = cut(kept.mapInArrow(_hits(held), HITS))

    # broken words: of the two forms the one that is known, or is misread from a known one
    best = meant.groupBy("seen").agg(F.max(F.struct("score", "meant")).alias("top")).select("seen", "top.score", "top.meant")
    rated = forms.join(best, "seen", "left").select("seen", F.when(F.col("own") > 0, F.log("own")).otherwise(F.col("score")).alias("rate"), F.when(F.col("own") > 0, F.col("seen")).otherwise(F.coalesce("meant", "seen")).alias("right"))
    broken = body.where("defect = 'hyphen'").select("src", "doc_id", "row_id", "line", "pos", "seen", "start", F.lower("halves").alias("kept")).withColumn("word", F.replace("kept", F.lit("-"), F.lit(""))).where("word RLIKE '[a-z]'")
    pick = broken.join(rated.toDF("word", "rate", "right"), "word", "left").join(rated.toDF("kept", "kept_rate", "kept_right"), "kept", "left")
    chosen = F.when(F.coalesce("kept_rate", F.lit(-99.0)) > F.coalesce("rate", F.lit(-99.0)), F.col("kept_right")).otherwise(F.coalesce("right", "word"))
    hyphens = pick.select("src", "doc_id", "row_id", "line", "pos", F.lit("hyphen").alias("defect"), _cased("seen", chosen, "start").alias("repaired"))

    # misread words: Viterbi over the candidates of each line
    cands = meant.groupBy("seen").agg(F.collect_list(F.struct("meant", "score")).alias("cands"))
    hits = body.where("defect = ''").withColumn("word", F.lower("seen")).join(cands.withColumnRenamed("seen", "word"), "word")
    lines = cut(hits.groupBy("src", "doc_id", "line").agg(F.collect_list(F.struct("pos", "row_id", F.lit("misread").alias("defect"), "seen", "start", "before", "after", "cands")).alias("hits")))
    around = lambda h: F.flatten(F.transform(h.cands, lambda c: F.array(F.struct(h.before.alias("u"), c.meant.alias("v")), F.struct(c.meant.alias("u"), h.after.alias("v")))))
    between = F.flatten(F.transform("hits", lambda h: F.flatten(F.transform(F.filter("hits", lambda g: g.pos == h.pos + 1), lambda g: F.flatten(F.transform(h.cands, lambda c: F.transform(g.cands, lambda d: F.struct(c.meant.alias("u"), d.meant.alias("v")))))))))
    edges = lines.select("src", "doc_id", "line", F.explode(F.array_distinct(F.concat(F.flatten(F.transform("hits", around)), between))).alias("e")).where("e.u <> '' AND e.v <> ''").select("src", "doc_id", "line", "e.u", "e.v", F.xxhash64(F.concat_ws(" ", "e.u", "e.v")).alias("pair"))
    # of the counted pairs only those that are asked for are added up
    asked = counts.where("word IS NULL").select("pair", "n").join(edges.select("pair").distinct(), "pair", "left_semi").groupBy("pair").agg(F.sum("n").alias("n"))
    weighed = edges.join(asked, "pair").groupBy("src", "doc_id", "line").agg(F.collect_list(F.struct("u", "v", "n")).alias("pairs"))
    decoded = lines.join(weighed, ["src", "doc_id", "line"], "left").select("src", "doc_id", "line", "hits", "pairs").mapInPandas(_viterbi, REPAIR)
    return furniture.unionByName(hyphens).unionByName(decoded)


def scan_repairs(scans: DataFrame, words: DataFrame, clean: DataFrame) -> DataFrame:
    """(src, row_id, defect, repaired): the distinct repairs of scanned texts and of their words; see ``placed_repairs``."""
    return placed_repairs(scans, words, clean).select("src", "row_id", "defect", "repaired").distinct()


def rebuilt(text: str, repairs: dict[tuple[int, int], str]) -> str:
    """Paragraphs of a scanned text: furniture gone, lines run on, words as repaired. A page break ends no paragraph."""
    lines = split_lines(text)
    kinds = layout(lines, [False] * len(lines))
    tokens = {(i, k): halves for i, k, _, halves, _ in body_tokens(lines, kinds)}
    paragraphs: list[str] = []
    fresh, skip = True, False
    for i, s in enumerate(lines):
        if kinds[i] == "blank":
            fresh = fresh or bool(paragraphs and re.search(r"[.?!:]\W*$", paragraphs[-1]))
        if kinds[i] != "body":
            continue
        out, at, glue = [], 0, False
        for k, m in enumerate(TOKEN.finditer(s)):
            halves = tokens.get((i, k))
            if k == 0 and skip:
                at = m.start() + len(m.group().rstrip("-"))
                continue
            out.append(s[at : m.start()])
            if halves:
                out.append(repairs.get((i, k), halves))
                at, glue = m.end(), True
            else:
                word = m.group().rstrip("-")
                out.append(repairs.get((i, k), word))
                at = m.start() + len(word)
        line = ("".join(out) + s[at:]).strip()
        if fresh or not paragraphs:
            paragraphs.append(line)
        elif line:
            paragraphs[-1] += line if skip and line[:1] in ".,;:?!" else " " + line
        fresh, skip = False, glue
    return "\n\n".join(p for p in paragraphs if p)


def _rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [rebuilt(t, {(r["line"], r["pos"]): r["repaired"] for r in rs} if rs is not None else {}) for t, rs in zip(pdf["text"], pdf["repairs"])]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "repaired_text": texts})


def repaired_texts(scans: DataFrame, words: DataFrame, clean: DataFrame) -> DataFrame:
    """(doc_id, repaired_text): each scanned text as continuous paragraphs."""
    placed = placed_repairs(scans, words, clean).where("src = 'scan' AND defect IN ('hyphen', 'misread')")
    by_text = placed.groupBy("doc_id").agg(F.collect_list(F.struct("line", "pos", "repaired")).alias("repairs"))
    held = scans.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return held.join(by_text, "doc_id", "left").mapInPandas(_rebuild, "doc_id bigint, repaired_text string")


def _cased(seen: str, meant, start: str):
    @F.pandas_udf("string")
    def run(s: pd.Series, m: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([as_cased(x, y, z) for x, y, z in zip(s, m, b)])

    return run(F.col(seen), meant, F.col(start))
