"""Problem 3: personal information inside free text.

Information-theoretic sanitisation. One pass over the corpus counts how often each term stands next to a protected
entity and how often it stands at all; the pointwise information between the two is what the term discloses. Evidence of
family names are titles, initials, "Family, Given", given names of a prior (optional) and values known to be persons.
Terms above the threshold are protected; capitalised words that stand before protected terms are rated in the same way
and become given names, on no list, and words after these become family names in turn. Numbers and addresses are taken by
their shape; where the shape says too little, by the label before them, which is a given list: texts alone don't tell a
member number from an invoice number. Everything taken is generalised to a typed placeholder, the rest stays as it is.

Only the statistics cross the network: (term, counts) combined within each task, then by term. Terms above the
threshold are joined back by term, text by text, never sent around as a whole table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.filters import passes, value_filter
from maskwright.llm.names import GIVEN_NAMES, NICKNAMES, TITLES
from maskwright.llm.places import DIRECTIONS, KINDS, STATES
from maskwright.runtime import cut

# ---- shapes -------------------------------------------------------------------------------------------------------

_LABEL_PART = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(
    rf"(?<![\w.+%-])[A-Za-z0-9_](?:[\w.+%-]*[A-Za-z0-9_+-])?(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?)(?:{_LABEL_PART}(?:\s?[(\[]\s?dot\s?[)\]]\s?|\s+dot\s+|\.))+[A-Za-z]{{2,}}(?![\w-])",
    re.IGNORECASE,
)
_TOLL_FREE = r"8(?:00|33|44|55|66|77|88)"
PHONE = re.compile(
    r"(?<![\w.,/$+-])(?:"
    r"(?:(?:\+1|001|1)[\s.-]{0,2})?(?:\(\d{3}\)\s?|\d{3}(?:[\s.-]|\s?/\s?)?)\d{3}(?:[\s.-]|\s?/\s?)?\d{4}"
    r"|(?:(?:\+1|001|1)[\s.-]{0,2})?\(\d{3}\)\s\d{3}\s\d{2}\s\d{2}"
    r"|\d{3}\s\d\s\d{3}\s\d{3}"
    r"|\+44\s?(?:\(0\)\s?)?\d{2,5}(?:[\s-]?\d{3,4}){1,3}|\+44\s?\d{4}\s?\d{6}"
    r"|0\d{2,4}[\s-]\d{3,4}[\s-]\d{3,4}"
    r"|\+(?!1\b|44)\d{1,3}(?:[\s.-]\d{2,4}){2,5}"
    r")(?![\w/]|[.,-]\d)"
)
SSN = re.compile(r"(?<![\w.-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w]|-\d)")
CARD = re.compile(r"(?<![\w.-])(?:\d{4}[- ]?){3}\d{4}(?![\w]|-\d)")
NUMBER = re.compile(r"(?<![\w.$,/+-])(?=[A-Z]{0,3}\d)(?=[A-Z0-9 -]*\d[A-Z0-9 -]*\d[A-Z0-9 -]*\d[A-Z0-9 -]*\d)[A-Z]{0,3}\d[A-Z0-9]*(?:[- ](?=[A-Z0-9]*\d)[A-Z0-9]+)*(?![\w]|[-.]\d)", re.IGNORECASE)

_KIND = "|".join(sorted(KINDS, key=len, reverse=True))
_DIR = "|".join(sorted(DIRECTIONS, key=len, reverse=True))
_STATE = "|".join([*(s.upper() for s in STATES.values()), *(s.title() for s in STATES), "DC"])
_UNIT = r"(?:Apt|Apartment|Unit|Suite|Ste|Flat)\.?\s?#?\s?\d{1,5}[A-Za-z]?\b|#\s?\d{1,5}[A-Za-z]?\b"
_STREET = rf"\d{{1,5}}\s(?:(?:{_DIR})\.?\s)?(?:[A-Z][\w'-]*\s){{1,3}}?(?:{_KIND})\b(?:\.(?=,|\s(?:{_UNIT}|\d{{5}}\b)))?"
_CITY = rf"(?:(?:[A-Z][\w'-]*\s){{0,2}}[A-Z][\w'-]*,?\s(?:{_STATE})\b(?:,?\s\d{{5}}(?:-\d{{4}})?\b)?)"
_BOX = r"P\.?\s?O\.?\sBox\s\d{1,6}\b"
ADDRESS = re.compile(rf"(?<![\w-])(?:(?:{_UNIT}),?\s)?(?:{_STREET}|{_BOX})(?:,?\s(?:{_UNIT}))?(?:,?\s(?:{_CITY}|\d{{5}}(?:-\d{{4}})?\b(?![\s-]\d)))?", re.IGNORECASE)

#: International bank account numbers: country, check digits, groups.
IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])")

#: Words that can label a number in the words before it.
ID_LABELS = frozenset("ssn itin tin ein dl passport licence license member medicare medicaid account acct card visa mastercard amex social security soc policy subscriber patient tax insurance routing iban nhs national".split())
#: Words that may stand between a label and its number.
FILLERS = frozenset("no number id num nr holder reference ref is was are".split())
_LAST_WORDS = re.compile(r"[A-Za-z][A-Za-z'’-]*")

TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")
#: Prior: given names that count as evidence from the first. An empty set leaves all to the other evidence.
GIVEN = frozenset(GIVEN_NAMES) | frozenset(NICKNAMES) | frozenset("álvaro amélie béla chloé inés jiří jürgen noël óscar rené søren zoë".split())

#: Given names that are ordinary words in lower case.
PROSE_NAMES = frozenset("will bill fee dot kit pip ray sue mark frank drew don art pat nick rob grace jack rose may june dick bob barb peg ken sam ed".split())

#: Bits by which a term must point to a protected name before it is taken for part of one.
DISCLOSURE = 3.0


def _mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the disjoint spans blanked, so later patterns can't reach into them."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        out += (text[at:a], "\x00" * (b - a))
        at = b
    return "".join(out) + text[at:]


#: What every text with a labelled number has.
_SOME_LABEL = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(sorted(ID_LABELS))})", re.IGNORECASE)
_CLAUSE = re.compile(r"[;|\n\x00]|[a-z]{3,}[.?!]\s")


def labelled(text: str, at: int) -> bool:
    """The clause before ``at`` ends in a word that labels what follows as an identity number, fillers left out."""
    reach = 40
    while True:
        head = text[max(0, at - reach) : at]
        clause = _CLAUSE.split(head)[-1]
        words = [w.lower() for w in _LAST_WORDS.findall(clause)]
        while words and words[-1] in FILLERS:
            words.pop()
        if len(words) > 2 or len(clause) < len(head) or reach >= at:
            break
        reach *= 4  # nothing but fillers so far
    return bool(words) and (words[-1] in ID_LABELS or words[-1].rstrip("s") in ID_LABELS or (len(words) > 1 and words[-1] in ("sec",) and words[-2] == "soc"))


_AT, _DIGIT = re.compile(r"[(\[]\s?at\s?[)\]]", re.IGNORECASE), re.compile(r"\d")


def shaped(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of mail addresses, phone and identity numbers and postal addresses."""
    found: list[tuple[int, int, str]] = []
    mail = "@" in text or _AT.search(text) is not None
    if not mail and not _DIGIT.search(text):
        return found

    def take(pattern: re.Pattern, kind: str, good: Callable[[re.Match], bool] = lambda m: True) -> None:
        nonlocal rest
        spans = [m.span() for m in pattern.finditer(rest) if good(m)]
        found.extend((a, b, kind) for a, b in spans)
        rest = _mask(rest, spans)

    rest = text
    if mail:
        take(EMAIL, "EMAIL")
    if not _DIGIT.search(rest):
        return found
    take(IBAN, "ID_NUMBER")
    take(CARD, "ID_NUMBER")
    take(SSN, "ID_NUMBER")
    if _SOME_LABEL.search(rest):
        take(NUMBER, "ID_NUMBER", lambda m: labelled(rest, m.start()))
    take(ADDRESS, "ADDRESS", lambda m: bool(re.search(r"[A-Za-z]", m.group())))
    take(PHONE, "PHONE", lambda m: not _toll_free(m.group()))
    return found


def _toll_free(number: str) -> bool:
    digits = re.sub(r"\D", "", number)
    for lead in ("001", "1"):
        if digits.startswith(lead) and len(digits) == 10 + len(lead):
            digits = digits[len(lead) :]
    return len(digits) == 10 and re.match(_TOLL_FREE, digits) is not None


# ---- names by disclosure ------------------------------------------------------------------------------------------


def _words(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]


_INITIAL = re.compile(r"(?<![^\W_])[^\W\d_]\.")
_BROKEN = re.compile(r"-\s*\n\s*\Z")
_TITLE = re.compile(r"\b(?:" + "|".join(sorted(TITLES)) + r")\.", re.IGNORECASE)


def terms_of(text: str) -> list[str]:
    return [w.rstrip(".") for w in TOKEN.findall(text.lower())]


def may_name(text: str, terms: list[str], prior: frozenset[str] = GIVEN) -> bool:
    """Some group of words can be built like a name with a given name of the prior, an initial or a title."""
    return not prior.isdisjoint(terms) or _INITIAL.search(text) is not None or _TITLE.search(text) is not None


def name_candidates(text: str, prior: frozenset[str] = GIVEN) -> list[tuple[int, int, str, str]]:
    """(start, end, term, form): word groups built like a name, with the family term whose disclosure decides.

    Forms: ``full`` given name and family, ``comma`` family before given name, ``initial`` initials and family, ``title``
    a form of address and family, which counts as evidence but is no name with a given name. Titles stay outside.
    """
    words = _words(text)
    low = [w[2].rstrip(".").lower() for w in words]
    n = len(words)
    given = [w in prior and not (words[i][2][0].islower() and (w in PROSE_NAMES or _BROKEN.search(text[max(0, words[i][0] - 4) : words[i][0]]) is not None)) for i, w in enumerate(low)]
    gap = lambda i: text[words[i][1] : words[i + 1][0]] if i + 1 < n else ""
    space = lambda i: gap(i) in (" ", "\n", "  ", "\r\n", "\t")
    initial = lambda i: i < n and len(low[i]) == 1 and words[i][2].endswith(".")
    ends = lambda i: words[i][2].endswith(".") and not initial(i)
    end_of = lambda i: words[i][1] - (1 if ends(i) else 0)
    name = lambda i: i < n and len(low[i]) > 1 and low[i] not in TITLES
    out: list[tuple[int, int, str, str]] = []
    taken = -1  # last word of a full name
    marks = [i for i in range(n) if given[i] or len(low[i]) == 1 or low[i] in TITLES]
    for i in sorted({*marks, *(i - 1 for i in marks if i)}):  # no other word can begin a group
        w, j = low[i], i + 1
        if given[i] and not ends(i):
            while initial(j) and space(j - 1):
                j += 1
            if name(j) and space(j - 1):
                out.append((words[i][0], end_of(j), low[j], "full"))
                taken = j
        elif len(w) > 1 and i != taken and j < n and given[j] and gap(i) in (", ", ",\n"):
            while initial(j + 1) and space(j):
                j += 1
            out.append((words[i][0], words[j][1] if initial(j) else end_of(j), w, "comma"))
        elif len(w) > 1 and i != taken and initial(j) and gap(i) == ", " and words[i][2][0].isupper():
            out.append((words[i][0], words[j][1], w, "initial"))
        elif initial(i) and not (i and initial(i - 1) and space(i - 1)) and not (i and given[i - 1] and space(i - 1)):
            while initial(j) and space(j - 1):
                j += 1
            if name(j) and space(j - 1) and not given[j]:
                out.append((words[i][0], end_of(j), low[j], "initial"))
        elif w in TITLES and words[i][2].endswith(".") and name(j) and space(i) and not given[j]:
            out.append((words[j][0], end_of(j), low[j], "title"))
    return out


_BIG = r"[^\W\d_a-zß-ÿ][^\W\d_]+(?:['’-][^\W\d_]+)*"
_PAIR = re.compile(rf"(?<![^\W_])(?<![^\W_]['’.-])({_BIG})((?:\s[^\W\d_a-z]\.){{0,2}}\s|,\s)({_BIG})((?:\s[^\W\d_a-z]\.){{0,2}})(?![\w@])(?!\s[^\W\d_a-z]|['’-]\w)")


def pair_candidates(text: str, prior: frozenset[str] = GIVEN) -> list[tuple[int, int, str, str]]:
    """(start, end, first, term): the last two of a run of capitalised words, or two with a comma between them and the
    family name in front, if the first name is none of the prior.

    Whether they are a name, the information of both terms decides.
    """
    out = []
    for m in _PAIR.finditer(text):
        comma = m[2][0] == ","
        first, term = (m[3].lower(), m[1].lower()) if comma else (m[1].lower(), m[3].lower())
        if first not in prior and first not in TITLES and term not in TITLES:
            out.append((m.start(), m.end() if comma else m.end(3), first, term))
    return out


def counted(text: str, found: list[tuple[int, int, str, str]]) -> list[str]:
    """Terms that stand in a name-like group; what follows "Family, Given" is no name and a lower-case comma may be the sentence's."""
    out, comma_end = [], -1
    for a, b, term, form in found:  # in order of start
        if form == "comma":
            comma_end = max(comma_end, b)
            if text[a].isupper():
                out.append(term)
        elif form != "full" or a >= comma_end:
            out.append(term)
    return out


def disclosure(seen, beside, p_beside: float):
    """Pointwise information in bits between a term and a name-like group, with one pseudo-count; works on columns too."""
    if isinstance(seen, (int, float)):
        return math.log2((beside + 0.5) / (seen + 1.0) / p_beside) if beside else -math.inf
    return F.when(beside > 0, F.log2((beside + 0.5) / (seen + 1.0) / p_beside)).otherwise(F.lit(-99.0))


# ---- distributed --------------------------------------------------------------------------------------------------

FOUND = pa.schema([("src", pa.string()), ("row_id", pa.int64()), ("start", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("term", pa.string()), ("first", pa.string()), ("seen", pa.int64()), ("beside", pa.int64())])
FOUND_DDL = "src string, row_id bigint, start int, kind string, value string, term string, first string, seen bigint, beside bigint"
#: Terms held by a task before their counts are handed on.
MAX_TERMS = 200_000


def hidden(text: str, inside: str | None) -> str:
    """The text with every occurrence of ``inside`` blanked."""
    return text.replace(inside, "\x00" * len(inside)) if inside else text


def _read(prior: frozenset[str]):
    """Found values, name candidates and term counts of each text in one pass over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        beside: Counter = Counter()

        def counts() -> pa.RecordBatch:
            terms = list(seen)
            n = len(terms)
            columns = [[None] * n, [None] * n, [None] * n, ["TERM"] * n, [None] * n, terms, [None] * n, list(seen.values()), [beside[t] for t in terms]]
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)
            seen.clear(), beside.clear()
            return batch

        for batch in batches:
            rows: list[tuple] = []
            for src, row_id, text, inside, etype, own in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if etype == "PERSON" and inside:  # a value known to be a person: its last word, or the one before a comma
                    known = terms_of(inside.split(",")[0])
                    if known:
                        seen[known[-1]] += 1
                        beside[known[-1]] += 1
                text = hidden(text, inside)
                spans = shaped(text)
                have = set()
                for a, b, kind in spans:
                    if (kind, text[a:b]) not in have:
                        have.add((kind, text[a:b]))
                        rows.append((src, row_id, a, kind, text[a:b], None, None, 0, 0))
                rest = _mask(text, [(a, b) for a, b, _ in spans])
                terms = terms_of(rest)
                seen.update(terms)
                pairs = pair_candidates(rest, prior)
                if may_name(rest, terms, prior):
                    found = name_candidates(rest, prior)
                    beside.update(counted(rest, found))
                    whole = {b: a for a, b, _, form in found if form in ("full", "comma")}
                    pairs = [p for p in pairs if p[1] not in whole]
                    longer = {p[1]: p[2] for p in pairs}  # with a given name in front of the initial, if it is one
                    for a, b, term, form in found:
                        if form != "title" and text[a:b] not in have:
                            have.add(text[a:b])
                            rows.append((src, row_id, a, "PERSON", text[a:b], term, longer.get(b) if form == "initial" else None, 0, 0))
                for a, b, first, term in pairs:
                    if text[a:b] not in have:
                        have.add(text[a:b])
                        # where a sentence, or a line caught whole, begins, any word is capitalised: no evidence
                        ahead = rest[max(0, a - 40) : a].rstrip()[-1:]
                        inner = (ahead.islower() or ahead == ",") and not (own and text.startswith(own, a))
                        rows.append((src, row_id, a, "PAIR", text[a:b], term, first, 0, int(inner)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)
            if len(seen) > MAX_TERMS:
                yield counts()
        if seen:
            yield counts()

    return run


def personal_values(texts: DataFrame, threshold: float = DISCLOSURE, prior: frozenset[str] = GIVEN) -> DataFrame:
    """(src, row_id, start, kind, value) of ``texts(src, row_id, text, inside)``; ``inside`` is left out of the text.

    One row per distinct value of a text and kind. Null and empty texts give no row. A column ``etype`` says what
    ``inside`` is; persons among them are evidence. A column ``own`` holds a value that isn't left out, but begins anew as a
    sentence does. ``prior`` are given names taken for such without evidence.
    """
    texts = texts.withColumns({c: F.lit(None).cast("string") for c in ("etype", "own") if c not in texts.columns})
    held = texts.where("text IS NOT NULL").select("src", F.col("row_id").cast("bigint").alias("row_id"), "text", "inside", "etype", "own")
    read = cut(held.mapInArrow(_read(prior), FOUND_DDL))
    terms = cut(read.where("kind = 'TERM'").groupBy("term").agg(F.sum("seen").alias("seen"), F.sum("beside").alias("beside")))
    total = terms.agg(F.sum("seen").alias("seen"), F.sum("beside").alias("beside")).first()
    p_beside = max(1, total["beside"] or 0) / max(1, total["seen"] or 0)
    above = lambda of, beside: of.where(disclosure(F.col("seen"), F.col(beside), p_beside) >= threshold)
    families = above(terms, "beside").select("term")
    pairs = read.where("kind = 'PAIR'").select("src", "row_id", "start", "value", "term", "first", "beside")
    # given names: what stands before family names; further family names: what stands after given names
    before = pairs.where("beside = 1 AND NOT value LIKE '%,%'").join(families, "term", "left_semi").groupBy("first").agg(F.count("*").alias("n")).where("n > 1")
    givens = cut(above(before.join(terms.select(F.col("term").alias("first"), "seen"), "first"), "n").select("first"))
    likely = cut(pairs.join(givens, "first", "left_semi"))
    after = likely.groupBy("term").agg(F.count("*").alias("n")).join(terms.select("term", "seen"), "term")
    names = families.unionByName(above(after, "n").select("term")).distinct()

    shapes = read.where("kind NOT IN ('TERM', 'PERSON', 'PAIR')").select("src", "row_id", "start", "kind", "value")
    persons = read.where("kind = 'PERSON'").join(names, "term", "left_semi").join(givens, "first", "left_anti").select("src", "row_id", "start", "kind", "value")
    unlisted = likely.join(names, "term", "left_semi").select("src", "row_id", "start", F.lit("PERSON").alias("kind"), "value")
    return shapes.unionByName(persons).unionByName(unlisted)


_WORD_START = re.compile(r"(?<![^\W_])\S|[^\w\s]|_")


#: What the types of detections are called in a placeholder; companies and whole lines have none.
ENTITY_KINDS = {"PERSON": "PERSON", "ADDRESS": "ADDRESS", "PHONE": "PHONE", "EMAIL": "EMAIL", "SSN": "ID_NUMBER", "ACCOUNT_NUMBER": "ID_NUMBER", "CREDIT_CARD": "ID_NUMBER"}


#: Up to so many values are looked up one after the other.
FEW_VALUES = 16


def standing(text: str, value: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of every place of ``value``; ``whole``: not inside a longer word."""
    out, a = [], text.find(value) if value else -1
    while a >= 0:
        b = a + len(value)
        out.append((a, b, not (value[0].isalnum() and a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())))
        a = text.find(value, a + 1)
    return out


def replaced(text: str, values: list[tuple[str, str]], own: tuple[str, str] | None = None) -> str:
    """The text with every whole occurrence of the values ``(kind, value)`` as ``[kind]``, and ``own`` inside longer words too
    if it stands nowhere as a whole.

    Many values take one pass: at the start of a word those that begin like it are compared, the longest first. Values that
    overlap become one placeholder, that of the longest, so no end of any value stays behind.
    """
    if not values and not own:
        return text
    spans: list[tuple[int, int, str]] = []
    if own:
        places = standing(text, own[1])
        whole = [p for p in places if p[2]]
        spans += [(a, b, own[0]) for a, b, _ in whole or places]
    if len(values) <= FEW_VALUES:
        spans += [(a, b, kind) for kind, value in values for a, b, whole in standing(text, value) if whole]
    else:
        begin: dict[str, list[tuple[str, str]]] = {}
        for kind, value in sorted(values, key=lambda v: -len(v[1])):
            begin.setdefault(value[:3], []).append((kind, value))
        for m in _WORD_START.finditer(text):
            i = m.start()
            for kind, value in begin.get(text[i : i + 3], ()):
                end = i + len(value)
                if text.startswith(value, i) and not (end < len(text) and text[end].isalnum()):
                    spans.append((i, end, kind))
                    break
    joined: list[list] = []  # start, end, kind, length of the longest
    for a, b, kind in sorted(spans, key=lambda v: v[0]):
        if joined and a < joined[-1][1]:
            last = joined[-1]
            last[1] = max(last[1], b)
            if b - a > last[3]:
                last[2:] = kind, b - a
        else:
            joined.append([a, b, kind, b - a])
    out, at = [], 0
    for a, b, kind, _ in joined:
        out += (text[at:a], f"[{kind}]")
        at = b
    return "".join(out) + text[at:]


def _redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [[(v["kind"], v["value"]) for v in vs] if vs is not None else [] for vs in pdf["found"]]
        own = [(ENTITY_KINDS[e], i) if i and e in ENTITY_KINDS else None for i, e in zip(pdf["inside"], pdf["etype"])]
        count = [len({*v, o} if o and o[1] in t else v) for t, v, o in zip(pdf["text"], found, own)]
        yield pd.DataFrame({"src": pdf["src"], "row_id": pdf["row_id"], "values": count, "redacted": [replaced(t, v, o) for t, v, o in zip(pdf["text"], found, own)]})


def redacted_texts(texts: DataFrame, threshold: float = DISCLOSURE, prior: frozenset[str] = GIVEN) -> DataFrame:
    """(src, row_id, values, redacted): each text with its values replaced by ``[KIND]``; texts without any come out as they are.

    Here ``inside`` isn't left out: the whole text is searched, and ``inside`` itself is replaced by the placeholder of
    its type in the column ``etype``, if there is such a column and the type is one of ENTITY_KINDS. Only companies are
    kept out of the search, as "P. M. Corp" is built like a person's name.
    """
    if "etype" not in texts.columns:
        texts = texts.withColumn("etype", F.lit(None).cast("string"))
    values = cut(personal_values(texts.withColumn("own", F.col("inside")).withColumn("inside", F.when(F.col("etype") == "ORG", F.col("inside"))), threshold, prior))
    row = F.xxhash64("src", "row_id")
    concerned = passes(value_filter(values.select(row.alias("h")), "h"), row)
    found = values.groupBy("src", "row_id").agg(F.collect_list(F.struct("kind", "value")).alias("found"))
    held = texts.where("text IS NOT NULL").select("src", F.col("row_id").cast("bigint").alias("row_id"), "text", "inside", "etype")
    # only texts with something found are shuffled to meet it
    near, far = held.where(concerned), held.where(~concerned).withColumn("found", F.lit(None).cast("array<struct<kind:string,value:string>>"))
    met = near.join(found, ["src", "row_id"], "left").select(far.columns)
    return met.unionByName(far).mapInPandas(_redact, "src string, row_id bigint, values int, redacted string")
