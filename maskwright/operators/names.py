"""Names and addresses by capitalisation and word lists, without a model.

Each line is reduced to one letter per word that says what the word can be; the shapes of names and addresses are then
regular expressions over these letters. Runs whole documents per Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.operators.rules import DETECTIONS

#: Order of these detections after all rules.
AFTER_RULES = 500
RULE_NAME = "NER (dictionary)"

#: Words of the closed classes of English, by class: no name holds one of them. Ordinary nouns, verbs and adjectives are an
#: open class and come from the texts themselves (``fitted_words``) or from a list that the caller has (``word_list``).
FUNCTION_WORDS = frozenset(
    " ".join(
        [
            "a an the",  # articles
            "this that these those each every either neither some any no all both half several enough such what which whose",  # determiners
            "i me my mine myself you your yours yourself he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves who whom one none",  # pronouns
            "about above across after against along among around at before behind below beneath beside between beyond by despite down during except for from in inside into near of off on onto out outside over past per since through throughout to toward under until up upon via with within without",  # prepositions
            "and or but nor so yet if unless because although though whereas while than as whether",  # conjunctions
            "be am is are was were been being have has had having do does did done will would shall should can could may might must",  # auxiliaries
            "not never always often again also too very just only even still already here there now then when where why how however therefore please",  # adverbs of time, place and degree
        ]
    ).split()
)

# Words of organisations, products and documents that no personal name holds.
ORGANISATION_WORDS = frozenset(
    """
vanguard fidelity schwab finra sipc fdic sec nyse nasdaq brokerage corporation services marketing associates holdings
capital investments securities fund trust bank insurance advisory advisors financial mutual exchange trading wealth
management admiral index market etf stock bond treasury money sweep cl semiconductor vaneck fabless shares equity reit
commodities futures options allocation benchmark composite yield maturity duration prospectus inc llc corp ltd company
co group international national federal american institute foundation association department university hospital medical
center committee broker dealer ascensus custodian fiduciary underwriter personal investor account statement summary
report portfolio premium basic standard professional total dividend growth income balanced retirement target quantity
price cost basis commissions trade sell buy cash reinvestment balance estimated annual interest realized unrealized gain
loss net gross fee fees expense ratio return performance contribution distribution withdrawal deposit proceeds principal
accrued settlement transaction valuation appreciation depreciation act protection rating ratings copyright intelligence
reproduction global reserved rights trademark registered disclaimer disclosure regulation compliance provision liability
warranty clause page break po box ira sep roth
""".split()
)

_WORD = re.compile(r"\S+")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CAPS = re.compile(r"[A-Z]{2,}")
_VOWEL = re.compile(r"[AEIOU]")

#: Letters: c candidate, o candidate of an organisation; upper case at the start of a sentence. At most three words, the
#: first not at a start, none of an organisation.
_TITLE_SHAPE = re.compile(r"c[cC]{2}|c[cC](?![cCoO])")
#: Letters: x plain, o organisation, common words f and g; only the first may be common.
_CAPS_SHAPE = re.compile(r"[xf]x{2}|[xf]x(?![xo])")
#: Letters: d all digits, C capitalised.
_ADDRESS_SHAPE = re.compile(r"dC{1,3}")
#: What every line with a find has: two words in a row, punctuation aside, of which the second begins with a capital and
#: the first with a capital or a digit.
_HINT = re.compile(r"(?<!\S)[^\Wa-z_]\S*\s+(?:(?:[^\w\s]|_)+\s+)*[^\Wa-z\d_]")
_BAD_IN_NAME = re.compile(r"[^\x00-\x7F]|[.&]|XXXX|xxxx")
_BAD_IN_ADDRESS = re.compile(r"[^\x00-\x7F]|&")


def _capitalised(word: str) -> bool:
    return word[0].isupper() and (len(word) > 1 or len(word.encode()) > 1)


def line_words(line: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, word without punctuation at its end, begins a sentence) of a line; words of punctuation alone are dropped."""
    out, fresh = [], True
    for m in _WORD.finditer(line):
        word = m.group().rstrip(_PUNCTUATION)
        if word:
            out.append((m.start(), m.start() + len(word), word, fresh))
        fresh = m.group()[-1] in ".!?"
    return out


def find_names(text: str, common: frozenset[str] = FUNCTION_WORDS, organisations: frozenset[str] = ORGANISATION_WORDS) -> list[tuple[int, int, str]]:
    """(start, end, type) of PERSON and ADDRESS spans; line by line, names before addresses."""
    found: list[tuple[int, int, str]] = []
    base = 0
    for line in text.split("\n"):
        if _HINT.search(line) is None:
            base += len(line) + 1
            continue
        words = line_words(line)
        low = [w[2].lower() for w in words]
        known, company = [w in common for w in low], [w in organisations for w in low]
        big = [_capitalised(w[2]) for w in words]
        title = "".join((("o" if company[i] else "c") if not w[3] else ("O" if company[i] else "C")) if big[i] and not known[i] else "." for i, w in enumerate(words))
        caps = "".join(("xo" if not known[i] else "fg")[company[i]] if _CAPS.fullmatch(w[2]) and _VOWEL.search(w[2]) else "." for i, w in enumerate(words))
        i = 0
        while i < len(words):
            m = _TITLE_SHAPE.match(title, i) or _CAPS_SHAPE.match(caps, i)
            if m is None:
                i += 1
                continue
            a, b = words[i][0], words[m.end() - 1][1]
            if not _BAD_IN_NAME.search(line, a, b):
                found.append((base + a, base + b, "PERSON"))
            i = m.end()
        shape = "".join("d" if w[2].isascii() and w[2].isdigit() else "C" if big[i] else "." for i, w in enumerate(words))
        for m in _ADDRESS_SHAPE.finditer(shape):
            a, b = words[m.start()][0], words[m.end() - 1][1]
            if not _BAD_IN_ADDRESS.search(line, a, b):
                found.append((base + a, base + b, "ADDRESS"))
        base += len(line) + 1
    return found


def dictionary_detector(common: frozenset[str] = FUNCTION_WORDS, organisations: frozenset[str] = ORGANISATION_WORDS) -> Callable[[Column], Column]:
    """A detector: text column to detections column. Null text gives no detections."""

    @F.pandas_udf(DETECTIONS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[(a, b, t[a:b], kind, RULE_NAME, AFTER_RULES + i) for i, (a, b, kind) in enumerate(find_names(t, common, organisations))] if t else [] for t in texts])

    return lambda text: run(text)


def name_words(text: Column) -> Column:
    """Words of a text as structs of line, position, word and flags; JVM-side counterpart of ``line_words``."""
    empty = "array<struct<line:int,pos:int,word:string,capitalised:boolean,all_caps:boolean,sentence_start:boolean>>"

    def of_line(line: Column, n: Column) -> Column:
        raw = F.regexp_extract_all(line, F.lit(r"(?U)\S+"), F.lit(0))
        plain = lambda w: F.regexp_replace(w, r"[\p{Punct}]+$", "")

        def word(w: Column, i: Column) -> Column:
            before = F.try_element_at(raw, F.when(i > 0, i).otherwise(F.lit(None).cast("int")))
            return F.struct(n.alias("line"), i.alias("pos"), plain(w).alias("word"), (plain(w).rlike(r"^\p{Lu}") & (F.octet_length(plain(w)) > 1)).alias("capitalised"), plain(w).rlike("^[A-Z]{2,}$").alias("all_caps"), F.coalesce(before.rlike(r"[.!?]$"), F.lit(True)).alias("sentence_start"))

        return F.filter(F.transform(raw, word), lambda s: s["word"] != "")

    return F.flatten(F.transform(F.split(text, "\n"), of_line)).cast(empty)


def common_words_of(texts, minimum: int = 3, text: str = "text"):
    """(word): words of a corpus that stand in lower case at least ``minimum`` times and more often than capitalised.

    Counted over all texts.
    """
    return _counted(texts, minimum, text).select("word")


def _counted(texts, minimum: int, text: str):
    words = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?U)\p{L}+"), F.lit(0))).alias("w"))
    counted = words.groupBy(F.lower("w").alias("word")).agg(F.count_if(F.col("w") == F.lower("w")).alias("low"), F.count("*").alias("n"))
    return counted.where((F.col("low") >= minimum) & (F.col("low") * 2 > F.col("n")))


#: Ordinary words that a detector takes from a corpus at most: the commonest, at the end by alphabet.
MAX_FITTED = 20_000


def fitted_words(texts, minimum: int = 3, text: str = "text", at_most: int = MAX_FITTED) -> frozenset[str]:
    """The list for ``dictionary_detector``: closed classes and the commonest ordinary words of all texts.

    It travels with the detector, so its size is bounded by ``at_most``, about half a megabyte; only words that also stand
    capitalised somewhere matter to the detector, and only they are taken.
    """
    held = _counted(texts, minimum, text).where("n > low").orderBy(F.desc("low"), "word").limit(at_most)
    return FUNCTION_WORDS | {r["word"] for r in held.select("word").collect()}


def word_list(path: str) -> frozenset[str]:
    """A list of the caller's own for ``dictionary_detector``: one word a line, in any case; blank lines don't count."""
    with open(path, encoding="utf-8") as f:
        return frozenset(w.strip().lower() for w in f if w.strip())
