import random

import numpy as np
import pytest

from maskwright.llm.leakage import MIN_WORDS, NAME, NUMBER, PER_ALTERED, PLAIN, leaked_passages, longest_stretch, longest_template, refilled_templates

VOCABULARY = [a + b for a in ("ba", "ke", "mi", "no", "tu") for b in ("ra", "se", "lo", "pi", "du", "go")]


def brute(words, passage):
    """Longest stretch over all diagonals by trying every pair of ends."""
    best = 0
    for offset in range(-len(passage), len(words)):
        for i in range(len(passage)):
            altered = 0
            for j in range(i, len(passage)):
                if not 0 <= j + offset < len(words):
                    altered = 10**9
                    break
                altered += words[j + offset] != passage[j]
                n = j - i + 1
                if n >= MIN_WORDS and altered * PER_ALTERED <= n:
                    best = max(best, n)
    return best


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_against_brute_force(spark):
    """All ends of all diagonals of all documents and items."""
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(40))) for i in range(4)]
    texts = []
    for _ in range(60):
        words = rng.choice(items)[1].split()
        a = rng.randint(0, 20)
        part = words[a : a + rng.randint(15, 30)]
        for k in rng.sample(range(len(part)), rng.randint(0, 4)):
            part[k] = rng.choice([*VOCABULARY, "unknown", "17"])
        texts.append(" ".join([rng.choice(VOCABULARY) for _ in range(12)] + part + [rng.choice(VOCABULARY) for _ in range(9)]))
    want = {(d, j, n) for d, t in enumerate(texts) for j, p in items if (n := brute(t.split(), p.split()))}
    found = leaked_passages(docs(spark, *texts), spark.createDataFrame(items, "item_id bigint, passage string"))
    assert set(map(tuple, found.collect())) == want and len(want) > 10


def test_stretch():
    p = np.arange(1, 41)
    assert longest_stretch(p, p, 0) == 40 and longest_stretch(p[:19], p, 0) == 0 and longest_stretch(p[::-1].copy(), p, 0) == 0


PASSAGE = "At Gannet Springs, our harbour (largely) enclosed 45 kg of one absence and the reference since the move. As a result, this envelope had been copied."


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "too short")], "item_id bigint, passage string")


def test_leaks(spark, items):
    words = PASSAGE.split()
    other = "At Larch Crossing, our harbour (largely) enclosed 99 kg of one absence and the reference since the move. As a result, this envelope had been copied."
    found = leaked_passages(docs(spark, "Before. " + PASSAGE.upper().replace(" ", "\n"), " ".join(words[:18]), " ".join(sorted(words)), None, "", other), items)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(0, 1), (5, 1)]


def test_small_filters_lose_nothing(spark, items):
    d = docs(spark, PASSAGE, "x " * 50_000 + PASSAGE)
    whole = sorted(map(tuple, leaked_passages(d, items).collect()))
    assert whole == sorted(map(tuple, leaked_passages(d, items, filter_bits=7).collect())) and len(whole) == 2


QUESTION = "In the summer, Priya Natarajan paid 45 kg of rice to Dmitri Volkov, and then Dmitri Volkov gave 12 kg back to Priya Natarajan because 45 was too much for one person to carry home alone."


def test_questions_asked_again(spark):
    items = spark.createDataFrame([(1, QUESTION)], "item_id bigint, passage string")
    again = lambda a, b, m, n: QUESTION.replace("Priya Natarajan", a).replace("Dmitri Volkov", b).replace("45", m).replace("12", n)
    mixed = again("Wei Zhang", "Aisha Khan", "70", "31").replace("because 70", "because 99")
    d = docs(spark, "Once. " + again("Wei Zhang", "Aisha Binte Khan", "70", "31"), mixed, QUESTION, QUESTION.upper(), "Nothing of the kind.", again("Wei Zhang", "Wei Zhang", "70", "31"))
    got = {r["doc_id"]: (r["template_words"], r["changed_slots"]) for r in refilled_templates(d, items).collect()}
    assert set(got) == {0, 1} and got[0][1] == 7 and got[0][0] > got[1][0] >= MIN_WORDS  # the mixed one only up to where it breaks
    assert {r["doc_id"] for r in leaked_passages(d, items).collect()} >= {2, 3}


def test_slots_must_agree():
    plain = np.arange(100, 125, dtype=np.uint64)
    types = np.full(25, PLAIN, np.int8)
    types[[3, 20]], types[7] = NAME, NUMBER
    item, doc = plain.copy(), plain.copy()
    item[[3, 20]], doc[[3, 20]] = 1, 2
    assert longest_template(doc, types, item, types, 0) == (25, 2)
    doc[20] = 3
    assert longest_template(doc, types, item, types, 0) == (21, 1)
    other = types.copy()
    other[7] = NAME
    assert longest_template(doc, other, item, types, 0) == (0, 0)


def test_one_window_in_all_documents(spark, items):
    d = docs(spark, *([PASSAGE] * 300))
    assert leaked_passages(d, items).count() == 300


def test_empty(spark, items):
    assert leaked_passages(docs(spark), items).count() == 0 and leaked_passages(docs(spark, PASSAGE), items.where("false")).count() == 0
