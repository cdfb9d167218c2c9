import pytest

from maskwright.llm.personal import ENTITY_KINDS, disclosure, labelled, name_candidates, pair_candidates, personal_values, redacted_texts, replaced, shaped

SCHEMA = "src string, row_id bigint, text string, inside string"


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("Send to: a.b+c@mail.x.example.", "EMAIL", "a.b+c@mail.x.example"),
        ("mail ab-3 (at) post dot cove dot example, today", "EMAIL", "ab-3 (at) post dot cove dot example"),
        ("mail x [at] y.test now", "EMAIL", "x [at] y.test"),
        ("call (555)\n493-1642.", "PHONE", "(555)\n493-1642"),
        ("call 555 / 563 / 9548 or", "PHONE", "555 / 563 / 9548"),
        ("call +1 (555) 278-2502;", "PHONE", "+1 (555) 278-2502"),
        ("call 01632 960 822.", "PHONE", "01632 960 822"),
        ("call +44 1632 960822.", "PHONE", "+44 1632 960822"),
        ("call 001 555 605 5934;", "PHONE", "001 555 605 5934"),
        ("carries 903-83-2739, as", "ID_NUMBER", "903-83-2739"),
        ("social security no. 903212211. each", "ID_NUMBER", "903212211"),
        ("licence no. D302-0454-5007.", "ID_NUMBER", "D302-0454-5007"),
        ("Passport #X36926958.", "ID_NUMBER", "X36926958"),
        ("policy holder no. QW3688154 was", "ID_NUMBER", "QW3688154"),
        ("The tax reference is 44556677.", "ID_NUMBER", "44556677"),
        ("NHS number 943 476 5919.", "ID_NUMBER", "943 476 5919"),
        ("national id 8812345678 was", "ID_NUMBER", "8812345678"),
        ("pay to GB29 NWBK 6016 1331 9268 19 today", "ID_NUMBER", "GB29 NWBK 6016 1331 9268 19"),
        ("card 4111 1111 1111 1111.", "ID_NUMBER", "4111 1111 1111 1111"),
        ("at 3966 Elm Cir, Apt 49, Larch Falls, KS 76061 today", "ADDRESS", "3966 Elm Cir, Apt 49, Larch Falls, KS 76061"),
        ("at Apt 70, 9482 North Elm Terrace; work", "ADDRESS", "Apt 70, 9482 North Elm Terrace"),
        ("at 9119 Elm Blvd, Apt 3\nMarrow Crossing, OR 19371, this", "ADDRESS", "9119 Elm Blvd, Apt 3\nMarrow Crossing, OR 19371"),
        ("to PO Box 97, Copper Valley, ME 47038.", "ADDRESS", "PO Box 97, Copper Valley, ME 47038"),
    ],
)
def test_shapes(text, kind, value):
    assert [(k, text[a:b]) for a, b, k in shaped(text)] == [(kind, value)]


@pytest.mark.parametrize("text", ["Toll-free help: 1-888-555-7665.", "Invoice 505-3570 covers it.", "Order no. 24626 was", "Item 8795 of batch 132", "Version 18.04.828 of", "came to $8727,850.28 then", "closed on 2025-06-16.", "Between 05:15 and 09:45", "Room 14, second floor", "", "plain"])
def test_no_cases(text):
    assert shaped(text) == []


def forms(text):
    return [(text[a:b], f) for a, b, _, f in name_candidates(text)]


def test_name_forms():
    assert forms("to Kenneth B. Minsunher another") == [("Kenneth B. Minsunher", "full")]
    assert forms("also Gornilvar, Kenneth our")[0] == ("Gornilvar, Kenneth", "comma")
    assert forms("for O. Verbrorbal, this") == [("O. Verbrorbal", "initial")]
    assert forms("Present: Nicholas Trenpinlor, Archibald Fenrolvun.") == [("Nicholas Trenpinlor", "full"), ("Archibald Fenrolvun", "full")]
    assert forms("it will be done, bill paid") == []


def texts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


PROSE = "the long report was signed and the other report was sent by the clerk of the office " * 40


def test_names_need_disclosure(spark):
    rows = [("text", 1, PROSE, None), ("text", 2, "by Kenneth Minsunher. M. Minsunher, again. Then Kenneth signed. Minsunher, Kenneth the clerk", None), ("text", 3, None, None), ("text", 4, "", None)]
    got = sorted((r["row_id"], r["kind"], r["value"]) for r in personal_values(texts(spark, rows)).collect())
    assert got == [(2, "PERSON", "Kenneth Minsunher"), (2, "PERSON", "M. Minsunher"), (2, "PERSON", "Minsunher, Kenneth")]


def test_own_match_is_left_out_and_values_are_distinct(spark):
    rows = [("context", 1, "... a@b.test and c@d.test and c@d.test", "a@b.test"), ("context", 2, "... a@b.test", "a@b.test"), ("context", 2, "x 555-123-4567", "")]
    assert sorted((r["row_id"], r["value"]) for r in personal_values(texts(spark, rows)).collect()) == [(1, "c@d.test"), (2, "555-123-4567")]


def test_empty_table(spark):
    assert personal_values(texts(spark, [])).count() == 0 and redacted_texts(texts(spark, [])).count() == 0


def test_redaction_keeps_the_rest(spark):
    rows = [("text", 1, PROSE + "mail a@b.test to Kenneth Minsunher, now", None), ("text", 2, PROSE, None)]
    got = {r["row_id"]: r["redacted"] for r in redacted_texts(texts(spark, rows)).collect()}
    assert got == {1: PROSE + "mail [EMAIL] to [PERSON], now", 2: PROSE}


def test_disclosure_in_bits():
    assert disclosure(8, 0, 0.01) == float("-inf") and disclosure(9, 9, 0.01) > 6 > 0 > disclosure(10_000, 9, 0.01)


def test_redaction_covers_the_own_match(spark):
    """A context comes out without the value its detection is about, and lines caught whole are searched inside."""
    rows = [
        ("context", 1, "...beyond the garage Hnrietta Salgurbur, mail c@d.test", "Hnrietta Salgurbur", "PERSON"),
        ("context", 2, "...near the crew (555) 010-0042 for 555-295-4955, today", "(555) 010-0042", "PHONE"),
        ("context", 3, "...the intake 900-09-7184 our quarry", "900-09-7184", "SSN"),
        ("context", 4, "...the guardian On file: SSN 982420614. our custodian", "On file: SSN 982420614.", "FREE_TEXT"),
        ("context", 5, "...the absence Fongreskex Estate Limited their", "Fongreskex Estate Limited", "ORG"),
        ("context", 6, "...sent to 17 Elm Street, Larch Falls, KS 76061 today", "Elm Street", "ADDRESS"),
        ("text", 7, PROSE, None, None),
    ]
    got = {r["row_id"]: (r["values"], r["redacted"]) for r in redacted_texts(spark.createDataFrame(rows, SCHEMA + ", etype string")).collect()}
    assert got == {
        1: (2, "...beyond the garage [PERSON], mail [EMAIL]"),
        2: (2, "...near the crew [PHONE] for [PHONE], today"),
        3: (1, "...the intake [ID_NUMBER] our quarry"),
        4: (1, "...the guardian On file: SSN [ID_NUMBER]. our custodian"),
        5: (0, rows[4][2]),
        6: (2, "...sent to [ADDRESS] today"),
        7: (0, PROSE),
    }


def test_overlapping_values_leave_no_rest():
    assert replaced("x Lumbar, Kenneth Minsunher y", [("PERSON", "Lumbar, Kenneth"), ("PERSON", "Kenneth Minsunher")]) == "x [PERSON] y"
    assert replaced("by R. Hnrietta Salgurbur.", [("PERSON", "R. Hnrietta")], ("PERSON", "Hnrietta Salgurbur")) == "by [PERSON]."
    assert replaced("Li met Lila, Li", [], ("PERSON", "Li")) == "[PERSON] met Lila, [PERSON]"
    assert replaced("no.x9001y", [], ("ID_NUMBER", "9001")) == "no.x[ID_NUMBER]y"


def test_labels_are_found_however_far_they_stand():
    far = "member " + "number id " * 60
    assert labelled(far, len(far)) and not labelled("invoice " + far[7:], len(far) + 1) and not labelled("number " * 200, 1400)
    assert not labelled("Signed by a member. It was number ", 34)


def test_pairs_of_capitalised_words():
    assert pair_candidates("then Priya K. Natarajan left, as Volkov, Dmitri did; North Long Way Home", frozenset()) == [(5, 23, "priya", "natarajan"), (33, 47, "dmitri", "volkov"), (64, 72, "way", "home")]
    assert pair_candidates("mail Priya Natarajan@x.test and O'Neil-Natarajan", frozenset()) == []


FAMILIES = ["Natarajan", "Volkov", "Zhang", "Okafor", "Lindqvist", "Haddad"]
GIVENS = ["Priya", "Dmitri", "Wei", "Chidi", "Saoirse", "Layla"]


@pytest.mark.parametrize("prior", [None, frozenset()])
def test_names_on_no_list(spark, prior):
    """Families are known by titles and initials in some texts; given names by standing before them; both then by each other."""
    rows = [("text", i, f"{PROSE} At noon Dr. {f} met {g[0]}. {f} there. The letter was by {g} {f} alone.", None) for i, (g, f) in enumerate((g, f) for g in GIVENS for f in FAMILIES)]
    rows += [("text", 100, f"{PROSE} Then Priya Ramanujan and also Priya Ramanujan, with Ramanujan, Priya there.", None), ("text", 101, f"{PROSE} In Green Valley the Copper Room, and Long Harbour Plan of Green Valley.", None)]
    found = personal_values(texts(spark, rows), **({} if prior is None else {"prior": prior})).where("kind = 'PERSON'").collect()
    got = {}
    for r in found:
        got.setdefault(r["row_id"], set()).add(r["value"])
    for i, (g, f) in enumerate((g, f) for g in GIVENS for f in FAMILIES):
        assert got[i] == {f"{g[0]}. {f}", f"{g} {f}"}
    assert got[100] == {"Priya Ramanujan", "Ramanujan, Priya"} and 101 not in got


def test_known_persons_are_evidence(spark):
    rows = [("context", i, f"{PROSE} and {g} Natarajan with Thandeka {f} too", f"{g} Natarajan", "PERSON") for i, g in enumerate(GIVENS) for f in FAMILIES]
    rows += [("context", 50 + i, f"{PROSE} by {f}, Priya here", f"{f}, Priya", "PERSON") for i, f in enumerate(FAMILIES)]
    got = {r["value"] for r in personal_values(spark.createDataFrame(rows, SCHEMA + ", etype string"), prior=frozenset()).where("kind = 'PERSON'").collect()}
    assert got == {f"Thandeka {f}" for f in FAMILIES}


def test_no_known_value_survives(spark, small):
    """Every context of the data: neither the value its detection is about nor any value found beside it is left."""
    from maskwright.llm import queries

    held = queries._free_texts(spark, small)
    own = {(r["src"], r["row_id"]): r["inside"] for r in held.where("text IS NOT NULL AND inside IS NOT NULL").collect() if r["etype"] in ENTITY_KINDS}
    out = {(r["src"], r["row_id"]): r["redacted"] for r in queries.p3_redacted(spark, small).collect()}
    found = {}
    for r in queries.p3_found(spark, small).collect():
        found.setdefault((r["src"], r["row_id"]), set()).add(r["pii_text"])
    import re

    alone = lambda value, text: re.search(rf"(?<![^\W_]){re.escape(value)}(?![^\W_])", text)
    assert len(own) > 300 and not [k for k, v in own.items() if v in out[k]]
    assert not [(k, v) for k, vs in found.items() for v in vs if alone(v, out[k])]


def test_words_that_begin_sentences_are_no_given_names(spark):
    """A verb that stands before names only, and always as the first word, stays outside of them."""
    rows = [("text", i, f"{PROSE} At noon Dr. {f} came. Reach {f} at once.\nReach {g[0]}. {f} there", None, None) for i, (g, f) in enumerate((g, f) for g in GIVENS for f in FAMILIES)]
    rows += [("context", 100 + i, f"...{PROSE} Reach {f} today.", f"Reach {f} today.", "FREE_TEXT") for i, f in enumerate(FAMILIES)]
    frame = spark.createDataFrame(rows, SCHEMA + ", etype string")
    got = {r["value"] for r in personal_values(frame).where("kind = 'PERSON'").collect()}
    assert got == {f"{g[0]}. {f}" for g in GIVENS for f in FAMILIES}
    assert not any("[PERSON] today" in r["redacted"] or "Reach [PERSON] at" in r["redacted"] for r in redacted_texts(frame).collect())
