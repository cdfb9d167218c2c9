import random
import re

from maskwright.llm.repetition import RUN, line_frequency, repeated_words, repetition_share


def brute(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    seen, covered = set(), set()
    for i in range(len(words) - RUN + 1):
        run = tuple(words[i : i + RUN])
        if run in seen:
            covered.update(range(i, i + RUN))
        seen.add(run)
    return len(covered), len(words)


def test_against_brute_force():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 120))) for _ in range(80)] + ["", "a " * 500, "one two three four five six seven eight", "x1y " * 20]
    again, words = repeated_words(texts)
    assert list(zip(again.tolist(), words.tolist())) == [brute(t) for t in texts]
    assert [len(x) for x in repeated_words([])] == [0, 0]


def test_share(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h " * 2), (2, None), (3, ""), (4, "1 2 3")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["share"] for r in repetition_share(df).collect()} == {1: 0.5, 3: 0.0, 4: 0.0}


def test_lines(spark):
    rows = [(i, "h", f"Page {i} of 9\nown text {'abcdefgh'[i]} long enough to stay") for i in range(6)] + [(10, "h", "PAGE  7 of 9"), (11, None, "Page 1 of 9"), (12, "h", None), (13, "h", ""), (14, "h", "\n \n")]
    rows += [(20 + i, "copies", "one text many times") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {r["doc_id"]: (r["kept_chars"], r["rejected"]) for r in line_frequency(df).collect()}
    assert got[0] == (len("own text a long enough to stay"), False) and got[10] == (0, True)
    assert got[11] == (11, False) and 12 not in got and got[13] == (0, False) and got[14] == (1, False)
    assert not any(got[20 + i][1] for i in range(9))  # whole copies count once
    assert line_frequency(df.where("false")).count() == 0


def test_hot_lines_and_planted_rejections(spark):
    """A line that a third of all documents have, a menu that fills whole documents, and blank lines everywhere."""
    menu = "\n".join(f"menu entry {c} of the house" for c in "abcdef")
    rows = [(i, f"host{i % 2}", f"The Hot Line  {i}\n\nown words {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} of this one text" if i % 3 == 0 else f"\n\nnothing {'abcdefghij'[i % 10]} shared {'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]} here") for i in range(300)]
    rows += [(1000 + i, "host0", f"{menu}\nshort {'abcdefgh'[i]}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {r["doc_id"]: r for r in line_frequency(df).collect()}
    assert {d for d, r in got.items() if r["rejected"]} == {1000 + i for i in range(8)}
    assert all(got[i]["all_chars"] - got[i]["kept_chars"] == len(f"The Hot Line  {i}") for i in range(0, 300, 3))
    assert all(got[i]["all_chars"] == got[i]["kept_chars"] for i in range(300) if i % 3)
    assert {r["doc_id"]: r["rejected"] for r in line_frequency(df, salts=1).collect()} == {d: r["rejected"] for d, r in got.items()}
