from pyspark.sql import functions as F

from maskwright.plans.pipeline import anonymise, anonymise_with_stores, detect, detection_rows
from maskwright.streaming.inbox import anonymise_stream, keep_mappings, read_inbox, read_mappings

SAMPLE = """To the records office of the harbour clinic.

Our patient Clara Whitcombe has moved. The old entry had the phone number
(415) 220-7781 and the mail address clara.w@harbourmail.example, both of which
are out of use. Her SSN is 219-45-8830, and the bill goes to
Account: 7710-2288-4093 as before.

The new home is 318 Juniper Crescent, where Owen Whitcombe and
Clara Whitcombe live since May. A colleague called CLARA WHITCOMBE there
today. The number 1-800-555-0199 is our own.
"""

#: Text, type and rule of each detection in order of place, read off the letter by hand.
GOLDEN = [
    ("Clara Whitcombe", "PERSON", "NER (dictionary)"),
    ("415) 220-7781", "PHONE", "Phone (US)"),
    ("clara.w@harbourmail.example", "EMAIL", "Email"),
    ("219-45-8830", "SSN", "SSN"),
    ("Account: 7710-2288-4093", "ACCOUNT_NUMBER", "Account Number"),
    ("318 Juniper Crescent", "ADDRESS", "NER (dictionary)"),
    ("Owen Whitcombe", "PERSON", "NER (dictionary)"),
    ("Clara Whitcombe", "PERSON", "Global match"),
    ("CLARA WHITCOMBE", "PERSON", "NER (dictionary)"),
]


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_sample(spark):
    rows = detection_rows(detect(documents(spark, SAMPLE)), ["doc_id"]).orderBy("start").collect()
    assert [(r["matched_text"], r["entity_type"], r["rule_name"]) for r in rows] == GOLDEN
    assert all(SAMPLE[r["start"] : r["end"]] == r["matched_text"] for r in rows)


def test_sample_output(spark):
    out = anonymise(documents(spark, SAMPLE)).first()["output_text"]
    assert "hitcombe" not in out and "219-45-8830" not in out and "harbourmail" not in out and "7710" not in out
    assert out.startswith("To the records office of the harbour clinic.\n\nOur patient ") and "((555) 555-" in out and "1-800-555-0199 is our own.\n" in out
    first, last = out.split("Our patient ")[1].split(" has moved")[0], out.split("and\n")[-1].split(" live since")[0]
    assert first == last  # one person, one cover


def test_nulls_empty_and_clean_texts(spark):
    got = anonymise(documents(spark, None, "", "nothing to see")).orderBy("doc_id").collect()
    assert [(r["detections"], r["output_text"]) for r in got] == [([], None), ([], ""), ([], "nothing to see")]


def test_empty_table_and_clashing_columns(spark):
    df = documents(spark, "a@b.example").withColumn("start", F.lit(1)).withColumn("detections_old", F.lit(2)).withColumn("replacement", F.lit("r"))
    assert anonymise(df).first()["output_text"].endswith("@example.com")
    assert anonymise(df.where("false")).count() == 0


def test_stores(spark):
    docs = documents(spark, "mail a@b.example and c@d.example", "by John Smith", None, "clean")
    stored = spark.createDataFrame([("a@b.example", "hidden@x.example")], "original string, stored string")
    ignored = spark.createDataFrame([("JOHN SMITH",), (None,)], "text string")
    got = {r["doc_id"]: (r["output_text"], r["accepted"]) for r in anonymise_with_stores(docs, "doc_id", stored, ignored).collect()}
    assert got[0][0].startswith("mail hidden@x.example and ") and got[0][1] == 2
    assert got[1] == ("by John Smith", 0) and got[2] == (None, 0) and got[3] == ("clean", 0)


def test_own_detector(spark):
    from maskwright.operators.rules import DETECTIONS

    found = lambda text: F.expr(f"CAST(array(struct(0, 3, substring(text, 1, 3), 'X', 'own', 900)) AS {DETECTIONS})")
    rows = detection_rows(detect(documents(spark, "abcdef"), detectors=[found]), ["doc_id"]).collect()
    assert [(r["matched_text"], r["rule_name"]) for r in rows] == [("abc", "own")]


def test_stream(spark, tmp_path):
    documents(spark, SAMPLE, "mail a@b.example").write.parquet(str(tmp_path / "in"))
    stream = anonymise_stream(read_inbox(spark, str(tmp_path / "in"), "doc_id bigint, text string"))
    q = stream.select("doc_id", "output_text").writeStream.format("memory").queryName("covered").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.table("covered").collect()) == [0, 1]


def test_stream_of_mappings(spark, tmp_path):
    schema = "original string, replacement string, entity_type string, ord bigint"
    spark.createDataFrame([("a", "x", "T", 1), ("a", "y", "T", 2), ("b", "z", "T", 3)], schema).write.parquet(str(tmp_path / "in"))
    q = keep_mappings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["original"], r["replacement"]) for r in read_mappings(spark, str(tmp_path / "store")).collect()) == [("a", "y"), ("b", "z")]


def test_stream_writes_touched_parts_only(spark, tmp_path):
    schema = "original string, replacement string, entity_type string, ord bigint"
    rows = [[(f"k{i}", "one", "T", i) for i in range(300)], [("k7", "two", "T", 1), ("new", "x", "T", 2)], [("k7", "three", "T", 1)]]
    for n, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = keep_mappings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    held = {r["original"]: r["replacement"] for r in read_mappings(spark, str(tmp_path / "store")).collect()}
    assert len(held) == 301 and held["k7"] == "three" and held["new"] == "x" and held["k8"] == "one"
    versions = [p.name for p in (tmp_path / "store").glob("bucket=*/v=*")]
    assert versions.count("v=2") <= 2 and versions.count("v=3") == 1


def test_many_spans_in_one_text(spark):
    """Spans over several groups, with characters of two to four bytes between them."""
    text = " ".join(f"é{'😀' if i % 3 else 'x'} a{i}@x.example," for i in range(300))
    d = documents(spark, text)
    rows = detection_rows(detect(d, detectors=[]), ["doc_id"]).collect()
    raw = text.encode()
    assert len(rows) == 300 and all(raw[r["start_byte"] : r["end_byte"]].decode() == r["matched_text"] == text[r["start"] : r["end"]] for r in rows)
    out = anonymise(d, detectors=[]).first()["output_text"]
    assert out.count("@example.com,") == 300 and [w for w in out.split() if "@" not in w] == [w for w in text.split() if "@" not in w]
