from pyspark.sql import functions as F

from maskwright.operators import resolve as r

D = "det_key bigint, matched_text string, entity_type string"


def test_ignored(spark):
    d = spark.createDataFrame([(1, "jOhN sMiTh", "PERSON"), (2, "x", "ORG"), (3, None, "ORG")], D)
    ignored = spark.createDataFrame([("John Smith", "PERSON"), ("John Smith", "ORG"), (None, "ORG")], "text string, entity_type string")
    assert sorted(x["det_key"] for x in r.drop_ignored(d, ignored).collect()) == [2, 3]
    assert r.drop_ignored(d, ignored.where("false")).count() == 3
    assert r.drop_ignored(d.where("false"), ignored).count() == 0


def test_resolve_prefers_the_stored(spark):
    d = spark.createDataFrame([(1, "a", "PERSON"), (2, "a", None), (3, None, "PERSON"), (4, "John Smith", "PERSON"), (4, "John Smith", "PERSON")], D)
    stored = spark.createDataFrame([("a", "cover")], "original string, stored string")
    got = sorted((x["det_key"], x["replacement"], x["accepted"]) for x in r.resolve(d, stored).collect())
    assert got == [(1, "cover", False), (2, "cover", False), (3, None, False), (4, "Montgomery Thornton", False), (4, "Montgomery Thornton", False)]


def test_resolve_with_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a", "PERSON", "mine")], D + ", stored string")
    row = r.resolve(d, spark.createDataFrame([("a", "cover")], "original string, stored string")).first()
    assert row["replacement"] == "cover" and row["stored"] == "mine"


def test_current(spark):
    rows = [("a", "old", "2025-01-01", "2025-02-01"), ("a", "new", "2024-01-01", "2025-03-01"), ("a", None, "2025-01-01", "2026-01-01"), ("b", "only", "2025-01-01", None)]
    m = spark.createDataFrame(rows, "original string, replacement string, created string, last_used string").withColumn("created", F.to_timestamp("created")).withColumn("last_used", F.to_timestamp("last_used"))
    assert sorted(map(tuple, r.current_mappings(m).collect())) == [("a", "new"), ("b", "only")]


def test_upsert(spark):
    old = spark.createDataFrame([("Alice Smith", "A", "PERSON"), ("kept", "K", "ORG")], "original string, replacement string, entity_type string").select("*", F.expr("TIMESTAMP '2024-01-01'").alias("created"), F.expr("TIMESTAMP '2024-01-02'").alias("last_used"))
    used = spark.createDataFrame([("Alice Smith", "B", "PERSON", 1), ("Alice Smith", "C", "USER", 2), ("new", "N", "ORG", 3), (None, "X", "ORG", 4)], "original string, replacement string, entity_type string, ord bigint")
    got = {x["original"]: (x["replacement"], x["entity_type"], str(x["created"])[:10], str(x["last_used"])[:10]) for x in r.upsert_mappings(old, used, F.expr("TIMESTAMP '2026-01-01'")).collect()}
    assert got == {"Alice Smith": ("C", "USER", "2024-01-01", "2026-01-01"), "kept": ("K", "ORG", "2024-01-01", "2024-01-02"), "new": ("N", "ORG", "2026-01-01", "2026-01-01")}
    assert r.upsert_mappings(old.where("false"), used.where("false")).count() == 0


def test_lists(spark):
    have = spark.createDataFrame([("John", "PERSON", None, None)], r.IGNORED)
    more = spark.createDataFrame([("JOHN", "PERSON", None, None), ("Ann", "PERSON", None, None), ("ANN", "ORG", None, None), (None, "ORG", None, None)], r.IGNORED)
    assert sorted(x["text"].lower() for x in r.add_ignored(have, more).collect()) == ["ann", "john"]
    assert r.remove_ignored(have, spark.createDataFrame([("jOHN",)], "text string")).count() == 0


def test_decisions(spark):
    d = spark.createDataFrame([(k, "t", "r") for k in range(4)], "det_key bigint, matched_text string, replacement string").withColumn("accepted", F.lit(False))
    said = spark.createDataFrame([(0, "accept", None), (1, "edit", "e"), (2, "reject", None)], "det_key bigint, action string, replacement string")
    got = sorted((x["det_key"], x["replacement"], x["accepted"]) for x in r.decide(d, said).collect())
    assert got == [(0, "r", True), (1, "e", True), (2, "r", False), (3, "r", None)]
    assert all(x["accepted"] for x in r.decide(d).collect())
