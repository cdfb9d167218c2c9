"""Ignore lists, cover values for detections, and the tables of mappings and ignored entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.covers import cover_value

MAPPING = "original string, replacement string, entity_type string, created timestamp, last_used timestamp"
IGNORED = "text string, entity_type string, created timestamp, reason string"


def drop_ignored(detections: DataFrame, ignored: DataFrame) -> DataFrame:
    """Detections whose text isn't on the list, in any letter case and whatever the type.

    The list is reduced to distinct texts; the engine broadcasts it if its measured size allows. Null texts are kept.
    """
    listed = ignored.where("text IS NOT NULL").select(F.lower("text").alias("_ignored")).distinct()
    return detections.join(listed, F.lower(detections["matched_text"]) == listed["_ignored"], "left_anti")


def current_mappings(mappings: DataFrame) -> DataFrame:
    """One mapping per original out of merged stores: the one used, else created, last; at a tie the greatest replacement."""
    rank = F.struct(F.coalesce("last_used", "created"), "created", "replacement")
    return mappings.where("original IS NOT NULL AND replacement IS NOT NULL").groupBy("original").agg(F.max_by("replacement", rank).alias("stored"))


def resolve(detections: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """Detections with ``replacement``: the stored one by exact text, else the generated one; ``accepted`` is false.

    ``mappings(original, stored)`` holds one row per original. Covers are made once per distinct text and type that has no
    mapping and joined back, so a text in a third of all rows costs one hash.
    """
    texts = detections.select("matched_text", "entity_type").distinct()
    if mappings is not None:
        texts = texts.join(mappings.withColumnRenamed("original", "matched_text"), "matched_text", "left")
    else:
        texts = texts.withColumn("stored", F.lit(None).cast("string"))
    made = texts.select("matched_text", "entity_type", F.coalesce("stored", cover_value(F.col("matched_text"), F.col("entity_type"))).alias("replacement"))
    d, m = detections.alias("d"), made.alias("m")
    same = (F.col("d.matched_text") == F.col("m.matched_text")) & F.col("d.entity_type").eqNullSafe(F.col("m.entity_type"))
    return d.join(m, same, "left").select("d.*", "m.replacement").withColumn("accepted", F.lit(False))


def resolve_inline(detections: Column) -> Column:
    """Generated covers inside the array, all accepted; no shuffle."""
    return F.transform(detections, lambda d: F.struct(d["start"], d["end"], d["matched_text"], d["entity_type"], cover_value(d["matched_text"], d["entity_type"]).alias("replacement"), F.lit(True).alias("accepted")))


def upsert_mappings(stored: DataFrame, used: DataFrame, now: Column | None = None) -> DataFrame:
    """The mapping table after a batch ``used(original, replacement, entity_type, ord)``.

    Per original the last of the batch by ``ord`` gives replacement, type and last use; ``created`` stays where the
    original was known. ``stored`` holds one row per original.
    """
    now = F.current_timestamp() if now is None else now
    last = used.where("original IS NOT NULL").groupBy("original").agg(F.max_by(F.struct("replacement", "entity_type"), "ord").alias("new"))
    both = stored.alias("s").join(last.alias("u"), "original", "full_outer")
    fresh = F.col("u.new").isNotNull()
    return both.select(
        "original",
        F.when(fresh, F.col("u.new.replacement")).otherwise(F.col("s.replacement")).alias("replacement"),
        F.when(fresh, F.col("u.new.entity_type")).otherwise(F.col("s.entity_type")).alias("entity_type"),
        F.coalesce(F.col("s.created"), now).alias("created"),
        F.when(fresh, now).otherwise(F.col("s.last_used")).alias("last_used"),
    )


def remove_mappings(stored: DataFrame, originals: DataFrame) -> DataFrame:
    return stored.join(originals.select("original"), "original", "left_anti")


def add_ignored(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """The list with new entries; a text known in any letter case is left as it is, of several new ones one is taken."""
    key = F.lower("text")
    one = entries.where("text IS NOT NULL").groupBy(key.alias("_key")).agg(F.min(F.struct("created", "text", "entity_type", "reason")).alias("e"))
    known = stored.select(key.alias("_key"))
    new = one.join(known, "_key", "left_anti").select("e.text", "e.entity_type", "e.created", "e.reason")
    return stored.select("text", "entity_type", "created", "reason").unionByName(new)


def remove_ignored(stored: DataFrame, texts: DataFrame) -> DataFrame:
    return stored.join(texts.select(F.lower("text").alias("_key")), F.lower(stored["text"]) == F.col("_key"), "left_anti")


def decide(resolved: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Review: ``decisions(det_key, action, replacement)`` on resolved rows that have ``det_key``.

    Actions: accept, edit (its replacement is taken), reject. Rows without a decision stay open (null); without a table
    of decisions all are accepted.
    """
    if decisions is None:
        return resolved.withColumn("accepted", F.lit(True))
    d = decisions.select("det_key", "action", F.col("replacement").alias("edited"))
    joined = resolved.drop("accepted").join(d, "det_key", "left")
    return (
        joined.withColumn("replacement", F.when((F.col("action") == "edit") & F.col("edited").isNotNull(), F.col("edited")).otherwise(F.col("replacement")))
        .withColumn("accepted", F.when(F.col("action").isin("accept", "edit"), True).when(F.col("action") == "reject", False))
        .drop("action", "edited")
    )
