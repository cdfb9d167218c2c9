"""Problem 9: repetition.

``line_frequency`` is the method named: normalised lines are hashed, their documents counted per host, lines above the
limit removed and depleted documents rejected. It sees what many documents share; what one document says twice it
can't see, so the share of repeated content inside a document is measured by runs of words over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.runtime import written

RUN = 8
WORD = re.compile(r"[^\W\d_]+")


def repeated_words(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(repeated words, words) of each text; a word is repeated if it lies in a run that also stands further up."""
    found = [WORD.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    total = int(sizes.sum())
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen) + 1) for words in found for w in words), np.uint64, total)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    starts = np.flatnonzero(doc[: total - run + 1] == doc[run - 1 :]) if total >= run else np.empty(0, np.int64)
    if not len(starts):
        return np.zeros(len(texts), np.int64), sizes
    h = doc[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        for k in range(run):
            h = (h ^ ids[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    later = np.flatnonzero(h[order][1:] == h[order][:-1])
    a, b = starts[order[later]], starts[order[later + 1]]
    real = np.ones(len(a), bool)
    for k in range(run):
        real &= ids[a + k] == ids[b + k]
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, b[real], 1)
    np.add.at(marks, b[real] + run, -1)
    covered = np.cumsum(marks)[:total] > 0
    return np.bincount(doc[covered], minlength=len(texts)).astype(np.int64), sizes


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        again, words = repeated_words(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(again), pa.array(words)], ["doc_id", "repeated_words", "words"])


def repetition_share(documents: DataFrame) -> DataFrame:
    """(doc_id, repeated_words, words, share) of each document with text; a text without words has the share 0.

    Null texts give no row. No shuffle: each text is measured where it is read.
    """
    texts = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    measured = texts.mapInArrow(_share, "doc_id bigint, repeated_words bigint, words bigint")
    return measured.withColumn("share", F.col("repeated_words") / F.greatest(F.col("words"), F.lit(1)))


def line_frequency(documents: DataFrame, host: str = "source", max_documents: int = 3, min_kept: float = 0.5, salts: int = 8) -> DataFrame:
    """(doc_id, kept_chars, all_chars, kept_share, rejected): documents after lines common on their host are removed.

    A line is common if more than ``max_documents`` different texts of its host have it; letter case, digits and white
    space don't count. A document is rejected if less than ``min_kept`` of its characters are left. A null host is a
    host of its own; documents without text or with blank lines only are kept. Whole copies of a text count once.
    Counting is by 64-bit hashes with map-side combination; counts and the join with the common lines are spread over
    salts, so a line that a third of all documents have is no task of its own. Blank lines take part in neither.
    """
    texts = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), "text")
    lines = texts.select("doc_id", "host", F.xxhash64("text").alias("text_key"), F.explode(F.split("text", r"\r\n|\n|\r")).alias("line"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("line"), r"[0-9]+", "0"), r"(?U)\s+", " "))
    # read and normalised once; what is kept are three numbers a line
    keyed = written(lines.select("doc_id", "text_key", F.length("line").alias("chars"), F.when(plain != "", F.xxhash64("host", plain)).alias("line_key")))
    salt = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(salts)).cast("int").alias("salt")
    held = keyed.where("line_key IS NOT NULL").groupBy("doc_id", "text_key", "line_key").agg(F.sum("chars").alias("chars"))
    part = held.select("line_key", "text_key").distinct().groupBy("line_key", F.pmod("text_key", F.lit(salts)).alias("salt")).agg(F.count("*").alias("n"))
    common = part.groupBy("line_key").agg(F.sum("n").alias("n")).where(F.col("n") > max_documents).select("line_key")
    # every copy of a common line is one key: the few common lines go once to each salt
    removed = held.select("doc_id", "line_key", "chars", salt).join(common.select("line_key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")), ["line_key", "salt"], "left_semi")
    every = keyed.select("doc_id", "chars", F.lit(0).cast("bigint").alias("gone")).unionByName(removed.select("doc_id", F.lit(0).alias("chars"), F.col("chars").alias("gone")))
    return (
        every.groupBy("doc_id")
        .agg((F.sum("chars") - F.sum("gone")).cast("bigint").alias("kept_chars"), F.sum("chars").cast("bigint").alias("all_chars"))
        .withColumn("kept_share", F.when(F.col("all_chars") > 0, F.col("kept_chars") / F.col("all_chars")).otherwise(F.lit(1.0)))
        .withColumn("rejected", F.col("kept_share") < min_kept)
    )
