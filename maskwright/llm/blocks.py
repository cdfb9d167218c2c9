"""Shared by the operators on pairs and on hits: blocks of any size compared in even portions, and hashes of words."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of one portion of a block. A block of n members becomes about (n / PORTION)^2 / 2 portions of pairs.
PORTION = 256


def block_pairs(keyed: DataFrame, member: str, a: str, b: str, portion: int = PORTION, common: int | None = None) -> DataFrame:
    """(a, b), a < b: the distinct pairs of members of ``keyed(member, key)`` that share a key.

    Keys of one member drop out before any row is joined. A block above ``portion`` members is dealt into portions and
    each pair of portions is compared by itself, so a key that holds a third of all rows spreads over many tasks and no
    pair is lost. (The join with the sizes has one row a key on its small side; the engine splits it where a key is hot.)
    The pairs of a block number n^2 / 2 all the same: keys have to be made so that only near members meet.

    With ``common``, keys that are marked ``spare`` are discarded above so many members; other keys must cover them.
    """
    spare = F.col("spare") if "spare" in keyed.columns else F.lit(False)
    rows = keyed.select(member, "key", spare.alias("spare"))  # repeated rows cost work and change nothing
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.bool_and("spare").alias("spare")).where("n > 1")
    if common is not None:
        sizes = sizes.where(~F.col("spare") | (F.col("n") <= common))
    rows = rows.select(member, "key").join(sizes.select("key", "n"), "key").withColumn("parts", F.ceil(F.col("n") / portion).cast("int"))
    mine = F.pmod(F.xxhash64(F.lit(7), member), F.col("parts")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", member, "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    x, y = rows.withColumnRenamed(member, a).withColumnRenamed("mine", "at"), rows.withColumnRenamed(member, b).withColumnRenamed("mine", "bt")
    once = (F.col("lo") == F.col("hi")) | (F.col("at") != F.col("bt"))
    return x.join(y, ["key", "lo", "hi"]).where(once & (F.col(a) < F.col(b))).select(a, b).distinct()


def text_hash(text: str) -> int:
    """The engine's ``xxhash64`` of one string, unsigned."""
    return xxhash.xxh64_intdigest(text.encode(), 42)

