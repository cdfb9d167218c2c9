import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.llm.packing import pack, pack_documents, step_groups, tier_of, unused_room


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_containers_hold_what_they_get(sizes):
    sizes = np.array(sizes, np.int64)
    used, window = pack(sizes, 64)
    loads = np.bincount(used, weights=sizes) if len(sizes) else np.array([])
    assert (loads <= 64).all() and (loads > 0).all()
    assert len(loads) <= 1.3 * -(-sizes.sum() // 64) + 1  # best fit from the largest down
    for w in set(window.tolist()):  # a window lies in one container and is no longer than its tier's
        own = np.flatnonzero(window == w)
        assert len(set(used[own])) == 1 and sizes[own].sum() <= max(64 >> t for t in tier_of(sizes[own], 64))


def test_groups_are_balanced():
    loads = np.arange(1, 101)
    group = step_groups(loads, 10)
    assert sorted(np.bincount(group)) == [10] * 10 and np.ptp(np.bincount(group, weights=loads)) <= 10


def test_tiers():
    assert tier_of(np.array([100, 51, 50, 26, 25, 13, 12, 1]), 100, 4).tolist() == [0, 0, 1, 1, 2, 2, 3, 3]


def test_tiers_matter():
    rng = np.random.default_rng(3)
    differ = 0
    for _ in range(50):
        sizes = rng.integers(1, 60, 80)
        (one, _), (four, windows) = pack(sizes, 64, 1), pack(sizes, 64, 4)
        differ += one.tolist() != four.tolist()
        assert np.bincount(windows, weights=sizes).max() <= 64 and four.max() <= one.max() + 4
    assert differ > 40


def frames(spark, texts, limits=((1, 10), (2, 25))):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(list(limits), "limit_id int, capacity int")


def test_only_large_documents_are_cut(spark):
    texts = ["a" * 9, "a" * 10, "é" * 12, "", None, "b" * 60, "c", "c"]
    packed = pack_documents(*frames(spark, texts)).collect()
    cut = {(r["limit_id"], r["doc_id"]) for r in packed if r["pieces"] > 1}
    assert cut == {(1, 1), (1, 2), (1, 5), (2, 5)}
    for limit, capacity in ((1, 10), (2, 25)):
        for d, t in enumerate(texts):
            assert sum(r["tokens"] for r in packed if (r["limit_id"], r["doc_id"]) == (limit, d)) == (len(t.encode()) + 1 if t is not None else 0)
        loads = {}
        for r in packed:
            if r["limit_id"] == limit:
                loads[r["shard"], r["container"]] = loads.get((r["shard"], r["container"]), 0) + r["tokens"]
        assert max(loads.values()) <= capacity


def test_shards_and_unused_room(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    limits = spark.read.parquet(f"{small}/pack_limits.parquet")
    packed = pack_documents(docs, limits, shard_items=50)
    assert packed.select("shard").distinct().count() > 1
    assert packed.where("pieces = 1").groupBy("limit_id", "doc_id").count().where("count > 1").count() == 0
    whole = pack_documents(docs, limits)
    assert all(r["unused_share"] < 0.05 for r in unused_room(whole, limits).collect())


def test_empty(spark):
    docs, limits = frames(spark, [])
    assert pack_documents(docs, limits).count() == 0
    assert pack_documents(docs, limits.where("false")).count() == 0
    assert pack_documents(docs.withColumn("limit_id", F.lit(1)).withColumn("capacity", F.lit("x")), limits).count() == 0
