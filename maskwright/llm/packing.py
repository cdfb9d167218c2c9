"""Problem 7: documents packed whole into containers of fixed capacity.

Hierarchical multi-length packing: every document is routed to the smallest of several context windows that holds it (the
capacity, half of it, a quarter ...). Each tier is packed into windows of its own length, the longest tier first, and the
gaps of its windows are filled from the shorter tiers, the best fitting item first; of the shortest tier only what fits
exactly is taken for that. Windows are then set side by side into containers of the full capacity, and the items of the
shortest tier, kept for it, go into what gaps remain. Full
containers are dealt to step groups of equal token load. Shards are hash-partitioned by document and of the same expected
size at any size of the corpus, so the work of a task is bounded; each shard leaves at most a few badly filled containers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Measured at sf0.1: with three tiers as many containers as best-fit-decreasing without tiers, with four up to 0.2 % more.
TIERS = 3
#: Expected items of one shard and containers of one step group.
SHARD_ITEMS = 20_000
GROUP_SIZE = 8

OUT = "limit_id int, shard int, container int, window int, step_group int, tier int, doc_id bigint, piece int, pieces int, tokens int"


def byte_tokens(text: Column) -> Column:
    """Tokens of the public ByT5 tokenizer: one per UTF-8 byte and one end token."""
    return (F.octet_length(text) + 1).cast("bigint")


def window_lengths(capacity: int, tiers: int = TIERS) -> list[int]:
    """Context windows from the capacity down, each half of the one before; no window is empty."""
    return [max(1, capacity >> t) for t in range(tiers)]


def tier_of(sizes: np.ndarray, capacity: int, tiers: int = TIERS) -> np.ndarray:
    """Tier of each item: the shortest window that holds it."""
    edges = np.array(window_lengths(capacity, tiers)[1:], np.int64)
    return (sizes[:, None] <= edges[None, :]).sum(1)


class Shelf:
    """Things by size, in bit sets: the smallest of at least a size, or the largest of at most one, in one step."""

    def __init__(self, largest: int):
        self.held: list[list[int]] = [[] for _ in range(largest + 1)]
        self.sizes = 0  # bit s is set while something of size s is held

    def put(self, size: int, thing: int) -> None:
        self.sizes |= 1 << size
        self.held[size].append(thing)

    def take(self, size: int) -> int:
        thing = self.held[size].pop()
        if not self.held[size]:
            self.sizes ^= 1 << size
        return thing

    def at_least(self, n: int) -> int:
        """Smallest size held from ``n`` on, or 0."""
        fit = self.sizes >> n
        return n + (fit & -fit).bit_length() - 1 if fit else 0

    def at_most(self, n: int) -> int:
        """Largest size held up to ``n``, or 0."""
        return max(0, (self.sizes & ((1 << (n + 1)) - 1)).bit_length() - 1) if n > 0 else 0


def pack(sizes: np.ndarray, capacity: int, tiers: int = TIERS) -> tuple[np.ndarray, np.ndarray]:
    """(container, window) of each item, both numbered; items have from 1 to ``capacity`` tokens.

    A window is what was packed for one tier, a part of a container. Items that fill what is left of a container at the
    end are windows of their own. An item costs the same however many windows and containers are open.
    """
    lengths = window_lengths(capacity, tiers)
    tier = tier_of(sizes, capacity, tiers)
    window = np.full(len(sizes), -1, np.int64)
    loads: list[int] = []
    waiting = [Shelf(capacity) for _ in range(tiers)]
    for i in np.argsort(sizes, kind="stable").tolist():
        waiting[tier[i]].put(int(sizes[i]), i)

    def place(t: int, size: int, w: int) -> None:
        window[waiting[t].take(size)] = w
        loads[w] += size

    last = tiers - 1

    def fitting(t: int, room: int) -> int:
        size = waiting[t].at_most(room)
        return size if t < max(last, 1) or size == room else 0

    for t in range(last if tiers > 1 else tiers):
        length = lengths[t]
        while size := waiting[t].at_most(length):  # the longest left opens a window, then the gap is filled
            loads.append(0)
            place(t, size, len(loads) - 1)
            while room := length - loads[-1]:
                size, source = max((fitting(s, room), -s) for s in range(t, tiers))
                if not size:
                    break
                place(-source, size, len(loads) - 1)
    # windows side by side in containers, the fullest window first, each into the smallest room that holds it
    rooms = Shelf(capacity)
    used = 0
    container_of = np.empty(len(sizes), np.int64)  # of windows; there are no more of them than items
    order = np.argsort(-np.array(loads, np.int64), kind="stable").tolist()

    def stow(w: int, load: int) -> None:
        nonlocal used
        room = rooms.at_least(load)
        if room:
            container_of[w] = rooms.take(room)
        else:
            room, container_of[w] = capacity, used
            used += 1
        if room > load:
            rooms.put(room - load, int(container_of[w]))

    for w in order:
        stow(w, loads[w])
    while size := waiting[last].at_most(capacity):
        i = waiting[last].take(size)
        window[i] = len(loads)
        loads.append(size)
        stow(int(window[i]), size)
    return container_of[window], window


def step_groups(loads: np.ndarray, size: int = GROUP_SIZE) -> np.ndarray:
    """Group of each container: containers sorted by load are dealt back and forth, so groups weigh about the same."""
    n = len(loads)
    groups = max(1, -(-n // size))
    turn = np.arange(n)
    lap, at = turn // groups, turn % groups
    out = np.empty(n, np.int64)
    out[np.argsort(-loads, kind="stable")] = np.where(lap % 2 == 0, at, groups - 1 - at)
    return out


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["doc_id"], kind="stable")
    size = pdf["tokens"].to_numpy(np.int64)
    pieces = np.maximum(1, -(-size // capacity))
    row = np.repeat(np.arange(len(size)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    tokens = np.minimum(capacity, size[row] - piece * capacity)
    container, window = pack(tokens, capacity)
    group = step_groups(np.bincount(container, weights=tokens))
    return pd.DataFrame(
        {
            "limit_id": pdf["limit_id"].to_numpy()[row], "shard": pdf["shard"].to_numpy()[row], "container": container, "window": window, "step_group": group[container], "tier": tier_of(tokens, capacity),
            "doc_id": pdf["doc_id"].to_numpy()[row], "piece": piece, "pieces": pieces[row], "tokens": tokens,
        }
    )


def pack_documents(documents: DataFrame, limits: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per piece: (limit_id, shard, container, window, step_group, tier, doc_id, piece, pieces, tokens).

    ``pieces`` is 1 for every document within the capacity; only documents above it are cut, into full containers and
    a rest. Null texts have no tokens and aren't packed; an empty text has its end token. Limits without a positive
    capacity are left out. Repeated ids are separate items.
    """
    held = [(int(r[0]), int(r[1])) for r in limits.where("capacity > 0").select("limit_id", "capacity").distinct().collect()]
    texts = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), byte_tokens(F.col("text")).alias("tokens"))
    if not held:
        return documents.sparkSession.createDataFrame([], OUT)
    shards = max(1, -(-documents.count() // shard_items))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("limit_id"), F.lit(c).alias("capacity")) for i, c in sorted(held))))
    items = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(shards)).cast("int")).select("doc_id", "tokens", "shard", each.alias("l")).select("doc_id", "tokens", "shard", "l.limit_id", "l.capacity")
    return items.groupBy("limit_id", "shard").applyInPandas(_pack_shard, OUT)


def packing_totals(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, documents, pieces, tokens, overfull): what was packed for each limit, and containers above their capacity."""
    loads = packed.groupBy("limit_id", "shard", "container").agg(F.sum("tokens").alias("load"), F.count("*").alias("pieces"), F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("documents"))
    held = loads.join(limits.select("limit_id", "capacity"), "limit_id")
    return held.groupBy("limit_id").agg(F.sum("documents").alias("documents"), F.sum("pieces").alias("pieces"), F.sum("load").alias("tokens"), F.count_if(F.col("load") > F.col("capacity")).alias("overfull"))


def unused_room(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, containers, tokens, unused_share): how full the containers are."""
    used = packed.groupBy("limit_id", "shard").agg(F.max("container").alias("last"), F.sum("tokens").alias("tokens")).groupBy("limit_id").agg(F.sum(F.col("last") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    return used.join(limits.select("limit_id", "capacity"), "limit_id").select("limit_id", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))
