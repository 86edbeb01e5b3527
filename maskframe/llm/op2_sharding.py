"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts).

Groups larger than a fixed share of the total are items of their own, so their number is bounded; all
smaller ones are bundled by hash into a fixed number of items. The packing itself thus sees a bounded
list, whatever the size of the input. An item above the even share has a shard of its own. For the
others and the remaining shards the least capacity that best fit needs is searched, and what coarse
items leave uneven is levelled, which makes these shards' sizes near equal.

Defined results. A null or empty text has one byte and all such texts are one group each (null apart
from empty). Repeated rows are members of their group and get slots of their own. A group above
the even share of its own and all smaller items' bytes over the shards that are left gets a shard
that nothing else enters. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialise

#: Groups with more than total / (shards * FINE) bytes are items themselves; BUNDLES take the rest.
FINE = 256
BUNDLES = 16384
#: Parts of a shard that number their rows apart.
SLOT_PARTS = 1024


class RoomTree:
    """Bins by (room, number) in a balanced binary tree (AA levels): insert, and take the least room that fits."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # nodes are [key, level, left, right]

    def insert(self, key: tuple[int, int]) -> None:
        self.root = self._insert(self.root, key)

    def _insert(self, node, key):
        if node is None:
            return [key, 1, None, None]
        side = 2 if key < node[0] else 3
        node[side] = self._insert(node[side], key)
        return _split(_skew(node))

    def ceiling(self, size: int) -> tuple[int, int] | None:
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, node, key):
        if node is None:
            return None
        if key != node[0]:
            side = 2 if key < node[0] else 3
            node[side] = self._remove(node[side], key)
        elif node[2] is None:
            return node[3]
        else:
            low = node[2]
            while low[3] is not None:
                low = low[3]
            node[0] = low[0]
            node[2] = self._remove(node[2], low[0])
        want = 1 + min(node[2][1] if node[2] else 0, node[3][1] if node[3] else 0)
        if want < node[1]:
            node[1] = want
            if node[3] and node[3][1] > want:
                node[3][1] = want
        node = _skew(node)
        if node[3]:
            node[3] = _skew(node[3])
            if node[3][3]:
                node[3][3] = _skew(node[3][3])
        node = _split(node)
        if node[3]:
            node[3] = _split(node[3])
        return node


def _skew(node):
    left = node[2]
    if left is not None and left[1] == node[1]:
        node[2], left[3] = left[3], node
        return left
    return node


def _split(node):
    right = node[3]
    if right is not None and right[3] is not None and right[3][1] == node[1]:
        node[3], right[2] = right[2], node
        right[1] += 1
        return right
    return node


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item. An item beyond the capacity gets a bin of its own."""
    tree, out, bins = RoomTree(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.ceiling(sizes[i])
        if found is None:
            out[i] = bins
            room, bins = capacity - sizes[i], bins + 1
        else:
            tree.remove(found)
            out[i], room = found[1], found[0] - sizes[i]
        if room > 0:
            tree.insert((room, out[i]))
    return out


def least_capacity(sizes: list[int], bins: int) -> list[int]:
    """Bins 0 to bins-1 by best-fit-decreasing at the least capacity for which that many suffice."""
    low, high = max(max(sizes), -(-sum(sizes) // bins)), max(sizes) + -(-sum(sizes) // bins)
    best = best_fit_decreasing(sizes, high)
    while low < high:
        mid = (low + high) // 2
        found = best_fit_decreasing(sizes, mid)
        if max(found) < bins:
            best, high = found, mid
        else:
            low = mid + 1
    return best


def level(sizes: list[int], where: list[int], bins: int) -> list[int]:
    """The same bins after moves of single items into the emptiest one, as long as a move leaves both bins below the giver's fill.

    Best fit fills bins to the capacity, so where items are coarse it can leave the last bins empty."""
    fills, held = [0] * bins, [[] for _ in range(bins)]
    for i, b in enumerate(where):
        fills[b] += sizes[i]
        held[b].append((sizes[i], i))
    for items in held:
        items.sort()

    def move() -> bool:
        low = min(range(bins), key=fills.__getitem__)
        for b in sorted(range(bins), key=lambda b: -fills[b]):
            gap = fills[b] - fills[low]
            at = bisect_right(held[b], (gap // 2, len(sizes)))  # before it, the largest item up to half the gap; else the next one
            for k in (at - 1, at):
                if 0 <= k < len(held[b]) and 0 < held[b][k][0] < gap:
                    item = held[b].pop(k)
                    insort(held[low], item)
                    fills[b] -= item[0]
                    fills[low] += item[0]
                    return True
        return False

    while move():
        pass
    out = list(where)
    for b, items in enumerate(held):
        for _, i in items:
            out[i] = b
    return out


def pack_into(sizes: list[int], bins: int) -> list[int]:
    """Bins 0 to bins-1. An item above the even share of what is left has a bin of its own; the others are packed into the remaining bins."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left, alone = sum(sizes), 0
    while alone < len(order) and sizes[order[alone]] * (bins - alone) > left:
        left -= sizes[order[alone]]
        alone += 1
    out = [0] * len(sizes)
    for b, i in enumerate(order[:alone]):
        out[i] = b
    if rest := order[alone:]:
        some = [sizes[i] for i in rest]
        for i, b in zip(rest, level(some, least_capacity(some, bins - alone), bins - alone)):
            out[i] = alone + b
    return out


def shards(docs: DataFrame, n_shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    spark = docs.sparkSession
    raw = F.col(text).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.col(text), F.col(text).isNull()).alias("group"),  # two groups that collide stay together, which harms nothing
        F.monotonically_increasing_id().alias("row"),  # written, so it stays; null or repeated ids don't crowd a part
    )
    rows = materialise(rows, "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    least = max(1, total // (n_shards * FINE))
    # At most n_shards * FINE groups pass `least`, so the list on the driver has that many rows and BUNDLES more.
    own = F.col("size") > least
    items = groups.groupBy(F.when(own, F.col("group")).alias("group"), F.when(~own, F.pmod("group", F.lit(BUNDLES))).alias("bundle")).agg(F.sum("size").alias("size")).collect()
    items.sort(key=lambda r: (-r["size"], r["bundle"] is None, r["bundle"] or 0, r["group"] or 0))
    where = pack_into([r["size"] for r in items], n_shards)
    large = spark.createDataFrame([(r["group"], s) for r, s in zip(items, where) if r["group"] is not None], "`group` long, own_shard int")
    small = spark.createDataFrame([(r["bundle"], s) for r, s in zip(items, where) if r["bundle"] is not None], "bundle long, bundle_shard int")
    placed = (
        rows.withColumns({"bundle": F.pmod("group", F.lit(BUNDLES)), "part": F.pmod(F.xxhash64("row"), F.lit(SLOT_PARTS))})
        .join(F.broadcast(large), "group", "left")
        .join(F.broadcast(small), "bundle", "left")
        .withColumn("shard", F.coalesce("own_shard", "bundle_shard"))
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))  # n_shards * SLOT_PARTS rows
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "row"))
    return (
        placed.select("doc_id", "size", "text_crc32", "shard", "part", within.alias("within"))
        .join(F.broadcast(before), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
