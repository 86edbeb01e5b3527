"""SimHash near-dedup with BK-trees.

Distinct fingerprints are dealt to shards: the 64 bits are cut into blocks, and of two fingerprints at
most RADIUS bits apart all but RADIUS blocks agree, so they meet in the shard of some choice of blocks.
The number of blocks grows with the number of fingerprints, which holds the shards' size. Every shard
is a BK-tree (children keyed by their integer distance to the parent), built and searched in one task
level by level; a search follows only the edges within the radius of the distance at hand.

A shard of more than HOT_SHARD fingerprints is not put into one task: its members are dealt again by more
blocks, so that more bits have to agree. What still crowds a shard lies in a small ball, and meets by the
points within half the radius of each: two fingerprints are near if and only if some point is within the
smaller half of the radius of one and the larger half of the other. That links the same fingerprints
exactly, for odd radii too, in steps that spread.

Trees aren't broadcast to the fingerprints, as the method's name has it: every tree would go to every task.
A shard's fingerprints and its tree meet in one task instead, and each is searched by its shard alone.

Linked fingerprints become classes by alternating star contraction, each round written to the shared
folder. Neither fingerprints nor links come to the driver.

Defined results. Null, empty and blank texts have fingerprint zero. Equal fingerprints are one class.
Repeated rows have equal results. Null ids count only where a class has no other: it then has no id.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import chunks, fresh, materialise, shipped, sized

RADIUS = 4
SHINGLE = 4
SEED = 42
HOT_SHARD = 20_000
#: Fingerprints that a fingerprint should meet in its shards, on average.
MEET = 256
#: Rows of whole shards that a task handles at once, and pairs of a search step.
FOREST_ROWS = 200_000
FRONTIER = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text: bit b is 1 if it is in over half of the shingles' hashes."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * np.add.reduce(bits, axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, keys: list[Column], text: str = "text") -> DataFrame:
    """The key columns and fp (the bits as a signed long), without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            kept = part.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(fp)], names=[*kept.schema.names, "fp"])

    df = docs.select(*keys, F.col(text).cast("binary").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    return df.transform(shipped).mapInArrow(run, f"{schema}, fp long")


# BK-trees ---------------------------------------------------------------------------------------


def _central_first(points: np.ndarray) -> np.ndarray:
    """The order of a shard's points by their distance to the bits that most of them have."""
    bits = np.unpackbits(points.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = np.packbits(2 * np.add.reduce(bits, axis=0, dtype=np.int64) > len(points), bitorder="little").view("<u8")[0]
    return np.argsort(np.bitwise_count(points ^ most), kind="stable")


class Forest:
    """BK-trees over runs of points, one tree a run, in arrays. A point's number is its node's number."""

    def __init__(self, points: np.ndarray, runs: np.ndarray):
        """points: distinct within a run; runs: the first point of each run, in order."""
        self.points = points
        sizes = np.diff(np.append(runs, len(points)))
        self.root = np.repeat(runs, sizes)
        self.size = np.repeat(sizes, sizes)
        parents, children = [], []
        node, rest = self.root, np.arange(len(points))
        rest = rest[rest != node]
        node = node[rest]
        while len(rest):
            far = np.bitwise_count(points[rest] ^ points[node]).astype(np.int64)
            key = node * 128 + far
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            head = np.append(True, key[1:] != key[:-1])
            child = rest[head]
            parents.append(key[head])
            children.append(child)
            node = child[np.cumsum(head) - 1]
            rest, node = rest[~head], node[~head]
        self.keys = np.concatenate(parents) if parents else np.empty(0, np.int64)
        self.children = np.concatenate(children) if children else np.empty(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.children = self.keys[order], self.children[order]

    def near(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query and another point of its tree at most `radius` apart, a level of the trees at a time."""
        node = self.root[query]
        while len(query):
            far = np.bitwise_count(self.points[query] ^ self.points[node]).astype(np.int64)
            hit = (far <= radius) & (query != node)
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.keys, node * 128 + np.maximum(far - radius, 0))
            n = np.searchsorted(self.keys, node * 128 + far + radius, side="right") - low
            query = np.repeat(query, n)
            node = self.children[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(query))]

    def classes(self, radius: int) -> np.ndarray:
        """The least number of each point's class by links at most `radius` long.

        A point that is already in the class of its tree's root needs no search: a link that leads out of
        that class is found from its other end."""
        label = np.arange(len(self.points))
        block = (np.cumsum(self.size) - self.size) // FRONTIER
        for query in np.split(label.copy(), np.flatnonzero(np.diff(block)) + 1) if len(label) else []:
            query = query[(self.size[query] > 1) & ((query == self.root[query]) | (label[query] != label[self.root[query]]))]
            for a, b in self.near(query, radius):
                link(label, a, b)
        return label


def link(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of linked numbers; labels are the classes' least numbers before and after."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b = a[apart], b[apart]
        high, low = np.maximum(la, lb)[apart], np.minimum(la, lb)[apart]
        np.minimum.at(label, high, low)
        while len(a):
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _forest_stars(radius: int):
    """Shards in order of their keys in, links to the first member of each class found within a shard out."""

    def stars(table: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        runs = np.flatnonzero(np.append(True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])))
        ends = np.append(runs[1:], len(fp))
        for a, b in zip(runs[ends - runs > 100].tolist(), ends[ends - runs > 100].tolist()):
            fp[a:b] = fp[a:b][_central_first(fp[a:b].view(np.uint64))]
        label = Forest(fp.view(np.uint64), runs).classes(radius)
        own = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[label[own]])], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("table", "key", "fp")))
            size += batch.num_rows
            if size >= FOREST_ROWS:
                table, key, fp = (np.concatenate(x) for x in zip(*held))
                whole = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1]))  # the last shard may go on
                if len(whole):
                    at = int(whole[-1]) + 1
                    yield stars(table[:at], key[:at], fp[:at])
                    table, key, fp = table[at:], key[at:], fp[at:]
                held, size = [(table, key, fp)], len(fp)
        if size:
            yield stars(*(np.concatenate(x) for x in zip(*held)))

    return run


#: Blocks beyond the radius at most; the choices of blocks grow fast with them.
MOST_BLOCKS = 5


def _blocks_for(n: int, radius: int) -> int:
    """Blocks to cut the bits into, so that a fingerprint meets about MEET others."""
    for blocks in range(radius + 1, radius + MOST_BLOCKS + 1):
        tables = len(list(combinations(range(blocks), radius)))
        if n * tables / 2.0 ** (64 * (blocks - radius) / blocks) <= MEET:
            break
    return blocks


def shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """An array of (table, key), one for each choice of the blocks that agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(F.shiftleft(fp, 64 - edges[i + 1]), 64 - edges[i + 1] + edges[i]) for i in range(blocks)]
    tables = []
    for t, kept in enumerate(combinations(range(blocks), blocks - radius)):
        key, width = F.lit(0).cast("long"), 0
        for i in kept:
            key = key.bitwiseOR(F.shiftleft(part[i], width))
            width += edges[i + 1] - edges[i]
        tables.append(F.struct(F.lit(t).alias("table"), key.alias("key")))
    return F.array(*tables)


def near_links(fps: DataFrame, radius: int = RADIUS, hot_shard: int = HOT_SHARD) -> DataFrame:
    """Links a, b whose classes are those of all pairs of the distinct column fp at most `radius` bits apart."""
    n = fps.count()
    blocks = _blocks_for(n, radius)
    links, members = _dealt_links(fps, n, blocks, radius, hot_shard)
    if members is None:
        return links
    if blocks < radius + MOST_BLOCKS:
        members = materialise(members, "hot-fingerprints")
        more, members = _dealt_links(members, members.count(), radius + MOST_BLOCKS, radius, hot_shard)
        links = links.unionByName(more)
    return links if members is None else links.unionByName(_midpoint_links(members, radius))


def _dealt_links(fps: DataFrame, n: int, blocks: int, radius: int, hot_shard: int) -> tuple[DataFrame, DataFrame | None]:
    """The links that BK-trees find in shards of up to `hot_shard` fingerprints, and the fingerprints of larger shards, if any."""
    keyed = fps.select("fp", F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("s")).select("s.table", "s.key", "fp")
    # At most (tables * n / hot_shard) shards are hot; each of the others fits a task.
    hot = materialise(keyed.groupBy("table", "key").count().where(F.col("count") > hot_shard).select("table", "key"), "hot-shards")
    some = not hot.isEmpty()
    side = sized(hot)
    cool = keyed.join(side, ["table", "key"], "left_anti") if some else keyed
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cool.repartition(max(parts, -(-n // FOREST_ROWS)), "table", "key").sortWithinPartitions("table", "key")
    links = dealt.transform(shipped).mapInArrow(_forest_stars(radius), "a long, b long")
    return links, keyed.join(side, ["table", "key"], "left_semi").select("fp").distinct() if some else None


def _midpoint_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links by shared points. All fingerprints within the larger half of the radius of a point are linked to the least one within
    the smaller half: each such link is near, and two near fingerprints have such a point between them."""
    inner, outer = radius // 2, radius - radius // 2
    flips = [(sum(1 << b for b in c), k <= inner) for k in range(outer + 1) for c in combinations(range(64), k)]
    signed = np.array([f for f, _ in flips], np.uint64).view(np.int64).tolist()
    table = fps.sparkSession.createDataFrame([(x, near) for x, (_, near) in zip(signed, flips)], "flip long, inner boolean")  # 2081 rows for a radius of 4
    around = fps.join(F.broadcast(table)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "inner")
    least = around.groupBy("point").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("b")).where("b is not null")
    return around.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


# Classes ----------------------------------------------------------------------------------------


def star_contraction(links: DataFrame, name: str = "stars") -> DataFrame:
    """node, root for every node in links a, b; roots are the least nodes of their classes, and not listed.

    Large and small stars alternate: each node hooks its larger, then its smaller neighbours to the
    least one, until nothing moves. Minima are pre-aggregated; joins on a frequent node are split."""
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), name)


def simhash_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row; classes are those of links at `radius` bits or fewer."""
    rows = materialise(with_fingerprints(docs, [F.col(doc_id).alias("doc_id")], text), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = star_contraction(near_links(fps.select("fp"), radius))
    member = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = member.join(ids, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the least id of each class, all columns kept.

    Rows that repeat an id are one document and one of them stays. Rows without an id go if their class
    has a document with one; if some class has none, the rows without an id stay."""
    found = materialise(simhash_classes(docs, doc_id, text), "simhash-classes")
    key = fresh(docs, "kept_id")
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(keep, docs[doc_id].eqNullSafe(keep[key]), "left_semi")
    once = found.agg((F.count("doc_id") == F.count_distinct("doc_id")).alias("once")).first()["once"]
    if once:
        return kept
    return kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).unionByName(kept.where(F.col(doc_id).isNull()))
