"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents: a shard holds about SHARD_BYTES of text and has, for each of its terms,
the sorted positions where it stands. Posting lists thus never cross the network and a frequent term's
list is as long as a shard at most. A phrase is looked up in every shard by taking the list of its
rarest term there, moved back by the term's place in the phrase, and intersecting it with the moved
lists of the other terms, rarest first.

Items reach the driver in blocks of at most BLOCK_WORDS words, each block broadcast by itself and released
before the next one.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case.
Terms are kept as 64-bit keys of their bytes: two words of one key, of which a billion distinct words have
about 0.03 pairs, would be taken for each other.

Defined results. A null or empty text has no words and is clean. Items without words match nothing;
items without an id are left out; items of one id count as one. Repeated documents are judged alike.
Empty tables give empty results, or clean documents.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import chunks, fresh, materialise, mix64, shipped, sized

WINDOW = 13
SHARD_BYTES = 1 << 21
BLOCK_WORDS = 1 << 19

INDEX = "shard string, docs array<struct<doc_id:long,first:int,n_words:int>>, terms binary, ends binary, positions binary"
HITS = "shard string, row int, doc_id long, n_words long, spans array<struct<start:int,stop:int>>, items array<string>"

# Word bytes, A-Z in lower case; 0 for all others.
_WORD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_STEP = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the step and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SHARD_BYTES + (1 << 16))
        inverse = pow(_STEP, -1, 1 << 64)
        for name, base in (("up", _STEP), ("down", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[name] = p
    return _powers["up"][:n], _powers["down"][:n]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key of every word of the texts in order, and each text's number of words."""
    data = _WORD[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    solid = data != 0
    turn = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    start, stop = turn[::2], turn[1::2]
    up, down = _power(len(data))
    run = np.empty(len(data) + 1, np.uint64)
    run[0] = 0
    np.cumsum(_VALUE[data] * up, out=run[1:])
    keys = mix64((run[stop] - run[start]) * down[start])
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return keys, np.diff(np.searchsorted(start, edges))


def _index_row(ids: list, texts: list[bytes]) -> dict:
    keys, counts = words(texts)
    first = np.concatenate([[0], np.cumsum(counts + 1)])[: len(texts)]  # a place is left free after each text
    place = np.arange(len(keys)) + np.repeat(np.arange(len(texts)), counts)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    last = np.flatnonzero(np.append(sorted_keys[1:] != sorted_keys[:-1], True)) if len(keys) else np.empty(0, np.int64)
    return {
        "shard": uuid.uuid4().hex,
        "docs": [{"doc_id": d, "first": int(f), "n_words": int(n)} for d, f, n in zip(ids, first, counts)],
        "terms": sorted_keys[last].tobytes(),
        "ends": (last + 1).astype("<u4").tobytes(),
        "positions": place[order].astype("<u4").tobytes(),
    }


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index table, one row a shard: its documents, sorted terms, the end of each term's list, and the positions."""
    doc = pa.struct([("doc_id", pa.int64()), ("first", pa.int32()), ("n_words", pa.int32())])
    schema = pa.schema([("shard", pa.string()), ("docs", pa.list_(doc)), ("terms", pa.binary()), ("ends", pa.binary()), ("positions", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text", shard_bytes):
            yield pa.RecordBatch.from_pylist([_index_row(part.column("doc_id").to_pylist(), texts)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).transform(shipped).mapInArrow(run, INDEX)


class Shard:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
        self.positions = np.frombuffer(row["positions"], "<u4").astype(np.int64)
        self.name, self.docs = row["shard"], row["docs"]
        self.first = np.array([d["first"] for d in self.docs], np.int64)

    def lists(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the list of each key begins and ends."""
        if not len(self.terms):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.terms, keys), len(self.terms) - 1)
        stop = self.ends[at]
        start = np.where(at > 0, self.ends[at - 1], 0)
        return np.where(self.terms[at] == keys, start, stop), stop

    def phrase(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Places where words with these posting lists stand one after the other."""
        order = np.argsort(stop - start, kind="stable").tolist()
        rarest = order[0]
        found = self.positions[start[rarest] : stop[rarest]] - rarest
        for k in order[1:]:
            if not len(found):
                break
            other = self.positions[start[k] : stop[k]] - k
            at = np.minimum(np.searchsorted(other, found), len(other) - 1)
            found = found[other[at] == found]
        return found

    def near(self, start: np.ndarray, stop: np.ndarray, within: int) -> list[tuple[int, int]]:
        """Least stretches (first, last place) of at most `within` words that have all the terms, in one document."""
        rarest = int(np.argmin(stop - start))
        anchor = self.positions[start[rarest] : stop[rarest]]
        if not len(anchor):
            return []
        marks = []
        for k in range(len(start)):
            p = self.positions[start[k] : stop[k]]
            at = np.searchsorted(anchor, p)
            gap = np.minimum(np.abs(p - anchor[np.minimum(at, len(anchor) - 1)]), np.abs(p - anchor[np.maximum(at - 1, 0)]))
            marks += [(int(x), k) for x in p[gap < within]]
        found, latest = [], {}
        for place, k in sorted(marks):
            latest[k] = place
            low = min(latest.values())
            if len(latest) == len(start) and place - low < within and self.doc(low) == self.doc(place):
                found.append((low, place))
        return found

    def doc(self, place: int) -> int:
        return int(np.searchsorted(self.first, place, side="right")) - 1


@dataclass
class Phrases:
    """Distinct phrases of a block of items: rows of term numbers (-1 beyond a phrase's end) and the items of each."""

    keys: np.ndarray
    rows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], window: int) -> "Phrases":
        keys, counts = words([t for _, t in items])
        owners: dict[tuple, set[str]] = defaultdict(set)
        term, number = np.unique(keys, return_inverse=True)
        ends = np.cumsum(counts)
        for (name, _), end, n in zip(items, ends.tolist(), counts.tolist()):
            own = number[end - n : end].tolist()
            for k in range(max(1, n - window + 1) if n else 0):
                owners[tuple(own[k : k + window])].add(name)
        rows = np.full((len(owners), window), -1, np.int32)
        for i, p in enumerate(owners):
            rows[i, : len(p)] = p
        return cls(term, rows, np.array([len(p) for p in owners], np.int16), [sorted(s) for s in owners.values()])


def _search_shard(shard: Shard, phrases: Phrases) -> tuple[dict[int, set], dict[int, list]]:
    """Items and stretches (in words of the document) found, by the document's number in the shard."""
    items: dict[int, set] = defaultdict(set)
    spans: dict[int, list] = defaultdict(list)
    if not len(phrases.rows) or not len(shard.terms):
        return items, spans
    start, stop = shard.lists(phrases.keys)
    count = np.append(stop - start, np.iinfo(np.int64).max)  # the last stands for places beyond a phrase's end
    for i in np.flatnonzero(count[phrases.rows].min(axis=1) > 0).tolist():
        n = int(phrases.lengths[i])
        term = phrases.rows[i, :n]
        places = shard.phrase(start[term], stop[term])
        if len(places):
            for d, p in zip((np.searchsorted(shard.first, places, side="right") - 1).tolist(), places.tolist()):
                items[d].update(phrases.items[i])
                at = p - int(shard.first[d])
                spans[d].append((at, at + n))
    return items, spans


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _search(index: DataFrame, shared: Broadcast, every: bool) -> DataFrame:
    """The hits of a block's phrases, at most BLOCK_WORDS of them, in all documents or only in those that have some."""
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    schema = pa.schema([("shard", pa.string()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a shard at a time
                shard = Shard(batch.slice(k, 1).to_pylist()[0])
                items, spans = _search_shard(shard, shared.value)
                rows = [{"shard": shard.name, "row": i, "doc_id": d["doc_id"], "n_words": d["n_words"], "spans": [{"start": a, "stop": b} for a, b in merge(spans.get(i, []))], "items": sorted(items.get(i, ()))} for i, d in enumerate(shard.docs) if every or i in spans]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return index.transform(shipped).mapInArrow(run, HITS)


def blocks(items: DataFrame, item_id: str, text: str, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """Phrases of the items, a bounded number of words at a time."""
    some = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string"), F.col(text).cast("binary"))
    held, size = [], 0
    for row in some.toLocalIterator():
        held.append((row[0], bytes(row[1])))
        size += len(row[1]) // 2 + 1  # no text has more words
        if size >= block_words:
            yield Phrases.of(held, window)
            held, size = [], 0
    yield Phrases.of(held, window)


def phrase_matches(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans (words hit) and items of every indexed document.

    Items of one block are looked up as the index is read once. With more blocks each one's hits are
    written, the block is released, and the hits of all meet the documents in one join."""
    context = index.sparkSession.sparkContext
    found, last = [], None
    for block in blocks(items, item_id, text, window, block_words):
        if last is not None:
            found.append(materialise(_search(index, last, False), "phrase-hits"))
            last.destroy()
        last = context.broadcast(block)
    if not found:
        return _search(index, last, True).drop("shard", "row")
    found.append(materialise(_search(index, last, False), "phrase-hits"))
    last.destroy()
    hits = reduce(DataFrame.unionByName, found).groupBy("shard", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    docs = index.select("shard", F.posexplode("docs").alias("row", "d")).select("shard", "row", "d.doc_id", F.col("d.n_words").cast("long").alias("n_words"))
    joined = docs.join(hits, ["shard", "row"], "left")
    empty = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c)
    return joined.select("doc_id", "n_words", empty("spans"), empty("items"))


def proximity_matches(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """doc_id and the first and last word of each least stretch of at most `within` words that has all the terms, in any order."""
    wanted = words([" ".join(terms).encode()])[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.slice(k, 1).to_pylist()[0])
                rows = []
                for a, b in shard.near(*shard.lists(wanted), within):
                    d = shard.docs[shard.doc(a)]
                    rows.append((d["doc_id"], a - d["first"], b - d["first"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "first_word", "last_word"])

    return index.transform(shipped).mapInArrow(run, "doc_id long, first_word long, last_word long")


def words_hit(spans: Column) -> Column:
    """The number of words in the union of the spans."""
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["stop"]).alias("end"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"].cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, spans, items and contaminated (a twentieth of the words hit) of every document."""
    index = materialise(build_index(docs, doc_id, text), "postings")
    hit = words_hit(F.col("spans"))
    found = phrase_matches(index, benchmark).withColumn("n_hit", hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns kept, in which no phrase of the benchmark occurs, however long the document is.

    `contaminated` would let long documents through with whole items in them. Documents are known by their
    texts, so ids may repeat or lack."""
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text)))
    index = materialise(build_index(keyed, key, text), "postings")
    hit = phrase_matches(index, benchmark).where(F.size("spans") > 0).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(sized(materialise(hit, "benchmark-hits")), key, "left_anti").select(*docs.columns)
