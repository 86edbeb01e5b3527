"""Best-fit packing of token pieces into sequences, in rounds.

Pieces are dealt out evenly, whatever order the files hold them in, so that each task sees the whole mix
of lengths. Tasks pack their own pieces by best fit, decreasing. Bins that are nearly full are done; the others
go up a tree of merging tasks, FAN to one, as single items, and best fit is repeated until one task is left.

Best fit leaves a task at most one bin that is half full or less, and of two fuller ones neither takes the
other. So on the whole way up a task's bins can meet at most FAN - 1 small ones a level, and a task passes
on only that many bins of each fill. Those it keeps back find nothing later that those it passes on
wouldn't take, so the result is as if all had gone up, while a merging task holds a bounded number of bins
whatever the size of the input: nothing is left out, and no two bins of the result that were sent up fit together.

Defined results. A null text is empty and gives one piece, the end token. Repeated rows are packed as
often as they appear. An empty table gives an empty result. A document longer than a sequence is cut
from its end, so its first piece may be the shorter one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, materialise, shipped

CAPACITY = 1024
END_ID = 2
#: A bin with at most this share of room left is done.
SLACK = 0.002
#: Pieces that a task of the first round takes, and tasks whose bins meet in one of the next round.
FIRST_ITEMS = 50_000
FAN = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BIN = "node int, up boolean, fill int, items array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


class BestFit:
    """Bins by remaining room, in a balanced search structure: a sorted list of the rooms in use, and the bins of each."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.bins, self.n = capacity, [], {}, 0

    def put(self, size: int) -> int:
        """The number of the bin with the least room that takes `size`; a new one if none does."""
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            number, room = self.n, self.capacity
            self.n += 1
        else:
            room = self.rooms[at]
            stack = self.bins[room]
            number = stack.pop()
            if not stack:
                del self.rooms[at], self.bins[room]
        if room - size:
            if room - size not in self.bins:
                insort(self.rooms, room - size)
                self.bins[room - size] = []
            self.bins[room - size].append(number)
        return number


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, by best fit in order of falling size."""
    out, fit = np.empty(len(sizes), np.int64), BestFit(capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        out[i] = fit.put(int(sizes[i]))
    return out


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of a byte-level BPE file, word by word, with the words seen lately kept.

    Where the merges and the split pattern are the common byte-level ones, a rank-based encoder of the
    same vocabulary gives the same ids several times faster; a text with a special token's string, or
    any other kind of file, goes to the file's own tokenizer."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self._slow = path, None
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = None
        pre = spec.get("pre_tokenizer") or {}
        plain = spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if plain:
            self.fast = self._ranks(spec)

    @property
    def slow(self):
        """The file's own tokenizer, loaded when a text first needs it."""
        if self._slow is None:
            self._slow = tokenizer(self.path)
        return self._slow

    def _ranks(self, spec: dict):
        import tiktoken

        # A byte-level vocabulary writes each byte as a printable character.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = set(self.special)
        vocab = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # Ranks stand for ids only if merges come in the order of the ids they make.
        made = [vocab.get(bytes(byte[c] for c in a + b)) for a, b in merges]
        if None in made or any(x >= y for x, y in zip(made, made[1:])):
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences but for the first."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenized(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for part, texts in chunks(batches, "text"):
            rows, ids = [], []
            for key, t in zip(part.column("doc_id").to_pylist(), texts):
                found = np.array([*encode(t.decode("utf-8", "replace")), END_ID], "<u4")
                for k, (s, n) in enumerate(cut(len(found), capacity)):
                    rows.append((key, k, s, n, zlib.crc32(found[s : s + n].tobytes())))
                    if with_ids:
                        ids.append(found[s : s + n].astype(np.int32))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return df.transform(shipped).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])


def passed_on(fills: np.ndarray, capacity: int, small_ones: int) -> np.ndarray:
    """Whether a bin goes up: it isn't nearly full, and is among the first `small_ones` of its fill if it is more than half full."""
    order = np.argsort(fills, kind="stable")
    ordered = fills[order]
    first = np.searchsorted(ordered, ordered)
    up = np.empty(len(fills), bool)
    up[order] = (np.arange(len(fills)) - first < small_ones) | (2 * ordered <= capacity)
    return up & (fills < capacity - int(SLACK * capacity))


def _packed(node: int, fills: list[int], contents: list[list[dict]], capacity: int, small_ones: int) -> pa.RecordBatch:
    """A task's items (each a list of pieces with offsets) packed into bins, and which of these go up."""
    where = pack(np.array(fills, np.int64), capacity)
    n = int(where.max()) + 1 if len(where) else 0
    fill, items = np.zeros(n, np.int64), [[] for _ in range(n)]
    for b, size, pieces in zip(where.tolist(), fills, contents):
        at = int(fill[b])
        items[b] += [p | {"offset": p["offset"] + at} for p in pieces]
        fill[b] += size
    arrays = [pa.array(np.full(n, node), pa.int32()), pa.array(passed_on(fill, capacity, small_ones)), pa.array(fill, pa.int32()), pa.array(items, pa.list_(_PIECE))]
    return pa.RecordBatch.from_arrays(arrays, names=["node", "up", "fill", "items"])


def _first_round(capacity: int, small_ones: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [r | {"offset": 0} for batch in batches for r in batch.to_pylist()]  # about FIRST_ITEMS
        yield _packed(TaskContext.get().partitionId(), [r["length"] for r in rows], [[r] for r in rows], capacity, small_ones)

    return run


def _merge_round(capacity: int, small_ones: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        packed = _packed(key[0].as_py(), table.column("fill").to_pylist(), table.column("items").to_pylist(), capacity, small_ones)
        return pa.Table.from_batches([packed])

    return run


def residual_packing(pieces: DataFrame, capacity: int = CAPACITY, first_items: int = FIRST_ITEMS, fan: int = FAN) -> DataFrame:
    """Bins (fill, items with offsets): local best fit, then rounds over the bins that are passed on.

    The pieces, which are read twice, are dealt out in turn before the first round: each task's rows go in order
    of their hash, one to each task of the next stage, so equal rows don't meet in one either.
    Each round's bins are written to the shared folder, so a lost executor costs one round."""
    tasks = -(-pieces.count() // first_items) or 1
    levels = 0
    while fan**levels < tasks:
        levels += 1
    small_ones = (fan - 1) * levels  # that a bin can meet on its way up
    spread = pieces.repartition(tasks).transform(shipped).mapInArrow(_first_round(capacity, small_ones), BIN)
    bins = materialise(spread, "packing-0")
    done = bins.where(~F.col("up") | F.lit(levels == 0))
    for k in range(1, levels + 1):
        groups = bins.where("up").select((F.col("node") / fan).cast("int").alias("parent"), "fill", "items").groupBy("parent")
        bins = materialise(groups.applyInArrow(_merge_round(capacity, small_ones), BIN), f"packing-{k}")
        done = done.unionByName(bins.where(~F.col("up") | F.lit(k == levels)))
    return done.select("fill", "items")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Tokens are made once; the packing carries lengths and places only."""
    bins = residual_packing(materialise(tokenized(docs, tokenizer_path, doc_id, text, capacity), "pieces"), capacity)
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "items")
    numbered = numbered.select("sequence_id", F.explode("items").alias("p"))  # after the numbering, which is by bin
    return numbered.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
