"""Removal of repeated 200-byte strings by sampled suffixes, induced sorting and common-prefix values.

A sort of all suffixes of a corpus needs several times its size in tuples. Here a sample is sorted first
and the rest is induced from it, as in induced suffix sorting, but the sample is chosen by content:

1. Each window (a string of LENGTH bytes at a place) has an anchor, its least ANCHOR-byte hash, the first
   of equals. Equal windows have equal anchors at equal distances. The windows of one anchor are one
   stretch of text, a segment, and only segments of one anchor hash can share a window. Tasks emit a row
   a segment, with a hash of its bytes; equal segments within a task are settled there and one goes on.
2. By anchor, in Spark's spilling sort: a segment alone with its anchor is unique and done. Segments with
   equal bytes are repeated as a whole. Those with the same anchor and other bytes stay open.
3. The open segments' bytes are gathered by anchor. Their sampled suffixes, those at the anchors, are
   sorted with their common-prefix values; the suffixes one byte further left follow from the tuples
   (byte, rank of the suffix to the right), and their common-prefix values from the least value between
   the ranks; so on to the segments' starts. A value of LENGTH or more to a neighbour marks a window.

The spilling sorts of steps 2 and 3 take the place of disk-backed queues: a task holds one group of anchors
at a time. What a group may hold is settled by counts before the sort: an anchor with more than
HOT_SEGMENTS segments, such as that of a line that very many documents have, doesn't go to one task. Its
segments are counted by their bytes with partial sums; equal ones are settled so. One of each goes on to the
sort of step 3, or, where these are over HOT_SEGMENTS too, by the hashes of its windows, which spread. All
ways mark the same windows.

Defined results. A null text has no bytes. Texts under LENGTH bytes lose nothing. Repeated rows are
copies and lose all bytes if they have LENGTH or more. Null ids are kept. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, materialise, mix64, shipped, sized, slices

LENGTH = 200
ANCHOR = 64
HOT_SEGMENTS = 1_000
#: Segments that a task settles among themselves before it sends them, and that it sorts at once.
TASK_SEGMENTS = 1 << 19
SORT_SEGMENTS = 20_000
#: Bytes looked at in one go; longer texts are read in overlapping parts.
SCAN_BYTES = 1 << 19
_PLACE_BITS = np.uint64(26)

SPAN, SEGMENT = 1, 0
ROWS = "kind int, anchor long, sup long, multi boolean, blob binary, start int, windows int, at int"
OPEN = "kind int, anchor long, blob binary, start int, windows int, at int"
BODIES = "anchor long, hot boolean, blob binary, start int, at int, body binary"

_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_STEP = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the step and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            p = np.full(max(n, 2 * SCAN_BYTES), base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[name] = p
    return _powers["up"], _powers["down"]


def _prefix(data: np.ndarray) -> np.ndarray:
    run = np.empty(len(data) + 1, np.uint64)
    run[0] = 0
    np.cumsum(_VALUE[data] * _power(len(data) + 1)[0][: len(data)], out=run[1:])
    return run


def segments(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Segments of texts that stand at [begin, end) in data: anchor hash, hash of the bytes, first window, windows, the anchor's distance."""
    if len(data) < length:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    run, (_, down) = _prefix(data), _power(len(data) + 1)
    hashes = mix64((run[anchor:] - run[:-anchor]) * down[: len(data) - anchor + 1])
    mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    width, size = length - anchor + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    change = np.zeros(len(data) + 1, np.int32)
    long = ends - begins >= length
    np.add.at(change, begins[long], 1)
    np.add.at(change, ends[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(change[: len(least)]) > 0)
    place = (least[window] & mask).astype(np.int64)
    head = np.append(True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1))[: len(window)]
    first = np.flatnonzero(head)
    low, count = window[first], np.diff(np.append(first, len(window)))
    at = place[first] - low
    whole = mix64((run[low + count - 1 + length] - run[low]) * down[low]) ^ (at * 1000 + count).astype(np.uint64) * np.uint64(_STEP)
    return hashes[place[first]], whole, low, count, at


def _emit(kind: int, anchor, sup, multi, blob, start, windows, at) -> pa.RecordBatch:
    n = len(start)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(anchor.view(np.int64)), pa.array(sup.view(np.int64)), pa.array(multi), pa.array(blob, pa.binary()), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(at.astype(np.int32))],
        names=["kind", "anchor", "sup", "multi", "blob", "start", "windows", "at"],
    )


def _scan(length: int, anchor: int):
    def settled(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Equal segments of one task: all but the first are known to be repeated, and the first too."""
        key, sup, start, windows, at = (np.concatenate(x) for x in list(zip(*held))[:5])
        blobs = [b for h in held for b in h[5]]
        names = np.array(blobs, object)[np.concatenate([h[6] + sum(len(g[5]) for g in held[:i]) for i, h in enumerate(held)])] if blobs else np.empty(0, object)
        order = np.lexsort((sup, key))
        key, sup, start, windows, at, names = (x[order] for x in (key, sup, start, windows, at, names))
        head = np.append(True, (key[1:] != key[:-1]) | (sup[1:] != sup[:-1]))
        first = np.flatnonzero(head)
        multi = np.diff(np.append(first, len(key))) > 1
        yield _emit(SEGMENT, key[first], sup[first], multi, names[first], start[first], windows[first], at[first])
        rest = np.flatnonzero(~head)
        if len(rest):
            yield _emit(SPAN, key[rest], sup[rest], np.ones(len(rest), bool), names[rest], start[rest], windows[rest], at[rest])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a copy has nothing new
        held: list[tuple] = []
        size = 0
        for part, texts in chunks(batches, "text", SCAN_BYTES):
            fresh: list[tuple[bytes, bytes]] = []
            for t, b in zip(texts, part.column("blob").to_pylist()):
                if b not in seen and len(t) >= length:
                    seen.add(b)
                    fresh.append((b, t))
            if len(fresh) == 1 and len(fresh[0][1]) > 2 * SCAN_BYTES:
                b, t = fresh[0]
                parts = [([(b, t[s : s + SCAN_BYTES + length - 1])], s) for s in range(0, len(t) - length + 1, SCAN_BYTES)]
            else:
                parts = [(fresh, 0)]
            for rows, shift in parts:
                ends = np.cumsum([len(t) for _, t in rows])
                begins = ends - np.array([len(t) for _, t in rows], np.int64)
                key, sup, low, count, at = segments(np.frombuffer(b"".join(t for _, t in rows), np.uint8), begins.astype(np.int64), ends.astype(np.int64), length, anchor)
                if len(key):
                    owner = np.searchsorted(ends, low, side="right")
                    held.append((key, sup, low - begins[owner] + shift, count, at, [b for b, _ in rows], owner))
                    size += len(key)
            if size >= TASK_SEGMENTS:
                yield from settled(held)
                held, size = [], 0
        if held:
            yield from settled(held)

    return run


def _resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by anchor, then bytes: spans of repeated segments, and the open ones, one of each if repeated."""
    kept = ("anchor", "sup", "multi", "blob", "start", "windows", "at")
    names = ["kind", "anchor", "blob", "start", "windows", "at"]

    def settle(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchor, sup, multi, blob, start, windows, at = cols
        same_anchor = anchor[1:] == anchor[:-1]
        same = same_anchor & (sup[1:] == sup[:-1])
        # Copies come from several tasks with equal blob and start; each counts once.
        twin = np.append(False, same & (blob[1:] == blob[:-1]) & (start[1:] == start[:-1]))
        head = np.append(True, ~same)
        group = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        many = np.bincount(group, weights=~twin) > 1
        many |= np.bincount(group, weights=multi) > 0
        top = np.append(True, ~same_anchor)[first]  # the anchor's first group
        variants = np.bincount(np.cumsum(top) - 1)[np.cumsum(top) - 1]
        span = many[group] & ~twin
        for kind, rows in ((SPAN, np.flatnonzero(span)), (SEGMENT, first[variants > 1])):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), pa.array(anchor[rows]), pa.array(blob[rows], pa.binary()), *(pa.array(c[rows].astype(np.int32)) for c in (start, windows, at))], names=names)

    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [np.array(batch.column(c).to_pylist(), object) if c == "blob" else batch.column(c).to_numpy(zero_copy_only=False).copy() for c in kept]
        held.append(cols)
        size = sum(len(h[0]) for h in held)
        edge = np.flatnonzero(cols[0][1:] != cols[0][:-1])  # the last anchor may go on
        if size >= 100_000 and len(edge):
            cut = int(edge[-1]) + 1
            held[-1] = [c[:cut] for c in cols]
            yield from settle([np.concatenate(x) for x in zip(*held)])
            held = [[c[cut:] for c in cols]]
    if held:
        yield from settle([np.concatenate(x) for x in zip(*held)])


# Induced sorting --------------------------------------------------------------------------------


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high+1] for each pair, low <= high, by a table of powers of two."""
    table = [values]
    most = int((high - low).max(initial=0)) + 1
    while 2 * (1 << (len(table) - 1)) <= most:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    for k in range(len(table)):
        mine = level == k
        out[mine] = np.minimum(table[k][low[mine]], table[k][high[mine] - (1 << k) + 1])
    return out


def induce(group: np.ndarray, texts: list[bytes], at: np.ndarray, length: int) -> np.ndarray:
    """Marks (a row a segment, a column a start) of the strings of `length` bytes that another segment of the group has at the same distance from its anchor.

    group: numbers of the segments' anchors; at: where the anchor begins in each segment's text."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    data = np.zeros((n, int(size.max(initial=0)) + 1), np.uint8)
    for i, t in enumerate(texts):
        data[i, : len(t)] = np.frombuffer(t, np.uint8)
    marks = np.zeros((n, max(1, int((size - length).max(initial=0)) + 1)), bool)
    # The sample: suffixes at the anchors, by group, with the common prefix of each with the one before it.
    order = np.array(sorted(range(n), key=lambda i: (group[i], texts[i][at[i] :])), np.int64)
    shared = np.zeros(n, np.int64)
    for i in range(1, n):
        p, q = order[i - 1], order[i]
        if group[p] == group[q]:
            m = int(min(size[p] - at[p], size[q] - at[q]))
            differ = data[p, at[p] : at[p] + m] != data[q, at[q] : at[q] + m]
            k = int(differ.argmax()) if m else 0
            shared[i] = k if m and differ[k] else m
    for back in range(int(at.max(initial=-1)) + 1):
        if back:
            # The rest, a byte further left: by (group, byte, rank of the suffix to the right).
            old = np.flatnonzero(at[order] >= back)
            rows = order[old]
            key = group[rows] * 256 + data[rows, at[rows] - back]
            turn = np.argsort(key, kind="stable")
            rank, key = old[turn], key[turn]
            fit = np.flatnonzero(key[1:] == key[:-1]) + 1
            now = np.zeros(len(rows), np.int64)
            if len(fit):
                now[fit] = 1 + _range_minima(shared, rank[fit - 1] + 1, rank[fit])
            order, shared = rows[turn], now
        near = shared >= length
        hit = near.copy()
        hit[:-1] |= near[1:]
        rows = order[hit]
        marks[rows, at[rows] - back] = True
    return marks


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and length of each run of marks."""
    wide = np.zeros((marks.shape[0], marks.shape[1] + 2), np.int8)
    wide[:, 1:-1] = marks
    step = np.diff(wide, axis=1)
    row, low = np.nonzero(step == 1)
    return row, low, np.nonzero(step == -1)[1] - low


def _sort_open(length: int):
    def settle(rows: list[tuple]) -> pa.RecordBatch | None:
        anchor, texts, at = np.array([r[0] for r in rows], np.int64), [r[4] for r in rows], np.array([r[3] for r in rows], np.int64)
        group = np.cumsum(np.append(0, anchor[1:] != anchor[:-1]))
        row, low, count = _runs(induce(group, texts, at, length))
        if len(row):
            start = np.array([r[2] for r in rows], np.int64)[row] + low
            return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in row.tolist()], pa.binary()), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=["blob", "start", "windows"])
        return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in slices(batches, 1024):
            for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "blob", "start", "at", "body"))):
                if r[0] != last and len(held) >= SORT_SEGMENTS:
                    if (out := settle(held)) is not None:
                        yield out
                    held = []
                if r[:3] != (held[-1][:3] if held else None):  # one of each place
                    held.append(r)
                last = r[0]
        if held and (out := settle(held)) is not None:
            yield out

    return run


def _gather(length: int):
    """The bytes of a text's open segments."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, blob, parts in zip(*(batch.column(c).to_pylist() for c in ("text", "blob", "parts"))):
                anchor, hot, start, windows, at = zip(*((p["anchor"], p["hot"], p["start"], p["windows"], p["at"]) for p in parts))
                body = [text[s : s + w - 1 + length] for s, w in zip(start, windows)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(hot, pa.bool_()), pa.array([blob] * len(body), pa.binary()), pa.array(start, pa.int32()), pa.array(at, pa.int32()), pa.array(body, pa.binary())], names=["anchor", "hot", "blob", "start", "at", "body"])

    return run


def _window_hashes(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, blob, start, at, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "blob", "start", "at", "body"))):
                data = np.frombuffer(body, np.uint8)
                prefix, (_, down) = _prefix(data), _power(len(data) + 1)
                h = mix64((prefix[length:] - prefix[:-length]) * down[: len(data) - length + 1]).view(np.int64)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array((at - np.arange(n)).astype(np.int32)), pa.array(h), pa.array([blob] * n, pa.binary()), pa.array((start + np.arange(n)).astype(np.int32))], names=["anchor", "back", "hash", "blob", "start"])

    return run


def repeated_spans(docs: DataFrame, copies: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """blob, start and windows of stretches of windows that occur elsewhere.

    docs: doc_id, text and blob (the text's digest), the last two binary; copies: blob and the least doc_id that has it.
    Copies are taken as one text; windows that only copies of a text share aren't listed."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(docs.select("text", "blob").transform(shipped).mapInArrow(_scan(length, anchor), ROWS), "segments")
    place = ["blob", "start", "windows"]
    every = rows.where(F.col("kind") == SEGMENT)
    hot = materialise(every.groupBy("anchor").count().where(F.col("count") > hot_segments).select("anchor"), "hot-anchors")
    side = sized(hot)
    by_anchor = every.join(side, "anchor", "left_anti").repartition(parts, "anchor").sortWithinPartitions("anchor", "sup", "blob", "start")
    settled = materialise(by_anchor.transform(shipped).mapInArrow(_resolve, OPEN), "settled-segments")
    spans = rows.where(F.col("kind") == SPAN).select(place).unionByName(settled.where(F.col("kind") == SPAN).select(place))
    opened = settled.where(F.col("kind") == SEGMENT).select("anchor", F.lit(False).alias("hot"), *place, "at")
    some = not hot.isEmpty()
    if some:
        crowd = materialise(every.join(side, "anchor", "left_semi"), "crowded-segments")
        groups = crowd.groupBy("anchor", "sup").agg(F.min(F.struct("blob", "start", "windows", "at")).alias("first"), F.max(F.struct("blob", "start", "windows", "at")).alias("last"), F.bool_or("multi").alias("multi"))
        groups = materialise(groups.select("anchor", "sup", "first", (F.col("multi") | (F.col("first") != F.col("last"))).alias("many")), "hot-segments")
        spans = spans.unionByName(crowd.join(sized(groups.where("many").select("anchor", "sup")), ["anchor", "sup"]).select(place))
        differing = groups.groupBy("anchor").count().where(F.col("count") > 1).select("anchor", (F.col("count") > hot_segments).alias("hot"))  # no more than there are hot anchors
        more = groups.join(sized(materialise(differing, "open-anchors")), "anchor").select("anchor", "hot", "first.*")
        opened = opened.unionByName(more)
    by_text = opened.groupBy("blob").agg(F.collect_list(F.struct("anchor", "hot", "start", "windows", "at")).alias("parts"))  # as long as the text at most
    by_text = by_text.join(copies.select("blob", "least"), "blob")
    # One copy of each text; rows that repeat an id give equal segments, which count once.
    held = docs.select("doc_id", "text", F.col("blob").alias("held")).join(by_text, (F.col("held") == F.col("blob")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("text", "blob", "parts")
    bodies = materialise(held.transform(shipped).mapInArrow(_gather(length), BODIES), "open-segments")
    cool = bodies.where(~F.col("hot")).drop("hot")
    found = cool.repartition(parts, "anchor").sortWithinPartitions("anchor", "blob", "start").transform(shipped).mapInArrow(_sort_open(length), "blob binary, start int, windows int")
    spans = spans.unionByName(found)
    if some:
        each = bodies.where("hot").drop("hot").transform(shipped).mapInArrow(_window_hashes(length), "anchor long, back int, hash long, blob binary, start int")
        # Rows that repeat an id give equal places, so a window is shared if it has two different ones.
        shared = each.groupBy("anchor", "back", "hash").agg(F.min(F.struct("blob", "start")).alias("a"), F.max(F.struct("blob", "start")).alias("b")).where("a <> b").select("anchor", "back", "hash")
        spans = spans.unionByName(each.join(shared, ["anchor", "back", "hash"]).select("blob", "start", F.lit(1).alias("windows")))
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs (begin, end) of the union of the spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _removed(length: int, with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text, copies, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copies", "spans"))):
                if copies > 1 and len(text) >= length:
                    runs = [(0, len(text))]
                else:
                    runs = merged([(s["start"], s["start"] + s["windows"] - 1 + length) for s in spans or ()])
                at, kept = 0, []
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out.append((doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot_segments: int = HOT_SEGMENTS, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), raw.alias("text"), F.unhex(F.substring(F.sha2(raw, 256), 1, 32)).alias("blob"))
    copies = materialise(rows.groupBy("blob").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "text-copies")
    spans = repeated_spans(rows, copies, length, anchor, hot_segments)
    by_text = spans.groupBy("blob").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    facts = copies.join(by_text, "blob", "left").where("copies > 1 or spans is not null").select(F.col("blob").alias("of"), "copies", "spans")
    whole = rows.join(facts, F.col("blob") == F.col("of"), "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "spans")
    return whole.transform(shipped).mapInArrow(_removed(length, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
