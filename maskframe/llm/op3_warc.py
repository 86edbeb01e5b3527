"""WARC archives: a writer with revisit records, and a reader that verifies record boundaries as chains.

Reading. Spark's text source cuts the archives into splits at the record terminator, so no task needs a
whole file. A task emits every place that looks like a record's head as a candidate with its offset and
its successor's (the end that its Content-Length gives). In each split the chains are shortened to where
they leave it; pointer jumping over the splits then tells which candidates a chain from the file's start
reaches, in a number of rounds that is the logarithm of the splits per file. Only those are records:
magic inside a payload is never reached. Records cut by a split or by a false candidate are put together
from their segments.

A split that begins within a run of line ends can make the text source lose or repeat some of them. A file
whose segments don't add up to its size, or whose chain breaks before its end, is read once more by single
line feeds, at which no split is ambiguous; its lines are sorted by place and go through one task as a stream,
so neither such a file nor a record's splits have to fit into memory as a whole. A broken file is cut
off at the break in both readings.

Tables that grow with the records are joined by sorting; others are broadcast only if counted to be few.

Defined results. A null payload is empty. Null page ids are kept; a page without an id is a response
unless a page with one has the same payload. Repeated rows are repeated records; all rows with the
least id of a payload are responses. What follows a broken record in a file can't be reached and is left
out. Empty tables give archives without records.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialise, shipped, sized, slices

LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
_END, _MAGIC = END.encode(), b"WARC/1."
_ID = "urn:maskframe:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of segments that a task sends on at once.
SEND_BYTES = 4 << 20

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean"
PAYLOAD = ", payload binary"
#: A segment; its body if that isn't a whole record, and the record's fields if it is.
SEGMENTS = "file string, split long, at long, length long, next long, body binary, "


# Writing ----------------------------------------------------------------------------------------


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One record a row, in files of text parts; each record ends with the writer's line separator."""
    raw = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.regexp_replace(F.col(url), r"[\r\n]", "").alias("url"), raw.alias("html"), F.octet_length(raw).alias("n"), F.sha2(raw.cast("binary"), 256).alias("digest"))
    # Only payloads that repeat are looked up; a frequent one is a key on the side that adaptive execution splits.
    firsts = rows.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select(F.col("digest").alias("first_digest"), "first")
    firsts = sized(materialise(firsts, "warc-firsts"))
    joined = rows.join(firsts, F.col("digest") == F.col("first_digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    urn = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),  # left out if null
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first")), F.lit(f"\r\nWARC-Profile: {_PROFILE}"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    joined.select(F.concat(head, F.lit(END), block).alias("value")).write.option("lineSep", END).text(path)


# Segments ---------------------------------------------------------------------------------------


def record_length(head: bytes) -> int | None:
    """Bytes of the record that a candidate head claims, its terminator included; None if it isn't a head."""
    length = None
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            value = value.strip()
            if not value.isdigit() or length is not None or len(value) > 15:
                return None
            length = int(value)
    return None if length is None else len(head) + 4 + length + 4


def _cut(pieces: Iterable[tuple[str, int, bytes]]) -> Iterator[tuple[str, int, int, int, int | None, bytes]]:
    """Segments of each split, from candidate to candidate: file, split, at, length, next (by the split's start) and body."""
    key, at, begin, after = None, 0, 0, None
    body: list[bytes] = []

    def flush(upto: int):
        whole = b"".join(body)
        cut = upto - begin
        rest = whole[cut:]
        body[:] = [rest] if rest else []
        if cut:
            yield (*key, begin, cut, after, whole[:cut])

    for file, split, piece in pieces:
        if key != (file, split):
            if key is not None:
                yield from flush(at)
            key, at, begin, after, body = (file, split), 0, 0, None, []
        skip = 0 if piece.startswith(_MAGIC) else 2 if piece.startswith(b"\r\n" + _MAGIC) else None
        length = record_length(piece[skip:]) if skip is not None else None
        if length is not None:
            body.append(piece[:skip])
            yield from flush(at + skip)
            begin, after = at + skip, at + skip + length
            body.append(piece[skip:])
        else:
            body.append(piece)
        body.append(_END)
        at += len(piece) + 4
    if key is not None:
        yield from flush(at)


_KINDS = [("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("length", pa.int64()), ("next", pa.int64()), ("body", pa.binary())]


def _batches(rows: Iterable[tuple], with_payload: bool, all_bodies: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_KINDS if all_bodies else _KINDS + _fields(with_payload))
    names = [n for n, _ in _KINDS]
    held, size = [], 0
    for r in rows:
        row = dict(zip(names, r))
        if not all_bodies and r[4] is not None and r[3] >= r[4] - r[2]:
            row |= parse(r[5][: r[4] - r[2]]) | {"body": None}
        held.append(row)
        size += r[3] + 100
        if size >= SEND_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _scan(with_payload: bool, all_bodies: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_cut((f, s, v) for b in batches for f, s, v in zip(*(b.column(c).to_pylist() for c in ("file", "split", "value")))), with_payload, all_bodies)

    return run


def _pieces(lines: Iterable[tuple[str, bytes]]) -> Iterator[tuple[str, int, bytes]]:
    """The pieces between record terminators of files that come as lines, in order, without their line feeds."""
    file, held = None, []

    def piece(upto: int) -> tuple[str, int, bytes]:
        return file, 0, b"\n".join(held[:upto])

    for f, line in lines:
        if f != file:
            if held:
                yield piece(len(held))
            file, held = f, []
        held.append(line)
        # A terminator: a line that ends with a carriage return, and one that is nothing else.
        if len(held) > 1 and line == b"\r" and held[-2].endswith(b"\r"):
            held[-2:] = [held[-2][:-1]]
            yield piece(len(held))
            held = []
    if held and held != [b""]:
        yield piece(len(held))


def _scan_lines(with_payload: bool, all_bodies: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((f, v) for batch in slices(batches, 1024) for f, v in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()))
        return _batches(_cut(_pieces(lines)), with_payload, all_bodies)

    return run


class Archive:
    """The bytes of archives as segments, cut at candidates."""

    def __init__(self, spark: SparkSession, path: str, with_payload: bool):
        self.spark, self.path, self.with_payload = spark, path, with_payload
        self.odd: list[str] = []
        self.segments = materialise(self.scan(), "warc-segments")
        sizes = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))  # a listing; no content is read
        tiled = self.segments.groupBy("file").agg(F.sum("length").alias("length")).join(sizes.hint("merge"), "file")
        self.read_by_lines(tiled.where("length <> size").select("file"))

    def text(self, separator: str, paths: str | list[str]) -> DataFrame:
        lines = self.spark.read.option("lineSep", separator).text(paths)
        return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))

    def read_by_lines(self, files: DataFrame) -> bool:
        """Read these files once more, by lines; whether there are any that weren't read so yet.

        Their names come to the driver, whose index of the path's files has them all."""
        found = sorted({r["file"] for r in files.collect()} - set(self.odd))
        if found:
            self.odd += found
            self.segments = materialise(self.scan(), "warc-segments")
        return bool(found)

    def scan(self, all_bodies: bool = False) -> DataFrame:
        schema = SEGMENTS.rstrip(", ") if all_bodies else SEGMENTS + RECORD + PAYLOAD * self.with_payload
        lines = self.text(END, self.path)
        if not self.odd:
            return lines.transform(shipped).mapInArrow(_scan(self.with_payload, all_bodies), schema)
        names = self.spark.createDataFrame([(f,) for f in self.odd], "file string")
        found = lines.join(sized(names), "file", "left_anti").select(*lines.columns).transform(shipped).mapInArrow(_scan(self.with_payload, all_bodies), schema)
        single = self.text("\n", self.odd).withColumn("line", F.monotonically_increasing_id())  # rises within a split
        parts = min(len(self.odd), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        ordered = single.repartition(parts, "file").sortWithinPartitions("file", "split", "line").select("file", "value")
        return found.unionByName(ordered.transform(shipped).mapInArrow(_scan_lines(self.with_payload, all_bodies), schema))

    def bodies(self, pieces: DataFrame) -> DataFrame:
        """The pieces' bodies; a second scan if one of them looked like a record of its own."""
        place, side = ["file", "split", "at"], sized(pieces)
        found = self.segments.select(*place, "body").join(side, place)
        return self.scan(all_bodies=True).select(*place, "body").join(side, place) if not found.where("body is null").isEmpty() else found


# Chains -----------------------------------------------------------------------------------------

#: Files in which a table of about one row a split is written.
FEW_FILES = 16


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where each candidate's chain leaves its split; -1 if it meets a place that is no candidate."""
    out: dict[int, int] = {}
    for off, succ, stop in sorted(zip(pdf["off"], pdf["next"], pdf["stop"]), reverse=True):
        out[off] = succ if succ >= stop else out.get(succ, -1)
    pdf["exit"] = [out[o] for o in pdf["off"]]
    return pdf[["file", "off", "exit"]]


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates that the chain from the split's entry passes."""
    succ = dict(zip(pdf["off"], pdf["next"]))
    passed = set()
    for off in pdf.loc[pdf["entry"], "off"]:
        while off in succ and off not in passed:
            passed.add(off)
            off = succ[off]
    return pdf.loc[pdf["off"].isin(passed), ["file", "split", "at", "off", "length", "next"]]


def reachable(meta: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The splits' places in their files, the segments' places, and the candidates that chains from the files' starts reach.

    meta: file, split, at, length and next of all segments."""
    splits = meta.groupBy("file", "split").agg(F.sum("length").alias("total"))
    by_file = Window.partitionBy("file").orderBy("split")  # a row a split
    splits = splits.withColumns({"stop": F.sum("total").over(by_file), "rank": F.row_number().over(by_file)})
    splits = materialise(splits.withColumn("base", F.col("stop") - F.col("total")).coalesce(FEW_FILES), "warc-splits")
    placed = meta.join(sized(splits.drop("total", "rank")), ["file", "split"]).withColumns({"off": F.col("base") + F.col("at"), "next": F.col("base") + F.col("next")})
    cands = materialise(placed.where("next is not null").select("file", "split", "at", "off", "length", "next", "stop"), "warc-candidates")
    most = splits.agg(F.max("rank")).first()[0] or 1
    reach = splits.select("file", F.lit(0).cast("long").alias("off")).distinct()
    if most > 1:
        jumps = cands.transform(shipped).groupBy("file", "split").applyInPandas(_exits, "file string, off long, exit long").where("exit >= 0")
        rounds = math.ceil(math.log2(most))
        for k in range(rounds):
            jumps = materialise(jumps, f"warc-jumps-{k}")
            ahead = reach.hint("merge").join(jumps, ["file", "off"]).select("file", F.col("exit").alias("off"))
            reach = materialise(reach.unionByName(ahead).distinct().coalesce(FEW_FILES), f"warc-reach-{k}")  # about one a split
            twice = jumps.select("file", F.col("off").alias("from"), F.col("exit").alias("off")).join(jumps.hint("merge"), ["file", "off"])
            jumps = twice.select("file", F.col("from").alias("off"), "exit")
    marked = cands.join(sized(reach.withColumn("entry", F.lit(True))), ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    passed = marked.transform(shipped).groupBy("file", "split").applyInPandas(_walk, "file string, split long, at long, off long, length long, next long")
    return splits, placed, materialise(passed, "warc-reached")


# Records ----------------------------------------------------------------------------------------


def parse(record: bytes) -> dict:
    """Fields of a whole record."""
    head, _, block = record.partition(_END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    block = block[: int(fields[b"content-length"])]
    http, _, payload = block.partition(_END)
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    claimed = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha256:")
    number = lambda v: int(x) if (x := v.decode("ascii", "replace").strip("<>").removeprefix(_ID)).lstrip("-").isdigit() else None
    full = next((int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length" and v.strip().isdigit()), len(payload))
    digest = claimed if kind == "revisit" else hashlib.sha256(payload).hexdigest()
    url = fields.get(b"warc-target-uri")
    return {
        "page_id": number(fields.get(b"warc-record-id", b"")), "url": None if url is None else url.decode("utf-8", "replace"), "record_type": kind, "refers_to": number(fields.get(b"warc-refers-to", b"")),
        "payload_bytes": full if kind == "revisit" else len(payload), "payload_digest": digest, "intact": digest == claimed, "payload": None if kind == "revisit" else payload,
    }


def _fields(with_payload: bool) -> list[tuple[str, pa.DataType]]:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())]
    return kinds + [("payload", pa.binary())] * with_payload


def _parsed(with_payload: bool):
    schema = pa.schema(_fields(with_payload))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([parse(b.as_py()) for b in batch.column("body")], schema=schema)

    return run


def _joined(parts: Column) -> Column:
    return F.aggregate(F.array_sort(parts), F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["body"]))


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row a record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact and, if asked for, the payload."""
    archive = Archive(spark, path, with_payload)
    place = ["file", "split", "at"]
    while True:
        meta = archive.segments.select("file", "split", "at", "length", "next")
        splits, placed, reached = reachable(meta)
        # A chain has to end where its file does; one that doesn't is followed once more by lines.
        ends = splits.groupBy("file").agg(F.max("stop").alias("stop")).join(reached.groupBy("file").agg(F.max("next").alias("upto")), "file", "left")
        if not archive.read_by_lines(ends.where("upto is null or upto < stop").select("file")):
            break
    fields = [n for n, _ in _fields(with_payload)]
    plain = archive.segments.where((F.col("next").isNotNull()) & F.col("body").isNull())
    # Records in one segment need no join but with the candidates that aren't records, if there are any.
    if meta.where("next is not null").count() > reached.count():
        false = meta.where("next is not null").select(*place).join(reached.hint("merge"), place, "left_anti")
        plain = plain.join(sized(materialise(false, "warc-false")), place, "left_anti")
    plain = plain.select(fields)
    # The others: a segment belongs to the last record that begins before it, in its split or else in those before.
    record = F.struct(F.col("off").alias("record"), (F.col("next") - F.col("off") > F.col("length")).alias("cut"), F.col("next").alias("upto"))
    own = reached.select(*place, record.alias("own"))
    last = reached.groupBy("file", "split").agg(F.max_by(record, "off").alias("last"))
    carried = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    carry = splits.select("file", "split").join(last.hint("merge"), ["file", "split"], "left").select("file", "split", carried.alias("before"))
    within = F.last("own", ignorenulls=True).over(Window.partitionBy("file", "split").orderBy("off"))
    known = placed.select(*place, "off").join(own.hint("merge"), place, "left").withColumn("within", within)
    owned = known.join(carry.hint("merge"), ["file", "split"]).withColumn("owner", F.coalesce("within", "before"))
    pieces = owned.where("owner.cut and off < owner.upto").select(*place, "off", F.col("owner.record").alias("record"), (F.col("owner.upto") - F.col("owner.record")).alias("size"))
    glued = archive.bodies(materialise(pieces, "warc-pieces")).groupBy("file", "record", "size").agg(F.collect_list(F.struct("off", "body")).alias("parts"))  # as large as one record
    # The text source gives no terminator at a file's end, where it is counted all the same.
    glued = glued.select("size", _joined(F.col("parts")).alias("body")).where(F.octet_length("body") >= F.col("size")).select("body")
    return plain.unionByName(glued.transform(shipped).mapInArrow(_parsed(with_payload), RECORD + PAYLOAD * with_payload))
