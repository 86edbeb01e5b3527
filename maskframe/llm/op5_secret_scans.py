"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger is a table of (blob, rule
set version, spans). A scan takes one copy of each blob that lacks some rule set's version, applies just
those rule sets, appends the outcome to the ledger, and joins the ledger back to all paths that hold a
blob. Texts move once, and only those of unseen blobs are read by a rule. The join back is by blob: a
blob held by many paths is a frequent key on the side that adaptive execution splits.

Defined results. A null text is the empty blob. Repeated rows get equal results. Null ids are kept.
Empty tables give empty results. Overlapping spans of different kinds all count.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import let
from ._common import fresh, materialise, scratch_path

# The patterns of the base kinds (the last number is the least length, of the group named before it).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"

#: Rule sets by version: kind, pattern, group whose length counts, least length, a string that every match has (or none), and the
#: group that is the span and ends the match. A change to a set must change its version; only then are blobs scanned again, and only for that set.
#: Patterns take time in proportion to the text: a run of characters is entered at its beginning only, or ends where the next match may begin.
RULE_SETS: dict[str, list[tuple[str, str, int, int, str | None, int]]] = {
    "base-1": [("assign", ASSIGN, 2, 8, None, 0), ("access", ACCESS, 0, 16, "AKIA", 0), ("hex", HEX, 0, 32, None, 0)],
    "keys-2": [
        ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----", 0),
        ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh", 0),
        ("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", 1, 1, "eyJ", 1),
    ],
}
BASE_KINDS = ("assign", "access", "hex")
#: Kinds in the order in which they are listed at one place.
KINDS = [kind for rules in RULE_SETS.values() for kind, *_ in rules]

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = f"blob binary, rules string, spans {SPANS}"
MARK = "[SECRET]"


#: Values that a running total copies at once; one more level takes the blocks' totals.
BLOCK = 128


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running totals of an array of INT by an associative function that 0 leaves as it is.

    A fold that appends copies what it has for each value, so it runs over blocks of BLOCK values, and once over the blocks."""
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    ints = F.array().cast("array<int>")
    fold = lambda part: F.aggregate(part, ints, lambda acc, x: F.concat(acc, F.array(combine(last(acc), x))))

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(BLOCK))
        return F.transform(starts, lambda s: fold(F.slice(v, s + 1, F.lit(BLOCK))))

    def joined(parts: Column) -> Column:
        return let(fold(F.transform(parts, last)), lambda ends: F.flatten(F.transform(parts, lambda part, i: let(F.coalesce(F.get(ends, i - 1), F.lit(0)), lambda before: F.transform(part, lambda x: combine(before, x))))))

    return let(values, lambda v: let(blocks(v), joined))


def rule_spans(text: Column, kind: str, pattern: str, group: int, least: int, has: str | None, span: int) -> Column:
    """The spans (code points, end exclusive) of one rule: matches from the left, none overlapping, those too short dropped."""
    rank = KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) if g else found
    gaps = F.split(text, pattern, -1)  # what stands before, between and behind the matches
    sizes = lambda strings: F.transform(strings, lambda s: F.length(s))
    facts = F.struct(sizes(gaps).alias("gap"), sizes(found).alias("match"), sizes(of(group)).alias("gauge"), sizes(of(span)).alias("span"))

    def spans(f: Column) -> Column:
        ends = running(F.zip_with(F.slice(f["gap"], F.lit(1), F.size(f["match"])), f["match"], lambda g, m: g + m), lambda a, b: a + b)
        every = F.zip_with(F.zip_with(f["gauge"], f["span"], lambda g, n: F.struct(g.alias("gauge"), n.alias("n"))), ends, lambda x, e: F.struct((e - x["n"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), x["gauge"].alias("gauge")))
        long = F.filter(every, lambda x: x["gauge"] >= least)
        return F.transform(long, lambda x: F.struct(x["start"], x["rank"], x["kind"], x["end"]))

    matches = text.rlike(pattern)
    return F.when(F.contains(text, F.lit(has)) & matches if has else matches, let(facts, spans)).otherwise(F.array().cast(SPANS))


def set_spans(text: Column, version: str) -> Column:
    """All spans of a rule set by start, then kind."""
    return F.array_sort(reduce(F.concat, [rule_spans(text, *rule) for rule in RULE_SETS[version]]))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class Ledger:
    """A growing Parquet table of scanned (blob, rule set version) pairs."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "blob-ledger")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            spark.createDataFrame([], LEDGER).write.parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def scan(self, versions: DataFrame, text: str, paths: DataFrame) -> None:
        """Scan what is unseen. versions: all rows with `path` and the text; paths: their path and blob."""
        blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
        wanted = blobs.withColumn("rules", F.explode(F.array(*map(F.lit, RULE_SETS))))
        unseen = wanted.join(self.rows().select("blob", "rules"), ["blob", "rules"], "left_anti").groupBy("blob", "path").agg(F.collect_set("rules").alias("todo"))
        held = versions.select(F.col("path").alias("held_path"), F.coalesce(text, F.lit("")).alias("text"), blob_of(F.col(text)).alias("held_blob"))
        read = held.join(unseen, F.col("held_path").eqNullSafe(F.col("path")) & (F.col("held_blob") == F.col("blob")))
        outcome = [F.when(F.array_contains("todo", v), F.struct(F.lit(v).alias("rules"), set_spans(F.col("text"), v).alias("spans"))) for v in RULE_SETS]
        done = read.select("blob", F.explode(F.array_compact(F.array(*outcome))).alias("r")).select("blob", "r.rules", "r.spans")
        done.write.mode("append").parquet(self.path)

    def findings(self) -> DataFrame:
        """blob and spans of the current rule sets, for blobs with any."""
        current = self.rows().where(F.col("rules").isin(*RULE_SETS) & (F.size("spans") > 0))
        # A path that repeats may have been read more than once, with the same outcome, which a set holds once.
        return current.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ledger: str | None = None) -> DataFrame:
    """doc_id and spans (start, rank, kind, end) of every row; `ledger` is the path of a table kept between scans."""
    book = Ledger(docs.sparkSession, ledger)
    versions = docs.select(F.col(doc_id).alias("path"), F.col(text).alias("text"))
    paths = materialise(versions.select("path", blob_of(F.col("text")).alias("blob")), "blob-paths")
    book.scan(versions, "text", paths)
    found = paths.join(book.findings(), "blob", "left")
    return found.select(F.col("path").alias("doc_id"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with a mark in place of each stretch that spans (sorted) cover.

    Pieces are cut from an encoding of fixed width, where a place is found without counting characters from the text's start."""
    mark = F.unhex(F.lit("0000FEFF"))  # says how to read the four bytes that follow; it is no part of the text

    def pieces(x: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            return F.decode(F.concat(mark, F.substring(x["wide"], 4 * start + 1, F.greatest(4 * (end - start), F.lit(0)))), "UTF-32")

        def one(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(x["upto"], i - 1), F.lit(0))
            return F.when(s["start"] >= before, F.concat(cut(before, s["start"]), F.lit(MARK))).otherwise(F.lit(""))

        tail = cut(F.get(x["upto"], F.size(x["upto"]) - 1), F.length(text))
        return F.concat(F.array_join(F.transform(spans, one), ""), tail)

    held = F.struct(F.encode(text, "UTF-32").alias("wide"), running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)).alias("upto"))
    return F.when(F.size(spans) > 0, let(held, pieces)).otherwise(text)


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", ledger: str | None = None) -> DataFrame:
    """The documents, all columns kept, with secrets replaced by a mark and n_chars counted anew where it changes."""
    book = Ledger(docs.sparkSession, ledger)
    path, blob, spans = (fresh(docs, c) for c in ("mf_path", "mf_blob", "mf_spans"))
    versions = docs.select(blob_of(F.col(text)).alias("path"), F.col(text).alias("text"))  # a blob is its own path here
    paths = materialise(versions.select("path", F.col("path").alias("blob")).distinct(), "blob-paths")
    book.scan(versions, "text", paths)
    found = book.findings().select(F.col("blob").alias(path), F.col("spans").alias(spans))
    rows = docs.withColumn(blob, blob_of(F.col(text))).join(found, F.col(blob) == F.col(path), "left")
    marked = fresh(docs, "mf_marked")
    rows = rows.withColumn(marked, redacted(F.col(text), F.coalesce(spans, F.array().cast(SPANS))))
    out = {text: F.col(marked)}
    if n_chars and n_chars in docs.columns:
        out[n_chars] = F.when(F.size(spans) > 0, F.length(marked).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars))
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
