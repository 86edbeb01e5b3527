"""Quality rules judged per host and rule.

Documents that fail are counted by domain for each rule. Each rule has a beta prior, fitted to the rates of
all hosts; a host's rate is shrunk towards it, and a host fails a rule if even the lower bound of its
shrunk rate is HOST_TIMES the corpus's rate and HOST_LEAST. The verdicts go back to the documents: the base
rules hold for every document, and a soft rule holds for those of hosts that fail it, or that fail a base rule.

Defined results. A null or empty text has no words, so it fails the length rule. A null host gets
no host verdict. Repeated rows count as often as they appear. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import chunks, materialise, shipped, sized

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Limits of the soft rules.
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINES_PER_WORD = 0.05
WORD_LENGTHS = (2.0, 12.0)
#: A host fails a rule if its shrunk rate, less so many deviations, passes both: a share, and so many times the corpus's rate.
HOST_LEAST = 0.1
HOST_TIMES = 2.0
HOST_Z = 2.0

#: The rules, the base ones first; a document fails one where its condition holds (in SQL that Spark and others share).
BASE_RULES = {"length": f"n_words < {MIN_WORDS}", "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"}
SOFT_RULES = {
    "symbols": f"n_symbols > {MAX_SYMBOLS_PER_WORD}D * n_words",
    "dup_lines": f"n_dup_lines > {MAX_DUP_LINES_PER_WORD}D * n_words",
    "word_width": f"NOT (CAST(word_chars AS DOUBLE) / greatest(n_words, 1) BETWEEN {WORD_LENGTHS[0]}D AND {WORD_LENGTHS[1]}D)",
}
RULES = BASE_RULES | SOFT_RULES

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text; words end at ASCII white space."""
    words = text.split()
    solid = text.translate(None, _SPACE)
    chars = len(solid) - len(solid.translate(None, bytes(range(0x80)) + bytes(range(0xC0, 0x100))))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeated = 0
    if len(words) > 3:
        grams = list(zip(words, words[1:], words[2:]))
        counts = Counter(grams)
        if len(counts) < len(grams):
            end = 0  # words before this are counted
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return len(words), chars, symbols, dup, repeated


def _stats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for part, texts in chunks(batches, "text"):
        rows = list(zip(*map(text_stats, texts)))
        kept = part.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(r, pa.int64()) for r in rows)], names=[*kept.schema.names, *names])


def with_stats(docs: DataFrame, text: str, keys: list[Column]) -> DataFrame:
    """The key columns and the text's counts, one row a document; no shuffle."""
    df = docs.select(*keys, F.col(text).cast("binary").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    return df.transform(shipped).mapInArrow(_stats, f"{schema}, {STATS}")


def host_of(source: Column) -> Column:
    """The domain of a source: what stands between a scheme and the first slash or port, in lower case."""
    return F.lower(F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/:?#]*)", 1))


def host_verdicts(judged: DataFrame) -> DataFrame:
    """host and failed_rules of every host, from documents with their host and a flag `fails_<rule>` of each rule."""
    hosts = judged.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(f"k_{r}") for r in RULES))
    rate = lambda r: F.col(f"k_{r}") / F.col("n")
    # One row: what the moments of each rule's prior need.
    fit = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), *(F.sum(f"k_{r}").alias(f"k_{r}") for r in RULES), *(F.sum(F.col("n") * rate(r) * rate(r)).alias(f"q_{r}") for r in RULES)).first()
    failed = []
    for r in RULES:
        n, k = fit["n"] or 0, fit[f"k_{r}"] or 0
        a, b = beta_prior(n, k, fit[f"q_{r}"] or 0.0, fit["hosts"])
        total = F.col("n") + (a + b)
        mean = (F.col(f"k_{r}") + a) / total
        bound = mean - HOST_Z * F.sqrt(mean * (1 - mean) / (total + 1))
        failed.append(F.when(bound > max(HOST_LEAST, HOST_TIMES * k / max(n, 1)), F.lit(r)))
    return hosts.select("host", F.array_compact(F.array(*failed)).alias("failed_rules"))


def host_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, host, the counts, base_failed, failed_rules (of the host) and kept, one row a document."""
    stats = materialise(with_stats(docs, text, [F.col(doc_id).alias("doc_id"), host_of(F.col(source)).alias("host")]), "quality-stats")
    judged = stats.withColumns({f"fails_{r}": F.expr(c) for r, c in RULES.items()})
    out = judged.join(sized(materialise(host_verdicts(judged), "host-verdicts")), "host", "left").withColumn("failed_rules", F.coalesce("failed_rules", F.array().cast("array<string>")))
    base = reduce(lambda x, y: x | y, (F.col(f"fails_{r}") for r in BASE_RULES))
    strict = F.arrays_overlap("failed_rules", F.array(*map(F.lit, BASE_RULES)))
    soft = reduce(lambda x, y: x | y, (F.col(f"fails_{r}") & (strict | F.array_contains("failed_rules", r)) for r in SOFT_RULES))
    return out.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "failed_rules", (~base & ~soft).alias("kept"))


def beta_prior(n: int, k: int, q: float, hosts: int) -> tuple[float, float]:
    """Alpha and beta by the method of moments from counts, failures and the weighted square of the rates."""
    if not n:
        return 1.0, 1.0
    mean = (k + 0.5) / (n + 1)
    spread = max(q / n - (k / n) ** 2, 0.0)
    within = mean * (1 - mean) * hosts / n  # what sampling alone would give
    between = max(spread - within, 1e-4 * mean * (1 - mean))
    size = min(max(mean * (1 - mean) / between - 1, 2.0), 1e4)
    return mean * size, (1 - mean) * size
