"""Language ID by language-bitmask n-gram filters.

One Bloom filter holds the n-grams of all languages, bit-sliced: a slot is a mask with a bit for each
language, and the AND of an n-gram's slots names every language that may contain it. A text's n-grams
are counted per language; the counts are corrected for the filter's false positives of that language,
and the largest corrected count decides.

N-grams are four bytes of UTF-8 inside a lower-cased word with one space at either side. A language
contains an n-gram that makes up LEAST_SHARE of its n-grams, whatever others contain.

The filter is fitted on a hash sample of about SAMPLE_DOCS labelled documents of each language (fewer
if there are fewer), and has at most 1 / LEAST_SHARE n-grams of a language: its size depends on the number
of languages, not on the corpus. There may be any number of languages; the driver and each worker hold the
filter, a bit a slot and language, and n-grams reach the driver 64 languages at a time.

Defined results. Null texts and texts without letters are `und` with score 0; so is everything if no
document is labelled. A text with letters but without a known n-gram gets the language with most labelled
documents, with score 0. Ties go to the language that sorts first. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import chunks, fresh, held_out, materialise, mix64, shipped, trainable

SAMPLE_DOCS = 2000
LEAST_SHARE = 1e-4
SLOTS_PER_GRAM = 16
HASHES = 3
#: Bytes of text looked at in one go; their n-grams and slots take about a hundred times as many.
CHUNK = 1 << 18
#: Languages whose n-grams are collected at once: as many as a mask word has bits.
WORD_BITS = 64
UNKNOWN = "und"

_SPACE = 0x20
# Letters in lower case, bytes of longer characters as they are, all else a space.
_NORMAL = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else _SPACE for b in range(256)], np.uint8)


def normal_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array with a space around each, and the place where each begins (one more for the end)."""
    data = _NORMAL[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    # Latin letters of two bytes: 0xC3 with 0x80-0x9E but for the multiplication sign is upper case.
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[after]
    upper = after[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
    data[upper] += 0x20
    return data, starts


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (four bytes as an integer) that don't reach across a space, and where they begin."""
    wide = data.astype(np.uint32)
    if len(wide) < 4:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    g = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    space = data == _SPACE
    at = np.flatnonzero(~(space[1:-2] | space[2:-1]))
    return g[at], at


@dataclass
class BitmaskFilter:
    languages: list[str]
    masks: np.ndarray  # (words, slots)
    false_rates: np.ndarray  # of each language
    own_rates: np.ndarray  # the share of a language's n-grams that the filter has for it
    usual: int = 0  # the language with most labelled documents

    @classmethod
    def build(cls, languages: list[str], gram: np.ndarray, language: np.ndarray, own_rates: np.ndarray) -> "BitmaskFilter":
        """gram and language are parallel: the language (its number) contains the n-gram. own_rates: a share for each language."""
        width = next((w for w in (8, 16, 32, 64) if len(languages) <= w), 64)
        words = max(1, -(-len(languages) // 64))
        slots = 1 << max(10, math.ceil(math.log2(max(1, len(np.unique(gram))) * SLOTS_PER_GRAM)))
        masks = np.zeros((words, slots), f"uint{width}")
        at = cls.places(gram, slots)
        for i in range(len(languages)):
            mine, bit = language == i, np.array(1 << (i % 64), masks.dtype)
            for p in at:
                masks[i // 64, p[mine]] |= bit
        fill = np.array([np.count_nonzero(masks[i // 64] >> np.array(i % 64, masks.dtype) & np.array(1, masks.dtype)) / slots for i in range(len(languages))])
        return cls(languages, masks, np.prod([fill] * HASHES, axis=0), np.maximum(own_rates, 1e-3))

    @staticmethod
    def places(gram: np.ndarray, slots: int) -> list[np.ndarray]:
        h = mix64(gram.astype(np.uint64))
        step, last = (h >> np.uint64(32)) | np.uint64(1), np.uint64(slots - 1)
        return [((h + np.uint64(k) * step) & last).astype(np.int64) for k in range(HASHES)]

    def containing(self, gram: np.ndarray) -> np.ndarray:
        """Masks (words, n) of the languages that may contain each n-gram."""
        at = self.places(gram, self.masks.shape[1])
        found = self.masks[:, at[0]]
        for p in at[1:]:
            found &= self.masks[:, p]
        return found

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and for each language how many it seems to have of them, by the corrected count."""
        data, starts = normal_bytes(texts)
        g, at = grams(data)
        edges = np.searchsorted(at, starts)
        total = np.diff(edges)
        found = self.containing(g)
        out = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bits = (found[i // 64] >> np.array(i % 64, found.dtype)) & np.array(1, found.dtype)
            run = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
            false = self.false_rates[i]
            out[:, i] = np.maximum((np.diff(run[edges]) - total * false) / (1 - false), 0) / self.own_rates[i]
        return total, out

    def decide(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The language of each text, or the number of languages where it is unknown, and the score."""
        best, score = np.full(len(texts), len(self.languages)), np.zeros(len(texts))
        if self.languages:
            _, counts = self.counts(texts)
            two = -np.sort(-counts, axis=1)[:, :2]
            first, second = two[:, 0], two[:, 1] if two.shape[1] > 1 else 0.0
            score = np.where(first > 0, first / np.maximum(first + second, 1e-12), 0.0)
            letters = np.array([has_letter(t) for t in texts])
            best = np.where(letters, np.where(first > 0, counts.argmax(axis=1), self.usual), len(self.languages))
            score = np.where(letters, score, 0.0)
        return best, score


def has_letter(text: bytes) -> bool:
    if text.isascii():
        return any(65 <= b <= 90 or 97 <= b <= 122 for b in text)
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches, "text", CHUNK):
        langs = part.column("language").to_pylist()
        for i in set(langs):
            g, _ = grams(normal_bytes([t for t, k in zip(texts, langs) if k == i])[0])
            gram, n = np.unique(g, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), i), pa.int32()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["language", "gram", "n"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> BitmaskFilter:
    """A filter from rows with text and lang; `order` is what the hash sample goes by (the text if not given)."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(text).cast("binary").alias("text"), F.col(lang).alias("lang"), F.xxhash64(order if order is not None else F.col(text)).alias("h"))
    # The counts read no texts, so null ones count here; they are left out of the sample.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return BitmaskFilter([], np.zeros((1, 1024), np.uint8), np.zeros(0), np.zeros(0))
    table = rows.sparkSession.createDataFrame([(k, i, min(1.0, sample_docs / sizes[k])) for i, k in enumerate(languages)], "lang string, language int, share double")
    sample = rows.join(F.broadcast(table), "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000).where("text is not null").select("language", "text")
    counts = sample.transform(shipped).mapInArrow(_count_grams, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), "language").where(F.col("n") >= F.greatest(F.lit(2), F.col("total") * LEAST_SHARE))
    held = kept.select("language", "gram", "n", "total")
    if len(languages) > WORD_BITS:  # read more than once
        held = materialise(held, "language-grams")
    parts = [held.where(F.col("language").between(low, low + WORD_BITS - 1)).toPandas() for low in range(0, len(languages), WORD_BITS)]
    own = {int(i): int(p["n"].sum()) / int(p["total"].iloc[0]) for part in parts for i, p in part.groupby("language")}
    gram, language = (np.concatenate([p[c].to_numpy(kind) for p in parts]) for c, kind in (("gram", np.uint32), ("language", np.int64)))
    model = BitmaskFilter.build(languages, gram, language, np.array([own.get(i, 0.0) for i in range(len(languages))]))
    model.usual = max(range(len(languages)), key=lambda i: sizes[languages[i]])
    return model


def predict(docs: DataFrame, model: BitmaskFilter, keys: list[Column], text: str = "text") -> DataFrame:
    """The key columns, lang_pred and score (the winner's share of the two best corrected counts)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see LEAST_SHARE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for part, texts in chunks(batches, "text", CHUNK):
            best, score = m.decide(texts)
            kept = part.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], names=[*kept.schema.names, "lang_pred", "score"])

    df = docs.select(*keys, F.col(text).cast("binary").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    return df.transform(shipped).mapInArrow(run, f"{schema}, lang_pred string, score double")


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, all columns kept, without those that `predict` calls unknown; if none is labelled, without those that have no letters."""
    model = fit(docs.where(trainable(F.col(doc_id))), text, lang, order=F.col(doc_id))
    shared, raw = docs.sparkSession.sparkContext.broadcast(model), fresh(docs, "text_bytes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, texts in chunks(batches, raw, CHUNK):
            known = m.decide(texts)[0] < len(m.languages) if m.languages else np.array([has_letter(t) for t in texts])
            yield part.filter(pa.array(known)).drop_columns([raw])

    return docs.withColumn(raw, F.col(text).cast("binary")).transform(shipped).mapInArrow(run, docs.schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, the filter fitted on those not held out."""
    model = fit(docs.where(trainable(F.col("doc_id"))), order=F.col("doc_id"))
    return predict(docs, model, [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])
