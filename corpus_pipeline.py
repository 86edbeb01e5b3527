"""The corpus pipeline: language ID, near-dedup, decontamination, secret scans, packing.

Each stage takes the documents that its predecessor kept and returns them with the columns of
`documents`; the last one returns the packed pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from maskframe.llm import op1_language_id, op4_decontamination, op5_secret_scans, op7_packing, op10_simhash
from maskframe.operators.scratch import drop, materialise, scope

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters go, null and empty texts among them.

    All rows of a repeated document stay or go together. An empty table stays empty."""
    return op1_language_id.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies; of rows that repeat an id one stays.

    Null and blank texts are one class. Rows without an id stay only where their class has no id at all.
    An empty table stays empty."""
    return op10_simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item; null texts have none.

    Rows with equal texts stay or go together. Without benchmark rows all documents stay."""
    return op4_decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; null texts stay null, equal texts are marked alike.

    Where the session names a folder as spark.maskframe.secretLedger, blobs scanned in earlier runs under the
    same rules are not scanned again; without one the ledger lasts for the run."""
    return op5_secret_scans.redact(docs, ledger=spark.conf.get("spark.maskframe.secretLedger", None))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; a null or empty text is one piece, its end token.

    Repeated rows are packed as often as they appear. An empty table gives no pieces."""
    return op7_packing.best_fit_packing(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact_secrets", redact_secrets), ("pack", pack)]

#: Packing and SimHash can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written to the shared folder and read again by the next.

    What a stage wrote besides its result is dropped, and its input once it is done."""
    docs, source = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scope() as scratch:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        drop([*source, *scratch[:-1]])
        source = scratch[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
