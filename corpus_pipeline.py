"""Cleaning of a document table into packed training sequences, as five stages.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read back as the next
stage's ``docs``, so a lost executor costs at most one stage's tasks. All but the last stage return the columns
of the documents.

* quality: lines that fail the line rules go; documents that fail the base rules or lose over half of
  their word characters go.
* near_dedup: of documents whose 5-word shingles agree to 80 percent, linked through others or not, the one
  with the smallest id stays.
* substring_dedup: words in passages of 35 or more words that occur elsewhere go.
* secrets: every secret span is replaced by ``[SECRET]``.
* packing: documents become pieces of at most 2048 token ids, placed in as few sequences as possible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from batchlens.llm import near_dedup, packing, quality, secrets, substring
from batchlens.llm.common import materialize, table
from batchlens.llm.tokens import vocabulary
from batchlens.session import ensure_checkpoint_dir

VOCABULARY = "byte_bpe_50k.json"
#: Pieces a worker remembers while it encodes: few, since its executor also serves the other stages.
MEMO = 150_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.cleaned(docs)


def near_dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return near_dedup.deduplicated(docs, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return substring.without_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return packing.pack_documents(docs, vocabulary(VOCABULARY), memo=MEMO)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup_documents),
    ("substring_dedup", substring_dedup),
    ("secrets", secret_scan),
    ("packing", best_fit_packing),
]

#: Near-duplicate components, automata and packing can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
