"""The corpus pipeline: documents in, encoded documents out.

Quality rules, SimHash near-dedup, benchmark decontamination, secret scan, BPE.
Each stage takes what its predecessor kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, decontamination, quality_rules, secret_scan, simhash
from lectern.llm._common import discard, stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies: five-word shingles, similarity 0.8 or more."""
    return simhash.near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with its id, language and source."""
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scan", redact_secrets),
    ("bpe encoding", encode),
]

#: Learned rules, fingerprints and BPE are beyond SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written once, and deleted when the next one is."""
    docs, held = table(spark, sf_dir, "documents"), None
    for k, (_, stage_of) in enumerate(STAGES):
        docs = stage_of(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = docs if hasattr(docs, "staged_at") else stage(docs, "stage")
            if held is not None:
                discard(held)
            held = docs
    return docs
