"""The corpus pipeline: documents to packed training sequences.

Toxic documents go, one document of each group of near copies stays, passages that repeat earlier ones
are cut, secrets are masked, and what is left is packed. Every stage takes the documents that its
predecessor kept; all but the last return the columns of ``documents``. An empty table stays empty, further
columns are passed on whatever their names, and texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, packing, secrets, substrings, toxicity
from tidemark.llm.common import Scratch, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.3 or more. Null and empty texts are scored like any other;
    repeated rows share their fate; labels of the held-out fold are not learned from."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies. Null and wordless texts are in no group and stay, as do
    rows with a null id; of rows that repeat an id one stays, that with the longest text (then the greatest)."""
    return jaccard.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every word that a window of 20 words covers which also starts earlier. What loses words becomes its kept
    words joined by a space, maybe an empty text; other texts, nulls and rows with a null id stay as they are."""
    return substrings.dedup(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret, base and novel; overlapping ones as one. Nulls and empty texts stay as they are."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents, null texts as empty ones: a row a piece with its sequence and offset."""
    return packing.pack(docs, partial(public_tokenizers.path, "byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("jaccard_join", distinct),
    ("substring_dedup", without_repeats),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]
#: Trees, tokenizers and compressors are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
