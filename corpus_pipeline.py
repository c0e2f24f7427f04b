"""From raw documents to packed training sequences, in five stages.

Every stage reads all that its predecessor kept, as Parquet. The first four return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stockloom.llm import decontam, jaccard, langid, packing, secrets
from stockloom.llm.queries import TOKENIZER, fold, table
from stockloom.llm.storage import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language cannot be told: null ones and those without letters."""
    return langid.keep_identified(docs, langid.fit(docs.where(fold() != 2)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by a Jaccard similarity of 0.8 on 5-word shingles."""
    return jaccard.keep_one(docs, words=5, similarity=(80, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with ten words in a row of a benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind; every document stays."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of every document, a null text as an empty one, into sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), 2048)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Kernel regression, similarity components and tokenization have no SQL; tests compare run() with
#: a direct computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each result is written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir))
    return docs
