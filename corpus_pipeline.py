"""A training corpus from `documents`, stage by stage.

Language ID drops what is in no learned language; SimHash keeps one row of each group of
near-duplicates (five-word shingles, similarity 0.8); decontamination drops documents that
hold a benchmark passage; the secret scan replaces secrets in the texts; BPE encodes what is
left.  Each stage reads what its predecessor wrote.

Null, empty and letterless texts go in the first stage, so later ones meet them only when they
are run by themselves; null and repeated ids, repeated rows, empty tables and extra columns are
carried as the operators say.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recollect.llm import bpe, decontaminate, language, secret_scan, simhash
from recollect.llm._spark import checkpoint_dir, remove, table

SHINGLE_WORDS, SIMILARITY = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs, SHINGLE_WORDS, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests, and the tokens themselves as `ids`."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]
#: SQL expresses neither the kernels, the hashes, the network nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again; only the last stage's table stays."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        written = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before:
            remove(spark, before)
        before = written
    return docs
