"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing and tokenizing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows to the shared folder
as Parquet and reads them back for the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lurewatch.llm import bpe, lines, mixing, quality, simhash
from lurewatch.llm.common import materialize

POLICY = "web-2"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    return quality.apply_policy(docs, POLICY)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents stay in the first of them only; every document stays."""
    return lines.cleaned(docs, min_docs=10, keep="first")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints of three-word shingles link at two bits or fewer, the smallest id stays."""
    return simhash.representatives(docs, max_bits=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: one row per document and pass, with the taken words."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, max_repeat=2)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per row of the mix, with digests of the ids and of the bytes that they decode to."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.tokenized(docs.select("doc_id", "source", "lang", "text"), tokenizer, keep_text=False)
    return bpe.with_digests(rows).drop("decoded")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup),
          ("source mixing", mix_sources), ("byte BPE", tokenize)]

#: Near copies, permutations and tokens are beyond SQL; tests compare near-dedup with brute force, the other stages only by
#: their operators and by properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
