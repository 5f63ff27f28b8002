"""Registered queries of this subpackage: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lurewatch.llm import bpe, langid, lines, mixing, neardup, phrases, quality, sharding, simhash, spelling, urlgraph, warc, winnow
from lurewatch.llm.common import string_of

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op6_quality_ledger(spark, sf):
    """Policies and the ablation of the strictest one, read from the stored ledger."""
    rows = quality.stored(table(spark, sf, "documents").select("doc_id", "text"))
    return quality.with_sole_rule(rows, "web-2").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes("base-1")).alias("base_failed"), quality.passes("web-2").alias("kept"),
        quality.passes("web-1").alias("kept_web_1"), "fail_bits", "sole_rule", "n_sole")


@query
def op7_line_dedup(spark, sf):
    rows = lines.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"), min_docs=10)
    return rows.select("_row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_simhash(spark, sf):
    rows = simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"), max_bits=2)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_source_mix(spark, sf):
    mix = mixing.Mix(mixing.sized(table(spark, sf, "documents")), weights=(5, 2, 1), share=1.5, max_repeat=2)
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken", "source", "n_pieces", "first_shard", "first_place")


@query
def op3_byte_bpe(spark, sf):
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.tokenized(table(spark, sf, "documents").select("doc_id", "text"), tokenizer, keep_text=False)
    return bpe.with_digests(rows).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op9_balanced_shards(spark, sf):
    rows = sharding.sharded(table(spark, sf, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = [urlgraph.Rule("allow", "com", "/"), urlgraph.Rule("block", "example.com", "/en/"),
             urlgraph.Rule("allow", "www.example.com", "/en/"), urlgraph.Rule("block", "net", "/es/"),
             urlgraph.Rule("block", "net", "/fr/")]


@query
def op10_url_graph(spark, sf):
    return urlgraph.filtered(table(spark, sf, "pages"), URL_RULES)


@query
def op2_warc_archive(spark, sf):
    manifest = warc.archive(table(spark, sf, "pages"))
    return warc.read_archives(manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op1_embedding_near_dup(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "embeddings"), threshold=0.93)


@query
def op4_language_by_compression(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.fold("doc_id") != 1))
    held_out = F.coalesce(langid.fold("doc_id") == 1, F.lit(False)).alias("held_out")
    return langid.identified(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score", "accepted")


@query
def op11_winnowing(spark, sf):
    rows = winnow.decontaminated(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"), window=10)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


@query
def op12_spelling_variants(spark, sf):
    rows = spelling.grouped_spellings(table(spark, sf, "documents"), min_length=6, min_count=5, ratio=5, typo_every=199)
    return rows.select("word", "form", "root", "n", "n_near", "form_n")


@query
def op13_collocations(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"), min_count=30, longest=4, top=2000, scale=2_000_000, inside=80)
