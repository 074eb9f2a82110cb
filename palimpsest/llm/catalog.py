"""Queries opN_* and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caps, extraction, language, minhash, packing, private, quality, scoring, sharding, tokens

#: Equal shards of production, and as many and one.
SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Key of the pseudonyms; a deployment passes its own secret.
PSEUDONYM_KEY = b"palimpsest-example-key"


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.assign(rows, "doc_id", [1.0] * SHARDS, grown=[1.0] * (SHARDS + 1), tie=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = quality.judge(docs, carry_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "removed")


def op5_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = private.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), "pii")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language.identify(docs, suffix=language.suffix_of("source")).select("doc_id", "lang", "source", "language", "confidence", "text_language", "kept")


def op7_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return scoring.score(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, held)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank_file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = tokens.encode(_table(spark, sf_dir, "documents"), rank_file, public_tokenizers.PATTERN)
    out = tokens.decode(out, rank_file, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over the main text of pages, with their markup's language, host and address suffix: a row for each page.

    Null or empty html has no text and is `und`. A markup without a language, a url without a host or suffix are no evidence. Null and repeated page_ids
    stay as they are. Ties: the language that sorts first. Empty table: no rows.
    """
    return pages_language(_table(spark, sf_dir, "pages"))


def pages_language(pages: DataFrame) -> DataFrame:
    markup = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    rows = pages.select(F.struct("page_id", F.when(markup != "", markup).alias("markup")).alias("page"), "url", "html")  # what goes along with a page's text
    texts = extraction.extract(rows, id="page").select("page.page_id", "page.markup", "text", F.when(F.col("host") != "", F.col("host")).alias("host"))
    out = language.identify(texts, declared="markup", host="host", suffix=language.suffix_of("host"))
    return out.select("page_id", "host", "markup", "language", "confidence", "text_language", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_sharding, op3_quality, op4_extraction, op5_private, op6_language, op7_attention, op8_byte_bpe, op9_caps, op10_packing, language_of_pages)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {"op1_minhash": oracles.minhash(), "op2_sharding": oracles.sharding(SHARDS), "op3_quality": oracles.quality(), "op9_caps": oracles.caps()}
