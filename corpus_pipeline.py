"""The training-data pipeline: documents in, packed sequences out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common, language, minhash, packing, private, quality
from palimpsest.llm.catalog import PSEUDONYM_KEY


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _keep_others(stage: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """stage(docs) with the columns of docs. Columns besides those of documents are out of the operator's way meanwhile, so names of
    its results don't meet theirs."""
    away = {c: f"__other{i}" for i, c in enumerate(docs.columns) if c not in OWN}
    out = stage(docs.withColumnsRenamed(away))
    return out.withColumnsRenamed({v: k for k, v in away.items()}).select(*docs.columns) if away else out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and lie within the fences of their language and source.

    Null and empty texts have no words and go. Null languages and sources are groups of their own. A document at a fence stays. Repeated rows
    are judged alike. Empty table: no rows. Other columns stay, whatever their names.
    """
    return _keep_others(lambda d: quality.judge(d).where("kept").select(*d.columns), docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the declared one stays in `lang` as it is.

    Null texts and texts without a letter go. Null languages and sources are no evidence. At a tie the language that sorts first counts. Repeated
    rows fare alike. Empty table, or no declared language anywhere: no rows. Other columns stay, whatever their names.
    """
    return _keep_others(lambda d: language.identify(d, suffix=language.suffix_of("source"), keep_text=True).where("kept").select(*d.columns), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id.

    Rows that repeat a doc_id are one document; of those with the same text one stays. Documents without a doc_id, with null texts or without a word
    are in no class and stay. Empty table: no rows. Other columns stay, whatever their names and types. Ids are broadcast if they
    were counted to be few, else joined by a shuffle.
    """
    classes = minhash.near_duplicates(docs)
    gone = common.materialize(classes.where("not kept").select("doc_id").distinct(), "gone")
    again = common.materialize(classes.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    stay = docs.join(common.few(gone), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return stay
    again = common.few(again)
    once = stay.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return stay.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in the place of personal data; n_chars is that of the new text.

    Null texts stay null, with n_chars null; empty ones stay. Equal values get equal pseudonyms in all rows, repeated ones too. Empty table: no
    rows. Other columns stay, whatever their names.
    """
    count = F.length("text").cast("long").alias("n_chars")
    return _keep_others(lambda d: private.pseudonymize(d, PSEUDONYM_KEY, spans=None).withColumn("n_chars", count), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, with their ids.

    Null and empty texts are the end id alone. Documents with the same place on the curve are ordered by doc_id; rows that repeat one, or have none, are placed
    one by one. Empty table: no rows. Other columns aren't read.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packed)]

#: SQL can't express language identification, DartMinHash, Feistel pseudonyms and tokenizing; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written and read again, and goes, with what it was made from, once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with common.scratch_scope() as made:
            docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        before = common.release(spark, [*before, *made], docs)
    return STAGES[-1][1](spark, docs, sf_dir)
