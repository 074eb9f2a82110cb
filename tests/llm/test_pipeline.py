"""The pipeline against a plain one: brute-force checks, classes, pseudonyms and tokens of every document that should be left."""

import os
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import private
from tests.llm.test_minhash_caps import classes, similarity_links

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of thing and tion her that with ing ness", "fr": "le de eau que ment une aux pour ç é"}


def documents():
    draw, rows = random.Random(4), []
    word = lambda lang: "".join(draw.choices(WORDS[lang].split(), k=draw.randint(1, 4)))
    for i in range(240):
        lang = draw.choice(["en", "fr"])
        words = [word(lang) for _ in range(draw.randint(30, 120))]
        if i % 7 == 0:
            words[5] = draw.choice(["+1 (017) 555-7713", "97.51.17.173", "a.12@mail.example.com"])
        rows.append((i, " ".join(words), lang, f"src{i % 4}"))
    for i in range(0, 60, 3):  # near and exact copies
        words = rows[i][1].split(" ")
        if i % 2:
            words[len(words) // 2] = "changed"
        rows.append((1000 + i, " ".join(words), rows[i][2], rows[i][3]))
    junk = [" ".join(["same words again"] * 40), " ".join(f"w{i}###$$$" for i in range(60)), "too short", "", None, " ".join(str(i * 7) for i in range(90))]
    rows += [(2000 + i, t, "en", "src0") for i, t in enumerate(junk)]
    rows += [(3000, rows[1][1], None, None), (None, rows[2][1], "en", "src1"), rows[3], rows[3]]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


def test_pipeline_equals_the_plain_way(spark, folder):
    rows = list(dict.fromkeys(r for r in documents() if not (r[0] or 0) // 2000 == 1))  # without the junk
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    texts = [r[1] for r in named]
    root = classes(range(len(texts)), similarity_links(texts, "log"))
    left = [r for i, r in enumerate(named) if root[i] == i] + [r for r in rows if r[0] is None]
    feistel, plain = private.Feistel(corpus_pipeline.PSEUDONYM_KEY), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {r[0]: [*plain.encode(private.replace(r[1], private.find(r[1], feistel)), add_special_tokens=False).ids, 2] for r in left}
    pieces = corpus_pipeline.run(spark, folder).collect()
    got, sequences = {}, {}
    for r in sorted(pieces, key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert got == want
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sequences.values())


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "personal_data", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, folder)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_other_columns_stay(spark, folder):
    extra = {"kept": 1, "language": "x", "point": 2.5, "key": None, "n_words": "w"}
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40")
    for k, v in extra.items():
        docs = docs.withColumn(k, F.lit(v).cast("string"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 0
        assert {tuple(r[k] for k in extra) for r in out.collect()} == {tuple(None if v is None else str(v) for v in extra.values())}


def test_pseudonyms_leave_no_number(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.personal_data(spark, docs, folder).collect()
    assert not any(x in (r.text or "") for r in out for x in ("555-7713", "97.51.17.173", "a.12@mail"))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)


def test_operators_leave_only_what_their_result_reads(spark, folder):
    from palimpsest.llm import extraction, minhash, quality, sharding
    from palimpsest.sources.scratch import scratch_dir

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pages = docs.selectExpr("doc_id page_id", "concat('http://', source, '/', doc_id) url", "concat('<p>', text) html")
    listed = lambda: set(os.listdir(scratch_dir(spark).removeprefix("file:")))
    for work in (lambda: quality.judge(docs), lambda: minhash.near_duplicates(docs), lambda: extraction.extract(pages), lambda: sharding.assign(docs.select("doc_id"), "doc_id", [1.0] * 3)):
        before = listed()
        out = work()
        read = {f.split("/")[-2] for f in out.inputFiles()}
        assert listed() - before <= read
        assert out.count() > 0


def test_threads_keep_their_tables(spark, folder):
    """Operators that run at the same time don't delete each other's scratch tables."""
    from concurrent.futures import ThreadPoolExecutor

    from palimpsest.llm import quality

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    with ThreadPoolExecutor(3) as pool:
        counts = list(pool.map(lambda k: quality.judge(docs.where(f"coalesce(doc_id, 0) % 3 = {k}")).count(), range(3)))
    assert sum(counts) == docs.count()
