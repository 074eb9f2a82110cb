"""What the Python workers of the pipeline's stages hold, in this process instead of a worker."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from palimpsest.llm import language, packing


def worker_code(df, make, monkeypatch):
    """The function that make(df) hands to Spark for the workers."""
    found = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: found.append(run) or self)
    make(df)
    return found[-1]


def test_language_looks_at_little_text_at_a_time(spark, monkeypatch):
    df = spark.createDataFrame([], "doc_id long, text string")
    run = worker_code(df, lambda d: language.score_text(d, "text", np.zeros((language.BUCKETS, 3), np.float32)), monkeypatch)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(["abc defg " * 1100] * 400)], ["doc_id", "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 400 and most < 48 << 20


def test_packing_lets_go_of_the_tokenizer(spark, monkeypatch):
    packing._loaded(public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame([], "doc_id long, curve_key long, n_tokens long, ids binary")
    run = worker_code(df, lambda d: packing.pack(d, 8), monkeypatch)
    monkeypatch.setattr(packing, "TaskContext", type("Context", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0)}))
    ids = [np.arange(n, dtype="<u2").tobytes() for n in (5, 9)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([5, 9], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])
    pieces = pa.Table.from_batches(run(iter([batch])))
    assert sum(pieces.column("length").to_pylist()) == 14 and packing._loaded.cache_info().currsize == 0


def test_pieces_in_parts_give_the_same_ids(monkeypatch):
    encoder = packing._loaded(public_tokenizers.path("word_bpe_49k.json"))[0]
    words = [f"{a}{b}" for a in ("reading", "x", "café", "9", "don't") for b in ("", "s.", ",", "zq")]
    whole = [x.tolist() for x in encoder(words)]
    monkeypatch.setattr(packing, "PIECES", 3)
    assert [x.tolist() for x in encoder(words)] == whole and encoder([])[0].tolist() == []
