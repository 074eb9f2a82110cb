"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratched, text_slices, texts_of

#: Longer texts are split before they are encoded.
PIECE_CHARS = 1 << 16
#: Between a character that isn't white space and a blank before a letter no pattern of the GPT-2 kind has a match
#: that reaches across: the match before ends there, the match after begins with the blank. Nothing looks further.
SAFE_BOUNDARY = regex.compile(r"(?<=\S)(?= \p{L})")


@functools.lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, without special tokens; one for each worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in parts of about `size` characters, cut at safe boundaries only; without one it stays whole."""
    start = 0
    while len(text) - start > size:
        found = SAFE_BOUNDARY.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a whole text."""
    parts = [encoding.encode_ordinary(p) for p in pieces(text)]
    return np.array(parts[0] if len(parts) == 1 else [i for p in parts for i in p], dtype="<u4")


@scratched
def encode(df: DataFrame, rank_file: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the id column, n_tokens long, ids binary (little-endian unsigned 32-bit).

    Null and empty texts: no ids (empty binary, n_tokens 0). Long texts are split at safe boundaries, so ids are
    those of the whole text. Repeated rows and null ids stay as they are; further columns of df are not read.
    An empty table gives no rows. rank_file must be readable at the same path by every worker.
    """
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(rank_file, pattern)
        for batch in text_slices(batches, "text"):
            ids = [encode_text(encoding, t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["id", "n_tokens", "ids"])

    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id)


@scratched
def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with a binary column `to`: the bytes that the ids (binary as encode() returns) stand for.

    Raw bytes, since a cut sequence of ids need not be valid UTF-8. Null ids give null, empty ids empty bytes.
    A column named `to` is replaced. Ids outside the rank file raise an error.
    """
    kept = [c for c in df.columns if c != to]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != to) + f", `{to}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(rank_file, pattern)
        for batch in text_slices(batches, ids):
            out = [None if x is None else encoding.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], [*kept, to])

    return df.mapInArrow(run, schema)
