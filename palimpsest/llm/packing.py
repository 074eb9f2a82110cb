"""Packing along a space-filling curve: like documents become neighbours and share sequences."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .common import give_back, kept_by_worker, let_go, materialize, scratched, tasks_for, text_slices
from .words import WordIds

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
#: Buckets of a hashed document vector, and dimensions and bits of each of its projection.
BUCKETS, DIMS, BITS = 1 << 10, 3, 16
#: Pieces of words that the library gets at once: it takes some hundred bytes for each meanwhile.
PIECES = 1 << 13


#: Byte-level models see each byte as a character: printable ones as themselves, the others from 256 on, in order.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


#: What a tokenizer file must say for its texts to be taken word by word: characters are composed and lower-cased, white space parts words and is dropped,
#: letters, digits and other signs are parted too, and bytes are merged up to a mark of a word's end.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


class Encoder:
    """Ids of words by a tokenizer file: what is plain is handed to its model in one go, pieces parted by blanks; the rest goes the file's whole way."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.pieces = tokenizer, Tokenizer(tokenizer.model)
        self.pieces.pre_tokenizer = WhitespaceSplit()
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # of the ids that end a piece
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, text: str, special: bool) -> list[int]:
        self.tokenizer.encode_special_tokens = not special
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, in a row, and each word's count of ids. Capitals A-Z must be gone."""
        pieces, number, odd = [], np.ones(len(words), np.int64), []  # pieces of each word
        for i, word in enumerate(words):
            plain = word.isascii()
            if plain and word.isalpha():
                pieces.append(word)
                continue
            if word and (plain or max(word) <= "\xff"):
                word = word.lower()
                last = "" if word.isalpha() else word[-1]
                head = word[:-1] if last else word
                if not last or last in ".,;:!?|" and head.isalpha():
                    pieces.append(head if plain else head.encode().decode("latin-1").translate(_BYTES))
                    if last:
                        pieces.append(last)
                        number[i] = 2
                    continue
            number[i] = 0
            odd.append(i)
        parts = [np.array(self.pieces.encode_batch_fast([" ".join(pieces[k : k + PIECES])], add_special_tokens=False)[0].ids, np.int32) for k in range(0, len(pieces), PIECES)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        each = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(each) != len(pieces):  # a byte that the file doesn't know
            lists = [[t.id for t in self.pieces.model.tokenize(x)] for x in pieces]
            ids, each = np.array([k for x in lists for k in x], np.int32), np.fromiter(map(len, lists), np.int64, len(lists))
        lens = np.diff(np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(number)])])
        if not odd:
            return ids, lens
        self.tokenizer.encode_special_tokens = True  # what looks like a special token wasn't one before its capitals went
        others = [x.ids for x in self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)]
        lens[odd] = list(map(len, others))
        out, apart = np.empty(int(lens.sum()), np.int32), np.zeros(len(words), bool)
        apart[odd] = True
        apart = np.repeat(apart, lens)
        out[~apart], out[apart] = ids, [k for x in others for k in x]
        return out, lens


@kept_by_worker
def _loaded(tokenizer_file: str) -> tuple[Encoder, bool, list[tuple[str, bool]]]:
    """Of a tokenizer file, once in each worker: its encoder, whether it's of the kind BY_WORDS, and its added tokens, and which are special."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    own = {"normalizer": spec["normalizer"], "pre_tokenizer": spec["pre_tokenizer"], "model": {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}}
    by_words = own == BY_WORDS and not any(spec.get(k) for k in ("truncation", "padding"))
    loaded = Encoder(Tokenizer.from_file(tokenizer_file)), by_words, [(t["content"], t["special"]) for t in spec["added_tokens"]]
    del spec, own
    give_back()
    return loaded


class TextIds:
    """Ids of texts as the library gives them for the whole texts without adding special tokens. For one task: it holds distinct words.

    Word by word if the file is of the kind BY_WORDS and the text holds no special token; else the library gets the whole text. special: strings of special
    tokens in a text become these tokens, as the library does unless told otherwise; else they are ordinary text.
    """

    def __init__(self, tokenizer_file: str, special: bool = True):
        self.encoder, self.by_words, marks = _loaded(tokenizer_file)
        self.added, self.special = [m for m, is_special in marks if special or not is_special], special
        self.words = WordIds(self.encoder)

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, in a row, and each text's count of ids. Null texts have none."""
        texts = pc.fill_null(texts, "")
        odd = np.full(len(texts), not self.by_words)
        for mark in self.added:
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.words.of_texts(texts, lower=True)
        flat, lens = self.words.of_texts(pc.if_else(pa.array(odd), "", texts), lower=True)
        parts = np.split(flat, np.cumsum(lens)[:-1])
        for i in np.flatnonzero(odd):
            parts[i] = np.array(self.encoder.whole(texts[int(i)].as_py(), self.special), np.int32)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


@functools.lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((BUCKETS, DIMS))


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of whole-numbered points (rows) of `bits` bits a dimension; Skilling's transposition, all rows at once."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(n):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Each text's place on the curve: token counts hashed to BUCKETS, unit length, projected to DIMS, cut to a grid."""
    buckets = (flat.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(22)).astype(np.int64)
    ends, out = np.concatenate([[0], np.cumsum(lens)]), []
    for k in range(0, len(lens), 256):  # a few rows of BUCKETS counts at a time
        own = lens[k : k + 256]
        rows = np.repeat(np.arange(len(own)), own)
        counts = np.bincount(rows * BUCKETS + buckets[ends[k] : ends[k] + len(rows)], minlength=len(own) * BUCKETS).reshape(len(own), BUCKETS).astype(np.float64)
        counts /= np.maximum(np.sqrt(np.einsum("ij,ij->i", counts, counts))[:, None], 1.0)
        placed = np.clip((counts @ _projection()) / 8 + 0.5, 0, 1) * ((1 << BITS) - 1)
        out.append(placed.astype(np.int64))
    return hilbert_key(np.concatenate(out) if out else np.zeros((0, DIMS), np.int64))


def tokenize(df: DataFrame, tokenizer_file: str, end_id: int, id: str = "doc_id", text: str = "text", special: bool = True) -> DataFrame:
    """One row per row of df: the id column, curve_key long, n_tokens long, ids binary (little-endian unsigned 16-bit), the
    end id last; see TextIds. Null text: empty, the end id alone. Vocabularies of up to 65,536 ids."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = TextIds(tokenizer_file, special)
        for batch in text_slices(batches, "text"):
            flat, lens = words.of_texts(batch.column("text"))
            keys, ends = curve_keys(flat, lens), np.cumsum(lens)
            out = np.insert(flat, ends, end_id).astype("<u2").tobytes()
            stops = 2 * (ends + np.arange(1, len(lens) + 1))
            ids = [out[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.int64()), pa.array(lens + 1, pa.int64()), pa.array(ids, pa.binary())], ["id", "curve_key", "n_tokens", "ids"])
        del words
        give_back()

    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, curve_key long, n_tokens long, ids binary").withColumnRenamed("id", id)


def _packed(batches: Iterator[pa.RecordBatch], length: int, task: int) -> Iterator[list[tuple]]:
    """Pieces (id, start, ids, document's ids, sequence, offset), in lists. What is left at the end goes to sequences of
    powers of two, so nothing is padded."""
    open_, held, number = [], 0, task << 32
    for batch in batches:
        out = []
        for doc, total, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "n_tokens", "ids")), strict=True):
            ids, start = np.frombuffer(raw, "<u2"), 0
            while start < total:
                took = min(length - held, total - start)
                open_.append((doc, start, ids[start : start + took], total, number, held))
                held, start = held + took, start + took
                if held == length:
                    out += open_
                    open_, held, number = [], 0, number + 1
        yield out
    out, room, at = [], 1 << held.bit_length() >> 1, 0
    for doc, start, ids, total, _, _ in open_:
        done = 0
        while done < len(ids):
            took = min(room - at, len(ids) - done)
            out.append((doc, start + done, ids[done : done + took], total, number, at))
            done, at = done + took, at + took
            if at == room:
                held, at, number = held - room, 0, number + 1
                room = 1 << held.bit_length() >> 1
    yield out


def pack(tokens: DataFrame, length: int = 4096, id: str = "doc_id", parts: int = 12) -> DataFrame:
    """Pieces of documents in sequences of at most `length` tokens, a power of two.

    tokens: rows as tokenize() returns them, read twice (a table, not a plan to run again). Sorted by range of curve key, then id,
    so ties and copies are spread over tasks; each task fills its sequences one after the other. A sequence is full or, at the
    end of a task, as long as a power of two. Returns the id column, start, length, doc_tokens, sequence_id, offset (long),
    ids binary (little-endian unsigned 32-bit). Empty table: no rows. Each row of tokens is placed, equal ids too.
    """
    kind = tokens.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # no tokenizer here, nor in what comes after
        for rows in _packed(text_slices(batches, "ids"), length, TaskContext.get().partitionId()):
            doc, start, ids, total, number, at = zip(*rows, strict=True) if rows else ((),) * 6
            longs = [pa.array(x, pa.int64()) for x in (start, [len(x) for x in ids], total, number, at)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, batch_type), *longs, pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(tokens.schema[id].dataType)
    rows = tokens.withColumnRenamed(id, "id").repartitionByRange(parts, "curve_key", "id").sortWithinPartitions("curve_key", "id").select("id", "n_tokens", "ids")
    return rows.mapInArrow(run, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary").withColumnRenamed("id", id)


@scratched
def pack_documents(df: DataFrame, tokenizer_file: str, end_id: int = 2, length: int = 4096, id: str = "doc_id", text: str = "text", special: bool = True) -> DataFrame:
    """tokenize(), written to the scratch folder, then pack(); tasks by the measured number of tokens."""
    tokens = materialize(tokenize(df, tokenizer_file, end_id, id, text, special), "tokens")
    total = tokens.agg(F.sum("n_tokens")).first()[0]
    return pack(tokens, length, id, tasks_for(2 * int(total or 0), 8 << 20))
