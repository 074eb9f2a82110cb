"""Scoring texts by a causal self-attention model and by smoothed word counts, both learnt from the training rows."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .attention import BY_COUNTS, DENSE, END, RARE, RARE_FIRST
from .common import give_back, materialize, scratched, text_slices
from .words import WordIds, distinct_words

#: Bytes of text in a block; one block in so many is fitted first, for the weights from which all blocks start; part of the rate then.
BLOCK_BYTES, BEGIN_ONE_IN, THEN = 8 << 20, 256, 1 / 3
#: Parts of one in sums of weights: whole numbers add up to the same in any order.
PARTS = 1 << 24
RAW_IDS = 1 << 16


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Words that are encoded at a time: their ids are Python numbers meanwhile.
PIECES = 1 << 14

#: White space but a blank: words may hold some, since they're parted by six ASCII characters alone.
ODD_SPACE = re.compile(r"[^\S ]")


class Subwords:
    """Subword ids of words, each with a blank before it. Words without white space are encoded together: no match of a pattern of the GPT-2 kind reaches
    across a blank between other characters, so the ids of each are those that it has alone."""

    def __init__(self, rank_file: str, pattern: str):
        ranks = _ranks(rank_file)
        self.encode = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes[list(ranks.values())] = list(map(len, ranks))

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(words) > PIECES:
            ids, lens = zip(*(self(words[k : k + PIECES]) for k in range(0, len(words), PIECES)), strict=True)
            return np.concatenate(ids), np.concatenate(lens)
        text = " " + " ".join(words)
        if not ODD_SPACE.search(text):
            ids = np.array(self.encode(text), np.int32)
            ends = np.cumsum(self.bytes[ids])
            stops = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            last = np.minimum(np.searchsorted(ends, stops), len(ends) - 1)
            if (ends[last] == stops).all():
                return ids, np.diff(last + 1, prepend=0)
        elif len(words) > 1:
            odd = [i for i, w in enumerate(words) if ODD_SPACE.search(w)]
            lists: list = [None] * len(words)
            plain = sorted({*range(len(words))} - {*odd})
            if plain:
                ids, lens = self([words[i] for i in plain])
                for i, x in zip(plain, np.split(ids, np.cumsum(lens)[:-1]), strict=True):
                    lists[i] = x
            for i in odd:
                lists[i] = self.encode(" " + words[i])
            return np.concatenate(lists).astype(np.int32), np.fromiter(map(len, lists), np.int64, len(lists))
        each = [self.encode(" " + w) for w in words]
        return np.array([i for x in each for i in x], np.int32), np.fromiter(map(len, each), np.int64, len(each))


def _subwords(rank_file: str, pattern: str) -> WordIds:
    return WordIds(Subwords(rank_file, pattern), 300_000)  # encoding is cheap, and a block takes memory of its own


BLOCK_SCHEMA = "block long, held array<boolean>, counts array<int>, numbers binary, words binary, n_train binary, sub binary, sub_lens binary, raw_ids array<int>, raw_n array<long>, train_tokens long, train_docs long"


def blocks(rows: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Texts by the block of about BLOCK_BYTES: a dictionary of the block's words (their 64-bit hashes) with their subword ids and training counts, and each
    text as numbers of words. Subwords of a text: those of each word with a blank before it."""
    kind = rows.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = pa.list_(to_arrow_type(rows.schema["id"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, serial = _subwords(rank_file, pattern), TaskContext.get().partitionId() << 32
        for batch in text_slices(batches, "text", BLOCK_BYTES, 1 << 20):
            words, numbers, counts = distinct_words(batch.column("text"), lower=True)
            often = np.bincount(numbers, minlength=len(words))
            order = np.argsort(-often, kind="stable")[: int((often > 0).sum())]
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(order))
            words, numbers = [words[i] for i in order.tolist()], rank[numbers]
            held = batch.column("held").to_numpy(zero_copy_only=False)
            train = np.bincount(numbers[~np.repeat(held, counts)], minlength=len(words))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "<u8", len(words))
            flat, lens = known.ids(known.numbers(words))
            raw = np.bincount(flat, np.repeat(train, lens), RAW_IDS).astype(np.int64)
            there = np.flatnonzero(raw)
            one = lambda x, t: pa.array([x], t)
            longs, n_docs = pa.list_(pa.int64()), int((~held).sum())
            yield pa.RecordBatch.from_arrays(
                [
                    one(serial, pa.int64()), one(held, pa.list_(pa.bool_())), one(counts.astype(np.int32), pa.list_(pa.int32())), one(_pack(numbers), pa.binary()), one(hashes.tobytes(), pa.binary()),
                    one(_pack(train.astype("<i8")), pa.binary()), one(_pack(flat.astype(np.uint16)), pa.binary()), one(_pack(lens.astype(np.uint32)), pa.binary()), one(there.astype(np.int32), pa.list_(pa.int32())), one(raw[there], longs),
                    one(int(train.sum()) + n_docs, pa.int64()), one(n_docs, pa.int64()), one(batch.column("id").to_pylist(), id_type),
                ],
                [*(x.split()[0] for x in BLOCK_SCHEMA.split(", ")), "ids"],
            )
            serial += 1
            del words, numbers, counts, often, order, rank, train, hashes, flat, lens, raw, there  # before the next block's

    return rows.mapInArrow(run, f"{BLOCK_SCHEMA}, ids array<{kind}>")


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: word numbers in a row, words of each text, raw subword ids in a row, raw ids of each text."""
    numbers, counts = _unpack(row["numbers"], "<i4"), np.array(row["counts"], np.int64)
    flat, lens = _unpack(row["sub"], "<u2"), _unpack(row["sub_lens"], "<u4").astype(np.int64)
    starts, own = (np.cumsum(lens) - lens).astype(np.int32), lens[numbers]
    ends = np.cumsum(own)
    if int(own.sum()) < 1 << 31 and len(flat) < 1 << 31:  # the usual block: half the memory
        raw = flat[np.repeat(starts[numbers] - (ends - own).astype(np.int32), own) + np.arange(int(own.sum()), dtype=np.int32)].astype(np.int64)
    else:
        raw = flat[np.repeat(starts[numbers].astype(np.int64) - ends + own, own) + np.arange(int(own.sum()))].astype(np.int64)
    return numbers, counts, raw, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])


def dense_ids(often: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From counts of raw ids and whether each begins a word: ids of the model, log shares among raw ids of one id, whether an id begins a word."""
    top = np.argsort(-often, kind="stable")[: DENSE - 3]
    dense = np.where(first, RARE_FIRST, RARE)
    dense[top] = np.arange(len(top))
    rare = np.zeros(len(often))
    for shared in (RARE, RARE_FIRST):
        own = dense == shared
        rare[own] = np.log((often[own] + 0.5) / (often[own] + 0.5).sum())
    begins = np.zeros(DENSE, bool)
    begins[: len(top)] = first[top]
    begins[[RARE_FIRST, END]] = True
    return dense, rare, begins


def _training_line(row: dict, dense: np.ndarray) -> np.ndarray:
    """Ids of the model of a block's training texts, in a row, with an end before and after each."""
    _, _, ids, lens = _texts(row)
    train = ~np.array(row["held"], bool)
    return np.concatenate([[END], np.insert(dense[ids[np.repeat(train, lens)]], np.cumsum(lens[train]), END)])


def averaged(table: DataFrame, dense: np.ndarray, classes: np.ndarray, prior: np.ndarray, weights: dict[str, np.ndarray], rate: float) -> tuple[dict[str, np.ndarray], int]:
    """The weights after a pass over the blocks' training texts, and how many windows these are: each block goes on from the same weights with all of its
    windows, and what the blocks come to is averaged by their windows. One number a weight reaches the driver."""
    given = table.sparkSession.sparkContext.broadcast((dense, classes, prior, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, classes, prior, start = given.value
        total = np.zeros(1 + sum(x.size for x in start.values()), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                line = _training_line(row, dense)
                if len(line) < 2:
                    continue
                found = attention.training_windows(line.astype(np.uint16))
                new = attention.fit(found, classes, prior, start, rate=rate, seed=row["block"])
                moved = np.concatenate([(new[k].astype(np.float64) - start[k]).reshape(-1) for k in start])
                total[0] += len(found)
                total[1:] += np.rint(moved * PARTS).astype(np.int64) * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "n"])
        give_back()

    cells = table.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    sums = cells["n"].to_numpy(np.float64)
    if not len(sums) or not sums[0]:
        return weights, 0
    moved = np.split(sums[1:] / sums[0] / PARTS, np.cumsum([x.size for x in weights.values()])[:-1])
    return {k: (x + m.reshape(x.shape)).astype(np.float32) for (k, x), m in zip(weights.items(), moved, strict=True)}, int(sums[0])


def learn(table: DataFrame, rank_file: str) -> attention.Model:
    """The model of a table of blocks: counts of ids and of pairs of frequent ids over all training texts (at most DENSE squared reach
    the driver), attention weights fitted on all training texts, from weights that some blocks, drawn by hash, were fitted on before."""
    spark = table.sparkSession
    raw = table.select(F.explode(F.arrays_zip("raw_ids", "raw_n")).alias("x")).groupBy("x.raw_ids").agg(F.sum("x.raw_n").alias("n")).toPandas()
    often = np.zeros(RAW_IDS, np.int64)
    often[raw["raw_ids"].to_numpy(np.int64)] = raw["n"].to_numpy(np.int64)
    first = np.zeros(RAW_IDS, bool)
    first[[rank for token, rank in _ranks(rank_file).items() if token.startswith(b" ")]] = True
    dense, rare, begins = dense_ids(often, first)
    given = spark.sparkContext.broadcast(dense)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DENSE * DENSE, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                line = _training_line(row, given.value)
                total += np.bincount(line[:-1] * DENSE + line[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])
        give_back()

    texts = table.select("block", "held", "counts", "numbers", "sub", "sub_lens")
    cells = texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros((DENSE, DENSE))
    pairs.reshape(-1)[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    classes, prior, member = attention.counted(pairs, begins)
    drawn = F.pmod(F.xxhash64("block"), F.lit(1 << 20))
    first = table.agg(F.min(drawn)).first()[0]
    weights, _ = averaged(texts.where((drawn < (1 << 20) // BEGIN_ONE_IN) | (drawn == F.lit(first))), dense, classes, prior, attention.begun(), attention.RATE)
    weights, number = averaged(texts, dense, classes, prior, weights, attention.RATE * THEN)
    return attention.Model(dense, rare, begins, classes, prior.astype(np.float32), member.astype(np.float32), weights, number)


def _words(table: DataFrame) -> DataFrame:
    """(block, place, word, n): the words of the blocks' dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, n = np.frombuffer(row["words"], "<i8"), _unpack(row["n_train"], "<i8")
                for k in range(0, len(words), 1 << 16):
                    part = words[k : k + (1 << 16)]
                    columns = (np.full(len(part), row["block"]), np.arange(k, k + len(part), dtype=np.int32), part, n[k : k + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "place", "word", "n"])
        give_back()

    return table.select("block", "words", "n_train").mapInArrow(run, "block long, place int, word long, n long")


def word_counts(table: DataFrame) -> tuple[DataFrame, int]:
    """(block, place, c): for each word of a block's dictionary its count in all training texts; and how many words have one. Counts are
    added up before the shuffle as well as after it; the join back is one that adaptive execution can split at a word that all blocks have.
    Words are told apart by 64-bit hashes: among a thousand million words two share a hash with probability 0.03."""
    sums = materialize(_words(table).groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "sums")
    found = _words(table).select("block", "place", "word").join(sums, "word", "left")
    return found.select("block", "place", F.coalesce("c", F.lit(0)).alias("c")), sums.count()


def mix(by_model: np.ndarray, by_counts: np.ndarray) -> np.ndarray:
    """log P of words from their log P by the model and their P by counts, which is 0 for unknown ones."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(1 - BY_COUNTS) + by_model, np.log(BY_COUNTS) + np.log(by_counts))


@scratched
def score(df: DataFrame, rank_file: str, pattern: str, held: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: id, held_out boolean, n_tokens, n_known, train_tokens (long), base_score, score (double, log10).

    Learns from the rows where `held` isn't true. A-Z are lower-cased; tokens are the words between the six white-space characters and one
    end. base_score: smoothed counts of words. score: log10 P of the text's words in order: for each word the mean of its
    probability by attention, which reads a word as a blank and its subword ids, and its share by counts (none if it's unknown).
    Both sum up to 1 over all words, so their mean does. Long texts are read in overlapping
    windows, each id is scored once. Null and empty texts: the end alone. Repeated rows count as often as they occur; ids may
    be null. Without training rows all counts are 0. Empty table: no rows.
    """
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    kind = rows.schema["id"].dataType.simpleString()
    table = materialize(blocks(rows, rank_file, pattern), "blocks")
    counts, distinct = word_counts(table)
    counts = materialize(counts, "counts")
    sums = table.agg(F.sum("train_tokens"), F.sum("train_docs")).first()
    total, n_docs = (int(x or 0) for x in sums)
    distinct += n_docs > 0
    shared = df.sparkSession.sparkContext.broadcast(learn(table, rank_file))
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        numbers, words, raw, lens = _texts(row)
        c = np.zeros(len(right), np.int64)
        c[right.column("place").to_numpy()] = right.column("c").to_numpy()
        who = np.repeat(np.arange(len(words)), words)
        least = np.log10(total + distinct + 1)
        base = np.bincount(who, (np.log10(c + 1.0) - least)[numbers], len(words)) + np.log10(n_docs + 1.0) - least
        known = np.bincount(who, (c > 0)[numbers], len(words)).astype(np.int64) + (n_docs > 0)
        by_model = shared.value.score_words(raw, lens)
        ends = np.cumsum(words)  # each text's end follows its words
        by_counts = np.insert(np.where(c > 0, (c + 1.0) / (total + distinct + 1), 0)[numbers], ends, (n_docs + 1.0) / (total + distinct + 1))
        mixed = mix(by_model, by_counts) / np.log(10)
        model = np.bincount(np.insert(who, ends, np.arange(len(words))), mixed, len(words))
        n = len(words)
        return pa.Table.from_arrays([pa.array(row["ids"], id_type), pa.array(row["held"], pa.bool_()), pa.array(words + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(n, total), pa.int64()), pa.array(base), pa.array(model)], names)

    left = table.select("block", "ids", "held", "counts", "numbers", "sub", "sub_lens").groupBy("block")
    out = left.cogroup(counts.select("block", "place", "c").groupBy("block")).applyInArrow(work, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id)
