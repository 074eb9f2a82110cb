"""Near-duplicate vectors by spherical-cap filters: structured random product codes, list decoding, join on filters, verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connect, few, materialize, scratched, tasks_for, whole_groups

#: Blocks of a product code; filters of a code that a vector is in, about; share of the pairs at the threshold that may have no filter in common; members
#: of a filter to aim at, and the largest part of all directions that a filter may cover.
BLOCKS, EACH, MISSED, MEMBERS, WIDEST = 2, 0.1, 1e-3, 400.0, 0.1
#: Random pairs that each of TRIALS codes is tried on, and how many of them must have met for the measured share to count.
TRIALS, TRIED, LEAST_MET = 16, 400, 100
#: A filter with more members is dealt into chunks of this size, and each pair of chunks is a piece of work of its own.
CHUNK = 1024
#: Rows and pairs that are looked at together.
BLOCK_ROWS, BLOCK_PAIRS = 8192, 1 << 17
#: Members from which on a bucket is compared by products of matrices.
LARGE = 24


@dataclass(frozen=True)
class Code:
    """`turns` product codes, each under a random rotation of its own. A code's filters are all sums of one codeword a block; a
    unit vector is in a filter if its inner product is `least` or more. Many codes even out how many filters vectors are in."""

    dim: int
    words: int
    turns: int
    least: float

    @lru_cache(maxsize=8)  # noqa: B019
    def parts(self) -> list[tuple[np.ndarray, list[slice], list[np.ndarray]]]:
        draw, out = np.random.default_rng([self.dim, self.words, self.turns]), []
        edges = np.linspace(0, self.dim, min(BLOCKS, self.dim) + 1).round().astype(int)
        cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for _ in range(self.turns):
            turn, _ = np.linalg.qr(draw.standard_normal((self.dim, self.dim)))
            books = [draw.standard_normal((self.words, c.stop - c.start)) for c in cuts]
            out.append((turn, cuts, [b / np.linalg.norm(b, axis=1, keepdims=True) * math.sqrt(b.shape[1]) for b in books]))
        return out

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter), sorted, of all filters that each unit vector exceeds: prefixes that can't reach `least` are left early."""
        found = []
        for number, (turn, cuts, books) in enumerate(self.parts()):
            turned = units @ turn
            scores = [turned[:, c] @ b.T for c, b in zip(cuts, books, strict=True)]
            rows, keys, sums = np.arange(len(units)), np.full(len(units), number), np.zeros(len(units))
            hope = np.cumsum([s.max(1) for s in scores[::-1]], axis=0)[::-1]
            for i, s in enumerate(scores):
                rest = hope[i + 1][rows] if i + 1 < len(scores) else 0.0
                at, word = np.nonzero((sums + rest)[:, None] + s[rows] >= self.least)
                rows, keys, sums = rows[at], keys[at] * self.words + word, sums[at] + s[rows[at], word]
            found.append((rows, keys))
        rows, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((keys, rows))
        return rows[order], keys[order]


def choose(dim: int, most: int, cosine: float) -> Code:
    """The codes for groups of up to `most` vectors: filters get narrower as groups grow, so that their members don't multiply.

    Codes are turned at random, so all pairs at the threshold fare alike, and one code after another misses a pair independently. How many of such pairs a code
    misses is measured, and as many codes are taken as leave MISSED of them. Where narrow filters hardly ever hold both (few dimensions), wider ones are taken.
    """
    draw = np.random.default_rng(dim)
    x, y = draw.standard_normal((2, TRIED, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine * cosine) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    share = min(WIDEST, MEMBERS / max(most, 1))
    while True:
        least = NormalDist().inv_cdf(1 - share)
        words = max(2, round((EACH / share) ** (1 / min(BLOCKS, dim))))
        trial = Code(dim, words, TRIALS, least)
        met = _met(trial, x, y)
        if met >= LEAST_MET or share >= 0.5:
            break
        share = min(0.5, 2 * share)
    if not met:  # one dimension: a filter is a side
        return Code(dim, 2, 1, -math.inf)
    missed = 1 - met / (TRIED * TRIALS)
    return Code(dim, words, math.ceil(math.log(MISSED) / math.log(max(missed, 1e-9))), least)


def _met(code: Code, x: np.ndarray, y: np.ndarray) -> int:
    """In how many codes the pairs have a filter in common, added up."""
    size = code.words ** min(BLOCKS, code.dim)
    found = [set(zip(*map(np.ndarray.tolist, code.decode(z)), strict=True)) for z in (x, y)]
    return len({(row, key // size) for row, key in found[0] & found[1]})


def _pairs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a < b) of places within buckets given by first place and size."""
    left = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    after = np.repeat(first + size, size) - left - 1
    a = np.repeat(left, after)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
    return a, b


def _links(block: dict[str, np.ndarray], units: np.ndarray, lists: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of places those that are links, and whose least common filter this is."""
    fits = (block["part"][a] != block["part"][b]) | (block["i"][a] == block["j"][a])
    a, b = a[fits], b[fits]
    near = _near(np.einsum("ij,ij->i", units[a], units[b]), block["vectors"], a, b, cosine)
    a, b = a[near], b[near]
    fresh = _fresh(lists, a, b)
    return a[fresh], b[fresh]


def _near(found: np.ndarray, vectors: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which cosines reach the threshold; those that rounding could turn are computed again from the vectors themselves."""
    near, close = found >= cosine, np.flatnonzero(np.abs(found - cosine) < 1e-9)
    near[close] = exact_cosine(vectors[a[close]], vectors[b[close]]) >= cosine
    return near


def _fresh(lists: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs have no lesser filter in common."""
    low, high, fresh = lists[a], lists[b], np.ones(len(a), bool)
    for k in range(low.shape[1]):
        fresh &= ~((low[:, k : k + 1] == high) & (high >= 0)).any(1)
    return fresh


def _links_of(block: dict[str, np.ndarray], units: np.ndarray, lists: np.ndarray, first: int, n: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for all pairs of a large bucket, cosines by products of matrices: a first pass in single precision, doubles for what it leaves."""
    own = slice(first, first + n)
    part, one = block["part"][own], block["i"][first] == block["j"][first]
    rough = units[own].astype(np.float32)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = BLOCK_PAIRS // n + 1
    for k in range(0, n, step):
        rows = slice(k, min(k + step, n))
        fits = rough[rows] @ rough.T >= cosine - 1e-4
        fits &= np.arange(n) > np.arange(n)[rows, None]
        if not one:
            fits &= part != part[rows, None]
        a, b = np.nonzero(fits)
        a, b = first + k + a, first + b
        near = _near(np.einsum("ij,ij->i", units[a], units[b]), block["vectors"], a, b, cosine)
        a, b = a[near], b[near]
        fresh = _fresh(lists, a, b)
        found_a.append(a[fresh])
        found_b.append(b[fresh])
    return np.concatenate(found_a), np.concatenate(found_b)


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine in double precision, scaled first so that no square over- or underflows."""
    x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def _work(block: dict[str, np.ndarray], cosine: float) -> dict[int, list[int]]:
    """Of the vectors with links in these buckets: rows linked, and the smallest id that they're tied to here."""
    vectors = block["vectors"]
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    units = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    change = np.flatnonzero(np.concatenate([[True], *([(block["bucket"][1:] != block["bucket"][:-1])] if len(units) else [])]))
    size = np.diff(np.append(change, len(units)))
    width = max(map(len, block["lists"]))  # lesser filters of each vector
    lists = np.full((len(units), width), -1)
    for k, x in enumerate(block["lists"]):
        lists[k, : len(x)] = x
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = size < LARGE
    first, count = change[few], size[few]
    turns = np.cumsum(count * (count - 1) // 2) // BLOCK_PAIRS
    for t in np.unique(turns):
        a, b = _links(block, units, lists, *_pairs(first[turns == t], count[turns == t]), cosine)
        found_a.append(a)
        found_b.append(b)
    for f, n in zip(change[~few].tolist(), size[~few].tolist(), strict=True):
        a, b = _links_of(block, units, lists, f, n, cosine)
        found_a.append(a)
        found_b.append(b)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    ids, flat = np.unique(np.concatenate([block["id"][a], block["id"][b]]), return_inverse=True)
    a_id, b_id = flat[: len(a)], flat[len(a) :]
    linked = np.zeros(len(ids), np.int64)
    np.add.at(linked, a_id, block["copies"][b])
    np.add.at(linked, b_id, block["copies"][a])
    low = np.arange(len(ids))
    while len(a):
        before = low.copy()
        least = np.minimum(low[a_id], low[b_id])
        np.minimum.at(low, a_id, least)
        np.minimum.at(low, b_id, least)
        low = low[low]
        if (low == before).all():
            break
    return {int(i): [int(n), int(ids[k])] for i, n, k in zip(ids, linked, low, strict=True)}


@scratched
def near_duplicates(df: DataFrame, cosine: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of df: id, n_links long, component_id long, kept boolean.

    Compares vectors of equal, non-null label (and length) by cosine in double precision; what the filters bring together is
    verified exactly, so no link lies below `cosine`. A link is missed only if two vectors share no filter: about MISSED of
    those at the threshold itself, fewer above. Equal vectors are one point with a count of copies; each copy counts as a link.
    Vectors that are null, empty, zero or hold null or non-finite components have no links and stay. A pair is found in each filter
    that it shares and counted in the least of them, where only its vectors' counts and smallest id leave the task: pairs are
    never written out. A filter's members are dealt into chunks of CHUNK, so no task holds a whole hot filter. ids: unique
    longs, not null; a repeated id is a row of its own with the figures of its vector. Empty table: no rows.
    """
    kept_as = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast(kept_as).alias("v"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    shown = F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.col("v").cast("array<string>"), ",")), 256)
    rows = rows.withColumn("point", F.when(F.coalesce(sound, F.lit(False)), shown))
    points = rows.where("point is not null").groupBy("point").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    points = materialize(points, "points")
    groups = points.groupBy("label", F.size("v").alias("dim")).count()
    most = {r.dim: r.most for r in groups.groupBy("dim").agg(F.max("count").alias("most")).collect()}
    codes = {dim: choose(dim, n, cosine) for dim, n in most.items()}
    small = all(c.turns * c.words ** min(BLOCKS, c.dim) < 1 << 31 for c in codes.values())
    list_type, filter_kind = pa.list_(pa.int32() if small else pa.int64()), "int" if small else "bigint"
    label_kind = points.schema["label"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                dims = np.array([len(x) for x in part.column("v")])
                for dim in np.unique(dims):
                    own = part.take(pa.array(np.flatnonzero(dims == dim)))
                    v = np.array(own.column("v").to_pylist(), np.float64)
                    v /= np.abs(v).max(1, keepdims=True)
                    at, keys = codes[int(dim)].decode(v / np.linalg.norm(v, axis=1, keepdims=True))
                    ends = np.searchsorted(at, np.arange(len(v) + 1))
                    lists = pa.array([keys[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("id", "copies", "label", "v")), lists.cast(list_type)], ["id", "copies", "label", "v", "filters"])

    coded = materialize(points.select("id", "copies", "label", "v").mapInArrow(decode, f"id long, copies long, label {label_kind}, v {kept_as}, filters array<{filter_kind}>"), "filters")
    dealt = coded.withColumn("dim", F.size("v")).select("id", "copies", "label", "v", "dim", F.posexplode("filters").alias("place", "filter"), "filters")
    dealt = dealt.withColumn("lesser", F.slice("filters", 1, F.col("place"))).drop("filters", "place")
    many = dealt.select("label", "dim", "filter").groupBy("label", "dim", "filter").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    many = materialize(many.select("label", "dim", "filter", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), "n"), "many")
    total = coded.agg(F.sum(F.size("filters"))).first()[0]
    if not total:
        figures = points.select("point", F.col("copies").alias("n"), F.col("id").alias("root"))
    else:
        met = dealt.join(few(many.drop("n")), ["label", "dim", "filter"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        met = met.withColumn("part", F.pmod(F.xxhash64("id", "filter"), F.col("chunks")).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        met = met.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
        total += many.agg(F.coalesce(F.sum(F.col("n") * (F.col("chunks") - 1)), F.lit(0))).first()[0]
        width = 8 * (max(codes) + 20)
        keys = ["label", "dim", "filter", "i", "j"]
        met = met.repartition(tasks_for(total * width, 8 << 20), *keys).sortWithinPartitions(*keys).select(F.xxhash64(*keys).alias("bucket"), "part", "i", "j", "id", "copies", "v", "lesser")
        found = materialize(met.mapInArrow(lambda batches: _stream(batches, cosine), "id long, linked long, low long"), "links")
        linked = found.groupBy("id").agg(F.sum("linked").alias("linked"))
        roots = connect(found.select(F.col("id").alias("a"), F.col("low").alias("b")), "components")
        figures = points.join(linked, "id", "left").join(roots, "id", "left").select("point", (F.col("copies") + F.coalesce("linked", F.lit(0))).alias("n"), F.coalesce("root", "id").alias("root"))
    figures = materialize(figures, "figures")
    out = rows.select("id", "point").join(figures, "point", "left")
    return out.select(F.col("id").alias(id), F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"), (F.coalesce("root", "id") == F.col("id")).alias("kept"))


def _stream(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Buckets out of sorted rows, many together; one figure for each vector of each block."""
    names = ("bucket", "part", "i", "j", "id", "copies")
    for table in whole_groups(batches, "bucket", BLOCK_ROWS):
        found: dict[int, list[int]] = {}
        wide = np.array([len(x) for x in table.column("v")])
        for dim in np.unique(wide):  # a bucket's vectors are equally long
            own = table.take(pa.array(np.flatnonzero(wide == dim)))
            block = {c: own.column(c).to_numpy() for c in names} | {"vectors": np.array(own.column("v").to_pylist(), np.float64), "lists": own.column("lesser").to_pylist()}
            for k, (n, low) in _work(block, cosine).items():
                old = found.setdefault(k, [0, low])
                found[k] = [old[0] + n, min(old[1], low)]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *(pa.array([x[i] for x in found.values()], pa.int64()) for i in (0, 1))], ["id", "linked", "low"])
