"""Near-duplicate documents by DartMinHash signatures, banded joins and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connect, drop_scratch, few, materialize, scratched, tasks_for, text_slices, whole_groups
from .words import distinct_words

#: Words of a shingle; bands and coordinates of each. A pair at similarity 0.8 shares no band with probability (1 - 0.8^5)^28, under 2 in 100,000.
SHINGLE, BANDS, ROWS = 5, 28, 5
#: Darts have ranks; the first stretch of ranks, and as long as some coordinate is empty another as long as all before.
FIRST_STRETCH = 0.125
#: Rounds in which each bucket is compared with one of its members, before what is left is dealt anew; members that meet one copy of such a member.
HUB_ROUNDS, HUB_MEMBERS = 2, 256
#: Members and elements that are compared together.
CHUNK, CHUNK_ELEMENTS = 512, 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(*parts: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(repr(parts)))


def _poisson(mean: float) -> np.ndarray:
    """The distribution function of a Poisson number, up to where doubles end."""
    terms, k = [math.exp(-mean)], 0
    while k < mean or terms[-1] > 1e-18:
        k += 1
        terms.append(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)))
    return np.minimum(np.cumsum(terms), 1.0)


def dart_signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """For each of n_rows weighted sets k coordinates (unsigned 64-bit); two sets agree in one with the probability of their weighted
    Jaccard similarity, sum of minima by sum of maxima.

    Each element has a half plane, weight by rank, cut into regions that double in either direction. A hash of element and
    region says how many darts lie there (a Poisson number of the region's area) and, for each, its weight, coordinate and
    place among the region's ranks. A set has the darts below its elements' weights; the earliest one of a coordinate is its value.
    Stretches of ranks are opened until every coordinate has a dart, so work depends on k more than on a set's size.
    rows, elements, weights: parallel, an element once a row, weights positive. Rows without elements keep all ones.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n_rows, k), empty)
    flat = out.reshape(-1)
    level = np.where(weights <= 1, 0, np.ceil(np.log2(np.maximum(weights, 1)))).astype(np.int64)
    active, stretch = np.bincount(rows, minlength=n_rows) > 0, 0
    while active.any():
        length = FIRST_STRETCH * (1 if stretch == 0 else 2 ** (stretch - 1))
        live = np.flatnonzero(active[rows])
        for tall in range(int(level[live].max()) + 1):
            own = live[level[live] >= tall] if tall else live
            low, height = (0.0, 1.0) if tall == 0 else (2.0 ** (tall - 1), 2.0 ** (tall - 1))
            there = mix(elements[own] + _salt(stretch, tall))
            number = np.searchsorted(_poisson(length * height), (there >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
            at = np.repeat(np.arange(len(own)), number)
            which = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
            dart = mix(there[at] + (which.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            if tall or (weights[own] < 1).any():
                up = low + height * (mix(dart + np.uint64(1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                hit = up < weights[own[at]]
                at, dart = at[hit], dart[hit]
            place = ((mix(dart + np.uint64(2)) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            cell = rows[own[at]] * k + place
            fresh = filled[cell] if stretch else np.ones(len(cell), bool)
            np.minimum.at(flat, cell[fresh], dart[fresh])
        filled = flat == empty  # open for later stretches, whose darts come later than all before
        active &= filled.reshape(n_rows, k).any(1)
        stretch += 1
    return out


class Shingles:
    """Weighted sets of word shingles."""

    def __init__(self, size: int):
        self.size = size
        self.odd = np.array([_salt(i) | np.uint64(1) for i in range(size)])

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shingle, count) of all texts, sorted. Words: lower case, between white space. A text of fewer words is one shingle."""
        known, numbers, lens = distinct_words(pc.utf8_lower(pc.fill_null(texts, "")), lower=False)
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[numbers]
        starts = np.cumsum(lens) - lens
        number = np.where(lens >= self.size, lens - self.size + 1, np.minimum(lens, 1))
        rows = np.repeat(np.arange(len(lens)), number)
        first = np.repeat(starts, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        have = np.minimum(lens, self.size)[rows]
        shingles = np.zeros(len(first), np.uint64)
        for i in range(self.size):
            ok = have > i
            shingles[ok] += words[first[ok] + i] * self.odd[i]
        shingles = mix(shingles + have.astype(np.uint64))
        order = np.lexsort((shingles, rows))
        rows, shingles = rows[order], shingles[order]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (shingles[1:] != shingles[:-1])])) if len(rows) else np.zeros(0, np.int64)
        return rows[new], shingles[new], np.diff(np.append(new, len(rows)))


def occurrences(rows: np.ndarray, shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle as often as it counts, as numbers that differ: sets whose plain Jaccard similarity is the weighted one."""
    at = np.repeat(np.arange(len(rows)), counts)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    return rows[at], mix(shingles[at] + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def weights_of(counts: np.ndarray, weigh: str) -> np.ndarray:
    """Whole weights of shingles from how often their text has them: 'log', the bits of that number, so each doubling adds 1; 'count', the number
    itself; 'set', 1."""
    if weigh not in ("log", "count", "set"):
        raise ValueError(f"no such weights: {weigh}")
    return counts if weigh == "count" else np.frexp(counts.astype(np.float64))[1].astype(np.int64) if weigh == "log" else np.ones(len(counts), np.int64)


def sketch(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weigh: str = "log") -> DataFrame:
    """Per row: id long, point binary (128-bit hash of the whole weighted set; null without words), bands array<long>. weigh: see weights_of()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, salts = Shingles(shingle), np.array([_salt(b, "band") for b in range(bands)])
        odd = np.array([_salt(r, "row") | np.uint64(1) for r in range(rows)])
        for batch in text_slices(batches, "text"):
            n = batch.num_rows
            at, elements, counts = maker.sets(batch.column("text"))
            weights = weights_of(counts, weigh)
            signs = dart_signatures(at, elements, weights.astype(np.float64), n, bands * rows)
            keys = mix((signs.reshape(n, bands, rows) * odd).sum(2, dtype=np.uint64) + salts).astype(np.int64)
            ends = np.searchsorted(at, np.arange(n + 1))
            points = [xxhash.xxh3_128_digest(elements[a:b].tobytes() + weights[a:b].tobytes()) if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands), pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(points, pa.binary()), lists], ["id", "point", "bands"])

    picked = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, "id long, point binary, bands array<bigint>")


def elements(df: DataFrame, shingle: int, weigh: str) -> DataFrame:
    """Of rows (id, text) the elements array<long> that verification compares, and their number n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingles(shingle)
        for batch in text_slices(batches, "text"):
            at, shingles, counts = maker.sets(batch.column("text"))
            at, every = occurrences(at, shingles, weights_of(counts, weigh))
            ends = np.searchsorted(at, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(every.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(ends), pa.int32()), lists], ["id", "n", "elements"])

    return df.select("id", "text").mapInArrow(run, "id long, n int, elements array<bigint>")


@scratched
def near_duplicates(df: DataFrame, similarity: float = 0.8, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weigh: str = "log") -> DataFrame:
    """One row per row of df: id, class_id long (smallest id of its class), kept boolean (id = class_id).

    Links: weighted Jaccard similarity, sum of minima by sum of maxima, of five-word shingles of `similarity` or more, computed exactly
    for pairs that share a band. A shingle weighs more the more often its text has it (weights_of()). Classes: reachable by links. Equal sets are one point from the
    start. In a bucket of points that share a band all are compared with one of them, a hub, then those of other classes than it
    with another; hubs are copied for every HUB_MEMBERS members. Buckets that are of several classes still are dealt anew by the rarest
    elements of their members (see finer()), for two more rounds; what is apart then is compared in the buckets' tasks, all with all other
    classes, in chunks. So every pair of a bucket is compared, or ruled out, or already of one class. Documents without a word and
    null ids have a class of their own and stay; rows that repeat an id are one document, all stay or go together. Whole texts count, of
    any length. Ties: the smallest id. Empty table: no rows. Columns besides id and text aren't read. The result is a stored table; what it was
    made from is deleted.
    """
    return materialize(_near_duplicates(df, similarity, id, text, shingle, bands, rows, weigh), "classes")


def _near_duplicates(df: DataFrame, similarity: float, id: str, text: str, shingle: int, bands: int, rows: int, weigh: str) -> DataFrame:
    signs = materialize(sketch(df, id, text, shingle, bands, rows, weigh), "signatures")
    sound = F.col("point").isNotNull() & F.col("id").isNotNull()
    points = materialize(signs.where(sound).groupBy("point").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "points")
    buckets = points.select("id", F.explode("bands").alias("key"))
    full = materialize(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "full")
    shared = materialize(buckets.join(full, "key").select("key", "id"), "buckets")
    wanted = materialize(shared.select("id").distinct(), "wanted")
    # few ids by count are broadcast, so that no text is shuffled
    texts = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).join(few(wanted), "id", "left_semi")
    sets = materialize(elements(texts, shingle, weigh).dropDuplicates(["id"]), "elements")
    state = Classes()
    apart = compare_with_hubs(shared, sets, similarity, state, 0)
    rest = None if apart is None else compare_with_hubs(finer(apart, sets, similarity), sets, similarity, state, HUB_ROUNDS)
    if rest is not None:
        ids = materialize(rest.select("id").distinct(), "ids")
        apart = apart.select("key", "id").join(few(ids), "id")
        if state.roots is not None:
            apart = apart.join(few(state.roots), "id", "left")
        state.add(_compare(apart.select("key", "id", F.coalesce("root", "id").alias("root") if state.roots else F.col("id").alias("root")), sets, similarity))
    roots = state.roots
    if roots is None:
        classes = points.select("point", F.col("id").alias("class_id"))
    else:
        classes = points.select("point", "id").join(roots, "id", "left").select("point", F.coalesce("root", "id").alias("class_id"))
    classes = materialize(classes, "classes")
    met = signs.select("id", F.when(sound, F.col("point")).alias("point")).join(classes, "point", "left")
    met = met.select(F.col("id").alias(id), F.coalesce("class_id", "id").alias("class_id"))
    return met.withColumn("kept", F.coalesce(F.col(id) == F.col("class_id"), F.lit(True)))


@dataclass
class Classes:
    """Links found so far, pairs that were compared, and the classes that the links make."""

    links: DataFrame | None = None
    seen: DataFrame | None = None
    roots: DataFrame | None = None

    def add(self, links: DataFrame, pairs: DataFrame | None = None) -> None:
        self.links = links if self.links is None else self.links.unionByName(links)
        if pairs is not None:
            self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        self.roots = connect(self.links, "classes")


def compare_with_hubs(buckets: DataFrame, sets: DataFrame, similarity: float, state: Classes, first: int) -> DataFrame | None:
    """Compares the members of each bucket (key, id) with one of them, HUB_ROUNDS times, and adds what is found to `state`. Members (key, id, root) of
    buckets that are of several classes still; None if there is none."""
    for turn in range(first, first + HUB_ROUNDS + 1):
        own = F.coalesce("root", "id").alias("root") if state.roots else F.col("id").alias("root")
        members = materialize((buckets.join(few(state.roots), "id", "left") if state.roots else buckets).select("key", "id", own), "members")
        hub = F.min_by(F.struct("id", "root"), F.xxhash64("id", F.lit(turn))).alias("hub")
        split = members.groupBy("key").agg(hub, F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
        split = materialize(split.select("key", F.col("hub.id").alias("other"), F.col("hub.root").alias("hub_root")), "hubs")
        if split.isEmpty():
            return None
        apart = members.join(few(split), "key")
        if turn == first + HUB_ROUNDS:
            return materialize(apart.select("key", "id", "root"), "apart")
        more = apart.where("root != hub_root").select("id", "other")
        more = more.select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("other")).distinct()
        more = materialize(more if state.seen is None else more.join(few(state.seen), ["id", "other"], "left_anti"), "pairs")
        drop_scratch(members)
        if not more.isEmpty():
            state.add(verify(more, sets, similarity), more)


def finer(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Smaller buckets (key, id) of the members of buckets: similar ones meet in one still.

    Elements are put in an order, rarest among these members first. Of two sets of the given similarity the part of size - ceil(similarity *
    size) + 1 that comes first has an element in common, so that element can be their bucket. Common elements, such as a pair of words
    that thousands of documents repeat, come last and make no bucket unless a document has little else.
    """
    ids = materialize(apart.select("id").distinct(), "ids")
    long = sets.join(few(ids), "id").select("id", F.col("n").alias("size"), F.explode("elements").alias("element"))
    long = materialize(long, "long")
    often = long.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    shared = long.join(materialize(often, "often"), "element").groupBy("id").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "element"))).alias("common"))
    reach = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("common"))
    keys = shared.where(reach > 0).select("id", F.explode(F.slice("common", F.lit(1), reach.cast("int"))["element"]).alias("key"))
    return materialize(keys.select("key", "id"), "buckets")


def _compare(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of a bucket that are of different classes; enough of them to tie together all that is linked.

    Buckets are dealt into chunks of CHUNK members or CHUNK_ELEMENTS elements, each pair of chunks is a piece of work. A member is
    compared with all members of other classes at once; where it's linked the classes become one. Pairs never leave the task.
    """
    apart = materialize(apart, "apart")
    split = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    apart = materialize(apart.join(few(materialize(split, "split")), "key"), "apart")
    sizes = sets.select("id", "n").join(few(apart), "id")
    sizes = sizes.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_ELEMENTS)).cast("int").alias("chunks"))
    met = apart.join(few(materialize(sizes, "chunks")), "key").withColumn("part", F.pmod(F.xxhash64("id", "key"), F.col("chunks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("id", "root", "part", F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with")).alias("bucket"), (F.col("part") == F.col("with")).alias("one"))
    met = materialize(met.join(sets.select("id", "elements"), "id"), "dealt")
    total = met.agg(F.sum(F.size("elements"))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket", 256):
            keys = table.column("bucket").to_numpy()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            left, right = [], []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
                x, y = _tied(table.slice(a, b - a), similarity)
                left += x
                right += y
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    met = met.repartition(tasks_for(8 * int(total or 0), 8 << 20), "bucket").sortWithinPartitions("bucket").select("bucket", "id", "root", "part", "one", "elements")
    return materialize(met.mapInArrow(run, "a long, b long"), "links")


def _tied(bucket: pa.Table, similarity: float) -> tuple[list[int], list[int]]:
    """Links that tie the classes of one bucket together."""
    ids, parts = bucket.column("id").to_numpy(), bucket.column("part").to_numpy()
    _, root = np.unique(bucket.column("root").to_numpy(), return_inverse=True)
    lists = bucket.column("elements").combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(size) - size
    known, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    has, one = np.zeros(len(known), bool), bool(bucket.column("one")[0].as_py())
    left, right = [], []
    for row in range(len(ids) - 1):
        fits = root[row + 1 :] != root[row]
        if not one:
            fits &= parts[row + 1 :] != parts[row]
        rest = row + 1 + np.flatnonzero(fits)
        if not len(rest):
            continue
        own = codes[starts[row] : starts[row] + size[row]]
        has[own] = True
        both = np.add.reduceat(has[codes[starts[row + 1] :]], starts[row + 1 :] - starts[row + 1], dtype=np.int64)[rest - row - 1]
        has[own] = False
        for other in rest[both >= similarity * (size[row] + size[rest] - both) - 1e-9].tolist():
            if root[other] != root[row]:
                left.append(int(ids[row]))
                right.append(int(ids[other]))
                root[root == root[other]] = root[row]
    return left, right


def verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b): the pairs (id, other) whose sets' similarity is at least `similarity`. An `other` of many pairs is copied, once for each
    HUB_MEMBERS of them, and the pairs are dealt to its copies by a hash, so no task gets all that is compared with it. Sets of too unlike sizes
    are left out before any elements are moved."""
    sized = materialize(sets.select("id", "n").join(few(pairs), "id"), "sized")
    sized = sets.select(F.col("id").alias("other"), F.col("n").alias("m")).join(few(sized), "other")
    pairs = materialize(sized.where(F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - 1e-9).select("id", "other"), "pairs")
    hubs = materialize(pairs.groupBy("other").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("copies")), "hubs")
    dealt = pairs.join(few(hubs), "other").select("id", "other", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int").alias("copy"))
    right = sets.select(F.col("id").alias("other"), F.col("elements").alias("y")).join(few(hubs), "other")
    right = right.select("other", "y", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    left = sets.select("id", F.col("elements").alias("x")).join(few(materialize(dealt, "dealt")), "id")
    met = left.join(right, ["other", "copy"])
    both = F.size(F.array_intersect("x", "y"))
    met = met.where(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both) - 1e-9)
    return materialize(met.select(F.col("id").alias("a"), F.col("other").alias("b")), "links")
