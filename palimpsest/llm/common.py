"""What the training-data operators share: scratch tables, text slices, connected classes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir

#: The white space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Bytes of text that a Python worker takes apart at a time; a longer text is one slice.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 2000


#: Bytes of an Arrow batch between Spark and a Python worker: both sides hold some, for each task.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless it has a bound of its own: results are made after their operator has returned, so the bound
    stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, f"{BATCH_BYTES}b")


#: Of this thread.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the folders that materialize() makes meanwhile."""
    made: list[str] = []
    mark = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(mark)


def scratched(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose scratch tables are deleted when it returns, but for those that its result reads; these go when the driver ends."""

    @wraps(operator)
    def run(df: DataFrame, *args, **named) -> DataFrame:
        small_batches(df.sparkSession)
        with scratch_scope() as made:
            out = operator(df, *args, **named)
        release(df.sparkSession, made, out)
        return out

    return run


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared scratch folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _scopes.get():
        made.append(path)
    small_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, folders: list[str], keep: DataFrame) -> list[str]:
    """Deletes scratch folders that `keep` doesn't read; returns the others."""
    needed = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in keep.inputFiles()}
    stay = [f for f in folders if f.rsplit("/", 1)[-1] in needed]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        if folder not in stay:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    return stay


def drop_scratch(df: DataFrame) -> None:
    """Deletes the files behind a frame that materialize() made, once nothing reads it any more."""
    release(df.sparkSession, [f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]], df.sparkSession.range(0))


#: Bytes of a table that may be broadcast, and copies of it, one for each salt, if it has more.
BROADCAST_BYTES, SALTS = 16 << 20, 64


def bytes_of(df: DataFrame) -> int:
    """Bytes of the rows as Spark holds them, about: summed up over them, so df should be a stored table."""
    width = F.lit(16 + 8 * len(df.columns)).cast("long")
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            width += F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map"):
            width += 8 * F.greatest(F.size(f.name), F.lit(0))
        elif kind == "struct":
            width += 8 * len(f.dataType)
    return df.agg(F.sum(width)).first()[0] or 0


def few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has at most BROADCAST_BYTES."""
    return F.broadcast(df) if bytes_of(df) <= BROADCAST_BYTES else df


def join_small(rows: DataFrame, table: DataFrame, keys: list[str], salt: list[str]) -> DataFrame:
    """rows left join table on equal keys (null equals null); table has one slim row for each key.

    Up to BROADCAST_BYTES it is broadcast. Beyond, each of its rows is copied to SALTS salts and `rows` dealt
    by a hash of the `salt` columns, so that a hot key is spread.
    """
    table = table.select(*(F.col(k).alias(f"__k_{k}") for k in keys), *(c for c in table.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    if bytes_of(table) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), same, "left").drop(*(f"__k_{k}" for k in keys))
    table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__pick", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int"))
    return rows.join(table, same & (F.col("__pick") == F.col("__salt")), "left").drop("__pick", "__salt", *(f"__k_{k}" for k in keys))


def tasks_for(total_bytes: int, each: int = 16 << 20, least: int = 12) -> int:
    """So many tasks that each gets about `each` bytes."""
    return max(least, -(-int(total_bytes or 0) // each))


def give_back() -> None:
    """Returns memory that a worker's task has freed to the system; the worker lives on and waits."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


#: What workers keep from task to task.
_kept: list = []


def kept_by_worker(load: Callable) -> Callable:
    """load, with its last results kept in each worker until let_go()."""
    cached = lru_cache(maxsize=2)(load)
    _kept.append(cached)
    return cached


def let_go() -> None:
    """Drops what this worker keeps for tasks of other kinds."""
    for cached in _kept:
        cached.cache_clear()
    give_back()


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `limit` bytes of `column`; a longer text is alone in its slice."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, base + limit, side="right"))), start + rows)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 8192) -> Iterator[pa.Table]:
    """Rows that come sorted by `key`, in tables of about `rows` rows that never cut a group."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            held.append(batch.slice(start, rows))
            count += held[-1].num_rows
            if count < rows:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            other = np.flatnonzero(keys != keys[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield table.slice(0, cut)
            held, count = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


#: Links that one task may put together.
LOCAL_LINKS = 200_000


def _local_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches]
    if not parts:
        return
    ids, flat = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = flat.reshape(2, -1)
    low = np.arange(len(ids))
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        while not (new[new] == new).all():
            new = new[new]
        if (new == low).all():
            break
        low = new
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[low], pa.int64())], ["id", "root"])


def connect(edges: DataFrame, label: str) -> DataFrame:
    """Connected classes of undirected links (a long, b long): rows (id, root), root the smallest id reachable.

    Alternates large-star and small-star steps until nothing changes. A step aggregates by id before and after its shuffle and joins the smallest neighbour
    back, a join that adaptive execution can split at a star's centre; it makes at most one link of each. Every step is written to the scratch folder. Up to LOCAL_LINKS
    links, counted, are put together by one task instead, with the same result. Empty input: no rows. Ids that occur in no link
    get no row.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    if now.count() <= LOCAL_LINKS:
        roots = materialize(now.coalesce(1).mapInArrow(_local_roots, "id long, root long"), label)
        drop_scratch(now)
        return roots
    while True:
        # large star: every neighbour above a links to the smallest of a and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), label)
        large = materialize(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), label)
        # small star: a and every neighbour below it link to the smallest of them
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), label)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct(), label)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for frame in (now, low, large, least):
            drop_scratch(frame)
        now = after
        if mark == before:
            links = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
            return links.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = mark
