"""Sizes, cutting a log into runs, and what is known about runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .log import OVERHEAD

#: Bytes after which a buffer is flushed.
THRESHOLD = 4 << 20
#: Functions that one task puts together; buffers' worth of bytes in a stretch, and its seq numbers at most; stretches whose runs' ends, about
#: STRETCH numbers each, may be broadcast.
FAN_IN, STRETCH, STRETCH_ROWS, BROADCAST_STRETCHES = 64, 64, 1 << 20, 10_000


def entry_bytes(key: str = "key", value: str = "value") -> Column:
    """What a version adds to a buffer: key, value and overhead; a tombstone has no value."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + OVERHEAD).cast("long")


def buffer_size(log: DataFrame) -> DataFrame:
    """One row: entries, bytes (0 for an empty log)."""
    return log.agg(F.count("*").alias("entries"), F.coalesce(F.sum(entry_bytes()), F.lit(0)).alias("bytes"))


def run_meta(log: DataFrame, run: str = "run") -> DataFrame:
    """For each run entry count, smallest and largest key, smallest and largest seq, bytes."""
    return log.groupBy(run).agg(F.count("*").alias("entry_count"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.sum(entry_bytes()).alias("bytes"))


def might_contain(meta: DataFrame, key) -> DataFrame:
    """The runs whose key range holds the key, ends included."""
    return meta.where((F.col("min_key") <= F.lit(key)) & (F.lit(key) <= F.col("max_key")))


def stats(meta: DataFrame, threshold: int = THRESHOLD, run: str = "run") -> DataFrame:
    """One row: of runs cut at `threshold`, the last still is the buffer if it has fewer bytes."""
    last = F.col(run) == F.max(run).over(Window.partitionBy())
    flat = meta.select("entry_count", "bytes", (last & (F.col("bytes") < threshold)).alias("open"))
    pick = lambda c, own: F.coalesce(F.sum(F.when(F.col("open") == own, F.col(c))), F.lit(0))
    return flat.agg(pick("entry_count", True).alias("memtable_entries"), pick("bytes", True).alias("memtable_bytes"), F.count_if(~F.col("open")).alias("runs"), F.coalesce(F.sum("entry_count"), F.lit(0)).alias("total_entries"))


# Cutting into runs. A buffer is flushed after the entry that brings it to the threshold, and starts at 0 again. With S the running
# sum of sizes over all entries, a run that starts after S = p ends at the least S >= p + threshold. The entries are dealt into
# stretches; a stretch turns the start of the run that is open where it begins into the start of the run that is open where it
# ends. That is a rising step function. Functions of neighbouring stretches are put together level by level, then the starts
# are handed back down, and each stretch numbers its own entries. No task sees more than a stretch or FAN_IN functions.


def _apply(up: np.ndarray, out: np.ndarray, jumps: np.ndarray, p: int) -> tuple[int, int]:
    """A step function at p: (start, runs ended). Beyond the last step nothing ends."""
    i = int(np.searchsorted(up, p, side="left"))
    return (p, 0) if i == len(up) else (int(out[i]), int(jumps[i]))


def _simplify(up: np.ndarray, out: np.ndarray, jumps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    last = np.append((out[1:] != out[:-1]) | (jumps[1:] != jumps[:-1]), True) if len(up) else np.zeros(0, bool)
    return up[last], out[last], jumps[last]


def _compose(f: tuple, g: tuple) -> tuple:
    """f first, then g."""
    i = np.searchsorted(g[0], f[1], side="left")
    stay = i == len(g[0])
    j = np.minimum(i, max(len(g[0]) - 1, 0))
    out, more = (np.where(stay, f[1], g[1][j]), np.where(stay, 0, g[2][j])) if len(g[0]) else (f[1], np.zeros(len(f[1]), np.int64))
    rest = g[0] > (f[0][-1] if len(f[0]) else -(1 << 62))
    return _simplify(np.concatenate([f[0], g[0][rest]]), np.concatenate([out, g[1][rest]]), np.concatenate([f[2] + more, g[2][rest]]))


def _steps(sums: np.ndarray, before: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The step function of a stretch with these running sums; `before` is the sum ahead of it, and no start lies beyond."""
    n = len(sums)
    onward = np.searchsorted(sums, sums + threshold, side="left")
    end, number = np.where(onward < n, onward, np.arange(n)), (onward < n).astype(np.int64)
    while not (end[end] == end).all():  # twice as far in each turn
        end, number = end[end], number + number[end]
    first = np.arange(min(n, int(np.searchsorted(sums, before + threshold, side="left")) + 1))
    return _simplify(sums[first] - threshold, sums[end[first]], number[first] + 1)


def _ends(sums: np.ndarray, start: int, threshold: int) -> np.ndarray:
    """Places of the entries of a stretch that end a run, if one is open since `start` where it begins."""
    ends, i = [], int(np.searchsorted(sums, start + threshold, side="left"))
    while i < len(sums):
        ends.append(i)
        i = int(np.searchsorted(sums, sums[i] + threshold, side="left"))
    return np.array(ends, np.int64)


_FUNCTION = "up array<bigint>, out array<bigint>, jumps array<bigint>"
_lists = lambda f: [x.tolist() for x in f]
_arrays = lambda r: tuple(np.asarray(x, np.int64) for x in (r["up"], r["out"], r["jumps"]))


def _composed(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = tuple(np.zeros(0, np.int64) for _ in range(3))
    for _, row in rows.sort_values("stretch").iterrows():
        f = _compose(f, _arrays(row))
    return f


def _handed_down(rows: pd.DataFrame, start: int, run: int) -> pd.DataFrame:
    """The start and number of the run that is open where each stretch begins."""
    rows, out = rows.sort_values("stretch"), []
    for _, row in rows.iterrows():
        out.append((row["stretch"], start, run))
        start, more = _apply(*_arrays(row), start)
        run += more
    return pd.DataFrame(out, columns=["stretch", "start", "run"])


def _starts(functions: DataFrame, number: int, start: int = 0, run: int = 1) -> DataFrame:
    """(stretch, start, run) for each stretch; functions: (stretch, up, out, jumps), `number` of them from 0 without gaps."""
    if number <= FAN_IN:
        return functions.sparkSession.createDataFrame(_handed_down(functions.toPandas(), start, run), "stretch long, start long, run long")
    grouped = functions.withColumn("upper", F.floor(F.col("stretch") / FAN_IN))

    def rise(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *_lists(_composed(rows))]], columns=["stretch", "up", "out", "jumps"])

    above = _starts(grouped.groupBy("upper").applyInPandas(rise, f"stretch long, {_FUNCTION}"), -(-number // FAN_IN), start, run)
    met = grouped.join(above.select(F.col("stretch").alias("upper"), "start", "run"), "upper")
    return met.groupBy("upper").applyInPandas(lambda rows: _handed_down(rows, int(rows["start"].iloc[0]), int(rows["run"].iloc[0])), "stretch long, start long, run long")


def cut(log: DataFrame, threshold: int = THRESHOLD, rows_each: int | None = None, seq: str = "seq", run: str = "run") -> DataFrame:
    """log with the number of its run, from 1: entries in the order of seq fill a buffer that is flushed after the entry that brings it to
    `threshold` bytes. rows_each: seq numbers of a stretch, by default as many as hold about STRETCH buffers. seq: unique. Python sees seqs and sizes
    alone, a stretch at a time, and gives back the seqs that end a run; rows get their run from these by native functions."""
    if rows_each is None:
        seen = buffer_size(log).first()
        rows_each = min(STRETCH_ROWS, max(1, STRETCH * threshold * max(seen["entries"], 1) // max(seen["bytes"], 1)))
    place = F.floor(F.col(seq) / rows_each)
    slim = log.select(F.col(seq).alias("seq"), entry_bytes().alias("size"), place.alias("place"))
    totals = slim.groupBy("place").agg(F.sum("size").alias("total"))
    line = Window.orderBy("place")
    totals = totals.select("place", (F.row_number().over(line) - 1).cast("long").alias("stretch"), (F.sum("total").over(line) - F.col("total")).alias("before"))
    slim, number = slim.join(totals, "place"), totals.count()

    def steps(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, before = rows.sort_values("seq"), int(rows["before"].iloc[0])
        found = _steps(before + rows["size"].to_numpy(np.int64).cumsum(), before, threshold)
        return pd.DataFrame([[key[0], *_lists(found)]], columns=["stretch", "up", "out", "jumps"])

    def ended(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        sums = int(rows["before"].iloc[0]) + rows["size"].to_numpy(np.int64).cumsum()
        ends = rows["seq"].to_numpy(np.int64)[_ends(sums, int(rows["start"].iloc[0]), threshold)]
        return pd.DataFrame([[int(rows["place"].iloc[0]), int(rows["run"].iloc[0]), ends.tolist()]], columns=["place", "first", "ends"])

    starts = _starts(slim.groupBy("stretch").applyInPandas(steps, f"stretch long, {_FUNCTION}"), number)
    ends = slim.join(starts, "stretch").groupBy("stretch").applyInPandas(ended, "place long, first long, ends array<bigint>")
    ends = ends.select(F.col("place").alias("__place"), F.col("first").alias("__first"), F.col("ends").alias("__ends"))
    met = log.withColumn("__place", place).join(F.broadcast(ends) if number <= BROADCAST_STRETCHES else ends, "__place")
    before = F.size(F.filter("__ends", lambda e: e < F.col(seq)))
    return met.withColumn(run, (F.col("__first") + before).cast("long")).select(*(c for c in log.columns if c != run), run)
