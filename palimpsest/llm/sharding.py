"""Sharding: weighted rendezvous hashing of stable record keys, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, materialize, scratched

#: Rows of a shard that are numbered together.
BUCKET_ROWS = 50_000


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1), fixed by key and shard: 52 bits of an MD5 sum, exact in any engine."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the least -ln(u) / weight: each shard gets keys in proportion to its weight, and a shard more or a
    larger weight moves keys into that shard only. Weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("at least one shard, and positive weights")
    scores = [F.struct((-F.ln(_draw(key, n)) / F.lit(float(w))).alias("s"), F.lit(n).alias("n")) for n, w in enumerate(weights)]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["n"]


@scratched
def assign(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, size: Column | None = None, tie: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df with shard int, slot long (gapless from 0 in its shard) and, if `grown` weights are given, grown_shard int.

    The shard depends on the key's string form alone, so it is stable across runs; a null key counts as the key
    '\\\\N'. Slots number the rows of a shard by a hash bucket of key and ties, then key, then the `tie` columns; rows equal in all
    of them may swap slots. Buckets' counts are summed up, so a shard of any size is never sorted in one task; within a bucket equal rows are
    counted where they lie and numbered there, so neither is a key that a third of all rows repeat. Empty table: no rows. Columns named
    shard, slot or grown_shard are replaced.
    """
    shown = F.coalesce(F.col(key).cast("string"), F.lit("\\N"))
    df = df.drop("shard", "slot", "grown_shard")
    out = df.withColumn("shard", shard_of(shown, weights))
    if grown is not None:
        out = out.withColumn("grown_shard", shard_of(shown, grown))
    n_buckets = max(64, df.count() // (bucket_rows * len(weights)))
    spread = F.concat_ws(":", shown, *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in tie))
    out = out.withColumn("__bucket", F.conv(F.substring(F.md5(spread), 1, 8), 16, 10).cast("long") % n_buckets)
    # Places are fixed by writing them down: what is counted and what is numbered must agree, also after a task was run again.
    out = materialize(out.withColumn("__same", F.xxhash64(spread)).withColumn("__at", F.monotonically_increasing_id()), "placed")
    out = out.withColumn("__part", F.shiftright("__at", 33))
    alike = ["shard", "__bucket", "__same", "__part"]
    counts = out.groupBy(*alike).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in (key, *tie)))
    before = Window.partitionBy("shard", "__bucket").orderBy(key, *tie, "__same", "__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*alike, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    sizes = out.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(sizes.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from")), "buckets")
    out = out.withColumn("__row", F.row_number().over(Window.partitionBy(*alike).orderBy("__at"))).join(starts, alike).join(few(sizes), ["shard", "__bucket"])
    slot = (F.col("__from") + F.col("__start") + F.col("__row") - 1).cast("long")
    return out.select(*df.columns, "shard", *(["grown_shard"] if grown is not None else []), slot.alias("slot"))
