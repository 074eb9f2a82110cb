"""Reads of a log: every one is lazy, and the newest version of a key is decided by seq alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One version of a key; a null value is a tombstone, an empty value is a value.
LOG_SCHEMA = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("value", T.BinaryType(), True)])
#: Bytes that a version costs besides its key and value.
OVERHEAD = 24


def as_bytes(column: Column | str) -> Column:
    """A key or value as bytes: strings as UTF-8, binary as it is."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def ordered_key(number: Column | str) -> Column:
    """A whole number as 8 bytes that sort like the number: big-endian, sign bit flipped."""
    number = (F.col(number) if isinstance(number, str) else number).cast("long")
    return F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def entries(df: DataFrame, key: Column | str, seq: Column | str, value: Column | str | None) -> DataFrame:
    """df as a log. value None: tombstones only."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return df.select(as_bytes(key).alias("key"), seq.cast("long").alias("seq"), (as_bytes(value) if value is not None else F.lit(None).cast("binary")).alias("value"))


def is_tombstone() -> Column:
    return F.col("value").isNull()


def merge(*logs: DataFrame) -> DataFrame:
    """All versions of all logs; equal (key, seq) are all kept, in no order."""
    out, *rest = logs
    for log in rest:
        out = out.unionByName(log)
    return out


def scan(log: DataFrame) -> DataFrame:
    """Every version, tombstones included, in the log's order: key ascending by unsigned bytes, seq descending."""
    return log.orderBy(F.asc("key"), F.desc("seq"))


def versions_before(log: DataFrame, seq: int) -> DataFrame:
    """The log as it was when `seq` was the newest number: applied below the choice of versions."""
    return log.where(F.col("seq") <= seq)


def latest(log: DataFrame, key: str = "key") -> DataFrame:
    """The newest version of each key, tombstones included. A predicate on the key is pushed below this; the top row a
    partition is chosen before the shuffle too, so a key with many versions sends one row a task."""
    newest = Window.partitionBy(key).orderBy(F.desc("seq"))
    return log.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def live(log: DataFrame, key: str = "key") -> DataFrame:
    """The newest version of each key, without keys whose newest version is a tombstone: that is tested last."""
    return latest(log, key).where(~is_tombstone())


def get(log: DataFrame, key) -> DataFrame:
    """No row or one (value): of the newest version of a key that isn't deleted."""
    return log.where(F.col("key") == F.lit(key)).orderBy(F.desc("seq")).limit(1).where(~is_tombstone()).select("value")


def get_all(log: DataFrame, key) -> DataFrame:
    """Every version of a key, tombstones included, newest first."""
    return log.where(F.col("key") == F.lit(key)).orderBy(F.desc("seq"))


def multi_get(log: DataFrame, keys: DataFrame, key: str = "key", state: str = "state") -> DataFrame:
    """keys with seq, value and state: 'absent' (never written), 'deleted' or 'value'. One row for each row of keys; null keys are absent."""
    wanted = latest(log.join(keys.select(F.col(key).alias("key")).where("key is not null").distinct(), "key", "left_semi"))
    found = wanted.select(F.col("key").alias("__key"), "seq", "value")
    out = keys.drop("seq", "value", state).join(found, F.col(key) == F.col("__key"), "left")
    return out.withColumn(state, F.when(F.col("__key").isNull(), "absent").when(F.col("value").isNull(), "deleted").otherwise("value")).drop("__key")


def between(log: DataFrame, low=None, high=None) -> DataFrame:
    """Versions with low <= key < high; None is no bound. Below every choice of versions."""
    if low is not None:
        log = log.where(F.col("key") >= F.lit(low))
    return log if high is None else log.where(F.col("key") < F.lit(high))


def range_live(log: DataFrame, low=None, high=None) -> DataFrame:
    return live(between(log, low, high))


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """Live rows of the snapshot at `seq`."""
    return live(versions_before(log, seq))


def key_history(log: DataFrame) -> DataFrame:
    """For each key its versions, its tombstones, and its smallest and largest seq."""
    return log.groupBy("key").agg(F.count("*").alias("n"), F.count_if(is_tombstone()).alias("tombstones"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def compact(log: DataFrame, whole: bool) -> DataFrame:
    """The newest versions. whole: the log is all there is, so tombstones have nothing left to hide and go too."""
    return live(log) if whole else latest(log)
