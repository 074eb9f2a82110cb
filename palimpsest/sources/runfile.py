"""Runs: sorted, immutable Parquet folders, and what is known about them without reading them."""

from __future__ import annotations

import base64
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import log as reads
from ..operators import runs as cuts
from ..operators.log import LOG_SCHEMA


@dataclass(frozen=True)
class Run:
    """Keys are in base64, as manifests hold them. An empty run has empty keys and seqs 0."""

    id: int
    path: str
    entry_count: int
    min_key: str
    max_key: str
    min_seq: int
    max_seq: int
    bytes: int

    def might_contain(self, key: bytes) -> bool:
        """Whether the key lies in the run's range, ends included."""
        return self.entry_count > 0 and base64.b64decode(self.min_key) <= key <= base64.b64decode(self.max_key)

    def overlaps(self, low: bytes | None, high: bytes | None) -> bool:
        """Whether it may hold keys with low <= key < high."""
        return self.entry_count > 0 and (low is None or base64.b64decode(self.max_key) >= low) and (high is None or base64.b64decode(self.min_key) < high)


def read_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The versions in folders of Parquet files."""
    return spark.read.schema(LOG_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], LOG_SCHEMA)


def watched(log: DataFrame) -> tuple[DataFrame, Observation]:
    """A log that counts what it's written with: entries, smallest and largest key and seq, bytes; to be read from the observation after the write."""
    seen = Observation()
    found = (F.count(F.lit(1)).alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.sum(cuts.entry_bytes()).alias("bytes"))
    return log.observe(seen, *found), seen


def write_run(rows: DataFrame, root: str, name: str, number: int, size: int, file_bytes: int = 256 << 20, compression: str = "snappy", bloom: bool = True) -> Run:
    """Writes a log of about `size` bytes as run `number` to root/name, in any order given, and returns its metadata, counted while it's written."""
    # By key and seq, so that a key with very many versions is spread over files too.
    order = (F.asc("key"), F.desc("seq"))
    rows, seen = watched(rows.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order))
    writer = rows.write.option("compression", compression)
    if bloom:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true")
    writer.parquet(f"{root}/{name}")
    found = seen.get
    if not found["n"]:
        return Run(number, name, 0, "", "", 0, 0, 0)
    text = lambda b: base64.b64encode(bytes(b)).decode()
    return Run(number, name, found["n"], text(found["min_key"]), text(found["max_key"]), found["min_seq"], found["max_seq"], found["bytes"])


class RunReader:
    """One run, opened by its metadata."""

    def __init__(self, spark: SparkSession, root: str, run: Run):
        self.spark, self.root, self.run = spark, root, run

    def scan(self) -> DataFrame:
        """All versions; ordered by what reads them, if order matters."""
        return read_logs(self.spark, [f"{self.root}/{self.run.path}"])

    def get_all(self, key: bytes) -> DataFrame:
        """Versions of a key, newest first. A run that can't hold the key isn't opened."""
        log = self.scan() if self.run.might_contain(bytes(key)) else read_logs(self.spark, [])
        return reads.get_all(log, bytearray(key))
