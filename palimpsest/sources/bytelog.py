"""Byte logs: files of records one after the other, as a sink and a source, and typed rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.codec import decode_rows, encode_record, encode_rows, read_records
from ..operators.log import LOG_SCHEMA


def to_bytes(log: DataFrame, rows_each: int = 100_000, per: str = "part") -> DataFrame:
    """(part, data): the log as byte logs of `rows_each` seq numbers, records in the order of seq. Bounded by rows_each, not by a file."""
    coded = log.select(F.floor(F.col("seq") / rows_each).alias(per), F.struct("seq", encode_record().alias("data")).alias("r"))
    lists = coded.groupBy(per).agg(F.sort_array(F.collect_list("r")).alias("r"))
    return lists.select(per, F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["data"])), "")).alias("data"))


def from_bytes(df: DataFrame, data: str = "data") -> DataFrame:
    """The log in byte logs, one a row, decoded in parallel. A record that a file cuts short at its end is left out; an unknown kind of
    record fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                found = read_records(x.as_py() or b"")[0]
                for k in range(0, len(found), 10_000):
                    key, seq, value = zip(*found[k : k + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(seq, pa.int64()), pa.array(value, pa.binary())], LOG_SCHEMA.fieldNames())

    return df.select(data).mapInArrow(run, LOG_SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The log in the files of byte logs at `path`, which any Hadoop file system may hold."""
    return from_bytes(spark.read.format("binaryFile").load(path), "content")


def replay(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The log of byte logs and the seq that comes next."""
    log = read_files(spark, path)
    return log, (log.agg(F.max("seq")).first()[0] or 0) + 1


class ByteLogSource(DataSource):
    """spark.read.format("palimpsest_log").load(path): byte logs of a folder on a file system that all workers mount, a task a file."""

    @classmethod
    def name(cls) -> str:
        return "palimpsest_log"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in LOG_SCHEMA])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        import os

        if os.path.isfile(self.path):
            return [InputPartition(self.path)]
        return [InputPartition(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if not n.startswith((".", "_"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from read_records(f.read())[0]


def write_rows(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Typed rows as a Parquet table of one binary column."""
    encode_rows(df, columns, "data").select("data").write.parquet(path)


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return decode_rows(spark.read.schema("data binary").parquet(path), schema).select(*schema.fieldNames())
