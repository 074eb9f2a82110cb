"""Change streams into a store, and the latest state of a stream. Order of arrival doesn't matter: seq decides."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.log import LOG_SCHEMA
from ..sources.store import Store


def log_stream(spark: SparkSession, path: str, files_each: int = 64) -> DataFrame:
    """Log rows of Parquet files as they appear in a folder."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_each).parquet(path)


def ingest(stream: DataFrame, store: Store, name: str, checkpoint: str, numbered: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Appends each micro-batch to the store once: the store remembers the last batch of `name`, so one that comes again after a restart has
    no effect. numbered: rows have seqs of their own; else they get new ones, and null values are deletes."""

    def write(batch: DataFrame, number: int) -> None:
        store.refresh()
        append = store.append_log if numbered else store.write_batch
        append(batch, mark=(name, number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_state(stream: DataFrame) -> DataFrame:
    """The newest version of each key as a streaming aggregate, tombstones included: without them a late older put would bring a key back."""
    newest = F.max_by(F.struct("seq", "value"), "seq").alias("s")
    return stream.groupBy("key").agg(newest).select("key", "s.seq", "s.value")


class Newest(StatefulProcessor):
    """Per key: emits a version if it's newer than all before. For transformWithStateInPandas with the RocksDB state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.newest.get()[0] if self.newest.exists() else -1
        best = None
        for frame in rows:
            row = frame.loc[frame["seq"].idxmax()]
            if row["seq"] > held:
                held, best = int(row["seq"]), row
        if best is not None:
            self.newest.update((held,))
            yield pd.DataFrame([[key[0], held, best["value"]]], columns=["key", "seq", "value"])

    def close(self) -> None:
        pass


def newest_changes(stream: DataFrame) -> DataFrame:
    """A stream of the versions that were the newest of their key when they came."""
    return stream.groupBy("key").transformWithStateInPandas(Newest(), "key binary, seq long, value binary", "Update", "None")
