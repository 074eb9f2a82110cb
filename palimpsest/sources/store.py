"""A store: immutable sorted Parquet runs, Parquet segments of a write-ahead log, and versioned manifests that make both visible.

Order of writes: data first, then the manifest that names them. What no manifest names isn't there. One writer at a time: a manifest
number that is taken means that another wrote, and the write fails without effect.
"""

from __future__ import annotations

import base64
import json
import math
import uuid
from collections import Counter
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import log as reads
from ..operators import runs as cuts
from ..operators.log import LOG_SCHEMA
from .files import Files
from .runfile import Run, RunReader, read_logs, watched, write_run


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Config:
    path: str
    #: Bytes of unflushed versions at which a batch is flushed after it was written.
    threshold: int = cuts.THRESHOLD
    #: Bytes of a file of a run, about; Parquet codec; whether runs carry Bloom filters of their keys.
    file_bytes: int = 256 << 20
    compression: str = "snappy"
    bloom: bool = True
    #: Manifests, the current one included, whose files collect_garbage() leaves for frames that read them.
    keep: int = 10


#: Keys that are looked up by name; more are joined.
FEW_KEYS = 1000


@dataclass(frozen=True)
class Segment:
    path: str
    entries: int
    bytes: int
    max_seq: int
    #: Rows came with seqs of their own, so versions may be there twice.
    replayed: bool = False


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_seq: int = 1
    next_run: int = 1
    runs: tuple[Run, ...] = ()
    segments: tuple[Segment, ...] = ()
    marks: dict[str, int] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def load(text: str) -> Manifest:
        x = json.loads(text)
        return Manifest(**(x | {"runs": tuple(Run(**r) for r in x["runs"]), "segments": tuple(Segment(**s) for s in x["segments"])}))


class Store:
    """Reads are lazy DataFrames over the manifest that was current when they were made: no write changes or deletes what they read, only
    collect_garbage() does, `keep` manifests later. Writes are batches; put() and delete() are batches of one."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config, self.files = spark, config, Files(spark, config.path)
        for folder in ("manifest", "runs", "wal"):
            self.files.make(folder)
        self.manifest = self._newest()
        #: What this object has done: batches, flushes, compactions, entries written to the log and to runs.
        self.metrics: Counter[str] = Counter()

    @staticmethod
    def open(spark: SparkSession, path: str, **options) -> Store:
        """The store at `path`, made if it isn't there. Unflushed versions are those of the segments that the newest manifest names."""
        return Store(spark, Config(path, **options))

    def _newest(self) -> Manifest:
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        found = Manifest.load(self.files.read(f"manifest/{names[-1]}")) if names else Manifest()
        for part in (*found.runs, *found.segments):
            if not self.files.exists(part.path):
                raise FileNotFoundError(f"{self.config.path}/{part.path} is named by manifest {found.version} and isn't there")
        return found

    def refresh(self) -> Store:
        self.manifest = self._newest()
        return self

    def _commit(self, new: Manifest) -> None:
        new = replace(new, version=self.manifest.version + 1)
        if not self.files.write_new(f"manifest/{new.version:012d}.json", new.dump()):
            raise Conflict(f"manifest {new.version} is there already")
        self.manifest = new

    # Writes

    def put_batch(self, df: DataFrame, key: str = "key", value: str = "value", order: list[str] | None = None, mark: tuple[str, int] | None = None) -> tuple[int, int]:
        """Appends a version for each row and returns its first and last seq (last < first: no rows). A null value is refused, an empty one is
        kept. Seqs follow the `order` columns, else the rows' order in df. mark (name, number): nothing is written if a batch with this
        mark or a higher one was; so a batch that is sent again has no effect."""
        return self._append(df, key, value, order, mark, deletes=False)

    def write_batch(self, df: DataFrame, key: str = "key", value: str = "value", order: list[str] | None = None, mark: tuple[str, int] | None = None) -> tuple[int, int]:
        """As put_batch(), but a null value is a delete."""
        return self._append(df, key, value, order, mark, deletes=True)

    def delete_batch(self, df: DataFrame, key: str = "key", order: list[str] | None = None, mark: tuple[str, int] | None = None) -> tuple[int, int]:
        """Appends a tombstone for each row, whether or not the key was ever written."""
        return self._append(df, key, None, order, mark, deletes=True)

    def append_log(self, df: DataFrame, mark: tuple[str, int] | None = None) -> tuple[int, int]:
        """Appends rows (key, seq, value or null) with seqs of their own, as a replay does. The store's next seq is above them all."""
        kept = df.select(*(F.col(f.name).cast(f.dataType) for f in LOG_SCHEMA))
        return self._write(kept, mark, replayed=True)

    def put(self, key, value) -> int:
        return self.put_batch(self._one(key, value))[0]

    def delete(self, key) -> int:
        return self.delete_batch(self._one(key, None))[0]

    def _one(self, key, value) -> DataFrame:
        key, value = (x.encode() if isinstance(x, str) else x for x in (key, value))
        return self.spark.createDataFrame([(bytearray(key), None if value is None else bytearray(value))], "key binary, value binary")

    def _append(self, df: DataFrame, key: str, value: str | None, order: list[str] | None, mark: tuple[str, int] | None, deletes: bool) -> tuple[int, int]:
        picked = df.select(reads.as_bytes(key).alias("key"), (reads.as_bytes(value) if value else F.lit(None).cast("binary")).alias("value"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order or [])))
        if order:
            names = [f"__o{i}" for i in range(len(order))]
            picked = picked.repartitionByRange(*names).sortWithinPartitions(*names)
        # Rows are staged with (partition, place); the partitions' counts turn these into numbers without gaps.
        staged = f"wal/stage-{uuid.uuid4().hex}"
        picked.select("key", "value", F.monotonically_increasing_id().alias("__at")).write.parquet(f"{self.config.path}/{staged}")
        rows = self.spark.read.schema("key binary, value binary, __at long").parquet(f"{self.config.path}/{staged}")
        rows = rows.withColumn("__part", F.shiftright("__at", 33)).withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        counts = rows.groupBy("__part").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select("__part", before.alias("__before"))
        numbered = rows.join(F.broadcast(counts), "__part")  # a row for each task of the write
        null = F.col("key").isNull() if deletes else F.col("key").isNull() | F.col("value").isNull()
        numbered = numbered.withColumn("key", F.when(null, F.raise_error(F.lit("keys, and values that are put, must not be null"))).otherwise(F.col("key")))
        try:
            return self._write(numbered.select("key", (F.col("__before") + F.col("__place") + self.manifest.next_seq).alias("seq"), "value"), mark)
        finally:
            self.files.delete(staged)

    def _write(self, rows: DataFrame, mark: tuple[str, int] | None, replayed: bool = False) -> tuple[int, int]:
        old = self.manifest
        if mark and old.marks.get(mark[0], -1) >= mark[1]:
            return old.next_seq, old.next_seq - 1
        path = f"wal/{old.version + 1:012d}-{uuid.uuid4().hex}"
        rows, counted = watched(rows)
        rows.write.option("compression", self.config.compression).parquet(f"{self.config.path}/{path}")
        seen = counted.get
        marks = old.marks | ({mark[0]: mark[1]} if mark else {})
        if not seen["n"]:
            self.files.delete(path)
            if mark:
                self._commit(replace(old, marks=marks))
            return old.next_seq, old.next_seq - 1
        segment = Segment(path, seen["n"], seen["bytes"], seen["max_seq"], replayed)
        self.metrics.update(batches=1, entries_in_log=seen["n"])
        self._commit(replace(old, next_seq=max(old.next_seq, seen["max_seq"] + 1), segments=(*old.segments, segment), marks=marks))
        self.maybe_flush()
        return seen["min_seq"], seen["max_seq"]

    # Flush and upkeep

    def maybe_flush(self) -> bool:
        """Flushes if the unflushed versions have come to the threshold."""
        return sum(s.bytes for s in self.manifest.segments) >= self.config.threshold and self.flush()

    def flush(self) -> bool:
        """Writes the unflushed versions as a sorted run; without any, nothing is done. One shuffle; versions are looked through for repeated ones only
        if some came with seqs of their own."""
        old = self.manifest
        if not old.segments:
            return False
        rows = self._read([s.path for s in old.segments])
        if any(s.replayed for s in old.segments):
            rows = rows.dropDuplicates(["key", "seq"])
        new = self._write_run(rows, old.next_run, sum(s.bytes for s in old.segments))
        self._commit(replace(old, runs=(new, *old.runs), segments=(), next_run=old.next_run + 1))
        self.metrics["flushes"] += 1
        return True

    def _write_run(self, rows: DataFrame, number: int, size: int) -> Run:
        run = write_run(rows, self.config.path, f"runs/{number:012d}-{uuid.uuid4().hex}", number, size, self.config.file_bytes, self.config.compression, self.config.bloom)
        self.metrics["entries_in_runs"] += run.entry_count
        return run

    def compact(self, runs: list[int] | None = None) -> Run | None:
        """Puts runs (all by default) together as one with the newest versions only. Tombstones go only if these are all runs and nothing is
        unflushed: else they still hide older versions."""
        old = self.manifest
        chosen = [r for r in old.runs if runs is None or r.id in runs]
        if not chosen:
            return None
        whole = len(chosen) == len(old.runs) and not old.segments
        new = self._write_run(reads.compact(self._read([r.path for r in chosen]), whole), old.next_run, sum(r.bytes for r in chosen))
        if not new.entry_count:
            self.files.delete(new.path)
            new = None
        self._commit(replace(old, runs=(*([new] if new else []), *(r for r in old.runs if r not in chosen)), next_run=old.next_run + 1))
        self.metrics["compactions"] += 1
        return new

    def compact_tiers(self, fan: int = 4) -> int:
        """Puts together runs of like size, `fan` or more, tier by tier, until no tier has so many; returns how often. Each version is
        rewritten about once a tier, not once a flush."""
        done = 0
        while True:
            tiers: dict[int, list[int]] = {}
            for r in self.manifest.runs:
                tiers.setdefault(int(math.log(max(r.bytes, 1), fan)), []).append(r.id)
            full = next((ids for _, ids in sorted(tiers.items()) if len(ids) >= fan), None)
            if full is None:
                return done
            self.compact(full)
            done += 1

    def _named(self) -> dict[str, Manifest]:
        """The manifests by name, oldest first."""
        return {n: Manifest.load(self.files.read(f"manifest/{n}")) for n in self.files.names("manifest") if n.endswith(".json")}

    def collect_garbage(self, keep: int | None = None) -> list[str]:
        """Deletes all manifests but the newest `keep` (by default the configuration's), and what none of them names: runs and segments that were
        replaced, remains of writes that failed. Frames made from the kept ones still work. Not while another writes."""
        kept = dict(list(self._named().items())[-max(1, self.config.keep if keep is None else keep) :])
        named = {p.path for m in kept.values() for p in (*m.runs, *m.segments)}
        gone = [f"{d}/{n}" for d in ("runs", "wal") for n in self.files.names(d) if f"{d}/{n}" not in named]
        gone += [f"manifest/{n}" for n in self.files.names("manifest") if n not in kept]
        for name in gone:
            self.files.delete(name)
        return gone

    # Reads

    def _read(self, paths: list[str]) -> DataFrame:
        return read_logs(self.spark, [f"{self.config.path}/{p}" for p in paths])

    def log(self, low: bytes | None = None, high: bytes | None = None, through: int | None = None) -> DataFrame:
        """All versions, of runs that may hold keys from low to below high and seqs up to `through`."""
        runs = [r.path for r in self.manifest.runs if r.overlaps(low, high) and (through is None or r.min_seq <= through)]
        return self._read([*runs, *(s.path for s in self.manifest.segments)])

    def buffer(self) -> DataFrame:
        """Unflushed versions."""
        return self._read([s.path for s in self.manifest.segments])

    def run(self, number: int) -> DataFrame:
        return self.reader(number).scan()

    def reader(self, number: int) -> RunReader:
        return RunReader(self.spark, self.config.path, next(r for r in self.manifest.runs if r.id == number))

    def runs(self) -> DataFrame:
        """Run metadata, newest run first."""
        rows = [(r.id, r.entry_count, bytearray(base64.b64decode(r.min_key)), bytearray(base64.b64decode(r.max_key)), r.min_seq, r.max_seq, r.bytes) for r in sorted(self.manifest.runs, key=lambda r: -r.id)]
        return self.spark.createDataFrame(rows, "run long, entry_count long, min_key binary, max_key binary, min_seq long, max_seq long, bytes long")

    def _with_key(self, key: bytes) -> DataFrame:
        runs = [r.path for r in self.manifest.runs if r.might_contain(key)]
        return self._read([*runs, *(s.path for s in self.manifest.segments)])

    def get(self, key) -> bytes | None:
        """The newest value, or None for a key that is deleted or was never written."""
        key = key.encode() if isinstance(key, str) else bytes(key)
        found = reads.get(self._with_key(key), bytearray(key)).collect()
        return bytes(found[0].value) if found else None

    def get_all(self, key) -> DataFrame:
        key = key.encode() if isinstance(key, str) else bytes(key)
        return reads.get_all(self._with_key(key), bytearray(key))

    def multi_get(self, keys: DataFrame, key: str = "key") -> DataFrame:
        """As the function of this name. Keys are counted first, with their range: a few are looked for by name in the runs whose range fits one of them,
        many in the runs that overlap their range."""
        own = keys.select(F.col(key).cast("binary").alias("key")).where("key is not null")
        seen = own.agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).first()
        if seen.n > FEW_KEYS:
            low, high = bytes(seen.low), bytes(seen.high) + b"\0"
            return reads.multi_get(reads.between(self.log(low, high), bytearray(low), bytearray(high)), keys, key)
        wanted = sorted({bytes(r.key) for r in own.collect()})
        runs = [r.path for r in self.manifest.runs if any(map(r.might_contain, wanted))]
        log = self._read([*runs, *(s.path for s in self.manifest.segments)]) if wanted else self._read([])
        return reads.multi_get(log.where(F.col("key").isin([bytearray(k) for k in wanted])) if wanted else log, keys, key)

    def scan(self) -> DataFrame:
        return reads.scan(self.log())

    def scan_latest(self) -> DataFrame:
        return reads.latest(self.log())

    def scan_live(self) -> DataFrame:
        return reads.live(self.log())

    def range_live(self, low=None, high=None) -> DataFrame:
        low, high = (x.encode() if isinstance(x, str) else x for x in (low, high))
        bound = lambda x: None if x is None else bytearray(x)
        return reads.range_live(self.log(low, high), bound(low), bound(high))

    def as_of(self, seq: int) -> DataFrame:
        """Live rows when `seq` was the newest number. Only as far back as compaction has kept versions."""
        return reads.as_of(self.log(through=seq), seq)

    def stats(self) -> dict[str, int]:
        m = self.manifest
        buffered = sum(s.entries for s in m.segments)
        return {"memtable_entries": buffered, "memtable_bytes": sum(s.bytes for s in m.segments), "runs": len(m.runs), "total_entries": buffered + sum(r.entry_count for r in m.runs), "next_seq": m.next_seq, "manifest": m.version}
