"""Queries over the test tables and the same in DuckDB's SQL.

The canonical log is made of the events: key = user_id as text, seq = event_id + 1, value = props, null (deleted) for errors. Keys and
values are shown as text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec
from ..operators import log as reads
from ..operators import runs as cuts
from ..sources import bytelog
from ..sources.buffer import Buffer
from ..sources.scratch import scratch_dir
from ..sources.store import Store

#: Bytes of a run in the queries that cut the log, so that small tables give many runs.
RUN_BYTES = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") != "error", F.col("props"))
    return reads.entries(events, F.col("user_id").cast("string"), F.col("event_id") + 1, value)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return reads.entries(orders, F.col("o_custkey").cast("string"), F.col("o_orderkey") + 1, F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")))


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.entries(table(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), F.col("doc_id") + 1, "text")


def shown(df: DataFrame) -> DataFrame:
    """Keys and values as text, k and v."""
    names = {"key": "k", "value": "v", "min_key": "min_k", "max_key": "max_k"}
    return df.select(*(F.col(c).cast("string").alias(names[c]) if c in names else F.col(c) for c in df.columns))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.cut(events_log(spark, sf_dir), RUN_BYTES)


def scan(spark, sf_dir):
    return shown(reads.merge(events_log(spark, sf_dir)))


def scan_latest(spark, sf_dir):
    return shown(reads.latest(events_log(spark, sf_dir)))


def scan_live(spark, sf_dir):
    return shown(reads.live(events_log(spark, sf_dir)))


def scan_live_orders(spark, sf_dir):
    return shown(reads.live(orders_log(spark, sf_dir)))


def scan_live_documents(spark, sf_dir):
    return shown(reads.live(documents_log(spark, sf_dir))).select("k", "seq", F.octet_length("v").alias("bytes"))


def get(spark, sf_dir):
    return shown(reads.get(events_log(spark, sf_dir), bytearray(b"13")))


def get_all(spark, sf_dir):
    return shown(reads.get_all(events_log(spark, sf_dir), bytearray(b"13")))


def get_deleted(spark, sf_dir):
    return shown(reads.get(events_log(spark, sf_dir), bytearray(b"4")))


def range_live(spark, sf_dir):
    return shown(reads.range_live(events_log(spark, sf_dir), bytearray(b"12"), bytearray(b"2")))


def multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").cast("binary").alias("key"))
    return shown(reads.multi_get(events_log(spark, sf_dir), keys))


def as_of(spark, sf_dir):
    return shown(reads.as_of(events_log(spark, sf_dir), 5000))


def versions(spark, sf_dir):
    return shown(reads.key_history(events_log(spark, sf_dir)))


def merge_runs(spark, sf_dir):
    log = _runs(spark, sf_dir)
    return shown(reads.merge(log.where("run <= 40").drop("run"), log.where("run > 40").drop("run")))


def merge_duplicates(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return shown(reads.merge(log, log.where("seq % 10 = 0"))).groupBy("k", "seq", "v").agg(F.count("*").alias("n"))


def latest_of_merged_runs(spark, sf_dir):
    log = _runs(spark, sf_dir)
    return shown(reads.live(reads.merge(log.where("run % 2 = 0").drop("run"), log.where("run % 2 = 1").drop("run"))))


def compact_part(spark, sf_dir):
    """Part of the runs: tombstones stay."""
    return shown(reads.compact(_runs(spark, sf_dir).where("run <= 40").drop("run"), whole=False))


def compact_whole(spark, sf_dir):
    return shown(reads.compact(events_log(spark, sf_dir), whole=True))


def memtable_size(spark, sf_dir):
    return cuts.buffer_size(events_log(spark, sf_dir))


def flush_runs(spark, sf_dir):
    return shown(_runs(spark, sf_dir).withColumn("sz", cuts.entry_bytes()))


def run_meta(spark, sf_dir):
    return shown(cuts.run_meta(_runs(spark, sf_dir)))


def stats(spark, sf_dir):
    return cuts.stats(cuts.run_meta(_runs(spark, sf_dir)), RUN_BYTES)


def zone_map_prune(spark, sf_dir):
    return shown(cuts.might_contain(cuts.run_meta(_runs(spark, sf_dir)), bytearray(b"99"))).select("run", "min_k", "max_k")


def run_order(spark, sf_dir):
    """The newest three runs."""
    return cuts.run_meta(_runs(spark, sf_dir)).orderBy(F.desc("run")).limit(3).select("run", "entry_count")


def tombstones(spark, sf_dir):
    return shown(events_log(spark, sf_dir).where(reads.is_tombstone())).select("k", "seq")


def key_order(spark, sf_dir):
    """Place of each live key in byte order, and in the order of its number."""
    keys = shown(reads.live(events_log(spark, sf_dir))).select("k")
    from pyspark.sql import Window

    return keys.select("k", F.row_number().over(Window.orderBy(F.col("k").cast("binary"))).alias("by_bytes"), F.row_number().over(Window.orderBy(reads.ordered_key(F.col("k")))).alias("by_number"))


def varint(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n")).union(table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 37).alias("n")))
    return parts.select("n", F.lower(F.hex(codec.varint(F.col("n")))).alias("hex"), codec.varint_len(F.col("n")).alias("bytes")).distinct()


def varint_roundtrip(spark, sf_dir):
    numbers = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 982451653).alias("n"))
    return codec.decode_varints(numbers.select("n", codec.varint(F.col("n")).alias("data"))).select("n", "number")


def serialized_size(spark, sf_dir):
    return shown(events_log(spark, sf_dir).select("key", "seq", codec.entry_size().alias("bytes")))


def entry_encode(spark, sf_dir):
    return events_log(spark, sf_dir).select("seq", F.hex(codec.encode_entry()).alias("hex"))


def entry_encode_documents(spark, sf_dir):
    return documents_log(spark, sf_dir).select("seq", F.hex(codec.encode_entry()).alias("hex"))


def entry_decode(spark, sf_dir):
    coded = events_log(spark, sf_dir).select(codec.encode_entry().alias("data"))
    return shown(codec.decode_entries(coded).select("key", "seq", "value"))


def wal_encode(spark, sf_dir):
    return events_log(spark, sf_dir).select("seq", F.hex(codec.encode_record()).alias("hex"))


def wal_replay(spark, sf_dir):
    return shown(bytelog.from_bytes(bytelog.to_bytes(events_log(spark, sf_dir), 1000)))


TYPED = T.StructType().add("p_partkey", "long").add("p_name", "string").add("p_size", "integer").add("p_retailprice", "double").add("cheap", "boolean").add("maybe", "integer")


def _typed(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", "p_name", "p_size", "p_retailprice", (F.col("p_retailprice") < 1000).alias("cheap"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("maybe"))


def tuple_roundtrip(spark, sf_dir):
    coded = codec.encode_rows(_typed(spark, sf_dir)).select("data")
    return codec.decode_rows(coded, TYPED).select(*TYPED.fieldNames())


def tuple_encode(spark, sf_dir):
    """Rows of whole numbers, the middle one null for some."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("b"), F.col("c_nationkey").alias("c"))
    return codec.encode_rows(rows).select("a", F.hex("data").alias("hex"))


def tuple_field(spark, sf_dir):
    coded = codec.encode_rows(_typed(spark, sf_dir)).select("p_partkey", "data")
    return codec.read_field(coded, TYPED, "maybe").select("p_partkey", "maybe")


# The life of a store


def _store(spark: SparkSession, **options) -> Store:
    """A new store in the scratch folder."""
    return Store.open(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}", **{"threshold": 1 << 40} | options)


def _batches(spark: SparkSession, sf_dir: str, parts: int) -> list[DataFrame]:
    """The canonical log's rows without their seqs, in so many batches."""
    log = events_log(spark, sf_dir)
    last = log.agg(F.max("seq")).first()[0] or 0
    cuts_at = [last * i // parts for i in range(parts + 1)]
    return [log.where((F.col("seq") > a) & (F.col("seq") <= b)) for a, b in zip(cuts_at[:-1], cuts_at[1:], strict=True)]


def _filled(spark: SparkSession, sf_dir: str, parts: int, flush: bool) -> Store:
    store = _store(spark)
    for batch in _batches(spark, sf_dir, parts):
        store.write_batch(batch, order=["seq"])
        if flush:
            store.flush()
    return store


def store_flush_reopen(spark, sf_dir):
    """Puts and deletes in batches, each flushed to a run, read by a store that is opened anew."""
    return shown(Store.open(spark, _filled(spark, sf_dir, 2, True).config.path).scan())


def store_recover(spark, sf_dir):
    """Unflushed batches after a crash: a run was written, the manifest that names it wasn't."""
    store = _filled(spark, sf_dir, 2, False)
    store._write_run(store.buffer(), 1, 1 << 20)
    again = Store.open(spark, store.config.path)
    again.collect_garbage()
    return shown(again.buffer())


def store_threshold(spark, sf_dir):
    """Batches fill the buffer up to the threshold, which one flushes."""
    first, *_ = batches = _batches(spark, sf_dir, 4)
    store = _store(spark, threshold=cuts.buffer_size(first.union(batches[1])).first()["bytes"])
    for batch in batches[:3]:
        store.write_batch(batch, order=["seq"])
    stats = Store.open(spark, store.config.path).stats()
    return spark.createDataFrame([(stats["runs"], stats["total_entries"], stats["memtable_entries"], stats["next_seq"])], "runs long, total_entries long, memtable_entries long, next_seq long")


def store_delete(spark, sf_dir):
    """All customers are put, some deleted, some of these put again, with flushes between."""
    store, customers = _store(spark), table(spark, sf_dir, "customer")
    store.put_batch(customers.withColumn("k", F.col("c_custkey").cast("string")), key="k", value="c_name", order=["c_custkey"])
    store.flush()
    store.delete_batch(customers.where("c_nationkey < 10").withColumn("k", F.col("c_custkey").cast("string")), key="k", order=["c_custkey"])
    store.flush()
    store.put_batch(customers.where("c_nationkey < 3").selectExpr("c_custkey", "cast(c_custkey as string) k", "'again' v"), key="k", value="v", order=["c_custkey"])
    return shown(store.scan_live())


def store_compact(spark, sf_dir):
    """All runs put together as one: the newest versions, no tombstones."""
    store = _filled(spark, sf_dir, 4, True)
    run = store.compact()
    return shown(store.run(run.id))


def store_snapshot(spark, sf_dir):
    """A frame from before a flush and a compaction, read after them."""
    store = _filled(spark, sf_dir, 1, False)
    before = store.scan()
    store.flush()
    store.compact()
    return shown(before)


def store_runs(spark, sf_dir):
    """What is known of the runs of a store that is opened anew, newest first."""
    return shown(Store.open(spark, _filled(spark, sf_dir, 3, True).config.path).runs())


def run_get(spark, sf_dir):
    """Every version of a key in one run."""
    return shown(_filled(spark, sf_dir, 2, True).reader(1).get_all(b"13"))


def store_lookup(spark, sf_dir):
    """Many keys at once, from runs and unflushed batches."""
    store = _filled(spark, sf_dir, 2, True)
    store.delete("13")
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").cast("binary").alias("key"))
    return shown(store.multi_get(keys))


def buffer_rows(spark, sf_dir):
    """A buffer's rows after puts, overwrites and deletes of the nations."""
    nations, buffer = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect(), Buffer()
    for r in nations:
        buffer.put(r.n_name, str(r.n_nationkey))
    for r in nations:
        if r.n_regionkey == 1:
            buffer.delete(r.n_name)
    for r in nations:
        if r.n_nationkey % 7 == 0:
            buffer.put_with_seq(r.n_name, "late", 100 + r.n_nationkey)
    return shown(buffer.log(spark))


def typed_files(spark, sf_dir):
    """Typed rows written to files and read back."""
    path = f"{scratch_dir(spark)}/typed-{uuid.uuid4().hex}"
    bytelog.write_rows(_typed(spark, sf_dir), path)
    return bytelog.read_rows(spark, path, TYPED)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: live rows."""
    return scan_live(spark, sf_dir)


_ALL = (
    scan, scan_latest, scan_live, scan_live_orders, scan_live_documents, get, get_all, get_deleted, range_live, multi_get, as_of, versions, merge_runs, merge_duplicates, latest_of_merged_runs, compact_part, compact_whole,
    memtable_size, flush_runs, run_meta, stats, zone_map_prune, run_order, tombstones, key_order, varint, varint_roundtrip, serialized_size, entry_encode, entry_encode_documents, entry_decode, wal_encode, wal_replay,
    tuple_roundtrip, tuple_encode, tuple_field, store_flush_reopen, store_recover, store_threshold, store_delete, store_compact, store_snapshot, store_runs, run_get, store_lookup, buffer_rows, typed_files,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


# DuckDB

LOG = "log as (select cast(user_id as varchar) k, event_id + 1 seq, case when event_type = 'error' then null else props end v from events)"
DOCS = "log as (select cast(doc_id as varchar) k, doc_id + 1 seq, text v from documents)"
ORDERS = "log as (select cast(o_custkey as varchar) k, o_orderkey + 1 seq, case when o_orderstatus = 'F' then null else o_orderstatus end v from orders)"
SIZE = "strlen(k) + coalesce(strlen(v), 0) + 24"
#: The buffer's rule, entry by entry; needs seqs from 1 without gaps.
RUNS = f"""{LOG}, sized as (select k, seq, v, {SIZE} sz from log),
cut(k, seq, v, sz, run, acc) as (
  select k, seq, v, sz, 1, sz from sized where seq = 1
  union all
  select s.k, s.seq, s.v, s.sz, case when c.acc >= {RUN_BYTES} then c.run + 1 else c.run end, case when c.acc >= {RUN_BYTES} then s.sz else c.acc + s.sz end
  from cut c join sized s on s.seq = c.seq + 1),
meta as (select run, count(*) entry_count, min(k) min_k, max(k) max_k, min(seq) min_seq, max(seq) max_seq, sum(sz) bytes from cut group by run)"""


def _newest(of: str, where: str = "") -> str:
    return f"select k, seq, v from (select *, row_number() over (partition by k order by seq desc) n from {of}) where n = 1{where}"


def _hex_byte(n: str) -> str:
    return f"lpad(to_hex({n}), 2, '0')"


def _hex_varint(n: str, most: int) -> str:
    """Of numbers below 2^(7 most)."""
    cases = []
    for size in range(1, most + 1):
        parts = [_hex_byte(f"((cast({n} as bigint) >> {7 * i}) & 127)" + (" | 128" if i < size - 1 else "")) for i in range(size)]
        cases.append(f"when {n} < {1 << 7 * size} then concat({', '.join(parts)}, '')")
    return f"(case {' '.join(cases)} end)"


def _hex_little(n: str, size: int) -> str:
    return "concat(" + ", ".join(_hex_byte(f"(cast({n} as bigint) >> {8 * i}) & 255") for i in range(size)) + ")"


def _varint_len(n: str) -> str:
    return f"(case when {n} < 128 then 1 when {n} < 16384 then 2 when {n} < 2097152 then 3 else 4 end)"


ENTRY = f"upper(concat({_hex_varint('strlen(k)', 4)}, hex(k), {_hex_little('seq', 8)}, case when v is null then '01' else concat('00', {_hex_varint('strlen(v)', 4)}, hex(v)) end))"
RECORD = f"upper(concat(case when v is null then '02' else '01' end, {_hex_little('seq', 8)}, {_hex_little('strlen(k)', 4)}, hex(k), case when v is null then '' else concat({_hex_little('strlen(v)', 4)}, hex(v)) end))"
TYPED_SQL = "select p_partkey, p_name, p_size, p_retailprice, p_retailprice < 1000 cheap, case when p_size % 3 <> 0 then p_size end maybe from part"


#: The part of the log that each of n batches takes.
def _batched(n: int) -> str:
    return f"{LOG}, top as (select max(seq) m from log), batched as (select *, (select count(*) from range(1, {n}) r(i) where seq > m * i // {n}) + 1 run from log, top)"


def oracle_sql() -> dict[str, str]:
    return {
        "scan": f"with {LOG} select * from log",
        "scan_latest": f"with {LOG} {_newest('log')}",
        "scan_live": f"with {LOG} {_newest('log', ' and v is not null')}",
        "scan_live_orders": f"with {ORDERS} {_newest('log', ' and v is not null')}",
        "scan_live_documents": f"with {DOCS} select k, seq, strlen(v) bytes from ({_newest('log', ' and v is not null')})",
        "get": f"with {LOG} select v from ({_newest('log')}) where k = '13' and v is not null",
        "get_all": f"with {LOG} select * from log where k = '13'",
        "get_deleted": f"with {LOG} select v from ({_newest('log')}) where k = '4' and v is not null",
        "range_live": f"with {LOG} select * from ({_newest('log')}) where k >= '12' and k < '2' and v is not null",
        "multi_get": f"with {LOG} select cast(c_custkey as varchar) k, seq, v, case when l.k is null then 'absent' when v is null then 'deleted' else 'value' end state from customer left join ({_newest('log')}) l on cast(c_custkey as varchar) = l.k",
        "as_of": f"with {LOG} {_newest('(select * from log where seq <= 5000)', ' and v is not null')}",
        "versions": f"with {LOG} select k, count(*) n, count(*) filter (v is null) tombstones, min(seq) min_seq, max(seq) max_seq from log group by k",
        "merge_runs": f"with {LOG} select * from log",
        "merge_duplicates": f"with {LOG} select k, seq, v, case when seq % 10 = 0 then 2 else 1 end n from log",
        "latest_of_merged_runs": f"with {LOG} {_newest('log', ' and v is not null')}",
        "compact_part": f"with recursive {RUNS} {_newest('(select k, seq, v from cut where run <= 40)')}",
        "compact_whole": f"with {LOG} {_newest('log', ' and v is not null')}",
        "memtable_size": f"with {LOG} select count(*) entries, sum({SIZE}) bytes from log",
        "flush_runs": f"with recursive {RUNS} select k, seq, v, sz, run from cut",
        "run_meta": f"with recursive {RUNS} select * from meta",
        "stats": f"""with recursive {RUNS}, last as (select *, run = max(run) over () and bytes < {RUN_BYTES} o from meta)
            select coalesce(sum(entry_count) filter (o), 0) memtable_entries, coalesce(sum(bytes) filter (o), 0) memtable_bytes, count(*) filter (not o) runs, sum(entry_count) total_entries from last""",
        "zone_map_prune": f"with recursive {RUNS} select run, min_k, max_k from meta where min_k <= '99' and '99' <= max_k",
        "run_order": f"with recursive {RUNS} select run, entry_count from (select *, max(run) over () m from meta) where run > m - 3",
        "tombstones": f"with {LOG} select k, seq from log where v is null",
        "key_order": f"with {LOG}, live as ({_newest('log', ' and v is not null')}) select k, row_number() over (order by k) by_bytes, row_number() over (order by cast(k as bigint)) by_number from live",
        "varint": f"with n as (select p_partkey n from part union select o_orderkey * 37 from orders) select n, lower({_hex_varint('n', 5)}) hex, {_varint_len('n')} bytes from n",
        "varint_roundtrip": "select o_orderkey * 982451653 n, o_orderkey * 982451653 number from orders",
        "serialized_size": f"with {LOG} select k, seq, {_varint_len('strlen(k)')} + strlen(k) + 9 + case when v is null then 0 else {_varint_len('strlen(v)')} + strlen(v) end bytes from log",
        "entry_encode": f"with {LOG} select seq, {ENTRY} hex from log",
        "entry_encode_documents": f"with {DOCS} select seq, {ENTRY} hex from log",
        "entry_decode": f"with {LOG} select * from log",
        "wal_encode": f"with {LOG} select seq, {RECORD} hex from log",
        "wal_replay": f"with {LOG} select * from log",
        "tuple_roundtrip": TYPED_SQL,
        "tuple_encode": f"""select c_custkey a, upper(concat(case when c_nationkey % 2 = 0 then '00' else '02' end, {_hex_little('c_custkey', 8)}, case when c_nationkey % 2 = 0 then {_hex_little('c_nationkey', 4)} else '' end, {_hex_little('c_nationkey', 4)})) hex from customer""",
        "store_flush_reopen": f"with {LOG} select * from log",
        "store_recover": f"with {LOG} select * from log",
        "store_threshold": f"with {_batched(4)} select 1 runs, count(*) filter (run <= 3) total_entries, count(*) filter (run = 3) memtable_entries, max(seq) filter (run <= 3) + 1 next_seq from batched",
        "store_delete": """with rows as (select c_custkey, cast(c_custkey as varchar) k, c_name, c_nationkey from customer), put as (select k, row_number() over (order by c_custkey) seq, c_name v from rows),
            gone as (select k, (select count(*) from rows) + row_number() over (order by c_custkey) seq, null v from rows where c_nationkey < 10),
            again as (select k, (select count(*) from rows) + (select count(*) from gone) + row_number() over (order by c_custkey) seq, 'again' v from rows where c_nationkey < 3)
            select k, seq, v from (select *, row_number() over (partition by k order by seq desc) n from (select * from put union all select * from gone union all select * from again)) where n = 1 and v is not null""",
        "store_compact": f"with {LOG} {_newest('log', ' and v is not null')}",
        "store_snapshot": f"with {LOG} select * from log",
        "store_runs": f"with {_batched(3)} select run, count(*) entry_count, min(k) min_k, max(k) max_k, min(seq) min_seq, max(seq) max_seq, sum({SIZE}) bytes from batched group by run",
        "run_get": f"with {_batched(2)} select k, seq, v from batched where run = 1 and k = '13'",
        "store_lookup": f"with {LOG}, more as (select * from log union all select '13', (select max(seq) + 1 from log), null) select cast(s_suppkey as varchar) k, seq, v, case when l.k is null then 'absent' when v is null then 'deleted' else 'value' end state from supplier left join ({_newest('more')}) l on cast(s_suppkey as varchar) = l.k",
        "buffer_rows": """with rows as (select *, row_number() over (order by n_nationkey) i, count(*) over () n from nation) select n_name k, i seq, cast(n_nationkey as varchar) v from rows
            union all select n_name, n + row_number() over (order by n_nationkey), null from rows where n_regionkey = 1 union all select n_name, 100 + n_nationkey, 'late' from rows where n_nationkey % 7 = 0""",
        "typed_files": TYPED_SQL,
        "tuple_field": "select p_partkey, case when p_size % 3 <> 0 then p_size end maybe from part",
    }
