"""The store against a dictionary of versions, through restarts, crashes and compaction."""

import random

import pytest

from palimpsest.__main__ import main as cli
from palimpsest.sources.buffer import DELETED, Buffer
from palimpsest.sources.runfile import write_run
from palimpsest.sources.store import Conflict, Store
from palimpsest.streaming import ingest as streams


def open_store(spark, tmp_path, **options):
    return Store.open(spark, str(tmp_path / "store"), **options)


def batch(spark, rows):
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v)) for k, v in rows], "key binary, value binary").coalesce(1)


def live(store):
    return {bytes(r.key): bytes(r.value) for r in store.scan_live().collect()}


def test_put_get_overwrite_delete(spark, tmp_path):
    store = open_store(spark, tmp_path)
    assert [store.put("key1", "value1"), store.put(b"key2", b"value2"), store.put("key1", "v2"), store.delete("key2"), store.delete("never")] == [1, 2, 3, 4, 5]
    assert store.get("key1") == b"v2" and store.get("key2") is None and store.get("never") is None and store.get("key3") is None
    assert [(r.seq, r.value and bytes(r.value)) for r in store.get_all("key1").collect()] == [(3, b"v2"), (1, b"value1")]
    assert store.stats() | {"manifest": 0} == {"memtable_entries": 5, "memtable_bytes": 34 + 34 + 30 + 28 + 29, "runs": 0, "total_entries": 5, "next_seq": 6, "manifest": 0}


def test_batches_and_order(spark, tmp_path):
    store = open_store(spark, tmp_path)
    df = spark.range(1000).selectExpr("cast(id % 10 as string) key", "cast(id as string) value", "999 - id as o").repartition(7)
    assert store.put_batch(df, order=["o"]) == (1, 1000)
    assert sorted(r.seq for r in store.log().collect()) == list(range(1, 1001))
    assert live(store) == {str(i).encode(): str(i).encode() for i in range(10)}  # the smallest id comes last
    assert store.delete_batch(spark.createDataFrame([(b"3",), (b"4",)], "key binary")) == (1001, 1002)
    assert set(live(store)) == {str(i).encode() for i in range(10) if i not in (3, 4)}
    assert store.put_batch(df.limit(0)) == (1003, 1002) and store.stats()["next_seq"] == 1003
    with pytest.raises(Exception, match="must not be null"):
        store.put_batch(spark.createDataFrame([(b"k", None)], "key binary, value binary"))
    assert store.stats()["next_seq"] == 1003 and open_store(spark, tmp_path).collect_garbage() is not None


def test_flush_and_reopen(spark, tmp_path):
    store = open_store(spark, tmp_path, threshold=10**9)
    store.put_batch(batch(spark, [(b"key1", b"value1"), (b"key2", b"value2")]))
    assert store.flush() and not store.flush()
    assert store.stats()["runs"] == 1 and store.stats()["memtable_entries"] == 0
    again = open_store(spark, tmp_path)
    assert again.get("key1") == b"value1" and again.get("key2") == b"value2"
    assert again.put("key1", "new") == 3  # numbers go on after a restart
    assert again.get("key1") == b"new" and open_store(spark, tmp_path).get("key1") == b"new"


def test_threshold_flushes(spark, tmp_path):
    store = open_store(spark, tmp_path, threshold=100)
    store.put("a", "x" * 74)  # 99 bytes
    assert store.stats()["runs"] == 0
    store.put("b", "")
    assert store.stats()["runs"] == 1 and store.stats()["memtable_bytes"] == 0


def test_versions_of_a_key_in_many_runs(spark, tmp_path):
    store = open_store(spark, tmp_path)
    for i in range(3):
        store.put("k", f"v{i}")
        store.flush()
    store.delete("k")
    store.flush()
    assert store.get("k") is None and live(store) == {} and store.get_all("k").count() == 4
    store.put("k", "back")
    assert store.get("k") == b"back" and [r.run for r in store.runs().collect()] == [4, 3, 2, 1]
    assert {bytes(r.value) for r in store.as_of(2).collect()} == {b"v1"} and store.as_of(4).count() == 0


def test_runs_are_sorted_and_pruned(spark, tmp_path):
    store = open_store(spark, tmp_path, file_bytes=500)
    store.put_batch(batch(spark, [(b"k%03d" % (i % 50), b"v%d" % i) for i in range(200)]))
    store.flush()
    store.put_batch(batch(spark, [(b"z%03d" % i, b"") for i in range(20)]))
    store.flush()
    run = store.manifest.runs[1]
    assert len(store._read([run.path]).inputFiles()) > 3
    assert (run.entry_count, run.min_seq, run.max_seq) == (200, 1, 200) and run.might_contain(b"k049") and not run.might_contain(b"k05")
    assert len(store._with_key(b"z001").inputFiles()) < len(store.log().inputFiles())
    assert {bytes(r.key) for r in store.range_live("k048", "z001").collect()} == {b"k048", b"k049", b"z000"}
    assert [bytes(r.key) for r in store.scan().collect()] == sorted(bytes(r.key) for r in store.log().collect())


def test_large_and_odd_values(spark, tmp_path):
    store = open_store(spark, tmp_path)
    rows = {b"": b"empty key", b"\xff\xfe": bytes(range(256)), b"big": b"x" * 100_000, b"e": b""}
    store.put_batch(batch(spark, list(rows.items())))
    store.flush()
    assert live(store) == rows and store.get(b"") == b"empty key" and store.get("e") == b""


def test_random_operations(spark, tmp_path):
    draw, store, model, seq = random.Random(7), open_store(spark, tmp_path, threshold=600), {}, 0
    history = []
    for _ in range(12):
        what = draw.choice(["put", "put", "delete", "flush", "reopen", "compact"])
        if what in ("put", "delete"):
            rows = [(b"k%d" % draw.randint(0, 9), None if what == "delete" else b"v%d" % draw.randint(0, 99)) for _ in range(draw.randint(1, 8))]
            first, last = store.put_batch(batch(spark, rows)) if what == "put" else store.delete_batch(batch(spark, rows).select("key"))
            assert (first, last) == (seq + 1, seq + len(rows))
            seq = last
            model.update(rows)
        elif what == "flush":
            store.flush()
        elif what == "compact":
            store.compact()
        else:
            store = open_store(spark, tmp_path, threshold=600)
        want = {k: v for k, v in model.items() if v is not None}
        history.append(what)
        assert live(store) == want, history
    keys = spark.createDataFrame([(b"k%d" % i,) for i in range(12)], "key binary")
    got = {bytes(r.key): r.value and bytes(r.value) for r in store.multi_get(keys).collect()}
    assert got == {b"k%d" % i: model.get(b"k%d" % i) for i in range(12)}


def test_compaction(spark, tmp_path):
    store = open_store(spark, tmp_path)
    for rows in ([(b"a", b"1"), (b"b", b"1")], [(b"a", b"2"), (b"c", b"1")]):
        store.put_batch(batch(spark, rows))
        store.flush()
    store.delete_batch(spark.createDataFrame([(b"b",), (b"c",)], "key binary"))
    store.flush()
    store.compact([2, 3])  # the tombstone of b still hides run 1
    assert live(store) == {b"a": b"2"} and {bytes(r.key) for r in store.run(store.manifest.runs[0].id).collect()} == {b"a", b"b", b"c"}
    store.compact()
    assert live(store) == {b"a": b"2"} and store.stats()["total_entries"] == 1
    store.delete("a")
    store.flush()
    store.compact()
    assert store.stats()["runs"] == 0 and live(store) == {} and store.put("a", "3") == 8
    assert store.collect_garbage(keep=1) and live(open_store(spark, tmp_path)) == {b"a": b"3"}


def test_frames_outlive_flush_and_compaction(spark, tmp_path):
    store = open_store(spark, tmp_path, keep=3)
    store.put_batch(batch(spark, [(b"a", b"1"), (b"b", b"1")]))
    first, history = store.scan_live(), store.scan()
    store.flush()
    store.delete("a")
    second = store.scan_live()
    store.flush()
    store.compact()
    shown = lambda df: {bytes(r.key): bytes(r.value) for r in df.collect()}
    assert shown(first) == {b"a": b"1", b"b": b"1"} and shown(second) == {b"b": b"1"} and history.count() == 2
    gone = store.collect_garbage()
    assert any(n.startswith("wal/") for n in gone) and shown(second) == {b"b": b"1"} == live(store)
    assert len(store.files.names("manifest")) == 3
    store.collect_garbage(keep=1)
    assert len(store.files.names("manifest")) == len(store.files.names("runs")) == 1 and not store.files.names("wal")
    assert live(store) == live(open_store(spark, tmp_path)) == {b"b": b"1"}


def test_damaged_manifests(spark, tmp_path):
    store = open_store(spark, tmp_path)
    store.put("a", "1")
    store.files.write_new("manifest/000000000009.json.part", "half a mani")  # a write that broke off: its name isn't a manifest's
    assert live(open_store(spark, tmp_path)) == {b"a": b"1"}
    store.files.write_new("manifest/000000000009.json", '{"version": 9, "runs": [')
    with pytest.raises(ValueError):  # nothing is guessed about a cut-off one
        open_store(spark, tmp_path)


def test_lookups_open_few_runs(spark, tmp_path, monkeypatch):
    store, opened = open_store(spark, tmp_path), []
    for prefix in (b"a", b"k", b"z"):
        store.put_batch(batch(spark, [(prefix + b"%02d" % i, b"v%d" % i) for i in range(30)]))
        store.flush()
    store.delete("a05")
    real = store._read
    monkeypatch.setattr(store, "_read", lambda paths: opened.append(len([p for p in paths if p.startswith("runs/")])) or real(paths))
    keys = spark.createDataFrame([(b"a03",), (b"a05",), (b"a99",), (None,), (b"a03",)], "key binary")
    want = [(None, "absent", None), (b"a03", "value", b"v3"), (b"a03", "value", b"v3"), (b"a05", "deleted", None), (b"a99", "absent", None)]
    for most in (1000, 2):
        monkeypatch.setattr("palimpsest.sources.store.FEW_KEYS", most)
        got = store.multi_get(keys)
        assert sorted(((r.key and bytes(r.key), r.state, r.value and bytes(r.value)) for r in got.collect()), key=lambda r: r[0] or b"") == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert opened.pop() == 1 and ("In(key" in plan or "GreaterThanOrEqual(key" in plan), plan
    assert store.multi_get(keys.limit(0)).count() == 0 and store.multi_get(keys.where("key is null")).first().state == "absent"


def test_flush_is_one_shuffle(spark, tmp_path):
    store = open_store(spark, tmp_path)
    store.put_batch(batch(spark, [(b"k", b"v")]))
    assert not store.manifest.segments[0].replayed
    store.append_log(store.log())
    assert store.manifest.segments[1].replayed and store.log().count() == 2
    store.flush()
    assert store.stats()["total_entries"] == 1 and store.manifest.runs[0].entry_count == 1


def test_tiers(spark, tmp_path):
    store, want = open_store(spark, tmp_path), {}
    for i in range(6):
        store.put_batch(batch(spark, rows := [(b"k%d" % (i % 4), b"v%d" % i), (b"x", b"")]))
        want.update(rows)
        store.flush()
    assert store.compact_tiers(fan=3) >= 1 and store.stats()["runs"] < 6
    assert live(store) == want and store.metrics["flushes"] == 6 and store.metrics["compactions"] >= 1 and store.metrics["entries_in_log"] == 12


def test_run_reader(spark, tmp_path):
    store = open_store(spark, tmp_path)
    store.put_batch(batch(spark, [(b"key", b"v1"), (b"key", b"v2"), (b"key", b"v3"), (b"other", b"x")]))
    store.flush()
    reader = store.reader(1)
    assert [bytes(r.value) for r in reader.get_all(b"key").collect()] == [b"v3", b"v2", b"v1"]
    assert reader.get_all(b"zzz").count() == 0 and reader.get_all(b"m").count() == 0 and reader.scan().count() == 4
    empty = write_run(store.log().limit(0), store.config.path, "runs/empty", 9, 0)
    assert (empty.entry_count, empty.min_key, empty.min_seq) == (0, "", 0) and not empty.might_contain(b"") and not empty.overlaps(None, None)


def test_buffer(spark):
    b = Buffer()
    assert [b.put("c", "3"), b.put(b"a", b"1"), b.put("a", "2"), b.delete("b"), b.put("e", "")] == [1, 2, 3, 4, 5]
    assert b.rows() == [(b"a", 3, b"2"), (b"a", 2, b"1"), (b"b", 4, None), (b"c", 1, b"3"), (b"e", 5, b"")]
    assert b.get("a") == b"2" and b.get("b") is DELETED and b.get("z") is None and b.get("e") == b"" and b.get_all("a") == [(3, b"2"), (2, b"1")]
    assert b.size_bytes() == 26 * 3 + 25 + 25 and len(b) == 5 and not b.is_full() and b.is_full(100)
    b.put_with_seq("a", "9", 20)
    b.delete_with_seq("a", 10)
    assert b.get("a") == b"9" and b.current_seq == 21 and b.log(spark).count() == 7
    b.clear()
    assert len(b) == 0 and b.size_bytes() == 0 and b.put("n", "") == 21
    with pytest.raises(ValueError):
        b.put_with_seq("a", "", 1 << 63)
    assert Buffer(7).put("a", "") == 7


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "store")
    assert [cli([path, *x]) for x in (["put", "a", "1"], ["put", "b", "é"], ["delete", "a"], ["get", "b"], ["get", "a"], ["scan"], ["history", "a"], ["flush"], ["compact"], ["gc"], ["stats"])] == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0]
    out = capsys.readouterr().out.splitlines()
    assert out[:4] == ["1", "2", "3", "é"] and out[4] == '["b", "\\u00e9"]' and out[5:7] == ["[3, null]", '[1, "1"]'] and '"total_entries": 1' in out[-1]


def test_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    store = open_store(spark, tmp_path)
    store.put("a", "1")
    monkeypatch.setattr(store, "_commit", lambda new: (_ for _ in ()).throw(OSError("lost power")))
    for write in (lambda: store.put("a", "2"), store.flush, store.compact):
        try:
            write()
        except OSError:
            pass
    again = open_store(spark, tmp_path)
    assert live(again) == {b"a": b"1"} and again.put("b", "1") == 2
    assert again.collect_garbage() and live(again) == {b"a": b"1", b"b": b"1"}


def test_two_writers(spark, tmp_path):
    one, two = open_store(spark, tmp_path), open_store(spark, tmp_path)
    one.put("a", "1")
    with pytest.raises(Conflict):
        two.put("a", "2")
    assert live(two.refresh()) == {b"a": b"1"}


def test_missing_run_is_an_error(spark, tmp_path):
    store = open_store(spark, tmp_path)
    store.put("a", "1")
    store.flush()
    store.files.delete(store.manifest.runs[0].path)
    with pytest.raises(FileNotFoundError):
        open_store(spark, tmp_path)


def test_replayed_log_keeps_its_numbers(spark, tmp_path):
    store = open_store(spark, tmp_path)
    log = spark.createDataFrame([(bytearray(b"a"), 10, bytearray(b"x")), (bytearray(b"a"), 12, None)], "key binary, seq long, value binary")
    assert store.append_log(log) == (10, 12) and store.get("a") is None and store.put("a", "y") == 13
    store.append_log(log)  # the same versions again
    assert store.get("a") == b"y"
    store.flush()
    assert store.stats()["total_entries"] == 3


def test_streams(spark, tmp_path):
    folder, rows = str(tmp_path / "in"), [(bytearray(b"k%d" % (i % 7)), i, None if i % 4 == 0 else bytearray(b"v%d" % i)) for i in range(1, 61)]
    schema = "key binary, seq long, value binary"
    store = open_store(spark, tmp_path)
    for k in (2, 0, 1):  # later versions may come first
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(folder)
        streams.ingest(streams.log_stream(spark, folder, 1), store, "in", str(tmp_path / "checkpoint")).awaitTermination()
    want = {bytes(k): bytes(v) for k, _, v in rows[-7:] if v is not None}
    assert live(store.refresh()) == want and store.stats()["total_entries"] == 60
    streams.ingest(streams.log_stream(spark, folder, 1), store, "in", str(tmp_path / "again")).awaitTermination()
    assert store.refresh().stats()["total_entries"] == 60  # batches that were sent before have no effect
    q = streams.latest_state(streams.log_stream(spark, folder)).writeStream.format("memory").queryName("state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {bytes(r.key): bytes(r.value) for r in spark.table("state").where("value is not null").collect()} == want


def test_unnumbered_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(b"a", b"1"), (b"b", None), (b"a", b"2")], "key binary, value binary").coalesce(1).write.parquet(folder)
    store = open_store(spark, tmp_path)
    stream = spark.readStream.schema("key binary, value binary").parquet(folder)
    streams.ingest(stream, store, "in", str(tmp_path / "checkpoint"), numbered=False).awaitTermination()
    assert live(store.refresh()) == {b"a": b"2"} and store.get_all("b").count() == 1


def test_stateful_processor(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(bytearray(b"k%d" % (i % 3)), i, bytearray(b"v%d" % i)) for i in range(1, 31)]
    for k in (1, 0, 2):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "key binary, seq long, value binary").coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = streams.newest_changes(streams.log_stream(spark, folder, 1))
        q = out.writeStream.format("memory").queryName("changes").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {}
        for r in spark.table("changes").collect():
            got[bytes(r.key)] = max(got.get(bytes(r.key), (0, b"")), (r.seq, bytes(r.value)))
        assert got == {b"k%d" % (i % 3): (i, b"v%d" % i) for i in (28, 29, 30)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
