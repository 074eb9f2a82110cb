"""Reads of logs against a plain model, and the rules of versions, tombstones and order."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import log as reads
from palimpsest.operators.log import LOG_SCHEMA

HARD = [b"", b"\x00", b"a", b"a\x00", b"ab", b"\x7f", b"\x80", b"\xff", b"\xff\xff", "é".encode()]


def frame(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, None if v is None else bytearray(v)) for k, s, v in rows], LOG_SCHEMA)


def plain(df):
    return [(bytes(r.key), r.seq, None if r.value is None else bytes(r.value)) for r in df.collect()]


def model(rows, through=None):
    newest = {}
    for k, s, v in rows:
        if (through is None or s <= through) and s >= newest.get(k, (-1, None))[0]:
            newest[k] = (s, v)
    return newest


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    return [(draw.choice(HARD), s, draw.choice([None, b"", b"x", b"long" * 50])) for s in range(1, 400)]


def test_scan_is_in_the_logs_order(spark, rows):
    shuffled = random.Random(2).sample(rows, len(rows))
    assert plain(reads.scan(frame(spark, shuffled))) == sorted(rows, key=lambda r: (r[0], -r[1]))


def test_latest_and_live(spark, rows):
    log, newest = frame(spark, rows), model(rows)
    assert {k: (s, v) for k, s, v in plain(reads.latest(log))} == newest
    assert {k: v for k, _, v in plain(reads.live(log))} == {k: v for k, (_, v) in newest.items() if v is not None}


def test_empty_value_is_no_tombstone(spark):
    log = frame(spark, [(b"a", 1, b""), (b"b", 2, b"x"), (b"b", 3, None)])
    assert plain(reads.live(log)) == [(b"a", 1, b"")]
    assert [bytes(r.value) for r in reads.get(log, bytearray(b"a")).collect()] == [b""]


def test_a_deleted_key_does_not_come_back(spark):
    log = frame(spark, [(b"k", 1, b"old"), (b"k", 2, None)])
    assert reads.live(log).count() == 0 and reads.get(log, bytearray(b"k")).count() == 0
    again = reads.merge(log, frame(spark, [(b"k", 3, b"new")]))
    assert plain(reads.live(again)) == [(b"k", 3, b"new")]


@pytest.mark.parametrize("key", [*HARD, b"never"])
def test_point_reads(spark, rows, key):
    log = frame(spark, rows)
    own = sorted((r for r in rows if r[0] == key), key=lambda r: -r[1])
    assert plain(reads.get_all(log, bytearray(key))) == own
    got = [bytes(r.value) for r in reads.get(log, bytearray(key)).collect()]
    assert got == ([own[0][2]] if own and own[0][2] is not None else [])


def test_multi_get(spark, rows):
    newest = model(rows)
    keys = spark.createDataFrame([(bytearray(k),) for k in [*HARD, b"never", b"a"]] + [(None,)], "key binary")
    got = reads.multi_get(frame(spark, rows), keys).collect()
    assert len(got) == len(HARD) + 3
    for r in got:
        s, v = newest.get(None if r.key is None else bytes(r.key), (None, None))
        assert r.state == ("absent" if s is None else "deleted" if v is None else "value")
        assert r.seq == s and (None if r.value is None else bytes(r.value)) == v


@pytest.mark.parametrize("low, high", [(None, None), (b"a", b"b"), (b"", b"\x80"), (b"\x80", None), (b"b", b"a")])
def test_ranges(spark, rows, low, high):
    bound = lambda x: None if x is None else bytearray(x)
    got = {k for k, _, _ in plain(reads.range_live(frame(spark, rows), bound(low), bound(high)))}
    assert got == {k for k, (_, v) in model(rows).items() if v is not None and (low is None or k >= low) and (high is None or k < high)}


@pytest.mark.parametrize("seq", [0, 1, 57, 399, 10**9])
def test_snapshots(spark, rows, seq):
    got = {k: (s, v) for k, s, v in plain(reads.as_of(frame(spark, rows), seq))}
    assert got == {k: x for k, x in model(rows, seq).items() if x[1] is not None}


def test_merge_keeps_duplicates(spark):
    log = frame(spark, [(b"k", 1, b"a")])
    assert reads.merge(log, log, log).count() == 3


def test_history(spark, rows):
    for r in reads.key_history(frame(spark, rows)).collect():
        own = [x for x in rows if x[0] == bytes(r.key)]
        assert (r.n, r.tombstones, r.min_seq, r.max_seq) == (len(own), sum(v is None for _, _, v in own), own[0][1], own[-1][1])


def test_ordered_keys(spark):
    numbers = [0, 1, -1, 9, 10, 2**62, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", reads.ordered_key("n").alias("k"))
    assert [r.n for r in df.orderBy("k").collect()] == sorted(numbers)


def test_key_filters_reach_the_scan(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(str(tmp_path / "log"))
    log = spark.read.schema(LOG_SCHEMA).parquet(str(tmp_path / "log"))
    plan = log.where(F.lit(True)).sparkSession._jvm.PythonSQLUtils.explainString(reads.range_live(log, bytearray(b"a"), bytearray(b"b"))._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan and "WindowGroupLimit" in plan
