import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import codec
from palimpsest.operators.log import LOG_SCHEMA
from palimpsest.sources import bytelog

NUMBERS = [0, 1, 127, 128, 255, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**35, 2**56 - 1, 2**56, 2**63 - 1]
ENTRIES = [(b"hello", 42, b"world"), (b"deleted", 100, None), (b"", 1, b""), (b"\x80\xff", 2**62, b"\x00" * 200), (b"k" * 200, 3, b"v" * 5000), (b"k", 2**63 - 1, None)]


def frame(spark, rows=ENTRIES):
    return spark.createDataFrame([(bytearray(k), s, None if v is None else bytearray(v)) for k, s, v in rows], LOG_SCHEMA)


def entry_bytes(key, seq, value):
    out = codec.write_varint(len(key)) + key + struct.pack("<Q", seq)
    return out + (b"\1" if value is None else b"\0" + codec.write_varint(len(value)) + value)


def record_bytes(key, seq, value):
    out = (b"\2" if value is None else b"\1") + struct.pack("<QI", seq, len(key)) + key
    return out if value is None else out + struct.pack("<I", len(value)) + value


def test_varint_expressions(spark):
    rows = spark.createDataFrame([(n,) for n in [*NUMBERS, -1]], "n long").select("n", codec.varint(F.col("n")).alias("b"), codec.varint_len(F.col("n")).alias("size")).collect()
    for r in rows:
        want = codec.write_varint(r.n % 2**64)
        assert bytes(r.b) == want and r.size == len(want)


@settings(deadline=None)
@given(st.integers(0, 2**64 - 1), st.binary(max_size=4))
def test_varint_roundtrip(n, rest):
    data = codec.write_varint(n)
    assert codec.read_varint(data + rest) == (n, len(data))


@pytest.mark.parametrize("data", [b"", b"\x80", b"\xff" * 9, b"\xff" * 10 + b"\x01", b"\xff" * 9 + b"\x7f", b"\x80" * 10 + b"\x01"])
def test_bad_varints(data):
    with pytest.raises(ValueError):
        codec.read_varint(data)


def test_entries(spark):
    rows = frame(spark).select("*", codec.encode_entry().alias("data"), codec.entry_size().alias("size"))
    got = codec.decode_entries(rows.withColumnsRenamed({"key": "k", "seq": "s", "value": "v"})).collect()
    for r in got:
        v = None if r.v is None else bytes(r.v)
        assert bytes(r.data) == entry_bytes(bytes(r.k), r.s, v) and r.size == len(r.data)
        assert (bytes(r.key), r.seq, None if r.value is None else bytes(r.value)) == (bytes(r.k), r.s, v)


def test_any_flag_but_zero_is_a_tombstone_and_short_data_an_error():
    data = bytearray(entry_bytes(b"k", 7, None))
    data[-1] = 9
    assert codec.read_entry(bytes(data)) == (b"k", 7, None, len(data))
    whole = entry_bytes(b"key", 7, b"value")
    for n in range(len(whole)):
        with pytest.raises(ValueError):
            codec.read_entry(whole[:n])


def test_records(spark):
    for r in frame(spark).select("*", codec.encode_record().alias("data")).collect():
        assert bytes(r.data) == record_bytes(bytes(r.key), r.seq, None if r.value is None else bytes(r.value))


def test_torn_logs():
    rows = [(b"key1", 1, b"value1"), (b"key2", 2, b"value2"), (b"key1", 3, None)]
    parts = [record_bytes(*r) for r in rows]
    data, ends = b"".join(parts), [0, *(sum(map(len, parts[: i + 1])) for i in range(3))]
    for n in range(len(data) + 1):
        whole = sum(e <= n for e in ends) - 1
        assert codec.read_records(data[:n]) == (rows[:whole], ends[whole])
    bad = b"\x07" + struct.pack("<QI", 4, 1) + b"k"
    with pytest.raises(OSError):
        codec.read_records(data + bad)
    assert codec.read_records(data + bad[:-1])[0] == rows  # cut short before its kind matters


def test_byte_logs_of_files(spark, tmp_path):
    rows = [(b"k%d" % (i % 7), i, None if i % 5 == 0 else b"v%d" % i) for i in range(1, 101)]
    parts = bytelog.to_bytes(frame(spark, rows), 30).collect()
    assert len(parts) == 4
    for r in parts:
        (tmp_path / f"{r.part:03d}.log").write_bytes(bytes(r.data))
    with open(tmp_path / "003.log", "ab") as f:
        f.write(record_bytes(b"torn", 101, b"x")[:-1])
    (tmp_path / "004.log").write_bytes(b"")
    log, following = bytelog.replay(spark, str(tmp_path))
    plain = lambda df: sorted((r.seq, bytes(r.key), None if r.value is None else bytes(r.value)) for r in df.collect())
    assert plain(log) == sorted((s, k, v) for k, s, v in rows) and following == 101
    spark.dataSource.register(bytelog.ByteLogSource)
    assert plain(spark.read.format("palimpsest_log").load(str(tmp_path))) == plain(log)


TYPED = T.StructType().add("a", "integer").add("b", "binary").add("c", "integer")
WIDE = T.StructType([T.StructField(f"f{i}", k) for i, k in enumerate([T.BooleanType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.BinaryType(), T.StringType(), T.LongType(), T.BooleanType()])])


@pytest.mark.parametrize(
    "schema, rows",
    [
        (TYPED, [(10, None, 30), (1, bytearray(b"Alice"), 30), (2, bytearray(b""), None), (None, None, None), (-(2**31), bytearray(b"x" * 200), 2**31 - 1)]),
        (WIDE, [(True, 1, 2, 0.5, 0.1, bytearray(b"\x00"), "é", -1, False), (None,) * 9, (False, None, -(2**63), None, float("inf"), None, "", None, True)]),
        (WIDE.__class__(WIDE.fields[:8]), [(None, None, None, None, None, None, None, 5), (True, 0, 0, 0.0, -0.0, bytearray(), "z" * 300, None)]),
    ],
)
def test_typed_rows(spark, schema, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], T.StructType([T.StructField("n", T.LongType()), *schema.fields]))
    coded = codec.encode_rows(df, schema.fieldNames()).select("n", "data")
    assert [tuple(r)[1:] for r in codec.decode_rows(coded, schema).select("n", *schema.fieldNames()).orderBy("n").collect()] == rows
    assert all(len(r.data) >= -(-len(schema) // 8) for r in coded.collect())
    for i, name in enumerate(schema.fieldNames()):
        assert [r[1] for r in codec.read_field(coded, schema, name).select("n", name).orderBy("n").collect()] == [r[i] for r in rows]


def test_row_bytes():
    kinds = [f.dataType for f in TYPED]
    assert codec.write_row([10, None, 30], kinds) == b"\x02" + struct.pack("<ii", 10, 30)
    assert codec.read_row(b"\x00\x02", [T.BooleanType()]) == [False]
    with pytest.raises(ValueError):
        codec.read_row(b"\x00\x01", [T.IntegerType()])


def test_types_that_rows_do_not_hold(spark):
    with pytest.raises(TypeError):
        codec.encode_rows(spark.sql("select array(1) a"))


def test_rows_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(v, bytearray(b"n"), None) for v in (100, 200, 300)], TYPED)
    bytelog.write_rows(df, str(tmp_path / "rows"))
    assert sorted(r.a for r in bytelog.read_rows(spark, str(tmp_path / "rows"), TYPED).collect()) == [100, 200, 300]
