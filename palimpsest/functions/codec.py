"""Byte formats: encoders as column expressions, decoders and typed rows over Arrow batches.

Formats (fixed values): varint, seven bits a byte, lowest first, high bit: more follow. Entry: varint key length, key, seq as 8 bytes little-endian,
0 or 1 (tombstone), then for 0 varint value length and value. Log record: 1 or 2 (delete), seq as 8 bytes, key length as 4 bytes, key,
then for 1 value length as 4 bytes and value, all little-endian. Typed row: one bit a field, lowest first, set for null, in whole
bytes; then the fields that aren't null: bool 1 byte, int 4, long 8, float 4, double 8 bytes little-endian, bytes with a varint length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARINT_BYTES = 10


def little(number: Column, size: int) -> Column:
    """A whole number as `size` bytes, lowest first."""
    big = F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))
    return F.concat(*(F.substring(big, 8 - i, 1) for i in range(size)))


def varint_len(number: Column) -> Column:
    """Bytes of a varint; the number counts as unsigned."""
    number = number.cast("long")
    out = F.lit(VARINT_BYTES)
    for n in range(VARINT_BYTES - 1, 0, -1):
        out = F.when((number >= 0) & (number < F.lit(1 << 7 * n)), n).otherwise(out) if 7 * n < 63 else F.when(number >= 0, n).otherwise(out)
    return out


def varint(number: Column) -> Column:
    number = number.cast("long")
    size, parts = varint_len(number), []
    for n in range(VARINT_BYTES):
        seven = F.shiftrightunsigned(number, 7 * n).bitwiseAND(F.lit(127))
        more = F.when(size > n + 1, F.lit(128)).otherwise(F.lit(0))
        byte = F.unhex(F.lpad(F.hex(seven.bitwiseOR(more)), 2, "0"))
        parts.append(F.when(size > n, byte).otherwise(F.unhex(F.lit(""))))
    return F.concat(*parts)


def entry_size(key: str = "key", value: str = "value") -> Column:
    """Bytes of an encoded entry."""
    own = lambda c: varint_len(F.octet_length(c)) + F.octet_length(c)
    return own(key) + 9 + F.when(F.col(value).isNull(), 0).otherwise(own(value))


def encode_entry(key: str = "key", seq: str = "seq", value: str = "value") -> Column:
    own = lambda c: F.concat(varint(F.octet_length(c)), F.col(c))
    return F.concat(own(key), little(F.col(seq), 8), F.when(F.col(value).isNull(), F.unhex(F.lit("01"))).otherwise(F.concat(F.unhex(F.lit("00")), own(value))))


def encode_record(key: str = "key", seq: str = "seq", value: str = "value") -> Column:
    own = lambda c: F.concat(little(F.octet_length(c), 4), F.col(c))
    put = F.concat(F.unhex(F.lit("01")), little(F.col(seq), 8), own(key), own(value))
    return F.when(F.col(value).isNull(), F.concat(F.unhex(F.lit("02")), little(F.col(seq), 8), own(key))).otherwise(put)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, next place). More than 64 bits or no last byte is an error."""
    out = 0
    for shift in range(0, 70, 7):
        if at >= len(data):
            raise ValueError("varint without an end")
        out |= (data[at] & 127) << shift
        at += 1
        if not data[at - 1] & 128:
            if out >> 64:
                break
            return out, at
    raise ValueError("varint of more than 64 bits")


def write_varint(number: int) -> bytes:
    if not 0 <= number < 1 << 64:
        raise ValueError("varints are unsigned numbers of 64 bits")
    out = bytearray()
    while number > 127:
        out.append(number & 127 | 128)
        number >>= 7
    return bytes([*out, number])


def _take(data: bytes, at: int, size: int) -> tuple[bytes, int]:
    if at + size > len(data):
        raise ValueError("the data end within a field")
    return data[at : at + size], at + size


def read_entry(data: bytes, at: int = 0) -> tuple[bytes, int, bytes | None, int]:
    """(key, seq, value, next place). Any flag but 0 is a tombstone."""
    size, at = read_varint(data, at)
    key, at = _take(data, at, size)
    seq, at = _take(data, at, 8)
    flag, at = _take(data, at, 1)
    value = None
    if flag == b"\0":
        size, at = read_varint(data, at)
        value, at = _take(data, at, size)
    return key, int.from_bytes(seq, "little"), value, at


def read_records(data: bytes) -> tuple[list[tuple[bytes, int, bytes | None]], int]:
    """The records of a byte log and where they end: a record that the data cut short is left out, an unknown kind whose seq and key
    are there is an error."""
    out, at = [], 0
    while at < len(data):
        start = at
        try:
            kind, at = _take(data, at, 1)
            seq, at = _take(data, at, 8)
            size, at = _take(data, at, 4)
            key, at = _take(data, at, int.from_bytes(size, "little"))
            value = None
            if kind == b"\1":
                size, at = _take(data, at, 4)
                value, at = _take(data, at, int.from_bytes(size, "little"))
        except ValueError:
            return out, start
        if kind not in (b"\1", b"\2"):
            raise OSError(f"unknown kind of record: {kind[0]}")
        out.append((key, int.from_bytes(seq, "little"), value))
    return out, at


def _extended(df: DataFrame, add: T.StructType, work) -> DataFrame:
    """df with columns that `work` makes of each batch; columns of their names are replaced."""
    kept = [c for c in df.columns if c not in add.fieldNames()]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(add)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = work(batch)
            made = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *add.fieldNames()])

    return df.mapInArrow(run, T.StructType([*(f for f in df.schema if f.name in kept), *add]))


def decode_entries(df: DataFrame, data: str = "data") -> DataFrame:
    """df with key, seq and value of its encoded entries. Null data give nulls; bytes after the entry are an error."""

    def work(batch: pa.RecordBatch) -> list[tuple]:
        out = []
        for x in batch.column(data).to_pylist():
            if x is None:
                out.append((None, None, None))
                continue
            *entry, end = read_entry(x)
            if end != len(x):
                raise ValueError("bytes after the entry")
            out.append(tuple(entry))
        return out

    return _extended(df, T.StructType().add("key", "binary").add("seq", "long").add("value", "binary"), work)


def decode_varints(df: DataFrame, data: str = "data", to: str = "number") -> DataFrame:
    """df with the number at the start of each data; numbers of 2**63 and more are an error, they are no longs."""

    def work(batch: pa.RecordBatch) -> list[tuple]:
        return [(None if x is None else read_varint(x)[0],) for x in batch.column(data).to_pylist()]

    return _extended(df, T.StructType().add(to, "long"), work)


_FIXED = {T.BooleanType: "<?", T.IntegerType: "<i", T.LongType: "<q", T.FloatType: "<f", T.DoubleType: "<d"}


def write_row(values: list, kinds: list[T.DataType]) -> bytes:
    bits = sum(1 << i for i, v in enumerate(values) if v is None)
    out = [bits.to_bytes(-(-len(kinds) // 8), "little")]
    for v, kind in zip(values, kinds, strict=True):
        if v is None:
            continue
        if type(kind) in _FIXED:
            out.append(struct.pack(_FIXED[type(kind)], v))
        else:
            v = v.encode() if isinstance(v, str) else v
            out += write_varint(len(v)), v
    return b"".join(out)


def read_row(data: bytes, kinds: list[T.DataType]) -> list:
    """The values; a bool is true for the byte 1 only."""
    at = -(-len(kinds) // 8)
    bits, out = int.from_bytes(_take(data, 0, at)[0], "little"), []
    for i, kind in enumerate(kinds):
        if bits >> i & 1:
            out.append(None)
        elif isinstance(kind, T.BooleanType):
            x, at = _take(data, at, 1)
            out.append(x == b"\1")
        elif type(kind) in _FIXED:
            x, at = _take(data, at, struct.calcsize(_FIXED[type(kind)]))
            out.append(struct.unpack(_FIXED[type(kind)], x)[0])
        else:
            size, at = read_varint(data, at)
            x, at = _take(data, at, size)
            out.append(x.decode() if isinstance(kind, T.StringType) else x)
    return out


def _check(schema: T.StructType) -> list[T.DataType]:
    kinds = [f.dataType for f in schema]
    for k in kinds:
        if type(k) not in (*_FIXED, T.BinaryType, T.StringType):
            raise TypeError(f"typed rows don't hold {k.simpleString()}")
    return kinds


def encode_rows(df: DataFrame, columns: list[str] | None = None, to: str = "data") -> DataFrame:
    """df with its `columns` (all by default) as a typed row each. Strings are bytes of UTF-8."""
    columns = columns or df.columns
    kinds = _check(T.StructType([df.schema[c] for c in columns]))

    def work(batch: pa.RecordBatch) -> list[tuple]:
        return [(write_row(list(r), kinds),) for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]

    return _extended(df, T.StructType().add(to, "binary"), work)


def decode_rows(df: DataFrame, schema: T.StructType, data: str = "data") -> DataFrame:
    """df with the fields of its typed rows. The schema isn't part of the data; with a wrong one, fields are misread or an error."""
    kinds = _check(schema)

    def work(batch: pa.RecordBatch) -> list[tuple]:
        return [tuple(read_row(x, kinds)) if x is not None else (None,) * len(kinds) for x in batch.column(data).to_pylist()]

    return _extended(df, T.StructType([T.StructField(f.name, f.dataType) for f in schema]), work)


def read_field(df: DataFrame, schema: T.StructType, field: str, data: str = "data") -> DataFrame:
    """df with one field of its typed rows; what comes before it is skipped, what comes after isn't read."""
    place = schema.fieldNames().index(field)
    kinds = _check(schema)

    def work(batch: pa.RecordBatch) -> list[tuple]:
        out = []
        for x in batch.column(data).to_pylist():
            if x is None or x[place // 8] >> place % 8 & 1:
                out.append((None,))
                continue
            bits = x[: -(-len(kinds) // 8)]
            head = (int.from_bytes(bits, "little") & (2 << place) - 1).to_bytes(-(-(place + 1) // 8) or 1, "little")[: -(-(place + 1) // 8)]
            out.append((read_row(head + x[len(bits) :], kinds[: place + 1])[place],))
        return out

    return _extended(df, T.StructType().add(field, schema[field].dataType), work)
