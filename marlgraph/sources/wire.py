"""Change events in the protobuf wire format, read and written without generated code or a connector, in Arrow batches.

The message has, by field number: 1 table, 2 primary key, 3 operation, 4 and 5 the maps of the row before and after, 6 the time as (1 seconds, 2 nanoseconds), 7 transaction, 8 sequence.
A map's entry is (1 name, 2 value); a value is one of 1 string, 2 int64, 3 double, 4 bool, 5 bytes.

Cases: unknown fields are skipped; fields that are absent are null (operation and sequence: 0, as the format has it); a repeated field's last occurrence counts; bytes that are
no message are kept in `corrupt` with null fields, so that one bad message stops nothing; null bytes give a row of nulls.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgraph.runtime import ship
from marlgraph.sources.events import EVENT, VALUE

#: Numbers of the fields, and wire types. Fixed values.
TABLE, KEY, OPERATION, BEFORE, AFTER, TIME, TXID, LSN = range(1, 9)
VARINT, EIGHT, BYTES, FOUR = 0, 1, 2, 5
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


class NotAMessage(ValueError):
    """The bytes don't follow the format."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise NotAMessage("a number is cut off or too long")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value & 0xFFFF_FFFF_FFFF_FFFF, at


def _fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == VARINT:
            value, at = _varint(data, at)
        else:
            size = {EIGHT: 8, FOUR: 4}.get(kind)
            if kind == BYTES:
                size, at = _varint(data, at)
            if size is None or at + size > len(data) or not number:
                raise NotAMessage("a field is cut off or of an unknown type")
            value, at = data[at : at + size], at + size
        yield number, kind, value


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _want(kind: int, expected: int) -> None:
    if kind != expected:
        raise NotAMessage("a field has another type")


def _value(data: bytes) -> dict:
    out = dict.fromkeys(VALUE.names)
    for number, kind, v in _fields(data):
        if not 1 <= number <= 5:
            continue
        _want(kind, {2: VARINT, 3: EIGHT, 4: VARINT}.get(number, BYTES))
        read = {1: lambda: v.decode("utf-8"), 2: lambda: _signed(v), 3: lambda: struct.unpack("<d", v)[0], 4: lambda: bool(v), 5: lambda: bytes(v)}[number]()
        out = dict.fromkeys(VALUE.names) | {VALUE.names[number - 1]: read}  # one of them: the last
    return out


def decode(data: bytes) -> dict:
    """The event's columns; raises NotAMessage or UnicodeDecodeError."""
    e = dict.fromkeys(EVENT.names) | {"operation": 0, "lsn": 0}
    images: dict[int, dict] = {}
    for number, kind, v in _fields(data):
        if number in (TABLE, KEY, TXID):
            _want(kind, BYTES)
            e[{TABLE: "src_table", KEY: "primary_key", TXID: "txid"}[number]] = v.decode("utf-8")
        elif number == OPERATION:
            _want(kind, VARINT)
            e["operation"] = _signed(v)
        elif number == LSN:
            _want(kind, VARINT)
            e["lsn"] = _signed(v)
        elif number in (BEFORE, AFTER):
            _want(kind, BYTES)
            entry = {n: x for n, _, x in _fields(v)}
            images.setdefault(number, {})[bytes(entry.get(1, b"")).decode("utf-8")] = _value(bytes(entry.get(2, b"")))
        elif number == TIME:
            _want(kind, BYTES)
            parts = {n: _signed(x) for n, k, x in _fields(v) if k == VARINT}
            e["event_ts"] = _EPOCH + dt.timedelta(seconds=parts.get(1, 0), microseconds=parts.get(2, 0) // 1000)
    e["before_image"], e["after_image"] = (list(images[n].items()) if n in images else None for n in (BEFORE, AFTER))
    return e


def _number(n: int) -> bytes:
    n &= 0xFFFF_FFFF_FFFF_FFFF
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _number(number << 3 | VARINT) + _number(value)
    return _number(number << 3 | BYTES) + _number(len(value)) + value


def encode(e: dict) -> bytes:
    """The message of an event's columns; nulls and zeros are left out."""

    def value(v: dict | None) -> bytes:
        v = v or {}
        if v.get("string_value") is not None:
            return _field(1, v["string_value"].encode())
        if v.get("int_value") is not None:
            return _field(2, v["int_value"])
        if v.get("double_value") is not None:
            return _number(3 << 3 | EIGHT) + struct.pack("<d", v["double_value"])
        if v.get("bool_value") is not None:
            return _field(4, int(v["bool_value"]))
        return _field(5, bytes(v["bytes_value"])) if v.get("bytes_value") is not None else b""

    out = b"".join(_field(n, e[c].encode()) for n, c in ((TABLE, "src_table"), (KEY, "primary_key")) if e[c])
    out += _field(OPERATION, e["operation"]) if e["operation"] else b""
    out += b"".join(_field(n, _field(1, k.encode()) + _field(2, value(v))) for n, c in ((BEFORE, "before_image"), (AFTER, "after_image")) for k, v in (e[c] or []))
    if e["event_ts"] is not None:
        when = e["event_ts"] if e["event_ts"].tzinfo else e["event_ts"].replace(tzinfo=dt.timezone.utc)
        micros = (when - _EPOCH) // dt.timedelta(microseconds=1)
        out += _field(TIME, _field(1, micros // 1_000_000) + _field(2, micros % 1_000_000 * 1000))
    out += _field(TXID, e["txid"].encode()) if e["txid"] else b""
    return out + (_field(LSN, e["lsn"]) if e["lsn"] else b"")


_EVENT_AND_CORRUPT = T.StructType([*EVENT.fields, T.StructField("corrupt", T.BinaryType())])


def from_wire(raw: DataFrame, column: str = "value") -> DataFrame:
    """Events from bytes, with `corrupt` for those that are none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(raw.sparkSession)
    shape = to_arrow_schema(_EVENT_AND_CORRUPT, timezone="UTC") if "timezone" in to_arrow_schema.__code__.co_varnames else to_arrow_schema(_EVENT_AND_CORRUPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = dict.fromkeys(_EVENT_AND_CORRUPT.names)
        for batch in batches:
            rows = []
            for data in batch.column(0).to_pylist():
                try:
                    rows.append(nothing if data is None else decode(data) | {"corrupt": None})
                except (NotAMessage, UnicodeDecodeError, OverflowError, TypeError):
                    rows.append(nothing | {"corrupt": data})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return raw.select(F.col(column).cast("binary")).mapInArrow(run, _EVENT_AND_CORRUPT)


def to_wire(events: DataFrame) -> DataFrame:
    """(key, value) of Kafka records: table|primary key, so that a row's changes keep their order, and the message."""
    ship(events.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist(maps_as_pydicts=None)
            yield pa.RecordBatch.from_pydict({"key": [f"{e['src_table'] or ''}|{e['primary_key'] or ''}".encode() for e in rows], "value": [encode(e) for e in rows]}, schema=pa.schema([("key", pa.binary()), ("value", pa.binary())]))

    return events.select(*[F.col(f.name).cast(f.dataType) for f in EVENT.fields]).mapInArrow(run, "key binary, value binary")
