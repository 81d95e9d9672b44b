"""The binary form of an episode, for interchange with other stores."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from engramma.errors import EpisodeDecodeError

# Reasons for a rejected payload.
TRUNCATED_EPISODE = "episode blob is truncated"
TRUNCATED_COUNT = "count ULEB128 is truncated"
OVERFLOWING_COUNT = "count ULEB128 overflows u64"
NON_CANONICAL_COUNT = "count ULEB128 is not canonical"
EMPTY_ATTRIBUTES = "episode has no attributes"
ATTRIBUTE_COUNT_EXCEEDS_REST = "episode attribute count exceeds remaining bytes"
EMPTY_VALUES = "attribute has no values"
VALUE_COUNT_EXCEEDS_REST = "attribute value count exceeds remaining bytes"
NON_CANONICAL_ATTRIBUTE_KEYS = "attribute keys are not strictly sorted and unique"
NON_CANONICAL_ATTRIBUTE_VALUES = "attribute values are not strictly sorted and unique"
TRAILING_BYTES = "episode blob has trailing bytes"

Attributes = list[tuple[int, list[int]]]


def uleb128(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode(timestamp_ms: int, attributes: Attributes) -> bytes:
    """i64 timestamp, then counted attributes of a u64 key and counted u64 values, all big-endian."""
    parts = [struct.pack(">q", timestamp_ms), uleb128(len(attributes))]
    for key, values in attributes:
        parts += [struct.pack(">Q", key), uleb128(len(values)), struct.pack(f">{len(values)}Q", *values)]
    return b"".join(parts)


def _count(data: bytes, at: int) -> tuple[int, int]:
    end = next((i for i in range(at, min(len(data), at + 10)) if data[i] < 128), None)
    if end is None or (end - at == 9 and data[end] > 1):
        raise EpisodeDecodeError(OVERFLOWING_COUNT if len(data) >= at + 10 else TRUNCATED_COUNT)
    if end > at and data[end] == 0:
        raise EpisodeDecodeError(NON_CANONICAL_COUNT)
    return sum((data[i] & 127) << 7 * (i - at) for i in range(at, end + 1)), end + 1


def _ascending(numbers: list[int]) -> bool:
    return all(a < b for a, b in zip(numbers, numbers[1:], strict=False))


def decode(data: bytes) -> tuple[int, Attributes]:
    """Timestamp and attributes of a canonical payload; any other is rejected with its reason."""
    if len(data) < 8:
        raise EpisodeDecodeError(TRUNCATED_EPISODE)
    timestamp = struct.unpack_from(">q", data)[0]
    n, at = _count(data, 8)
    if n == 0:
        raise EpisodeDecodeError(EMPTY_ATTRIBUTES)
    if n > (len(data) - at) // 17:
        raise EpisodeDecodeError(ATTRIBUTE_COUNT_EXCEEDS_REST)
    out: Attributes = []
    for _ in range(n):
        if len(data) < at + 8:
            raise EpisodeDecodeError(TRUNCATED_EPISODE)
        key = struct.unpack_from(">Q", data, at)[0]
        m, at = _count(data, at + 8)
        if m == 0:
            raise EpisodeDecodeError(EMPTY_VALUES)
        if m > (len(data) - at) // 8:
            raise EpisodeDecodeError(VALUE_COUNT_EXCEEDS_REST)
        values = list(struct.unpack_from(f">{m}Q", data, at))
        at += 8 * m
        if not _ascending(values):
            raise EpisodeDecodeError(NON_CANONICAL_ATTRIBUTE_VALUES)
        out.append((key, values))
    if not _ascending([k for k, _ in out]):
        raise EpisodeDecodeError(NON_CANONICAL_ATTRIBUTE_KEYS)
    if at != len(data):
        raise EpisodeDecodeError(TRAILING_BYTES)
    return timestamp, out


def _count_hex(n: Column) -> Column:
    """Hex digits of a count as ULEB128, seven bits a byte; counts are under 2^35, as arrays are."""
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    n = n.cast("long")
    parts = [F.shiftrightunsigned(n, 7 * k) for k in range(5)]
    rest = byte(parts[4])
    for k in (3, 2, 1, 0):
        low = parts[k].bitwiseAND(F.lit(127).cast("long"))
        rest = F.when(parts[k] < 128, byte(parts[k])).otherwise(F.concat(byte(low.bitwiseOR(F.lit(128).cast("long"))), rest))
    return rest


def encoded(timestamp_ms: Column, attributes: Column) -> Column:
    """The payload of a canonical episode: array<struct<key long, values array<long>>>; an expression without Python."""
    wide = lambda v: F.lpad(F.hex(v), 16, "0")
    one = lambda a: F.concat(wide(a["key"]), _count_hex(F.size(a["values"])), F.array_join(F.transform(a["values"], wide), ""))
    return F.unhex(F.concat(wide(timestamp_ms.cast("long")), _count_hex(F.size(attributes)), F.array_join(F.transform(attributes, one), "")))


def decoded(payload: Column) -> Column:
    """struct(timestamp_ms, attributes, detail); detail says why a payload was rejected. Ids over 2^63 - 1 fail."""

    @F.pandas_udf("timestamp_ms long, attributes array<struct<key:long,values:array<long>>>, detail string")
    def apply(blobs: pd.Series) -> pd.DataFrame:
        rows = []
        for b in blobs:
            try:
                t, attrs = decode(bytes(b)) if b is not None else (None, None)
                rows.append((t, attrs and [{"key": k, "values": v} for k, v in attrs], None))
            except EpisodeDecodeError as e:
                rows.append((None, None, e.detail))
        return pd.DataFrame({"timestamp_ms": pd.array([r[0] for r in rows], "Int64"), "attributes": [r[1] for r in rows], "detail": [r[2] for r in rows]})

    return apply(payload)
