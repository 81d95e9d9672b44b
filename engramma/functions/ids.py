"""Identifiers: memory ids, atom ids, and order-preserving images of unsigned numbers."""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramma.errors import ZeroMemoryId

MEMORY_ID_BYTES = 16


def memory_id(value: int | bytes) -> bytes:
    """The canonical 16 big-endian bytes of a non-zero 128-bit id."""
    raw = value if isinstance(value, bytes) else value.to_bytes(MEMORY_ID_BYTES, "big")
    if len(raw) != MEMORY_ID_BYTES:
        raise ValueError("a memory identifier has 16 bytes")
    if not any(raw):
        raise ZeroMemoryId
    return raw


def new_memory_id() -> bytes:
    return memory_id(secrets.token_bytes(MEMORY_ID_BYTES - 1) + b"\1")


def memory_display(raw: bytes) -> str:
    return raw.hex()


def atom_display(raw: bytes, sequence: int) -> str:
    return f"{raw.hex()}:{sequence}"


def atom(memory: Column, sequence: Column) -> Column:
    """An atom id; structs compare by memory first, then by sequence."""
    return F.struct(memory.alias("memory_id"), sequence.cast("long").alias("sequence"))


def atom_text(memory: Column, sequence: Column) -> Column:
    return F.concat_ws(":", F.lower(F.hex(memory)), sequence.cast("string"))


def memory_is_valid(memory: Column) -> Column:
    return (F.octet_length(memory) == MEMORY_ID_BYTES) & (memory != F.lit(bytes(MEMORY_ID_BYTES)))


def biased(value: Column) -> Column:
    """A caller's unsigned 64-bit id as a signed one of the same order."""
    return (value.cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def unbiased(value: Column) -> Column:
    return (value.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)")


def u64_bytes(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value), 16, "0"))
