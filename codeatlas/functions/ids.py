"""Symbol ids: the first 8 bytes of the MD5 of a documentation id, as 16 hex digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_id(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def lookup_id(term: Column) -> Column:
    """A term of 16 hex digits is an id, anything else a documentation id to hash."""
    return F.when(term.rlike("^[0-9a-fA-F]{16}$"), F.lower(term)).otherwise(symbol_id(term))


def positional_id(file: Column, start: Column) -> Column:
    """The id of a symbol known by its place only."""
    return symbol_id(F.concat_ws("|", file, start.cast("string")))


def id_to_decimal(hex16: Column) -> Column:
    """The unsigned number whose little-endian bytes the digits are."""
    total = F.lit(0).cast("decimal(20,0)")
    for k in range(8):
        byte = F.conv(F.substring(hex16, 2 * k + 1, 2), 16, 10).cast("decimal(20,0)")
        total = (total + byte * F.lit(str(256**k)).cast("decimal(20,0)")).cast("decimal(20,0)")
    return total


def decimal_to_id(number: Column) -> Column:
    """The inverse of ``id_to_decimal``; ``number`` is a decimal or its digits."""
    big = F.lpad(F.lower(F.conv(number.cast("decimal(20,0)").cast("string"), 10, 16)), 16, "0")
    return F.concat(*[F.substring(big, 15 - 2 * k, 2) for k in range(8)])


def bucket(hex16: Column) -> Column:
    return F.substring(hex16, 1, 1)


def short_key(hex16: Column) -> Column:
    """What a redirect bucket shows of an id: 8 digits without the bucket's own."""
    return F.substring(hex16, 2, 7)


def varint_encode(n: int) -> bytes:
    """7 bits a byte, the lowest first, the top bit on all but the last."""
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def varint_decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number at ``at`` and where it ends; at most 5 bytes."""
    n = 0
    for k, b in enumerate(data[at : at + 5]):
        n |= (b & 0x7F) << 7 * k
        if b < 0x80:
            return n, at + k + 1
    raise ValueError("number without an end")
