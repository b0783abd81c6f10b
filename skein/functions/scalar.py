"""Column functions with the dialect's semantics, and library functions."""

from __future__ import annotations

import hashlib
import struct
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def substr(s: Column, start: Column, length: Column | None = None) -> Column:
    """Positions before the first character count towards the length."""
    first = F.greatest(start, F.lit(1))
    if length is None:
        return F.substring(s, first, F.length(s))
    return F.when(start.isNull() | length.isNull(), None).otherwise(F.substring(s, first, F.greatest(start + length - first, F.lit(0))))


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def avg_int(x: Column) -> Column:
    return F.call_function("div", F.sum(x), F.count(x))


def total(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def sort_key(x: Column, kind: str) -> Column:
    """A struct that orders across kinds: null, boolean, number, string, bytes, uuid."""
    rank = {"bool": 1, "number": 2, "str": 3, "bin": 4, "uuid": 5}[kind]
    number = x.cast("double") if kind in ("bool", "number") else F.lit(None).cast("double")
    text = x.cast("string") if kind in ("str", "uuid") else F.lit(None).cast("string")
    raw = x if kind == "bin" else F.lit(None).cast("binary")
    return F.struct(F.when(x.isNull(), 0).otherwise(rank).alias("rank"), number.alias("num"), text.alias("str"), raw.alias("bin"))


def quote(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


# string library


def ljust(s: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(s, width, fill))


def rjust(s: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, fill))


def center(s: Column, width: int, fill: str = " ") -> Column:
    """The odd fill character goes to the right."""
    left = F.floor((F.lit(width) - F.length(s)) / 2).cast("int")
    filled = F.concat(F.repeat(F.lit(fill), F.greatest(left, F.lit(0))), s)
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(filled, width, fill))


def fromhex(s: Column) -> Column:
    return F.unhex(s)


# digests


def _pandas(kind: str, f):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v.encode() if isinstance(v, str) else bytes(v)))

    return run


def _murmur(data: bytes, seed: int = 13) -> int:
    """The public 32-bit Murmur3 hash."""
    mask, h = 0xFFFFFFFF, seed
    whole = len(data) // 4 * 4
    blocks = [*struct.unpack(f"<{whole // 4}I", data[:whole]), int.from_bytes(data[whole:], "little")]
    for i, k in enumerate(blocks):
        last = i == len(blocks) - 1
        k = k * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * 0x1B873593 & mask
        if not last:
            h = (h << 13 | h >> 19) & mask
            h = (h * 5 + 0xE6546B64) & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    return h ^ h >> 16


def murmur(x: Column) -> Column:
    return _pandas("bigint", _murmur)(x)


def pbkdf2(salt: str, rounds: int = 100_000, size: int = 128):
    return _pandas("binary", lambda v: hashlib.pbkdf2_hmac("sha256", v, salt.encode(), rounds, size))


def jump_hash(key: int, buckets: int) -> int:
    """The published jump consistent hash: few keys move when buckets are added."""
    b, j, key = -1, 0, key & (1 << 64) - 1
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def consistent(buckets: int):
    @F.pandas_udf("bigint")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: jump_hash(int(v), buckets))

    return run


# decimals beyond 38 digits


def big_decimal(op: str):
    """Arithmetic on numbers written as text, up to 76 digits."""
    import decimal

    context = decimal.Context(prec=76)

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        f = {"+": context.add, "-": context.subtract, "*": context.multiply, "/": context.divide}[op]
        return pd.Series([None if x is None or y is None else format(f(Decimal(x), Decimal(y)), "f") for x, y in zip(a, b)])

    return run
