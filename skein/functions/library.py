"""The function library beside SQL: strings, code points, encodings, addresses, identifiers, tuples, decimals, latency histograms.

Functions take and give columns; a null input gives null. Built-in functions do the work wherever they can; the decimal
functions run in Arrow batches.
"""

from __future__ import annotations

import decimal
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Significant digits of a decimal.
DIGITS = 38
_CONTEXT = decimal.Context(prec=DIGITS, rounding=decimal.ROUND_HALF_UP)
#: Crockford's base 32, as ULIDs write it.
_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


# strings


def split(s: Column, sep: str | None = None, limit: int | None = None) -> Column:
    """Parts between separators, at most limit cuts; without one, words between white space."""
    if sep is None:
        words = F.split(F.regexp_replace(F.trim(s), r"\s+", " "), " ", -1 if limit is None else limit + 1)
        return F.when(F.trim(s) == "", F.array().cast("array<string>")).otherwise(words)
    quoted = "".join(c if c.isalnum() else "\\" + c for c in sep)
    return F.split(s, quoted, -1 if limit is None else limit + 1)


def startswith(s: Column, prefix: str, start: int = 1) -> Column:
    return F.substring(s, start, len(prefix)) == prefix


def endswith(s: Column, suffix: str) -> Column:
    return s.endswith(suffix)


def strip(s: Column, chars: str | None = None, left: bool = True, right: bool = True) -> Column:
    """Without the given characters (white space if none are given) at its ends."""
    known = F.lit(" \t\n\v\f\r" if chars is None else chars)
    return F.btrim(s, known) if left and right else F.ltrim(s, known) if left else F.rtrim(s, known)


def to_hex(s: Column) -> Column:
    return F.lower(F.hex(s))


def sub(s: Column, i: int, j: int = -1) -> Column:
    """Code points i to j, counted from 1, or from the end if negative."""
    n = F.char_length(s)
    first = F.lit(i) if i > 0 else F.greatest(n + i + 1, F.lit(1)) if i else F.lit(1)
    last = F.least(F.lit(j), n) if j >= 0 else n + j + 1
    return F.substring(s, first, F.greatest(last - first + 1, F.lit(0)))


def _class(name: str):
    def test(s: Column) -> Column:
        return F.regexp_like(s, F.lit(rf"^\p{{{name}}}$"))

    return test


#: Of single code points.
isalpha, isdigit, isupper, islower = _class("L"), _class("Nd"), _class("Lu"), _class("Ll")


def cmp(a: Column, b: Column, ignore_case: bool = False) -> Column:
    """-1, 0 or 1 in the order of the Unicode collation."""
    name = "UNICODE_CI" if ignore_case else "UNICODE"
    x, y = F.collate(a, name), F.collate(b, name)
    return F.when(x < y, -1).when(x == y, 0).when(x > y, 1)


# encodings


def base64(x: Column, nopad: bool = False, urlsafe: bool = False) -> Column:
    out = F.regexp_replace(F.base64(x.cast("binary")), r"[\r\n]", "")
    out = F.rtrim(out, F.lit("=")) if nopad or urlsafe else out
    return F.translate(out, "+/", "-_") if urlsafe else out


def from_base64(s: Column) -> Column:
    """Both alphabets, padded or not."""
    plain = F.rtrim(F.translate(s, "-_", "+/"), F.lit("="))
    pad = F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)))
    return F.unbase64(F.concat(plain, pad))


def uri(s: Column) -> Column:
    """Parts of an address: scheme, login, password, host, service, path, query, fragment; those that aren't there are null."""
    part = lambda i: F.nullif(F.regexp_extract(s, r"^(?:([a-zA-Z][\w+.-]*)://)?(?:([^:@/?#]*)(?::([^@/?#]*))?@)?(\[[^\]]*\]|[^:/?#]*)(?::(\w+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", i), F.lit(""))
    return F.struct(*[part(i + 1).alias(n) for i, n in enumerate(("scheme", "login", "password", "host", "service", "path", "query", "fragment"))])


def uri_escape(s: Column) -> Column:
    """Everything but letters, digits and -._~ as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def uri_unescape(s: Column) -> Column:
    return F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def ulid(ms: Column, random: Column) -> Column:
    """The 26 characters of a time in milliseconds and 10 random bytes."""
    bits = F.concat(F.lpad(F.bin(ms.cast("bigint")), 50, "0"), *[F.lpad(F.bin(F.conv(F.hex(F.substring(random, i, 1)), 16, 10).cast("bigint")), 8, "0") for i in range(1, 11)])
    letters = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.substring(F.lit(_BASE32), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.array_join(letters, "")


def ulid_time(s: Column) -> Column:
    """Milliseconds of a ULID."""
    digit = lambda i: (F.position(F.substring(F.upper(s), i, 1), F.lit(_BASE32)) - 1).cast("bigint")
    out = digit(1)
    for i in range(2, 11):
        out = out * 32 + digit(i)
    return out


def uuid_parts(s: Column) -> Column:
    """Version and variant bits of a UUID's text."""
    return F.struct(F.conv(F.substring(s, 15, 1), 16, 10).cast("int").alias("version"), F.conv(F.substring(s, 20, 1), 16, 10).cast("int").alias("variant"))


# tuples, as arrays


def transform(t: Column, start: int, remove: int, *new: Column) -> Column:
    """The array with remove fields from start (counted from 1, or from the end if negative) replaced by new ones."""
    first = F.lit(start) if start > 0 else F.size(t) + start + 1
    return F.concat(F.slice(t, 1, first - 1), F.array(*new) if new else F.slice(t, 1, 0), F.slice(t, first + remove, F.greatest(F.size(t) - first - remove + 1, F.lit(0))))


def find(t: Column, value: Column, after: int = 0) -> Column:
    """The first place of a value behind after, null if there is none."""
    rest = F.slice(t, after + 1, F.greatest(F.size(t) - after, F.lit(0)))
    return F.nullif(F.array_position(rest, value), F.lit(0)) + after


def findall(t: Column, value: Column) -> Column:
    return F.filter(F.transform(t, lambda x, i: F.when(x == value, i + 1)), lambda i: i.isNotNull())


# decimals, as text


def decimal_math(op: str, digits: int | None = None):
    """pow, exp, ln, log10, sqrt of decimals written as text, with 38 digits; rescale to digits after the point; trim of zeros. What has no value is null."""

    def one(x: str | None, y: str | None = None) -> str | None:
        if x is None or (op == "pow" and y is None):
            return None
        try:
            v = Decimal(x)
            if op == "rescale":
                return format(v.quantize(Decimal(1).scaleb(-digits), context=_CONTEXT), "f")
            if op == "trim":
                return format(v.normalize(_CONTEXT) if v else Decimal(0), "f")
            if op == "pow":
                v = _CONTEXT.power(v, Decimal(y))
            else:
                v = {"exp": _CONTEXT.exp, "ln": _CONTEXT.ln, "log10": _CONTEXT.log10, "sqrt": _CONTEXT.sqrt}[op](v)
        except decimal.DecimalException:
            return None
        return format(v, "f") if v.is_finite() else None

    if op == "pow":

        @F.pandas_udf("string")
        def both(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

        return both

    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in a], dtype=object)

    return run


# latency


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(bound, n, up_to): rows whose value is at most the bound and above the one before, and all up to it; above the last bound it is null."""
    edges = df.sparkSession.createDataFrame([(float(b), i) for i, b in enumerate(sorted(bounds))] + [(None, len(bounds))], "bound double, place int")
    place = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(sorted(bounds)))):
        place = F.when(F.col(value) <= b, i).otherwise(place)
    counts = df.where(F.col(value).isNotNull()).select(place.alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    known = F.broadcast(edges).join(counts, "place", "left").select("place", "bound", F.coalesce("n", F.lit(0)).alias("n"))  # a row per bound
    before = known.select(F.col("place").alias("p"), F.col("n").alias("m"))
    summed = known.join(F.broadcast(before), F.col("p") <= F.col("place")).groupBy("place", "bound", "n").agg(F.sum("m").alias("up_to"))
    return summed.select("bound", "n", "up_to")


def latency(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(n, min, max, avg, then a column per share): exact percentiles, the least value that so large a share of the rows doesn't exceed."""
    cuts = [F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY `{value}`)").alias(f"p{s * 100:g}".replace(".", "_")) for s in shares]
    x = F.col(value)
    return df.agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), *cuts)
