"""Key and range access: iterators over typed keys, pages, counts, quantiles, bit and box predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Iterators that run from the greatest key down.
DESCENDING = frozenset({"REQ", "LT", "LE", "PP"})
TREE = frozenset({"EQ", "REQ", "ALL", "LT", "LE", "GE", "GT", "NP", "PP"})
HASH = frozenset({"ALL", "EQ", "GT"})
BITSET = frozenset({"ALL", "EQ", "BITS_ALL_SET", "BITS_ANY_SET", "BITS_ALL_NOT_SET"})
BOX = frozenset({"ALL", "EQ", "GT", "GE", "LT", "LE", "OVERLAPS", "NEIGHBOR"})


class Unsupported(ValueError):
    """An iterator or option that the kind of index doesn't have."""


def _lexicographic(columns: list[str], values: list, strict: bool, greater: bool) -> Column:
    """Compare a key's leading columns with values as tuples, in a form that filters push down."""
    whole, equal, bound = F.lit(False), F.lit(True), F.lit(True)
    for i, (c, v) in enumerate(zip(columns, values)):
        x = F.col(c)
        if v is None:  # null is the least key
            step = x.isNotNull() if greater else F.lit(False)
            edge = F.lit(True) if greater else x.isNull()
        else:
            step = x > F.lit(v) if greater else (x < F.lit(v)) | x.isNull()
            edge = x >= F.lit(v) if greater else (x <= F.lit(v)) | x.isNull()
        whole = whole | (equal & step)
        equal = equal & x.eqNullSafe(F.lit(v))
        if i == 0:
            bound = edge
    return bound & (whole if strict else whole | equal)


class Space:
    """A table with an ordered key. All results are DataFrames; the key's order is null first."""

    def __init__(self, df: DataFrame, key: list[str]):
        self.df, self.key = df, key

    def get(self, key: list) -> DataFrame:
        """The row of a full key, or none."""
        if len(key) != len(self.key):
            raise Unsupported("get takes a full key")
        return self.df.where(self._equal(key)).limit(1)

    def _equal(self, key: list) -> Column:
        return reduce(Column.__and__, (F.col(c) == F.lit(v) for c, v in zip(self.key, key)), F.lit(True))

    def where(self, iterator: str = "ALL", key: list | None = None) -> Column:
        """The iterator's predicate."""
        key, it = key or [], iterator.upper()
        if it not in TREE:
            raise Unsupported(f"a tree index has no iterator {iterator}")
        if not key or it == "ALL":
            return F.lit(True)
        if it in ("EQ", "REQ"):
            return self._equal(key)
        if it in ("NP", "PP"):
            *lead, prefix = key
            if prefix == "":
                return F.lit(False)
            c = F.col(self.key[len(lead)])
            past = (c > F.lit(prefix)) & ~c.startswith(prefix) if it == "NP" else c < F.lit(prefix)
            return reduce(Column.__and__, (F.col(k) == F.lit(v) for k, v in zip(self.key, lead)), past)
        return _lexicographic(self.key[: len(key)], key, it in ("GT", "LT"), it in ("GE", "GT"))

    def order(self, iterator: str = "ALL") -> list[Column]:
        return [F.col(c).desc_nulls_last() if iterator.upper() in DESCENDING else F.col(c).asc_nulls_first() for c in self.key]

    def select(self, key: list | None = None, iterator: str = "EQ", offset: int = 0, limit: int | None = None, after: list | None = None) -> DataFrame:
        """Rows in key order. after: the key of the last row of the page before."""
        iterator = iterator if key else "ALL" if iterator == "EQ" else iterator
        out = self.df.where(self.where(iterator, key))
        if after is not None:
            out = out.where(_lexicographic(self.key, after, True, iterator.upper() not in DESCENDING))
        out = out.orderBy(*self.order(iterator))
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)

    def position(self, page: DataFrame) -> list | None:
        """The position after a page, for the next call's after."""
        rows = page.select(*self.key).tail(1)
        return list(rows[0]) if rows else None

    def count(self, key: list | None = None, iterator: str = "EQ") -> DataFrame:
        return self.df.where(self.where(iterator if key else "ALL", key)).agg(F.count(F.lit(1)).alias("n"))

    def min(self, key: list | None = None) -> DataFrame:
        """The first row by key, of those that have the leading key."""
        return self.df.where(self.where("EQ" if key else "ALL", key)).orderBy(*self.order("ALL")).limit(1)

    def max(self, key: list | None = None) -> DataFrame:
        return self.df.where(self.where("EQ" if key else "ALL", key)).orderBy(*self.order("REQ")).limit(1)

    def random(self, seed: int) -> DataFrame:
        """A row chosen by a seed: the least hash of seed and key."""
        return self.df.orderBy(F.xxhash64(F.lit(seed), *self.key), *self.key).limit(1)

    def quantile(self, level: float, begin: list | None = None, end: list | None = None) -> DataFrame:
        """The least key of the range [begin, end) below which at least the share level of its rows lies. One column or none in a small range."""
        if begin and end and not begin < end:
            raise ValueError("the range's begin must be less than its end")
        held = self.df.where((self.where("GE", begin) if begin else F.lit(True)) & (self.where("LT", end) if end else F.lit(True)))
        return held.agg(F.percentile_disc(self.key[0], F.lit(level)).alias("quantile")) if hasattr(F, "percentile_disc") else held.agg(F.expr(f"percentile_disc({level}) WITHIN GROUP (ORDER BY `{self.key[0]}`)").alias("quantile"))

    def offset_of(self, key: list, iterator: str = "GE") -> DataFrame:
        """How many rows stand before the iterator's first row."""
        before = {"GE": ("LT", key), "EQ": ("LT", key), "GT": ("LE", key), "LE": ("GT", key), "REQ": ("GT", key), "LT": ("GE", key)}[iterator.upper()]
        return self.df.where(self.where(*before)).agg(F.count(F.lit(1)).alias("n"))

    def len(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n"))


def hash_select(df: DataFrame, key: list[str], iterator: str, value: list | None = None) -> DataFrame:
    """A hash index: ALL, EQ and GT only."""
    if iterator.upper() not in HASH:
        raise Unsupported(f"a hash index has no iterator {iterator}")
    return df.where(Space(df, key).where(iterator, value))


def bits(df: DataFrame, column: str, iterator: str, mask: int = 0) -> DataFrame:
    """A bit-set index."""
    c, it = F.col(column).cast("long"), iterator.upper()
    if it not in BITSET:
        raise Unsupported(f"a bitset index has no iterator {iterator}")
    both = c.bitwiseAND(F.lit(mask))
    return df.where({"ALL": F.lit(True), "EQ": c == mask, "BITS_ALL_SET": both == mask, "BITS_ANY_SET": both != 0, "BITS_ALL_NOT_SET": both == 0}[it])


def box(df: DataFrame, low: list[str], high: list[str], iterator: str, key: list[float], limit: int | None = None, distance: str = "euclid") -> DataFrame:
    """An index of boxes. low, high: the columns of a row's corners; key: a point, or low and high corners.

    GE and GT: the row's box holds the key's (GT: strictly); LE and LT: it lies within; NEIGHBOR: nearest to the key's point first.
    """
    it, n = iterator.upper(), len(low)
    if it not in BOX:
        raise Unsupported(f"a box index has no iterator {iterator}")
    k_low, k_high = (key, key) if len(key) == n else (key[:n], key[n:])
    every = lambda tests: reduce(Column.__and__, tests)
    sides = list(zip(map(F.col, low), map(F.col, high), k_low, k_high))
    if it == "NEIGHBOR":
        gaps = [F.greatest(F.lit(float(a)) - h, lo - F.lit(float(b)), F.lit(0.0)) for lo, h, a, b in sides]
        far = reduce(Column.__add__, (g * g if distance == "euclid" else g for g in gaps))
        out = df.withColumn("distance", F.sqrt(far) if distance == "euclid" else far).orderBy("distance", *low)
        return out if limit is None else out.limit(limit)
    tests = {
        "ALL": [F.lit(True)],
        "EQ": [(lo == a) & (h == b) for lo, h, a, b in sides],
        "GE": [(lo <= a) & (h >= b) for lo, h, a, b in sides],
        "GT": [(lo < a) & (h > b) for lo, h, a, b in sides],
        "LE": [(lo >= a) & (h <= b) for lo, h, a, b in sides],
        "LT": [(lo > a) & (h < b) for lo, h, a, b in sides],
        "OVERLAPS": [(lo <= b) & (h >= a) for lo, h, a, b in sides],
    }
    return df.where(every(tests[it]))


def merge(sources: list[DataFrame], key: list[str], reverse: bool = False) -> DataFrame:
    """One ordered stream of several: a range-partitioned sort, so no task sees all rows."""
    union = reduce(DataFrame.unionByName, sources)
    return union.orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in key])


def multikey(df: DataFrame, array: str, into: str = "key") -> DataFrame:
    """A row per distinct element of an array field, as a multikey index has."""
    return df.withColumn(into, F.explode(F.array_distinct(array)))
