"""Key definitions: parts with order and collation, as expressions over rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """One part: a field or path like 'a.b', its order, collation, and whether null parts exclude a row from the index."""

    field: str
    descending: bool = False
    collation: str | None = None
    exclude_null: bool = False

    def column(self, alias: str = "") -> Column:
        c = F.col(f"{alias}.{self.field}" if alias else self.field)
        return F.collate(c, self.collation) if self.collation else c


class KeyDef:
    def __init__(self, parts: list[Part]):
        self.parts = parts

    def extract(self, df: DataFrame) -> DataFrame:
        """The keys of rows; rows with a null excluding part have none."""
        held = reduce(DataFrame.where, (F.col(p.field).isNotNull() for p in self.parts if p.exclude_null), df)
        return held.select(*[p.column().alias(p.field.replace(".", "_")) for p in self.parts])

    def compare(self, a: str, b: str) -> Column:
        """-1, 0 or 1 for two aliased rows; null is least."""
        out = F.lit(0)
        for p in reversed(self.parts):
            x, y = p.column(a), p.column(b)
            less = (x < y) | (x.isNull() & y.isNotNull())
            more = (x > y) | (y.isNull() & x.isNotNull())
            out = F.when(less, 1 if p.descending else -1).when(more, -1 if p.descending else 1).otherwise(out)
        return out

    def order(self) -> list[Column]:
        return [p.column().desc_nulls_last() if p.descending else p.column().asc_nulls_first() for p in self.parts]

    def merge(self, other: KeyDef) -> KeyDef:
        """This key's parts, then those of the other whose fields it lacks."""
        mine = {p.field for p in self.parts}
        return KeyDef([*self.parts, *(p for p in other.parts if p.field not in mine)])

    def unique_violations(self, df: DataFrame) -> DataFrame:
        """Keys that several rows have; null parts never collide."""
        keys = self.extract(df).dropna()
        return keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
