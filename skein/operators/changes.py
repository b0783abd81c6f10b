"""Changes of tables as DataFrames: inserts with conflict modes, updates, upserts, compaction, checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import recursion


class ConstraintError(ValueError):
    """Rows that break a table's constraint."""


def cut(df: DataFrame) -> DataFrame:
    """A written version: plans stay small, and files in the shared folder survive lost executors."""
    return recursion.cut(df)


def insert(old: DataFrame, new: DataFrame, unique: list[tuple[list[str], str]]) -> tuple[DataFrame, DataFrame | None, int]:
    """The rows of new that go in, what is left of old if rows of it go (else None), and how many rows changed.

    unique: column lists with their modes. ABORT, FAIL and ROLLBACK raise on a taken value; IGNORE keeps the row that was
    there; REPLACE the new one, and a row that goes counts as a change of its own. Nulls are never taken. Rows of new are
    taken in order, that of their column __n if there is one; the result has it too. new is read several times.
    """
    if not unique:
        return new, None, new.count()
    rows = new if "__n" in new.columns else new.withColumn("__n", F.monotonically_increasing_id())
    left, lost = old, None
    for columns, mode in unique:
        held = " AND ".join(f"`{c}` IS NOT NULL" for c in columns)
        if mode == "REPLACE":
            taken = rows.where(held).select(*columns).distinct()
            left, lost = left.join(taken, columns, "left_anti").select(*old.columns), True
            continue
        rest = old.join(rows.where(held).select(*columns).distinct(), columns, "left_semi").select(*columns).distinct()
        if mode == "IGNORE":
            rows = rows.join(rest, columns, "left_anti").select(*rows.columns)
        elif not rest.isEmpty():
            raise ConstraintError(f"duplicate key exists in unique index ({', '.join(columns)})")
    rows = cut(rows)
    n_replaced = 0
    by = lambda columns, down: Window.partitionBy(*columns).orderBy(F.col("__n").desc() if down else F.col("__n"))
    for columns, mode in unique:
        held = " AND ".join(f"`{c}` IS NOT NULL" for c in columns)
        if mode == "REPLACE":
            rows = rows.withColumn("__r", F.when(F.expr(held), F.row_number().over(by(columns, True))).otherwise(1)).where("__r = 1").drop("__r")
        elif mode != "IGNORE" and not rows.where(held).groupBy(*columns).count().where("count > 1").isEmpty():
            raise ConstraintError(f"duplicate key exists in unique index ({', '.join(columns)})")
    ignoring = [c for c, mode in unique if mode == "IGNORE"]
    if len(ignoring) == 1:
        held = " AND ".join(f"`{c}` IS NOT NULL" for c in ignoring[0])
        rows = rows.withColumn("__r", F.when(F.expr(held), F.row_number().over(by(ignoring[0], False))).otherwise(1)).where("__r = 1").drop("__r")
    elif ignoring:
        rows = _first_of_each(rows, ignoring)
    out = cut(rows.select(*old.columns, "__n"))
    n = out.count()
    if lost:
        left = cut(left)
        n_replaced = old.count() - left.count() + (new.count() - n if not ignoring else 0)
    return out, left if lost else None, n + n_replaced


def _first_of_each(rows: DataFrame, unique: list[list[str]]) -> DataFrame:
    """Rows in order of __n that conflict with no row kept before them. A round keeps what is first under all keys and drops what conflicts with it."""
    kept, open_ = rows.limit(0), rows
    while not open_.isEmpty():
        ranked = open_
        for i, columns in enumerate(unique):
            held = " AND ".join(f"`{c}` IS NOT NULL" for c in columns)
            ranked = ranked.withColumn(f"__r{i}", F.when(F.expr(held), F.row_number().over(Window.partitionBy(*columns).orderBy("__n"))).otherwise(1))
        first = cut(ranked.where(" AND ".join(f"__r{i} = 1" for i in range(len(unique)))).select(*rows.columns))
        kept = kept.unionByName(first)
        open_ = open_.join(first.select("__n"), "__n", "left_anti")
        for columns in unique:
            open_ = open_.join(first.select(*columns), columns, "left_anti")
        open_ = cut(open_.select(*rows.columns))
    return kept


def number_nulls(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """new with the column's nulls numbered in order, after the greatest value of old and new."""
    last = max(old.agg(F.max(column)).first()[0] or 0, new.agg(F.max(column)).first()[0] or 0)
    blank = new.where(F.col(column).isNull())
    order = ["__n"] if "__n" in new.columns else None
    return new.where(F.col(column).isNotNull()).unionByName(sequence(blank.drop(column), column, int(last) + 1, order_by=order).select(*new.columns))


def drop_nulls(new: DataFrame, meta: dict, mode: str | None) -> DataFrame:
    """new without the rows that a NOT NULL column ignores."""
    for c in meta.get("not_null", []):
        if (mode or meta.get("conflict", {}).get((c,), "ABORT")) == "IGNORE":
            new = new.where(F.col(c).isNotNull())
    return new


def validate(df: DataFrame, meta: dict, tables: dict[str, DataFrame]) -> None:
    """Raise if a key repeats, a column is null that must not be, a check fails or a reference dangles."""
    for columns in [*([meta["key"]] if meta.get("key") else []), *meta.get("unique", [])]:
        held = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
        if not held.groupBy(*columns).count().where("count > 1").isEmpty():
            raise ConstraintError(f"duplicate key exists in unique index ({', '.join(columns)})")
    for c in [*meta.get("not_null", []), *(meta.get("key") or []), *meta.get("key_not_null", [])]:
        if not df.where(F.col(c).isNull()).isEmpty():
            raise ConstraintError(f"{c} is null")
    for name, condition in meta.get("checks", {}).items():
        if not df.where(f"NOT ({condition})").isEmpty():
            raise ConstraintError(f"check constraint {name} failed")
    for columns, table, theirs in meta.get("foreign", []):
        if not dangling(df, columns, tables[table], theirs).isEmpty():
            raise ConstraintError(f"foreign key on {', '.join(columns)} is not in {table}")


def dangling(df: DataFrame, columns: list[str], parent: DataFrame, theirs: list[str]) -> DataFrame:
    """Rows whose reference isn't null and has no row in parent."""
    held = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    return held.join(parent.select(*[F.col(b).alias(a) for a, b in zip(columns, theirs)]).distinct(), columns, "left_anti")


def compact(log: DataFrame, key: list[str], lsn: str, op: str | None = None) -> DataFrame:
    """The newest version of each key; with op, keys whose newest version is a DELETE are gone."""
    newest = log.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(lsn).desc()))).where("__r = 1").drop("__r")
    return newest.where(F.col(op) != "DELETE") if op else newest


def add_up(base: DataFrame, ops: DataFrame, key: list[str], field: str, delta: str) -> DataFrame:
    """Upserts that only add: the sum of the deltas, on top of the old value; absent keys start at the first delta's insert value 0."""
    total = ops.groupBy(*key).agg(F.sum(delta).alias("__d"))
    return base.join(total, key, "full").select(*key, (F.coalesce(F.col(field), F.lit(0)) + F.coalesce("__d", F.lit(0))).alias(field))


def apply_ops(value: dict, ops: list[tuple]) -> dict:
    """Update operations on one row, in order; one that can't be applied is skipped.

    ops: (code, field, argument...) with = assign, + - & | ^ arithmetic, : splice (offset, length, text), # delete, ! insert.
    """
    out = dict(value)
    for code, name, *args in ops:
        try:
            if code == "=" or code == "!":
                out[name] = args[0]
            elif code == "#":
                out[name] = None
            elif code == "+":
                out[name] = out[name] + args[0]
            elif code == "-":
                out[name] = out[name] - args[0]
            elif code in "&|^":
                out[name] = {"&": int.__and__, "|": int.__or__, "^": int.__xor__}[code](int(out[name]), int(args[0]))
            elif code == ":":
                start, length, text = args
                s = out[name]
                start = start - 1 if start > 0 else len(s) + 1 + start if start < 0 else 0
                if start > len(s):
                    raise ValueError("offset past the end")
                stop = start + length if length >= 0 else max(start, len(s) + length)
                out[name] = s[:start] + text + s[stop:]
        except (TypeError, ValueError, KeyError, IndexError):
            continue
    return out


def upsert(base: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Fold upserts into base. log: (key..., lsn, tuple fields as in base, ops array<struct<code,field,number,text,start,length>>).

    An absent key inserts the tuple and skips the operations; an existing one takes the operations in order of lsn. The folds
    are by key, so a key's own history is all that one task holds.
    """
    fields = [c for c in base.columns if c not in key]
    schema, columns = base.schema, base.columns
    tagged = base.select(*base.columns, F.lit(-1).cast("long").alias("lsn"), F.lit(None).cast(log.schema["ops"].dataType).alias("ops"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        row: dict | None = None
        for r in pdf.sort_values("lsn").to_dict("records"):
            if row is None:
                row = {c: r[c] for c in columns}
                continue
            steps = []
            for o in r["ops"] if r["ops"] is not None else []:
                arg = o["text"] if o["number"] is None else o["number"]
                steps.append((o["code"], o["field"], o["start"], o["length"], o["text"]) if o["code"] == ":" else (o["code"], o["field"], arg))
            row = apply_ops({c: (None if pd.isna(row[c]) else row[c]) for c in columns}, steps)
        return pd.DataFrame([row], columns=columns)

    both = tagged.unionByName(log.select(*base.columns, "lsn", "ops"))
    return both.groupBy(*key).applyInPandas(fold, schema).select(*key, *fields)


def delete_range(df: DataFrame, column: str, begin: object, end: object) -> DataFrame:
    """df without begin <= column < end."""
    return df.where(~((F.col(column) >= F.lit(begin)) & (F.col(column) < F.lit(end))) | F.col(column).isNull())


def sequence(df: DataFrame, column: str, start: int = 1, step: int = 1, low: int | None = None, high: int | None = None, cycle: bool = False, order_by: list[str] | None = None) -> DataFrame:
    """Number rows densely. Counts per partition come first, so no task sees all rows."""
    ranged = df.repartitionByRange(*order_by) if order_by else df
    tagged = ranged.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    sizes = tagged.groupBy("__p").agg(F.count(F.lit(1)).alias("__size"), F.min("__i").alias("__first"))
    # a row per partition
    offsets = sizes.withColumn("__before", F.sum("__size").over(Window.orderBy("__p")) - F.col("__size")).select("__p", "__before")
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*(order_by or []), "__i")) - 1
    n = F.col("__before") + F.col("__k")
    value = F.lit(start) + n * step
    if cycle and low is not None and high is not None:
        span = (high - low) // abs(step) + 1
        first = (start - low) // abs(step) if step > 0 else (high - start) // abs(step)
        value = (F.lit(low) if step > 0 else F.lit(high)) + F.pmod(n + first, F.lit(span)) * step
    return tagged.withColumn("__k", within).join(F.broadcast(offsets), "__p").withColumn(column, value.cast("long")).drop("__p", "__i", "__k", "__before")
