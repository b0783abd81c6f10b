"""An engine over named tables: the dialect, its data definition and its data changes, on DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import changes, recursion
from skein.plans.dialect import DialectError, Parser, scan
from skein.plans.program import IGNORED, RAISED, Program, Trigger

#: Changes on a table's plan before it is cut to a written version, and appended parts before they are put together.
DEEP, PARTS = 8, 8


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    for types, kind in (((T.DecimalType,), "decimal"), ((T.StringType,), "str"), ((T.BinaryType,), "bin"), ((T.BooleanType,), "bool"), ((T.ArrayType, T.MapType), "container"), ((T.TimestampType, T.DateType), "datetime")):
        if isinstance(data_type, types):
            return kind
    return "unknown"


class Engine:
    """Tables are DataFrames under names; a change of a table is a new DataFrame under the same name.

    Readers that hold the old one are not disturbed: that is the read view.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.meta: dict[str, dict] = {}
        self.functions: dict[str, str] = {}
        self.settings: dict[str, object] = {"sql_seq_scan": True}
        self.prepared: dict[int, tuple[str, int]] = {}
        self.version = 0
        self.changed = 0
        self.triggers: dict[str, Trigger] = {}
        self.views: dict[str, tuple[str, list[str]]] = {}
        self.fresh = 0
        self.saved: list[tuple[str | None, dict, dict, dict]] = []

    # catalog
    def register(self, name: str, df: DataFrame, key: list[str] | None = None, **meta: object) -> DataFrame:
        """Put a table under a name. meta: unique (list of column lists), not_null, checks, foreign, defaults, conflict, sequence."""
        self.tables[name.lower()] = df
        self.meta[name.lower()] = {"key": key or [], **meta}
        df.createOrReplaceTempView(name)
        self.version += 1
        return df

    def drop(self, name: str) -> None:
        low = name.lower()
        if low not in self.tables:
            raise DialectError(f"no such table: {name}")
        for other, meta in self.meta.items():
            if other != low and any(parent == low for _, parent, _ in meta.get("foreign", [])):
                raise changes.ConstraintError(f"{other} refers to {name}")
        del self.tables[low], self.meta[low]
        self.views.pop(low, None)
        for trigger in [t for t, x in self.triggers.items() if x.table == low]:
            del self.triggers[trigger]
        self.spark.catalog.dropTempView(name)
        self.version += 1

    def rename(self, name: str, to: str) -> None:
        df, meta = self.tables[name.lower()], self.meta[name.lower()]
        del self.tables[name.lower()], self.meta[name.lower()]
        self.spark.catalog.dropTempView(name)
        for other in self.meta.values():
            other["foreign"] = [(c, to.lower() if t == name.lower() else t, r) for c, t, r in other.get("foreign", [])]
        for trigger in self.triggers.values():
            trigger.table = to.lower() if trigger.table == name.lower() else trigger.table
        self.register(to, df, **meta)

    def upgrade(self, name: str, migrate: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Migrate a table's rows by a function of its DataFrame; its constraints hold for the new rows too."""
        meta = self.meta[name.lower()]
        df = changes.cut(migrate(self.tables[name.lower()]))
        changes.validate(df, meta, self.tables)
        return self.register(name, df, **meta)

    def add_column(self, name: str, column: str, data_type: str, default: object = None) -> DataFrame:
        df = self.tables[name.lower()].withColumn(column, F.lit(default).cast(data_type))
        return self.register(name, df, **self.meta[name.lower()])

    def function(self, name: str, returns: str, body: str | Callable, params: list[str] | None = None) -> None:
        """A user function: a SQL expression over its parameters (like 'a:bigint'), or a Python function."""
        kinds = {"bigint": "int", "int": "int", "double": "double", "string": "str", "boolean": "bool", "binary": "bin"}
        if callable(body):
            self.spark.udf.register(name, body, returns)
        else:
            args = ", ".join(p.replace(":", " ") for p in params or [])
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
        self.functions[name.upper()] = kinds.get(returns, "unknown")

    def _kinds(self, name: str) -> dict[str, str] | None:
        df = self.tables.get(name.lower())
        return None if df is None else {f.name.lower(): kind_of(f.dataType) for f in df.schema.fields}

    def table_function(self, name: str, body: str, params: list[str] | None = None, returns: list[str] | None = None) -> None:
        """A function that gives a table, for FROM name(...) and IN name(...): a query of the dialect over its parameters (like 'a:bigint')."""
        args = ", ".join(p.replace(":", " ") for p in params or [])
        columns = ", ".join(c.replace(":", " ") for c in returns or [])
        kinds = {p.split(":")[0].lower(): {"bigint": "int", "int": "int", "double": "double", "string": "str"}.get(p.split(":")[1], "unknown") for p in params or []}
        parser = self.parser(body)
        parser.scope.kinds |= kinds
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE{f'({columns})' if columns else ''} RETURN {parser.statement()}")

    def parser(self, text: str, rowwise: bool = False) -> Program:
        self._views()
        return Program(text, self._kinds, self.functions, {**self.settings, "row_count": self.changed}, rowwise)

    def translate(self, text: str) -> str:
        return self.parser(text).statement()

    def _views(self) -> None:
        """Views are queries: what they hold follows the tables. One whose tables are gone is gone until they are back."""
        if self.fresh == self.version or not self.views:
            return
        for name, (text, columns) in self.views.items():
            self.tables.pop(name, None)
            try:
                df = self.spark.sql(Program(text, self._kinds, self.functions, self.settings).statement())
            except DialectError:
                self.spark.catalog.dropTempView(name)
                continue
            self.register(name, df.toDF(*columns) if columns else df, view=text)
        self.fresh = self.version

    # statements
    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """Run one statement; changes return a row with their count."""
        words = [t.upper() for k, t in scan(text)[:4] if k in ("id", "op")]
        head = words[0] if words else ""
        if head in ("SELECT", "VALUES", "WITH", "("):
            sql = self._limits(self.translate(text))
            self.changed = 0
            return self.spark.sql(sql, args=args) if args else self.spark.sql(sql)
        if head == "EXPLAIN":
            plan = self.spark.sql(self.translate(re.sub(r"^\s*EXPLAIN(\s+QUERY\s+PLAN)?", "", text, flags=re.I)))
            lines = plan._jdf.queryExecution().simpleString().split("\n")
            return self.spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "step int, detail string")
        if head == "PRAGMA":
            return self._pragma(text)
        if head == "SHOW":
            return self._show(text)
        if head == "SET":
            m = re.fullmatch(r"\s*SET\s+SESSION\s+\"?(\w+)\"?\s*=\s*(.+?);?\s*", text, re.I | re.S)
            if not m:
                raise DialectError("SET SESSION name = value expected")
            value = m[2].strip("'\"")
            self.settings[m[1].lower()] = {"TRUE": True, "FALSE": False}.get(value.upper(), value)
            return self._count(0)
        if head in ("INSERT", "REPLACE"):
            return self._insert(text)
        if head == "UPDATE":
            return self._update(text)
        if head == "DELETE":
            return self._delete(text)
        if head == "TRUNCATE":
            parser = self.parser(text)
            parser.expect("TRUNCATE", "TABLE")
            name = parser.name().lower()
            parser.end()
            empty = self._writable(name).limit(0)
            self._referenced(name, empty)
            self.register(name, empty, **self.meta[name])
            return self._count(0)
        if head in ("START", "BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE"):
            return self._transaction(words)
        if words[1:2] == ["TRIGGER"]:
            return self._trigger(text)
        if head in ("CREATE", "DROP", "ALTER"):
            return self._define(text)
        raise DialectError(f"no such statement: {head}")

    def _count(self, n: int) -> DataFrame:
        self.changed = n
        return self.spark.createDataFrame([(n,)], "row_count bigint")

    def row_count(self) -> int:
        """Rows that the last statement changed."""
        return self.changed

    def _limits(self, sql: str) -> str:
        """A LIMIT may be any expression; Spark wants a constant, so a subquery is evaluated first."""
        m = re.search(r" LIMIT (\(SELECT .*\))$", sql, re.S)
        return sql if not m else f"{sql[: m.start()]} LIMIT {self.spark.sql(f'SELECT {m[1]} AS n').first()['n']}"

    def prepare(self, text: str) -> int:
        self.prepared[hash(text)] = (text, self.version)
        return hash(text)

    def execute(self, handle: int, args: dict | list | None = None) -> DataFrame:
        """Run a prepared statement; it is compiled anew, so a changed schema is no matter."""
        return self.sql(self.prepared[handle][0], args)

    def recursive(self, seed: str, step: Callable[[DataFrame], DataFrame], distinct: bool = True, order_by: list[str] | None = None, limit: int | None = None) -> DataFrame:
        return recursion.iterate(self.sql(seed), step, distinct=distinct, order_by=order_by, limit=limit)

    def _state(self) -> tuple[dict, dict, dict]:
        return dict(self.tables), {k: dict(v) for k, v in self.meta.items()}, dict(self.views)

    # transactions: a savepoint is the tables as they are, which is only names for immutable plans
    def _transaction(self, words: list[str]) -> DataFrame:
        head, name = words[0], words[-1] if len(words) > 1 and words[-1] not in ("TRANSACTION", "START") else None
        if head in ("START", "BEGIN"):
            if any(n is None for n, *_ in self.saved):
                raise DialectError("a transaction is open")
            self.saved.append((None, *self._state()))
        elif not self.saved:
            raise DialectError("no transaction is open")
        elif head == "SAVEPOINT":
            self.saved.append((name, *self._state()))
        elif head == "COMMIT":
            self.saved.clear()
        else:
            at = next((i for i in range(len(self.saved) - 1, -1, -1) if self.saved[i][0] == (name if name not in ("ROLLBACK", "COMMIT") else None)), None)
            if at is None:
                raise DialectError(f"no savepoint {name}")
            if head == "RELEASE":
                del self.saved[at:]
            else:
                _, tables, meta, self.views = self.saved[at]
                for gone in set(self.tables) - set(tables):
                    self.spark.catalog.dropTempView(gone)
                self.tables, self.meta = {}, {}
                for table, df in tables.items():
                    self.register(table, df, **meta[table])
                del self.saved[at + (name is not None) :]
        return self._count(0)

    # triggers: each step runs once per statement, over all of its rows
    def _trigger(self, text: str) -> DataFrame:
        parser = self.parser(text)
        if parser.accept("DROP", "TRIGGER"):
            quiet = parser.accept("IF", "EXISTS")
            if self.triggers.pop(parser.name(), None) is None and not quiet:
                raise DialectError("no such trigger")
            return self._count(1)
        made = parser.trigger()
        made.table, made.of = made.table.lower(), [c.lower() for c in made.of]
        if made.table not in self.tables:
            raise DialectError(f"no such table: {made.table}")
        self.triggers[made.name] = made
        return self._count(1)

    def _fire(self, when: str, event: str, table: str, rows: DataFrame, changed: set[str] = frozenset()) -> tuple[bool, DataFrame]:
        """Run the triggers over rows {NEW, OLD, row}; whether one ran, and the rows that none of them told to ignore."""
        fired = False
        for t in list(self.triggers.values()):
            if (t.when, t.event, t.table) != (when, event, table) or (t.of and not {c.lower() for c in changed} & set(t.of)):
                continue
            fired = True
            sides = {f"{side}.{c}".lower(): k for side in ("NEW", "OLD") if side in rows.columns for c, k in (self._kinds(table) or {}).items()}
            own = rows
            if t.condition:
                parser = self.parser(t.condition, rowwise=True)
                parser.scope.kinds |= {k.split(".")[1]: v for k, v in sides.items()}
                own = rows.where(parser.expr().sql)
            for step in t.steps:
                ignored = self._step(step, own, table)
                if ignored is not None:
                    rows, own = (x.join(ignored, "row", "left_anti") for x in (rows, own))
        return fired, rows

    def _step(self, text: str, rows: DataFrame, table: str) -> DataFrame | None:
        """One step over the trigger's rows; the numbers of the rows that it ignores, if it may."""
        parser = self.parser(text, rowwise=True)
        parser.scope.kinds |= self._kinds(table) or {}
        head = parser.word()
        if head in ("INSERT", "REPLACE"):
            step = parser.insert()
            columns = step.columns or self.tables[step.table.lower()].columns
            new = self._lateral(rows, step.sql).toDF("row", *columns).orderBy("row").drop("row") if step.sql else rows.select()
            self._add(step.table.lower(), new, columns if step.sql else [], step.mode)
            return None
        if head == "DELETE":
            step = parser.delete()
            name = step.table.lower()
            held = self._writable(name)
            gone = held.join(rows, F.expr(step.where or "true"), "left_semi")
            self._remove(name, gone, held.join(rows, F.expr(f"({step.where or 'true'})"), "left_anti"))
            return None
        if head == "UPDATE":
            step = parser.update()
            name = step.table.lower()
            held = changes.cut(self._writable(name).withColumn("__target", F.monotonically_increasing_id()))
            hits = changes.cut(held.select("*").join(rows, F.expr(step.where or "true")).select("__target", "row", *[c for c in ("NEW", "OLD") if c in rows.columns]))
            turns = hits.groupBy("__target").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
            if turns > 1 and set(re.findall(r"`([^`]+)`", step.where or "")) & set(step.values):
                raise DialectError("several rows of one statement update the same row, whose condition they change")
            order = hits.withColumn("turn", F.row_number().over(Window.partitionBy("__target").orderBy("row")))
            for turn in range(1, turns + 1):  # as often as one row is hit
                now = order.where(F.col("turn") == turn).drop("turn", "row")
                both = held.join(now.withColumn("__hit", F.lit(True)), "__target", "left")
                held = changes.cut(both.select("__target", *[F.when(F.col("__hit"), F.expr(step.values[c])).otherwise(F.col(c)).cast(held.schema[c].dataType).alias(c) if c in step.values else F.col(c) for c in held.columns if c != "__target"]))
            result = held.drop("__target")
            changes.validate(result, self.meta[name], self.tables)
            self._referenced(name, result)
            self.register(name, result, **self.meta[name])
            return None
        sql = parser.statement()
        try:
            seen = changes.cut(self._lateral(rows, sql))  # evaluates what it raises
        except Exception as e:
            found = re.search(re.escape(RAISED) + r"(\w+): ([^\n]*)", str(e))
            if not found:
                raise
            if found[1] == "ROLLBACK" and self.saved:
                self._transaction(["ROLLBACK"])
            raise changes.ConstraintError(found[2]) from None
        if IGNORED not in sql:
            return None
        told = " OR ".join(f"cast(`{c}` as string) = '{IGNORED}'" for c in seen.columns if c != "row")
        return seen.where(told).select("row").distinct()

    def _lateral(self, rows: DataFrame, sql: str) -> DataFrame:
        """The rows' numbers beside the rows of a query that may refer to NEW and OLD."""
        rows.createOrReplaceTempView("__trigger_rows")
        out = self.spark.sql(f"SELECT t.row, q.* FROM __trigger_rows t, LATERAL ({sql}) q")
        self.spark.catalog.dropTempView("__trigger_rows")
        return out

    @staticmethod
    def _sides(new: DataFrame | None = None, old: list[str] | None = None) -> DataFrame:
        """Rows {NEW, OLD, row} for triggers; of a change that has both, OLD's columns are those with a prefix."""
        columns = []
        if new is not None:
            plain = [c for c in new.columns if not c.startswith("__old_") and c != "__n"]
            columns.append(F.struct(*plain).alias("NEW"))
        if old is not None:
            columns.append(F.struct(*[F.col(f"__old_{c}").alias(c) for c in old]).alias("OLD"))
        return new.select(*columns, (F.col("__n") if "__n" in new.columns else F.monotonically_increasing_id()).alias("row"))

    # data changes
    def _writable(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise DialectError(f"no such table: {name}")
        if name in self.views:
            raise DialectError(f"{name} is a view")
        return self.tables[name]

    def _referenced(self, name: str, result: DataFrame, columns: set[str] | None = None) -> None:
        """Raise if rows of other tables, or of this one, lose the row they refer to."""
        for other, meta in self.meta.items():
            for own, parent, theirs in meta.get("foreign", []):
                if parent == name and (columns is None or columns & set(theirs)):
                    child = result if other == name else self.tables[other]
                    if not changes.dangling(child, own, result, theirs).isEmpty():
                        raise changes.ConstraintError(f"{other} refers to rows of {name}")

    def _put(self, name: str, result: DataFrame, part: DataFrame | None = None) -> None:
        """The table's next version. Appended parts are put together now and then, and a plan of many changes is written, so plans stay small."""
        meta = self.meta[name]
        base, parts = meta.get("parts", (None, []))
        if part is not None:
            base, parts = (self.tables[name], [part]) if base is None else (base, [*parts, part])
            if len(parts) > PARTS:
                merged = parts[0]
                for x in parts[1:]:
                    merged = merged.unionByName(x)
                parts = [changes.cut(merged)]
            result = base
            for x in parts:
                result = result.unionByName(x)
            meta["parts"] = (base, parts)
        else:
            meta.pop("parts", None)
            meta["depth"] = meta.get("depth", 0) + 1
            if meta["depth"] >= DEEP:
                result, meta["depth"] = changes.cut(result), 0
        self.register(name, result, **meta)

    def _insert(self, text: str) -> DataFrame:
        step = self.parser(text).insert()
        name = step.table.lower()
        if name not in self.tables:
            raise DialectError(f"no such table: {step.table}")
        columns = step.columns or self.tables[name].columns
        new = self.spark.sql(self._limits(step.sql)).toDF(*columns) if step.sql else self.spark.createDataFrame([()], T.StructType([]))
        return self._count(self._add(name, new, columns if step.sql else [], step.mode))

    def _add(self, name: str, new: DataFrame, columns: list[str], mode: str | None) -> int:
        old, meta = self.tables[name], self.meta[name]
        given = {c.lower(): c for c in columns}
        kinds = {f.name: f.dataType for f in old.schema.fields}
        defaults = meta.get("defaults", {})
        # a default stands for a column that isn't named, not for a null that is
        new = new.select(*[(F.col(given[c.lower()]) if c.lower() in given else F.expr(defaults.get(c, "NULL"))).cast(kinds[c]).alias(c) for c in old.columns])
        new = changes.cut(new.withColumn("__n", F.monotonically_increasing_id()))  # files have no order
        if meta.get("sequence"):
            new = changes.cut(changes.number_nulls(old, new, meta["sequence"]))
        fired, rows = self._fire("INSTEAD", "INSERT", name, self._sides(new))
        if fired:
            return new.count()
        self._writable(name)
        fired, rows = self._fire("BEFORE", "INSERT", name, self._sides(new))
        old = self.tables[name]
        if fired:
            new = changes.cut(rows.select("NEW.*", F.col("row").alias("__n")))
        unique = [u for u in [meta["key"], *meta.get("unique", [])] if u]
        modes = [mode or meta.get("conflict", {}).get(tuple(u), "ABORT") for u in unique]
        new = changes.drop_nulls(new, meta, mode)
        kept, gone, n = changes.insert(old, new, list(zip(unique, modes)))
        rows, new = self._sides(kept), kept.drop("__n")
        changes.validate(new, {**meta, "unique": [], "key_not_null": meta["key"], "key": []}, {**self.tables, name: old.unionByName(new)})
        if gone is None:
            self._put(name, old, new)
        else:
            result = gone.unionByName(new)
            self._referenced(name, result)
            self._put(name, result)
        self._fire("AFTER", "INSERT", name, rows)
        return n

    def _update(self, text: str) -> DataFrame:
        step = self.parser(text).update()
        name, where = step.table.lower(), step.where or "true"
        df, meta = self.tables[name], self.meta[name]
        names = {c.lower(): c for c in df.columns}
        if unknown := [c for c in step.values if c.lower() not in names]:
            raise DialectError(f"no such column: {unknown[0]}")
        values = {names[c.lower()]: v for c, v in step.values.items()}
        new = {c: F.expr(values[c]).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns}
        both = df.where(where).select(*new.values(), *[F.col(c).alias(f"__old_{c}") for c in df.columns])
        watched = any(t.event == "UPDATE" and t.table == name for t in self.triggers.values())
        if watched:
            both = changes.cut(both)
            sides = self._sides(both, df.columns)
            fired, _ = self._fire("INSTEAD", "UPDATE", name, sides, set(values))
            if fired:
                return self._count(both.count())
            fired, sides = self._fire("BEFORE", "UPDATE", name, sides, set(values))
            if fired:
                both = changes.cut(sides.select("NEW.*", *[F.col(f"OLD.{c}").alias(f"__old_{c}") for c in df.columns]))
        df = self._writable(name)
        n = both.count() if watched else df.where(where).count()
        rest = df.where(f"NOT coalesce({where}, false)")
        if watched and meta["key"]:  # rows that a trigger told to ignore stay as they are
            spared = df.where(where).join(both.select(*[F.col(f"__old_{c}").alias(c) for c in meta["key"]]), meta["key"], "left_anti").select(*df.columns)
            rest = rest.unionByName(spared)
        changed = both.select(*df.columns)
        if step.mode in ("IGNORE", "REPLACE"):
            unique = [(u, step.mode) for u in [meta["key"], *meta.get("unique", [])] if u and set(u) & set(values)]
            kept, left, _ = changes.insert(rest, changes.cut(changed), unique)
            kept = kept.select(*df.columns)
            out = (rest if left is None else left).unionByName(kept)
            if step.mode == "IGNORE" and meta["key"]:
                lost = both.join(kept.select(*meta["key"]), meta["key"], "left_anti")
                out = out.unionByName(lost.select(*[F.col(f"__old_{c}").alias(c) for c in df.columns]))
        elif "SELECT" in where or watched:
            out = rest.unionByName(changed)
        else:
            out = df.select(*[F.when(F.expr(where), new[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])
        touched = set(values)
        held = {**meta, "unique": [u for u in meta.get("unique", []) if set(u) & touched], "key": meta["key"] if set(meta["key"]) & touched else []}
        changes.validate(out, held, {**self.tables, name: out})
        self._referenced(name, out, touched)
        self._put(name, out)
        if watched:
            self._fire("AFTER", "UPDATE", name, self._sides(both, df.columns), set(values))
        return self._count(n)

    def _condition(self, name: str, text: str) -> str:
        parser = self.parser(text)
        parser.on_table(name)
        return parser.expr().sql

    def _delete(self, text: str) -> DataFrame:
        step = self.parser(text).delete()
        name, where = step.table.lower(), step.where or "true"
        df = self.tables[name]
        gone = changes.cut(df.where(where))
        sides = self._sides(gone.select(*[F.col(c).alias(f"__old_{c}") for c in df.columns]), df.columns).drop("NEW")
        if self._fire("INSTEAD", "DELETE", name, sides)[0]:
            return self._count(gone.count())
        fired, rows = self._fire("BEFORE", "DELETE", name, sides)
        rest = self._writable(name).where(f"NOT coalesce({where}, false)")
        if fired:
            left = changes.cut(rows.select("OLD.*"))
            rest = rest.unionByName(gone.exceptAll(left))
            gone = left
        self._remove(name, gone, rest)
        sides = self._sides(gone.select(*[F.col(c).alias(f"__old_{c}") for c in df.columns]), df.columns).drop("NEW")
        self._fire("AFTER", "DELETE", name, sides)
        return self._count(gone.count())

    def _remove(self, name: str, gone: DataFrame, rest: DataFrame) -> None:
        self._referenced(name, rest)
        self._put(name, rest)

    # definitions
    def _define(self, text: str) -> DataFrame:
        t = text.strip().rstrip(";")
        words = [w.upper() for _, w in scan(t)[:2]]
        if words == ["CREATE", "TABLE"]:
            self._create(t)
        elif words == ["CREATE", "VIEW"]:
            parser = self.parser(t)
            parser.expect("CREATE", "VIEW")
            quiet, name = parser.accept("IF", "NOT", "EXISTS"), parser.name().lower()
            columns = parser._names() if parser.word() == "(" else []
            parser.expect("AS")
            body = parser.text(parser.at, len(parser.toks))
            if name in self.tables:
                if not quiet:
                    raise DialectError(f"{name} exists")
            else:
                self.translate(body)
                self.views[name] = (body, columns)
                self.version += 1
                self._views()
        elif m := re.fullmatch(r"CREATE\s+(UNIQUE\s+)?INDEX\s+\"?(\w+)\"?\s+ON\s+\"?(\w+)\"?\s*\(([^)]*)\)", t, re.I | re.S):
            meta, columns = self.meta[m[3].lower()], [c.split()[0].strip('"') for c in m[4].split(",")]
            meta.setdefault("indexes", {})[m[2]] = (bool(m[1]), columns)
            if m[1]:
                meta.setdefault("unique", []).append(columns)
                changes.validate(self.tables[m[3].lower()], {"unique": [columns]}, self.tables)
        elif m := re.fullmatch(r"DROP\s+INDEX\s+\"?(\w+)\"?\s+ON\s+\"?(\w+)\"?", t, re.I):
            unique, columns = self.meta[m[2].lower()]["indexes"].pop(m[1])
            if unique:
                self.meta[m[2].lower()]["unique"].remove(columns)
        elif m := re.fullmatch(r"DROP\s+(TABLE|VIEW)\s+(IF\s+EXISTS\s+)?\"?(\w+)\"?", t, re.I):
            if m[3].lower() in self.tables and (m[3].lower() in self.views) != (m[1].upper() == "VIEW"):
                raise DialectError(f"{m[3]} is a {'view' if m[3].lower() in self.views else 'table'}")
            if not m[2] or m[3].lower() in self.tables:
                self.drop(m[3])
        elif m := re.fullmatch(r"ALTER\s+TABLE\s+\"?(\w+)\"?\s+RENAME\s+TO\s+\"?(\w+)\"?", t, re.I):
            self.rename(m[1], m[2])
        elif m := re.fullmatch(r"ALTER\s+TABLE\s+\"?(\w+)\"?\s+ADD\s+COLUMN\s+\"?(\w+)\"?\s+(\w+)", t, re.I):
            self.add_column(m[1], m[2], self._type(m[3]))
        elif m := re.fullmatch(r"ALTER\s+TABLE\s+\"?(\w+)\"?\s+ADD\s+CONSTRAINT\s+\"?(\w+)\"?\s+(CHECK|UNIQUE|PRIMARY\s+KEY)\s*\((.*)\)", t, re.I | re.S):
            meta = self.meta[m[1].lower()]
            if m[3].upper() == "CHECK":
                meta.setdefault("checks", {})[m[2]] = self._condition(m[1].lower(), m[4])
            else:
                columns = [c.strip().strip('"') for c in m[4].split(",")]
                meta.setdefault("named", {})[m[2]] = columns
                if m[3].upper() == "UNIQUE":
                    meta.setdefault("unique", []).append(columns)
                else:
                    meta["key"] = columns
            changes.validate(self.tables[m[1].lower()], meta, self.tables)
        elif m := re.fullmatch(r"ALTER\s+TABLE\s+\"?(\w+)\"?\s+DROP\s+CONSTRAINT\s+\"?(\w+)\"?", t, re.I):
            meta = self.meta[m[1].lower()]
            if m[2] in meta.get("checks", {}):
                del meta["checks"][m[2]]
            else:
                columns = meta.get("named", {}).pop(m[2])
                if columns in meta.get("unique", []):
                    meta["unique"].remove(columns)
        else:
            raise DialectError(f"no such definition: {t[:60]}")
        return self._count(1)

    @staticmethod
    def _type(name: str) -> str:
        types = {"INT": "bigint", "INTEGER": "bigint", "UNSIGNED": "bigint", "DOUBLE": "double", "NUMBER": "double", "DECIMAL": "decimal(38,10)", "TEXT": "string", "STRING": "string", "VARCHAR": "string", "UUID": "string", "BOOLEAN": "boolean", "BOOL": "boolean", "VARBINARY": "binary", "DATETIME": "timestamp", "SCALAR": "variant", "ANY": "variant"}
        if name.upper() not in types:
            raise DialectError(f"no such type: {name}")
        return types[name.upper()]

    def _create(self, text: str) -> None:
        t = self.parser(text).table()
        name = t.name.lower()
        if name in self.tables:
            if t.exists_ok:
                return
            raise DialectError(f"{t.name} exists")
        if len({c.lower() for c, _ in t.columns}) < len(t.columns):
            raise DialectError("a column is there twice")
        fields = ", ".join(f"`{c}` {self._type(kind)}" for c, kind in t.columns)
        meta = {"key": t.key, "unique": t.unique, "named": t.named, "not_null": t.not_null, "checks": {}, "foreign": t.foreign, "defaults": t.defaults, "conflict": t.conflict, "sequence": t.sequence}
        for columns, parent, theirs in t.foreign:
            if parent != name and parent not in self.tables or len(columns) != len(theirs):
                raise DialectError(f"a foreign key refers to no table {parent}")
        self.register(t.name, self.spark.createDataFrame([], fields), **meta)
        self.meta[name]["checks"] = {k: self._condition(name, v) for k, v in t.checks.items()}

    def _pragma(self, text: str) -> DataFrame:
        m = re.match(r"\s*PRAGMA\s+(\w+)(?:\s*\(\s*\"?(\w+)\"?(?:\.\"?(\w+)\"?)?\s*\))?", text, re.I)
        what, name = m[1].lower(), (m[2] or "").lower()
        if what == "table_info":
            df, meta = self.tables[name], self.meta[name]
            rows = [(i, f.name, kind_of(f.dataType), f.name in meta.get("not_null", []) + meta["key"], meta.get("defaults", {}).get(f.name), meta["key"].index(f.name) + 1 if f.name in meta["key"] else 0) for i, f in enumerate(df.schema.fields)]
            return self.spark.createDataFrame(rows, "cid int, name string, type string, notnull boolean, dflt_value string, pk int")
        if what == "index_list":
            rows = [(i, k, v[0]) for i, (k, v) in enumerate(self.meta[name].get("indexes", {}).items())]
            return self.spark.createDataFrame(rows, "seq int, name string, is_unique boolean")
        if what == "index_info":
            rows = [(i, c) for i, c in enumerate(self.meta[name]["indexes"][m[3]][1])]
            return self.spark.createDataFrame(rows, "seqno int, name string")
        if what == "foreign_key_list":
            rows = [(i, t, ",".join(a), ",".join(b)) for i, (a, t, b) in enumerate(self.meta[name].get("foreign", []))]
            return self.spark.createDataFrame(rows, "id int, referenced string, from_columns string, to_columns string")
        if what == "collation_list":
            return self.spark.createDataFrame([(0, "none"), (1, "unicode"), (2, "unicode_ci"), (3, "binary")], "seq int, name string")
        if what == "stats":
            rows = [(t, self.tables[t].count()) for t in sorted(self.tables)]
            return self.spark.createDataFrame(rows, "table_name string, n_rows bigint")
        raise DialectError(f"no such pragma: {what}")

    def _show(self, text: str) -> DataFrame:
        m = re.match(r"\s*SHOW\s+CREATE\s+TABLE(?:\s+\"?(\w+)\"?)?", text, re.I)
        if not m:
            raise DialectError("SHOW CREATE TABLE expected")
        names = {"int": "INTEGER", "double": "DOUBLE", "decimal": "DECIMAL", "str": "STRING", "bin": "VARBINARY", "bool": "BOOLEAN", "datetime": "DATETIME"}
        rows = []
        for name in [m[1].lower()] if m[1] else sorted(self.tables):
            df, meta = self.tables[name], self.meta[name]
            lines = [f"{f.name} {names.get(kind_of(f.dataType), 'ANY')}{' NOT NULL' if f.name in meta.get('not_null', []) else ''}{' DEFAULT ' + meta['defaults'][f.name] if f.name in meta.get('defaults', {}) else ''}" for f in df.schema.fields]
            lines += [f"PRIMARY KEY({', '.join(meta['key'])})"] if meta["key"] else []
            lines += [f"UNIQUE({', '.join(u)})" for u in meta.get("unique", [])]
            lines += [f"CONSTRAINT {k} CHECK({v})" for k, v in meta.get("checks", {}).items()]
            lines += [f"FOREIGN KEY({', '.join(a)}) REFERENCES {t}({', '.join(b)})" for a, t, b in meta.get("foreign", [])]
            rows.append((f"CREATE TABLE {name} (" + ", ".join(lines) + ")",))
        return self.spark.createDataFrame(rows, "statement string")
