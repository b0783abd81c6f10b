"""Statements that change or define something, read token by token: values may hold any text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from skein.plans.dialect import DialectError, Expr, Parser, Scope

MODES = frozenset({"ABORT", "FAIL", "ROLLBACK", "IGNORE", "REPLACE"})
#: What RAISE() puts before its message, and what RAISE(IGNORE) gives.
RAISED, IGNORED = "raised by trigger: ", "row ignored by trigger"


@dataclass
class Insert:
    table: str
    mode: str | None
    columns: list[str] | None
    sql: str | None


@dataclass
class Update:
    table: str
    mode: str | None
    values: dict[str, str]
    where: str | None


@dataclass
class Delete:
    table: str
    where: str | None


@dataclass
class Trigger:
    name: str
    when: str
    event: str
    of: list[str]
    table: str
    condition: str | None
    steps: list[str]


@dataclass
class Table:
    """Columns are (name, type, collation); checks and defaults are texts of the dialect."""

    name: str
    exists_ok: bool
    columns: list[tuple[str, str]] = field(default_factory=list)
    key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    named: dict[str, list[str]] = field(default_factory=dict)
    not_null: list[str] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    foreign: list[tuple[list[str], str, list[str]]] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    conflict: dict[tuple[str, ...], str] = field(default_factory=dict)
    sequence: str | None = None


class Program(Parser):
    """rowwise: the statement is a trigger's step, its rows may refer to NEW and OLD."""

    def __init__(self, text: str, kinds: Callable[[str], dict[str, str] | None], functions: dict[str, str] | None = None, settings: dict | None = None, rowwise: bool = False):
        super().__init__(text, kinds, functions, settings)
        self.rowwise = rowwise

    # tokens
    def text(self, start: int, stop: int) -> str:
        return " ".join(t for _, t in self.toks[start:stop])

    def span(self, *ends: str) -> str:
        """The text up to one of the words outside of brackets."""
        start, depth = self.at, 0
        while self.peek()[0] != "end":
            w = self.word()
            if depth == 0 and (w in ends or w == ")"):
                break
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(w, 0)
            self.at += 1
        return self.text(start, self.at)

    def bracketed(self) -> str:
        self.expect("(")
        got = self.span()
        self.expect(")")
        return got

    def end(self) -> None:
        self.accept(";")
        if self.peek()[0] != "end":
            raise DialectError(f"syntax error near {self.peek()[1]!r}")

    def mode(self) -> str | None:
        if not self.accept("OR"):
            return None
        return self._known_mode()

    def _known_mode(self) -> str:
        mode = self.name().upper()
        if mode not in MODES:
            raise DialectError(f"no such conflict mode: {mode}")
        return mode

    def on_table(self, name: str) -> None:
        """The table's columns come into reach."""
        kinds = self.kinds_of(name)
        if kinds is None:
            raise DialectError(f"no such table: {name}")
        self.scope = Scope(dict(kinds), self.scope)

    # rows of a step are selects, as they may refer to the trigger's row
    def arm(self) -> tuple[str, dict[str, str]]:
        if not self.rowwise or self.word() != "VALUES":
            return super().arm()
        self.expect("VALUES")
        rows: list[list[Expr]] = []
        while True:
            self.expect("(")
            row = [self.expr()]
            while self.accept(","):
                row.append(self.expr())
            self.expect(")")
            rows.append(row)
            if not self.accept(","):
                break
        sql = " UNION ALL ".join("SELECT " + ", ".join(f"{x.sql} AS COLUMN_{i + 1}" for i, x in enumerate(row)) for row in rows)
        return (f"SELECT * FROM ({sql})" if len(rows) > 1 else sql), {f"column_{i + 1}": x.kind for i, x in enumerate(rows[0])}

    def call(self, text: str, up: str) -> Expr:
        if up != "RAISE":
            return super().call(text, up)
        if not self.rowwise:
            raise DialectError("RAISE() may only be used within a trigger")
        self.expect("(")
        mode, message = self.name().upper(), None
        if self.accept(","):
            message = self.expr().sql
        self.expect(")")
        if mode not in ("IGNORE", "ROLLBACK", "ABORT", "FAIL") or (mode == "IGNORE") != (message is None):
            raise DialectError("RAISE takes IGNORE, or ROLLBACK, ABORT or FAIL and a message")
        return Expr(f"'{IGNORED}'" if message is None else f"cast(raise_error(concat('{RAISED}{mode}: ', {message}, char(10))) as string)")

    # changes
    def insert(self) -> Insert:
        if self.accept("REPLACE"):
            mode: str | None = "REPLACE"
        else:
            self.expect("INSERT")
            mode = self.mode()
        self.expect("INTO")
        table = self.name()
        columns = self._names() if self.word() == "(" and self.word(1) not in ("SELECT", "WITH", "VALUES", "(") else None
        sql = None if self.accept("DEFAULT", "VALUES") else self.query()[0]
        self.end()
        return Insert(table, mode, columns, sql)

    def update(self) -> Update:
        self.expect("UPDATE")
        mode, table, values = self.mode(), self.name(), {}
        self.expect("SET")
        self.on_table(table)
        while True:
            if self.word() == "(":
                names = self._names()
                self.expect("=", "(")
                row = [self.expr().sql]
                while self.accept(","):
                    row.append(self.expr().sql)
                self.expect(")")
                if len(row) != len(names):
                    raise DialectError(f"{len(names)} columns are assigned {len(row)} values")
                values |= dict(zip(names, row))
            else:
                column = self.name()
                self.expect("=")
                values[column] = self.expr().sql
            if not self.accept(","):
                break
        where = self.expr().sql if self.accept("WHERE") else None
        self.end()
        return Update(table, mode, values, where)

    def delete(self) -> Delete:
        self.expect("DELETE", "FROM")
        table = self.name()
        self.on_table(table)
        where = self.expr().sql if self.accept("WHERE") else None
        self.end()
        return Delete(table, where)

    # definitions
    def trigger(self) -> Trigger:
        self.expect("CREATE", "TRIGGER")
        self.accept("IF", "NOT", "EXISTS")
        name = self.name()
        when = next((w for w in ("BEFORE", "AFTER", "INSTEAD") if self.accept(w)), "BEFORE")
        if when == "INSTEAD":
            self.expect("OF")
        event, of = self.name().upper(), []
        if event not in ("INSERT", "UPDATE", "DELETE"):
            raise DialectError(f"no such event: {event}")
        if event == "UPDATE" and self.accept("OF"):
            of = [self.name()]
            while self.accept(","):
                of.append(self.name())
        self.expect("ON")
        table = self.name()
        self.accept("FOR", "EACH", "ROW")
        condition = self.span("BEGIN") if self.accept("WHEN") else None
        self.expect("BEGIN")
        steps: list[str] = []
        while not self.accept("END"):
            start, cases = self.at, 0
            while not (self.word() == ";" and cases == 0):
                if self.peek()[0] == "end":
                    raise DialectError("a trigger's steps end with ; and the program with END")
                cases += {"CASE": 1, "END": -1}.get(self.word(), 0)
                self.at += 1
            steps.append(self.text(start, self.at))
            self.at += 1
        self.end()
        if not steps:
            raise DialectError("a trigger has a step at least")
        return Trigger(name, when, event, of, table, condition, steps)

    def table(self) -> Table:
        self.expect("CREATE", "TABLE")
        exists_ok = self.accept("IF", "NOT", "EXISTS")
        t = Table(self.name(), exists_ok)
        self.expect("(")
        while True:
            self._item(t)
            if not self.accept(","):
                break
        self.expect(")")
        if self.accept("WITH"):
            self.span(";")
        self.end()
        if not t.columns:
            raise DialectError("a table has a column at least")
        return t

    def _conflict(self, t: Table, columns: list[str]) -> None:
        if self.accept("ON", "CONFLICT"):
            t.conflict[tuple(columns)] = self._known_mode()

    def _reference(self, t: Table, columns: list[str]) -> None:
        table = self.name().lower()
        t.foreign.append((columns, table, self._names() if self.word() == "(" else list(columns)))

    def key_columns(self, t: Table | None = None) -> list[str]:
        self.expect("(")
        out = []
        while True:
            out.append(self.name())
            if self.accept("COLLATE"):
                self.name()
            self.accept("ASC") or self.accept("DESC")
            if t is not None and self.accept("AUTOINCREMENT"):
                t.sequence = out[-1]
            if not self.accept(","):
                break
        self.expect(")")
        return out

    def _item(self, t: Table) -> None:
        name = self.name() if self.accept("CONSTRAINT") else None
        if self.accept("PRIMARY", "KEY"):
            t.key = self.key_columns(t)
            self._conflict(t, t.key)
            if name:
                t.named[name] = t.key
        elif self.accept("UNIQUE"):
            t.unique.append(self.key_columns())
            self._conflict(t, t.unique[-1])
            if name:
                t.named[name] = t.unique[-1]
        elif self.accept("CHECK"):
            t.checks[name or f"ck_{t.name}_{len(t.checks) + 1}"] = self.bracketed()
        elif self.accept("FOREIGN", "KEY"):
            columns = self._names()
            self.expect("REFERENCES")
            self._reference(t, columns)
        else:
            self._column(t)

    def _column(self, t: Table) -> None:
        column, kind = self.name(), self.name().upper()
        if self.word() == "(":
            self.bracketed()
        t.columns.append((column, kind))
        name = None
        while self.word() not in (",", ")") and self.peek()[0] != "end":
            if self.accept("CONSTRAINT"):
                name = self.name()
                continue
            if self.accept("PRIMARY", "KEY"):
                t.key.append(column)
                self.accept("ASC") or self.accept("DESC")
                self._conflict(t, [column])
            elif self.accept("AUTOINCREMENT"):
                t.sequence = column
            elif self.accept("UNIQUE"):
                t.unique.append([column])
                self._conflict(t, [column])
                if name:
                    t.named[name] = t.unique[-1]
            elif self.accept("NOT", "NULL"):
                t.not_null.append(column)
                self._conflict(t, [column])
            elif self.accept("NULL"):
                self._conflict(t, [column])
            elif self.accept("DEFAULT"):
                start = self.at
                x = self.unary()
                t.defaults[column] = x.sql
                if start == self.at:
                    raise DialectError("DEFAULT takes a value")
            elif self.accept("CHECK"):
                t.checks[name or f"ck_{t.name}_{len(t.checks) + 1}"] = self.bracketed()
            elif self.accept("REFERENCES"):
                self._reference(t, [column])
            elif self.accept("COLLATE"):
                self.name()
            else:
                raise DialectError(f"syntax error near {self.peek()[1]!r}")
            name = None
