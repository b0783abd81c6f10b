"""The SQL dialect as Spark SQL text.

A recursive-descent parser reads a statement and writes Spark SQL. It carries a coarse static kind for every expression
(int, double, decimal, str, bin, bool, container or unknown), because some rules depend on it: division of integers
truncates, AVG of integers is an integer, || takes strings or bytes only, and text never turns into a number by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/|(?P<blob>[xX]'[0-9a-fA-F]*')|(?P<str>'(?:[^']|'')*')|(?P<qid>"(?:[^"]|"")*")|(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)"""
    r"""|(?P<bind>\?|[:@$][A-Za-z_0-9]+)|(?P<id>[A-Za-z_\x80-￿][A-Za-z_0-9$\x80-￿]*)|(?P<op>\|\||==|<>|<=|>=|!=|<<|>>|[-+*/%&|~<>=(),.;\[\]{}:])""",
    re.S | re.X,
)
NUMBERS = ("int", "double", "decimal", "number")
CLAUSES = frozenset("FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION EXCEPT INTERSECT ON USING JOIN INNER LEFT CROSS NATURAL AS THEN ELSE END WHEN AND OR NOT IN LIKE BETWEEN IS ASC DESC COLLATE ESCAPE SET VALUES SELECT INDEXED SEQSCAN MATCH REGEXP".split())
AGGREGATES = frozenset("COUNT SUM AVG TOTAL MIN MAX GROUP_CONCAT".split())


class DialectError(ValueError):
    """A statement that the dialect doesn't have."""


class TypeMismatch(DialectError):
    """An operand or argument of a kind that the operator doesn't take."""


class WrongArgCount(DialectError):
    """A function call with too few or too many arguments."""


@dataclass
class Expr:
    sql: str
    kind: str = "unknown"
    name: str | None = None
    aggregate: bool = False
    extreme: tuple[str, str] | None = None
    column: bool = False


@dataclass
class Scope:
    """Kinds of the columns in reach, by lower-case name."""

    kinds: dict[str, str] = field(default_factory=dict)
    parent: Scope | None = None

    def kind(self, name: str) -> str:
        scope: Scope | None = self
        while scope is not None:
            if name in scope.kinds:
                return scope.kinds[name]
            scope = scope.parent
        return "unknown"


def scan(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise DialectError(f"unrecognized token near {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return out


def _args(name: str, args: list[Expr], low: int, high: int) -> None:
    if not low <= len(args) <= high:
        raise WrongArgCount(f"{name}() takes {low}{'' if low == high else f' to {high}'} arguments, {len(args)} given")


def _want(name: str, x: Expr, *kinds: str) -> None:
    if x.kind not in ("unknown", "null", *kinds):
        raise TypeMismatch(f"{name} doesn't take {x.kind}")


def _simple(spark: str, kind: str | None, low: int, high: int, *wants: str) -> Callable[[str, list[Expr]], Expr]:
    def build(name: str, args: list[Expr]) -> Expr:
        _args(name, args, low, high)
        for x in args if wants else ():
            _want(name, x, *wants)
        return Expr(f"{spark}({', '.join(a.sql for a in args)})", kind or (args[0].kind if args else "unknown"))

    return build


def _substr(name: str, args: list[Expr]) -> Expr:
    _args(name, args, 2, 3)
    _want(name, args[0], "str", "bin")
    s, start = args[0].sql, args[1].sql
    if len(args) == 2:
        return Expr(f"substring({s}, greatest({start}, 1))", args[0].kind)
    end = f"({start}) + ({args[2].sql})"
    # positions before the first character count towards the length, and are empty
    return Expr(f"if({start} IS NULL OR {args[2].sql} IS NULL, NULL, substring({s}, greatest({start}, 1), greatest({end} - greatest({start}, 1), 0)))", args[0].kind)


def _round(name: str, args: list[Expr]) -> Expr:
    _args(name, args, 1, 2)
    _want(name, args[0], *NUMBERS)
    if args[0].kind == "int":
        return Expr(args[0].sql, "int")
    digits = re.sub(r"[\s()]", "", args[1].sql) if len(args) == 2 else "0"
    if not re.fullmatch(r"-?\d+", digits):
        raise DialectError("ROUND takes a whole constant number of digits")
    return Expr(f"round({args[0].sql}, {max(0, int(digits))})", args[0].kind)


def _char(name: str, args: list[Expr]) -> Expr:
    parts = [f"decode(unhex(lpad(hex(cast({a.sql} as bigint)), 8, '0')), 'UTF-32')" for a in args]
    return Expr(f"concat({', '.join(parts)})" if parts else "''", "str")


def _typeof(name: str, args: list[Expr]) -> Expr:
    _args(name, args, 1, 1)
    x = args[0].sql
    names = {"string": "string", "boolean": "boolean", "double": "double", "float": "double", "binary": "varbinary", "timestamp": "datetime"}
    cases = " ".join(f"WHEN typeof({x}) = '{a}' THEN '{b}'" for a, b in names.items())
    return Expr(f"CASE WHEN {x} IS NULL THEN 'NULL' {cases} WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint') THEN 'integer' WHEN typeof({x}) LIKE 'decimal%' THEN 'decimal' WHEN typeof({x}) LIKE 'array%' THEN 'array' WHEN typeof({x}) LIKE 'map%' THEN 'map' ELSE typeof({x}) END", "str")


def _quote(name: str, args: list[Expr]) -> Expr:
    _args(name, args, 1, 1)
    x = args[0]
    if x.kind == "bin":
        return Expr(f"if({x.sql} IS NULL, 'NULL', concat('X''', hex({x.sql}), ''''))", "str")
    if x.kind in NUMBERS or x.kind == "bool":
        return Expr(f"coalesce(upper(cast({x.sql} as string)), 'NULL')", "str")
    return Expr(f"coalesce(concat('''', replace({x.sql}, '''', ''''''), ''''), 'NULL')", "str")


def _position(name: str, args: list[Expr]) -> Expr:
    _args(name, args, 2, 2)
    return Expr(f"if(octet_length({args[0].sql}) = 0 AND {args[1].sql} IS NOT NULL, 1, locate({args[0].sql}, {args[1].sql}))", "int")


def _coalesce(name: str, args: list[Expr]) -> Expr:
    _args(name, args, 2, 127)
    kinds = {a.kind for a in args} - {"null"}
    return Expr(f"coalesce({', '.join(a.sql for a in args)})", kinds.pop() if len(kinds) == 1 else "unknown")


def _extreme(spark: str) -> Callable[[str, list[Expr]], Expr]:
    """GREATEST and LEAST: between kinds, boolean < number < string < bytes; the greatest kind alone decides."""
    order = {"bool": 0, "int": 1, "double": 1, "decimal": 1, "number": 1, "str": 2, "bin": 3}

    def build(name: str, args: list[Expr]) -> Expr:
        _args(name, args, 2, 127)
        ranks = {order[a.kind] for a in args if a.kind in order}
        if len(ranks) > 1:
            pick = (max if spark == "greatest" else min)(ranks)
            chosen = [a for a in args if order.get(a.kind) == pick]
        else:
            chosen = args
        nulls = " OR ".join(f"{a.sql} IS NULL" for a in args)
        value = f"{spark}({', '.join(a.sql for a in chosen)})" if len(chosen) > 1 else chosen[0].sql
        return Expr(f"if({nulls}, NULL, {value})", chosen[0].kind)

    return build


def _identity(low: int) -> Callable[[str, list[Expr]], Expr]:
    def build(name: str, args: list[Expr]) -> Expr:
        _args(name, args, low, low)
        return args[0]

    return build


def _printf(name: str, args: list[Expr]) -> Expr:
    _args(name, args, 1, 127)
    return Expr(f"printf({', '.join(a.sql for a in args)})", "str")


FUNCTIONS: dict[str, Callable[[str, list[Expr]], Expr]] = {
    "ABS": _simple("abs", None, 1, 1, *NUMBERS),
    "ROUND": _round,
    "LOWER": _simple("lower", "str", 1, 1, "str"),
    "UPPER": _simple("upper", "str", 1, 1, "str"),
    "LENGTH": _simple("length", "int", 1, 1, "str", "bin"),
    "CHAR_LENGTH": _simple("char_length", "int", 1, 1, "str"),
    "CHARACTER_LENGTH": _simple("char_length", "int", 1, 1, "str"),
    "UNICODE": _simple("ascii", "int", 1, 1, "str"),
    "CHAR": _char,
    "HEX": _simple("hex", "str", 1, 1, "bin"),
    "SOUNDEX": _simple("soundex", "str", 1, 1, "str"),
    "REPLACE": _simple("replace", "str", 3, 3, "str"),
    "NULLIF": _simple("nullif", None, 2, 2),
    "COALESCE": _coalesce,
    "IFNULL": _coalesce,
    "GREATEST": _extreme("greatest"),
    "LEAST": _extreme("least"),
    "SUBSTR": _substr,
    "SUBSTRING": _substr,
    "POSITION": _position,
    "TYPEOF": _typeof,
    "QUOTE": _quote,
    "PRINTF": _printf,
    "LIKELY": _identity(1),
    "UNLIKELY": _identity(1),
    "LIKELIHOOD": _identity(2),
    "NOW": lambda n, a: Expr("current_timestamp()", "datetime"),
    "UUID": lambda n, a: Expr("uuid()", "str"),
    "RANDOM": lambda n, a: Expr("cast((rand() - 0.5) * 18446744073709551615D as bigint)", "int"),
    "ZEROBLOB": lambda n, a: Expr(f"unhex(repeat('00', {a[0].sql}))", "bin"),
    "RANDOMBLOB": lambda n, a: Expr(f"substring(unhex(repeat(replace(uuid(), '-', ''), cast(ceil({a[0].sql} / 16.0) as int))), 1, {a[0].sql})", "bin"),
}


class Parser:
    def __init__(self, text: str, kinds: Callable[[str], dict[str, str] | None], functions: dict[str, str] | None = None, settings: dict | None = None):
        """kinds: column kinds of a table by name. functions: kinds of user functions by upper-case name."""
        self.toks, self.at, self.kinds_of = scan(text), 0, kinds
        self.user, self.settings = functions or {}, settings or {}
        self.scope, self.ctes, self.binds = Scope(), {}, 0

    # tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.toks[self.at + ahead] if self.at + ahead < len(self.toks) else ("end", "")

    def word(self, ahead: int = 0) -> str:
        kind, text = self.peek(ahead)
        return text.upper() if kind == "id" else text if kind == "op" else ""

    def take(self) -> tuple[str, str]:
        got = self.peek()
        self.at += 1
        return got

    def accept(self, *words: str) -> bool:
        if all(self.word(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise DialectError(f"syntax error near {self.peek()[1]!r}, {' '.join(words)} expected")

    def name(self) -> str:
        kind, text = self.take()
        if kind == "qid":
            return text[1:-1].replace('""', '"')
        if kind != "id":
            raise DialectError(f"syntax error near {text!r}, a name expected")
        return text

    # queries
    def statement(self) -> str:
        sql, _ = self.query()
        self.accept(";")
        if self.peek()[0] != "end":
            raise DialectError(f"syntax error near {self.peek()[1]!r}")
        return sql

    def query(self) -> tuple[str, dict[str, str]]:
        head = ""
        if self.accept("WITH"):
            recursive = "RECURSIVE " if self.accept("RECURSIVE") else ""
            parts = []
            while True:
                name = self.name()
                columns = self._names() if self.word() == "(" else []
                self.expect("AS", "(")
                self.ctes[name.lower()] = dict.fromkeys((c.lower() for c in columns), "unknown")
                sql, kinds = self.query()
                self.expect(")")
                own = dict(zip((c.lower() for c in columns), kinds.values())) if columns else kinds
                self.ctes[name.lower()] = own
                parts.append(f"`{name}`{'(' + ', '.join(f'`{c}`' for c in columns) + ')' if columns else ''} AS ({sql})")
                if not self.accept(","):
                    break
            head = f"WITH {recursive}{', '.join(parts)} "
        sql, kinds = self.arm()
        arms = 1
        while self.word() in ("UNION", "EXCEPT", "INTERSECT"):
            op = self.take()[1].upper()
            if op == "UNION" and self.accept("ALL"):
                op = "UNION ALL"
            right, _ = self.arm()
            sql = f"({sql}) {op} ({right})" if arms == 1 else f"({sql}) {op} ({right})"
            arms += 1
            if arms > 30:
                raise DialectError("too many terms in a compound query")
        outer, self.scope = self.scope, Scope(kinds, self.scope)
        if self.accept("ORDER", "BY"):
            keys = []
            while True:
                x = self.expr()
                if x.kind == "container":
                    raise TypeMismatch("ORDER BY doesn't take containers or intervals")
                keys.append(x.sql + (" DESC" if self.accept("DESC") else " ASC" if self.accept("ASC") else ""))
                if not self.accept(","):
                    break
            sql = f"{sql} ORDER BY {', '.join(keys)}" if arms == 1 else f"SELECT * FROM ({sql}) ORDER BY {', '.join(keys)}"
        if self.accept("LIMIT"):
            first = self.expr().sql
            if self.accept(","):  # LIMIT offset, count
                sql = f"{sql} LIMIT {self.expr().sql} OFFSET {first}"
            else:
                sql = f"{sql} LIMIT {first}" + (f" OFFSET {self.expr().sql}" if self.accept("OFFSET") else "")
        self.scope = outer
        if self.word() in ("UNION", "EXCEPT", "INTERSECT"):
            raise DialectError("ORDER BY and LIMIT come after the last term of a compound query")
        return head + sql, kinds

    def _names(self) -> list[str]:
        self.expect("(")
        out = [self.name()]
        while self.accept(","):
            out.append(self.name())
        self.expect(")")
        return out

    def arm(self) -> tuple[str, dict[str, str]]:
        if self.accept("VALUES"):
            rows = []
            while True:
                self.expect("(")
                row = [self.expr()]
                while self.accept(","):
                    row.append(self.expr())
                self.expect(")")
                rows.append(row)
                if not self.accept(","):
                    break
            names = [f"COLUMN_{i + 1}" for i in range(len(rows[0]))]
            body = ", ".join("(" + ", ".join(x.sql for x in row) + ")" for row in rows)
            return f"SELECT * FROM VALUES {body} AS v({', '.join(names)})", {n.lower(): x.kind for n, x in zip(names, rows[0])}
        if self.word() == "(" and self.word(1) in ("SELECT", "WITH", "VALUES"):
            self.expect("(")
            sql, kinds = self.query()
            self.expect(")")
            return sql, kinds
        self.expect("SELECT")
        distinct = "DISTINCT " if self.accept("DISTINCT") else ""
        self.accept("ALL")
        start, depth = self.at, 0
        # the select list needs the sources' kinds: read FROM first
        while self.peek()[0] != "end" and not (depth == 0 and (self.word() in ("FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "EXCEPT", "INTERSECT", ";") or self.word() == ")")):
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(self.word(), 0)
            self.at += 1
        outer = self.scope
        self.scope = Scope({}, outer)
        source = f" FROM {self.sources()}" if self.accept("FROM") else ""
        after, self.at = self.at, start
        items = self.items()
        self.at = after
        aliases = {x.name.lower(): x.kind for x in items if x.name}
        where = f" WHERE {self.expr().sql}" if self.accept("WHERE") else ""
        group = ""
        columns, self.scope = self.scope, Scope(aliases, self.scope)
        if self.accept("GROUP", "BY"):
            keys = [self.expr().sql]
            while self.accept(","):
                keys.append(self.expr().sql)
            group = f" GROUP BY {', '.join(keys)}"
        having = f" HAVING {self.expr().sql}" if self.accept("HAVING") else ""
        self.scope = columns
        extremes = [x.extreme for x in items if x.extreme]
        if len(extremes) == 1 and any(x.column for x in items):  # bare columns take the row of the extreme
            pick = "max_by" if extremes[0][0] == "max" else "min_by"
            keys = group.removeprefix(" GROUP BY ").split(", ")
            for x in items:
                if x.column and x.sql not in keys:
                    x.sql = f"{pick}({x.sql}, {extremes[0][1]})"
        listed, kinds, number = [], {}, 0
        for x in items:
            if x.name is None:
                number += 1
                x.name = f"COLUMN_{number}"
            if x.sql == "*" or x.sql.endswith(".*"):
                listed.append(x.sql)
                kinds |= columns.kinds
            else:
                listed.append(f"{x.sql} AS `{x.name}`")
                kinds[x.name.lower()] = x.kind
        self.scope = outer
        return f"SELECT {distinct}{', '.join(listed)}{source}{where}{group}{having}", kinds

    def items(self) -> list[Expr]:
        out = []
        while True:
            if self.accept("*"):
                out.append(Expr("*", name="*"))
            elif self.peek()[0] in ("id", "qid") and self.word(1) == "." and self.word(2) == "*":
                out.append(Expr(f"`{self.name()}`.*", name="*"))
                self.at += 2
            else:
                x = self.expr()
                x = Expr(x.sql, x.kind, x.name, x.aggregate, x.extreme, x.column)
                if self.accept("AS"):
                    x.name = self.name()
                elif self.peek()[0] in ("id", "qid") and self.word() not in CLAUSES:
                    x.name = self.name()
                out.append(x)
            if not self.accept(","):
                return out

    def sources(self) -> str:
        sql = self.source()
        while True:
            if self.accept(","):
                sql += f" CROSS JOIN {self.source()}"
                continue
            natural = self.accept("NATURAL")
            kind = "INNER"
            if self.accept("LEFT"):
                self.accept("OUTER")
                kind = "LEFT"
            elif self.accept("CROSS"):
                kind = "CROSS"
            elif self.word() in ("RIGHT", "FULL"):
                raise DialectError("there are no RIGHT and FULL OUTER JOINs")
            else:
                self.accept("INNER")
            if not self.accept("JOIN"):
                return sql
            right = self.source()
            on = ""
            if self.accept("ON"):
                on = f" ON {self.expr().sql}"
            elif self.accept("USING"):
                on = f" USING ({', '.join(f'`{n}`' for n in self._names())})"
            if natural:
                sql += f" NATURAL {'LEFT' if kind == 'LEFT' else 'INNER'} JOIN {right}"
            else:
                kind = "CROSS" if not on and kind != "LEFT" else "INNER" if kind == "CROSS" else kind
                sql += f" {kind} JOIN {right}{on if on or kind != 'LEFT' else ' ON true'}"

    def source(self) -> str:
        marked = self.accept("SEQSCAN")
        if self.accept("("):
            if self.word() in ("SELECT", "WITH", "VALUES"):
                sql, kinds = self.query()
                self.expect(")")
                self.scope.kinds |= kinds
                sql = f"({sql})"
            else:
                sql = f"({self.sources()})"
                self.expect(")")
        else:
            name = self.name()
            if self.word() == "(":  # a table function
                self.at += 1
                args = [] if self.word() == ")" else [self.expr().sql]
                while self.accept(","):
                    args.append(self.expr().sql)
                self.expect(")")
                sql = f"{name}({', '.join(args)})"
            else:
                kinds = self.ctes.get(name.lower())
                if kinds is None:
                    kinds = self.kinds_of(name)
                    if kinds is None:
                        raise DialectError(f"no such table: {name}")
                self.scope.kinds |= kinds
                if not marked and self.settings.get("sql_seq_scan") is False and name.lower() not in self.ctes and self.word() != "WHERE":
                    raise DialectError(f"scanning is not allowed for {name}")
                sql = f"`{name}`"
        if self.accept("AS"):
            sql += f" AS `{self.name()}`"
        elif self.peek()[0] in ("id", "qid") and self.word() not in CLAUSES and self.word() not in ("RIGHT", "FULL"):
            sql += f" AS `{self.name()}`"
        if self.accept("INDEXED", "BY"):
            self.name()
        else:
            self.accept("NOT", "INDEXED")
        return sql

    # expressions, from the loosest to the tightest
    def expr(self) -> Expr:
        x = self.conjunction()
        while self.accept("OR"):
            y = self.conjunction()
            x = Expr(f"({x.sql} OR {y.sql})", "bool", aggregate=x.aggregate or y.aggregate)
        return x

    def conjunction(self) -> Expr:
        x = self.negation()
        while self.accept("AND"):
            y = self.negation()
            x = Expr(f"({x.sql} AND {y.sql})", "bool", aggregate=x.aggregate or y.aggregate)
        return x

    def negation(self) -> Expr:
        if self.word() == "NOT" and self.word(1) != "EXISTS":
            self.at += 1
            x = self.negation()
            return Expr(f"(NOT {x.sql})", "bool", aggregate=x.aggregate)
        return self.comparison()

    def comparison(self) -> Expr:
        x = self.bits()
        while True:
            w = self.word()
            if w in ("=", "==", "<>", "!=", "<", "<=", ">", ">="):
                self.at += 1
                y = self.bits()
                if {x.kind, y.kind} >= {"str", "int"} or {x.kind, y.kind} >= {"str", "double"}:
                    raise TypeMismatch(f"{x.kind} doesn't compare with {y.kind}")
                x = Expr(f"({x.sql} {'=' if w == '==' else w} {y.sql})", "bool", aggregate=x.aggregate or y.aggregate)
            elif self.accept("IS", "NOT", "NULL"):
                x = Expr(f"({x.sql} IS NOT NULL)", "bool", aggregate=x.aggregate)
            elif self.accept("IS", "NULL"):
                x = Expr(f"({x.sql} IS NULL)", "bool", aggregate=x.aggregate)
            elif w in ("BETWEEN", "IN", "LIKE", "MATCH", "REGEXP") or (w == "NOT" and self.word(1) in ("BETWEEN", "IN", "LIKE", "MATCH", "REGEXP")):
                no = "NOT " if self.accept("NOT") else ""
                x = self.predicate(x, self.take()[1].upper(), no)
            else:
                return x

    def predicate(self, x: Expr, op: str, no: str) -> Expr:
        if op == "BETWEEN":
            low = self.bits()
            self.expect("AND")
            return Expr(f"({x.sql} {no}BETWEEN {low.sql} AND {self.bits().sql})", "bool", aggregate=x.aggregate)
        if op == "LIKE":
            _want("LIKE", x, "str")
            pattern = self.bits()
            escape = f" ESCAPE {self.bits().sql}" if self.accept("ESCAPE") else ""
            if not escape and "\\" in pattern.sql:  # a backslash is an ordinary character here
                pattern.sql = pattern.sql.replace("\\\\", "\\\\\\\\")
            return Expr(f"({x.sql} {no}LIKE {pattern.sql}{escape})", "bool", aggregate=x.aggregate)
        if op in ("MATCH", "REGEXP"):
            return Expr(f"({no}rlike({x.sql}, {self.bits().sql}))", "bool", aggregate=x.aggregate)
        if self.accept("("):
            if self.word() in ("SELECT", "WITH", "VALUES"):
                sql, _ = self.query()
                self.expect(")")
                return Expr(f"({x.sql} {no}IN ({sql}))", "bool", aggregate=x.aggregate)
            values = [] if self.word() == ")" else [self.expr().sql]
            while self.accept(","):
                values.append(self.expr().sql)
            self.expect(")")
            if not values:
                return Expr("true" if no else "false", "bool")
            return Expr(f"({x.sql} {no}IN ({', '.join(values)}))", "bool", aggregate=x.aggregate)
        return Expr(f"({x.sql} {no}IN (SELECT * FROM {self.source()}))", "bool", aggregate=x.aggregate)

    def _left(self, ops: tuple[str, ...], below: Callable[[], Expr], build: Callable[[str, Expr, Expr], Expr]) -> Expr:
        x = below()
        while self.peek()[0] == "op" and self.word() in ops:
            op = self.take()[1]
            y = below()
            z = build(op, x, y)
            z.aggregate = x.aggregate or y.aggregate
            x = z
        return x

    def bits(self) -> Expr:
        def build(op: str, x: Expr, y: Expr) -> Expr:
            for e in (x, y):
                _want(op, e, "int")
            if op in ("<<", ">>"):
                if y.sql.startswith("(-") or y.sql.startswith("-"):
                    raise TypeMismatch("a shift count can't be negative")
                return Expr(f"{'shiftleft' if op == '<<' else 'shiftrightunsigned'}(cast({x.sql} as bigint), cast({y.sql} as int))", "int")
            return Expr(f"({x.sql} {op} {y.sql})", "int")

        return self._left(("&", "|", "<<", ">>"), self.sums, build)

    def _arithmetic(self, op: str, x: Expr, y: Expr) -> Expr:
        for e in (x, y):
            _want(op, e, *NUMBERS, *(("datetime", "interval") if op in "+-" else ()))
        kinds = {x.kind, y.kind} - {"null"}
        kind = kinds.pop() if len(kinds) == 1 else "double" if "double" in kinds else "decimal" if kinds == {"int", "decimal"} else "unknown"
        if op == "/" and kind == "int":
            return Expr(f"({x.sql} div {y.sql})", "int")
        if op in "+-*" and kind == "int":
            # literals are ints in Spark, and integers here have 64 bits
            return Expr(f"(cast({x.sql} as bigint) {op} {y.sql})", "int")
        return Expr(f"({x.sql} {op} {y.sql})", kind)

    def sums(self) -> Expr:
        return self._left(("+", "-"), lambda: self._left(("*", "/", "%"), self.joined, self._arithmetic), self._arithmetic)

    def joined(self) -> Expr:
        def build(op: str, x: Expr, y: Expr) -> Expr:
            for e in (x, y):
                _want("||", e, "str", "bin")
            if {x.kind, y.kind} == {"str", "bin"}:
                raise TypeMismatch("|| takes two strings or two varbinaries")
            return Expr(f"concat({x.sql}, {y.sql})", x.kind if x.kind != "unknown" else y.kind)

        return self._left(("||",), self.unary, build)

    def unary(self) -> Expr:
        if self.peek()[0] == "op" and self.word() in ("-", "+", "~"):
            op = self.take()[1]
            x = self.unary()
            _want(op, x, *(("int",) if op == "~" else NUMBERS))
            return Expr(x.sql if op == "+" else f"({op}{x.sql})", x.kind, aggregate=x.aggregate)
        x = self.primary()
        while True:
            if self.accept("COLLATE"):
                name = self.name().lower()
                known = {"binary": "UTF8_BINARY", "unicode": "UNICODE", "unicode_ci": "UNICODE_CI", "none": "UTF8_BINARY"}
                if name not in known:
                    raise DialectError(f"no such collation: {name}")
                _want("COLLATE", x, "str")
                x = Expr(f"({x.sql} COLLATE {known[name]})", "str", aggregate=x.aggregate)
            elif self.word() == "[":
                self.at += 1
                key = self.expr()
                self.expect("]")
                _want("[]", x, "container")
                x = Expr(f"try_element_at({x.sql}, {key.sql})", "unknown")
            else:
                return x

    def primary(self) -> Expr:
        kind, text = self.take()
        if kind == "num":
            if re.fullmatch(r"\d+", text):
                return Expr(text, "int")
            return Expr(f"{text}D" if "e" not in text.lower() else text, "double")
        if kind == "str":
            body = text[1:-1].replace("''", "'").replace("\\", "\\\\").replace("'", "\\'")
            return Expr(f"'{body}'", "str")
        if kind == "blob":
            return Expr(f"X{text[1:]}", "bin")
        if kind == "bind":
            if text == "?":
                return Expr("?")
            return Expr(":" + (f"p{text[1:]}" if text[1:].isdigit() else text[1:]))
        if text == "(":
            if self.word() in ("SELECT", "WITH", "VALUES"):
                sql, kinds = self.query()
                self.expect(")")
                return Expr(f"({sql})", next(iter(kinds.values()), "unknown"))
            parts = [self.expr()]
            while self.accept(","):
                parts.append(self.expr())
            self.expect(")")
            if len(parts) == 1:
                return Expr(f"({parts[0].sql})" if not parts[0].sql.startswith("(") else parts[0].sql, parts[0].kind, aggregate=parts[0].aggregate)
            return Expr(f"({', '.join(p.sql for p in parts)})", "row")
        if text == "[":
            values = [] if self.word() == "]" else [self.expr()]
            while self.accept(","):
                values.append(self.expr())
            self.expect("]")
            mixed = len({v.kind for v in values} - {"null"}) > 1
            if mixed:
                return Expr("parse_json(to_json(array(" + ", ".join(f"to_variant_object({v.sql})" for v in values) + ")))", "container")
            return Expr(f"array({', '.join(v.sql for v in values)})", "container")
        if text == "{":
            pairs = []
            while self.word() != "}":
                k = self.expr()
                kind, text = self.peek()
                if kind == "bind" and text[0] == ":":  # a colon and a plain value, not a parameter
                    self.toks[self.at : self.at + 1] = scan(text[1:])
                else:
                    self.expect(":")
                pairs += [k.sql, self.expr().sql]
                if not self.accept(","):
                    break
            self.expect("}")
            return Expr(f"map({', '.join(pairs)})", "container")
        if kind not in ("id", "qid"):
            raise DialectError(f"syntax error near {text!r}")
        up = text.upper() if kind == "id" else ""
        if up == "NULL" or up == "UNKNOWN":
            return Expr("NULL" if up == "NULL" else "cast(NULL as boolean)", "null" if up == "NULL" else "bool")
        if up in ("TRUE", "FALSE"):
            return Expr(up.lower(), "bool")
        if up == "EXISTS" or (up == "NOT" and self.accept("EXISTS")):
            self.expect("(")
            sql, _ = self.query()
            self.expect(")")
            return Expr(f"({'NOT ' if up == 'NOT' else ''}EXISTS ({sql}))", "bool")
        if up == "CASE":
            return self.case()
        if up == "CAST" and self.word() == "(":
            return self.cast()
        if up == "TRIM" and self.word() == "(":
            return self.trim()
        if self.word() == "(":
            return self.call(text, up)
        self.at -= 1
        name = self.name()
        if self.word() == "." and self.peek(1)[0] in ("id", "qid"):
            self.at += 1
            column = self.name()
            return Expr(f"`{name}`.`{column}`", self.scope.kind(column.lower()), column, column=True)
        return Expr(f"`{name}`", self.scope.kind(name.lower()), name, column=True)

    def case(self) -> Expr:
        sql = "CASE" + (f" {self.expr().sql}" if self.word() != "WHEN" else "")
        kinds, aggregate = set(), False
        while self.accept("WHEN"):
            cond = self.expr()
            self.expect("THEN")
            x = self.expr()
            kinds.add(x.kind)
            aggregate |= x.aggregate or cond.aggregate
            sql += f" WHEN {cond.sql} THEN {x.sql}"
        if self.accept("ELSE"):
            x = self.expr()
            kinds.add(x.kind)
            aggregate |= x.aggregate
            sql += f" ELSE {x.sql}"
        self.expect("END")
        kinds -= {"null"}
        return Expr(f"({sql} END)", kinds.pop() if len(kinds) == 1 else "unknown", aggregate=aggregate)

    def cast(self) -> Expr:
        self.expect("(")
        x = self.expr()
        self.expect("AS")
        name = self.name().upper()
        size = ""
        if self.accept("("):
            size = f"({self.take()[1]})"
            self.expect(")")
        self.expect(")")
        types = {
            "INT": ("bigint", "int"), "INTEGER": ("bigint", "int"), "UNSIGNED": ("bigint", "int"), "DOUBLE": ("double", "double"), "NUMBER": ("double", "double"), "DECIMAL": ("decimal(38,10)", "decimal"), "DEC": ("decimal(38,10)", "decimal"),
            "TEXT": ("string", "str"), "STRING": ("string", "str"), "VARCHAR": (f"varchar{size or '(65535)'}", "str"), "VARBINARY": ("binary", "bin"), "BOOL": ("boolean", "bool"), "BOOLEAN": ("boolean", "bool"), "SCALAR": (None, x.kind), "ANY": (None, x.kind),
            "UUID": ("string", "str"), "DATETIME": ("timestamp", "datetime"),
        }
        if name not in types:
            raise DialectError(f"no such type: {name}")
        target, kind = types[name]
        if target is None:
            return x
        if kind == "int" and x.kind == "double":
            return Expr(f"cast({x.sql} as bigint)", "int", aggregate=x.aggregate)
        return Expr(f"cast({x.sql} as {target})", kind, aggregate=x.aggregate)

    def trim(self) -> Expr:
        self.expect("(")
        where = self.word() if self.word() in ("LEADING", "TRAILING", "BOTH") else ""
        if where:
            self.at += 1
        x = None if self.word() == "FROM" else self.expr()
        if self.accept("FROM"):
            chars, x = x, self.expr()
        else:
            chars = None
        self.expect(")")
        _want("TRIM", x, "str", "bin")
        what = chars.sql if chars else "X'00'" if x.kind == "bin" else "' '"
        sql = f"trim({where or 'BOTH'} {what} FROM {x.sql})"
        return Expr(f"cast({sql} as binary)" if x.kind == "bin" else sql, x.kind)

    def call(self, text: str, up: str) -> Expr:
        self.expect("(")
        distinct = self.accept("DISTINCT")
        if self.accept("*"):
            self.expect(")")
            if up != "COUNT":
                raise WrongArgCount(f"{up}() doesn't take *")
            return Expr("count(*)", "int", aggregate=True)
        args = [] if self.word() == ")" else [self.expr()]
        while self.accept(","):
            args.append(self.expr())
        self.expect(")")
        if distinct and len(args) != 1:
            raise WrongArgCount("a DISTINCT aggregate takes one argument")
        if up in AGGREGATES and not (up in ("MIN", "MAX") and len(args) > 1):
            x = self.aggregate(up, args, "DISTINCT " if distinct else "")
            x.aggregate = True
            return x
        if up == "ROW_COUNT":
            _args(up, args, 0, 0)
            return Expr(f"cast({self.settings.get('row_count', 0)} as bigint)", "int")
        if up == "LIKE":  # LIKE(pattern, text[, escape])
            _args(up, args, 2, 3)
            _want(up, args[1], "str")
            pattern = args[0].sql if len(args) == 3 else args[0].sql.replace("\\\\", "\\\\\\\\")
            return Expr(f"({args[1].sql} LIKE {pattern}{f' ESCAPE {args[2].sql}' if len(args) == 3 else ''})", "bool", aggregate=any(a.aggregate for a in args))
        if up in FUNCTIONS:
            x = FUNCTIONS[up](up, args)
            x = Expr(x.sql, x.kind, aggregate=any(a.aggregate for a in args))
            return x
        if up in self.user:
            return Expr(f"{text}({', '.join(a.sql for a in args)})", self.user[up], aggregate=any(a.aggregate for a in args))
        raise DialectError(f"Function '{up}' does not exist")

    def aggregate(self, up: str, args: list[Expr], distinct: str) -> Expr:
        if up == "GROUP_CONCAT":
            _args(up, args, 1, 2)
            _want(up, args[0], "str", "bin")
            sep = args[1].sql if len(args) == 2 else "','"
            return Expr(f"listagg({distinct}{args[0].sql}, {sep}) WITHIN GROUP (ORDER BY {args[0].sql})", "str")
        if up == "COUNT":
            _args(up, args, 0, 1)
            return Expr(f"count({distinct}{args[0].sql if args else '*'})", "int")
        _args(up, args, 1, 1)
        x = args[0]
        if up in ("MIN", "MAX"):
            return Expr(f"{up.lower()}({x.sql})", x.kind, extreme=(up.lower(), x.sql))
        _want(up, x, *NUMBERS)
        if up == "TOTAL":
            return Expr(f"coalesce(sum({distinct}cast({x.sql} as double)), 0.0D)", "double")
        if up == "AVG" and x.kind == "int":
            return Expr(f"(sum({distinct}{x.sql}) div count({distinct}{x.sql}))", "int")
        return Expr(f"{up.lower()}({distinct}{x.sql})", x.kind)
