import pytest

from skein.plans.dialect import DialectError, Parser, TypeMismatch, WrongArgCount

KINDS = {"t": {"a": "int", "b": "double", "s": "str", "v": "bin"}}


def spark_sql(text, **settings):
    return Parser(text, lambda n: KINDS.get(n.lower()), settings=settings).statement()


@pytest.mark.parametrize(
    "text, part",
    [
        ("SELECT a / 2 FROM t", "(`a` div 2)"),
        ("SELECT b / 2 FROM t", "(`b` / 2)"),
        ("SELECT AVG(a) FROM t", "(sum(`a`) div count(`a`))"),
        ("SELECT MAX(a), s FROM t", "max_by(`s`, `a`)"),
        ("SELECT a FROM SEQSCAN t NOT INDEXED", "FROM `t`"),
        ("SELECT a FROM t LIMIT 3, 4", "LIMIT 4 OFFSET 3"),
        ("SELECT a FROM t WHERE a IN t", "IN (SELECT * FROM `t`)"),
        ("SELECT [1, 2][2], {'k': 1}['k']", "try_element_at(map('k', 1), 'k')"),
        ("SELECT a == 1 FROM t", "(`a` = 1)"),
        ("SELECT COUNT(*) FROM t", "AS `COLUMN_1`"),
    ],
)
def test_rewrites(text, part):
    assert part in spark_sql(text)


@pytest.mark.parametrize("text", ["SELECT '1' + 2", "SELECT 1 || 'a'", "SELECT LENGTH(1)", "SELECT ABS('1')", "SELECT HEX('a')", "SELECT 1.5 & 1", "SELECT 9 >> -2", "SELECT a COLLATE \"unicode\" FROM t", "SELECT SUM(s) FROM t", "SELECT s || v FROM t", "SELECT s < 1 FROM t"])
def test_types(text):
    with pytest.raises(TypeMismatch):
        spark_sql(text)


@pytest.mark.parametrize("text", ["SELECT COUNT(DISTINCT a, b) FROM t", "SELECT SUM() FROM t", "SELECT SUBSTR('a')", "SELECT SUM(*) FROM t"])
def test_argument_counts(text):
    with pytest.raises(WrongArgCount):
        spark_sql(text)


@pytest.mark.parametrize(
    "text",
    ["SELECT SQRT(1)", "SELECT a FROM nothing", "SELECT a FROM t RIGHT JOIN t AS u ON 1 = 1", "SELECT a FROM t FULL OUTER JOIN t AS u ON 1 = 1", "SELECT a FROM t ORDER BY a UNION SELECT 1", "SELECT CAST(1 AS CHAR)", "SELECT 'x' COLLATE \"xx\"", "SELECT", " UNION ".join(["SELECT 1"] * 31)],
)
def test_rejected(text):
    with pytest.raises(DialectError):
        spark_sql(text)


def test_full_scans_can_be_forbidden():
    with pytest.raises(DialectError):
        spark_sql("SELECT a FROM t", sql_seq_scan=False)
    assert spark_sql("SELECT a FROM SEQSCAN t", sql_seq_scan=False)
