import pytest

from skein.operators.changes import ConstraintError, apply_ops, sequence, upsert
from skein.operators.recursion import CircularError, closure, iterate
from skein.plans.engine import Engine


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE null_t (a INT PRIMARY KEY, b INT, c INT)")
    e.sql("INSERT INTO null_t VALUES (1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1), (5, NULL, 0), (6, NULL, 1), (7, NULL, NULL)")
    return e


def values(df):
    return [tuple(r) for r in df.collect()]


def test_nulls(engine):
    assert values(engine.sql("SELECT a FROM null_t WHERE b IS NULL ORDER BY a")) == [(5,), (6,), (7,)]
    assert values(engine.sql("SELECT b FROM null_t ORDER BY b, a"))[:3] == [(None,)] * 3
    assert values(engine.sql("SELECT COUNT(*) AS n, COUNT(b) AS m, SUM(b) AS s, AVG(b) AS v, TOTAL(b) AS t FROM null_t")) == [(7, 4, 2, 0, 2.0)]
    assert values(engine.sql("SELECT a FROM null_t WHERE NOT (b = 1 AND c = 1) ORDER BY a")) == [(1,), (2,), (3,), (5,)]
    assert len(values(engine.sql("SELECT DISTINCT b FROM null_t"))) == 3


def test_keys_and_modes(engine):
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO null_t VALUES (1, 5, 5)")
    engine.sql("INSERT OR IGNORE INTO null_t VALUES (1, 5, 5), (8, 5, 5)")
    assert engine.row_count() == 1
    engine.sql("REPLACE INTO null_t VALUES (1, 9, 9)")
    assert engine.row_count() == 2
    assert values(engine.sql("SELECT b FROM null_t WHERE a = 1")) == [(9,)]
    engine.sql("DELETE FROM null_t WHERE b IS NULL")
    assert engine.row_count() == 3
    engine.sql("SELECT 1")
    assert engine.row_count() == 0
    engine.sql("TRUNCATE TABLE null_t")
    assert engine.row_count() == 0 and values(engine.sql("SELECT COUNT(*) AS n FROM null_t")) == [(0,)]


def test_constraints(engine):
    engine.sql("CREATE TABLE kid (id INT PRIMARY KEY, p INT REFERENCES null_t (a), n INT NOT NULL, CHECK (n > 0))")
    engine.sql("INSERT INTO kid VALUES (1, 1, 1), (2, NULL, 1)")
    for bad in ("(3, 99, 1)", "(3, 1, 0)", "(3, 1, NULL)", "(NULL, 1, 1)"):
        with pytest.raises(ConstraintError):
            engine.sql(f"INSERT INTO kid VALUES {bad}")
    engine.sql("CREATE UNIQUE INDEX u ON null_t (a, b)")
    with pytest.raises(ConstraintError):
        engine.sql("ALTER TABLE null_t ADD CONSTRAINT uc UNIQUE (c)")


def test_catalogue_statements(engine):
    assert [r["name"] for r in engine.sql("PRAGMA table_info(null_t)").collect()] == ["a", "b", "c"]
    assert "PRIMARY KEY(a)" in engine.sql("SHOW CREATE TABLE null_t").first()[0]
    assert engine.sql("EXPLAIN SELECT a FROM null_t").count() > 0
    engine.sql("SET SESSION \"sql_seq_scan\" = false")
    with pytest.raises(ValueError):
        engine.sql("SELECT a FROM null_t")
    handle = engine.prepare("SELECT a FROM SEQSCAN null_t WHERE a > :low ORDER BY a LIMIT 1")
    assert values(engine.execute(handle, {"low": 3})) == [(4,)]


def test_a_read_view_keeps_its_rows(engine):
    view = engine.tables["null_t"]
    engine.sql("DELETE FROM null_t WHERE a > 3")
    assert view.count() == 7 and engine.tables["null_t"].count() == 3


def test_update_operations():
    row = {"k": 1, "n": 6, "s": "abcdef"}
    assert apply_ops(row, [("+", "n", 4), ("&", "n", 6), ("|", "n", 1), ("^", "n", 8)])["n"] == ((10 & 6) | 1) ^ 8
    assert apply_ops(row, [(":", "s", 2, 2, "XY!")])["s"] == "aXY!def"
    assert apply_ops(row, [("=", "s", "z"), ("#", "n")]) == {"k": 1, "n": None, "s": "z"}
    assert apply_ops(row, [("+", "s", 1), (":", "s", 99, 1, "x"), ("-", "n", 1)]) == {"k": 1, "n": 5, "s": "abcdef"}


def test_upsert_folds_in_order(spark):
    base = spark.createDataFrame([(1, 10)], "k long, n long")
    ops = "ops array<struct<code:string,field:string,number:bigint,text:string,start:int,length:int>>"
    log = spark.createDataFrame([(1, 0, 1, [("+", "n", 5, None, None, None)]), (1, 0, 2, [("=", "n", 7, None, None, None)]), (2, 100, 3, [("+", "n", 5, None, None, None)]), (2, 100, 4, [("-", "n", 1, None, None, None)])], f"k long, n long, lsn long, {ops}")
    assert sorted(values(upsert(base, log, ["k"]))) == [(1, 7), (2, 99)]


def test_recursion(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4)], "s int, t int")
    assert closure(edges, "s", "t").count() == 10
    seed = spark.createDataFrame([(1,)], "n int")
    assert sorted(values(iterate(seed, lambda f: f.where("n < 5").selectExpr("n + 1")))) == [(i,) for i in range(1, 6)]
    with pytest.raises(CircularError):
        iterate(seed, lambda f: f.selectExpr("n + 1"), rounds=3)


def test_sequences(spark):
    df = spark.range(100).repartition(5)
    assert sorted(r["v"] for r in sequence(df, "v", 10, 2).collect()) == list(range(10, 210, 2))
    assert [r["v"] for r in sequence(df, "v", 5, 1, 1, 7, True, ["id"]).orderBy("id").limit(4).collect()] == [5, 6, 7, 1]


def test_empty_tables(engine):
    engine.sql("CREATE TABLE none (a INT PRIMARY KEY, s TEXT)")
    assert values(engine.sql("SELECT COUNT(*) AS n, MAX(a) AS m, GROUP_CONCAT(s) AS g FROM none")) == [(0, None, None)]
    assert values(engine.sql("SELECT MAX(a) AS m, s FROM none")) == [(None, None)]
    engine.sql("UPDATE none SET s = 'x' WHERE a = 1")
    assert engine.row_count() == 0


def test_views_follow_their_tables(engine):
    engine.sql("CREATE VIEW big AS SELECT a FROM null_t WHERE a > 5")
    engine.sql("CREATE VIEW biggest (m) AS SELECT MAX(a) AS x FROM big")
    assert values(engine.sql("SELECT COUNT(*) AS n FROM big")) == [(2,)]
    engine.sql("INSERT INTO null_t VALUES (8, 1, 1)")
    assert values(engine.sql("SELECT COUNT(*) AS n FROM big")) == [(3,)]
    assert values(engine.sql("SELECT m FROM biggest")) == [(8,)]
    with pytest.raises(ValueError):
        engine.sql("DELETE FROM big")
    engine.sql("CREATE TRIGGER on_view INSTEAD OF DELETE ON big FOR EACH ROW BEGIN DELETE FROM null_t WHERE a = OLD.a; END")
    engine.sql("DELETE FROM big WHERE a = 8")
    assert values(engine.sql("SELECT COUNT(*) AS n FROM null_t")) == [(7,)]
    engine.sql("DROP VIEW biggest")
    with pytest.raises(ValueError):
        engine.sql("SELECT m FROM biggest")


def test_autoincrement(engine):
    engine.sql("CREATE TABLE t (a INT PRIMARY KEY AUTOINCREMENT, b INT)")
    engine.sql("INSERT INTO t(b) VALUES (5), (6)")
    engine.sql("INSERT INTO t VALUES (40, 7)")
    engine.sql("INSERT INTO t VALUES (NULL, 8)")
    assert values(engine.sql("SELECT a, b FROM t ORDER BY a")) == [(1, 5), (2, 6), (40, 7), (41, 8)]


def test_literals_hold_any_text(engine):
    engine.sql("CREATE TABLE q (a INT PRIMARY KEY, t TEXT DEFAULT 'x, (y', u TEXT, CHECK (t <> 'no, (not) this'))")
    engine.sql("INSERT INTO q (a, u) VALUES (1, 'b; VALUES (3)'), (2, 'SELECT')")
    engine.sql("UPDATE q SET t = 'a WHERE b', (u, a) = (COALESCE(NULL, 'c, d'), a + 10) WHERE a = 1")
    assert values(engine.sql("SELECT a, t, u FROM q ORDER BY a")) == [(2, "x, (y", "SELECT"), (11, "a WHERE b", "c, d")]
    with pytest.raises(ConstraintError):
        engine.sql("UPDATE q SET t = 'no, (not) this'")
    engine.sql("DELETE FROM q WHERE t = 'a WHERE b'")
    assert engine.row_count() == 1


def test_conflicts_on_unique_columns(engine):
    engine.sql("CREATE TABLE u (a INT PRIMARY KEY, b INT UNIQUE ON CONFLICT REPLACE, c INT UNIQUE)")
    engine.sql("INSERT INTO u VALUES (1, 1, 1), (2, 2, 2), (3, NULL, NULL), (4, NULL, NULL)")
    engine.sql("INSERT OR IGNORE INTO u VALUES (5, 1, 9), (6, 6, 2), (7, 7, 7), (8, 7, 8)")
    assert engine.row_count() == 1
    engine.sql("INSERT INTO u VALUES (9, 2, 20)")
    assert engine.row_count() == 2
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO u VALUES (10, 10, 1)")
    engine.sql("REPLACE INTO u VALUES (1, 7, 20)")  # takes the place of three rows
    assert engine.row_count() == 4
    assert values(engine.sql("SELECT a FROM u ORDER BY a")) == [(1,), (3,), (4,)]


def test_parents_keep_their_children(engine):
    engine.sql("CREATE TABLE kid (id INT PRIMARY KEY, p INT REFERENCES null_t (a))")
    engine.sql("INSERT INTO kid VALUES (1, 1), (2, NULL)")
    for bad in ("DELETE FROM null_t WHERE a = 1", "UPDATE null_t SET a = 99 WHERE a = 1", "TRUNCATE TABLE null_t", "DROP TABLE null_t"):
        with pytest.raises(ConstraintError):
            engine.sql(bad)
    engine.sql("DELETE FROM null_t WHERE a = 2")
    engine.sql("CREATE TABLE tree (id INT PRIMARY KEY, up INT REFERENCES tree (id))")
    engine.sql("INSERT INTO tree VALUES (1, NULL), (2, 1)")
    with pytest.raises(ConstraintError):
        engine.sql("DELETE FROM tree WHERE id = 1")


def test_plans_of_many_inserts_stay_small(engine):
    engine.sql("CREATE TABLE m (a INT PRIMARY KEY)")
    for i in range(20):
        engine.sql(f"INSERT INTO m VALUES ({i})")
    lines = engine.tables["m"]._jdf.queryExecution().logical().toString().count("\n")
    assert lines < 60
    assert values(engine.sql("SELECT COUNT(*) AS n, SUM(a) AS s FROM m")) == [(20, 190)]


def test_trigger_programs(engine):
    engine.sql("CREATE TABLE tally (k INT PRIMARY KEY, n INT, last INT)")
    engine.sql("CREATE TABLE log (k INT, what TEXT)")
    engine.sql("INSERT INTO tally VALUES (0, 0, 0), (1, 0, 0)")
    engine.sql(
        """CREATE TRIGGER count_them AFTER INSERT ON null_t FOR EACH ROW WHEN NEW.b IS NOT NULL BEGIN
           UPDATE tally SET n = n + 1, last = NEW.a WHERE k = NEW.b;
           INSERT INTO log SELECT k, 'now; ' || CASE WHEN n > 1 THEN 'many' ELSE 'one' END FROM tally WHERE k = NEW.b;
           DELETE FROM log WHERE k = 0; END"""
    )
    engine.sql("INSERT INTO null_t VALUES (10, 1, 0), (11, 1, 0), (12, 0, 0), (13, NULL, 0)")
    assert values(engine.sql("SELECT k, n, last FROM tally ORDER BY k")) == [(0, 1, 12), (1, 2, 11)]
    assert values(engine.sql("SELECT k, what FROM log")) == [(1, "now; many")] * 2
    engine.sql("CREATE TRIGGER guard BEFORE INSERT ON null_t FOR EACH ROW BEGIN SELECT CASE WHEN NEW.c = 7 THEN RAISE(ABORT, 'seven, no') WHEN NEW.c = 8 THEN RAISE(IGNORE) END; END")
    with pytest.raises(ConstraintError, match="seven, no"):
        engine.sql("INSERT INTO null_t VALUES (20, NULL, 0), (21, NULL, 7)")
    engine.sql("INSERT INTO null_t VALUES (20, NULL, 0), (21, NULL, 8)")
    assert values(engine.sql("SELECT a FROM null_t WHERE a >= 20")) == [(20,)]
    engine.sql("CREATE TRIGGER moved AFTER UPDATE OF c ON null_t FOR EACH ROW BEGIN INSERT INTO log VALUES (OLD.c * 100 + NEW.c, 'moved'); END")
    engine.sql("UPDATE null_t SET b = 5 WHERE a = 20")
    engine.sql("UPDATE null_t SET c = 3 WHERE a = 20")
    assert values(engine.sql("SELECT k FROM log WHERE what = 'moved'")) == [(3,)]


def test_functions_of_the_dialect(engine):
    assert values(engine.sql("SELECT LIKE('a%', 'abc') AS x, LIKE('a#%', 'a%', '#') AS y")) == [(True, True)]
    engine.sql("DELETE FROM null_t WHERE a < 3")
    assert values(engine.sql("SELECT ROW_COUNT() AS n")) == [(2,)]
    engine.table_function("above", "SELECT a, b FROM null_t WHERE a > low", ["low:bigint"], ["a:bigint", "b:bigint"])
    assert sorted(values(engine.sql("SELECT a FROM above(5)"))) == [(6,), (7,)]
    assert values(engine.sql("SELECT a FROM null_t WHERE a IN (SELECT a FROM above(6))")) == [(7,)]


def test_ordered_recursion(spark):
    """Depth first by level, and a LIMIT that ends an endless recursion."""
    seed = spark.createDataFrame([(1, 0)], "n int, level int")
    step = lambda f: f.where("n < 8").selectExpr("explode(array(n * 2, n * 2 + 1)) AS n", "level + 1 AS level")
    got = iterate(seed, step, distinct=False, order_by=["level DESC", "n"])
    assert [r["n"] for r in got.collect()] == [1, 2, 4, 8, 9, 5, 10, 11, 3, 6, 12, 13, 7, 14, 15]
    endless = iterate(spark.createDataFrame([(1,)], "n int"), lambda f: f.selectExpr("n + 1"), order_by=["n"], limit=5)
    assert [r["n"] for r in endless.collect()] == [1, 2, 3, 4, 5]
