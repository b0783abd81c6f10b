import pytest
from pyspark.sql import functions as F

from skein.functions import library
from skein.operators.keydef import KeyDef, Part
from skein.plans.dialect import DialectError
from skein.plans.engine import Engine
from skein.sources import files


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE t (a INT PRIMARY KEY, b INT)")
    e.sql("CREATE TABLE log (what TEXT, a INT, b INT)")
    e.sql("INSERT INTO t VALUES (1, 10), (2, 20)")
    return e


def values(df):
    return sorted(map(tuple, df.collect()))


def test_transactions(engine):
    engine.sql("START TRANSACTION")
    engine.sql("INSERT INTO t VALUES (3, 30)")
    engine.sql("SAVEPOINT s1")
    engine.sql("DELETE FROM t")
    engine.sql("ROLLBACK TO s1")
    assert values(engine.sql("SELECT a FROM t")) == [(1,), (2,), (3,)]
    engine.sql("ROLLBACK")
    assert values(engine.sql("SELECT a FROM t")) == [(1,), (2,)]
    with pytest.raises(DialectError):
        engine.sql("COMMIT")


def test_triggers(engine):
    engine.sql("CREATE TRIGGER i AFTER INSERT ON t FOR EACH ROW WHEN NEW.b > 5 BEGIN INSERT INTO log VALUES ('new', NEW.a, NEW.b); END")
    engine.sql("CREATE TRIGGER u AFTER UPDATE OF b ON t FOR EACH ROW BEGIN INSERT INTO log VALUES ('up', OLD.b, NEW.b); END")
    engine.sql("CREATE TRIGGER d BEFORE DELETE ON t FOR EACH ROW BEGIN INSERT INTO log VALUES ('gone', OLD.a, OLD.b); END")
    engine.sql("INSERT INTO t VALUES (3, 1), (4, 9)")
    engine.sql("UPDATE t SET b = b + 1 WHERE a = 1")
    engine.sql("DELETE FROM t WHERE a = 2")
    assert values(engine.sql("SELECT what, a, b FROM log")) == [("gone", 2, 20), ("new", 4, 9), ("up", 10, 11)]
    engine.sql("CREATE VIEW v AS SELECT a, b FROM t")
    engine.sql("CREATE TRIGGER w INSTEAD OF INSERT ON v FOR EACH ROW BEGIN INSERT INTO log VALUES ('view', NEW.a, NEW.b); END")
    engine.sql("INSERT INTO v VALUES (7, 7)")
    assert ("view", 7, 7) in values(engine.sql("SELECT what, a, b FROM log"))
    engine.sql("DROP TRIGGER i")
    assert "i" not in engine.triggers


def test_key_definitions(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (None, "c", "z"), (1, "b", "w")], "k int, s string, v string")
    key = KeyDef([Part("k"), Part("s", descending=True)])
    assert [r["s"] for r in df.orderBy(*key.order()).limit(3).collect()] == ["c", "b", "b"]
    pairs = df.alias("l").crossJoin(df.alias("r")).select(key.compare("l", "r").alias("c"), F.col("l.v").alias("a"), F.col("r.v").alias("b"))
    got = {(r["a"], r["b"]): r["c"] for r in pairs.collect()}
    assert got["x", "y"] == -1 and got["y", "x"] == 1 and got["x", "w"] == 0 and got["z", "x"] == -1
    assert [tuple(r) for r in key.unique_violations(df).collect()] == [(1, "b", 2)]
    assert [p.field for p in key.merge(KeyDef([Part("s"), Part("v")])).parts] == ["k", "s", "v"]
    assert KeyDef([Part("k", exclude_null=True)]).extract(df).count() == 3


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", you'), (2, "plain"), (3, "semi;colon")]
    df = spark.createDataFrame(rows, "id int, s string")
    files.dump_csv(df, f"file://{tmp_path}/csv", delimiter=";")
    assert values(files.csv(spark, f"file://{tmp_path}/csv", "id int, s string", delimiter=";")) == rows


def test_snapshots_and_arrow(spark, tmp_path):
    df = spark.range(5)
    files.snapshot(df, f"file://{tmp_path}/snap")
    assert spark.read.parquet(f"file://{tmp_path}/snap").count() == 5
    assert values(files.from_arrow(spark, files.to_arrow(df))) == [(i,) for i in range(5)]
    files.discard(df)


def test_library(spark):
    df = spark.createDataFrame([("http://me:pw@host.org:33/a/b?x=1#end", "a b/ü~*", "  x  y z ", 1_700_000_000_123)], "u string, e string, w string, ms long")
    got = df.select(
        library.uri(F.col("u")).alias("u"),
        library.uri(F.lit("localhost:3301")).alias("v"),
        library.uri_escape(F.col("e")).alias("e"),
        library.uri_unescape(library.uri_escape(F.col("e"))).alias("back"),
        library.split(F.col("w")).alias("w"),
        library.split(F.lit("a.b.c"), ".", 1).alias("p"),
        library.cmp(F.lit("a"), F.lit("B")).alias("c"),
        library.cmp(F.lit("a"), F.lit("A"), True).alias("i"),
        library.ulid(F.col("ms"), F.unhex(F.lit("00112233445566778899"))).alias("ulid"),
        library.sub(F.lit("äbc"), -2, 2).alias("s"),
    ).first()
    assert tuple(got["u"]) == ("http", "me", "pw", "host.org", "33", "/a/b", "x=1", "end") and tuple(got["v"])[3:5] == ("localhost", "3301")
    assert got["e"] == "a%20b%2F%C3%BC~%2A" and got["back"] == "a b/ü~*"
    assert got["w"] == ["x", "y", "z"] and got["p"] == ["a", "b.c"] and (got["c"], got["i"]) == (-1, 0) and got["s"] == "b"
    assert len(got["ulid"]) == 26 and spark.range(1).select(library.ulid_time(F.lit(got["ulid"]))).first()[0] == 1_700_000_000_123
    assert spark.range(1).select(library.decimal_math("ln")(F.lit("-1")), library.decimal_math("exp")(F.lit("0"))).first()[:] == (None, "1")
    assert spark.range(1).select(library.uuid_parts(F.lit("f47ac10b-58cc-4372-a567-0e02b2c3d479"))["version"]).first()[0] == 4
