import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skein.functions import scalar, timeops
from skein.operators.space import Space, Unsupported, bits, box, hash_select, merge
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    data = [(a, b) for a in (None, 1, 2, 3) for b in ("a", "b", "ba", "c")]
    return data, spark.createDataFrame(data, "a int, b string")


def order(r):
    return (r[0] is not None, r[0] or 0, r[1])


@pytest.mark.parametrize("iterator", ["GE", "GT", "LE", "LT", "EQ", "REQ"])
@pytest.mark.parametrize("key", [[2], [2, "b"], [9], [1, "c"]])
def test_iterators_against_a_plain_reading(rows, iterator, key):
    data, df = rows
    n = len(key)
    cut = lambda r: ((r[0] is not None, r[0] or 0), r[1])[:n] if n == 2 else ((r[0] is not None, r[0] or 0),)
    want = ((True, key[0]), *key[1:])
    test = {"GE": lambda x: x >= want, "GT": lambda x: x > want, "LE": lambda x: x <= want, "LT": lambda x: x < want, "EQ": lambda x: x == want, "REQ": lambda x: x == want}[iterator]
    expected = sorted((r for r in data if test(cut(r))), key=order, reverse=iterator in ("LE", "LT", "REQ"))
    assert [tuple(r) for r in Space(df, ["a", "b"]).select(key, iterator).collect()] == expected


def test_pages_meet(rows):
    data, df = rows
    space, after, seen = Space(df, ["a", "b"]), None, []
    space = Space(df.where("a IS NOT NULL"), ["a", "b"])
    while True:
        page = space.select(limit=5, after=after)
        got = [tuple(r) for r in page.collect()]
        if not got:
            break
        seen += got
        after = space.position(page)
    assert seen == sorted((r for r in data if r[0] is not None), key=order)


def test_prefixes(rows):
    _, df = rows
    space = Space(df.where("a = 1"), ["b"])
    assert [r["b"] for r in space.select(["b"], "NP").collect()] == ["c"]
    assert [r["b"] for r in space.select(["b"], "PP").collect()] == ["a"]
    assert space.select([""], "NP").count() == 0


def test_what_an_index_lacks(rows):
    _, df = rows
    with pytest.raises(Unsupported):
        hash_select(df, ["a"], "LT", [1])
    with pytest.raises(Unsupported):
        bits(df, "a", "GE", 1)
    with pytest.raises(Unsupported):
        box(df, ["a"], ["a"], "NP", [1.0])
    with pytest.raises(ValueError):
        Space(df, ["a"]).quantile(0.5, [3], [1])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 31), min_size=1, max_size=20), st.integers(0, 31))
def test_bits(spark, xs, mask):
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    got = lambda it: sorted(r["x"] for r in bits(df, "x", it, mask).collect())
    assert got("BITS_ALL_SET") == sorted(x for x in xs if x & mask == mask)
    assert got("BITS_ANY_SET") == sorted(x for x in xs if x & mask)
    assert got("BITS_ALL_NOT_SET") == sorted(x for x in xs if not x & mask)


def test_merge_and_reverse(spark):
    parts = [spark.createDataFrame([(x,) for x in xs], "x int") for xs in ([1, 4, 7], [2, 5], [3])]
    assert [r["x"] for r in merge(parts, ["x"]).collect()] == [1, 2, 3, 4, 5, 7]
    assert [r["x"] for r in merge(parts, ["x"], reverse=True).collect()] == [7, 5, 4, 3, 2, 1]


def test_interval_adjustment(spark):
    ts = spark.sql("SELECT TIMESTAMP '2023-01-31 10:00:00' AS t, TIMESTAMP '2023-02-28 00:00:00' AS u")
    month = timeops.interval(month=1)
    day = lambda c, adjust: timeops.strftime(timeops.add(F.col(c), month, adjust), "%F %T")
    got = ts.select(day("t", "none").alias("a"), day("t", "excess").alias("b"), day("u", "last").alias("c"), day("u", "none").alias("d")).first()
    assert tuple(got) == ("2023-02-28 10:00:00", "2023-03-03 10:00:00", "2023-03-31 00:00:00", "2023-03-28 00:00:00")


def test_library_functions(spark):
    df = spark.createDataFrame([("abcdefg",), (None,)], "s string")
    got = df.select(scalar.center(F.col("s"), 10, "*").alias("c"), scalar.substr(F.col("s"), F.lit(-1), F.lit(10)).alias("u"), scalar.quote(F.col("s")).alias("q")).collect()
    assert tuple(got[0]) == ("*abcdefg**", "abcdefg", "'abcdefg'") and tuple(got[1]) == (None, None, "NULL")
    assert scalar._murmur(b"hello", 0) == 0x248BFA47 and scalar._murmur(b"", 0) == 0
    assert len({scalar.jump_hash(k, 8) for k in range(100)}) == 8
    keys = df.select(scalar.sort_key(F.col("s"), "str").alias("k")).orderBy("k").collect()
    assert keys[0]["k"]["rank"] == 0
