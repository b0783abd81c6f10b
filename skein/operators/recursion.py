"""Recursive queries that Spark SQL lacks: UNION, and an ordered queue."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CircularError(RuntimeError):
    """A recursion that doesn't end within its limit."""


def cut(df: DataFrame) -> DataFrame:
    """Lineage must not grow with the rounds: each is a written table in the shared folder. Its shuffle files go with the job."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.gettempdir()
    path = f"{folder.rstrip('/')}/skein-round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.skein_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove what cut() wrote for df."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.skein_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def iterate(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, order_by: list[str] | None = None, limit: int | None = None, rounds: int = 1000) -> DataFrame:
    """All rows that step reaches from seed; with distinct (UNION), a row once.

    Rounds are the levels of a first-in, first-out queue; each writes its own front and nothing else. With order_by the
    queue gives its least row first, one at a time, as a depth-first or best-first walk needs; the result
    is the first limit rows taken, in the order they were taken.
    """
    if order_by:
        return _ordered(seed, step, distinct, order_by, limit, rounds)
    cast = lambda df: df.toDF(*seed.columns).select(*[F.col(c).cast(seed.schema[c].dataType).alias(c) for c in seed.columns])
    front = cut(seed.distinct() if distinct else seed)
    fronts, n, held = [front], 0, front.count()
    while not front.isEmpty() and (limit is None or held < limit):
        n += 1
        if n > rounds:
            raise CircularError(f"no end within {rounds} rounds")
        new = cast(step(front))
        if distinct:
            new = new.distinct()
            seen = _together(fronts)
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in seed.columns]
            new = new.alias("n").join(seen.alias("s"), reduce(lambda a, b: a & b, same), "left_anti")
        front = cut(new)
        held += front.count()
        fronts.append(front)
        if len(fronts) > 32:  # a plan of few parts
            fronts = [cut(_together(fronts))]
    found = _together(fronts)
    return found if limit is None else found.limit(limit)


def _together(fronts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, fronts)


def _ordered(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool, order_by: list[str], limit: int | None, rounds: int) -> DataFrame:
    """The queue of an ordered recursion: rows are taken one by one, so it is as long as its result; the queue itself stays a table."""
    names = seed.columns
    order = [F.col(k.split()[0]).desc() if k.upper().endswith(" DESC") else F.col(k.split()[0]) for k in order_by]
    cast = lambda df: df.toDF(*names).select(*[F.col(c).cast(seed.schema[c].dataType).alias(c) for c in names])
    queue, taken, seen = cut((seed.distinct() if distinct else seed).withColumn("__at", F.monotonically_increasing_id())), [], set()
    number = 1 << 40
    while limit is None or len(taken) < limit:
        row = queue.orderBy(*order, "__at").limit(1).collect()  # a row
        if not row:
            break
        if len(taken) >= rounds:
            raise CircularError(f"no end within {rounds} rows")
        rest = queue.where(F.col("__at") != row[0]["__at"])
        values = tuple(row[0][c] for c in names)
        if distinct and values in seen:
            queue = rest
            continue
        seen.add(values)
        taken.append(values)
        one = seed.sparkSession.createDataFrame([values], seed.schema)
        new = cast(step(one)).withColumn("__at", F.monotonically_increasing_id() + number)
        number += 1 << 40
        queue, old = cut(rest.unionByName(new)), queue
        drop_if_cut(old)
    return seed.sparkSession.createDataFrame(taken, seed.schema)


def drop_if_cut(df: DataFrame) -> None:
    if hasattr(df, "skein_path"):
        drop(df)


def closure(edges: DataFrame, source: str, target: str) -> DataFrame:
    """All pairs (source, target) joined by a path of edges."""
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    step = lambda front: front.join(e.select(F.col("s").alias("t"), F.col("t").alias("u")), "t").select("s", F.col("u").alias("t"))
    return iterate(e, step).toDF(source, target)
