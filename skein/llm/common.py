"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, SparkSession

#: Words as the contracts define them: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set in local mode (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.gettempdir()
    return path.rstrip("/")


#: What this process has written to the shared folder and not removed yet.
_LEFT: dict[str, None] = {}


def shared_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/skein-{what}-{uuid.uuid4().hex}"
    _LEFT[path] = None
    return path


@contextmanager
def leaving(spark: SparkSession) -> Iterator[list[DataFrame | str]]:
    """Removes what is written to the shared folder meanwhile, but for the tables and paths that are put into the list."""
    before, kept = set(_LEFT), []
    yield kept
    stay = {k if isinstance(k, str) else k.skein_path for k in kept}
    for path in [p for p in _LEFT if p not in before and p not in stay]:
        drop_path(spark, path)


def sweep(spark: SparkSession) -> None:
    """Removes all that this process's operators left in the shared folder; no result of theirs may be read any more."""
    for path in list(_LEFT):
        drop_path(spark, path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends in files that survive lost executors. The job's shuffle files go with it."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    # the driver keeps the plans' descriptions, and some plans hold tables of constants
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), setting(spark, "spark.sql.maxPlanStringLength", "20000"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.skein_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove what cut() wrote for df; nothing may read it any more."""
    drop_path(df.sparkSession, df.skein_path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows per Arrow batch for Python workers: texts can be long, and each worker holds a few batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def regroup(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of about size bytes of text: short ones are put together, long ones cut."""
    held, n = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + size - n, side="right")))
            held.append(batch.slice(a, b - a))
            n += ends[b - 1] - before
            a = b
            if n >= size or a < batch.num_rows:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def tidy(run: Callable) -> Callable:
    """run for mapInArrow or mapInPandas; when its task ends, freed memory goes back to the system, as idle workers stay alive."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return whole


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    _LEFT.pop(path, None)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def let(name: str, value: str, body: str) -> str:
    """SQL: evaluate value once and use it by name in body, also inside lambdas."""
    return f"transform(array({value}), {name} -> {body})[0]"
