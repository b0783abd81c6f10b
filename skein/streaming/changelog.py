"""The change log: rows {lsn, replica_id, op, key, value}, replayed in batch or followed as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.changes import compact

SCHEMA = "lsn bigint, replica_id int, op string, key bigint, value double"
TABLE = "key bigint, lsn bigint, replica_id int, op string, value double"


def replay(log: DataFrame, since: int = 0) -> DataFrame:
    """The table after the log: each (replica, lsn) once, then the newest version of each key that isn't a deletion."""
    once = log.where(F.col("lsn") > since).dropDuplicates(["replica_id", "lsn"])
    return compact(once, ["key"], "lsn", "op").select("key", "value", "lsn")


def join_and_follow(snapshot: DataFrame, log: DataFrame, at: int) -> DataFrame:
    """A snapshot taken at an lsn, and what the log says after it."""
    later = log.where(F.col("lsn") > at).dropDuplicates(["replica_id", "lsn"])
    base = snapshot.select("key", "value", F.lit(at).cast("long").alias("lsn"), F.lit("INSERT").alias("op"))
    return compact(base.unionByName(later.select("key", "value", "lsn", "op")), ["key"], "lsn", "op").select("key", "value", "lsn")


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Follow the Parquet files of a log folder."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def latest(changes: DataFrame) -> DataFrame:
    """State by key: the change with the greatest lsn. Runs on streams (update mode) as on tables; replays of a change are idempotent."""
    newest = changes.groupBy("key").agg(F.max_by(F.struct("lsn", "op", "value"), "lsn").alias("x"))
    return newest.select("key", "x.*")


class Follower:
    """Apply a stream to a table, micro-batch by micro-batch; triggers are called with each batch of applied rows.

    The folder holds ``base-<batch>``, the table up to a batch, and ``delta-<batch>``, the newest rows by key of each
    batch after it. A batch writes its own rows only; every ``merge_every`` batches they are merged into the next
    base. What is committed is found again by another Follower over the same folder, and a batch that comes again is not applied again.
    Of equal lsns the greatest replica_id wins.
    """

    def __init__(self, spark: SparkSession, table_path: str, merge_every: int = 16):
        self.spark, self.path, self.merge_every = spark, table_path.rstrip("/"), merge_every
        self.before: list[Callable[[DataFrame], DataFrame]] = []
        self.after: list[Callable[[DataFrame], None]] = []
        self.watchers: dict[int, list[Callable[[int, float | None], None]]] = {}

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _committed(self) -> tuple[int, list[int]]:
        """The last base's batch (-1 without one) and the batches of the deltas after it."""
        fs, path = self._files()
        bases, deltas = [-1], []
        for entry in fs.listStatus(path) if fs.exists(path) else []:
            kind, _, number = entry.getPath().getName().partition("-")
            if number.isdigit() and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                (bases if kind == "base" else deltas).append(int(number))
        return max(bases), sorted(n for n in deltas if n > max(bases))

    def table(self) -> DataFrame | None:
        """Newest row of each key, deletions included."""
        base, deltas = self._committed()
        names = [f"base-{base}"] * (base >= 0) + [f"delta-{n}" for n in deltas]
        if not names:
            return None
        rows = self.spark.read.schema(TABLE).parquet(*[f"{self.path}/{n}" for n in names])
        return self._newest(rows)

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        newest = rows.groupBy("key").agg(F.max(F.struct("lsn", "replica_id", "op", "value")).alias("x"))
        return newest.select("key", "x.lsn", "x.replica_id", "x.op", "x.value")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        base, deltas = self._committed()
        if batch_id <= base or batch_id in deltas:
            return
        for f in self.before:
            batch = f(batch)
        self._newest(batch).write.mode("overwrite").parquet(f"{self.path}/delta-{batch_id}")
        if len(deltas) + 1 >= self.merge_every:
            self.table().write.mode("overwrite").parquet(f"{self.path}/base-{batch_id}")
            fs, _ = self._files()
            for name in [f"delta-{n}" for n in [*deltas, batch_id]] + [f"base-{base}"] * (base >= 0):
                fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
            new = self._newest(batch)
        else:
            new = self.spark.read.schema(TABLE).parquet(f"{self.path}/delta-{batch_id}")
        for f in self.after:
            f(new)
        if self.watchers:  # last values of watched keys only
            for r in self.table().where(F.col("key").isin(list(self.watchers))).collect():
                for f in self.watchers[r["key"]]:
                    f(r["key"], None if r["op"] == "DELETE" else r["value"])

    def watch_once(self, key: int) -> float | None:
        """The key's value now."""
        table = self.table()
        row = None if table is None else table.where((F.col("key") == key) & (F.col("op") != "DELETE")).select("value").first()
        return row and row["value"]

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def live(self) -> DataFrame:
        return self.table().where("op != 'DELETE'").select("key", "value", "lsn")


def windows(events: DataFrame, time: str, size: str, late: str) -> DataFrame:
    """Counts per tumbling window; rows later than the watermark are dropped on streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, size)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")
