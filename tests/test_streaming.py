from pyspark.sql import functions as F

from skein.streaming import changelog


def log(spark, rows):
    return spark.createDataFrame(rows, changelog.SCHEMA)


ROWS = [(1, 1, "INSERT", 1, 1.0), (2, 1, "REPLACE", 1, 2.0), (3, 1, "INSERT", 2, 5.0), (4, 1, "DELETE", 2, None), (5, 1, "INSERT", 3, 7.0)]


def test_batch_and_stream_replay_agree(spark, tmp_path):
    folder, table = str(tmp_path / "log"), str(tmp_path / "table")
    follower, seen = changelog.Follower(spark, table), []
    follower.watchers[1] = [lambda key, value: seen.append((key, value))]
    for i, part in enumerate((ROWS[:2], ROWS[1:4], ROWS[4:])):  # one row comes twice
        log(spark, part).coalesce(1).write.mode("append").parquet(folder)
        follower.follow(changelog.stream(spark, folder), str(tmp_path / "checkpoint")).awaitTermination()
    whole = changelog.replay(log(spark, ROWS))
    assert sorted(map(tuple, follower.live().collect())) == sorted(map(tuple, whole.collect())) == [(1, 2.0, 2), (3, 7.0, 5)]
    assert seen[-1] == (1, 2.0)


def test_snapshot_then_tail(spark):
    at_two = changelog.replay(log(spark, ROWS[:2])).select("key", "value")
    got = changelog.join_and_follow(at_two, log(spark, ROWS), 2)
    assert sorted((r["key"], r["value"]) for r in got.collect()) == [(1, 2.0), (3, 7.0)]


def test_empty_log(spark):
    assert changelog.replay(log(spark, [])).count() == 0


def test_before_triggers_change_rows(spark, tmp_path):
    follower = changelog.Follower(spark, str(tmp_path / "t"))
    follower.before.append(lambda df: df.withColumn("value", F.col("value") * 10))
    follower.apply(log(spark, ROWS), 0)
    assert {(r["key"], r["value"]) for r in follower.live().collect()} == {(1, 20.0), (3, 70.0)}


def test_a_follower_goes_on_after_a_restart(spark, tmp_path):
    folder, table, mark = str(tmp_path / "log"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for i, part in enumerate((ROWS[:1], ROWS[1:3], ROWS[3:4], ROWS[4:])):
        log(spark, part).coalesce(1).write.mode("append").parquet(folder)
        follower = changelog.Follower(spark, table, merge_every=2)
        follower.follow(changelog.stream(spark, folder), mark).awaitTermination()
    follower = changelog.Follower(spark, table)
    assert {(r["key"], r["value"]) for r in follower.live().collect()} == {(1, 2.0), (3, 7.0)}
    follower.apply(log(spark, [(9, 1, "INSERT", 1, 99.0)]), 2)  # a batch that was applied
    assert follower.watch_once(1) == 2.0 and follower.watch_once(2) is None


def test_ties_between_replicas(spark, tmp_path):
    follower = changelog.Follower(spark, str(tmp_path / "t"))
    follower.apply(log(spark, [(5, 2, "INSERT", 1, 2.0), (5, 1, "INSERT", 1, 1.0)]), 0)
    follower.apply(log(spark, [(5, 1, "INSERT", 1, 3.0)]), 1)
    assert follower.watch_once(1) == 2.0
