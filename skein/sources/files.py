"""Tables from and to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str, delimiter: str = ",", quote_char: str = '"', skip_head_lines: int = 0) -> DataFrame:
    """Rows of CSV files; a first line is skipped by skip_head_lines=1."""
    if skip_head_lines > 1:
        raise ValueError("Spark skips one head line per file")
    return spark.read.schema(schema).csv(path, sep=delimiter, quote=quote_char, escape=quote_char, header=bool(skip_head_lines), multiLine=False)


def dump_csv(df: DataFrame, path: str, delimiter: str = ",", quote_char: str = '"') -> None:
    df.write.mode("overwrite").csv(path, sep=delimiter, quote=quote_char, escape=quote_char, header=False)


def snapshot(df: DataFrame, path: str) -> None:
    """A checkpoint of a table that a later read can start from."""
    df.write.mode("overwrite").parquet(path)


def discard(df: DataFrame) -> None:
    """Run a plan and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def from_arrow(spark: SparkSession, table) -> DataFrame:
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame):
    return df.toArrow()
