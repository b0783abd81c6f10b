"""Skein: a Spark-first analytics engine with a SQL face and a key/range face."""
