"""User aggregates: a state with step, merge and final functions, as SQL expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Inputs that one fold takes, and states that one merge takes. 4096 * MERGE ** 3 is more than there are row numbers.
CHUNK, MERGE = 1 << 12, 1 << 17


@dataclass(frozen=True)
class Aggregate:
    """zero, step over (state, x), merge over (state, other) and final over state. step takes null inputs too."""

    type: str
    zero: str
    step: str
    merge: str
    final: str = "state"


def fold(df: DataFrame, keys: list[str], value: str, how: Aggregate, name: str) -> DataFrame:
    """The aggregate of each group of keys. Groups of any size: they are cut into chunks of bounded length, whose states are merged level by level.

    Inputs come in no order; where order matters the state has to hold it. Nulls are a group of keys; an empty table has no groups.
    """
    by = [F.col(k) for k in keys]
    # a task's rows of a group come in runs; numbering them per task keeps chunks bounded without a shuffle
    numbered = df.select(*by, F.expr(value).alias("x"), (F.monotonically_increasing_id() / CHUNK).cast("long").alias("chunk"))
    state = f"aggregate(xs, cast({how.zero} as {how.type}), (state, x) -> {how.step})"
    states = numbered.groupBy(*keys, "chunk").agg(F.collect_list(F.struct("x")).alias("held")).selectExpr(*[f"`{k}`" for k in keys], "chunk", "transform(held, h -> h.x) AS xs")
    states = states.selectExpr(*[f"`{k}`" for k in keys], "chunk", f"{state} AS state")
    merged = f"aggregate(slice(held, 2, size(held)), held[0].state, (state, h) -> {re.sub(r'\bother\b', 'h.state', how.merge)})"
    for _ in range(2):
        states = states.withColumn("chunk", F.expr(f"chunk div {MERGE}"))
        states = states.groupBy(*keys, "chunk").agg(F.collect_list(F.struct("state")).alias("held")).selectExpr(*[f"`{k}`" for k in keys], "chunk", f"{merged} AS state")
    states = states.groupBy(*keys).agg(F.collect_list(F.struct("state")).alias("held"))
    return states.selectExpr(*[f"`{k}`" for k in keys], f"{merged} AS state").selectExpr(*[f"`{k}`" for k in keys], f"{how.final} AS `{name}`")
