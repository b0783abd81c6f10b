"""Benchmark decontamination by spaced seeds, DataFrame operations only.

Texts are lower-cased and cut into runs of letters and digits. An overlap counts if, on some diagonal of document and item,
``REGION`` aligned places (or the whole item, if shorter) hold at least ``SHARE`` equal tokens. Fixed masks of
marked places, between which tokens are ignored, are hashed at every window of both. Of the hits of its masks an
overlap has at least ``kept_hits``, wherever its unequal places are; that number is worked out over all
their arrangements and is never 0, so the seeds lose no overlap. Whichever diagonal has as many hits is checked place by place.
Items of fewer than 5 tokens allow no unequal place and are hashed whole.

Null and empty texts match nothing. Repeated rows get equal results; a document is told
apart by doc_id (nulls equal) and text. Extra columns don't matter to ``overlaps`` and are kept by ``clean``.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import let

#: Marked places of the masks for items of REGION tokens or more, and for shorter ones.
LONG = ((0, 2, 3, 4), (0, 3, 6, 7))
SHORT = ((0, 1, 3), (0, 2, 3))
REGION = 15
SHARE = 0.8
#: Item hashes are broadcast up to this many rows (some 30 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000


def tokens(text: str) -> str:
    return rf"array_remove(split(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), '')"


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks for an item of n tokens."""
    return LONG if n >= REGION else SHORT if unequal(n) else (tuple(range(n)),)


def unequal(n: int) -> int:
    """Places of an overlap with an item of n tokens that may differ."""
    region = min(n, REGION)
    return region - math.ceil(SHARE * region - 1e-9)


@functools.cache
def kept_hits(n: int) -> int:
    """How many windows of its masks are left whole at least, by whichever places differ."""
    region = min(n, REGION)
    windows = [{i + p for p in mask} for mask in masks_of(n) for i in range(region - mask[-1])]
    return min(sum(not window & set(bad) for window in windows) for bad in combinations(range(region), unequal(n)))


def _by_size(values: list[int]) -> str:
    """SQL: one of the values, which are those of items of 1, 2, ... REGION tokens, for an item of n tokens."""
    return f"element_at(array({', '.join(map(str, values))}), least(n, {REGION}))"


def _hashes(text: str) -> str:
    return f"transform({tokens(text)}, t -> xxhash64(t))"


def _windows(masks: tuple[tuple[int, ...], ...]) -> str:
    """SQL: array of (i, seed) of all windows of the masks over the hashes h."""
    none = "cast(array() as array<struct<i:int,seed:bigint>>)"
    parts = []
    for mask in masks:
        seed = f"xxhash64('{' '.join(map(str, mask))}', {', '.join(f'h[i + {p}]' for p in mask)})"
        parts.append(f"if(size(h) > {mask[-1]}, transform(sequence(0, size(h) - {mask[-1] + 1}), i -> named_struct('i', i, 'seed', {seed})), {none})")
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, same): documents that overlap an item, and the most equal tokens of an alignment."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").where("text IS NOT NULL")
    items = items.select("item_id", "text").where("text IS NOT NULL").dropDuplicates(["item_id", "text"])
    theirs = items.select("item_id", F.xxhash64("text").alias("ih"), F.expr(_hashes("text")).alias("h")).withColumn("n", F.size("h")).where("n > 0")
    sets = list(dict.fromkeys(masks_of(n) for n in range(1, REGION + 1)))
    theirs = theirs.select("item_id", "ih", "h", F.expr(_by_size([sets.index(masks_of(n)) for n in range(1, REGION + 1)])).alias("masks"), F.expr(_by_size([kept_hits(n) for n in range(1, REGION + 1)])).alias("least"))
    used = {mask for r in theirs.select("masks").distinct().collect() for mask in sets[r.masks]}  # a row per set of masks at most
    seeds = " ".join(f"WHEN {k} THEN {_windows(masks)}" for k, masks in enumerate(sets))
    theirs = theirs.select("item_id", "ih", "least", F.explode(F.expr(f"CASE masks {seeds} END")).alias("s")).select("item_id", "ih", "least", F.col("s.i").alias("at"), "s.seed")
    if theirs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        theirs = F.broadcast(theirs)
    # documents are hashed under the masks that some item has
    seeds = let("h", _hashes("text"), _windows(tuple(sorted(used)) or LONG))
    ours = docs.select("doc_id", "th", F.explode(F.expr(seeds)).alias("s")).select("doc_id", "th", "s.i", "s.seed")
    hits = ours.join(theirs, "seed").groupBy("doc_id", "th", "item_id", "ih", "least", F.expr("i - at").alias("shift")).agg(F.count(F.lit(1)).alias("hits"))
    hits = hits.where("hits >= least").groupBy("doc_id", "th", "item_id", "ih").agg(F.collect_set("shift").alias("shifts"))
    # The benchmark's own tokens; a document's tokens are cut anew for the few documents with hits.
    held = items.select("item_id", F.xxhash64("text").alias("ih"), F.expr(tokens("text")).alias("want"))
    met = hits.join(held, ["item_id", "ih"])
    per_doc = met.groupBy(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th")).agg(F.collect_list(F.struct("item_id", "want", "shifts")).alias("met"))
    once = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")))
    once = once.select("doc_id", "th", F.expr(tokens("text")).alias("have"), "met").dropDuplicates(["doc_id", "th"])
    each = once.select("doc_id", "th", "have", F.explode("met").alias("m")).select("doc_id", "th", "m.item_id", "have", "m.want", F.explode("m.shifts").alias("shift"))
    equal = "transform(want, (t, j) -> if(coalesce(get(have, j + shift) = t, false), 1, 0))"
    each = each.select("doc_id", "th", "item_id", F.expr(equal).alias("equal"))
    region = f"least(size(equal), {REGION})"
    most = f"array_max(transform(sequence(0, size(equal) - {region}), s -> aggregate(slice(equal, s + 1, {region}), 0, (a, x) -> a + x)))"
    each = each.where(f"{most} >= {SHARE} * {region} - 1e-9")
    return each.groupBy("doc_id", "th", "item_id").agg(F.max(F.expr("aggregate(equal, 0, (a, x) -> a + x)")).alias("same"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that overlap no item."""
    found = overlaps(docs, items).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left_anti")


def _oracle() -> str:
    """All diagonals with enough equal tokens, without seeds."""
    cut = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id AS id, {cut} AS t FROM {{docs}} WHERE text IS NOT NULL), b AS (SELECT item_id AS id, {cut} AS t FROM benchmark WHERE text IS NOT NULL),
dt AS (SELECT id, unnest(t) AS tok, unnest(range(0, len(t))) AS i FROM d), bt AS (SELECT id, len(t) AS n, unnest(t) AS tok, unnest(range(0, len(t))) AS i FROM b),
h AS (SELECT dt.id AS doc_id, bt.id AS item_id, dt.i - bt.i AS shift FROM dt JOIN bt USING (tok) GROUP BY ALL HAVING count(*) >= {SHARE} * least(any_value(bt.n), {REGION}) - 1e-9),
e AS (SELECT h.doc_id, h.item_id, list_transform(range(0, len(b.t)), lambda j: CASE WHEN j + h.shift >= 0 AND coalesce(d.t[j + h.shift + 1] = b.t[j + 1], false) THEN 1 ELSE 0 END) AS eq
      FROM h JOIN d ON d.id = h.doc_id JOIN b ON b.id = h.item_id)
SELECT doc_id, item_id, CAST(max(list_sum(eq)) AS BIGINT) AS same FROM e
WHERE list_max(list_transform(range(0, len(eq) - least(len(eq), {REGION}) + 1), lambda s: list_sum(eq[s + 1 : s + least(len(eq), {REGION})]))) >= {SHARE} * least(len(eq), {REGION}) - 1e-9
GROUP BY doc_id, item_id"""


ORACLE = _oracle()
