"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, DataFrame operations only.

A text is cut into paragraphs: lines, and within a line pieces of ``PIECE`` characters or more that end
with a sentence. The distinct 64-bit paragraph digests are dealt over groups, ``GROUP`` a group at most on average,
whose number is a power of two. Each group has a sketch: a digest is added to three cells (count, XOR of
digests, XOR of checks), one in each third of the cells. A group's sketch takes the first of the sizes ``CELLS`` at which peeling it gives all its digests back.
The fingerprint is the number of digests and all cells, in hexadecimal: a function of the one text, and equal for equal texts.

Two fingerprints are compared by themselves: group by group the cells subtract, what both hold cancels, and peeling
pure cells recovers the digests in which they differ. If the groups are of different sizes or peeling gets stuck, the
groups' own digests are peeled from the fingerprints and sketched again, larger each time. A fingerprint with fewer groups is first dealt
over as many as the other has. Likeness is 1 - differing / all digests of both (1.0 if neither has any).

A null text counts as empty. Rows with a null doc_id have no next document: their edited text is the kept half and
near_next is 0.0 (1.0 if the text has no paragraph). A doc_id may be any long. Repeated doc_ids are one
place in the order, with the least of their leading parts; every row is returned. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import common
from skein.llm.common import let

PIECE = 96
GROUP = 8
#: Cells of a group's sketch that are tried, in turn; multiples of three.
CELLS = (27, 63, 255, 1023)
#: Hexadecimal digits of a cell: its count, digests and checks.
COUNT, KEY, CHECK = 4, 16, 8


def digests(text: str) -> str:
    """SQL: the distinct digests of the text's paragraphs."""
    pattern = rf"[^\\n]{{{PIECE},}}?[.!?](?=\\s)|[^\\n]+"
    return f"array_distinct(transform(regexp_extract_all({text}, '{pattern}', 0), p -> xxhash64(p)))"


def _check(k: str) -> str:
    return f"(xxhash64({k}) & 4294967295L)"


def dealt(keys: str, bits: str) -> str:
    """SQL: an array of digests as 2**bits arrays, by the digests' low bits. In two steps, so that long texts don't scan all for each group."""
    low, high = f"cast({bits} / 2 as int)", f"({bits} - cast({bits} / 2 as int))"
    fine = f"transform(sequence(0, shiftleft(1, {high}) - 1), q -> filter(part, k -> (shiftright(k, {low}) & (shiftleft(1L, {high}) - 1)) = q))"
    return f"flatten(transform(sequence(0, shiftleft(1, {low}) - 1), p -> {let('part', f'filter({keys}, k -> (k & (shiftleft(1L, {low}) - 1)) = p)', fine)}))"


def _placed(k: str, third: str, more: str) -> str:
    places = ", ".join(f"cast(pmod(shiftright({k}, {20 * j}), {third}) as int)" for j in range(3))
    return f"named_struct('k', {k}, 'at', array({places}), {more})"


def cells_of(keys: str, third: str) -> str:
    """SQL: the sketch of an array of digests: three arrays of so many cells; a digest is in one cell of each."""
    zero = "named_struct('c', 0, 'k', 0L, 'h', 0L)"
    added = f"if(array_contains(used, i), aggregate(filter(placed, e -> e.at[j] = i), {zero}, (t, e) -> named_struct('c', t.c + 1, 'k', t.k ^ e.k, 'h', t.h ^ e.h)), {zero})"
    placed = f"transform({keys}, k -> {_placed('k', third, _check_field('k'))})"
    return let("placed", placed, f"transform(array(0, 1, 2), j -> {let('used', 'transform(placed, e -> e.at[j])', f'transform(sequence(0, {third} - 1), i -> {added})')})")


def _check_field(k: str) -> str:
    return f"'h', {_check(k)}"


def peeled(cells: str, rounds: int = 16) -> str:
    """SQL: the digests in a sketch or in a difference of two, NULL if peeling gets stuck.

    A step takes the pure cells of one of the three arrays, which hold different digests, out of all three. Three steps without any end it.
    """
    signed = "'s', c.c, 'h', c.h"
    pure = f"transform(filter(st.x[r % 3], c -> abs(c.c) = 1 AND {_check('c.k')} = c.h), c -> {_placed('c.k', 'size(st.x[0])', signed)})"
    less = "aggregate(filter(pure, e -> e.at[j] = i), c, (t, e) -> named_struct('c', t.c - e.s, 'k', t.k ^ e.k, 'h', t.h ^ e.h))"
    without = f"transform(st.x, (third, j) -> {let('used', 'transform(pure, e -> e.at[j])', f'transform(third, (c, i) -> if(array_contains(used, i), {less}, c))')})"
    step = let("pure", pure, f"if(size(pure) = 0, named_struct('x', st.x, 'got', st.got, 'idle', st.idle + 1), named_struct('x', {without}, 'got', concat(st.got, transform(pure, e -> e.k)), 'idle', 0))")
    return f"""aggregate(sequence(0, {3 * rounds - 1}), named_struct('x', {cells}, 'got', cast(array() as array<bigint>), 'idle', 0), (st, r) -> if(st.idle > 2, st, {step}),
        st -> if(exists(st.x, third -> exists(third, c -> c.c != 0 OR c.k != 0 OR c.h != 0)), cast(null as array<bigint>), st.got))"""


def group_sketch(keys: str) -> str:
    """SQL: a group's sketch at the first size at which it peels; the largest one stays as it is (a chance of about 1e-14)."""
    # Where each digest has a cell of one array to itself there is nothing to try.
    alone = "exists(own, third -> forall(third, c -> c.c < 2))"
    tries = [let("own", cells_of("mine", str(m // 3)), f"if({alone} OR {peeled('own')} IS NOT NULL, own, NULL)") for m in CELLS[:-1]]
    return let("mine", keys, f"coalesce({', '.join(tries)}, {cells_of('mine', str(CELLS[-1] // 3))})")


def sketch(keys: str) -> str:
    """SQL: (n, groups) of an array of digests; groups are three arrays of cells each, and none without digests."""
    bits = f"if(size({keys}) <= {GROUP}, 0, cast(ceil(log2(size({keys}) / {GROUP})) as int))"
    none = "cast(array() as array<array<array<struct<c: int, k: bigint, h: bigint>>>>)"
    return f"named_struct('n', size({keys}), 'groups', if(size({keys}) = 0, {none}, transform({dealt(keys, bits)}, g -> {group_sketch('g')})))"


def printed(sketch_: str) -> str:
    """SQL: a sketch as the fingerprint string."""
    cell = f"concat(lpad(hex(c.c), {COUNT}, '0'), lpad(hex(c.k), {KEY}, '0'), lpad(hex(c.h), {CHECK}, '0'))"
    return f"concat(hex({sketch_}.n), ':', array_join(transform({sketch_}.groups, g -> array_join(transform(flatten(g), c -> {cell}), '')), '.'))"


def parsed(print_: str) -> str:
    """SQL: the sketch that a fingerprint string holds."""
    at = [1, 1 + COUNT, 1 + COUNT + KEY]
    cell = f"""named_struct('c', cast(conv(substr(s, {at[0]}, {COUNT}), 16, 10) as int), 'k', cast(conv(substr(s, {at[1]}, {KEY}), 16, -10) as bigint),
                            'h', cast(conv(substr(s, {at[2]}, {CHECK}), 16, 10) as bigint))"""
    thirds = let("own", f"transform(regexp_extract_all(g, '.{{{COUNT + KEY + CHECK}}}', 0), s -> {cell})", "transform(array(0, 1, 2), j -> slice(own, j * cast(size(own) / 3 as int) + 1, cast(size(own) / 3 as int)))")
    groups = f"transform(split(substring_index({print_}, ':', -1), '[.]'), g -> {thirds})"
    return f"named_struct('n', cast(conv(substring_index({print_}, ':', 1), 16, 10) as int), 'groups', if({print_} = '0:', slice({groups}, 1, 0), {groups}))"


def _less(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> zip_with(p, q, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h)))"


def differing(a: str, b: str) -> str:
    """SQL: the number of digests in which two groups' sketches differ."""
    larger = ", ".join(f"array_size({peeled(_less(cells_of('ka', str(m // 3)), cells_of('kb', str(m // 3))))})" for m in CELLS[1:])
    last = "size(array_except(ka, kb)) + size(array_except(kb, ka))"
    stuck = f"aggregate({a}[0], 0, (t, c) -> t + c.c) + aggregate({b}[0], 0, (t, c) -> t + c.c)"
    again = let("ka", peeled(a), let("kb", peeled(b), f"if(ka IS NULL OR kb IS NULL, {stuck}, coalesce({larger}, {last}))"))
    # array_size() of NULL is NULL
    return f"coalesce(if(size({a}[0]) = size({b}[0]), array_size({peeled(_less(a, b))}), NULL), {again})"


def aligned(a: str, b: str) -> str:
    """SQL: (n, many, few) of two fingerprints, as sketch() or parsed() gives them: all their digests, and their groups, as many of either."""
    keys = f"flatten(transform(few.groups, g -> coalesce({peeled('g')}, cast(array() as array<bigint>))))"
    bits = "cast(round(log2(size(many.groups))) as int)"
    spread = f"zip_with({dealt('loose', bits)}, many.groups, (own, other) -> {cells_of('own', 'size(other[0])')})"
    same = f"if(size(few.groups) = size(many.groups), few.groups, {let('loose', keys, spread)})"
    pair = f"named_struct('n', {a}.n + {b}.n, 'many', many.groups, 'few', {same})"
    return let("many", f"if(size({a}.groups) >= size({b}.groups), {a}, {b})", let("few", f"if(size({a}.groups) >= size({b}.groups), {b}, {a})", pair))


def likeness(pair: str) -> str:
    """SQL: likeness of two fingerprints that aligned() has put together. (Apart from it, as Spark resolves so many nested lambdas only.)"""
    total = f"aggregate(zip_with({pair}.many, {pair}.few, (ga, gb) -> {differing('ga', 'gb')}), 0, (t, x) -> t + x)"
    return f"if({pair}.n = 0, 1.0D, 1.0D - {total} / cast({pair}.n as double))"


def order_links(docs: DataFrame) -> DataFrame:
    """(doc_id, prev_id, prev_n) of every distinct doc_id: its predecessor, the last one for the first, and that one's length.

    Ids are dealt by range; neighbours across two ranges come from a table with a row per range.
    """
    ids = docs.groupBy("doc_id").agg(F.max("n_chars").alias("n"))
    ids = common.cut(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "order")
    # One row per partition of the line above.
    edge = ids.groupBy("part").agg(F.max(F.struct("doc_id", "n")).alias("last"))
    before = F.lag("last").over(Window.orderBy("part"))
    whole = F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edge = edge.select("part", F.coalesce(before, whole).alias("before"))
    inside = F.lag(F.struct("doc_id", "n")).over(Window.partitionBy("part").orderBy("doc_id"))
    prev = ids.withColumn("inside", inside).join(edge, "part").withColumn("prev", F.coalesce("inside", "before"))
    return prev.select("doc_id", F.col("prev.doc_id").alias("prev_id"), F.col("prev.n").alias("prev_n"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text: the last half replaced by the start of the next document."""
    # Struct keys are never null: no join filters its side, and both take the texts from the same exchange.
    key = F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))
    base = docs.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    links = order_links(base.where("key.has").select(F.col("key.id").alias("doc_id"), F.char_length("text").alias("n_chars")))
    links = links.select(F.struct(F.lit(True).alias("has"), F.col("doc_id").alias("id")).alias("key"), F.struct(F.lit(True).alias("has"), F.col("prev_id").alias("id")).alias("before"), "prev_n")
    lent = base.join(links, "key").select(F.col("before").alias("key"), F.expr("left(text, cast(prev_n div 2 as int))").alias("lead"), F.expr(digests("text")).alias("next_digests"))
    lent = lent.groupBy("key").agg(F.min(F.struct("lead", "next_digests")).alias("lent"))
    edited = base.join(lent, "key", "left").select("key", "text", "lent", F.char_length("text").alias("n_chars"))
    edited = edited.select(
        F.expr("if(key.has, key.id, null)").alias("doc_id"),
        F.col("n_chars").cast("long"),
        F.expr(digests("text")).alias("own"),
        F.expr("concat(left(text, n_chars - n_chars div 2), left(coalesce(lent.lead, ''), cast(n_chars div 2 as int)))").alias("edited"),
        F.expr("coalesce(lent.next_digests, cast(array() as array<bigint>))").alias("next"),
    )
    ready = edited.select("doc_id", "n_chars", "own", "next", F.expr(digests("edited")).alias("changed"), F.sha2("edited", 256).alias("edited_sha256"))
    sketches = [F.expr(sketch(x)).alias(name) for x, name in (("own", "a"), ("changed", "b"), ("next", "c"))]
    ready = ready.select("doc_id", "n_chars", "edited_sha256", *sketches)
    prints = [F.expr(printed(x)).alias(name) for x, name in (("a", "fingerprint"), ("b", "edited_fingerprint"))]
    pairs = [F.expr(aligned("a", x)).alias(name) for x, name in (("b", "with_edited"), ("c", "with_next"))]
    ready = ready.select("doc_id", "n_chars", "edited_sha256", *prints, *pairs)
    near = [F.expr(likeness(x)).alias(name) for x, name in (("with_edited", "near_edited"), ("with_next", "near_next"))]
    return ready.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
