"""Near-duplicate documents: a set-similarity self-join of word 5-grams by chosen paths.

A document is the set of its 5-grams of words (a shorter one is a single gram). Documents with equal sets
form a class; classes are joined. Sets are embedded as ``SIGNATURE`` min-hashes, which are the tokens of the
chosen-path recursion: in each run the root splits on the few tokens that a hash samples, 1/similarity
of them expected, and runs are repeated until the chance that a pair of the asked similarity shares none of them is below ``MISS``.
Buckets of up to ``SMALL`` classes are compared by brute force. In a larger one every class meets a few pivots; classes that nearly
equal one are done, since whatever is similar to them is then tied to that pivot too, and the others split on over ``CHILDREN``
tokens of their path.

Classes whose signatures agree as those of a similar pair might are tied together; ties are kept as spanning trees, so
their number is linear in the buckets' sizes. All pairs of a tied component are then verified on the sets themselves, in
blocks of at most ``TILE`` by ``TILE`` classes: so a pair that the recursion itself missed counts as soon as others tie it, and
nothing below the similarity ever does. Results are counts and spanning trees of links, never a row per pair.

Null and empty texts have no grams: all of them are one class without links. Repeated rows are
members of one class. Rows with null doc_id get the class of their text. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

GRAM = 5
SIMILARITY = 0.8
SIGNATURE = 48
SMALL = 1024
MISS = 1e-5
CHILDREN = 2
MAX_DEPTH = 6
TILE = 512
#: Agreeing min-hashes of a pair of the asked similarity are fewer than this once in a million times.
TIED = math.floor(SIGNATURE * SIMILARITY - 4.9 * math.sqrt(SIGNATURE * SIMILARITY * (1 - SIMILARITY)))
#: Agreeing min-hashes from which a class is as good as its pivot.
SAME = math.ceil(0.85 * SIGNATURE)
PIVOTS = 8
_WORD = re.compile(common.WORD)
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(f"min-hash {i}") | 1 for i in range(SIGNATURE)], dtype=np.uint64)


def grams(text: str | None, of: dict) -> np.ndarray:
    """Sorted distinct hashes of the text's word 5-grams."""
    words = _WORD.findall(text or "")
    if not words:
        return np.zeros(0, dtype=np.uint64)
    for w in words:
        if w not in of:
            of[w] = xxhash.xxh64_intdigest(w)
    h = np.array([of[w] for w in words], dtype=np.uint64)
    if len(of) > 150_000:
        of.clear()
    size = min(GRAM, len(h))
    x = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        x = (x ^ h[i : len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique(x)


def signature(x: np.ndarray) -> np.ndarray:
    mixed = x[:, None] * _MULTIPLIERS[None, :]
    mixed ^= mixed >> np.uint64(32)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0) >> np.uint64(32)


def embed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, class, n, signature) of each row; class is the 128-bit hash of the set, th a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, int] = {}
        for batch in batches:
            classes, sizes, signatures = [], [], []
            for text in batch.column(2).to_pylist():
                x = grams(text, of)
                classes.append(xxhash.xxh128_digest(x.tobytes()))
                sizes.append(len(x))
                signatures.append(signature(x).astype("<u4").tobytes() if len(x) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes), pa.array(sizes, pa.int32()), pa.array(signatures)], ["doc_id", "th", "class", "n", "signature"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return slim.mapInArrow(common.tidy(run), "doc_id long, th long, class binary, n int, signature binary")


def root_tokens() -> list[tuple[int, int]]:
    """(run, token) of the root's splits: runs are added until the recall is reached."""
    out: list[tuple[int, int]] = []
    run = 0
    while len({t for _, t in out}) < math.log(MISS) / math.log(1 - SIMILARITY):
        draw = (xxhash.xxh64_intdigest(f"run {run} token {t}") / 2.0**64 for t in range(SIGNATURE))
        out += [(run, t) for t, x in enumerate(draw) if x < 1 / (SIMILARITY * SIGNATURE) and t not in {k for _, k in out}]
        run += 1
    return out


def split(rows: DataFrame, root: bool) -> DataFrame:
    """Children (path, class) of rows (path, class, signature): at the root on its sampled tokens, else on CHILDREN tokens that a hash of the path chooses."""
    tokens_of_root = np.array([t for _, t in root_tokens()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u4").reshape(-1, SIGNATURE).astype(np.uint64)
            paths = np.array(batch.column(0)).view(np.uint64)
            choices = tokens_of_root if root else range(CHILDREN)
            for k in choices:
                x = (paths ^ np.uint64(0x5851F42D4C957F2D * (int(k) + 1) & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
                token = np.full(len(paths), int(k)) if root else (x % np.uint64(SIGNATURE)).astype(np.int64)
                y = (x ^ held[np.arange(len(paths)), token]) * np.uint64(0xBF58476D1CE4E5B9)
                y ^= y >> np.uint64(30)
                yield pa.RecordBatch.from_arrays([pa.array(y.view(np.int64)), batch.column(1)], ["path", "class"])

    return rows.select("path", "class", "signature").mapInArrow(common.tidy(run), "path long, class binary")


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def compare(rows: DataFrame) -> DataFrame:
    """Ties (a, b) of classes within each path of rows (path, class, n, signature): a spanning tree of those that might be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            paths = np.array(table.column(0).combine_chunks())
            if not len(paths):
                continue
            first = int(np.searchsorted(paths, paths[-1])) if paths[0] != paths[-1] else 0  # the last path may go on
            rest = table.slice(first)
            yield from ties(table.slice(0, first))
        if rest is not None:
            yield from ties(rest)

    def ties(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        paths, sizes = np.array(table.column(0).combine_chunks()), np.array(table.column(2).combine_chunks())
        classes = table.column(1).combine_chunks()
        tokens = np.frombuffer(b"".join(table.column(3).to_pylist()), dtype="<u4").reshape(-1, SIGNATURE)
        forest, left, right = Forest(len(paths)), [], []
        at, apart = np.arange(len(paths)), 1
        while len(at):
            at = at[: np.searchsorted(at, len(paths) - apart)]
            at = at[paths[at] == paths[at + apart]]
            for some in np.array_split(at, max(1, len(at) // 50_000)):
                other = some + apart
                fit = np.minimum(sizes[some], sizes[other]) >= SIMILARITY * np.maximum(sizes[some], sizes[other]) - 1e-9
                some, other = some[fit], other[fit]
                near = (tokens[some] == tokens[other]).sum(axis=1) >= TIED
                for i, j in zip(some[near].tolist(), other[near].tolist()):
                    if forest.tie(i, j):
                        left.append(i)
                        right.append(j)
            apart += 1
        if left:
            yield pa.RecordBatch.from_arrays([classes.take(pa.array(left)), classes.take(pa.array(right))], ["a", "b"])

    ordered = rows.select("path", "class", "n", "signature").repartition("path").sortWithinPartitions("path", "class")
    return ordered.mapInArrow(common.tidy(run), "a binary, b binary").distinct()


def meet(rows: DataFrame) -> DataFrame:
    """Classes of large buckets against their pivots. rows: (path, class, n, signature, pivots array<struct<class,n,signature>>).

    Output rows are ties (a, b), or what must split on (path, class). A class is tied to one pivot of each set of pivots that are tied among themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, tuple] = {}
        for batch in batches:
            paths, classes, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.array(batch.column(2))
            if not paths:
                continue
            tokens = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype="<u4").reshape(-1, SIGNATURE)
            a, b, on = [], [], []
            order = np.argsort(np.array(paths), kind="stable")
            cuts = np.flatnonzero(np.diff(np.array(paths)[order])) + 1
            for some in np.split(order, cuts):
                path = paths[some[0]]
                if path not in cache:
                    pivots = sorted(batch.column(4)[int(some[0])].as_py(), key=lambda p: p["class"])
                    held = np.frombuffer(b"".join(p["signature"] for p in pivots), dtype="<u4").reshape(-1, SIGNATURE)
                    n = np.array([p["n"] for p in pivots])
                    near = ((held[:, None] == held[None]).sum(axis=2) >= TIED) & _fits(n[:, None], n[None])
                    forest = Forest(len(pivots))
                    for i, j in zip(*np.nonzero(near)):
                        forest.tie(int(i), int(j))
                    cache[path] = ([p["class"] for p in pivots], held, n, np.array([forest.root(i) for i in range(len(pivots))]))
                names, held, n, root = cache[path]
                agree = (tokens[some][:, None] == held[None]).sum(axis=2)
                tied = (agree >= TIED) & _fits(sizes[some][:, None], n[None])
                for r in np.unique(root):
                    mine = tied & (root == r)[None]
                    for k in np.flatnonzero(mine.any(axis=1)).tolist():
                        name = classes[some[k]]
                        to = names[r] if name in names else names[int(mine[k].argmax())]
                        if to != name:
                            a.append(to)
                            b.append(name)
                on += some[~(agree >= SAME).any(axis=1)].tolist()
            none, gone = pa.nulls(len(on), pa.binary()), pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(a, pa.binary()), none]), pa.concat_arrays([pa.array(b, pa.binary()), none]), pa.concat_arrays([gone, pa.array([paths[i] for i in on], pa.int64())]), pa.concat_arrays([pa.nulls(len(a), pa.binary()), pa.array([classes[i] for i in on], pa.binary())])],
                ["a", "b", "path", "class"],
            )

    return rows.select("path", "class", "n", "signature", "pivots").mapInArrow(common.tidy(run), "a binary, b binary, path long, class binary")


def _fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x, y) >= SIMILARITY**2 * np.maximum(x, y)


def tiled(rows: DataFrame) -> DataFrame:
    """rows with each path of more than SMALL classes cut into parts and dealt over paths of two parts each: all pairs meet, no task holds more than two parts."""
    parts = rows.groupBy("path").agg(F.expr(f"cast(ceil(count(1) * 2 / {SMALL}) as int)").alias("parts"))
    dealt = rows.join(parts, "path").withColumn("part", F.expr("cast(pmod(xxhash64(class), parts) as int)"))
    pairs = F.explode(F.expr("transform(sequence(0, parts - 1), p -> struct(least(p, part) AS i, greatest(p, part) AS j))"))
    return dealt.select("path", "class", "n", "signature", pairs.alias("t")).select(F.xxhash64("path", "t.i", "t.j").alias("path"), "class", "n", "signature")


def ties(classes: DataFrame) -> DataFrame:
    """Spanning ties (a, b) over all classes that some path brought together and that might be similar."""
    found: list[DataFrame] = []
    rows = common.cut(split(classes.select(F.lit(0).cast("long").alias("path"), "class", "signature"), True), "paths")
    for depth in range(1, MAX_DEPTH + 1):
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = common.cut(rows.join(sizes, "path"), "sized")
        small = sized.where(F.col("size") <= SMALL).select("path", "class").join(classes, "class")
        found.append(common.cut(compare(small), "ties"))
        large = sized.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        large = large.join(classes.select("class", "n", "signature"), "class")
        # a bucket has about PIVOTS of them, whatever its size
        drawn = large.where(f"pmod(xxhash64(path, class), size) < {PIVOTS}")
        pivots = drawn.groupBy("path").agg(F.collect_list(F.struct("class", "n", "signature")).alias("pivots"))
        met = common.cut(meet(large.join(pivots, "path", "left").withColumn("pivots", F.expr("coalesce(pivots, array())"))), "met")
        found.append(common.cut(met.where("path IS NULL").select("a", "b").distinct(), "ties"))
        rest = met.where("path IS NOT NULL").select("path", "class").join(classes, "class")
        if depth < MAX_DEPTH:
            rows = common.cut(split(rest, False), "paths")
        else:  # what no split parts: compared in full
            found.append(common.cut(compare(tiled(rest)), "ties"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def verify(docs: DataFrame, classes: DataFrame, components: DataFrame) -> DataFrame:
    """(class, links, root): how many classes of its component each is similar to in a tile, and a spanning tree of these links.

    components: (class, group). A class's text is read from its first document. A component of more than TILE classes is dealt over
    tiles of two parts each, so that a task never holds more than two parts; a class goes to as many tiles as its component has parts.
    """
    wanted = components.join(classes.select("class", "rep", "th"), "class").select("class", F.col("rep").alias("w_id"), F.col("th").alias("w_th"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("class", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([grams(t, of).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["class", "grams"])

    held = common.cut(texts.mapInArrow(common.tidy(sets), "class binary, grams binary").dropDuplicates(["class"]), "grams")
    parts = components.groupBy("group").agg(F.expr(f"cast(ceil(count(1) * 2 / {TILE}) as int)").alias("parts"))
    dealt = components.join(parts, "group").withColumn("part", F.expr("cast(pmod(xxhash64(class), parts) as int)"))
    tiles = F.explode(F.expr("transform(sequence(0, parts - 1), p -> struct(least(p, part) AS i, greatest(p, part) AS j))"))
    dealt = dealt.select("class", "group", "part", tiles.alias("t")).select("class", "part", F.xxhash64("group", "t.i", "t.j").alias("tile"), "t.i", "t.j")
    rows = dealt.join(held, "class").select("tile", "class", "part", "i", "j", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, []
        for batch in batches:
            for tile, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if tile != key:
                    yield from links(kept)
                    key, kept = tile, []
                kept.append(row)
        yield from links(kept)

    def links(kept: list) -> Iterator[pa.RecordBatch]:
        if len(kept) < 2:
            return
        arrays = [np.frombuffer(r[4], dtype=np.uint64) for r in kept]
        n = np.array([len(a) for a in arrays])
        if len(kept) <= 6:
            same = np.diag(n).astype(np.float64)
            for i in range(len(kept)):
                for j in range(i):
                    same[i, j] = same[j, i] = len(np.intersect1d(arrays[i], arrays[j], assume_unique=True))
        else:  # an incidence matrix, some grams at a time
            words, at = np.unique(np.concatenate(arrays), return_inverse=True)
            row = np.repeat(np.arange(len(kept)), n)
            order = np.argsort(at, kind="stable")
            row, at = row[order], at[order]
            same = np.zeros((len(kept), len(kept)), dtype=np.float32)
            for a in range(0, len(words), 4096):
                lo, hi = np.searchsorted(at, a), np.searchsorted(at, a + 4096)
                dense = np.zeros((len(kept), 4096), dtype=np.float32)
                dense[row[lo:hi], at[lo:hi] - a] = 1
                same += dense @ dense.T
        linked = same >= SIMILARITY * (n[:, None] + n[None, :] - same) - 1e-6
        np.fill_diagonal(linked, False)
        part, (i, j) = np.array([r[1] for r in kept]), kept[0][2:4]
        if i != j:  # pairs within one part belong to that part's own tile
            linked &= part[:, None] != part[None, :]
        forest = Forest(len(kept))
        for x, y in zip(*np.nonzero(np.triu(linked))):
            forest.tie(int(x), int(y))
        degree = linked.sum(axis=1)
        at = np.flatnonzero(degree)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([kept[k][0] for k in at], pa.binary()), pa.array(degree[at].astype(np.int64)), pa.array([kept[forest.root(int(k))][0] for k in at], pa.binary())], ["class", "links", "root"])

    return rows.repartition("tile").sortWithinPartitions("tile", "class").mapInArrow(common.tidy(run), "class binary, links long, root binary")


def groups(links: DataFrame) -> DataFrame:
    """(class, group) of linked classes: the least class reachable, by contraction.

    Each round a node takes the least name around it, and the links between different names are the next round's graph, at most half as
    many nodes. At the end the rounds' names are looked up from the last to the first.
    """
    edges = common.cut(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    rounds = []
    while not edges.isEmpty():
        names = common.cut(edges.groupBy(F.col("a").alias("class")).agg(F.least(F.col("a"), F.min("b")).alias("group")), "names")
        rounds.append(names)
        left = names.select(F.col("class").alias("a"), F.col("group").alias("x"))
        right = names.select(F.col("class").alias("b"), F.col("group").alias("y"))
        edges = common.cut(edges.join(left, "a").join(right, "b").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    if not rounds:
        return edges.select(F.col("a").alias("class"), F.col("b").alias("group"))
    labels = rounds[-1]
    for names in reversed(rounds[:-1]):
        later = labels.select(F.col("class").alias("name"), F.col("group").alias("last"))
        labels = common.cut(names.join(later, F.col("group") == F.col("name"), "left").select("class", F.coalesce("last", "group").alias("group")), "labels")
    return labels


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links): (doc_id, th, class, n), (class, rep, th, n, signature), (class, links, root)."""
    common.small_batches(docs.sparkSession)
    with common.leaving(docs.sparkSession) as kept:
        members, classes, links = _join(docs)
        kept += [members, classes, links]
    return members.select("doc_id", "th", "class", "n"), classes, links


def _join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    members = common.cut(embed(docs), "members")
    classes = members.where("n > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "n", "signature")).alias("x"))
    classes = common.cut(classes.select("class", F.col("x.doc_id").alias("rep"), "x.th", "x.n", "x.signature"), "classes")
    links = common.cut(verify(docs, classes, groups(common.cut(ties(classes), "ties"))), "links")
    return members, classes, links


def linked_groups(links: DataFrame) -> DataFrame:
    with common.leaving(links.sparkSession) as kept:
        out = common.cut(groups(links.where("class != root").select(F.col("class").alias("a"), F.col("root").alias("b")).distinct()), "groups")
        kept.append(out)
    return out


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, links, group_id) of every row: the least doc_id of its class, how many other classes its class
    links to, and the least doc_id of all classes it is linked with by any chain."""
    members, classes, links = join(docs)
    degree = links.groupBy("class").agg(F.sum("links").alias("links"))
    reps = members.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    labels = linked_groups(links)
    least = labels.join(reps, "class").groupBy("group").agg(F.min("class_id").alias("group_id"))
    about = reps.join(degree, "class", "left").join(labels.join(least, "group").select("class", "group_id"), "class", "left")
    about = about.select("class", "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))
    return members.join(about, "class").select("doc_id", "th", "class_id", "links", "group_id")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs of which one of each group stays: the one with the least doc_id, then the least hash of the text.

    Rows without words are kept. Of rows that repeat that doc_id and text, all stay equal and one is kept.
    """
    members, _, links = join(docs)
    named = members.join(linked_groups(links), "class", "left").withColumn("worded", F.col("n") > 0)
    best = named.where("worded").groupBy(F.coalesce("group", "class").alias("group")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("x"))
    stay = best.select("x.doc_id", "x.th").union(named.where("NOT worded").select("doc_id", "th")).distinct()
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    kept = docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
