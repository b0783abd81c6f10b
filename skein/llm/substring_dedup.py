"""Substring dedup by relative Lempel-Ziv parsing.

The corpus is its own reference: every text is a block, indexed at anchors, the ``SEED`` consecutive words with the
least hash of each window of ``WINDOW`` words. The choice depends on the window's words alone, so that equal windows have
equal anchors. An index entry holds the anchor, its place, and a hash of its context: all the words of the
windows that chose it. A text is parsed from left to right into factors (start, length, block, offset); a factor
goes on as long as the block at the other place does:

* inside a factor, a context that the index holds at another place matches as a whole;
* at its boundaries, where the anchor is known but the context isn't, the windows around the anchor are checked one
  by one against the windows of the other contexts of that anchor. One place stands for all places with the same
  context, so a passage in very many texts is checked as often as it has different surroundings.

Factors have ``WINDOW`` words or more; everything between is literal. Contexts and windows are compared under
their anchor, so two 64-bit hashes have to agree. Counts are summed before they are shuffled; joins on anchors and
contexts take both sides from files, so that Spark may split large keys.

A null text has no words. Rows are told apart by doc_id (nulls equal) and text; repeated rows count as
documents of their own, and so do different texts under one doc_id. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

WINDOW = 35
SEED = 16
_WORD = re.compile(common.WORD)
_BASE = 0x9E3779B97F4A7C15
#: Hashed words that a worker keeps.
_KEPT = 200_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        got = xxhash.xxh64_intdigest(word)
        if len(self) < _KEPT:
            self[word] = got
        return got


@functools.lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n, dtype=np.uint64), np.ones(n, dtype=np.uint64)
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes().__getitem__, words), dtype=np.uint64, count=len(words))


def spans(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of word hashes h[lo:hi]."""
    up, down = _powers(1 << max(15, int(len(h)).bit_length()))
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    x = (total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def anchors(h: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor in order: its hash, its context's hash, and the first and last window that chose it."""
    at = np.arange(len(h) - seed + 1)
    seeds = spans(h, at, at + seed)
    view = np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1)
    chosen = view.argmin(axis=1) + np.arange(len(view))  # the first of equal ones, so never before an earlier window's
    lo = np.flatnonzero(np.diff(chosen, prepend=-1))
    hi = np.append(lo[1:], len(chosen)) - 1
    return seeds[chosen[lo]], spans(h, lo, hi + window), lo, hi


def factors(matched: list[tuple[int, int, int | None, int]]) -> list[list]:
    """Greedy factors [start, length, block, offset] of matched runs (start, end, block, offset): overlapping runs on one diagonal of one block are one."""
    out: list[list] = []
    ends: dict[tuple, list] = {}
    for start, end, block, offset in sorted(matched, key=lambda m: (m[0], -m[1])):
        open_ = ends.get((block, offset - start))
        if open_ is not None and start <= open_[0] + open_[1]:
            open_[1] = max(open_[1], end - open_[0])
        else:
            ends[block, offset - start] = new = [start, end - start, block, offset]
            out.append(new)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): th tells the texts under one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def _of(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """rows with what lists holds for their (doc_id, th)."""
    lists = lists.withColumnsRenamed({"doc_id": "l_id", "th": "l_th"})
    return rows.join(lists, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("th") == F.col("l_th")), how).drop("l_id", "l_th")


def index(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, th, anchor, context, lo, hi) of every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, parts = [], [], []
            for doc_id, th, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = _WORD.findall(text or "")
                if len(words) >= window:
                    parts.append(anchors(hashes(words), window, seed))
                    ids += [doc_id] * len(parts[-1][0])
                    ths += [th] * len(parts[-1][0])
            if parts:
                anchor, context, lo, hi = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), _signed(anchor), _signed(context), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["doc_id", "th", "anchor", "context", "lo", "hi"])

    return _texts(docs).mapInArrow(common.tidy(run), "doc_id long, th long, anchor long, context long, lo int, hi int")


def boundary_windows(docs: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, hash, doc_id, th, start, alone) of each window of the given contexts."""
    wanted = places.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi", "anchor", "alone")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, parts = [], [], []
            for doc_id, th, text, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                h = hashes(_WORD.findall(text))
                lo, hi = np.array([w["lo"] for w in own]), np.array([w["hi"] for w in own])
                size = hi - lo + 1
                start = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                anchor, alone = np.repeat(np.array([w["anchor"] for w in own], dtype=np.int64), size), np.repeat(np.array([w["alone"] for w in own], dtype=bool), size)
                parts.append((anchor, spans(h, start, start + window).view(np.int64), start, alone))
                ids += [doc_id] * len(start)
                ths += [th] * len(start)
            if parts:
                anchor, found, start, alone = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(found), pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(start, pa.int32()), pa.array(alone)], ["anchor", "hash", "doc_id", "th", "start", "alone"])

    held = _of(_texts(docs), wanted, "inner").select("doc_id", "th", "text", "wanted")
    return held.mapInArrow(common.tidy(run), "anchor long, hash long, doc_id long, th long, start int, alone boolean")


def _elsewhere(start: str, end: str) -> list:
    """A matched run and another place that holds it: the first one, or the last one for the first itself."""
    own = F.expr(f"struct(doc_id, th, {start} AS at) = first")
    return ["doc_id", "th", F.col(start).alias("start"), F.expr(end).cast("int").alias("end"), F.when(own, F.col("last.doc_id")).otherwise(F.col("first.doc_id")).alias("block"), F.when(own, F.col("last.at")).otherwise(F.col("first.at")).alias("offset")]


def matches(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, th, start, end, block, offset): runs of words that another place holds; each repeated window lies in one of them."""
    entries = common.cut(index(docs, window, seed), "index")
    often = entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("context") != F.max("context")).alias("various"))
    often = common.cut(often.where("n > 1").select("anchor", "various"), "often")
    shared = common.cut(entries.join(often, "anchor"), "shared")
    common.drop_cut(entries)
    common.drop_cut(often)

    place = F.struct("doc_id", "th", F.col("lo").alias("at"))
    contexts = shared.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"), F.max("various").alias("various"), F.max(F.expr("hi - lo")).alias("width"))
    contexts = common.cut(contexts, "contexts")
    whole = shared.join(contexts.where("n > 1").select("anchor", "context", "first", "last"), ["anchor", "context"])
    whole = whole.select(*_elsewhere("lo", f"hi + {window}"))

    ends = contexts.where("various").select("first.doc_id", "first.th", F.col("first.at").alias("lo"), F.expr("first.at + width").alias("hi"), "anchor", F.expr("n = 1").alias("alone"))
    windows = common.cut(boundary_windows(docs, ends, window), "windows")
    place = F.struct("doc_id", "th", F.col("start").alias("at"))
    twice = windows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    twice = common.cut(twice.where("n > 1").drop("n"), "twice")
    single = windows.where("alone").join(twice, ["anchor", "hash"]).select(*_elsewhere("start", f"start + {window}"))
    found = common.cut(whole.union(single), "matches")
    for done in (shared, contexts, windows, twice):
        common.drop_cut(done)
    return found


def dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, factors) of every row."""
    common.small_batches(docs.sparkSession)
    # A set: repeated rows of one place have the same runs.
    runs = matches(docs, window, seed).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end", "block", "offset")).alias("runs"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept, parsed = [], [], [], []
            for text, own in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
                words = _WORD.findall(text or "")
                n.append(len(words))
                parsed.append(factors([(r["start"], r["end"], r["block"], r["offset"]) for r in own or []]))
                if parsed[-1]:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    start, length = (np.array([f[i] for f in parsed[-1]]) for i in (0, 1))
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + length, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                gone.append(n[-1] - len(words))
                kept.append(" ".join(words))
            shape = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("block", pa.int64()), ("offset", pa.int32())]))
            listed = pa.array([[dict(zip(("start", "length", "block", "offset"), f)) for f in fs] for fs in parsed], shape)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), listed], ["doc_id", "n_words", "n_removed", "kept_text", "factors"])

    final = _of(_texts(docs), runs, "left").select("doc_id", "text", "runs")
    return final.mapInArrow(common.tidy(keep), "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start:int,length:int,block:long,offset:int>>")


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The contract read plainly, for tests on small inputs."""
    words = [_WORD.findall(t or "") for _, t in rows]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
