"""Toxicity by noisy-channel deobfuscation.

Words that look disguised (digits or signs for letters, letters spaced out, letters repeated) become character lattices:
each sign offers itself and the letters it can stand for, runs offer one or two letters, separators can be dropped. A
Viterbi search takes the reading that a character trigram model, counted over all documents, finds likeliest after the
channel's costs. Plain words have a lattice of one path and are taken as they are. The restored words and their
prefixes then score the text: a logistic regression over the features that set the toxic training texts apart.

Labels are learned from a bounded sample of the labelled rows, ``TRAIN_ROWS`` of those with the least hash of doc_id, and never from rows
held out (crc32 of doc_id as text, mod 4, is 2; a null doc_id is as ''). The counts of the character model cover every text.
Null and empty texts have no words and get the score of the bias alone. Without any labels every score is about 1e-13; labels other than 0
and 1 are none. Repeated
doc_ids in labels count once for each row they meet; repeated documents get equal scores. Extra columns are carried by ``score``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

TRAIN_ROWS = 40_000
FEATURES = 3_000
THRESHOLD = 0.3
#: Log-odds of a feature times the root of its toxic texts, from which it is no chance.
EVIDENCE = 6
PREFIXES = (3, 4, 5, 6, 7)
#: What a sign can stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou", "%": "aeiou"}
#: Look-alikes of Latin letters.
ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i", "у": "y", "ѕ": "s", "ο": "o", "α": "a", "ι": "i"}
SEPARATORS = ".-_*·~/\\"
EDGE = ".,;:?\"'()[]{}<>«»“”„…%&=/\\~`^-_"
_SPACED = re.compile(r"(?<!\w)\w(?:[ .\-_*~/]\w){3,}(?!\w)")
_DISGUISED = re.compile(r"[0-9@$!|+(€£*#%.\-_·~/\\а-яіѕοαι​-‍⁠﻿！-～]|(.)\1\1")
_PLAIN = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile("[­​-‍⁠﻿]")

_ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
_CODE = {c: i + 2 for i, c in enumerate(_ALPHABET)}  # 0 is a word's edge, 1 any other character
_SIZE = 64


class CharModel:
    """Trigram log-probabilities of characters within words, interpolated with bigrams and single ones."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + _SIZE)
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).astype(np.float32)

    def step(self, a: int, b: int, c: int) -> float:
        return float(self.log[a, b, c])


def trigram_counts(words: Counter) -> np.ndarray:
    """Counts over the letters of words, each as often as it occurs."""
    total = np.zeros(_SIZE**3, dtype=np.int64)
    if not words:
        return total
    codes: list[int] = []
    weight: list[int] = []
    for w, n in words.items():
        run = [0, 0, *[_CODE.get(c, 1) for c in w], 0, 0]
        codes += run
        weight += [n] * len(run)
    x, n = np.array(codes), np.array(weight)
    tri = (x[:-2] * _SIZE + x[1:-1]) * _SIZE + x[2:]
    whole = (x[1:-1] != 0) | (x[2:] == 0) & (x[:-2] != 0)
    np.add.at(total, tri[whole], n[2:][whole])
    return total


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Choices (letters, cost) for each place; empty letters drop the place."""
    places: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(token):
        c, end = token[at], at + 1
        while end < len(token) and token[end] == c:
            end += 1
        run, at = end - at, end
        if c in ALIKE:
            letters = [(ALIKE[c], 0.2), (c, 3.0)]
        elif c in LEET:
            letters = [(x, 1.0 + 0.5 * (len(LEET[c]) > 2)) for x in LEET[c]] + [(c, 2.0)]
            if c in SEPARATORS:
                letters.append(("", 1.0))
        elif c in SEPARATORS:
            letters = [("", 0.5), (c, 2.0)]
        else:
            letters = [(c, 0.0)]
        if run == 1:
            places.append(letters)
        elif run == 2:
            places.append([(x * 2, k) for x, k in letters] + [(x, k + 1.5) for x, k in letters])
        else:  # a run stands for one or two letters
            places.append([(x, k + 0.5) for x, k in letters] + [(x * 2, k + 1.0) for x, k in letters])
    return places


def restore(token: str, model: CharModel) -> str:
    """The likeliest reading of a disguised token."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for choices in lattice(token):
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for letters, cost in choices:
                x, y, s = a, b, score - cost
                for c in letters:
                    z = _CODE.get(c, 1)
                    s += model.step(x, y, z)
                    x, y = y, z
                if (x, y) not in new or new[x, y][0] < s:
                    new[x, y] = (s, text + letters)
        states = new
    return max((s + model.step(a, b, 0), t) for (a, b), (s, t) in states.items())[1]


def readings(raw: str, model: CharModel) -> list[str]:
    """Restored words of a white-space free token in lower case."""
    if not raw.isascii():
        raw = _HIDDEN.sub("", unicodedata.normalize("NFKC", raw)).lower()
    bare = raw.strip(EDGE)
    core = bare.strip("!|*#+($@€£")
    if core.isalpha() and not _DISGUISED.search(core):
        if len(core) == len(bare):
            return [core]
        found = [core]
        bare = bare.rstrip("!*#+|").lstrip("*#+|")  # signs that stand for a word's first or last letter
        return found if bare == core else [*found, restore(bare, model)]
    found = _PLAIN.findall(bare)
    if core and _DISGUISED.search(core) and any(c.isalpha() for c in core):
        found.append(restore(core, model))
        if bare != core:
            found.append(restore(bare.rstrip("!"), model))
    return found


def features(words: list[str]) -> set[str]:
    """The words themselves and their prefixes."""
    out = set()
    for w in words:
        if len(w) > 2 and w.isalpha():
            out.add(w + "$")
            out.update(w[:k] for k in PREFIXES if k <= len(w))
    return out


class Reader:
    """Distinct restored words of texts; what a token gives is kept for a bounded number of tokens."""

    def __init__(self, model: CharModel, derive):
        self.model, self.derive, self.of = model, derive, {}

    def read(self, text: str | None) -> set:
        if not text:
            return set()
        text = text.lower()
        got: set = set()
        of = self.of
        for token in set(text.split()):
            x = of.get(token)
            if x is None:
                x = self.derive(features(readings(token, self.model)))
                if len(of) < 150_000:
                    of[token] = x
            if x:
                got.update(x)
        for m in _SPACED.finditer(text):
            letters = re.sub(r"[ .\-_*~/]", "", m[0])
            got.update(self.derive(features([restore(letters, self.model), letters])))
        return got


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts, added up per task, then over the (bounded) trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(_SIZE**3, dtype=np.int64), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(text.lower().split())
                    if len(words) > 100_000:
                        total += trigram_counts(_letters(words))
                        words = Counter()
        total += trigram_counts(_letters(words))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["tri", "n"])

    rows = docs.select("text").mapInArrow(common.tidy(run), "tri long, n long").groupBy("tri").agg(F.sum("n").alias("n")).collect()  # 64**3 rows at most
    total = np.zeros(_SIZE**3, dtype=np.int64)
    for tri, n in rows:
        total[tri] = n
    return total


def _letters(tokens: Counter) -> Counter:
    out: Counter = Counter()
    for token, n in tokens.items():
        w = token.strip(EDGE + "!|*#+($@€£")
        if w.isalpha():
            out[w] += n
    return out


def fit(rows: list[list[int]], labels: list[int], size: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features with an L2 penalty: full gradient steps with momentum."""
    y = np.array(labels, dtype=np.float64)
    if not len(y):
        return np.zeros(size), -30.0
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], dtype=np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w, bias, v, vb = np.zeros(size), np.log(share / (1 - share)), np.zeros(size), 0.0
    scale = 1 / np.sqrt(np.bincount(col, minlength=size) / len(y) + 1e-3)
    for _ in range(rounds):
        z = np.bincount(row, weights=w[col] * scale[col], minlength=len(y)) + bias
        gap = 1 / (1 + np.exp(-z)) - y
        grad = np.bincount(col, weights=gap[row], minlength=size) * scale / len(y) + 1e-4 * w
        v = 0.9 * v - 0.5 * grad
        vb = 0.9 * vb - 0.5 * gap.mean()
        w, bias = w + v, bias + vb
    return w * scale, bias


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray) -> dict:
    """The scoring model: features, weights, bias."""
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    known = labels.where("cast(toxic as int) IN (0, 1) AND doc_id IS NOT NULL").where(F.crc32(id_text) % 4 != 2).select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
    known = F.broadcast(known.orderBy(F.xxhash64("l_id"), "l_id").limit(TRAIN_ROWS))  # 12 bytes a row, TRAIN_ROWS at most
    sample = common.cut(docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("l_id")).select("text", "toxic"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(CharModel(counts), tuple), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update(reader.read(text))
        for toxic in (0, 1):
            if seen[toxic]:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen[toxic])), pa.array([toxic] * len(seen[toxic]), pa.int32()), pa.array(list(seen[toxic].values()), pa.int64())], ["feature", "toxic", "n"])

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    by = sample.mapInArrow(common.tidy(count), "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("n1"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("n0"))
    odds = F.log((F.col("n1") + 0.5) / (ones + 1)) - F.log((F.col("n0") + 0.5) / (zeros + 1))
    best = by.where(F.col("n1") >= max(3, ones // 400)).withColumn("odds", odds).where(f"odds > 1.5 AND odds * sqrt(n1) >= {EVIDENCE}").orderBy(F.desc(F.col("odds") * F.sqrt("n1")), "feature").limit(FEATURES)
    vocabulary = {r["feature"]: i for i, r in enumerate(best.collect())}  # FEATURES rows at most

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(CharModel(counts), lambda fs: tuple(vocabulary[f] for f in fs if f in vocabulary))
        for batch in batches:
            found = [sorted(reader.read(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    rows = sample.mapInArrow(common.tidy(pick), "toxic int, found array<int>").collect()  # TRAIN_ROWS, times the rows of a repeated doc_id
    common.drop_cut(sample)
    weights, bias = fit([r["found"] for r in rows], [r["toxic"] for r in rows], len(vocabulary))
    return {"vocabulary": vocabulary, "weights": weights, "bias": bias}


def score(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """docs with score (0 to 1), predicted (0 or 1) and held_out; clashing columns of these names are replaced."""
    common.small_batches(docs.sparkSession)
    base = docs if learn_from is None else learn_from
    counts = char_counts(base)
    model = train(base, labels, counts)
    vocabulary, weights, bias = model["vocabulary"], model["weights"], model["bias"]
    names = [c for c in docs.columns if c not in ("score", "predicted", "held_out")]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(CharModel(counts), lambda fs: tuple(vocabulary[f] for f in fs if f in vocabulary))
        for batch in batches:
            z = np.array([bias + sum(weights[i] for i in sorted(reader.read(t))) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], [*names, "score"])

    kept = docs.select(*names)
    schema = kept.withColumn("score", F.lit(0.0)).schema
    scored = kept.mapInArrow(common.tidy(run), schema)
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4) == 2
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int")).withColumn("held_out", held)
