"""Byte-level BPE encoding and decoding by a pair occurrence index.

All distinct pre-tokens of a slice of a partition are laid out in one flat symbol array. An index maps
every mergeable pair (by its rank) to the positions where it occurs. Active ranks are taken in ascending
order; all occurrences of a rank are merged at once, and only the lists of the pairs that the merge
touched are updated. A pair that holds a merged token ranks after the merge that made the token, so one
ascending pass is the same as repeated lowest-rank-first merging in each word.

Null text counts as empty; an empty text has no ids. Repeated rows and ties are independent. Extra columns
are carried by ``encode`` and dropped by ``digest``.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

# Characters whose classes (letter, number, space, other) are the same in Python's re as in the tokenizers library.
_PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-՗ -⁯₠-₿ぁ-ヿ一-鿿가-힣\U0001f300-\U0001f64f]*")
# The letters among them: the regular expression engine looks ranges up in a bitmap, character categories one by one.
_LETTERS = (
    "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02c1\u02c6-\u02d1\u02e0-\u02e4\u02ec\u02ee\u0370-\u0374\u0376\u0377\u037a-\u037d\u037f\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u03f5\u03f7-\u0481\u048a-\u052f"
    "\u0531-\u0556\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u4e00-\u9fff\uac00-\ud7a3"
)
# Pre-tokens of texts of such characters alone. Words come first, as no contraction begins like one.
_PIECE = re.compile(rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
#: Words kept per Python worker.
CACHE = 150_000
# Kinds of characters for piece_starts(); the last are characters that _PLAIN lacks and white space beyond ASCII.
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of every code point below 0x20000 by the patterns above; all further ones are odd."""
    every = "".join(map(chr, range(0x20000)))
    kinds = np.full(len(every), _ODD, dtype=np.uint8)
    for kind, pattern in ((_SIGN, _PLAIN), (_ODD, re.compile(r"\s+")), (_LETTER, re.compile(f"[{_LETTERS}]+")), (_DIGIT, re.compile("[0-9]+")), (_SPACE, re.compile(r"[\t-\r ]+"))):
        for m in pattern.finditer(every):
            kinds[m.start() : m.end()] = kind
    return kinds


def piece_starts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of texts that lie side by side as UTF-8: the bytes that they begin at, and the bytes of odd characters.

    starts: the first byte of each text. A text with an odd character is left to pieces(); all others are cut as _PIECE does.
    """
    if not len(data):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    of = _kinds()
    kinds = of[:256].take(data)
    for least, size in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
        # lead bytes; a longer character is read again as what it is
        lead = np.flatnonzero(data >= least) if size == 2 else lead[data[lead] >= least]
        if not len(lead):
            break
        code = data[lead].astype(np.int32) & (0x7F >> size)
        for k in range(1, size):
            code = code << 6 | (data[lead + k] & 0x3F)
        kind = of.take(code, mode="clip")
        for k in range(size):
            kinds[lead + k] = kind
    n, starts = len(data), starts[starts < len(data)]
    # the end is a start too, and two more places are out of a contraction's way
    begins, first = np.zeros(n + 3, dtype=bool), np.zeros(n + 3, dtype=bool)
    first[starts] = first[n:] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:n])
    begins |= first
    # the last of a run of white space leaves it, if more of the text follows; a plain space then goes with what follows
    blank = kinds == _SPACE
    last = blank[:-1] > blank[1:]
    last &= ~first[1:n]
    begins[: n - 1] |= last
    last &= data[:-1] == 32
    begins[1:n] &= ~last
    # contractions: a single sign without a space before it
    at = np.flatnonzero(data == 39)
    at = at[begins[at] & ~first[at + 1]]
    one, two = data[np.minimum(at + 1, n - 1)], data[np.minimum(at + 2, n - 1)]
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # re, ve, ll
    long &= ~first[at + 2]
    short = (one == 115) | (one == 116) | (one == 109) | (one == 100)  # s, t, m, d
    begins[at[long | short] + 1] = False
    begins[at[short] + 2] = begins[at[long] + 3] = True
    return np.flatnonzero(begins[:n]), np.flatnonzero(kinds == _ODD)


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairIndexBpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab = spec["model"]["vocab"]
        stand_in = byte_alphabet()
        back = {c: b for b, c in enumerate(stand_in)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.first = np.array([vocab[c] for c in stand_in], dtype=np.int64)
        self.size = max(max(vocab.values()), *self.special.values(), 0) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        code = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(code)
        self.codes, self.ranks = code[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.left, self.right = code // self.size, code % self.size
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._pretokenizer = None
        self.path = path

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of the text; special tokens stand as pieces of their own."""
        if self._split is not None and "<|" in text:
            parts = self._split.split(text)
            if len(parts) > 1:
                return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self._plain_pieces(part))]
        return self._plain_pieces(text)

    def _plain_pieces(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _PIECE.findall(text)
        if self._pretokenizer is None:
            from tokenizers import Tokenizer

            self._pretokenizer = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._pretokenizer.pre_tokenize_str(text)]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge; a negative symbol marks a word's end."""
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Words are taken whole; the index covers all of them at once."""
        raw = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        total = int(size.sum()) + len(raw)
        word_of = np.repeat(np.arange(len(raw)), size + 1)
        sym = np.full(total + 1, -1, dtype=np.int64)  # one end mark after each word
        ends = np.cumsum(size + 1) - 1
        inner = np.ones(total, dtype=bool)
        inner[ends] = False
        sym[:total][inner] = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        nxt = np.arange(1, total + 2)
        prv = np.arange(-1, total)
        index: dict[int, list[np.ndarray]] = {}

        def enter(pos: np.ndarray, rank: np.ndarray) -> None:
            keep = rank >= 0
            pos, rank = pos[keep], rank[keep]
            if not len(pos):
                return
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist(), len(pos)]
            for r, s, e in zip(rank[starts[:-1]].tolist(), starts, starts[1:]):
                if (held := index.get(r)) is None:
                    index[r] = [pos[s:e]]
                    heapq.heappush(active, r)
                else:
                    held.append(pos[s:e])

        active: list[int] = []
        enter(np.arange(total), self._rank_of(sym[:total], sym[1:]))
        while active:
            r = heapq.heappop(active)
            held = index.pop(r)
            a, b, new = int(self.left[r]), int(self.right[r]), int(self.made[r])
            pos = held[0] if len(held) == 1 else np.concatenate(held)
            pos = pos[(sym[pos] == a) & (sym[nxt[pos]] == b)]
            if not len(pos):
                continue
            if a == b or len(held) > 1:
                pos = np.unique(pos)
            if a == b:  # runs such as aaa: pairs must not overlap, leftmost first
                kept, last = [], -1
                for p in pos.tolist():
                    if p != last:
                        kept.append(p)
                        last = int(nxt[p])
                    else:
                        last = -1
                pos = np.array(kept, dtype=np.int64)
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = new
            sym[gone] = -2
            nxt[pos] = after
            prv[after] = pos
            before = prv[pos]
            before = before[before >= 0]
            left = np.concatenate([before, pos])
            enter(left, self._rank_of(sym[left], sym[nxt[left]]))
        alive = sym[:total] >= 0
        ids, owner = sym[:total][alive].tolist(), word_of[alive]
        stops = np.searchsorted(owner, np.arange(len(raw) + 1)).tolist()
        return [ids[s:e] for s, e in zip(stops, stops[1:])]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


class WordMemo:
    """What is derived from a word's ids, kept for a bounded number of words per worker."""

    def __init__(self, bpe: PairIndexBpe, derive: Callable[[list[int]], object]):
        self.bpe, self.derive, self.of = bpe, derive, {}

    def learn(self, words: set[str]) -> dict:
        new = [w for w in words if w not in self.of]
        if len(self.of) + len(new) > CACHE:
            self.of.clear()
            new = list(words)
        special = self.bpe.special
        plain = [w for w in new if w not in special]
        for w, ids in zip(plain, self.bpe.encode_words(plain) if plain else ()):
            self.of[w] = self.derive(ids)
        for w in new:
            if w in special:
                self.of[w] = self.derive([special[w]])
        return self.of


def slices(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts of a bounded number of characters; a text is never cut."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


@functools.lru_cache(maxsize=2)
def _digest_memo(path: str) -> WordMemo:
    bpe = vocabulary(path)
    return WordMemo(bpe, lambda ids: (",".join(map(str, ids)), b"".join(map(bpe.token_bytes.__getitem__, ids))))


@functools.lru_cache(maxsize=2)
def _ids_memo(path: str) -> WordMemo:
    return WordMemo(vocabulary(path), tuple)


def encode_texts(texts: list[str], path: str) -> list[list[int]]:
    """Ids of every text, as the tokenizers library gives them without template tokens."""
    memo, out = _ids_memo(path), []
    for run in slices(texts):
        cut_up = [memo.bpe.pieces(t) for t in run]
        of = memo.learn({p for ps in cut_up for p in ps})
        out += [[i for p in ps for i in of[p]] for ps in cut_up]
    return out


def decode_ids(ids: list[int], path: str) -> str:
    """Text of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
    of = vocabulary(path).token_bytes
    return b"".join(of.get(i, b"") for i in ids).decode("utf-8", errors="replace")


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add an array<int> column of ids; other columns are kept as they are (a clashing ``into`` is replaced)."""

    @F.pandas_udf("array<int>")
    def ids(col: pd.Series) -> pd.Series:
        return pd.Series(encode_texts(["" if t is None else t for t in col], path))

    return docs.withColumn(into, ids(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Add the decoded text of an id array; null ids give an empty text."""

    @F.pandas_udf("string")
    def text(col: pd.Series) -> pd.Series:
        return pd.Series([decode_ids([] if x is None else list(x), path) for x in col], dtype=object)

    return docs.withColumn(into, text(F.col(ids)))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode again, and return one digest row per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _digest_memo(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for run_ in slices(["" if t is None else t for t in batch["text"]]):
                cut_up = [memo.bpe.pieces(t) for t in run_]
                words: set[str] = set()
                for ps in cut_up:
                    words.update(ps)
                of = memo.learn(words)
                for ps in cut_up:
                    got = [of[p] for p in ps]
                    ids = ",".join([g[0] for g in got])
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                    text = b"".join([g[1] for g in got]).decode("utf-8", errors="replace")
                    text_hash.append(hashlib.sha256(text.encode()).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": text_hash})

    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(common.tidy(run), DIGEST)
