"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(word | class, history). Histories are hashed features: the word
before, the word before that (a skip), and both together. ``HEAD`` frequent words have classes of ``CLASS`` words
that occur in texts of the same kind and in similar numbers; within a class, hashed weights tell the words apart: a (feature, class) has
a block of ``CLASS`` weights side by side, one a word, so that numpy moves blocks and not single weights. The
other words of the ``KNOWN`` most frequent ones fall into classes by frequency, all further words (and the one unseen
word) into a last class; within these, probability goes by (count + 1). So the untrained model is the smoothed unigram.

Counts cover all training texts and are exact. Training is distributed: each task makes gradient
updates (AdaGrad) over every position of its own training texts, ``BATCH`` at most at a time and on the weights that have a gradient, and the
tasks' changes are averaged where they touched a weight. Texts are split and their words numbered by Arrow, a part of a record batch at
once; scoring runs in numpy on such parts. Counts of words beyond ``KNOWN`` come by a join.

Null and empty texts are one end token. Repeated rows are scored alike, and each counts in training. A null doc_id
hashes as ''. Without training texts every count is 0 and both scores are those of one unseen word each. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import common
from skein.llm.common import regroup

HEAD = 4096
CLASS = 64
KNOWN = 100_000
KINDS = 8
ROWS = 1 << 14
PAIRS = 1 << 21
#: Positions of a gradient update.
BATCH = 4096
#: Weights up to this number have powers of which no three multiply to what 32-bit numbers can't hold.
TAME = 25
#: Bytes of text that are read at once (a longer text is still whole), and that are counted at once.
PART, COUNTED = 8 << 20, 16 << 20
RATE = 0.25
END = b""
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_BYTES = np.arange(1, 257, dtype=np.uint32) * _M1
_BYTES = (_BYTES ^ (_BYTES >> np.uint32(13))) * _M2
#: Where each feature's rows begin, side by side.
_TURNS = np.arange(4, dtype=np.uint32) * np.uint32(ROWS)
#: Stand for the two words before a text.
_START = np.array([7, 5], dtype=np.uint32)


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lowered, and the end. bytes.lower and bytes.split know just ASCII letters and white space."""
    return [*(text or "").encode().lower().split(), END]


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """tokens() of many texts: where each text's tokens start (and the last ones end), each token's number, and the distinct words by number."""
    # take() copies: Arrow's string functions go wrong on the offsets of a slice
    t = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    t = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(t, "")))
    # an empty text splits into one empty word, the end; other texts get theirs by a space more
    empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    t = pc.if_else(pc.equal(t, empty), empty, pc.binary_join_element_wise(t, empty, space))
    lists = pc.ascii_split_whitespace(t)
    words = lists.flatten().dictionary_encode()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))])
    return starts, words.indices.to_numpy(), words.dictionary.cast(pa.large_binary())


def hashes(words: pa.Array) -> np.ndarray:
    """32 bits for each word: a polynomial of its bytes, each of which stands for a mixed number."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64, count=words.offset + len(words) + 1)[words.offset :]
    size, some = np.diff(ends), np.flatnonzero(np.diff(ends))
    h = np.zeros(len(words), dtype=np.uint32)
    if len(some):
        at = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], size)
        powers = np.cumprod(np.full(int(size.max()), _M2, dtype=np.uint32), dtype=np.uint32)
        values = _BYTES[np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]] * powers[at]
        h[some] = np.add.reduceat(values, ends[:-1][some] - ends[0], dtype=np.uint32)
    h ^= h >> np.uint32(15)
    h *= _M1
    return h ^ (h >> np.uint32(13))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n, kind): counts over all rows, and the kind of text (a hash of its commonest word) with most of them, the first of such; summed per task first."""

    def count(texts: pa.Array) -> pa.RecordBatch:
        starts, at, words = split(texts)
        size, rank = len(words), np.empty(len(words), dtype=np.int64)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(size)
        # a text's words with their counts; the commonest is the last of those with the most, by bytes
        pair, n = np.unique(np.repeat(np.arange(len(texts)), np.diff(starts)) * size + rank[at], return_counts=True)
        text, word = pair // size, pair % size
        first = np.flatnonzero(np.diff(text, prepend=-1))
        most = np.maximum.reduceat(n * size + word, first) % size
        of_rank = np.argsort(rank)
        hashed = {w: xxhash.xxh32_intdigest(words[of_rank[w]].as_py()) % KINDS for w in np.unique(most).tolist()}
        kind = np.array([hashed[w] for w in most.tolist()], dtype=np.int64)[text]
        sums = np.bincount(kind * size + word, weights=n, minlength=KINDS * size)
        some = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays(
            [words.take(pa.array(of_rank[some % size])).cast(pa.binary()), pa.array((some // size).astype(np.int32)), pa.array(sums[some].astype(np.int64))], ["word", "kind", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches, 0, COUNTED):
            yield count(batch.column(0))

    rows = docs.select("text").mapInArrow(common.tidy(run), "word binary, kind int, n long")
    sums = rows.groupBy("word").agg(*[F.sum(F.expr(f"if(kind = {k}, n, 0)")).alias(f"k{k}") for k in range(KINDS)])
    kinds = [f"k{k}" for k in range(KINDS)]
    kind = F.expr(f"cast(array_position(array({', '.join(kinds)}), greatest({', '.join(kinds)})) - 1 as int)")
    return sums.select("word", F.expr(" + ".join(kinds)).alias("n"), kind.alias("kind"))


_KINDS_OF = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _change(what: str, at: int, salt: int, delta: np.ndarray, touched: np.ndarray) -> pa.RecordBatch:
    cols = [[what], [at], [salt], [delta.tobytes()], [touched.astype(np.uint16).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS_OF)], ["what", "piece", "salt", "delta", "touched"])


class Model:
    """Vocabulary, classes and weights. Sizes are fixed by the module's constants."""

    def __init__(self, rows: list, total: int, distinct: int):
        """rows: the KNOWN most frequent (word, n, kind) in order."""
        self.total, self.distinct = total, distinct
        head = rows[: HEAD]
        by_kind: dict[int, list[int]] = {}
        for i, (_, _, kind) in enumerate(head):
            by_kind.setdefault(kind, []).append(i)
        self.words = pa.array([x[0] for x in rows], pa.large_binary())
        n = np.array([x[1] for x in rows], dtype=np.float64)
        self.count = n
        self.class_of = np.zeros(len(rows) + 1, dtype=np.int32)
        self.place = np.zeros(max(1, len(head)), dtype=np.int32)
        members = []
        for kind in sorted(by_kind):
            for a in range(0, len(by_kind[kind]), CLASS):
                part = by_kind[kind][a : a + CLASS]
                self.class_of[part], self.place[part] = len(members), np.arange(len(part))
                members.append(part)
        self.heads = len(members)
        self.members = np.full((max(1, self.heads), CLASS), -1, dtype=np.int64)
        for c, part in enumerate(members):
            self.members[c, : len(part)] = part
        bins: dict[int, int] = {}
        for i in range(len(head), len(rows)):
            self.class_of[i] = self.heads + bins.setdefault(int(math.log2(n[i] + 1)), len(bins))
        self.rare = self.class_of[len(rows)] = self.heads + len(bins)
        self.classes = int(self.rare) + 1
        mass = np.bincount(self.class_of[: len(rows)], weights=n + 1, minlength=self.classes)
        # all words beyond, and the unseen one
        mass[self.rare] = max(1.0, total + distinct + 1 - (n + 1).sum())
        self.mass = mass
        self.bias = np.log(mass / mass.sum()).astype(np.float32)
        self.word_bias = np.full((max(1, self.heads), CLASS), -1e9, dtype=np.float32)
        for c, part in enumerate(members):
            self.word_bias[c, : len(part)] = np.log((n[part] + 1) / mass[c])
        self.class_hash = np.arange(1, self.classes + 1, dtype=np.uint32) * _M1
        self.row = np.zeros((ROWS, self.classes), dtype=np.float32)
        self.pair = np.zeros(PAIRS, dtype=np.float32)

    @staticmethod
    def features(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hashes of the word before, the one before that, and both, for the hashes of whole texts' words."""
        one, two = np.empty_like(h), np.empty_like(h)
        one[1:], two[2:] = h[:-1], h[:-2]
        begin = starts[:-1]
        one[begin], two[begin] = _START[1], _START[0]
        more = begin[np.diff(starts) > 1] + 1
        two[more] = _START[1]
        f = np.empty((len(h), 3), dtype=np.uint32)
        f[:, 0], f[:, 1] = one * _M1, two * _M2
        f[:, 2] = f[:, 0] ^ (f[:, 1] + _M1)
        f ^= f >> np.uint32(15)
        return f

    def ids(self, words: pa.Array) -> np.ndarray:
        """Words' ids, len(count) for those beyond."""
        return pc.fill_null(pc.index_in(words, self.words), len(self.count)).to_numpy().astype(np.int64)

    def read_all(self, starts: np.ndarray, at: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and features of what split() made of whole texts."""
        return self.ids(words)[at], self.features(hashes(words)[at], starts)

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and features of a whole text's words."""
        return self.read_all(np.array([0, len(words)]), np.arange(len(words)), pa.array(words, pa.large_binary()))

    @staticmethod
    def class_rows(f: np.ndarray) -> np.ndarray:
        return (f * _M2) >> np.uint32(32 - 14)

    def word_blocks(self, f: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return ((f ^ self.class_hash[classes][:, None]) * _M2) >> np.uint32(32 - 15)

    def class_logits(self, f: np.ndarray, room: Room | None = None) -> tuple[np.ndarray, np.ndarray]:
        rows = self.class_rows(f)
        return rows, _gather(self.row, rows, self.bias, room or Room())

    def word_logits(self, f: np.ndarray, classes: np.ndarray, room: Room | None = None) -> tuple[np.ndarray, np.ndarray]:
        room = room or Room()
        blocks = self.word_blocks(f, classes)
        return blocks, _gather(self.pair.reshape(-1, CLASS), blocks, room.take("bias", self.word_bias, classes), room)

    def log_probs(self, ids: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Natural log P of each position; for rare words that of the class alone."""
        out, room = np.empty(len(ids)), Room()
        # a softmax is made of products of powers: those of the tables are taken once, not for each position
        tame = max(-self.row.min(), self.row.max(), -self.pair.min(), self.pair.max()) <= TAME
        if tame:
            row, pair, bias, word_bias = np.exp(self.row), np.exp(self.pair).reshape(-1, CLASS), np.exp(self.bias), np.exp(self.word_bias)
        for a in range(0, len(ids), 2048):
            i, g = ids[a : a + 2048], f[a : a + 2048]
            c = self.class_of[i]
            got, odd = _log_share(row, self.class_rows(g), bias, c, room) if tame else (np.empty(len(i)), np.arange(len(i)))
            if len(odd):
                got[odd] = _log_softmax_at(self.class_logits(g[odd], room)[1], c[odd], room)
            head = np.flatnonzero(c < self.heads)
            if len(head):
                h, d, place = g[head], c[head], self.place[i[head]]
                more, odd = _log_share(pair, self.word_blocks(h, d), room.take("bias", word_bias, d), place, room) if tame else (np.empty(len(h)), np.arange(len(h)))
                if len(odd):
                    more[odd] = _log_softmax_at(self.word_logits(h[odd], d[odd], room)[1], place[odd], room)
                got[head] += more
            mid = (c >= self.heads) & (c < self.rare)
            got[mid] += np.log((self.count[i[mid]] + 1) / self.mass[c[mid]])
            out[a : a + 2048] = got
        return out

    def learn(self, ids: np.ndarray, f: np.ndarray, row_sum: np.ndarray, pair_sum: np.ndarray, room: Room | None = None) -> None:
        """One AdaGrad step on a batch of positions."""
        room = room or Room()
        c = self.class_of[ids]
        rows, z = self.class_logits(f, room)
        p = _softmax(z, room)
        p[np.arange(len(ids)), c] -= 1
        # the features' sums come at once, their steps one after another
        keys, sums = _sums((rows + _TURNS[:-1]).T.ravel(), p, room)
        cuts = np.searchsorted(keys, _TURNS)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            _step(self.row, row_sum, keys[a:b] - k * ROWS, sums[a:b], room)
        head = np.flatnonzero(c < self.heads)
        if len(head):
            blocks, z = self.word_logits(f[head], c[head], room)
            p = _softmax(z, room)
            p[np.arange(len(head)), self.place[ids[head]]] -= 1
            _step(self.pair.reshape(-1, CLASS), pair_sum.reshape(-1, CLASS), *_sums(blocks.T.ravel(), p, room), room)


class Room:
    """Arrays that are used again, by name: what is as large as a batch's logits goes back to the system when it is freed, and new pages cost more than the numbers in them.

    An array holds until the next one of its name is asked for.
    """

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def empty(self, name: str, shape: tuple[int, int], dtype: np.dtype) -> np.ndarray:
        size = shape[0] * shape[1]
        flat = self.held.get(name)
        if flat is None or len(flat) < size or flat.dtype != dtype:
            # from a multiple of 64 bytes on: vector instructions on others take two cache lines each
            room = np.empty(size * dtype.itemsize + 64, dtype=np.uint8)
            flat = self.held[name] = room[-room.ctypes.data % 64 :][: size * dtype.itemsize].view(dtype)
        return flat[:size].reshape(shape)

    def take(self, name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The table's rows at numbers within it."""
        # numpy would take into an array of its own first, if it had to look out for other numbers
        return table.take(at, axis=0, out=self.empty(name, (len(at), table.shape[1]), table.dtype), mode="clip")


def _gather(table: np.ndarray, at: np.ndarray, bias: np.ndarray, room: Room) -> np.ndarray:
    """bias and the table's rows for each position's three features, added up."""
    z = room.take("z", table, at[:, 0])
    z += room.take("more", table, at[:, 1])
    z += room.take("more", table, at[:, 2])
    z += bias
    return z


def _exp(z: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) and its rows' sums; where that leaves the range, z loses its rows' largest numbers first."""
    e = room.empty("exp", z.shape, z.dtype)
    with np.errstate(over="ignore"):
        np.exp(z, out=e)
        sums = np.einsum("ij->i", e)
    if not (sums.min() > 1e-30 and sums.max() < 1e30):
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=e)
        sums = np.einsum("ij->i", e)
    return e, sums


def _softmax(z: np.ndarray, room: Room) -> np.ndarray:
    e, sums = _exp(z, room)
    e /= sums[:, None]
    return e


def _log_share(powers: np.ndarray, at: np.ndarray, bias: np.ndarray, column: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Each position's log softmax at one column, from exp(table) and exp(bias), and where that is too small for it. bias is one row for all or a row each."""
    e = room.take("z", powers, at[:, 0])
    e *= room.take("more", powers, at[:, 1])
    e *= room.take("more", powers, at[:, 2])
    each = np.arange(len(e))
    with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
        own = e[each, column] * (bias[column] if bias.ndim == 1 else bias[each, column])
        sums = np.einsum("ij,j->i" if bias.ndim == 1 else "ij,ij->i", e, bias)
        return np.log(own).astype(np.float64) - np.log(sums), np.flatnonzero(~((own > 1e-30) & (sums < 1e30)))


def _log_softmax_at(z: np.ndarray, at: np.ndarray, room: Room) -> np.ndarray:
    """Each row's log softmax at one column."""
    z -= z.max(axis=1, keepdims=True)
    _, sums = _exp(z, room)
    return z[np.arange(len(z)), at].astype(np.float64) - np.log(sums)


def _sums(at: np.ndarray, p: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in at, and the sum of p's rows for each; at may run over p's rows several times."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # radix sort; 3 * ROWS and PAIRS // CLASS numbers fit
    ordered = at[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    n = np.diff(np.append(first, len(at)))
    if len(at) > len(p):
        order %= len(p)
    room.empty("sums", (len(at), p.shape[1]), p.dtype)  # its largest size at once
    sums = room.take("sums", p, order[first])
    # the second of each run, the third and so on; what long runs have beyond is summed one by one
    left = np.flatnonzero(n > 1)
    for k in range(1, 9):
        if not len(left):
            break
        some = room.take("some", sums, left)
        some += room.take("more", p, order[first[left] + k])
        sums[left] = some
        left = left[n[left] > k + 1]
    for i in left.tolist():
        sums[i] += p.take(order[first[i] + 9 : first[i] + n[i]], axis=0).sum(axis=0)
    return ordered[first].astype(np.intp), sums


def _step(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, grad: np.ndarray, room: Room) -> None:
    """AdaGrad on the table's rows that have a gradient; no row may come twice."""
    for a in range(0, len(rows), 512):  # what fits the processor's cache
        r, g = rows[a : a + 512], grad[a : a + 512]
        s = np.multiply(g, g, out=room.empty("step", g.shape, g.dtype))
        s += room.take("more", squares, r)
        squares[r] = s
        s += np.float32(1)
        np.sqrt(s, out=s)
        np.divide(g, s, out=s)
        s *= np.float32(RATE)
        t = room.take("more", table, r)
        t -= s
        table[r] = t


def train(docs: DataFrame, model: Model) -> None:
    """Distributed gradient updates; model gets the averaged weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # HEAD, KNOWN, ROWS and PAIRS bound it: about 18 MB
    piece = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        own.row, own.pair = np.zeros_like(own.row), np.zeros_like(own.pair)
        row_sum, pair_sum, room = np.zeros_like(own.row), np.zeros_like(own.pair), Room()
        ids, f = np.empty(0, dtype=np.int64), np.empty((0, 3), dtype=np.uint32)
        for batch in regroup(batches, 0, PART):
            starts, at, words = split(batch.column(0))
            i, g = own.read_all(starts, at, words)
            ends = len(ids) + starts[1:]
            ids, f = np.concatenate([ids, i]), np.concatenate([f, g])
            begin = 0
            while (k := int(np.searchsorted(ends, begin + BATCH))) < len(ends):
                for a in range(begin, ends[k], BATCH):
                    own.learn(ids[a : min(a + BATCH, ends[k])], f[a : min(a + BATCH, ends[k])], row_sum, pair_sum, room)
                begin = int(ends[k])
            ids, f = ids[begin:], f[begin:]
        if len(ids):
            own.learn(ids, f, row_sum, pair_sum, room)
        task = TaskContext.get().partitionId()
        for name, x in (("row", own.row), ("pair", own.pair)):
            flat = x.ravel().astype(np.float16)
            for a in range(0, len(flat), piece):
                if flat[a : a + piece].any():
                    yield _change(name, a // piece, task % 16, flat[a : a + piece], flat[a : a + piece] != 0)

    schema = "what string, piece int, salt int, delta binary, touched binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            for what, at, _, delta, touched in zip(*(c.to_pylist() for c in batch.columns)):
                d = np.frombuffer(delta, dtype=np.float16 if len(delta) == len(touched) else np.float32).astype(np.float32)
                t = np.frombuffer(touched, dtype=np.uint16).astype(np.uint32)
                if (what, at) in held:
                    held[what, at][0] += d
                    held[what, at][1] += t
                else:
                    held[what, at] = [d.copy(), t.copy()]
        for (what, at), (d, t) in held.items():
            yield _change(what, at, 0, d, np.minimum(t, 65535))

    changes = docs.select("text").mapInArrow(common.tidy(run), schema)
    changes = changes.repartition("what", "piece", "salt").mapInArrow(common.tidy(add), schema).repartition("what", "piece").mapInArrow(common.tidy(add), schema)
    for what, at, _, delta, touched in changes.collect():  # the model's own size
        target = model.row.reshape(-1) if what == "row" else model.pair
        t = np.frombuffer(touched, dtype=np.uint16)
        target[at * piece : at * piece + len(t)] = np.frombuffer(delta, dtype=np.float32) / np.maximum(1, t)
    shared.unpersist()


def _frequent(counts: DataFrame) -> list[tuple[bytes, int, int]]:
    """The KNOWN most frequent (word, n, kind), without the last ones that tie beyond that number.

    A histogram of the counts gives the least count first, so that no task sends more than its share to the driver.
    """
    least, held = None, 0
    for n, words in counts.groupBy("n").agg(F.count(F.lit(1))).orderBy(F.desc("n")).limit(KNOWN).collect():  # KNOWN rows at most
        held += words
        if held > KNOWN:
            break
        least = n
    if least is None:
        return []
    rows = counts.where(F.col("n") >= least).select("word", "n", "kind").collect()  # KNOWN rows at most
    return sorted(((bytes(w), n, k) for w, n, k in rows), key=lambda r: (-r[1], r[0]))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, beyond array<binary>"


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from the rows not held out."""
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    learn_from = docs.where("NOT held_out")
    counts = common.cut(count_words(learn_from), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = Model(_frequent(counts), total, distinct)
    train(learn_from, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    unit = total + distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        known = np.log10(np.concatenate([own.count + 1, [1.0]]))
        for batch in regroup(batches, 2, PART):
            starts, at, words = split(batch.column(2))
            ids, f = own.read_all(starts, at, words)
            far = ids == len(own.count)
            n, n_far = np.diff(starts), np.add.reduceat(far.astype(np.int64), starts[:-1])
            # a rare word's share of its class needs its count, which comes by the join
            scores = np.add.reduceat(own.log_probs(ids, f), starts[:-1]) / math.log(10) - n_far * math.log10(own.mass[own.rare])
            beyond = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_far)]).astype(np.int32)), words.take(pa.array(at[far])).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(n - n_far), pa.array(np.add.reduceat(known[ids], starts[:-1])), pa.array(scores), beyond],
                [x.split()[0] for x in SCORED.split(", ")],
            )

    scored = common.cut(docs.mapInArrow(common.tidy(run), SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    far = scored.select("row", F.explode("beyond").alias("word")).join(counts.select("word", "n"), "word")
    far = far.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count(F.lit(1)).alias("n_far"))
    # partitions of bounded size are joined by hashes and not sorted; Spark decides that when it has seen their sizes
    with common.setting(docs.sparkSession, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m"):
        far = common.cut(far, "far")
    common.drop_cut(counts)
    out = scored.drop("beyond").join(far, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("n_far", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * math.log10(unit)).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
