"""Token-id files: static-range asymmetric numeral system (rANS) blocks with shared frequency tables.

A store is a folder with two Parquet tables that any Spark reader opens:

* ``freq``   (token, freq): one table shared by all blocks, scaled so that the frequencies sum to 2**20;
* ``blocks`` (shard, block, first_token, n_tokens, doc_ids, doc_tokens, payload, crc): runs of whole
  documents of about ``BLOCK`` ids. A block is decoded alone: its payload holds the end states of ``LANES``
  interleaved coders and their common word stream; ``first_token`` is the checkpoint (ids before it in the
  shard), ``crc`` the checksum of the payload.

Shards are ranges of doc_id in ascending order, null first; repeated doc_ids are ordered by their ids.
A null text counts as empty and still gets the end id. A document is never cut: a longer one makes a longer block.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, common

SCALE_BITS = 20
SCALE = 1 << SCALE_BITS
LANES = 2048
BLOCK = 1 << 18
#: Pre-tokens that a worker keeps: some 150 bytes each. Fewer of them, and the rare ones go to the library again and again.
KEPT = 700_000
#: Bytes of text that are cut into pre-tokens at once (a longer text is still whole).
PART = 4 << 20
LOW = np.uint64(1 << 31)
_S, _W, _MASK = np.uint64(SCALE_BITS), np.uint64(32), np.uint64(SCALE - 1)
_TOP = np.uint64(63 - SCALE_BITS)


def scale_counts(counts: np.ndarray) -> np.ndarray:
    """Whole-number frequencies that sum to SCALE, at least 1 for every id that occurs."""
    counts = counts.astype(np.float64)
    used = counts > 0
    if not used.any():
        counts[:1], used[:1] = 1, True
    if used.sum() > SCALE // 2:
        raise ValueError("more ids than the frequency scale can hold")
    freq = np.where(used, np.maximum(1, np.floor(counts / counts.sum() * (SCALE - used.sum()))), 0).astype(np.int64)
    freq[int(np.argmax(freq))] += SCALE - int(freq.sum())
    return freq


class Coder:
    """Encoder and decoder for one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        """Lane j codes ids j, j + LANES, ...; rows go in last-to-first, so that they come out in order."""
        state = np.full(LANES, LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        at_once = ids.astype(np.intp)
        freq, start = self.freq.take(at_once), self.start.take(at_once)
        rest = np.uint64(SCALE) - freq
        for at in range((len(ids) - 1) // LANES * LANES, -1, -LANES):
            f = freq[at : at + LANES]
            x = state[: len(f)]
            full = np.flatnonzero(x >> _TOP >= f)
            out = x.take(full)
            words.append(out.astype(np.uint32))  # the low half
            x[full] = out >> _W
            # the quotient moves up, the rest stays: x + quotient * (SCALE - f) + start
            q = x // f
            q *= rest[at : at + LANES]
            x += q
            x += start[at : at + LANES]
        return state.tobytes() + (np.concatenate(words[::-1]).tobytes() if words else b"")

    def decode(self, payload: bytes, n: int) -> np.ndarray:
        state = np.frombuffer(payload, dtype=np.uint64, count=LANES).copy()
        words = np.frombuffer(payload, dtype=np.uint32, offset=LANES * 8)
        out, used = np.empty(n, dtype=np.uint32), 0
        for at in range(0, n, LANES):
            x = state[: min(LANES, n - at)]
            low = x & _MASK
            # numbers below SCALE, so nothing is clipped; numpy would take into an array of its own first otherwise
            s = self.slot.take(low.view(np.int64), out=out[at : at + len(x)], mode="clip").astype(np.intp)
            x >>= _S
            x *= self.freq.take(s)
            low -= self.start.take(s)
            x += low
            empty = np.flatnonzero(x < LOW)
            x[empty] = (x.take(empty) << _W) | words[used : used + len(empty)]
            used += len(empty)
        if used != len(words) or (state != LOW).any():
            raise ValueError("corrupt block: the coders don't end where they began")
        return out


class _Pieces(dict):
    """Packed ids of pre-tokens. The tokenizers library's model gets each one once; a bounded number is kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokens_of, self.special, self.kind = self.library.model.tokenize, bpe.vocabulary(path).special, id_kind(path)
        self.stand_in = dict(enumerate(bpe.byte_alphabet()))

    def __missing__(self, piece: str) -> bytes:
        if piece in self.special:
            ids = [self.special[piece]]
        else:
            ids = [t.id for t in self.tokens_of(piece.encode().decode("latin-1").translate(self.stand_in))]
        self[piece] = packed = array(self.kind, ids).tobytes()
        return packed


class _Encoder:
    """Packed ids of texts: the pieces of a text are independent of each other in a byte-level BPE."""

    def __init__(self, path: str):
        self.vocab, self.pieces = bpe.vocabulary(path), _Pieces(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > KEPT:
            self.pieces.clear()
        of = self.pieces.__getitem__
        return [b"".join(map(of, self.vocab.pieces(t))) for t in texts]

    def encode_all(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without nulls, the end id after each, and where each text's ids end. Arrow numbers the pre-tokens, so that each distinct one is looked up once."""
        if len(self.pieces) > KEPT:
            self.pieces.clear()
        # take() copies, so that the texts lie side by side from the first byte on
        texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1)
        flat = np.frombuffer(data, dtype=np.uint8)[: bounds[-1]] if bounds[-1] else np.empty(0, dtype=np.uint8)
        begins, odd = bpe.piece_starts(flat, bounds[:-1])
        apart = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        apart[np.searchsorted(bounds, odd, side="right") - 1] = True
        if apart.any():
            return self._with_others(texts, apart, end)
        # an empty piece at each text's end stands for the end id
        ends = np.searchsorted(begins, bounds[1:]) + np.arange(len(texts))
        cuts = np.empty(len(begins) + len(texts) + 1, dtype=np.int64)
        own = np.ones(len(cuts), dtype=bool)
        own[ends], own[-1] = False, False
        cuts[own], cuts[ends], cuts[-1] = begins, bounds[1:], bounds[-1]
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), data]).dictionary_encode()
        kind = self.pieces.kind
        tail = array(kind, [end]).tobytes()
        packed = [self.pieces[p] if p else tail for p in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]
        known = np.frombuffer(b"".join(packed), dtype=kind)
        size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // len(tail)
        start = np.cumsum(size) - size
        at = pieces.indices.to_numpy()
        size = size[at]
        stops = np.cumsum(size)
        ids = known[np.repeat(start[at] - (stops - size), size) + np.arange(stops[-1])]
        return ids, stops[ends]

    def _with_others(self, texts: pa.Array, apart: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """encode_all() where some texts are to be cut one by one."""
        kind = self.pieces.kind
        tail = array(kind, [end]).tobytes()
        out: list[np.ndarray] = [np.empty(0, dtype=kind)] * len(texts)
        rest = np.flatnonzero(~apart)
        if len(rest):
            ids, ends = self.encode_all(texts.take(pa.array(rest)), end)
            for i, part in zip(rest.tolist(), np.split(ids, ends[:-1])):
                out[i] = part
        for i in np.flatnonzero(apart).tolist():
            out[i] = np.frombuffer(self.encode([texts[i].as_py()])[0] + tail, dtype=kind)
        return np.concatenate(out), np.cumsum([len(x) for x in out])


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def id_kind(path: str) -> str:
    """Array type code of ids on their way: 16 bits where the vocabulary fits."""
    return "H" if bpe.vocabulary(path).size <= 1 << 16 else "I"


TOKENS = "doc_id long, ids binary, counts binary"


def tokenize(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """(doc_id, ids, counts): ids of each text and the end id, as id_kind() packs them; for each task one row more, with only the 64-bit counts of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = _encoder(path), np.zeros(1, dtype=np.int64)
        for batch in common.regroup(batches, 1, PART):
            ids, ends = encoder.encode_all(pc.fill_null(batch.column(1), ""), end)
            total = _add(total, np.bincount(ids))
            offsets = np.concatenate([[0], ends]).astype(np.int64) * ids.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed.cast(pa.binary()), pa.nulls(len(ends), pa.binary())], ["doc_id", "ids", "counts"])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], ["doc_id", "ids", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.tidy(run), TOKENS)


def _add(total: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The sum of counts by id, as long as the longer of both."""
    if len(more) > len(total):
        total = np.pad(total, (0, len(more) - len(total)))
    total[: len(more)] += more
    return total


def count_ids(tokens: DataFrame) -> DataFrame:
    """(token, n) over all documents: tokenize() has counted them by task, here they are summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for counts in batch.column(0):
                total = _add(total, np.frombuffer(counts.as_py(), dtype=np.int64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token", "n"])

    counted = tokens.select("counts").where("counts IS NOT NULL")
    return counted.mapInArrow(common.tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


BLOCKS = "shard int, block int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary, crc long"


def write_store(docs: DataFrame, vocab_path: str, path: str, end: int = 0, block: int = BLOCK) -> None:
    """Encode every text and write the store."""
    spark = docs.sparkSession
    raw = f"{path}/raw"
    tokenize(docs, vocab_path, end).write.parquet(raw)  # else the range sampling would tokenize twice
    tokens = spark.read.schema(TOKENS).parquet(raw)
    kind = id_kind(vocab_path)
    rows = count_ids(tokens).collect()  # a row per vocabulary entry at most
    size = max([r["token"] for r in rows], default=0) + 1
    counts = np.zeros(size, dtype=np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    freq = scale_counts(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq.tolist()) if f], "token int, freq int").coalesce(1).write.parquet(f"{path}/freq")
    table = freq.astype(np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, done, number = Coder(np.frombuffer(table, dtype=np.int32).astype(np.int64)), TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held, size = [], [], [], 0
        width = array(kind).itemsize

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype=kind)
            payload = coder.encode(ids)
            cols = [[shard], [number], [done], [len(ids)], [list(doc_ids)], [list(lengths)], [payload], [zlib.crc32(payload)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                lengths.append(len(ids) // width)
                held.append(ids)
                size += lengths[-1]
                if size >= block:
                    yield flush()
                    done, number = done + size, number + 1
                    doc_ids, lengths, held, size = [], [], [], 0
        if doc_ids:
            yield flush()

    ordered = tokens.where("counts IS NULL").select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(common.tidy(run), BLOCKS).write.parquet(f"{path}/blocks")
    common.drop_path(spark, raw)


def read_freq(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/freq").collect()  # a row per vocabulary entry at most
    freq = np.zeros(max(r["token"] for r in rows) + 1, dtype=np.int64)
    for r in rows:
        freq[r["token"]] = r["freq"]
    return freq


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document, decoded block by block."""
    table = read_freq(spark, path).astype(np.int32).tobytes()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    before, ids_so_far = {}, 0
    for shard, total in blocks.groupBy("shard").agg(F.sum("n_tokens")).orderBy("shard").collect():  # a row per writing task
        before[shard], ids_so_far = ids_so_far, ids_so_far + total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(table, dtype=np.int32).astype(np.int64))
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["payload"]) != r["crc"]:
                    raise ValueError(f"checksum of shard {r['shard']}, block {r['block']} differs")
                ids = coder.decode(r["payload"], r["n_tokens"]).astype("<u4")
                lengths = np.array(r["doc_tokens"], dtype=np.int64)
                ends = np.cumsum(lengths)
                starts = before[r["shard"]] + r["first_token"] + ends - lengths
                docs = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(docs, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(common.tidy(run), "doc_id long, start long, n_tokens long, ids binary")


def digest(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Write a store, read it back, and return a digest row per document."""
    spark = docs.sparkSession
    path = common.shared_path(spark, "tokens")
    common.small_batches(spark)
    write_store(docs, vocab_path, path)
    # crc32 takes the bytes as they are: little-endian unsigned 32-bit ids
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
