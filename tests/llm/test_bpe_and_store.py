import collections
import hashlib
import random
import re
import timeit
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")

from skein.llm import bpe, common, token_store  # noqa: E402
from skein.llm.queries import vocab_path  # noqa: E402

ODD = ["", " ", "aaa aaaa aaaaaaa", "a<|endoftext|>b  <|endoftext|>", "x² ½ y\x1c\x1d  z", "日本語 テスト 🙂🙂", "\n\n  \n a", "ﬁ'll don't 'S", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocab_path())


def test_ids_and_text_as_the_library_has_them(library):
    r = random.Random(1)
    texts = ODD + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 0x600), r.randrange(0xE000, 0x20000)])) for _ in range(25)) for _ in range(300)]
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert bpe.encode_texts(texts, vocab_path()) == ids
    assert [bpe.decode_ids(i, vocab_path()) for i in ids] == library.decode_batch(ids, skip_special_tokens=False)


def test_digest(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "x"), (1, " ")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens int")
    got = bpe.digest(df, vocab_path()).collect()
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.digest(df.limit(0), vocab_path()).count() == 0


def test_columns_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in ODD] + [(None,)], "text string")
    back = bpe.decode(bpe.encode(df, vocab_path()), vocab_path(), into="back").collect()
    assert all(r["back"] == (r["text"] or "") for r in back)


def test_store_round_trip(spark, library, tmp_path):
    rows = [(9, "later"), (3, None), (5, ""), *[(20 + i, "some text " * i) for i in range(60)], (4, ODD[5])]
    path = f"file://{tmp_path}/store"
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocab_path(), path, block=200)
    got = {r["doc_id"]: r for r in token_store.read_store(spark, path).collect()}
    start = 0
    for k, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[k]["start"], got[k]["n_tokens"]) == (start, len(ids))
        assert zlib.crc32(bytes(got[k]["ids"])) == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_store_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/empty"
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), vocab_path(), path)
    assert token_store.read_store(spark, path).count() == 0


def test_tokenize_counts_ids_itself(spark, library):
    """Each text is one row, null doc_ids too; what tokenize() counts on the way is what the rows hold."""
    rows = [(i, t) for i, t in enumerate(ODD * 3)] + [(None, None), (None, "x")]
    tokens = token_store.tokenize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocab_path(), 7).cache()
    packed = [bytes(r["ids"]) for r in tokens.where("counts IS NULL").collect()]
    want = np.bincount(np.frombuffer(b"".join(packed), dtype=token_store.id_kind(vocab_path())))
    counted = {r["token"]: r["n"] for r in token_store.count_ids(tokens).collect()}
    tokens.unpersist()
    assert len(packed) == len(rows) and counted == {i: n for i, n in enumerate(want.tolist()) if n}
    assert counted == dict(collections.Counter(i for _, t in rows for i in [*library.encode(t or "", add_special_tokens=False).ids, 7]))


def test_store_keeps_rare_pieces():
    """A worker doesn't clear its pieces at 400,000 of them, so that none goes to the library twice."""
    encoder, calls = token_store._Encoder(vocab_path()), []
    encoder.pieces.update((f"#{i}", b"") for i in range(400_000))
    tokens_of = encoder.pieces.tokens_of
    encoder.pieces.tokens_of = lambda piece: calls.append(piece) or tokens_of(piece)
    assert encoder.encode(["rarely"]) == encoder.encode(["rarely"])
    assert len(encoder.pieces) > 400_000 and len(calls) == 1


@pytest.mark.parametrize("n", [0, 1, 5, 2048, 2049, 9000])
def test_coder(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.01, n), 4999)
    coder = token_store.Coder(token_store.scale_counts(np.bincount(ids, minlength=5000)))
    payload = coder.encode(ids)
    assert (coder.decode(payload, n) == ids).all()
    if n > 100:
        with pytest.raises((ValueError, IndexError)):
            coder.decode(payload[:-8] + b"\1\2\3\4\5\6\7\7", n)


def test_shared_folder_is_the_session_s(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_store_ignores_extra_columns(spark):
    rows = [(3, "some words", 1), (1, None, 2), (3, "other words here", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").selectExpr("*", "1 AS start", "text AS payload", "2 AS shard")
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in token_store.digest(docs, vocab_path()).collect())
    assert [g[0] for g in got] == [1, 3, 3] and got[0][1:] == (0, 1) and got[1][1] == 1 and got[2][1] == got[1][1] + got[1][2]


def test_pieces_of_plain_texts():
    """Ranges of letters against character categories: every plain character alone and beside others, and random texts; and they are quicker."""
    general = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    plain = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x1F700))) if bpe._PLAIN.fullmatch(c)]
    assert len(plain) > 30_000
    for c in plain:
        for t in (c, f"a{c}", f"1{c}1", f" {c}{c}", f"'{c}", f"_{c} "):
            assert bpe._PIECE.findall(t) == general.findall(t)
    r = random.Random(8)
    some = [*"''''strevmld  \n\t__019.,!-ABé\x85\xa0 "]
    for _ in range(3000):
        t = "".join(r.choices(some + r.choices(plain, k=10), k=60))
        assert bpe._PIECE.findall(t) == general.findall(t)
    words = " ".join("".join(r.choices("etaoinshr", k=r.randrange(2, 12))) for _ in range(40_000))
    spent = {p: min(timeit.repeat(lambda: p.findall(words), number=1, repeat=9)) for p in (bpe._PIECE, general)}
    assert len(spent) == 2 and spent[bpe._PIECE] < 0.9 * spent[general]


def test_pieces_of_many_texts():
    """The bytes that pre-tokens begin at against the pattern, for texts side by side; texts with odd characters are told."""
    r = random.Random(9)
    plain = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x1F700))) if bpe._PLAIN.fullmatch(c) and (c.isascii() or not c.isspace())]
    some = [*"strevmld    \n\n\t\x0b\x0c019.,!-ABé"]
    texts = ["", "'s", "'", "s", "'re", "'r", "e", "a'", "ll", " 's", "  's", "\n's", "\n", " ", "a  ", "\n", " b", "'s'll''d", "x'vex", "it's  \n\n we've", "日本 é🙂'm", *plain]
    texts += ["".join(r.choices(some + r.choices(plain, k=8), k=r.randrange(40))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    begins, odd = bpe.piece_starts(data, starts[:-1])
    want = [p for t in texts for p in bpe._PIECE.findall(t)]
    assert [data[a:b].tobytes().decode() for a, b in zip(begins, [*begins[1:], len(data)])] == want and not len(odd)
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000), 0x10FFFF)):
        if not bpe._PLAIN.fullmatch(c) or c.isspace() and not c.isascii():
            assert bpe.piece_starts(np.frombuffer(f"a{c}".encode(), dtype=np.uint8), np.array([0]))[1][0] == 1
    assert [len(x) for x in bpe.piece_starts(data[:0], np.zeros(3, dtype=np.int64))] == [0, 0]


def test_texts_are_encoded_together(library):
    """Many texts at once have the library's ids, in order, whatever they hold; and known words cost less than one by one."""
    r = random.Random(10)
    texts = ODD + ["", "\xa0x", "'s", "it's"] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 0x600), r.randrange(0xE000, 0x20000)])) for _ in range(25)) for _ in range(200)]
    for part in (texts, ["", ""], ["<|endoftext|>"], texts[4:5], ["plain", "", "words\n"]):
        column = pa.array(["cut off", *part]).slice(1)
        ids, ends = token_store._Encoder(vocab_path()).encode_all(column, 7)
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [[*library.encode(t, add_special_tokens=False).ids, 7] for t in part]
        assert ids.dtype == token_store.id_kind(vocab_path())
    words = ["".join(r.choices("etaoinshr", k=r.randrange(2, 12))) for _ in range(5000)]
    texts = [" ".join(r.choices(words, k=400)) for _ in range(400)]
    encoder, column = token_store._Encoder(vocab_path()), pa.array(texts)
    assert encoder.encode_all(column, 0)[0].tobytes() == b"".join(x + b"\0\0" for x in encoder.encode(texts))
    one, all_ = (min(timeit.repeat(f, number=1, repeat=7)) for f in (lambda: encoder.encode(texts), lambda: encoder.encode_all(column, 0)))
    assert all_ < 0.8 * one


def test_coder_writes_the_same_bytes_for_less():
    """Against the plain steps of the coder, whose payloads it has to write and read."""
    ids = np.minimum(np.random.default_rng(3).zipf(1.2, 100_000), 50_000).astype(np.uint16)
    coder = token_store.Coder(token_store.scale_counts(np.bincount(ids)))

    def plain():
        state, words = np.full(token_store.LANES, 1 << 31, dtype=np.uint64), []
        limit = coder.freq << np.uint64(43)
        freq, start, limit = coder.freq[ids], coder.start[ids], limit[ids]
        for at in range((len(ids) - 1) // token_store.LANES * token_store.LANES, -1, -token_store.LANES):
            f, c, top = (x[at : at + token_store.LANES] for x in (freq, start, limit))
            x = state[: len(f)]
            full = x >= top
            words.append(x[full].astype(np.uint32))
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: len(f)] = (q << np.uint64(20)) + (x - q * f) + c
        return state.tobytes() + np.concatenate(words[::-1]).tobytes()

    payload = coder.encode(ids)
    assert payload == plain() and (coder.decode(payload, len(ids)) == ids).all()
    one, other = (min(timeit.repeat(f, number=1, repeat=15)) for f in (plain, lambda: coder.encode(ids)))
    assert other < 0.85 * one
