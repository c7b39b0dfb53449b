"""Splitting, BPE and files of codes against the public libraries and exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

P = pytest.importorskip("public_tokenizers")
import regex  # noqa: E402
import tiktoken  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from cellframe.llm import bpe, dac, pieces  # noqa: E402

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
SIGNS = "ab 's\n\t'trevmld  1２é漢字 　!?.\U0001f600ÀZ_-\x1c\x85<|endoftext|>"
SOME = ["", " ", "  \n\n x", "it's 'Tis we'll''s", "<|endoftext|>", "a" * 5000, "ab" * 2000, "=" * 999, "１２３ 漢字カナ　", "é" * 700, " \r\n" * 50]


def texts(n=1500):
    rnd = random.Random(7)
    return SOME + ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 70))) for _ in range(n)]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_splits_equal_the_pattern():
    for t in texts():
        want = [m.start() for m in regex.finditer(P.PATTERN, t)]
        assert pieces.split(t).tolist() == want
        assert pieces.split(t, 5).tolist() == want


def test_ids_equal_the_library(tik):
    merges, table = bpe.coder(RANKS)
    rnd = random.Random(2)
    long = ["".join(rnd.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(rnd.randint(20, 800))) for _ in range(80)]
    for t, ids in zip(texts() + long, table.of_texts(texts() + long)):
        assert ids.tolist() == tik.encode_ordinary(t)
        assert table.of_text(t).tolist() == ids.tolist()
        assert merges.decode(ids) == t.encode()


def test_table_of_pieces_starts_anew_when_full(tik):
    merges, _ = bpe.coder(RANKS)
    table = pieces.PieceIds(merges.encode_many, bits=5)
    for t in ["a b c d e f g h", "i j k l m n", "a b q r s t u"]:
        starts = pieces.split(t)
        ids, _ = table.of_spans(t, pieces.code_points(t), starts)
        assert ids.tolist() == tik.encode_ordinary(t)


def test_round_trip_query(spark, tik):
    some = texts(50)
    rows = [(i, t, "x") for i, t in enumerate(some)] + [(900, None, "y"), (None, "a b", "z"), (0, "dup", "z")]
    out = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string"), RANKS).collect()}
    want = set()
    for d, t, _ in rows:
        ids = tik.encode_ordinary(t or "")
        want.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert out == want
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = {(r.doc_id, bytes(r.data)) for r in bpe.decode(bpe.encode(df, RANKS), RANKS).collect()}
    assert back == {(d, (t or "").encode()) for d, t, _ in rows}
    assert bpe.round_trip(df.limit(0), RANKS).collect() == []


def test_very_long_matches_equal_the_library(tik):
    _, table = bpe.coder(RANKS)
    rnd = random.Random(4)
    for t in ("".join(rnd.choices("etaoinshrd", k=5_000_000)), "".join(rnd.choices("漢字仮名交文", k=1_600_000))):
        assert len(t.encode()) > 4_500_000
        # the library takes quadratic time on such a match, so its own long matches are the reference up to a length
        assert table.of_text(t[:60_000]).tolist() == tik.encode_ordinary(t[:60_000])
        ids = table.of_text(t).astype(np.int64)
        assert bpe.coder(RANKS)[0].decode(ids) == t.encode()
        few = bpe.coder(RANKS)[0]
        assert all(few.compatible(a, b) for a, b in set(zip(ids[:-1].tolist(), ids[1:].tolist())))  # so it is the encoding


def test_added_tokens_are_matched_first_as_in_the_library():
    tok, own = Tokenizer.from_file(JSON), dac.library(JSON)
    some = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "a <|endoftext|> b", "<|endoftext", "plain", "", "x" * 300_000 + "<|endoftext|>it's"]
    for t, ids in zip(some, own.of_texts(some), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids
    assert own.added and 50256 in own.added.values()


def test_clashing_columns_of_token_queries(spark, tmp_path):
    rows = [(1, "a b", 5, "x", 2, 3), (2, None, 6, "y", 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash int, ids string, part int, start int")
    plain = df.select("doc_id", "text")
    assert sorted(bpe.round_trip(df, RANKS).collect()) == sorted(bpe.round_trip(plain, RANKS).collect())
    assert sorted(dac.read(spark, dac.write(df, JSON, str(tmp_path / "a"))).collect()) == sorted(dac.read(spark, dac.write(plain, JSON, str(tmp_path / "b"))).collect())


def test_codes_give_any_place():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 5000):
        values = rng.integers(0, 1 << rng.integers(1, 40, n) if n else 2, n).astype(np.uint64)
        codes = dac.Codes(dac.Codes.pack(values))
        assert codes.n == n and (codes.read(np.arange(n)) == values).all()
        assert codes.checksum(n // 3, n - n // 3) == zlib.crc32(values[n // 3 :].astype("<u4").tobytes())
        some = rng.permutation(n)[:17]
        assert (codes.read(some) == values[some]).all()
    with pytest.raises(IndexError):
        codes.read(np.array([5000]))


def test_files_are_in_order_and_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dac, "FILE_IDS", 300)
    tok = Tokenizer.from_file(JSON)
    rows = [(i * 7 % 211, t) for i, t in enumerate(texts(150))] + [(None, "null id"), (5000, None), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = dac.read(spark, dac.write(df, JSON, str(tmp_path / "ids"))).collect()
    start, want = 0, []
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1] or ""))):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert dac.read(spark, dac.write(df.limit(0), JSON, str(tmp_path / "none"))).collect() == []
