"""Elias-Fano sequences, the trie and the scores against plain counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cellframe.llm import eliasfano, lm, packs


@pytest.mark.parametrize("top", [5, 300, 2**40, 2**63])
@pytest.mark.parametrize("n", [0, 1, 2, 64, 1000])
def test_sequence(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
    if n == 1000 and top == 2**40:
        values = np.unique(np.concatenate([values, np.arange(7 << 30, (7 << 30) + 500, dtype=np.uint64)]))  # a crowded place
    ef = eliasfano.EliasFano(eliasfano.EliasFano.arrays(values))
    assert (ef.get(np.arange(len(values))) == values).all()
    asked = np.unique(np.concatenate([values, values + np.uint64(1), rng.integers(0, top, 50, dtype=np.uint64), np.array([0, top], np.uint64)]))
    assert (ef.successor(asked) == np.searchsorted(values, asked)).all()
    known = set(values.tolist())
    assert [i >= 0 for i in ef.find(asked)] == [x in known for x in asked.tolist()]


def test_trie(tmp_path):
    rnd = random.Random(1)
    grams = Counter((rnd.choice([3, 9, 2**63 + 5, 77]) if rnd.random() < 0.8 else rnd.randrange(2**64), rnd.randrange(2**40) if rnd.random() < 0.5 else rnd.randrange(6)) for _ in range(3000))
    keys = sorted(grams)
    contexts = sorted({c for c, _ in keys})
    sizes = np.array([sum(1 for c, _ in keys if c == x) for x in contexts])
    path = str(tmp_path / "trie")
    eliasfano.Trie.build(np.array(contexts, np.uint64), sizes, np.array([s for _, s in keys], np.uint64), np.array([grams[k] for k in keys]), path)
    trie = eliasfano.Trie.open(path)
    asked = keys + [(c, s + 1) for c, s in keys[:200] if s + 1 < 2**40] + [(12345, 1)]
    got = trie.counts(np.array([c for c, _ in asked], np.uint64), np.ones(len(asked), np.int64), np.array([s for _, s in asked], np.uint64))
    assert got.tolist() == [grams.get(k, 0) for k in asked]


def test_counts_are_quantised_finely():
    n = np.array([0, 1, 17, 4096, 5000, 10**6, 10**9])
    assert np.allclose(eliasfano.restore(eliasfano.quantise(n)), n, rtol=3e-4)


def plain(rows):
    cut = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None] for _, t in rows]
    one, two = Counter(), Counter()
    for (d, _), w in zip(rows, cut):
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            one.update(w)
            two.update(zip([""] + w[:-1], w))
    n, v = sum(one.values()), len(one)
    out = []
    for (d, _), w in zip(rows, cut):
        base = score = 0.0
        for a, b in zip([""] + w[:-1], w):
            p = (one[b] + 0.1) / (n + 0.1 * (v + 1))
            before = one[None] if a == "" else one[a]
            base += math.log10(p)
            score += math.log10((two[a, b] + lm.WEIGHT * p) / (before + lm.WEIGHT))
        out.append((d, None if d is None else zlib.crc32(str(d).encode()) % 10 == 0, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("pack_bytes,shard_bytes,hot", [(4 << 20, 4 << 20, 1 / 20000), (600, 300, 1 / 50)])
def test_scores_equal_plain_counts(spark, monkeypatch, pack_bytes, shard_bytes, hot):
    monkeypatch.setattr(packs, "PACK_BYTES", pack_bytes)
    monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lm, "HOT_SHARE", hot)
    rnd = random.Random(6)
    rows = [(i, rnd.choice([" ", "\n"]).join(rnd.choice(["The", "the", "É", "é", "cat"] + [f"w{rnd.randrange(60)}"] * 4) for _ in range(rnd.randint(0, 60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "the cat"), (7, rows[7][1]), (502, "the " * 3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, pack long, score string").repartition(3)
    same(lm.scores(df).collect(), plain(rows))


def test_model_beats_the_base_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = lm.scores(docs).collect()
    same(got, plain([tuple(r) for r in docs.collect()]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_table(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
