"""Substring deduplication against brute force."""

import random
import re

import numpy as np
import pytest

from cellframe.llm import fmindex, packs, substring

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows):
    owners = {}
    cut = [[w for w in WORD.findall((t or "").encode())] for _, t in rows]
    for (d, _), w in zip(rows, cut):
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                owners[k] = min(owners.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, cut):
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and owners[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def some_docs(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É,", "ß", "x. y"]
    passages = [" ".join(rnd.choices(vocabulary, k=rnd.randint(8, 60))) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.4 else "\n ".join(rnd.choices(vocabulary, k=rnd.randint(1, 40))))
        rows.append((rnd.randint(0, 400), rnd.choice([" ", "\t", "\r\n"]).join(parts)))
    rows += [(500, "a " * 900), (501, "b c " + "a " * 50), (502, "a " * 12), (503, None), (504, ""), (None, rows[0][1]), (None, None), (-5, passages[0]), (-5, passages[0])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("pack_bytes,shard_bytes,hot", [(4 << 20, 4 << 20, 1 / 20000), (900, 700, 1 / 300)])
def test_matches_brute_force(spark, monkeypatch, pack_bytes, shard_bytes, hot):
    monkeypatch.setattr(packs, "PACK_BYTES", pack_bytes)
    monkeypatch.setattr(substring, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(substring, "HOT_SHARE", hot)
    rows = some_docs(4)
    df = spark.createDataFrame([(d, t, i, "p") for i, (d, t) in enumerate(rows)], "doc_id long, text string, shard long, pack string").repartition(3)
    got = sorted(((r.shard, r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.dedup(df).collect()))
    assert got == [(i, *r) for i, r in enumerate(brute(rows))]


def test_tables_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted(tuple(r) for r in substring.dedup(docs).select("doc_id", "n_words", "n_removed", "text").collect())
    want = sorted(brute([tuple(r) for r in docs.collect()]))
    assert got == want and sum(r[2] for r in got) > 0


def test_empty_table(spark):
    assert substring.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_index_finds_every_interval():
    rng = np.random.default_rng(3)
    counts = rng.integers(13, 40, 60)
    words = rng.integers(0, 3, int(counts.sum())).astype(np.uint64)
    index = fmindex.FMIndex(words, counts)
    text = index.text.tolist()
    ends = np.concatenate([np.arange(s + 5, s + c) for s, c in zip(index.starts, counts)])
    matched, low, high = index.search(ends, 6)
    for e, m, a, b in zip(ends.tolist(), matched.tolist(), low.tolist(), high.tolist()):
        if m == 6:
            p = text[e - 5 : e + 1]
            assert sorted(index.order[a:b].tolist()) == [i for i in range(len(text)) if text[i : i + 6] == p]
        else:
            p = text[e - m : e + 1]
            assert sum(text[i : i + m + 1] == p for i in range(len(text))) == 1
