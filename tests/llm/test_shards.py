"""Contiguous shards against a plain loop."""

import random
import zlib

import pytest

from cellframe.llm import shards

DOCS = "doc_id long, text string"


def brute(rows, n_shards):
    sized = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows]
    sized.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, before, out, slots = sum(r[1] for r in sized), 0, [], {}
    for d, size, crc in sized:
        shard = (2 * before + size) * n_shards // (2 * total)
        out.append((d, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return sorted(out, key=str)


def run(spark, rows, n_shards, schema=DOCS, more=()):
    df = spark.createDataFrame([(*r, *more) for r in rows], schema).repartition(5)
    return sorted((tuple(r) for r in shards.place(df, n_shards).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_places_equal_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(10_000) if rnd.random() < 0.9 else None, rnd.choice([None, "", "é" * rnd.randrange(40), "word " * rnd.randrange(60)])) for _ in range(400)]
    rows += [(7, "the same row")] * 150 + [(None, None)] * 60
    assert run(spark, rows, 8) == brute(rows, 8)
    assert run(spark, rows, 3) == brute(rows, 3)


def test_sizes_are_near_equal(spark):
    rows = [(i, "x" * (i * 37 % 501)) for i in range(2000)]
    total = {}
    for _, size, _, shard, _ in run(spark, rows, 8):
        total[shard] = total.get(shard, 0) + size
    assert sorted(total) == list(range(8)) and max(total.values()) - min(total.values()) <= 2 * 501


def test_a_very_long_text_fills_its_shard(spark):
    rows = [(i, "a b") for i in range(20)] + [(10, "y" * 3_000_000)]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], 8) == []
    rows = [(3, "c"), (1, "a"), (2, None)]
    schema = DOCS + ", size string, shard string, slot int, _at int, key int, row_no int, text_crc32 int"
    assert run(spark, rows, 2, schema, ("big", "s", 1, 2, 3, 4, 5)) == brute(rows, 2)


def test_digest_names_the_law(spark):
    out = shards.shard(spark.createDataFrame([(1, "a"), (2, "b")], DOCS))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {(r.law, r.grown_shard) for r in out.collect()} == {("bytes", None)}


def test_written_shards_hold_every_row_in_order(spark, tmp_path):
    rows = [(i % 50, f"text {i % 7}", "kept") for i in range(300)] + [(None, None, "kept")] * 20
    docs = spark.createDataFrame(rows, DOCS + ", size string").repartition(4)
    folder = str(tmp_path / "shards")
    shards.write(docs, folder, 4)
    back = spark.read.parquet(folder).collect()
    assert sorted(((r.doc_id, r.text, r.size) for r in back), key=str) == sorted(rows, key=str)
    places = {}
    for r in back:
        places.setdefault(r._shard, []).append((r._slot, r.doc_id))
    assert sorted(places) == [0, 1, 2, 3]
    for found in places.values():
        assert sorted(slot for slot, _ in found) == list(range(len(found)))
    ids = [d for s in sorted(places) for _, d in sorted(places[s], key=lambda p: p[0])]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d)
