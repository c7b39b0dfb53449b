"""SimHash groups against brute force."""

import random

import numpy as np
import pytest
import xxhash

from cellframe.llm import simhash

DOCS = "doc_id long, text string"


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 3)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > n)


def brute(rows):
    fp = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 4:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted((d if d is not None else -1, f"{fp[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows))


def run(spark, rows, schema=DOCS):
    out = simhash.near_duplicates(spark.createDataFrame(rows, schema)).select("doc_id", simhash.hex16().alias("f"), "component_id").collect()
    return sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in out)


def some_docs(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "ß", "X-1"]
    base = [" ".join(rnd.choices(words, k=rnd.randint(1, 300))) for _ in range(n)]
    rows = [(i * 3, t) for i, t in enumerate(base)]
    for i in range(n):
        t = base[rnd.randrange(8)].split(" ")
        t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((1000 + i, " \n".join(t).upper() if i % 5 else "\t".join(t)))
    return rows + [(5000, None), (5001, ""), (5002, " \x0b "), (5003, " "), (None, base[0]), (0, base[0])]


@pytest.mark.parametrize("slice_rows,group_rows", [(50_000, 200_000), (5, 40)])
def test_groups_match_brute_force(spark, monkeypatch, slice_rows, group_rows):
    monkeypatch.setattr(simhash, "SLICE", slice_rows)
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    rows = some_docs(1)
    assert run(spark, rows) == brute(rows)


def test_every_pair_within_the_radius_is_linked():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).view(np.uint64)
    near = []
    for b in base:
        for k in range(6):
            flips = rng.choice(64, k, replace=False)
            near.append(b ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if k else b)
    nodes = np.unique(np.array(near, np.uint64))
    routes = [(r, s + lo, bits) for r, (s, lo, bits) in enumerate((s, lo, b) for s, _, blocks in simhash.HALVES for lo, b in blocks)]
    found = set()
    for r, at, bits in routes:
        block = nodes >> np.uint64(at) & np.uint64((1 << bits) - 1)
        for v in np.unique(block):
            own = nodes[block == v]
            a, b = simhash.local_forest(np.full(len(own), r), own, np.ones(len(own), bool))
            found |= {(int(x), int(y)) for x, y in zip(a, b)}
    labels = {int(n): int(n) for n in nodes}

    def find(x):
        while labels[x] != x:
            x = labels[x]
        return x

    for a, b in found:
        labels[find(a)] = find(b)
    want = {int(n): int(n) for n in nodes}

    def root(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(int(a) ^ int(b)).count("1") <= 4:
                want[root(int(a))] = root(int(b))
    same = lambda f, a, b: f(int(a)) == f(int(b))
    assert all(same(find, a, b) == same(root, a, b) for a in nodes for b in nodes)


def test_empty_table_and_extra_columns(spark):
    assert run(spark, []) == []
    rows = [(1, "a b c d e", 7, "x"), (2, "a b c d e", 8, "y")]
    assert run(spark, rows, DOCS + ", fp long, component_id string") == brute([r[:2] for r in rows])


def test_long_text():
    text = ("alpha beta gamma delta " * 20_000).encode()
    assert simhash.fingerprint(text) == plain(text.decode())
