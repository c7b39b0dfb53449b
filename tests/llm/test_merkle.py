"""Merkle manifests against recursive hashing."""

import hashlib
import random
import zlib

import pytest

from cellframe.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(digests, arity):
    """The last node, and for every leaf its runs: (siblings before, siblings after) level by level."""
    proofs, owner = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, owners = [], []
        for at in range(0, len(digests), arity):
            run = digests[at : at + arity]
            for k in range(len(run)):
                for leaf in owner[at + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(H(*run))
            owners.append([x for o in owner[at : at + arity] for x in o])
        digests, owner = up, owners
    return digests[0], proofs


def brute(rows, arity=16):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    by = {}
    for d, source, lang, n, text in rows:
        changed = text.translate(lower) if text is not None and d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else text
        leaf = [H(*map(field, (d, source, lang, n, t))) for t in (text, changed)]
        by.setdefault(source, []).append((d is not None, d or 0, *leaf, d))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in sources:
        by[s].sort()
        subs.append(climb([x[2] for x in by[s]], arity))
    root, top = climb([x[0] for x in subs], arity)
    out = []
    for s, (sub, proofs), above in zip(sources, subs, top):
        for (_, _, leaf, changed, d), proof in zip(by[s], proofs):
            acc, path = changed, proof + above
            for a, b in path:
                acc = H(a, acc, b)
            out.append((d, leaf, sub, root, H(*[a + b for a, b in path]), acc, acc == root))
    return sorted(out, key=str)


def run(spark, rows, schema=DOCS):
    return sorted((tuple(r) for r in merkle.verified(spark.createDataFrame(rows, schema).repartition(3)).collect()), key=str)


def some_rows(seed, n, sources):
    rnd = random.Random(seed)
    return [
        (rnd.randrange(5000) if rnd.random() < 0.95 else None, rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([None, 5]), rnd.choice([None, "", "Ünïcode AbC", "x" * rnd.randrange(99)]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("n, sources", [(700, ["a", "B", None, "é"]), (17, ["a"]), (40, [f"s{i}" for i in range(25)]), (3, [None, "", "a"])])
def test_equals_recursive_hashing(spark, n, sources):
    rows = some_rows(n, n, sources)
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_a_hot_source(spark):
    rows = [(5, "hot", "en", 1, "Same")] * 300 + some_rows(1, 30, ["hot", "cold"])
    assert run(spark, rows) == brute(rows)


def test_tampering_shows(spark):
    rows = [(i, "s", "en", 3, "ABC" if i % 2 else "abc") for i in range(60)]
    for d, *_, ok in run(spark, rows):
        assert ok == (zlib.crc32(str(d).encode()) % 5 != 0 or d % 2 == 0)


def test_binary_trees_pair_by_xor(spark):
    rows = some_rows(3, 21, ["a", "b"])
    found = merkle.manifest(spark.createDataFrame(rows, DOCS), arity=2).collect()
    want = {(leaf, sub, root) for _, leaf, sub, root, *_ in brute(rows, 2)}
    assert {(r.leaf, r.subroot, r.root) for r in found} == want
    for r in found:
        acc = r.leaf
        for step in r.path:
            acc = H(step.before, acc, step.after)
        assert acc == r.root


def test_very_long_text_empty_table_clashing_columns(spark):
    rows = [(1, "s", None, None, "Z" * 3_000_000), (2, "s", None, None, "")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    wide = [(*r, "x", 9, "y", 1, 2) for r in rows]
    assert run(spark, wide, DOCS + ", leaf string, idx int, digest string, tree int, path int") == brute(rows)
