"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from cellframe.llm import spelling

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    out, forms = [], {}
    for w in n:
        others = [v for v in n if v != w and abs(len(v) - len(w)) <= 1 and near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out.append((w, len(others)))
    rows = []
    for w, count in out:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n[w], count, n[forms[w]] if forms[w] is not None else None))
    return sorted(rows)


def brute(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return brute_variants({w: c for w, c in n.items() if c >= 3 and len(w) >= 5})


def run(spark, rows, schema=DOCS):
    return sorted(tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(rows, schema).repartition(4)).collect())


def dense_words(seed, n, letters, longest):
    rnd = random.Random(seed)
    return {"".join(rnd.choice(letters) for _ in range(rnd.randint(5, longest))): rnd.randint(3, 60) for _ in range(n)}


@pytest.mark.parametrize("seed, letters, longest", [(1, "ab", 9), (2, "aéb", 7), (3, "abcde", 6)])
def test_dense_vocabularies_equal_brute_force(spark, seed, letters, longest):
    n = dense_words(seed, 500, letters, longest)
    words = spark.createDataFrame([(w, c, i) for i, (w, c) in enumerate(sorted(n.items()))], "word string, n long, id long").repartition(3)
    assert sorted(tuple(r) for r in spelling.variants(words).collect()) == brute_variants(n)


def test_documents_equal_brute_force(spark):
    rnd = random.Random(5)
    base = ["mountain", "Éclair", "straße", "window", "windows", "aaaaa", "aaaaaa", "aaaaaaa", "letter", "×÷×÷×", "ÿÿÿÿÿÿ"]
    rows = []
    for i in range(1500):
        words = [rnd.choice(base) for _ in range(8)]
        if rnd.random() < 0.5:
            k = rnd.randrange(8)
            words[k] = words[k][:3] + rnd.choice("xyz") + words[k][rnd.choice([3, 4]) :]
        rows.append((rnd.randrange(4000), rnd.choice([" ", "-", "1", "\n"]).join(words).upper() if rnd.random() < 0.2 else " ".join(words)))
    rows += [(None, "window mountain letter"), (3, None), (None, None), (4, "")] + [(9, "mountain  mountein")] * 4
    found = run(spark, rows)
    assert found == brute(rows) and any(r[1] for r in found)


def test_chains_end_at_their_last_form(spark):
    n = {"abcde": 3, "abcdef": 7, "abcdefg": 15, "abcdefgh": 40, "zzzzz": 3, "zzzzy": 6, "zzzzx": 6}
    words = spark.createDataFrame([(w, c, i) for i, (w, c) in enumerate(n.items())], "word string, n long, id long")
    found = {r.word: r for r in spelling.variants(words).collect()}
    assert found["abcde"].root == "abcdefgh" and found["abcde"].form == "abcdef" and found["zzzzz"].form == "zzzzx"


def test_very_long_words_and_frequent_ones(spark):
    long = "ab" * 10_000 + "c" * 10_000
    rows = [(i, f"{long} {long[:9000]}x{long[9000:]} {long[:-1]} common commonn") for i in range(5)] + [(1, "common " * 50_000)]
    assert run(spark, rows) == brute(rows)


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, []) == [] and run(spark, [(1, "a b c"), (None, None)]) == []
    rows = [(i, "window windows") for i in range(9)]
    assert run(spark, [(*r, 1, 2, "z", 3, 4) for r in rows], DOCS + ", word int, node int, n string, id int, run int") == brute(rows)
