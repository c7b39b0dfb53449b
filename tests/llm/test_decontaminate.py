"""Leaks against brute force over all windows."""

import random
import re
from collections import Counter

from cellframe.llm import decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    both = sum(min(a[x], b[x]) for x in a)
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(docs, items):
    out = []
    cut = [(i, WORD.findall((t or "").lower())) for i, t in items if i is not None]
    for d, t in docs:
        words = WORD.findall((t or "").lower())
        own = shingles(words)
        for i, item in cut:
            want = shingles(item)
            if not own or not want or not set(own) & set(want):
                continue
            starts = range(max(1, len(words) - len(item) + 1))
            best = max((jaccard(own[s : s + len(want)], want), -s) for s in starts)
            if best[0] >= 0.8:
                out.append((d, i, -best[1], round(best[0], 9)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_words long, item_id string").repartition(3)
    out = decontaminate.leaks(d, spark.createDataFrame(items, "item_id long, text string"))
    return sorted(((r.doc_id, r.item_id, r.start, round(r.similarity, 9)) for r in out.collect()), key=str)


def some(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "the", "a"] * 8
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(6, 70)))) for i in range(25)]
    items += [(100, items[0][1]), (101, None), (102, ""), (None, items[1][1]), (103, "one two three"), (104, "x " * 30)]
    docs = []
    for i in range(120):
        text = rnd.choices(vocabulary, k=rnd.randint(0, 120))
        for _ in range(rnd.randint(0, 2)):
            passage = rnd.choice(items)[1]
            passage = (passage or "").split(" ")
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(passage))
                passage[at : at + rnd.randint(0, 1)] = rnd.choices(vocabulary, k=rnd.randint(0, 2))
                passage = passage or ["x"]
            at = rnd.randint(0, len(text))
            text[at:at] = passage
        docs.append((i, rnd.choice([" ", "\n"]).join(text).upper() if i % 3 else "  ".join(text)))
    docs += [(900, None), (901, ""), (902, "one two three"), (None, items[2][1]), (903, items[3][1]), (903, items[3][1]), (904, "x " * 100), (905, items[5][1][: len(items[5][1]) * 9 // 10])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = some(11)
    want = brute(docs, items)
    assert len(want) > 40
    assert run(spark, docs, items) == want


def test_without_broadcast_and_clean(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = some(12)
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(docs)], "doc_id long, text string, h long")
    bad = {t for (d, t) in docs if any(w[0] == d for w in want if d is not None)} | {items[2][1]}
    kept = {r.h for r in decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {i for i, (_, t) in enumerate(docs) if t not in bad}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.leaks(docs.limit(0), items).collect() == []
    assert decontaminate.leaks(docs, items.limit(0)).collect() == []
    assert len(decontaminate.leaks(docs, items).collect()) == 1
