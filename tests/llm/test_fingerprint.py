"""Fingerprints: order, insertion and deletion, likeness, neighbours and odd rows."""

import hashlib
import random

from pyspark.sql import functions as F

from cellframe.llm import fingerprint


def texts(spark, rows):
    df = spark.createDataFrame(rows, "k string, text string")
    out = fingerprint.vectors(df, ["k"])
    v = out.select("k", F.struct("n", *fingerprint.LANES, *fingerprint.COUNTERS).alias("v"))
    return v, {r.k: r.f for r in v.select("k", fingerprint.printed("v").alias("f")).collect()}


def test_order_insertion_and_deletion(spark):
    v, f = texts(spark, [("ab", "one. two!\nthree"), ("ba", "three\none. two!"), ("a", "one. two!"), ("b", "three"), ("aa", "one. two!\none. two!"), ("e", ""), ("ee", "\n"), ("s", "two. one!")])
    assert f["ab"] == f["ba"] and len({f[k] for k in ("ab", "a", "b", "aa", "e", "ee", "s")}) == 7
    pick = lambda k, n: v.where(F.col("k") == k).select(F.col("v").alias(n))
    both = pick("ab", "ab").crossJoin(pick("a", "a")).crossJoin(pick("b", "b"))
    made = both.select(fingerprint.combine(F.col("a"), F.col("b")).alias("plus"), fingerprint.combine(F.col("ab"), F.col("b"), -1).alias("minus"))
    got = made.select(fingerprint.printed("plus").alias("p"), fingerprint.printed("minus").alias("m")).first()
    assert (got.p, got.m) == (f["ab"], f["a"])


def plain(rows):
    ids = sorted({d for d, _ in rows if d is not None})
    out = []
    for d, t in rows:
        t, nxt = t or "", ""
        if d is not None:
            i = ids.index(d)
            n = ids[i - 1]  # of the smallest: the largest
            nxt = min((x or "")[: max(len(y or "") for e, y in rows if e == d) // 2] for e, x in rows if e == n)
        half = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts_and_odd_rows(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdé😀. \n") for _ in range(rnd.randint(0, 9)))
    rows = [(i * i, " ".join(word() for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    rows += [(-7, "negative"), (None, "no id at all"), (None, None), (9, "again nine"), (16, rows[4][1]), (5000, None), (5001, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long").repartition(4)
    got = fingerprint.fingerprints(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == plain(rows)
    assert all(0 <= r.near_edited <= 1 and (r.near_next is None) == (r.doc_id is None) for r in got)
    assert fingerprint.fingerprints(df.limit(0)).collect() == []
    one = fingerprint.fingerprints(spark.createDataFrame([(4, "alone. text\nhere")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_likeness_follows_what_texts_share(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = fingerprint.fingerprints(docs).toPandas()
    text = {r.doc_id: r.text for r in docs.collect()}
    by = got.groupby("fingerprint").doc_id.apply(list)
    assert all(len({text[i] for i in ids}) == 1 for ids in by) and len(by) == len(set(text.values()))
    assert got.near_edited.mean() > 0.4 and got.near_next.mean() < 0.2
    same = got[got.edited_fingerprint == got.fingerprint]
    assert (same.near_edited == 1).all()
