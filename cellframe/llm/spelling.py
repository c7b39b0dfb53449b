"""Spelling variants by a relational trie frontier.

Words are runs of letters, A-Z lowered, with at least MIN_LENGTH code points and MIN_COUNT occurrences. Two are near if
one inserted, deleted or replaced code point parts them. A word's form is its most frequent near word, if that is at
least twice as frequent; its root is where the chain of forms ends.

The words make a trie whose edges are a distributed table (node, label, to, ends): chains without a branch are one
edge, and ``ends`` is the word that an edge completes. A state (word, pos, node, edits) says that the trie's path to
``node`` spells the word's first ``pos`` code points with so many edits. States without edits lie on the word's own
path; where it branches, an edge may stand for one replaced or follow one deleted code point, which makes a state with
one edit. From then on states join the edge table level by level on node and next code point, and move on where the
label agrees; one that has spelled its word to the end where another word ends is a pair. An insertion is a deletion
seen from the other word, and a replacement is followed in one order only.

Near the trie's root every word would meet every branch. So there are two tries, of the words and of the words
reversed, and a word enters each at its middle: an edit in its second half leaves the first half as it is, which is a
prefix of both words; any other leaves a suffix. A node is a 64-bit hash of its prefix and its trie; every pair found
is compared letter by letter, so a hash shared by chance gives no pair.

Nulls: a null text has no words; a null doc_id counts as an empty one where words are altered (:func:`altered_runs`).
Repeated rows count again. A table without words gives no row. A word of any length is one path, with as many edges as
it has branches; rounds follow the longest chain of branches that an edited word passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.llm.merkle import LOWER, UPPER
from cellframe.llm.pieces import code_points
from cellframe.llm.shards import CRC_TABLE_SQL, crc_sql
from cellframe.llm.text import mix, ragged, span_hashes
from cellframe.session import cut

LETTERS = "[a-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
#: Of the contract: a run is altered where this divides its checksum.
ALTERED = 97
#: Code points whose paths are made in one pass.
PASS = 1 << 20


def runs(docs: DataFrame) -> DataFrame:
    """doc_id and run: every run of letters of every text, A-Z lowered."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(found).alias("run"))


def altered_runs(found: DataFrame) -> DataFrame:
    """word: each run, less one code point where ALTERED divides the CRC-32 of ``<doc_id>:<run>``."""
    hashed = found.select("run", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % ALTERED == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(occurrences: DataFrame) -> DataFrame:
    """word, n and id of every word that is long and frequent enough."""
    counted = occurrences.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)
    return cut(counted.withColumn("id", F.monotonically_increasing_id()))


def paths(words: DataFrame) -> DataFrame:
    """id, pos, node and next (code point, 0 at the end) of every word from its middle on, in both tries.

    The lowest bit of a node tells its trie.
    """

    def of(ids: np.ndarray, lengths: np.ndarray, points: np.ndarray, starts: np.ndarray, enter: np.ndarray, trie: int) -> pa.RecordBatch:
        counts = lengths - enter + 1
        pos, base = ragged(enter, counts), np.repeat(starts, counts)
        node = span_hashes(mix(points.astype(np.uint64) + np.uint64(1)), base, base + pos) & ~np.uint64(1) | np.uint64(trie)
        after = np.where(pos < np.repeat(lengths, counts), points[np.minimum(base + pos, len(points) - 1)], 0)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(pos.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(after.astype(np.int32))], ["id", "pos", "node", "next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, strings = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            lengths = np.fromiter(map(len, strings), np.int64, len(strings))
            ends = np.cumsum(lengths)
            done = 0
            while done < len(ids):
                before = ends[done] - lengths[done]
                upto = max(done + 1, int(np.searchsorted(ends, before + PASS, "right")))
                part, size = slice(done, upto), lengths[done:upto]
                points = code_points("".join(strings[part]))
                starts = ends[part] - size - before
                yield of(ids[part], size, points, starts, size // 2, 0)
                yield of(ids[part], size, points[::-1], len(points) - starts - size, size - size // 2, 1)
                done = upto

    return words.select("id", "word").mapInArrow(run, "id long, pos int, node long, next int")


def branches(words: DataFrame) -> DataFrame:
    """word, n, trie and kept (pos and node in order) of every word: where its path meets those of others or their ends."""
    steps = paths(words)
    forks = steps.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high")).where("low <> high").select("node")
    kept = steps.select("id", "pos", "node").join(forks, "node").groupBy("id", F.col("node").bitwiseAND(F.lit(1)).cast("int").alias("trie"))
    listed = kept.agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("kept")).join(words, "id")
    return listed.select(F.when(F.col("trie") == 1, F.reverse("word")).otherwise(F.col("word")).alias("word"), "n", "trie", "kept")


def _piece(start: Column, length: Column) -> Column:
    """``length`` code points of the word from position ``start`` (from 0) on."""
    return F.substring("word", start + 1, length)


def trie(branched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The states without edits (word, n, trie, pos, node) and the edges (node, label, to, ends)."""
    at = branched.select("word", "n", "trie", "kept", F.posexplode("kept").alias("i", "here")).select(
        "word", "n", "trie", F.col("here.pos").alias("pos"), F.col("here.node").alias("node"), F.get("kept", F.col("i") + 1).alias("then"))
    length = F.length("word")
    upto = F.coalesce(F.col("then.pos"), length)
    ends = F.when(upto == length, F.struct("word", "n"))
    edges = at.select("node", _piece(F.col("pos"), upto - F.col("pos")).alias("label"), F.col("then.node").alias("to"), ends.alias("ends"))
    return at.where(F.col("pos") < length).drop("then"), edges.groupBy("node", "label").agg(F.max("to").alias("to"), F.max("ends").alias("ends"))


def first_edits(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States with one edit: an edge that differs in its first code point, or that goes on after a dropped one."""
    met = states.join(edges, "node")
    first, size, own = F.substring("label", 1, 1), F.length("label"), F.substring("word", F.col("pos") + 1, F.lit(1))
    rest = F.substring("label", 2, 2**31 - 1)
    replaced = (first > own) & (rest == _piece(F.col("pos") + 1, size - 1)) & (F.col("pos") + size <= F.length("word"))
    dropped = (first != own) & (F.col("label") == _piece(F.col("pos") + 1, size)) & (F.col("pos") + 1 + size <= F.length("word"))
    dropped = dropped & ((size > 0) | (F.col("pos") + 1 == F.length("word")))
    moved = met.withColumn("upto", F.explode(F.array_compact(F.array(F.when(replaced, F.col("pos") + size), F.when(dropped, F.col("pos") + 1 + size)))))
    return moved.select("word", "n", "trie", F.col("upto").alias("pos"), F.col("to").alias("node"), "ends")


def advance(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States with one edit, one edge further: a join on node and next code point."""
    ahead = states.withColumn("next", F.substring("word", F.col("pos") + 1, F.lit(1))).drop("ends")
    met = ahead.join(edges.withColumn("next", F.substring("label", 1, 1)), ["node", "next"])
    same = (F.col("label") == _piece(F.col("pos"), F.length("label"))) & (F.length("label") > 0)
    return met.where(same).select("word", "n", "trie", (F.col("pos") + F.length("label")).alias("pos"), F.col("to").alias("node"), "ends")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every pair of near words, in both orders."""
    states, edges = trie(cut(branches(words)))
    edges = cut(edges)
    frontier, found = cut(first_edits(states, edges)), []
    while True:
        there = F.col("pos") == F.length("word")
        found.append(frontier.where(there & F.col("ends").isNotNull()))
        going = frontier.where(~there & F.col("node").isNotNull())
        if going.isEmpty():
            break
        frontier = cut(advance(going, edges))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    turned = lambda c: F.when(F.col("trie") == 1, F.reverse(c)).otherwise(c)
    pairs = pairs.select(turned(F.col("word")).alias("word"), "n", turned(F.col("ends.word")).alias("near"), F.col("ends.n").alias("near_n"))
    pairs = pairs.where(F.levenshtein("word", "near", 1) == 1)
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return pairs.select(both.alias("p")).select("p.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every row (word, form): where the chain of forms ends. Pointers double in every round."""
    known = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row (word, n, id) of a vocabulary."""
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    fits = -F.col("best.less") >= 2 * F.col("n")
    named = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    out = named.join(roots(named.where(F.col("form").isNotNull())), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among the altered words of the documents."""
    return variants(vocabulary(altered_runs(runs(docs))))


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
tokens AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
spelled AS MATERIALIZED (SELECT doc_id, run, count(*) AS times, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM tokens GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, times, {crc_sql("key")} AS h FROM spelled, crc_table),
altered AS (
    SELECT CASE WHEN h % {ALTERED} = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM altered WHERE length(word) >= {MIN_LENGTH} GROUP BY 1 HAVING sum(times) >= {MIN_COUNT}),
cuts AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masks AS MATERIALIZED (SELECT word, n, substring(word, 1, i - 1) || '*' || substring(word, i + 1) AS mask FROM cuts),
shorter AS (SELECT DISTINCT word, n, substring(word, 1, i - 1) || substring(word, i + 1) AS less FROM cuts),
dropped AS MATERIALIZED (SELECT s.word, s.n, w.word AS near, w.n AS near_n FROM shorter s JOIN words w ON w.word = s.less),
near AS MATERIALIZED (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word
    UNION SELECT * FROM dropped UNION SELECT near, near_n, word, n FROM dropped),
best AS MATERIALIZED (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT word, near AS form, near_n AS form_n FROM best WHERE near_n >= 2 * n),
chain AS (SELECT word, form AS root, 1 AS depth FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.root),
ends AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word)
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN ends e USING (word)
"""
