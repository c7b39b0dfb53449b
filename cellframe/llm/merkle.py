"""Merkle manifest of a table of documents by sibling-shift self-joins.

A leaf is the SHA-256 of a row's fields. The leaves of a source, in the order of doc_id, are the first level of its
tree; every ARITY consecutive nodes of a level make one of the next, until one is left, the subroot. The subroots in
the order of their sources (null first) are the leaves of the top tree, which ends in the root.

Every level is an equijoin: a node offers its digest to the computed indices of its siblings (XOR 1 in a binary tree,
else its slot plus 1 to ARITY - 1, modulo ARITY, within its run), and meets there what it needs for its own proof. The
rows of slot zero then hold a whole run and emit the parent. All trees of a level are joined together, at most ARITY
rows to a run, so a source with most of the rows loads no task more than others. Proofs run top down: the siblings
above a node are those of its parent and are joined once a run.

Digests enter hashes as lower-case hex; between joins they are 32 bytes. A field is ``-`` if null, else its UTF-8 byte count, a colon and
the value. Leaves of equal doc_id follow in the order of their digests, null ids first; repeated rows are leaves of
their own. An empty table gives no row. Texts of any length are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.llm.order import positions
from cellframe.llm.shards import CRC_TABLE_SQL, crc_sql
from cellframe.session import cut

ARITY = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:binary,after:binary>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    """The leaf of a row of documents with the given text, as bytes."""
    return F.unhex(F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, idx, digest and more) with before and after: the siblings' digests to either side, joined."""
    slot, first = F.col("idx") % arity, F.col("idx") - F.col("idx") % arity
    if arity == 2:
        shifted = nodes.select("tree", F.col("idx").bitwiseXOR(F.lit(1)).alias("idx"), slot.alias("slot"), "digest")
    else:
        shifts = F.explode(F.sequence(F.lit(1), F.lit(arity - 1))).alias("shift")
        offers = nodes.select("tree", slot.alias("slot"), first.alias("first"), "digest", shifts)
        shifted = offers.select("tree", (F.col("first") + (F.col("slot") + F.col("shift")) % arity).alias("idx"), "slot", "digest")
    met = shifted.groupBy("tree", "idx").agg(F.array_sort(F.collect_list(F.struct("slot", "digest"))).alias("_met"))
    nothing = F.lit(b"")
    side = lambda keep: F.coalesce(F.aggregate(F.filter("_met", keep), nothing, lambda acc, m: F.concat(acc, m["digest"])), nothing)
    found = nodes.join(met, ["tree", "idx"], "left").withColumn("_slot", slot)
    return found.select(
        *nodes.columns, side(lambda m: m["slot"] < F.col("_slot")).alias("before"), side(lambda m: m["slot"] > F.col("_slot")).alias("after"))


def levels(leaves: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels of trees from their leaves (tree, idx, digest, n: the leaves of the tree).

    Gives for each level the nodes that have a parent, with their siblings, and the nodes that are all that remains.
    """
    steps, ends, nodes = [], [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        ends.append(nodes.where("n = 1"))
        if most <= 1:
            return steps, ends
        steps.append(cut(with_siblings(nodes.where("n > 1"), arity)))
        nodes = steps[-1].where(F.col("idx") % arity == 0).select(
            "tree", F.expr(f"idx div {arity}").alias("idx"), F.unhex(F.sha2(hexed(F.concat("digest", "after")), 256)).alias("digest"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"))
        most = -(-most // arity)


def with_paths(steps: list[DataFrame], ends: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The first level with its whole path: an array of before and after, from the node's siblings up.

    ``above`` has, for every tree, the path that goes on from its last node; its other columns come along. The steps
    above a run are joined once a run and level.
    """
    carried = [c for c in above.columns if c != "tree"]
    known = ends[-1].join(above, "tree")
    for step, end in zip(reversed(steps), reversed(ends[:-1])):
        up = known.select("tree", F.col("idx").alias("_up"), *carried)
        own = step.withColumn("_up", F.expr(f"idx div {arity}")).join(up, ["tree", "_up"])
        own = own.withColumn("path", F.concat(F.array(F.struct("before", "after")), "path"))
        known = own.select(*end.columns, *carried).union(end.join(above, "tree").select(*end.columns, *carried))
    return known


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings along ``path`` give."""
    return F.aggregate(path, digest, lambda acc, step: F.sha2(F.concat(step["before"], acc, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings along a path, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def manifest(docs: DataFrame, altered: Column | None = None, arity: int = ARITY) -> DataFrame:
    """doc_id, source, leaf, subroot, root and path (the siblings before and after, level by level) of every row.

    With ``altered``, a text in terms of the columns of documents, also altered_leaf: the leaf it would give.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text")
    more = [] if altered is None else [hexed(leaf_digest(altered)).alias("altered_leaf")]
    rows = docs.select(
        "doc_id", F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("name"), leaf_digest(F.col("text")).alias("digest"), *more)
    placed = positions(rows, ["known", "name", "doc_id", "digest"], by=["known", "name"])
    leaves = placed.select(
        "doc_id", F.when(F.col("known"), F.col("name")).alias("source"), *(["altered_leaf"] if more else []),
        F.col("group_first").alias("tree"), F.col("row_no").alias("idx"), "digest", F.col("group_rows").alias("n"))
    steps, ends = levels(cut(leaves), arity)

    subroots = ends[0].select("tree", "digest")
    for end in ends[1:]:
        subroots = subroots.union(end.select("tree", "digest"))
    ranked = positions(subroots.withColumnRenamed("tree", "source_tree"), ["source_tree"])
    top = ranked.select(F.lit(0).cast("long").alias("tree"), F.col("row_no").alias("idx"), "digest", F.col("group_rows").alias("n"), "source_tree")
    top_steps, top_ends = levels(cut(top), arity)
    root = top_ends[-1].select("digest").first()
    whole = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), F.array().cast(PATH).alias("path"), F.lit(root and root[0].hex()).cast("string").alias("root"))
    upper = with_paths(top_steps, top_ends, whole, arity)
    above = cut(upper.select(F.col("source_tree").alias("tree"), "path", "root", hexed(F.col("digest")).alias("subroot")))
    path = F.transform("path", lambda step: F.struct(hexed(step["before"]).alias("before"), hexed(step["after"]).alias("after")))
    return with_paths(steps, ends, above, arity).select("doc_id", "source", *(["altered_leaf"] if more else []), hexed(F.col("digest")).alias("leaf"), "subroot", "root", path.alias("path"))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest checked against texts of which some were altered: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 5 divides the CRC-32 of the decimal doc_id, the text's A-Z are lowered (a null doc_id is never altered).
    """
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = manifest(docs, tampered).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.col("altered_leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
ids AS (SELECT *, CASE WHEN doc_id IS NULL THEN false ELSE {crc_sql("doc_id::VARCHAR")} % 5 = 0 END AS hit FROM documents, crc_table),
fields AS (
    SELECT doc_id, source,
        list_reduce(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda x : CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), lambda a, b : a || b) AS head,
        text, CASE WHEN hit THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS changed FROM ids),
leaves AS (
    SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(changed) || ':' || changed END) AS changed FROM fields),
placed AS MATERIALIZED (
    SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
nodes AS (
    SELECT tree, 0 AS level, idx, n, leaf AS digest FROM placed
    UNION ALL SELECT tree, any_value(level) + 1, idx // {ARITY}, any_value((n + {ARITY - 1}) // {ARITY}), sha256(string_agg(digest, '' ORDER BY idx))
    FROM nodes WHERE n > 1 GROUP BY tree, idx // {ARITY}),
subroots AS MATERIALIZED (SELECT tree, digest AS subroot FROM nodes WHERE n = 1),
top AS (
    SELECT 0 AS level, tree AS idx, count(*) OVER () AS n, subroot AS digest FROM subroots
    UNION ALL SELECT any_value(level) + 1, idx // {ARITY}, any_value((n + {ARITY - 1}) // {ARITY}), sha256(string_agg(digest, '' ORDER BY idx))
    FROM top WHERE n > 1 GROUP BY idx // {ARITY}),
runs AS MATERIALIZED (
    SELECT tree, level, idx // {ARITY} AS run, list(digest ORDER BY idx) AS digests FROM nodes WHERE n > 1 GROUP BY ALL
    UNION ALL SELECT -1, level, idx // {ARITY}, list(digest ORDER BY idx) FROM top WHERE n > 1 GROUP BY ALL),
walk AS (
    SELECT id, tree AS source_tree, tree, 0 AS level, idx, n, changed AS acc, '' AS proof FROM placed
    UNION ALL
    SELECT id, source_tree, CASE WHEN w.n = 1 THEN -1 ELSE w.tree END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END,
        CASE WHEN w.n = 1 THEN source_tree ELSE w.idx // {ARITY} END, CASE WHEN w.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (w.n + {ARITY - 1}) // {ARITY} END,
        CASE WHEN w.n = 1 THEN acc ELSE sha256(array_to_string(digests[:w.idx % {ARITY}], '') || acc || array_to_string(digests[w.idx % {ARITY} + 2:], '')) END,
        CASE WHEN w.n = 1 THEN proof ELSE proof || array_to_string(digests[:w.idx % {ARITY}], '') || array_to_string(digests[w.idx % {ARITY} + 2:], '') END
    FROM walk w LEFT JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.run = w.idx // {ARITY} WHERE w.tree >= 0 OR w.n > 1),
ended AS (SELECT * FROM walk WHERE tree = -1 AND n = 1)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = digest AS verified
FROM placed p JOIN ended e USING (id) JOIN subroots s ON s.tree = p.tree JOIN top t ON t.n = 1
"""
