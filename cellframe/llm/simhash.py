"""Near-duplicate groups by SimHash and multi-index hashing.

A text's A-Z are lowered; its words (``[^\\x20\\x09-\\x0D]+``) give 4-word shingles, repeats included. A bit of the
fingerprint is set if it is set in over half of the shingles' XXH64 hashes. Fingerprints link where at most four
bits differ; a group is what links reach.

Multi-index hashing: with at most four differing bits, the high half of the fingerprint differs in at most two or the
low half in at most one. A half with at most r differing bits agrees in one of r + 1 blocks of it. Fingerprints meet
where such a block is equal; there the small Hamming ball of the rest of the half is enumerated, the table of halves
gives the matches, and their complete distance is verified. Every link is found, none is approximate.

Equal fingerprints are one row before any of this. Where many different fingerprints share a block, the asking side is
cut into slices and each slice meets the table of that block, so no task gets more than a bounded part. A task hands
on a spanning forest of the links it verified, never all pairs.

Nulls: a null text is an empty one, its fingerprint is zero and links like any other. A null doc_id gets a
fingerprint and takes part in linking; the group's id is the smallest doc_id that isn't null. Repeated rows give
repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.text import utf8
from cellframe.session import cut

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Of each half (shift): the differing bits it may have, and its blocks as (shift, bits).
HALVES = ((32, 2, ((0, 11), (11, 11), (22, 10))), (0, 1, ((0, 16), (16, 16))))
#: Fingerprints of one block that one task looks up, and rows of one task.
SLICE, GROUP_ROWS = 50_000, 200_000
#: Pairs verified at a time.
CHUNK = 1 << 20


def fingerprint(text: bytes) -> int:
    """The SimHash of one text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    ends = ends[min(SHINGLE, len(words)) - 1 :]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), ends[at : at + (1 << 16)].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], ["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


def ball(bits: int, radius: int, shift: int) -> list[int]:
    """Masks with at most ``radius`` set bits among the bits from ``shift`` on."""
    out = [0]
    for i in range(bits):
        out += [m | 1 << shift + i for m in out if bin(m).count("1") < radius]
    return out


def _masks(route: int) -> tuple[int, np.ndarray]:
    """Shift of the route's half, and the ball around the bits outside its block."""
    at = [(shift, radius, b) for shift, radius, blocks in HALVES for b in blocks][route]
    shift, radius, (low, bits) = at
    free = [i for i in range(32) if not low <= i < low + bits]
    masks = ball(len(free), radius, 0)
    spread = [sum(1 << free[i] for i in range(len(free)) if m >> i & 1) for m in masks]
    return shift, np.array(spread, np.uint64)


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the nodes that pairs (a, b) connect the smallest label among them."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def local_forest(route: np.ndarray, fp: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smaller root) that span the links between the asking rows and all rows of equal blocks."""
    nodes, at = np.unique(fp, return_inverse=True)
    labels = np.arange(len(nodes))
    for r in np.unique(route):
        shift, masks = _masks(int(r))
        mine = route == r
        own, ask = np.unique(at[mine]), np.unique(at[mine & asks])
        half = nodes[own] >> np.uint64(shift) & np.uint64(0xFFFFFFFF)
        order = np.argsort(half, kind="stable")
        own, half = own[order], half[order]
        asked = nodes[ask] >> np.uint64(shift) & np.uint64(0xFFFFFFFF)
        for m in masks:
            lo, hi = np.searchsorted(half, asked ^ m, "left"), np.searchsorted(half, asked ^ m, "right")
            n = hi - lo
            hit = np.flatnonzero(n)
            done = 0
            while done < len(hit):
                upto = done + max(1, int(np.searchsorted(np.cumsum(n[hit[done:]]), CHUNK, "right")))
                part = hit[done:upto]
                left = np.repeat(ask[part], n[part])
                base = np.repeat(lo[part] - np.concatenate([[0], np.cumsum(n[part])[:-1]]), n[part])
                right = own[base + np.arange(len(base))]
                near = np.bitwise_count(nodes[left] ^ nodes[right]) <= RADIUS
                near &= left != right
                join_labels(labels, left[near], right[near])
                done = upto
    moved = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[moved], nodes[labels[moved]]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp`` that connect every pair within RADIUS bits."""
    routes = [(r, shift + low, bits) for r, (shift, low, bits) in enumerate((s, lo, b) for s, _, blocks in HALVES for lo, b in blocks)]
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(r).alias("route"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("block")) for r, at, bits in routes
    ])).alias("k")).select("fp", "k.*")
    crowded = keyed.groupBy("route", "block").count().where(F.col("count") > SLICE).select("route", "block", F.ceil(F.col("count") / SLICE).alias("slices"))
    n_groups = max(1, -(-len(routes) * distinct.count() // GROUP_ROWS))
    dealt = (
        keyed.join(crowded, ["route", "block"], "left")
        .withColumn("slices", F.coalesce("slices", F.lit(1)).cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("route", "fp", (F.pmod(F.xxhash64("fp"), F.col("slices")) == F.col("slice")).alias("asks"),
                F.pmod(F.xxhash64("route", "block", "slice"), F.lit(n_groups)).alias("part"))
    )

    def run(group: pa.Table) -> pa.Table:
        route, fp, asks = (group.column(c).to_numpy() for c in ("route", "fp", "asks"))
        a, b = local_forest(route, fp.astype(np.int64).view(np.uint64), asks)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return dealt.groupBy("part").applyInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the same for all nodes that edges connect.

    Each round takes the smallest label among a node's neighbours, then jumps to that label's own label; it ends when
    no label moves. Labels are cut to the checkpoint folder in every round.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        moved = labels.join(near, "node").select("node", F.least("root", "m").alias("to"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("next"))
        step = cut(moved.join(jump, "to", "left").select("node", F.least("to", F.coalesce("next", "to")).alias("root"), "was"))
        labels = step.select("node", "root")
        if step.where("root <> was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text_hash, root (the group's key), component_id (its smallest doc_id) of every row of ``docs``."""
    marked = cut(fingerprints(docs))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = components(links(distinct)).withColumnRenamed("node", "fp")
    groups = distinct.join(rooted, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = groups.join(groups.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group, with all columns: of the smallest doc_id (nulls last), then of the smallest text hash."""
    last = F.lit(2**63 - 1)
    rows = near_duplicates(docs).groupBy("root", F.coalesce("doc_id", last).alias("_id"), "text_hash").agg(F.count("*").alias("times"))
    kept = cut(rows.groupBy("root").agg(F.min(F.struct("_id", "text_hash", "times")).alias("first")).select("first._id", F.col("first.text_hash").alias("_hash"), "first.times"))
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), last)).withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = keyed.join(kept, ["_id", "_hash"])
    if not kept.where("times > 1").isEmpty():  # repeated rows with one doc_id and text
        out = out.dropDuplicates(["_id", "_hash"])
    return out.select(docs.columns)


def hex16(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
