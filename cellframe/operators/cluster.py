"""Cluster-then-label: communities of cells per core and positivity by cluster mean.

Every core is clustered on all of its cells, by the same rule at every size. All
cells of a core meet in one task, whose memory grows with the core's cells. Its time grows
with their square at worst, where no part of a core's cells is far from another (README:
figures).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.functions.expr import require, stack_columns
from cellframe.operators.normalize import zscore_by_core
from cellframe.operators.rules import phenotype_labels
from cellframe.panel import CELL_KEY, DEFAULT_PANEL, MarkerPanel, ch, ph
from cellframe.session import cut

# Defaults of the clustering.
RESOLUTION = 0.6
NEIGHBOURS = 20
COMPONENTS = 10
SEED = 0
SCALED = "zscore_spacec"
# Rows up to which a block of distances covers whole rows; the rows of a leaf and the columns of a block above.
WHOLE_ROWS = 8192
LEAF, COLUMNS = 256, 2048
# Pairs held of a leaf's rows before the nearest of each are picked: equal rows are all as near.
FOUND = 2_000_000


def principal_scores(x: np.ndarray, components: int) -> np.ndarray:
    """Scores on the leading components, signs fixed by the largest loading."""
    n, p = x.shape
    m = max(1, min(components, min(n, p) - 1))
    centred = x - x.mean(axis=0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    loadings = vectors[:, ::-1][:, :m]
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(m)])
    return centred @ (loadings * np.where(signs == 0, 1.0, signs))


def _nearest(scores: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of every row, itself excluded, in bounded blocks of distances."""
    n = len(scores)
    sq = (scores**2).sum(axis=1)
    out = np.empty((n, k), dtype=np.int32)
    if n <= WHOLE_ROWS:
        for start in range(0, n, 512):
            block = scores[start:start + 512]
            d = sq[start:start + 512, None] - 2.0 * block @ scores.T + sq[None, :]
            d[np.arange(len(block)), np.arange(start, start + len(block))] = np.inf
            out[start:start + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
        return out
    return _nearest_in_leaves(scores, sq, k, out)


def _leaves(scores: np.ndarray) -> list[np.ndarray]:
    """The rows in leaves of at most LEAF, halved across their widest column."""
    leaves, open_ = [], [np.arange(len(scores), dtype=np.int32)]
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF:
            leaves.append(np.sort(rows))
            continue
        part = scores[rows]
        by = part[:, np.ptp(part, axis=0).argmax()]
        half = np.argpartition(by, len(rows) // 2)
        open_ += [rows[half[len(rows) // 2:]], rows[half[:len(rows) // 2]]]
    return leaves


def _first(row: np.ndarray, col: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest found of every row, by distance, then place."""
    order = np.lexsort((col, d, row))
    row, col, d = row[order], col[order], d[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept], d[kept]


def _nearest_in_leaves(scores: np.ndarray, sq: np.ndarray, k: int, out: np.ndarray) -> np.ndarray:
    """:func:`_nearest` leaf by leaf: leaves whose box is farther than a row's k-th among the nearest leaves are left out."""
    leaves = _leaves(scores)
    low, high = (np.array([f(scores[rows], axis=0) for rows in leaves]) for f in (np.min, np.max))
    # the squared length in the product's last column: a product of rows is their squared distance but for the own length
    columns = [np.column_stack([scores[rows], sq[rows]]).T for rows in leaves]
    near = -(-4 * max(k + 1, LEAF) // LEAF)
    for at, rows in enumerate(leaves):
        block, own_sq = np.column_stack([-2.0 * scores[rows], np.ones(len(rows))]), sq[rows, None]
        gap = np.maximum(0.0, np.maximum(low - high[at], low[at] - high))
        gap = (gap * gap).sum(axis=1)
        order = np.argsort(gap, kind="stable")
        d = block @ np.concatenate([columns[i] for i in order[:near]], axis=1)
        # the (k + 1)-th among some, the row itself with them, is no nearer than the k-th of all others
        bound = np.partition(d, k, axis=1)[:, k, None]
        bound += 1e-9 * (np.abs(bound) + own_sq)
        reach = (bound + own_sq)[:, 0] * (1 + 1e-9) + 1e-9 * own_sq[:, 0]
        found, many = [], 0
        far = order[: np.searchsorted(gap[order], reach.max(), side="right")]
        for start in range(0, len(far), COLUMNS // LEAF):
            some = far[start:start + COLUMNS // LEAF]
            asked = np.flatnonzero(reach >= gap[some[0]])
            cells = np.concatenate([leaves[i] for i in some])
            d = block[asked] @ np.concatenate([columns[i] for i in some], axis=1)
            flat = np.flatnonzero(d <= bound[asked])
            other = cells[flat % len(cells)] != rows[asked[flat // len(cells)]]
            flat = flat[other]
            found.append((asked[flat // len(cells)], cells[flat % len(cells)], d.ravel()[flat]))
            many += len(flat)
            if many > FOUND:
                found = [_first(*(np.concatenate(x) for x in zip(*found)), k)]
                many = len(found[0][0])
        row, col, d = _first(*(np.concatenate(x) for x in zip(*found)), k)
        out[rows] = col.reshape(len(rows), k)
    return out


@dataclass
class Graph:
    """Links of every row as flat arrays: those of row i lie from ``first[i]`` to ``first[i + 1]``."""

    first: np.ndarray
    other: np.ndarray
    weight: np.ndarray


def _linked(row: np.ndarray, other: np.ndarray, weight: np.ndarray, n: int) -> Graph:
    """The graph of the given links; repeated ones are added up, a row's links are in the order they first come in."""
    key = row.astype(np.int64) * n + other
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    total = np.add.reduceat(weight[order], starts) if len(key) else weight
    key, came = key[starts], order[starts]
    del order
    place = np.lexsort((came, key // n))
    key, total = key[place], total[place]
    first = np.searchsorted(key // n, np.arange(n + 1))
    return Graph(first, (key % n).astype(np.int32), total)


def knn_graph(scores: np.ndarray, k: int) -> Graph:
    """Symmetric neighbour graph weighted by shared direction."""
    n = len(scores)
    k = min(k, n - 1)
    near = _nearest(scores, k).ravel()
    row = np.repeat(np.arange(n, dtype=np.int32), k)
    # both directions of a link come in one after the other
    ends = np.stack([np.stack([row, near], axis=1), np.stack([near, row], axis=1)], axis=1).reshape(-1, 2)
    return _linked(ends[:, 0], ends[:, 1], np.full(len(ends), 0.5), n)


def communities(graph: Graph, resolution: float, seed: int) -> np.ndarray:
    """Modularity communities by seeded local moving and aggregation, numbered by size."""
    rng = np.random.default_rng(seed)
    n = len(graph.first) - 1
    member, loops = np.arange(n), np.zeros(n)
    while True:
        n = len(graph.first) - 1
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(graph.first))
        degrees = np.bincount(row, graph.weight, n) + loops
        total = float(degrees.sum())
        degree, label, weight = degrees.tolist(), list(range(n)), degrees.tolist()
        if total == 0:
            break
        first = graph.first.tolist()
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in rng.permutation(n).tolist():
                own = label[i]
                links: dict[int, float] = {}
                here = slice(first[i], first[i + 1])
                for j, w in zip(graph.other[here].tolist(), graph.weight[here].tolist()):
                    c = label[j]
                    links[c] = links.get(c, 0.0) + w
                weight[own] -= degree[i]
                scale = resolution * degree[i] / total
                best, gain = own, links.get(own, 0.0) - scale * weight[own]
                for c, w in links.items():
                    g = w - scale * weight[c]
                    if g > gain + 1e-12:
                        best, gain = c, g
                weight[best] += degree[i]
                if best != own:
                    label[i] = best
                    moved = moved_any = True
        ids, compact = np.unique(np.array(label), return_inverse=True)
        member = compact[member]
        if not moved_any or len(ids) == n:
            break
        one, other = compact[row], compact[graph.other]
        inside = one == other
        loops = np.bincount(compact, loops, len(ids)) + np.bincount(one[inside], graph.weight[inside], len(ids))
        graph = _linked(one[~inside], other[~inside], graph.weight[~inside], len(ids))
    ids, first, counts = np.unique(member, return_index=True, return_counts=True)
    order = np.lexsort((first, -counts))
    number = np.empty(len(ids), dtype=np.int64)
    number[order] = np.arange(len(ids))
    return number[np.searchsorted(ids, member)]


def cluster_matrix(
    x: np.ndarray, k: int = NEIGHBOURS, resolution: float = RESOLUTION,
    components: int = COMPONENTS, seed: int = SEED,
) -> np.ndarray:
    """Cluster id per row of one bounded matrix; fewer than two rows are one cluster."""
    if len(x) < 2:
        return np.zeros(len(x), dtype=np.int64)
    scores = principal_scores(x, components)
    return communities(knn_graph(scores, min(k, max(2, len(x) - 1))), resolution, seed)


def cluster_cells(
    df: DataFrame, panel: MarkerPanel = DEFAULT_PANEL, k: int = NEIGHBOURS,
    resolution: float = RESOLUTION, components: int = COMPONENTS, seed: int = SEED,
    zscore: str = SCALED, out: str = "cluster_id_spacec",
) -> DataFrame:
    """Cluster id of every cell of every core: ``basename, cell_id, <out>``.

    ``df`` carries the scaled columns ``chXX_<zscore>``. Ids count from 0 by size
    within their core and have no meaning across cores.
    """
    columns = [ch(c, zscore) for c in panel.channels]
    require(df, [*CELL_KEY, *columns])
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    cells = df.select("basename", "cell_id", vector.alias("v"))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        ids = cluster_matrix(np.stack(pdf["v"].to_numpy()), k, resolution, components, seed)
        return pd.DataFrame({"basename": pdf["basename"], "cell_id": pdf["cell_id"], out: ids})

    return cut(cells.groupBy("basename").applyInPandas(label, f"basename string, cell_id long, {out} int"))


def cluster_zscore(
    df: DataFrame, cluster: str = "cluster_id_spacec", zscore: str = SCALED,
    panel: MarkerPanel = DEFAULT_PANEL,
) -> DataFrame:
    """Mean scaled value and size per core, cluster and marker."""
    agg = df.groupBy("basename", cluster).agg(
        F.count("*").alias("n_cluster"),
        *[F.avg(F.col(ch(c, zscore)).cast("double")).alias(f"__z_{c}") for c in panel.channels],
    )
    rows = [
        {"marker": F.lit(n), "channel": F.lit(c), "z": F.col(f"__z_{c}")} for n, c in panel.pairs
    ]
    return stack_columns(agg, ["basename", cluster, "n_cluster"], rows)


def positive_clusters(
    cz: DataFrame, tau: float = 0.5, cluster: str = "cluster_id_spacec"
) -> DataFrame:
    """Per core and marker the clusters strictly above tau, and the largest cluster mean."""
    return cz.groupBy("basename", "marker", "channel").agg(
        F.sort_array(F.collect_list(F.when(F.col("z") > tau, F.col(cluster)))).alias("positive_cluster_ids"),
        F.max("z").alias("max_z"),
    )


def broadcast_positivity(
    df: DataFrame, cz: DataFrame, tau: float = 0.5, cluster: str = "cluster_id_spacec",
    panel: MarkerPanel = DEFAULT_PANEL, suffix: str = "pos_spacec",
) -> DataFrame:
    """Cells take the positivity of their cluster, marker by marker."""
    flags = cz.groupBy("basename", cluster).agg(*[
        F.bool_or((F.col("channel") == c) & (F.col("z") > tau)).alias(ch(c, suffix))
        for c in panel.channels
    ])
    return df.join(flags, ["basename", cluster])


def label_cores(
    df: DataFrame, panel: MarkerPanel = DEFAULT_PANEL, tau: float = 0.5, k: int = NEIGHBOURS,
    resolution: float = RESOLUTION, components: int = COMPONENTS, seed: int = SEED,
    max_value: float = 5.0, space: str = "raw",
) -> DataFrame:
    """Scale, cluster and label every core: key, cluster id, z-scores, marker and phenotype labels."""
    require(df, [*CELL_KEY, *[ch(c, "true") for c in panel.channels]])
    source = df.select(*CELL_KEY, *[ch(c, "true") for c in panel.channels])
    scaled = zscore_by_core(source, panel, max_value, space, SCALED).drop(*[ch(c, "true") for c in panel.channels])
    ids = cluster_cells(scaled, panel, k, resolution, components, seed)
    joined = cut(scaled.join(ids, list(CELL_KEY)))
    labelled = broadcast_positivity(joined, cluster_zscore(joined, panel=panel), tau, panel=panel)
    return phenotype_labels(labelled, panel, "pos_spacec", "call_spacec")


def label_columns(panel: MarkerPanel = DEFAULT_PANEL) -> Sequence[str]:
    """The columns :func:`label_cores` adds to the key."""
    return (
        ["cluster_id_spacec"]
        + [ch(c, SCALED) for c in panel.channels]
        + [ch(c, "pos_spacec") for c in panel.channels]
        + [ph(n, "call_spacec") for n in panel.phenotypes]
    )
