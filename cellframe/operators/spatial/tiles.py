"""Searches within a radius, a tile at a time.

A core is cut into squares of TILE radii. A cell belongs to its own tile and, as a candidate, to every tile whose border
is within the radius, so a tile holds all neighbours of its own cells and cells travel once, in 2.25 copies on average;
pairs never do. Inside a tile the cells lie in strips, ordered by x: each strip around a cell is one run of candidates. Of
that run, the part that is within the radius for any y of the strip is counted by prefix sums, and only its ends are
compared. A row of candidates costs a search, not a comparison each.

Results are exact: bounds of runs have a margin above rounding, and what lies between them is decided by the same
arithmetic as in Spark. Tiles of more than TILE_ROWS cells are named by :func:`crowded_tiles` and searched elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.session import cut, dealt

#: Side of a tile in radii, and the cells (candidates included) up to which one task searches it.
TILE = 4.0
TILE_ROWS = 200_000
#: Pairs looked at and sources searched at a time: a few arrays of pairs stay in a core's cache.
PAIRS, SOURCES = 100_000, 8192
#: Cells a task packs at a time, and the labels of a tile that are listed with each of its cells.
PACK_ROWS, FEW_LABELS = 500_000, 32
KEY = ("basename", "tx", "ty")


def members(points: DataFrame, radius: float) -> DataFrame:
    """Every cell once per tile it can matter to; ``own`` marks the tile it lies in.

    ``points`` has basename, x and y; rows without a place are left out.
    """
    side = F.lit(float(radius) * TILE)

    def span(c: str) -> Column:
        reach = F.lit(float(radius) * (1 + 1e-9)) + F.abs(F.col(c)) * F.lit(1e-14)
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))

    placed = points.where((F.abs("x") < F.lit(float("inf"))) & (F.abs("y") < F.lit(float("inf"))) & F.col("basename").isNotNull())
    own = (F.col("tx") == F.floor(F.col("x") / side)) & (F.col("ty") == F.floor(F.col("y") / side))
    return placed.withColumn("tx", span("x")).withColumn("ty", span("y")).withColumn("own", own)


def crowded_tiles(tiled: DataFrame) -> DataFrame | None:
    """Keys of the tiles too large for a task, None if there are none."""
    found = cut(tiled.groupBy(*KEY).agg(F.count("*").alias("__n")).where(F.col("__n") > TILE_ROWS).select(*KEY))
    return None if found.isEmpty() else found


class Strips:
    """The candidates of a tile, ordered by strip and x."""

    def __init__(self, x: np.ndarray, y: np.ndarray, radius: float):
        self.radius = radius
        self.slack = 1e-9 * radius + 16 * np.finfo(float).eps * max(np.abs(x).max(), np.abs(y).max())
        self.x0, self.y0 = x.min(), y.min()
        width, height = x.max() - self.x0, y.max() - self.y0
        # about two cells to a strip's height, so that ends and searches cost alike
        self.height = min(radius, max(radius / 256, 2 * np.sqrt(max(width, radius) * max(height, radius) / len(x))))
        strip = np.floor((y - self.y0) / self.height).astype(np.int64)
        self.order = np.lexsort((x, strip))
        self.x, self.y, strip = x[self.order], y[self.order], strip[self.order]
        # strips are laid end to end, too far apart for a run to leave its own
        self.pitch, self.lead = width + 6 * radius, 2 * radius
        self.at = strip * self.pitch + (self.x - self.x0)
        self.strip, self.count = strip, int(strip[-1]) + 1
        first = np.searchsorted(strip, np.arange(self.count))
        last = np.searchsorted(strip, np.arange(self.count), side="right")
        self.low, self.high = np.full(self.count, np.inf), np.full(self.count, -np.inf)
        some = last > first
        self.low[some] = np.minimum.reduceat(self.y, first[some])
        self.high[some] = np.maximum.reduceat(self.y, first[some])
        self.reach = int(np.ceil(radius / self.height)) + 1

    def runs(self, who: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
        """Positions (outer first, inner first, inner last, outer last) of the strip ``step`` above, for cells by position.

        All cells within the radius lie in the outer run, and all cells of the inner run are within it.
        """
        x, y, to = self.x[who], self.y[who], self.strip[who] + step
        there = (to >= 0) & (to < self.count)
        to = np.clip(to, 0, self.count - 1)
        below, above = self.low[to] - y, y - self.high[to]
        least = np.maximum(0.0, np.maximum(below, above))
        most = np.maximum(np.abs(below), np.abs(above))
        r2 = self.radius * self.radius
        there &= least <= self.radius + self.slack
        least = np.where(there, least, 0.0)
        outer = np.sqrt(np.maximum(0.0, r2 - least * least)) + np.sqrt(2 * self.radius * self.slack) + self.slack
        sure = there & (most < self.radius)
        inner = np.sqrt(np.maximum(0.0, r2 - np.where(sure, most, 0.0) ** 2)) - self.slack - 1e-6 * self.radius
        sure &= inner > 0
        middle = to * self.pitch + (x - self.x0)
        out_low = np.searchsorted(self.at, middle - outer)
        out_high = np.where(there, np.searchsorted(self.at, middle + outer, side="right"), out_low)
        in_low = np.where(sure, np.searchsorted(self.at, middle - inner), out_low)
        in_high = np.where(sure, np.searchsorted(self.at, middle + inner, side="right"), out_low)
        return out_low, in_low, np.maximum(in_low, in_high), out_high

    def steps(self) -> range:
        return range(-self.reach, self.reach + 1)


def _flat(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, ... of all runs, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def _pieces(size: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive rows with about ``most`` pairs each, one row at least."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(at, to)
        at = to


def counts_around(x: np.ndarray, y: np.ndarray, own: np.ndarray, code: np.ndarray, codes: int, radius: float) -> np.ndarray:
    """Per own cell, in order: the cells of every code within the radius, itself included."""
    strips = Strips(x, y, radius)
    code = code[strips.order]
    sums = np.zeros((len(x) + 1, codes), dtype=np.int64)
    sums[np.arange(1, len(x) + 1), code] = 1
    np.cumsum(sums, axis=0, out=sums)
    sources = np.flatnonzero(own[strips.order])
    total = np.zeros((len(x), codes), dtype=np.int64)
    r2 = radius * radius
    for start in range(0, len(sources), SOURCES):
        who = sources[start : start + SOURCES]
        found = np.zeros((len(who), codes), dtype=np.int64)
        for step in strips.steps():
            out_low, in_low, in_high, out_high = strips.runs(who, step)
            found += sums[in_high] - sums[in_low]
            for first, last in ((out_low, in_low), (in_high, out_high)):
                size = np.maximum(0, last - first)
                for piece in _pieces(size, PAIRS):
                    asked = np.repeat(np.arange(piece.start, piece.stop), size[piece])
                    other = _flat(first[piece], size[piece])
                    dx, dy = strips.x[who[asked]] - strips.x[other], strips.y[who[asked]] - strips.y[other]
                    near = dx * dx + dy * dy <= r2
                    cell = (asked[near] - piece.start) * codes + code[other[near]]
                    found[piece] += np.bincount(cell, minlength=(piece.stop - piece.start) * codes).reshape(-1, codes)
        total[strips.order[who]] = found
    return total[own]


def pairs_around(x: np.ndarray, y: np.ndarray, own: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bounded pieces of all pairs (own cell, cell within the radius), itself included: the own cells of a piece and how
    many pairs each has, then the other cell and the squared distance of every pair, in the order of the own cells."""
    strips = Strips(x, y, radius)
    sources = np.flatnonzero(own[strips.order])
    r2 = radius * radius
    steps = strips.steps()
    for start in range(0, len(sources), SOURCES):
        who = sources[start : start + SOURCES]
        first, size = np.empty((len(who), len(steps)), dtype=np.int64), np.empty((len(who), len(steps)), dtype=np.int64)
        for i, step in enumerate(steps):
            out_low, _, _, out_high = strips.runs(who, step)
            first[:, i], size[:, i] = out_low, np.maximum(0, out_high - out_low)
        asked = size.sum(axis=1)
        for piece in _pieces(asked, PAIRS):
            src, many = who[piece], asked[piece]
            other = _flat(first[piece].ravel(), size[piece].ravel())
            dx, dy = np.repeat(strips.x[src], many), np.repeat(strips.y[src], many)
            dx -= strips.x[other]
            dy -= strips.y[other]
            dx *= dx
            dy *= dy
            dx += dy
            near = dx <= r2
            yield strips.order[src], _sums(near, many), strips.order[other[near]], dx[near]


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums over runs of the given sizes that lie end to end; a run may be empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(size)
    return total[ends] - total[ends - size]


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def count_tiles(tiled: DataFrame, radius: float, labels: Sequence[str]) -> DataFrame:
    """Per own cell of every tile: id, label, and the counts ``n`` and ``n0``, ``n1``, ... around it, itself included."""
    codes = len(labels) + 1
    code = F.lit(len(labels))
    for i, name in reversed(list(enumerate(labels))):
        code = F.when(F.col("label") == name, F.lit(i)).otherwise(code)
    names = ["n", *[f"n{i}" for i in range(len(labels))]]
    rows = tiled.select(*KEY, "own", "x", "y", "cell_id", F.when(F.col("own"), F.col("label")).alias("label"), code.cast("int").alias("code"))

    def run(table: pa.Table) -> pa.Table:
        own = _column(table, "own")
        found = np.zeros((0, codes), dtype=np.int64)
        if own.any():
            found = counts_around(_column(table, "x"), _column(table, "y"), own, _column(table, "code"), codes, radius)
        out = table.select(["basename", "cell_id", "label"]).filter(pa.array(own))
        for name, values in zip(names, [found.sum(axis=1), *found.T[: len(labels)]]):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    kind = dict(tiled.dtypes)["cell_id"]
    return rows.groupBy(*KEY).applyInArrow(run, f"basename string, cell_id {kind}, label string, " + ", ".join(f"{n} long" for n in names))


def packs(tiled: DataFrame) -> DataFrame:
    """The cells of every tile in packs, of as many as a task meets in PACK_ROWS rows: what is sent names a tile once a
    pack, and a label once a pack. Cells without an id are left out."""
    kind = dict(tiled.dtypes)["cell_id"]
    rows = tiled.where(F.col("cell_id").isNotNull()).select(*KEY, "own", "x", "y", "cell_id", "label")

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        core = table.column("basename").chunk(0).dictionary_encode()
        label = table.column("label").chunk(0).dictionary_encode(null_encoding="encode")
        at = [_column(table, "ty"), _column(table, "tx"), core.indices.to_numpy()]
        order = np.lexsort(at)
        at = [a[order] for a in at]
        starts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([a[1:] != a[:-1] for a in at])]))
        size = np.diff(np.append(starts, len(order)))
        # a pack numbers its own labels
        names = max(1, len(label.dictionary))
        known, code = np.unique(np.repeat(np.arange(len(starts)), size) * names + label.indices.to_numpy()[order], return_inverse=True)
        first = np.searchsorted(known, np.arange(len(starts) + 1) * names)
        code = (code - np.repeat(first[:-1], size)).astype(np.int32)
        ends, order = pa.array(np.append(starts, len(order)), pa.int32()), pa.array(order)
        yield pa.RecordBatch.from_arrays([
            core.dictionary.take(pa.array(at[2][starts])), pa.array(at[1][starts]), pa.array(at[0][starts]),
            *[pa.ListArray.from_arrays(ends, table.column(c).chunk(0).take(order)) for c in ("own", "x", "y", "cell_id")],
            pa.ListArray.from_arrays(ends, pa.array(code)),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), label.dictionary.take(pa.array(known % names))),
        ], [*KEY, "own", "x", "y", "id", "code", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                many += batch.num_rows
            if many >= PACK_ROWS:
                yield from pack(held)
                held, many = [], 0
        if held:
            yield from pack(held)

    schema = f"basename string, tx long, ty long, own array<boolean>, x array<double>, y array<double>, id array<{kind}>, code array<int>, label array<string>"
    # a tile's pairs are many times its bytes, and tiles differ
    return dealt(rows.mapInArrow(run, schema), *KEY, turns=4)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, pa.Array, pa.Scalar]:
    """The cells of a tile: x, y, own, id, the id as a number, label code, the labels and the core."""
    table = pa.Table.from_batches(list(batches))
    flat = {c: table.column(c).combine_chunks().flatten() for c in ("own", "x", "y", "id", "code", "label")}
    many = [np.array([len(v) for v in table.column(c)], dtype=np.int64) for c in ("code", "label")]
    before = np.cumsum(many[1]) - many[1]
    names = flat["label"].dictionary_encode(null_encoding="encode")
    code = names.indices.to_numpy()[flat["code"].to_numpy() + np.repeat(before, many[0])]
    ids = flat["id"].to_numpy(zero_copy_only=False)
    place = ids if ids.dtype.kind in "iuf" else np.unique(ids, return_inverse=True)[1]
    x, y, own = (flat[c].to_numpy(zero_copy_only=False) for c in ("x", "y", "own"))
    return x, y, own, flat["id"], place, code, names.dictionary, table.column("basename")[0]


def pair_tiles(tiled: DataFrame, radius: float, ranked: bool = False) -> DataFrame:
    """Directed edges from every own cell to the cells within the radius but its own id; ranked by distance, then id, if asked for.

    A cell's edges leave the task together, as arrays in bounded batches, and become rows in Spark. With ``ranked``, ids
    are unique in their core.
    """
    kind = dict(tiled.dtypes)["cell_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, own, ids, place, code, names, core = _unpacked(batches)
        if not own.any():
            return
        for src, many, dst, d2 in pairs_around(x, y, own, radius):
            other = np.repeat(place[src], many) != place[dst]
            many, dst, d2 = _sums(other, many), dst[other], d2[other]
            some = many > 0
            src, many = src[some], many[some]
            if not len(src):
                continue
            if ranked:
                # a cell's pairs are together: order them among themselves
                order = np.lexsort((place[dst], d2, np.repeat(np.arange(len(src)), many)))
                dst, d2 = dst[order], d2[order]
            ends = pa.array(np.append(0, np.cumsum(many)), pa.int32())
            if len(names) <= FEW_LABELS:
                turn, words = code[dst], pa.ListArray.from_arrays(pa.array(np.arange(len(src) + 1) * len(names), pa.int32()), names.take(pa.array(np.tile(np.arange(len(names)), len(src)))))
            else:
                turn, words = _flat(np.zeros(len(src), dtype=np.int64), many), pa.ListArray.from_arrays(ends, names.take(pa.array(code[dst])))
            lists = [ids.take(pa.array(dst)), pa.array(turn, pa.int32()), pa.array(np.sqrt(d2))]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(core, len(src)), ids.take(pa.array(src)), names.take(pa.array(code[src])), words,
                 *[pa.ListArray.from_arrays(ends, values) for values in lists]], columns)

    columns = ["basename", "src_cell_id", "src_phenotype", "words", "ids", "turns", "distances"]
    schema = f"basename string, src_cell_id {kind}, src_phenotype string, words array<string>, ids array<{kind}>, turns array<int>, distances array<double>"
    lists = packs(tiled).groupBy(*KEY).applyInArrow(run, schema)
    rows = lists.select(*columns, F.posexplode("ids").alias("__at", "dst_cell_id"))
    rank = [(F.col("__at") + 1).alias("rank")] if ranked else []
    return rows.select(
        "basename", "src_cell_id", "dst_cell_id", "src_phenotype", F.get("words", F.get("turns", "__at")).alias("dst_phenotype"),
        F.get("distances", "__at").alias("distance_px"), *rank)


def label_pair_tiles(tiled: DataFrame, radius: float) -> DataFrame:
    """The pairs of labels that edges of :func:`pair_tiles` join, each once a tile.

    The labels around every own cell are counted, so no edge is made but those of ids that come twice in a tile.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, own, _, place, code, names, _ = _unpacked(batches)
        codes = len(names)
        _, which, count = np.unique(place, return_inverse=True, return_counts=True)
        met = np.zeros(0, dtype=np.int64)
        alone = own & (count[which] == 1) & (codes <= FEW_LABELS)
        if alone.any():
            around = counts_around(x, y, alone, code, codes, radius)
            around[np.arange(len(around)), code[alone]] -= 1
            cell, label = np.nonzero(around)
            met = np.unique(code[alone][cell].astype(np.int64) * codes + label)
        if (own & ~alone).any():
            for src, many, dst, _ in pairs_around(x, y, own & ~alone, radius):
                src = np.repeat(src, many)
                other = place[src] != place[dst]
                met = np.union1d(met, code[src[other]].astype(np.int64) * codes + code[dst[other]])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(met // codes)), names.take(pa.array(met % codes))], ["src_phenotype", "dst_phenotype"])

    return packs(tiled).groupBy(*KEY).applyInArrow(run, "src_phenotype string, dst_phenotype string")
