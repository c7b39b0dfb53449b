"""Nearest neighbours as lists, in pieces of a part of a core.

A piece holds up to PIECE cells of a square of SQUARE grid buckets: their lists of neighbours as places in the piece's own
list of ids, which names a cell once. Values of neighbours are asked for once a piece, and what is made of a cell's
neighbours is made in the piece's task, so no pair of cells is ever written or sent.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.session import cut, dealt, stored

#: Side of a square in grid buckets, and the cells of a piece at most.
SQUARE, PIECE = 16, 8192
PART = ["basename", "tx", "ty", "twice"]
KEY = [*PART, "piece"]


def neighbour_lists(met: DataFrame, origin: DataFrame, k: int) -> DataFrame:
    """The pieces of a graph, written once.

    ``met`` has a row a cell: basename, cell_id, x, y and its neighbours' ``ids`` and ``d2s``, itself perhaps with them, by
    distance, then id; ``origin`` has the grid of every core. Cells whose id comes twice lie in pieces of their own.
    """
    key = ["basename", "cell_id"]
    kind = dict(met.dtypes)["cell_id"]
    many = cut(met.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > 1).select(*key, F.lit(True).alias("twice")))
    rows = met.withColumn("twice", F.lit(False)) if many.isEmpty() else met.join(many, key, "left").withColumn("twice", F.coalesce("twice", F.lit(False)))
    side = F.col("g") * F.lit(float(SQUARE))
    placed = rows.where(F.col("cell_id").isNotNull()).join(origin, "basename").select(
        "basename", F.floor((F.col("x") - F.col("x0")) / side).alias("tx"), F.floor((F.col("y") - F.col("y0")) / side).alias("ty"),
        "twice", "cell_id", "ids", "d2s")

    def piece(table: pa.Table, number: int) -> pa.RecordBatch:
        table = table.combine_chunks()
        many = np.array(pc.list_value_length(table.column("ids").chunk(0)))
        flat = table.column("ids").chunk(0).flatten().dictionary_encode()
        d2 = table.column("d2s").chunk(0).flatten().to_numpy(zero_copy_only=False)
        own = table.column("cell_id").chunk(0)
        # an unknown id is nobody's neighbour
        at = flat.indices.fill_null(-1).to_numpy()
        row = np.repeat(np.arange(len(many)), many)
        kept = (at >= 0) & (at != pc.index_in(own, value_set=flat.dictionary).fill_null(-2).to_numpy()[row])
        row, at, d2 = row[kept], at[kept], d2[kept]
        ends = np.searchsorted(row, np.arange(len(many) + 1))
        nearest = np.arange(len(row)) - ends[row] < k
        row, at, d2 = row[nearest], at[nearest], d2[nearest]
        used, at = np.unique(at, return_inverse=True)
        first = table.slice(0, 1)
        lists = [own, pa.array(np.bincount(row, minlength=len(many)), pa.int32()), flat.dictionary.take(pa.array(used)), pa.array(at, pa.int32()), pa.array(np.sqrt(d2))]
        return pa.RecordBatch.from_arrays(
            [first.column(c).chunk(0) for c in PART] + [pa.array([number], pa.int32())]
            + [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, number = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                if rows + part.num_rows > PIECE:
                    yield piece(pa.Table.from_batches(held), number)
                    held, rows, number = [], 0, number + 1
                if part.num_rows:
                    held.append(part)
                    rows += part.num_rows
        if rows:
            yield piece(pa.Table.from_batches(held), number)

    names = [*KEY, "src", "many", "ids", "places", "distances"]
    schema = (f"basename string, tx long, ty long, twice boolean, piece int, src array<{kind}>, many array<int>, ids array<{kind}>, "
              "places array<int>, distances array<double>")
    return stored(placed.groupBy(*PART).applyInArrow(run, schema))


def is_listed(edges: DataFrame) -> bool:
    """Whether the table is a graph in lists in place of edges."""
    return "places" in edges.columns


def _flat(row: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    column = row.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten()


def listed_edges(lists: DataFrame) -> DataFrame:
    """The edges of a graph in lists: basename, src_cell_id, dst_cell_id, distance_px and rank."""
    kind = dict(lists.dtypes)["src"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                many, at = _flat(row, "many").to_numpy(), _flat(row, "places")
                src = np.repeat(np.arange(len(many)), many)
                rank = np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(row.column("basename")[0], len(src)), _flat(row, "src").take(pa.array(src)), _flat(row, "ids").take(at),
                    _flat(row, "distances"), pa.array(rank, pa.int32())], ["basename", "src_cell_id", "dst_cell_id", "distance_px", "rank"])

    return lists.mapInArrow(run, f"basename string, src_cell_id {kind}, dst_cell_id {kind}, distance_px double, rank int")


def _spread(values: np.ndarray, known: np.ndarray, first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per run of pairs and column: the known values, their mean and their population deviation."""
    count = np.add.reduceat(known.astype(np.int64), first, axis=0)
    some = np.maximum(count, 1)
    mean = np.add.reduceat(np.where(known, values, 0.0), first, axis=0) / some
    off = np.where(known, values - mean[row], 0.0)
    return count, mean, np.sqrt(np.add.reduceat(off * off, first, axis=0) / some)


def list_features(
    lists: DataFrame, values: DataFrame, ks: Sequence[int], features: Sequence[str], taus: Sequence[float], names: Sequence[str],
) -> DataFrame:
    """Per cell with neighbours whose id comes once: the statistics ``names`` of :func:`~.knn.knn_features`.

    ``values`` has basename, cell_id and a column of doubles a channel, whose cuts are ``taus``. A piece asks for the
    values of its ids once.
    """
    channels = [c for c in values.columns if c not in ("basename", "cell_id")]
    lists = lists.where(~F.col("twice"))
    kind = dict(lists.dtypes)["src"].removeprefix("array<").removesuffix(">")
    asked = lists.select(*KEY, F.explode("ids").alias("cell_id")).join(values, ["basename", "cell_id"])
    asked = asked.withColumnsRenamed({c: f"_{c}" for c in KEY})

    def run(graph: pa.Table, around: pa.Table) -> pa.Table:
        many, at = _flat(graph, "many").to_numpy(), _flat(graph, "places").to_numpy()
        distance = _flat(graph, "distances").to_numpy()
        # the rows of values of every id, as a run; an id may come several times
        place = pc.index_in(around.column("cell_id"), value_set=_flat(graph, "ids")).to_numpy()
        order = np.argsort(place, kind="stable")
        runs = np.searchsorted(place[order], np.arange(at.max(initial=-1) + 2))
        times = np.diff(runs)[at] if len(at) else np.zeros(0, dtype=np.int64)
        cell = np.repeat(np.arange(len(many)), many)
        rank = np.arange(len(cell)) - np.repeat(np.cumsum(many) - many, many) + 1
        cell, rank, distance = np.repeat(cell, times), np.repeat(rank, times), np.repeat(distance, times)
        ends = np.cumsum(times)
        picked = order[np.arange(len(cell)) + np.repeat((runs[at] if len(at) else ends) - ends + times, times)]
        columns = [around.column(c).combine_chunks() for c in channels]
        v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])[picked].astype(float)
        known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])[picked]
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        cells = np.unique(cell)
        turn = iter(names)
        for k in ks:
            near = rank <= k
            first = np.searchsorted(cell[near], cells)  # every cell's first neighbour is among them
            row = np.searchsorted(cells, cell[near])
            if not len(cells):
                break
            count, mean, spread = _spread(v[near], known[near], first, row)
            above = (v[near] > np.array(taus)) | np.isnan(v[near])
            share = np.add.reduceat(above & known[near], first, axis=0, dtype=np.int64) / np.maximum(count, 1)
            for i in range(len(channels)):
                for feature, got in (("mean", mean), ("std", spread), ("posfrac", share)):
                    if feature in features:
                        found[next(turn)] = got[:, i], count[:, i] == 0
            if "density" in features:
                one = np.diff(np.append(first, near.sum()))
                found[next(turn)] = np.add.reduceat(1.0 / (distance[near] + 1.0), first) / one, one == 0
        ids = _flat(graph, "src").take(pa.array(cells))
        out = [pa.array(found[n][0], pa.float64(), mask=found[n][1]) if n in found else pa.nulls(0, pa.float64()) for n in names]
        return pa.table([pa.repeat(graph.column("basename")[0], len(cells)), ids, *out], names=["basename", "cell_id", *names])

    schema = f"basename string, cell_id {kind}, " + ", ".join(f"{n} double" for n in names)
    return dealt(lists, *KEY, turns=4).groupBy(*KEY).cogroup(dealt(asked, *[f"_{c}" for c in KEY], turns=4).groupBy(*[f"_{c}" for c in KEY])).applyInArrow(run, schema)
