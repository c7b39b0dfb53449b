"""Exact neighbour graphs as bucketed equi-joins.

Nothing here pairs all cells of a core. A core may hold any share of the rows,
and so may one spot or one patch of it:

* cells on the same spot are searched once, and only the ``k + 1`` smallest ids
  of a spot can be anybody's neighbours;
* a first pass compares each spot with the 3x3 grid buckets around it, with a
  bucket size taken from the density of its core, and accepts a spot when its
  neighbours are provably complete;
* the few remaining spots (sparse surroundings, or next to a crowded bucket) are
  searched on the finest level of a bucket hierarchy on which their own bucket
  holds ``k + 1`` points. All neighbours then lie within that bucket's diagonal,
  so the buckets at distance two or less are enough, on any level.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.expr import require
from cellframe.operators.spatial.lists import is_listed, list_features, listed_edges, neighbour_lists
from cellframe.operators.spatial.tiles import KEY, crowded_tiles, label_pair_tiles, members, pair_tiles
from cellframe.session import cut, dealt, stored

# Points per bucket aimed at, as a multiple of k; and the size from which a bucket counts as crowded.
BUCKET_FILL = 0.9
CROWDED = 512
# Levels of halving below the base grid that crowded buckets are split into.
FINE_LEVELS = 16
SAFE = 1.0 - 1e-9


def _points(cells: DataFrame, label: str | None) -> DataFrame:
    tag = F.col(label).cast("string") if label else F.lit(None).cast("string")
    return cells.select(
        "basename", "cell_id", F.col("centroid_x").cast("double").alias("x"),
        F.col("centroid_y").cast("double").alias("y"), tag.alias("label"),
    ).filter("x is not null and y is not null")


def _reachable(points: DataFrame, k: int) -> DataFrame:
    """The k + 1 smallest ids of every spot; the limit is applied before the shuffle."""
    w = Window.partitionBy("basename", "x", "y").orderBy("cell_id")
    return points.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k + 1)


def _grid(spots: DataFrame, k: int) -> DataFrame:
    """Origin and bucket size per core from the extent and number of its spots."""
    w, h = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    fill = F.lit(BUCKET_FILL * max(k, 4))
    size = F.greatest(
        F.sqrt(w * h * fill / F.count("*")), F.greatest(w, h) * fill / F.count("*")
    )
    return spots.groupBy("basename").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"),
        F.max("x").alias("x1"), F.max("y").alias("y1"),
        F.when(size > 0, size).otherwise(F.lit(1.0)).alias("g"),
    )


def _bucketed(df: DataFrame, grid: DataFrame) -> DataFrame:
    return df.join(grid, "basename").withColumns({
        "bx": F.floor((F.col("x") - F.col("x0")) / F.col("g")),
        "by": F.floor((F.col("y") - F.col("y0")) / F.col("g")),
    })


def _around(df: DataFrame, reach: int) -> DataFrame:
    """Replicate rows to the (2 reach + 1)^2 buckets around theirs."""
    steps = ", ".join(f"({i}L, {j}L)" for i in range(-reach, reach + 1) for j in range(-reach, reach + 1))
    return df.selectExpr("*", f"inline(array({steps})) as (__dx, __dy)").selectExpr(
        *[c for c in df.columns if c not in ("bx", "by")], "bx + __dx as bx", "by + __dy as by"
    )


def _candidate_cols() -> list[Column]:
    return [
        F.col("cell_id").alias("c_id"), F.col("x").alias("c_x"), F.col("y").alias("c_y"),
        F.col("label").alias("c_label"),
    ]


def _dist2() -> Column:
    dx, dy = F.col("x") - F.col("c_x"), F.col("y") - F.col("c_y")
    return dx * dx + dy * dy


def _nearest(pairs: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k + 1 nearest candidates per spot as a sorted array of ``(d2, id, label)``."""
    w = Window.partitionBy(*keys).orderBy("d2", "c_id")
    top = pairs.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k + 1)
    entry = F.struct("d2", F.col("c_id").alias("id"), F.col("c_label").alias("label"))
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("nb"))


def _block_reach(side: str, low: str, high: str, index: str) -> Column:
    """Distance from a spot to the nearer border of its 3x3 block; open where the core ends."""
    lower = F.col(low) + (F.col(index) - 1) * F.col("g")
    upper = F.col(low) + (F.col(index) + 2) * F.col("g")
    inf = F.lit(float("inf"))
    return F.least(
        F.when(F.col(index) <= 1, inf).otherwise(F.col(side) - lower),
        F.when(upper > F.col(high), inf).otherwise(upper - F.col(side)),
    )


def _first_pass(spots: DataFrame, reachable: DataFrame, crowded: DataFrame, k: int) -> DataFrame:
    zone = _around(crowded.select("basename", "bx", "by"), 1).distinct()
    reach = F.least(_block_reach("x", "x0", "x1", "bx"), _block_reach("y", "y0", "y1", "by"))
    sources = spots.join(zone, ["basename", "bx", "by"], "left_anti").withColumn("limit2", reach * reach * F.lit(SAFE))
    # every block holds at most nine buckets that are not crowded, so the arrays are bounded
    calm = reachable.join(crowded.select("basename", "bx", "by"), ["basename", "bx", "by"], "left_anti")
    blocks = (
        _around(calm.select("basename", "bx", "by", *_candidate_cols()), 1)
        .groupBy("basename", "bx", "by")
        .agg(F.collect_list(F.struct("c_id", "c_x", "c_y", "c_label")).alias("block"))
    )

    def entry(c: Column) -> Column:
        dx, dy = F.col("x") - c["c_x"], F.col("y") - c["c_y"]
        return F.struct((dx * dx + dy * dy).alias("d2"), c["c_id"].alias("id"), c["c_label"].alias("label"))

    inside = F.filter(F.transform("block", entry), lambda e: e["d2"] < F.col("limit2"))
    return (
        sources.join(blocks, ["basename", "bx", "by"])
        .select(*spots.columns, "limit2", F.slice(F.sort_array(inside), 1, k + 1).alias("nb"))
        .select(
            *spots.columns, "nb",
            ((F.size("nb") >= k + 1) | (F.col("limit2") == F.lit(float("inf")))).alias("complete"),
        )
    )


def _second_pass(
    spots: DataFrame, reachable: DataFrame, tiles: DataFrame, crowded: DataFrame, k: int
) -> DataFrame:
    """Search the remaining spots on the level their surroundings ask for."""
    key = ["basename", "lvl", "cx", "cy"]

    def coarse(df: DataFrame) -> DataFrame:
        """Ancestors of base buckets: level u has buckets of size g * 2^u."""
        span = F.greatest((F.col("x1") - F.col("x0")), (F.col("y1") - F.col("y0"))) / F.col("g") + 1
        top = F.ceil(F.log2(span)).cast("int") + 1
        return df.withColumn("lvl", F.explode(F.sequence(F.lit(0), top))).withColumns({
            "cx": F.floor(F.col("bx") / F.pow(F.lit(2.0), F.col("lvl"))),
            "cy": F.floor(F.col("by") / F.pow(F.lit(2.0), F.col("lvl"))),
        })

    def fine(df: DataFrame) -> DataFrame:
        """Halvings of base buckets: level -d has buckets of size g / 2^d."""
        out = df.withColumn("lvl", F.explode(F.sequence(F.lit(-FINE_LEVELS), F.lit(-1))))
        scale = F.pow(F.lit(2.0), -F.col("lvl")) / F.col("g")
        return out.withColumns({
            "cx": F.floor((F.col("x") - F.col("x0")) * scale),
            "cy": F.floor((F.col("y") - F.col("y0")) * scale),
        })

    zone = _around(crowded.select("basename", "bx", "by"), 1).distinct()
    warm = fine(reachable.join(zone, ["basename", "bx", "by"], "left_semi"))
    counts = (
        coarse(tiles).groupBy(*key).agg(F.sum("n").alias("n"))
        .unionByName(warm.groupBy(*key).agg(F.count("*").alias("n")))
        .filter(F.col("n") >= k + 1)
    )
    in_zone = spots.join(zone, ["basename", "bx", "by"], "left_semi")
    columns = ["basename", "x", "y", "g", "x0", "y0", "bx", "by", "lvl", "cx", "cy"]
    ladder = coarse(spots).select(*columns).unionByName(fine(in_zone).select(*columns))
    level = (
        ladder.join(counts.select(*key, F.lit(True).alias("enough")), key, "left")
        .groupBy("basename", "x", "y")
        .agg(
            F.min(F.when(F.col("enough"), F.col("lvl"))).alias("__fit"),
            F.max("lvl").alias("__top"), F.first("g").alias("g"),
            F.first("x0").alias("x0"), F.first("y0").alias("y0"),
        )
        .withColumn("lvl", F.coalesce("__fit", "__top"))
    )
    size = F.col("g") * F.pow(F.lit(2.0), F.col("lvl"))
    limit2 = F.when(F.col("__fit").isNull(), F.lit(float("inf"))).otherwise(size * size * F.lit(2.0 + 1e-6))
    rings = _around(
        level.select(
            "basename", "x", "y", "g", "x0", "y0", "lvl", limit2.alias("limit2"),
            F.floor((F.col("x") - F.col("x0")) / size).alias("bx"),
            F.floor((F.col("y") - F.col("y0")) / size).alias("by"),
        ), 2,
    ).withColumnsRenamed({"bx": "cx", "by": "cy"})

    def outside(side: str, low: str, index: str) -> Column:
        start = F.col(low) + F.col(index) * F.col("g")
        return F.greatest(start - F.col(side), F.col(side) - start - F.col("g"), F.lit(0.0))

    gap_x, gap_y = outside("x", "x0", "bx"), outside("y", "y0", "by")
    touched = (
        rings.filter("lvl >= 0")
        .join(coarse(tiles).select(*key, "bx", "by"), key)
        .filter((gap_x * gap_x + gap_y * gap_y) * F.lit(SAFE) <= F.col("limit2"))
        .select("basename", "bx", "by", "x", "y", "limit2")
    )
    through_base = touched.join(
        reachable.select("basename", "bx", "by", *_candidate_cols()), ["basename", "bx", "by"]
    )
    through_fine = rings.filter("lvl < 0").join(warm.select(*key, *_candidate_cols()), key)
    out = ["basename", "x", "y", "limit2", "c_id", "c_x", "c_y", "c_label"]
    pairs = (
        through_base.select(*out).unionByName(through_fine.select(*out))
        .withColumn("d2", _dist2())
        .filter(F.col("d2") <= F.col("limit2"))
    )
    return _nearest(pairs, ["basename", "x", "y"], k)


def knn_edges(
    cells: DataFrame, k: int = 16, label: str | None = None, edge_type: str = "knn", expand: bool = True,
) -> DataFrame:
    """Directed edges from every cell to its k nearest cells of the same core, itself excluded.

    Ties are broken by the smaller id; a core of n cells gives min(k, n - 1) edges per
    cell. With ``label`` the edges carry the label of both ends. The bucketed points and the
    result of the first pass are written once, since several branches read them.

    ``expand=False`` gives the graph as lists of neighbours, in pieces of a part of a core (:mod:`.lists`), without
    labels: :func:`knn_features` takes it in place of edges.
    """
    if k < 1:
        raise ValueError("k must be positive")
    require(cells, ["basename", "cell_id", "centroid_x", "centroid_y"])
    points = stored(_points(cells, label))
    near = _reachable(points, k)
    grid = _grid(near.filter("__rn = 1"), k)
    near = stored(dealt(_bucketed(near, grid), "basename", "x", "y"))
    spots = near.filter("__rn = 1").drop("__rn", "cell_id", "label")
    tiles = near.groupBy("basename", "bx", "by").agg(
        F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1", "g")]
    )
    crowded = tiles.filter(F.col("n") > CROWDED)

    first = stored(_first_pass(spots, near, crowded, k))
    found = first.filter("complete").select("basename", "x", "y", "nb")
    # what the first pass left open, and the surroundings of crowded buckets that it didn't search
    zone = _around(crowded.select("basename", "bx", "by"), 1).distinct()
    rest = first.filter(~F.col("complete")).select(*spots.columns).unionByName(spots.join(zone, ["basename", "bx", "by"], "left_semi"))
    if not rest.isEmpty():
        found = found.unionByName(_second_pass(rest, near, tiles, crowded, k))

    # plain arrays are sent with less than arrays of rows
    found = found.select("basename", "x", "y", *[F.col(f"nb.{c}").alias(f"{c}s") for c in ("d2", "id", "label")])
    met = points.join(found, ["basename", "x", "y"])
    if not expand:
        origin = near.groupBy("basename").agg(*[F.first(c).alias(c) for c in ("g", "x0", "y0")])
        return neighbour_lists(met, origin, k)
    others = F.slice(F.filter(F.arrays_zip("d2s", "ids", "labels"), lambda e: e["ids"] != F.col("cell_id")), 1, k)
    listed = met.select(
        "basename", F.col("cell_id").alias("src_cell_id"), F.col("label").alias("src_phenotype"),
        F.posexplode(others).alias("rank0", "e"),
    )
    return listed.select(
        "basename", "src_cell_id", F.col("e.ids").alias("dst_cell_id"),
        "src_phenotype", F.col("e.labels").alias("dst_phenotype"),
        F.sqrt("e.d2s").alias("distance_px"), F.lit(edge_type).alias("edge_type"),
        (F.col("rank0") + 1).alias("rank"),
    )


def rank_neighbours(edges: DataFrame) -> DataFrame:
    """Rank of every edge among those of its source, by distance, then id.

    A source's edges are at most as many as its neighbours. A graph in tiles (:func:`radius_edges`) is ranked where
    its edges are made, so that they are not sorted again.
    """
    w = Window.partitionBy("basename", "src_cell_id").orderBy("distance_px", "dst_cell_id")
    if not is_tiled(edges):
        return edges.withColumn("rank", F.row_number().over(w))
    note = edges.schema["own"].metadata
    by_window = lambda e: e.withColumn("rank", F.row_number().over(w))
    # the edges of an id that comes twice meet in a window, as do those of a tile too large for a task
    key = ["basename", "cell_id"]
    twice = cut(edges.where("own").groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > 1).select(*key))
    if twice.isEmpty():
        return expanded(edges, by_window)
    marked = edges.join(twice.withColumn("__twice", F.lit(True)), key, "left").withColumn("__twice", F.coalesce("__twice", F.lit(False)))
    single, several = (
        marked.withColumn("own", (F.col("own") & which).alias("own", metadata=note)).drop("__twice")
        for which in (~F.col("__twice"), F.col("__twice"))
    )
    return expanded(single, by_window).unionByName(by_window(expanded(several)))


def label_pairs(edges: DataFrame) -> DataFrame:
    """The pairs of labels that edges join, each once.

    A graph in tiles (:func:`radius_edges`) tells them from the labels around its cells, so that its edges are not made.
    """
    ends = ["src_phenotype", "dst_phenotype"]
    if not is_tiled(edges):
        return edges.select(*ends).distinct()
    note = edges.schema["own"].metadata
    crowded = crowded_tiles(edges)
    if crowded is None:
        return label_pair_tiles(edges, note["radius"]).distinct()
    calm = label_pair_tiles(edges.join(crowded, list(KEY), "left_anti"), note["radius"])
    return calm.unionByName(_bucket_pairs(edges.join(crowded, list(KEY)), note["radius"]).select(*ends)).distinct()


def is_tiled(edges: DataFrame) -> bool:
    """Whether the table is a radius graph in tiles in place of edges."""
    return "own" in edges.columns


def expanded(tiled: DataFrame, rank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The edges of a graph in tiles, those of crowded tiles by a join of buckets; with their rank if ``rank`` is given,
    which ranks the joined ones."""
    note = tiled.schema["own"].metadata
    crowded = crowded_tiles(tiled)
    if crowded is None:
        edges = pair_tiles(tiled, note["radius"], rank is not None)
    else:
        edges = pair_tiles(tiled.join(crowded, list(KEY), "left_anti"), note["radius"], rank is not None)
        joined = _bucket_pairs(tiled.join(crowded, list(KEY)), note["radius"])
        edges = edges.unionByName(rank(joined) if rank else joined)
    return edges.withColumn("edge_type", F.lit(note["edge_type"]))


def _bucket_pairs(tiled: DataFrame, radius: float) -> DataFrame:
    """Edges of large tiles: an equi-join of each bucket with the 3x3 block around it; a crowded bucket is split by
    the adaptive skew join."""
    points = tiled.withColumns({
        "bx": F.floor(F.col("x") / F.lit(radius)), "by": F.floor(F.col("y") / F.lit(radius)),
    })
    candidates = _around(points.select(*KEY, "bx", "by", *_candidate_cols()), 1)
    return (
        points.where("own").join(candidates, [*KEY, "bx", "by"])
        .withColumn("d2", _dist2())
        .filter((F.col("d2") <= F.lit(radius ** 2)) & (F.col("cell_id") != F.col("c_id")))
        .select(
            "basename", F.col("cell_id").alias("src_cell_id"), F.col("c_id").alias("dst_cell_id"),
            F.col("label").alias("src_phenotype"), F.col("c_label").alias("dst_phenotype"),
            F.sqrt("d2").alias("distance_px"),
        )
    )


def radius_edges(
    cells: DataFrame, radius: float = 98.0, label: str | None = None, edge_type: str = "radius", expand: bool = True,
) -> DataFrame:
    """All ordered pairs of cells of a core within ``radius`` (inclusive), itself excluded.

    Cells go to the tiles they can matter to, and pairs are made there (:mod:`cellframe.operators.spatial.tiles`).
    ``expand=False`` gives the graph in tiles, before its pairs are made: its rows grow with the cells, and
    :func:`rank_neighbours`, :func:`label_pairs` and :func:`~cellframe.operators.joins.annotate_edges` take it in place of edges.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    tiled = members(_points(cells, label), float(radius))
    note = {"radius": float(radius), "edge_type": edge_type}
    tiled = tiled.withColumn("own", F.col("own").alias("own", metadata=note))
    return expanded(tiled) if expand else tiled


def neighbour_edges(
    cells: DataFrame, method: str = "knn", k: int = 16, radius: float = 98.0, label: str | None = None
) -> DataFrame:
    if method == "knn":
        return knn_edges(cells, k, label).drop("rank")
    if method == "radius":
        return radius_edges(cells, radius, label)
    raise ValueError(f"unknown method: {method!r}")


FEATURES = ("mean", "std", "posfrac", "density")


def pairs_by_cell(edges: DataFrame, values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The edges with the values of their far end, dealt out by their source.

    The sums begun for a pair are many times wider than its values, so the pairs of a cell meet first.
    """
    far = values.select("basename", F.col("cell_id").alias("dst_cell_id"), *columns)
    pairs = edges.select("basename", "src_cell_id", "dst_cell_id", "distance_px", "rank").join(far, ["basename", "dst_cell_id"])
    return pairs.drop("dst_cell_id").repartition("basename", "src_cell_id")


def knn_features(
    df: DataFrame, ks: Sequence[int], features: Sequence[str], taus: dict[int, float],
    channels: Sequence[int], pred: str = "ch{:02d}_pred", edges: DataFrame | None = None,
) -> DataFrame:
    """Neighbourhood features per cell for several k from one graph at the largest k.

    Mean, population deviation and share above the cut of every channel's prediction
    over the k nearest cells, and the mean of 1 / (distance + 1). A cell without
    neighbours takes the mean over all cells.
    """
    from cellframe.operators.normalize import global_fill

    ks = sorted(set(int(k) for k in ks))
    if not ks:
        return df
    if ks[0] < 1:
        raise ValueError("neighborhood k must be positive")
    unknown = set(features) - set(FEATURES)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    if edges is None:
        edges = knn_edges(df, ks[-1], expand=False)
    values = df.select(
        "basename", "cell_id", *[F.col(pred.format(c)).cast("double").alias(f"__p_{c}") for c in channels],
    )
    aggs: dict[str, Column] = {}
    for k in ks:
        near = F.col("rank") <= k
        for c in channels:
            v = F.col(f"__p_{c}")
            if "mean" in features:
                aggs[f"nbr{k}_ch{c:02d}_pred_mean"] = F.avg(F.when(near, v))
            if "std" in features:
                aggs[f"nbr{k}_ch{c:02d}_pred_std"] = F.stddev_pop(F.when(near, v))
            if "posfrac" in features:
                aggs[f"nbr{k}_ch{c:02d}_posfrac"] = F.avg(
                    F.when(near, (v > F.lit(float(taus[c]))).cast("double"))
                )
        if "density" in features:
            aggs[f"nbr{k}_density"] = F.avg(F.when(near, F.lit(1.0) / (F.col("distance_px") + F.lit(1.0))))

    def joined(rows: DataFrame) -> DataFrame:
        pairs = pairs_by_cell(rows, values, [f"__p_{c}" for c in channels])
        return pairs.groupBy("basename", F.col("src_cell_id").alias("cell_id")).agg(*[c.alias(n) for n, c in aggs.items()])

    if not is_listed(edges):
        per_cell = joined(edges)
    else:
        cuts = [float(taus[c]) if "posfrac" in features else 0.0 for c in channels]
        per_cell = list_features(edges, values, ks, features, cuts, list(aggs))
        # the lists of an id that comes twice are one cell's, wherever they lie
        twice = edges.where("twice")
        if not twice.isEmpty():
            per_cell = per_cell.unionByName(joined(listed_edges(twice)))
    # the overall means and the result both read the features
    per_cell = stored(per_cell)
    return global_fill(df.join(per_cell, ["basename", "cell_id"], "left"), list(aggs), per_cell)


def feature_columns(ks: Sequence[int], features: Sequence[str], channels: Sequence[int]) -> list[str]:
    """Names of the columns :func:`knn_features` adds, in order."""
    out = []
    for k in sorted(set(ks)):
        for c in channels:
            if "mean" in features:
                out.append(f"nbr{k}_ch{c:02d}_pred_mean")
            if "std" in features:
                out.append(f"nbr{k}_ch{c:02d}_pred_std")
            if "posfrac" in features:
                out.append(f"nbr{k}_ch{c:02d}_posfrac")
        if "density" in features:
            out.append(f"nbr{k}_density")
    return out
