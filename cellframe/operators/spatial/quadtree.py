"""Label counts within a radius, without an edge list.

Cells are counted tile by tile (:mod:`cellframe.operators.spatial.tiles`); the tree below is for the tiles that hold too
many cells for one task.

The spots of a core (cells on one place are one, with the count of every label) make a quad-tree: squares of the radius'
size, each split in four while it holds more than LEAF_SPOTS spots. A node knows the box its spots fill and the count of
every label in it. Pairs of nodes descend together from adjacent squares: if the boxes are wholly within the radius of
each other, every cell of one has all cells of the other as neighbours, whose counts are added as a whole; if they are
wholly beyond it, the pair goes; else the split ones among the two are replaced by their children. Only pairs of leaves
on the border of the radius compare spots. The rows grow with the length of that border, not with the pairs within.

Results are exact: box distances are made by the same monotone arithmetic as those of cells, so a box decides nothing
that a cell wouldn't.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.operators.spatial.knn import _points
from cellframe.operators.spatial.tiles import KEY, count_tiles, crowded_tiles, members
from cellframe.session import cut

#: Spots from which a node is split, and the depth at which it no longer is.
LEAF_SPOTS, MAX_LEVEL = 16, 24
NODE = ("level", "ix", "iy")
BOX = ("x0", "x1", "y0", "y1", "split")


def _counts(labels: Sequence[str]) -> list[str]:
    return ["n", *[f"n{i}" for i in range(len(labels))]]


def _spots(points: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row a place with the number of its cells, of all and of every label."""
    return points.groupBy("basename", "x", "y").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("label") == label).alias(f"n{i}") for i, label in enumerate(labels)])


def _tree(spots: DataFrame, radius: float, counts: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each level, and all spots with their leaf."""
    rest, levels, leaves = spots, [], []
    for level in range(MAX_LEVEL + 1):
        # scaling by a power of two is exact, so a node lies in one node of the level above
        keyed = rest.withColumns({
            "level": F.lit(level), **{i: F.floor(F.col(c) / F.lit(radius) * F.lit(float(1 << level))) for i, c in (("ix", "x"), ("iy", "y"))}})
        nodes = cut(keyed.groupBy("basename", *NODE).agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
            ((F.count("*") > LEAF_SPOTS) & F.lit(level < MAX_LEVEL)).alias("split"), *[F.sum(c).alias(c) for c in counts]))
        levels.append(nodes)
        if nodes.where("split").isEmpty():
            leaves.append(keyed)
            break
        marked = cut(keyed.join(nodes.select("basename", *NODE, "split"), ["basename", *NODE]))
        leaves.append(marked.where(~F.col("split")).select(keyed.columns))
        rest = marked.where("split").select(spots.columns)
    return levels, reduce(DataFrame.union, leaves)


def _far2(near: bool) -> Column:
    """Square of the largest (or smallest) distance between the boxes a and b."""
    total = F.lit(0.0)
    for lo, hi in (("x0", "x1"), ("y0", "y1")):
        one, other = F.col(f"b.{hi}") - F.col(f"a.{lo}"), F.col(f"a.{hi}") - F.col(f"b.{lo}")
        d = F.greatest(F.lit(0.0), -one, -other) if near else F.greatest(one, other)
        total = total + d * d
    return total


def _expand(pairs: DataFrame, side: str, children: DataFrame) -> DataFrame:
    """Pairs with the given side's children in its place, where it is split."""
    whole = pairs.where(~F.col(f"{side}.split"))
    split = pairs.where(f"{side}.split").withColumns({f"_{k}": F.col(f"{side}.{k}") for k in NODE}).drop(side)
    met = split.join(children, ["basename", *[f"_{k}" for k in NODE]]).withColumnRenamed("child", side)
    return whole.unionByName(met.select(pairs.columns))


def _descend(levels: Sequence[DataFrame], radius: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """Pairs of nodes wholly within the radius, and pairs of leaves that its border may cross."""
    node = F.struct(*NODE, *BOX)
    top = levels[0].select("basename", "ix", "iy", node.alias("a"))
    steps = F.inline(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = levels[0].select("basename", "ix", "iy", node.alias("b"), steps).select("basename", (F.col("ix") + F.col("dx")).alias("ix"), (F.col("iy") + F.col("dy")).alias("iy"), "b")
    pairs = top.join(around, ["basename", "ix", "iy"]).select("basename", "a", "b")
    inside, border = [], []
    children = None
    if len(levels) > 1:
        below = reduce(DataFrame.union, levels[1:])
        up = [(F.col("level") - 1).alias("_level"), F.expr("ix >> 1").alias("_ix"), F.expr("iy >> 1").alias("_iy")]
        children = below.select("basename", *up, node.alias("child"))
    limit = F.lit(radius * radius)
    for depth in range(len(levels)):
        judged = pairs.where(_far2(True) <= limit).withColumn("within", _far2(False) <= limit)
        if depth < len(levels) - 1:
            judged = cut(judged)
        inside.append(judged.where("within").drop("within"))
        open_ = judged.where(~F.col("within")).drop("within")
        border.append(open_.where(~F.col("a.split") & ~F.col("b.split")))
        if children is None:
            break
        pairs = _expand(_expand(open_.where("a.split or b.split"), "a", children), "b", children)
    return inside, border


def _summed(rows: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def _whole_counts(levels: Sequence[DataFrame], inside: Sequence[DataFrame], counts: Sequence[str]) -> DataFrame:
    """Per node: the counts of all nodes that are wholly near it or a node above it."""
    keys = ["basename", *NODE]
    nodes = reduce(DataFrame.union, levels)
    pairs = reduce(DataFrame.union, inside).select("basename", *[F.col(f"b.{k}").alias(k) for k in NODE], *[F.col(f"a.{k}").alias(f"_{k}") for k in NODE])
    own = pairs.join(nodes.select(*keys, *counts), keys).drop(*NODE).withColumnsRenamed({f"_{k}": k for k in NODE})
    own = _summed(own, keys, counts)
    if len(levels) == 1:
        return own
    own = cut(own)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out, above = [], None
    for nodes in levels:
        here = nodes.select(*keys).join(own, keys, "left")
        if above is not None:
            up = above.select("basename", (F.col("level") + 1).alias("level"), F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), *[F.col(c).alias(f"_{c}") for c in counts])
            here = here.withColumns({"_ix": F.expr("ix >> 1"), "_iy": F.expr("iy >> 1")}).join(up, ["basename", "level", "_ix", "_iy"])
            here = here.select(*keys, *[(zero(F.col(c)) + F.col(f"_{c}")).alias(c) for c in counts])
        else:
            here = here.select(*keys, *[zero(F.col(c)).alias(c) for c in counts])
        above = here
        out.append(here)
    return reduce(DataFrame.union, out)


def _border_counts(leaves: DataFrame, border: Sequence[DataFrame], radius: float, counts: Sequence[str]) -> DataFrame:
    """Per spot: the counts of the spots within the radius in leaves that its border crosses."""
    keys = ["basename", *NODE]
    pairs = reduce(DataFrame.union, border).select("basename", *[F.col(f"a.{k}").alias(k) for k in NODE], *[F.col(f"b.{k}").alias(f"_{k}") for k in NODE])
    asking = pairs.join(leaves.select(*keys, "x", "y"), keys).drop(*NODE).withColumnsRenamed({f"_{k}": k for k in NODE})
    met = asking.join(leaves.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"), *counts), keys)
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    return _summed(met.where(dx * dx + dy * dy <= F.lit(radius * radius)), ["basename", "x", "y"], counts)


def radius_counts(cells: DataFrame, radius: float, label: str, labels: Sequence[str]) -> DataFrame:
    """Per cell with a neighbour within ``radius`` (inclusive): its label, n_neighbors and local_count_<label> of every label.

    Cells without coordinates are left out; a label that isn't listed counts among the neighbours alone. Ids are unique
    in their core.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    radius = float(radius)
    tiled = members(_points(cells, label), radius)
    crowded = crowded_tiles(tiled)
    if crowded is None:
        found = count_tiles(tiled, radius, labels)
    else:
        calm = count_tiles(tiled.join(crowded, list(KEY), "left_anti"), radius, labels)
        found = calm.unionByName(_tree_counts(tiled.join(crowded, list(KEY)), radius, labels))
    # a cell counts itself once, on whichever way its own spot was met
    own = [F.coalesce((F.col("label") == name).cast("long"), F.lit(0)) for name in labels]
    return found.select(
        "basename", F.col("cell_id").alias("src_cell_id"), F.col("label").alias("src_phenotype"), (F.col("n") - 1).alias("n_neighbors"),
        *[(F.col(f"n{i}") - mine).alias(f"local_count_{name}") for i, (name, mine) in enumerate(zip(labels, own))],
    ).where("n_neighbors > 0")


def _tree_counts(tiled: DataFrame, radius: float, labels: Sequence[str]) -> DataFrame:
    """What :func:`count_tiles` gives, by a tree of every tile."""
    counts = _counts(labels)
    points = tiled.withColumn("basename", F.struct(*KEY))
    levels, leaves = _tree(_spots(points, labels), radius, counts)
    leaves = cut(leaves)
    inside, border = _descend(levels, radius)
    whole = _whole_counts(levels, inside, counts).withColumnsRenamed({c: f"_w_{c}" for c in counts})
    single = _border_counts(leaves, border, radius, counts).withColumnsRenamed({c: f"_b_{c}" for c in counts})
    found = leaves.select("basename", *NODE, "x", "y").join(whole, ["basename", *NODE], "left").join(single, ["basename", "x", "y"], "left")
    total = lambda c: F.coalesce(f"_w_{c}", F.lit(0)) + F.coalesce(f"_b_{c}", F.lit(0))
    around = points.where("own").join(found.select("basename", "x", "y", *[total(c).alias(c) for c in counts]), ["basename", "x", "y"])
    return around.select("basename.basename", "cell_id", "label", *counts)
