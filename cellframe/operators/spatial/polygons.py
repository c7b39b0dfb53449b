"""Point-in-polygon lookup and ring helpers over nested ring arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def ring_bbox(polys: DataFrame, ring: str) -> DataFrame:
    """Bounding box of a ring as ``min_x, min_y, max_x, max_y``."""
    xs = F.transform(ring, lambda p: p[0])
    ys = F.transform(ring, lambda p: p[1])
    return polys.withColumns({
        "min_x": F.array_min(xs), "min_y": F.array_min(ys),
        "max_x": F.array_max(xs), "max_y": F.array_max(ys),
    })


def inside_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting over the edges of a ring, closed or not."""
    previous = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1))
    edges = F.arrays_zip(ring.alias("p"), previous.alias("q"))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        straddles = (p[1] > y) != (q[1] > y)
        at = (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1] + F.lit(1e-12)) + p[0]
        return straddles & (x < at)

    return F.when(
        F.size(ring) > 0,
        F.aggregate(edges, F.lit(False), lambda acc, e: F.when(crosses(e), ~acc).otherwise(acc)),
    ).otherwise(F.lit(False))


def points_in_polygons(
    points: DataFrame, polys: DataFrame, ring: str = "expanded_xy", order: str = "cell_id",
    point_key: str = "point_id",
) -> DataFrame:
    """For every point the first polygon, by ``order``, of its core that contains it.

    ``points`` has ``basename``, ``point_key``, ``x``, ``y``. A polygon is filed under the
    power of two that covers its box, so it meets at most four buckets of that size; a
    point looks into one bucket per size in use in its core. Points outside every
    polygon are not returned.
    """
    boxed = ring_bbox(polys.select("basename", F.col(order).alias("__id"), F.col(ring).alias("__ring")), "__ring")
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(2.0**-20))
    filed = boxed.withColumn("lvl", F.ceil(F.log2(side)).cast("int"))

    def bucket(c: str) -> Column:
        return F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("lvl")))

    filed = filed.withColumn("bx", F.explode(F.sequence(bucket("min_x"), bucket("max_x")))).withColumn(
        "by", F.explode(F.sequence(bucket("min_y"), bucket("max_y")))
    )
    # at most some sixty sizes per core
    levels = filed.groupBy("basename").agg(F.collect_set("lvl").alias("__lvls"))
    looked = (
        points.select("basename", point_key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        .join(levels, "basename")
        .withColumn("lvl", F.explode("__lvls"))
    )
    looked = looked.withColumns({"bx": bucket("x"), "by": bucket("y")}).drop("__lvls")
    x, y = F.col("x"), F.col("y")
    hits = looked.join(filed, ["basename", "lvl", "bx", "by"]).filter(
        (x >= F.col("min_x")) & (x <= F.col("max_x")) & (y >= F.col("min_y")) & (y <= F.col("max_y"))
    ).filter(inside_ring(F.col("__ring"), x, y))
    return hits.groupBy("basename", point_key).agg(F.min("__id").alias("polygon_id"))


def cap_ring(
    polys: DataFrame, ring: str, height: Column, width: Column, max_vertices: int | None = None
) -> DataFrame:
    """Clamp a closed ring to the image and close it again.

    With ``max_vertices``, a longer ring is thinned evenly around its whole outline.

    Adds ``n_verts``, ``degenerate`` (fewer than three distinct vertices) and the
    sorted, comma-separated ``flags``.
    """
    from cellframe.operators.joins import close_ring

    r = F.col(ring)

    def clamp(p: Column) -> Column:
        return F.array(
            F.greatest(F.lit(0.0), F.least(p[0], width - 1)).cast("double"),
            F.greatest(F.lit(0.0), F.least(p[1], height - 1)).cast("double"),
        )

    border = F.exists(r, lambda p: (p[0] < 0) | (p[1] < 0) | (p[0] > width - 1) | (p[1] > height - 1))
    out = polys.withColumn("__border", border).withColumn("__r", close_ring(F.transform(r, clamp)))
    n = F.size("__r") - 1
    if max_vertices is None:
        out = out.withColumn("__truncated", F.lit(False))
    else:
        every = F.transform(
            F.sequence(F.lit(0), F.lit(max_vertices - 1)),
            lambda i: F.get(F.col("__r"), F.floor(i * n / F.lit(max_vertices)).cast("int")),
        )
        out = out.withColumn("__truncated", n > max_vertices).withColumn(
            "__r", F.when(n > max_vertices, F.concat(every, F.slice("__r", 1, 1))).otherwise(F.col("__r"))
        )
    # all vertices are the first one or the first that differs from it: linear, unlike counting distinct ones
    out = out.withColumn("__one", F.get("__r", F.lit(0)))
    out = out.withColumn("__two", F.get(F.filter("__r", lambda p: ~p.eqNullSafe(F.col("__one"))), F.lit(0)))
    degenerate = ~F.exists("__r", lambda p: ~p.eqNullSafe(F.col("__one")) & ~p.eqNullSafe(F.col("__two")))
    flags = F.array(
        F.when(F.col("__border"), F.lit("border")), F.when(degenerate, F.lit("degenerate")),
        F.when(F.col("__truncated"), F.lit("truncated")),
    )
    return out.withColumns({
        "n_verts": F.greatest(F.size("__r") - 1, F.lit(0)), "degenerate": degenerate,
        "flags": F.array_join(F.array_sort(F.array_compact(flags)), ","), ring: F.col("__r"),
    }).drop("__r", "__border", "__truncated", "__one", "__two")
