"""Pixel, region and tile tables.

A pixel table has one row per pixel: ``basename, y, x`` with a ``label`` (0 is
background) or ``channel`` and ``value``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.expr import clip
from cellframe.functions.running import group_quantiles, tie_quantiles, tie_totals
from cellframe.session import cut

TINY_AREA = 4
TILE_SIZE = 256
TILE_OVERLAP = 1


def region_properties(pixels: DataFrame) -> DataFrame:
    """Area, centroid and half-open bounding box per labelled region."""
    return pixels.filter(F.col("label") > 0).groupBy("basename", "label").agg(
        F.count("*").alias("area"),
        F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"),
        F.min("y").alias("min_y"), F.min("x").alias("min_x"),
        (F.max("y") + 1).alias("max_y"), (F.max("x") + 1).alias("max_x"),
    )


def filter_regions(regions: DataFrame, minimum: int, maximum: int) -> DataFrame:
    """Regions in the area range with consecutive new labels per core, in label order.

    Labels are ranked inside blocks of 4096 and offset by the sizes of the blocks
    before, so a large core is not ordered in one task.
    """
    kept = regions.filter(F.col("area").between(minimum, maximum)).withColumn(
        "__block", F.floor(F.col("label") / 4096)
    )
    sizes = kept.groupBy("basename", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("basename").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("basename", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inner = Window.partitionBy("basename", "__block").orderBy("label")
    return (
        kept.join(offsets, ["basename", "__block"])
        .withColumn("new_label", F.row_number().over(inner) + F.col("__o"))
        .drop("__block", "__o")
    )


def mask_summary(regions: DataFrame) -> DataFrame:
    """Regions per core with mean, median, 5th and 95th percentile of the area."""
    # the regions are read once: mean and quantiles come from the count of every area
    ties = cut(tie_totals(regions, ["basename"], "area", {"n": F.lit(1)}))
    stats = ties.groupBy("basename").agg((F.sum(F.col("area") * F.col("n")) / F.sum("n")).alias("mean_area"))
    quantiles = tie_quantiles(ties, ["basename"], "area", {"median_area": 0.5, "p05_area": 0.05, "p95_area": 0.95})
    return quantiles.join(stats, "basename").select(
        "basename", F.col("n").alias("n_regions"), "mean_area", "median_area", "p05_area", "p95_area"
    )


def assert_nucleus_subset(nuclei: DataFrame, expanded: DataFrame) -> DataFrame:
    """Nucleus labels without an expanded region; empty when the masks agree."""
    def labels(df: DataFrame) -> DataFrame:
        return df.filter(F.col("label") > 0).select("basename", "label").distinct()

    return labels(nuclei).join(labels(expanded), ["basename", "label"], "left_anti")


def ring_compartment(expanded: DataFrame, nuclei: DataFrame, tile: Sequence[str] = ()) -> DataFrame:
    """Pixels of the expanded mask that belong to no nucleus.

    ``tile`` are columns of both masks that follow from a pixel's place; masks that are dealt out alike by core and tile
    meet where they are. Neither is joined: Spark broadcasts a mask whose cells are few bytes on disk, whatever its pixels.
    """
    key = ["basename", *tile, "y", "x"]
    inner = nuclei.filter(F.col("label") > 0).select(*key, F.lit(True).alias("__nucleus"))
    both = expanded.filter(F.col("label") > 0).withColumn("__nucleus", F.lit(False)).unionByName(inner, allowMissingColumns=True)
    # an unknown place is the place of no nucleus
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    covered = both.withColumn("__covered", F.max("__nucleus").over(Window.partitionBy(*key)) & known)
    return covered.filter(~F.col("__nucleus") & ~F.col("__covered")).select(*expanded.columns)


def classify_skips(cells: DataFrame, nuclei: DataFrame, expanded: DataFrame) -> DataFrame:
    """Every cell with the reason it gets no polygon, or null: ``out_of_mask``, ``tiny`` or ``empty``.

    ``nuclei`` and ``expanded`` are region tables with ``label`` and ``area``, and
    optionally ``has_contour``.
    """
    def areas(df: DataFrame, name: str) -> DataFrame:
        contour = F.col("has_contour") if "has_contour" in df.columns else F.lit(True)
        return df.select(
            "basename", F.col("label").alias("cell_id"), F.col("area").cast("double").alias(f"area_{name}_px"),
            contour.alias(f"__c_{name}"),
        )

    key = ["basename", "cell_id"]
    joined = cells.select(*key).join(areas(nuclei, "nucleus"), key, "left").join(
        areas(expanded, "expanded"), key, "left"
    )
    reason = (
        F.when(F.col("area_nucleus_px").isNull() | F.col("area_expanded_px").isNull(), "out_of_mask")
        .when(F.col("area_nucleus_px") <= TINY_AREA, "tiny")
        .when(~(F.col("__c_nucleus") & F.col("__c_expanded")), "empty")
    )
    return joined.select(
        *key, reason.alias("reason"),
        F.coalesce("area_nucleus_px", F.lit(0.0)).alias("area_nucleus_px"),
        F.coalesce("area_expanded_px", F.lit(0.0)).alias("area_expanded_px"),
    )


def nonzero_window_rescale(
    pixels: DataFrame, low: float, high: float, by: Sequence[str] = ("basename", "channel")
) -> DataFrame:
    """Rescale to 0-255 between two percentiles of the nonzero pixels of each image channel.

    A flat channel maps nonzero pixels to 255, an all-zero channel stays 0.
    """
    lit_pixels = pixels.filter(F.col("value") > 0)
    window = group_quantiles(lit_pixels, by, "value", {"p_low": low / 100.0, "p_high": high / 100.0}).drop("n")
    v, span = F.col("value").cast("double"), F.col("p_high") - F.col("p_low")
    inside = F.greatest(F.least(v, F.col("p_high")), F.col("p_low"))
    scaled = F.floor((inside - F.col("p_low")) / span * F.lit(255.0) + F.lit(0.5)).cast("int")
    flat = F.when(v > 0, F.lit(255)).otherwise(F.lit(0))
    return pixels.join(window, list(by), "left").withColumn(
        "rescaled", F.when(span.isNull(), F.lit(0)).when(span <= 0, flat).otherwise(scaled)
    ).withColumns({"p_low": F.coalesce("p_low", F.lit(0.0)), "p_high": F.coalesce("p_high", F.lit(0.0))})


def core_norm(pixels: DataFrame, stride: int = 1) -> DataFrame:
    """99.9th percentile per core over all pixels, or over those of a stride grid; at least 1e-6."""
    sample = pixels if stride == 1 else pixels.filter((F.col("y") % stride == 0) & (F.col("x") % stride == 0))
    return group_quantiles(sample, ["basename"], "value", {"norm": 0.999}).select(
        "basename", F.greatest("norm", F.lit(1e-6)).alias("norm")
    )


def percentile_window(
    pixels: DataFrame, low: float = 0.005, high: float = 0.998, by: Sequence[str] = ("basename",)
) -> DataFrame:
    """Normalise to [0, 1] between two quantiles, between minimum and maximum if those are equal."""
    stats = group_quantiles(pixels, by, "value", {"lo": low, "hi": high, "mn": 0.0, "mx": 1.0}).drop("n")
    degenerate = F.col("hi") <= F.col("lo")
    lo = F.when(degenerate, F.col("mn")).otherwise(F.col("lo"))
    hi = F.when(degenerate, F.col("mx")).otherwise(F.col("hi"))
    stats = stats.select(*by, lo.alias("__lo"), hi.alias("__hi"))
    position = F.try_divide(F.col("value").cast("double") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    return pixels.join(stats, list(by)).withColumn(
        "normalized", clip(F.coalesce(position, F.lit(0.0)), 0.0, 1.0)
    ).drop("__lo", "__hi")


def _origins(extent: Column, size: int, stride: int) -> Column:
    last = F.greatest(extent - size, F.lit(1))
    return F.when(extent <= size, F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(stride).cast("long"))
    )


def tile_grid(cores: DataFrame, size: int, stride: int) -> DataFrame:
    """Tile origins per core; an image not larger than a tile gets one."""
    if size <= 0 or stride <= 0:
        raise ValueError("tile size and stride must be positive")
    return cores.select(
        "basename", F.explode(_origins(F.col("height"), size, stride)).alias("y0"), "width"
    ).select("basename", "y0", F.explode(_origins(F.col("width"), size, stride)).alias("x0"))


def positive_tiles(
    pixels: DataFrame, thresholds: Mapping[object, float] | float, fraction: float,
    channel: object | None = None, center: int | None = None, size: int | None = None,
) -> DataFrame:
    """Tiles of which any channel (or the given one) exceeds its threshold in a large enough share.

    ``pixels`` has ``basename, tile_y, tile_x, channel, y, x, value`` with pixel
    coordinates inside the tile; ``center`` looks at the central square only.
    """
    rows = pixels if channel is None else pixels.filter(F.col("channel") == channel)
    if center is not None:
        if size is None:
            raise ValueError("the tile size is needed for a centre region")
        side = min(center, size)
        start = max(0, (size - side) // 2)
        rows = rows.filter(F.col("y").between(start, start + side - 1) & F.col("x").between(start, start + side - 1))
    if isinstance(thresholds, Mapping):
        cut = F.lit(None).cast("double")
        for c, t in thresholds.items():
            cut = F.when(F.col("channel") == c, F.lit(float(t))).otherwise(cut)
    else:
        cut = F.lit(float(thresholds))
    share = F.avg((F.col("value") > cut).cast("double"))
    per_channel = rows.groupBy("basename", "tile_y", "tile_x", "channel").agg(share.alias("share"))
    return per_channel.groupBy("basename", "tile_y", "tile_x").agg(
        F.bool_or(F.col("share") >= fraction).alias("positive"),
        F.max("share").alias("max_share"),
        F.max_by("channel", F.struct("share", "channel")).alias("channel"),
    )


def overlap_add(
    tiles: DataFrame, size: int, height: Column, width: Column, crop: int = 0,
    by: Sequence[str] = ("basename",), value: str = "value",
) -> DataFrame:
    """Blend overlapping tile predictions into one value per image pixel.

    ``tiles`` has one row per tile pixel: ``tile_y, tile_x`` (origin), ``y, x`` (inside
    the tile) and the value. Without ``crop`` a Hann window weights the pixels; with it
    only the tile's centre counts, except along the image border.
    """
    y, x = F.col("y"), F.col("x")
    gy, gx = F.col("tile_y") + y, F.col("tile_x") + x

    def hann(i: Column) -> Column:
        return F.lit(0.5) - F.lit(0.5) * F.cos(i * F.lit(2.0 * math.pi / max(size - 1, 1)))

    if crop > 0:
        if size - 2 * crop <= 0:
            raise ValueError("crop is too large for the tile size")

        def kept(i: Column, origin: Column, extent: Column) -> Column:
            low = F.when(origin == 0, F.lit(0)).otherwise(F.lit(crop))
            high = F.when(origin + size >= extent, F.lit(size)).otherwise(F.lit(size - crop))
            return (i >= low) & (i < high)

        keep = kept(y, F.col("tile_y"), height) & kept(x, F.col("tile_x"), width)
        weight = F.when(keep, F.lit(1.0)).otherwise(F.lit(0.0))
    else:
        weight = hann(y) * hann(x)
    placed = tiles.select(
        *by, gy.alias("__gy"), gx.alias("__gx"), weight.alias("__w"), F.col(value).cast("double").alias("__v"),
        (gy < height).alias("__iy"), (gx < width).alias("__ix"),
    ).filter("__iy and __ix")
    return placed.groupBy(*by, "__gy", "__gx").agg(
        (F.sum(F.col("__w") * F.col("__v")) / F.greatest(F.sum("__w"), F.lit(1e-6))).alias("value")
    ).withColumnsRenamed({"__gy": "y", "__gx": "x"})


def tile_pyramid(
    points: DataFrame, size: int = TILE_SIZE, overlap: int = TILE_OVERLAP, key: str = "cell_id"
) -> DataFrame:
    """Every pyramid tile a point falls into: ``level, col, row``.

    Level 0 is one pixel, the top level the full image of ``height`` x ``width``; each
    level halves the one above, tiles overlap by ``overlap`` pixels.
    """
    extent = F.greatest("height", "width")
    top = F.length(F.bin(extent.cast("long"))) - 1
    down = F.explode(F.sequence(F.lit(0), top)).alias("__s")
    levels = points.select("basename", key, "x", "y", "height", "width", top.alias("__top"), down)

    def at(c: str, side: str) -> tuple[Column, Column]:
        length = F.greatest(F.lit(1), F.floor(F.col(side) / F.pow(F.lit(2.0), F.col("__s"))))
        here = F.least(F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__s"))), length - 1)
        return here, F.ceil(length / F.lit(float(size)))

    def tiles_of(c: str, side: str) -> Column:
        here, count = at(c, side)
        first = F.greatest(F.floor((here - overlap) / F.lit(float(size))), F.lit(0))
        last = F.least(F.floor((here + overlap) / F.lit(float(size))), count - 1)
        return F.sequence(first, last)

    return (
        levels.select("basename", key, (F.col("__top") - F.col("__s")).alias("level"), "y", "height", "__s",
                      F.explode(tiles_of("x", "width")).alias("col"))
        .select("basename", key, "level", "col", F.explode(tiles_of("y", "height")).alias("row"))
    )


def dense_lattice(
    cores: DataFrame, swap_xy: bool = False, flip_rows: bool = False, flip_cols: bool = False,
    by: Sequence[str] = ("tma",),
) -> DataFrame:
    """Filled row and column lattice of ``row`` letters and ``col`` numbers per slide.

    Every slot has its letter and number, whether a core is there, and its grid indices
    after swapping and flipping. The rows and columns come from ``sequence``, not from a
    join of the cores with themselves.
    """
    span = cores.groupBy(*by).agg(
        F.min(F.ascii("row")).alias("__r0"), F.max(F.ascii("row")).alias("__r1"),
        F.min("col").cast("int").alias("__c0"), F.max("col").cast("int").alias("__c1"),
    )
    slots = span.select("*", F.explode(F.sequence("__r0", "__r1")).alias("__r")).select(
        "*", F.explode(F.sequence("__c0", "__c1")).alias("col")
    )
    i = F.col("__r") - F.col("__r0")
    j = F.col("col") - F.col("__c0")
    if flip_rows:
        i = F.col("__r1") - F.col("__r")
    if flip_cols:
        j = F.col("__c1") - F.col("col")
    gy, gx = (j, i) if swap_xy else (i, j)
    slots = slots.select(*by, F.chr(F.col("__r").cast("long")).alias("row"), "col", gy.alias("grid_y"), gx.alias("grid_x"))
    seen = cores.select(*by, "row", F.col("col").cast("int").alias("col")).distinct().withColumn("present", F.lit(True))
    return slots.join(seen, [*by, "row", "col"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def core_sort_key(core: str = "core") -> list[Column]:
    """Order columns that sort ``A-2`` before ``A-10``."""
    parts = F.split(F.col(core), "-", 2)
    return [parts[0], parts[1].cast("int")]


def core_sort(df: DataFrame, core: str = "core") -> DataFrame:
    return df.orderBy(*core_sort_key(core))
