"""Joins between the cell table and the tables around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.expr import fail_if_empty, nan_to_null, require, truthy
from cellframe.operators.rules import canonical_pred_cols, phenotype_calls, phenotype_scores, resolve_pred_cols
from cellframe.operators.spatial.knn import expanded, is_tiled
from cellframe.panel import CELL_KEY, DEFAULT_PANEL, MarkerPanel, Thresholds, ch, ph

KEY = list(CELL_KEY)


def attach_consensus(cells: DataFrame, consensus: DataFrame) -> DataFrame:
    """Left join on the cell key; the right side only contributes columns the cells lack."""
    new = [c for c in consensus.columns if c not in cells.columns]
    return cells.join(consensus.select(*KEY, *new), KEY, "left")


def unique_keys(df: DataFrame, keys: Sequence[str] = CELL_KEY) -> DataFrame:
    """The rows unchanged, with a run-time error if a key occurs twice."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct("*")).alias("__row"))
    message = F.concat_ws(" ", F.lit("duplicate key:"), *[F.col(k).cast("string") for k in keys])
    single = F.when(F.col("__n") == 1, F.col("__row")).otherwise(
        F.raise_error(message).cast(counts.schema["__row"].dataType)
    )
    return counts.select(single.alias("__row")).select("__row.*")


def merge_model(
    cells: DataFrame, preds: DataFrame, model: str, thr: Thresholds, panel: MarkerPanel = DEFAULT_PANEL
) -> DataFrame:
    """Add a model's predictions with derived phenotype scores and calls; replaces old columns.

    Cells the model does not cover keep nulls. Duplicate prediction keys are an error.
    """
    require(preds, KEY)
    require(cells, KEY)
    if not resolve_pred_cols(preds, model, panel):
        raise ValueError(f"no prediction columns for model {model!r}")
    sub = canonical_pred_cols(preds, model, panel)
    sub = sub.select(*KEY, *[c for c in (ch(k, "pred", model) for k in panel.channels) if c in sub.columns])
    sub = phenotype_calls(phenotype_scores(unique_keys(sub), model, panel), thr, model, panel)
    added = [c for c in sub.columns if c not in KEY]
    return cells.drop(*added).join(sub, KEY, "left")


def ordered_models(model_ids: Sequence[str], default: str | None = None) -> list[str]:
    """Distinct model ids with the default first."""
    ids = list(dict.fromkeys(model_ids))
    if default is None:
        return ids
    return [default] + [m for m in ids if m != default]


def add_models(
    cells: DataFrame, preds: Sequence[tuple[str, DataFrame]], thr: Thresholds,
    panel: MarkerPanel = DEFAULT_PANEL,
) -> DataFrame:
    for model, table in preds:
        cells = merge_model(cells, table, model, thr, panel)
    return cells


def core_summary(manifest: DataFrame, composition: DataFrame, model: str | None = None) -> DataFrame:
    """Manifest columns first, then the composition of the cores that have cells."""
    lead = ["basename", "tma", "core", "tissue", "split", "rigid_D_px"]
    joined = manifest.join(composition, "basename", "left")
    if model is not None:
        joined = joined.withColumn("model_id", F.lit(model))
    front = [c for c in [*lead, "n_cells", "model_id"] if c in joined.columns]
    return joined.select(*front, *[c for c in joined.columns if c not in front])


def close_ring(ring: Column) -> Column:
    """Append the first vertex where the last one differs from it.

    They count as equal within 1e-5 of the last one's coordinates, which is 0.02 pixels at 2,000: such a ring keeps its
    own last vertex.
    """
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    same = (F.abs(first[0] - last[0]) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(last[0])) & (
        F.abs(first[1] - last[1]) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(last[1])
    )
    return F.when((F.size(ring) == 0) | same, ring).otherwise(F.concat(ring, F.array(first)))


def cells_with_polygons(
    cells: DataFrame, polys: DataFrame, basename: str | None = None, ring: str = "expanded_xy"
) -> DataFrame:
    """Cells that have a polygon, with the ring closed as ``ring``.

    A single core is filtered on both sides before the join; a core without any match is an error.
    """
    if basename is not None:
        cells = cells.filter(F.col("basename") == basename)
        polys = polys.filter(F.col("basename") == basename)
    extra = [c for c in polys.columns if c not in KEY and c not in cells.columns]
    joined = cells.join(polys.select(*KEY, *extra), KEY)
    joined = joined.withColumn("ring", close_ring(F.col(ring)))
    if basename is None:
        return joined
    return fail_if_empty(joined, f"no cells with polygons in core {basename!r}")


def polygon_coverage(cells: DataFrame, polys: DataFrame, skips: DataFrame) -> DataFrame:
    """Violations of the bundle contract: duplicate polygons and cells in neither table."""
    duplicates = (
        polys.groupBy(*KEY).agg(F.count("*").alias("__n")).filter("__n > 1")
        .select(*KEY, F.lit("duplicate_polygon").alias("problem"))
    )
    covered = polys.select(*KEY).unionByName(skips.select(*KEY))
    uncovered = cells.select(*KEY).join(covered, KEY, "left_anti").select(
        *KEY, F.lit("missing_polygon").alias("problem")
    )
    return duplicates.unionByName(uncovered)


def annotate_edges(edges: DataFrame, cells: DataFrame, label: str = "dominant_phenotype") -> DataFrame:
    """Labels of both endpoints as ``src_phenotype`` and ``dst_phenotype``.

    A radius graph in tiles takes the labels to its cells before its edges are made, so edges are not joined.
    """
    if is_tiled(edges):
        named = cells.select(*KEY, F.col(label).cast("string").alias("label"))
        return expanded(edges.drop("label").join(named, KEY, "left"))
    look = cells.select("basename", F.col("cell_id"), F.col(label).cast("string").alias("__l"))
    out = edges.drop("src_phenotype", "dst_phenotype")
    for side in ("src", "dst"):
        named = look.withColumnsRenamed({"cell_id": f"{side}_cell_id", "__l": f"{side}_phenotype"})
        out = out.join(named, ["basename", f"{side}_cell_id"], "left")
    return out


def attach_features(
    cells: DataFrame, features: DataFrame, sets: Sequence[str] = ("global", "deep", "fine"),
    model: str | None = None, predictions: bool = True, core_mean: bool = True,
    panel: MarkerPanel = DEFAULT_PANEL, out: str = "x",
) -> DataFrame:
    """Concatenate cached vectors, predictions and core means per cell; cells without vectors drop out.

    The core means are taken over the kept cells.
    """
    from cellframe.operators.normalize import core_means

    columns = [f"feat_{s}" for s in sets]
    kept = cells.join(features.select(*KEY, *columns), KEY)
    preds = [ch(c, "pred", model) for c in panel.channels]
    if predictions or core_mean:
        require(cells, preds)
    pieces = [F.col(c).cast("array<float>") for c in columns]
    if predictions:
        pieces.append(F.array(*[F.col(c).cast("float") for c in preds]))
    if core_mean:
        means = {f"__cm_{i}": c for i, c in enumerate(preds)}
        kept = core_means(kept, means)
        pieces.append(F.array(*[F.col(m).cast("float") for m in means]))
    return kept.select(*KEY, F.concat(*pieces).alias(out))


def cell_detail(
    cells: DataFrame, polys: DataFrame, thr: Thresholds, model: str,
    basename: str | None = None, cell_id: int | None = None, panel: MarkerPanel = DEFAULT_PANEL,
) -> DataFrame:
    """One row per requested cell: morphology and nested marker and phenotype entries.

    Areas come from the polygon, else from the cell table, else 0. A missing cell is
    an error when one is asked for by key.
    """
    if basename is not None:
        cells = cells.filter(F.col("basename") == basename)
        polys = polys.filter(F.col("basename") == basename)
    if cell_id is not None:
        cells = cells.filter(F.col("cell_id") == int(cell_id))
        polys = polys.filter(F.col("cell_id") == int(cell_id))

    def opt(name: str, kind: str = "double") -> Column:
        return nan_to_null(F.col(name)) if name in cells.columns else F.lit(None).cast(kind)

    areas = polys.select(*KEY, *[
        F.col(f"area_{k}_px").cast("double").alias(f"__{k}") for k in ("nucleus", "expanded")
    ])
    markers = F.array(*[
        F.struct(
            F.lit(n).alias("name"), F.lit(c).alias("channel"),
            opt(ch(c, "pred", model)).alias("prob"),
            (truthy(F.col(ch(c, "pos"))) if ch(c, "pos") in cells.columns else F.lit(None).cast("boolean")).alias("truth"),
            F.lit(float(thr.marker[n])).alias("threshold"), F.lit(thr.stratum(n)).alias("confidence"),
        )
        for n, c in panel.pairs
    ])
    phenotypes = F.array(*[
        F.struct(
            F.lit(n).alias("name"), opt(ph(n, "score", model)).alias("score"),
            F.coalesce(opt(ph(n, "call", model)) > 0, F.lit(False)).alias("call"),
            F.lit(float(thr.phenotype[n])).alias("threshold"), F.lit(thr.stratum(n)).alias("confidence"),
        )
        for n in panel.phenotypes
    ])
    out = cells.join(areas, KEY, "left").select(
        *KEY, F.col("centroid_x").cast("double").alias("x"), F.col("centroid_y").cast("double").alias("y"),
        F.coalesce(F.col("__nucleus"), opt("area_nucleus_px"), F.lit(0.0)).alias("area_nucleus_px"),
        F.coalesce(F.col("__expanded"), opt("area_expanded_px"), F.lit(0.0)).alias("area_expanded_px"),
        F.coalesce(opt("eccentricity"), F.lit(0.0)).alias("eccentricity"),
        markers.alias("markers"), phenotypes.alias("phenotypes"),
    )
    if basename is None or cell_id is None:
        return out
    return fail_if_empty(out, f"cell not found: core={basename!r} cell_id={cell_id}")


def emit_labels(
    df: DataFrame, result: DataFrame, panel: MarkerPanel = DEFAULT_PANEL
) -> DataFrame:
    """Attach cluster id, z-scores, labels and phenotypes; cells of unlabelled cores get
    -1, NaN and False. A core labelled only in part is an error.

    ``result`` has the key, ``cluster_id_spacec`` and any of the ``_spacec`` columns.
    """
    added = [c for c in result.columns if c not in KEY]
    clash = sorted(set(added) & set(df.columns))
    if clash:
        raise ValueError(f"columns already present: {clash}")
    joined = df.join(result, KEY, "left")
    expected = df.groupBy("basename").agg(F.count("*").alias("__n"))
    found = result.groupBy("basename").agg(F.count("*").alias("__m"))
    ok = expected.join(found, "basename", "left").select(
        "basename",
        F.when(
            F.col("__m").isNull() | (F.col("__m") == F.col("__n")), F.lit(True)
        ).otherwise(
            F.raise_error(F.concat(F.lit("label count mismatch in core "), F.col("basename"))).cast("boolean")
        ).alias("__ok"),
    ).filter("__ok")
    joined = joined.join(ok.select("basename"), "basename", "left_semi")
    fills: dict[str, Column] = {}
    for name in added:
        kind = dict(result.dtypes)[name]
        if name.startswith("cluster_id"):
            fills[name] = F.coalesce(F.col(name), F.lit(-1).cast(kind))
        elif kind == "boolean":
            fills[name] = F.coalesce(F.col(name), F.lit(False))
        elif kind in ("float", "double"):
            fills[name] = F.coalesce(F.col(name), F.lit(float("nan")).cast(kind))
        elif kind in ("tinyint", "int", "bigint"):
            fills[name] = F.coalesce(F.col(name), F.lit(0).cast(kind))
    return joined.withColumns(fills).select(*df.columns, *added)


def split_overlap(train: DataFrame, val: DataFrame) -> DataFrame:
    """Cores that occur in both splits."""
    return train.select("basename").intersect(val.select("basename"))
