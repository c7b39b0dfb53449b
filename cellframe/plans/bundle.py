"""Whole runs: from inputs to the tables of a bundle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.operators import compose, joins, metrics, rules
from cellframe.operators.audit import disagreement_gate, reaudit
from cellframe.operators.cluster import label_cores, label_columns
from cellframe.operators.spatial.knn import neighbour_edges
from cellframe.operators.spatial.preference import (
    LABELS, cozi, hotspot_overlap, observed_over_expected, spatial_summary_join,
)
from cellframe.operators.spatial.quadtree import radius_counts
from cellframe.panel import BACKGROUND, CELL_KEY, DEFAULT_PANEL, MarkerPanel, Thresholds
from cellframe.session import cut
from cellframe.sources.tables import Bundle


def build_cell_tables(
    cells: DataFrame, consensus: DataFrame | None, manifest: DataFrame, thr: Thresholds, model: str,
    split: str | None = None, panel: MarkerPanel = DEFAULT_PANEL,
) -> Bundle:
    """Cells with consensus labels and calls, and the core summary."""
    if consensus is not None:
        cells = joins.attach_consensus(cells, consensus)
    if split is not None:
        manifest = manifest.filter(F.col("split") == split)
        cells = cells.join(manifest.select("basename"), "basename", "left_semi")
    cells = rules.phenotype_calls(rules.marker_calls(cells, thr, model, panel), thr, model, panel)
    manifest = rules.attach_tma_tissue(manifest)
    composition = compose.core_composition(cells, [model], panel)
    return Bundle(cells=cells, cores=joins.core_summary(manifest, composition, model))


def rebuild_cell_tables(
    bundle: Bundle, predictions: Sequence[tuple[str, DataFrame]], metadata: DataFrame, thr: Thresholds,
    default: str | None = None, panel: MarkerPanel = DEFAULT_PANEL,
) -> tuple[DataFrame, DataFrame]:
    """Cells with the added models, and the model registry with its metrics, the default first.

    ``metadata`` has one row per model, as the metadata reader gives.
    """
    cells = cut(joins.add_models(bundle.cells, predictions, thr, panel))
    order = joins.ordered_models([m for m, _ in predictions], default)
    known = [m for m in order if m in dict(predictions)]
    registry = model_entries(metrics.models_metrics(cells, known, panel), known)
    position = F.lit(len(order))
    for i, m in enumerate(order):
        position = F.when(F.col("id") == m, F.lit(i)).otherwise(position)
    return cells, registry.join(metadata, "id").withColumn("position", position)


def model_entries(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """Registry maps and macro values per model from the per-name metrics (a few dozen rows a model)."""
    def table(kind: str):
        entry = F.when(F.col("kind") == kind, F.struct("name", "ap"))
        return F.map_from_entries(F.sort_array(F.collect_list(entry)))

    def macro(kind: str):
        value = F.max(F.when(F.col("kind") == kind, F.col("macro_ap")))
        missing = F.raise_error(F.concat(F.lit(f"no evaluable {kind} predictions for model "), F.col("id")))
        return F.coalesce(value, missing.cast("double"))

    ids = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in models])).alias("id"))
    return ids.join(rows.withColumnRenamed("model", "id"), "id", "left").groupBy("id").agg(
        macro("marker").alias("macro_marker_ap"), macro("phenotype").alias("macro_phenotype_ap"),
        table("marker").alias("per_marker_ap"), table("phenotype").alias("per_phenotype_ap"),
    )


def model_entry(rows: DataFrame, model: str) -> DataFrame:
    """The registry entry of one model."""
    return model_entries(rows.withColumn("model", F.lit(model)), [model])


def spatial_summary(
    cells: DataFrame, model: str, method: str = "knn", k: int = 16, radius: float = 98.0,
    labels: Sequence[str] | None = None, panel: MarkerPanel = DEFAULT_PANEL,
) -> tuple[DataFrame, DataFrame]:
    """The annotated edge table and the neighbour-preference summary of every core.

    ``labels`` are the panel's phenotypes and the background unless given. Edges within a radius grow
    with the square of the density, so the summary is made from label counts per cell, without the edges.
    """
    labels = labels or (*panel.phenotypes, BACKGROUND)
    typed = rules.dominant_phenotype(cells, model, panel).select(
        *CELL_KEY, "centroid_x", "centroid_y", "dominant_phenotype"
    )
    edges = neighbour_edges(typed, method, k, radius, "dominant_phenotype")
    if method == "radius":
        return edges, summarize_edges(typed, cut(radius_counts(typed, radius, "dominant_phenotype", labels)), labels)
    edges = cut(edges)
    return edges, summarize_edges(typed, edges, labels)


def summarize_edges(typed: DataFrame, edges: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    return spatial_summary_join(
        cozi(typed, edges), observed_over_expected(typed, edges), hotspot_overlap(edges, labels)
    )


def build_labels(
    cells: DataFrame, thresholds: Mapping[int, Mapping[str, float]], gate: float | None = None,
    panel: MarkerPanel = DEFAULT_PANEL, **settings,
) -> tuple[DataFrame, DataFrame | None]:
    """Cluster-derived labels attached to the cells, and the gate rows of their audit if asked for."""
    labels = cut(label_cores(cells, panel, **settings))
    out = joins.emit_labels(cells, labels.select(*CELL_KEY, *label_columns(panel)), panel)
    if gate is None:
        return out, None
    audit = reaudit(out, thresholds, panel=panel, cluster="cluster_id_spacec")
    return out, disagreement_gate(audit, gate)


def report_rows(
    cores: DataFrame, summary: DataFrame, thr: Thresholds, model: str, basename: str | None = None,
    n_top: int = 10, panel: MarkerPanel = DEFAULT_PANEL,
) -> tuple[DataFrame, DataFrame]:
    """Marker and phenotype rows of a core (or all), and its strongest directional preferences."""
    from pyspark.sql import Window

    from cellframe.operators.spatial.preference import spatial_slice

    rows = compose.core_phenotype_summary(cores, basename, thr, model, panel).withColumn(
        "frac_pred", F.coalesce("frac_pred", F.lit(0.0))
    )
    # label pairs of one core: a few dozen rows per window
    w = Window.partitionBy("basename").orderBy(F.abs("z").desc(), "phenotype_a", "phenotype_b")
    top = spatial_slice(summary, basename).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_top)
    return rows, top.select(
        "basename", "rank", "phenotype_a", "phenotype_b", "z", "obs_over_exp", "hotspot_overlap_iou"
    )
