"""Writers. The tables of a bundle become one new version; single exports are staged and renamed into place."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.functions.expr import nan_to_null, stack_columns, truthy
from cellframe.operators.audit import AUDIT_COLUMNS
from cellframe.operators.compose import positive_counts
from cellframe.panel import DEFAULT_PANEL, MarkerPanel, Thresholds, ch, ph
from cellframe.sources.tables import POLYGON_SCHEMA, SKIP_SCHEMA, Bundle
from cellframe.sources.versions import publish

#: The tables of a bundle by their names in a folder without versions.
TABLE_NAMES = (
    "cells.parquet", "core_summary.parquet", "thresholds.parquet", "manifest.json", "cell_polygons.parquet", "polygons_skipped.csv",
    "spatial_edges.parquet", "spatial_summary.parquet",
)


def swap_in(spark: SparkSession, target: str, write: Callable[[str], None]) -> None:
    """Run ``write`` on a staging path next to ``target``, then rename it into place.

    For exports that stand alone: the one before is moved aside first, so between the two renames there is none, and an
    object store copies. Tables that others read meanwhile are published as versions (:mod:`cellframe.sources.versions`).
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tag = uuid.uuid4().hex
    staged, old = path(f"{target}.staging-{tag}"), path(f"{target}.old-{tag}")
    write(staged.toString())
    replaced = fs.exists(path(target))
    if replaced and not fs.rename(path(target), old):
        raise OSError(f"cannot move aside {target}")
    if not fs.rename(staged, path(target)):
        if replaced:
            fs.rename(old, path(target))
        raise OSError(f"cannot move {staged} to {target}")
    if replaced:
        fs.delete(old, True)


def parquet_writer(df: DataFrame, partition_by: Sequence[str] = ()) -> Callable[[str], None]:
    def write(folder: str) -> None:
        writer = df.write.mode("errorifexists").option("compression", "snappy")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)

    return write


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    swap_in(df.sparkSession, path, parquet_writer(df, partition_by))


def write_json_rows(df: DataFrame, path: str) -> None:
    swap_in(df.sparkSession, path, lambda staged: df.write.text(staged))


def threshold_rows(spark: SparkSession, thr: Thresholds) -> DataFrame:
    rows = [("marker", n, float(t), thr.stratum(n)) for n, t in thr.marker.items()]
    rows += [("phenotype", n, float(t), thr.stratum(n)) for n, t in thr.phenotype.items()]
    return spark.createDataFrame(rows, "kind string, name string, threshold double, confidence string")


def write_bundle(
    bundle: Bundle, path: str, thr: Thresholds | None = None, manifest: DataFrame | None = None
) -> None:
    """Cells partitioned by core, the core summary, thresholds, manifest and any optional table, as one new version."""
    spark = bundle.cells.sparkSession
    writers = {
        "cells.parquet": parquet_writer(clustered(bundle.cells), ["basename"]),
        "core_summary.parquet": parquet_writer(bundle.cores),
    }
    if thr is not None:
        writers["thresholds.parquet"] = parquet_writer(threshold_rows(spark, thr))
    if manifest is not None:
        writers["manifest.json"] = manifest.write.json
    if bundle.cell_polygons is not None:
        skips = bundle.polygons_skipped
        writers |= polygon_writers(bundle.cell_polygons, skips if skips is not None else spark.createDataFrame([], SKIP_SCHEMA))
    for name in ("spatial_edges", "spatial_summary"):
        table = getattr(bundle, name)
        if table is not None:
            writers[f"{name}.parquet"] = parquet_writer(table)
    publish(spark, path, writers, keep=False)


def clustered(df: DataFrame) -> DataFrame:
    """Bring the rows of a core together before a partitioned write, so that a core is few files.

    The rebalance hint lets the adaptive planner split a very large core over several tasks.
    """
    return df.hint("rebalance", "basename")


def rewrite_cells(df: DataFrame, path: str) -> None:
    """A new version with another cell table (columns in name order) and all else as it was; the same input gives the same rows."""
    rows = clustered(df.select(*sorted(df.columns)))
    publish(df.sparkSession, path, {"cells.parquet": parquet_writer(rows, ["basename"])}, plain=TABLE_NAMES)


def polygon_rows(polys: DataFrame) -> DataFrame:
    """The polygon table cast to its pinned schema."""
    return polys.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in POLYGON_SCHEMA.fields])


def polygon_writers(polys: DataFrame, skips: DataFrame) -> dict[str, Callable[[str], None]]:
    log = skips.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SKIP_SCHEMA.fields])
    return {"cell_polygons.parquet": parquet_writer(polygon_rows(polys)), "polygons_skipped.csv": log.write.option("header", True).csv}


def write_polygons(polys: DataFrame, skips: DataFrame, path: str) -> None:
    """A new version of the bundle with polygons in the pinned schema and the skip log, which is written even when empty."""
    publish(polys.sparkSession, path, polygon_writers(polys, skips), plain=TABLE_NAMES)


def audit_csv_rows(audit: DataFrame, panel: MarkerPanel = DEFAULT_PANEL) -> DataFrame:
    """The pinned audit columns ordered by core and marker position."""
    position = F.lit(len(panel.names))
    for i, n in enumerate(panel.names):
        position = F.when(F.col("marker") == n, F.lit(i)).otherwise(position)
    return audit.orderBy("basename", position).select(*AUDIT_COLUMNS)


def write_audit_csv(audit: DataFrame, path: str, panel: MarkerPanel = DEFAULT_PANEL) -> None:
    rows = audit_csv_rows(audit, panel)
    swap_in(audit.sparkSession, path, lambda staged: rows.write.option("header", True).csv(staged))


def audit_json(audit: DataFrame, params: Mapping[str, object] | None = None) -> DataFrame:
    """One JSON document per core: its cell count and an object per marker, no per-cell data."""
    fields = [c for c in audit.columns if c not in ("basename", "marker", "n_cells")]
    per_marker = F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(F.col("marker"), F.to_json(F.struct("n_cells", *fields)).alias("json"))
    )))
    docs = audit.groupBy("basename", "n_cells").agg(per_marker.alias("per_marker"))
    settings = F.lit(None).cast("string")
    if params:
        settings = F.to_json(F.create_map(*[F.lit(str(x)) for kv in params.items() for x in kv]))
    return docs.select(
        "basename",
        F.to_json(F.struct("basename", "n_cells", settings.alias("parameters"), "per_marker")).alias("value"),
    )


def label_provenance(
    df: DataFrame, params: Mapping[str, object], panel: MarkerPanel = DEFAULT_PANEL,
    family: str = "pos_spacec",
) -> DataFrame:
    """One JSON row with the parameters, sizes and positive cells per marker."""
    counts = positive_counts(df, panel, family).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("marker", "n_positive")))).alias("per_marker_positive_counts")
    )
    sizes = df.groupBy("basename").agg(F.count("*").alias("n")).agg(
        F.struct(F.count("*").alias("n_cores"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_cells_total")).alias("s")
    ).scalar()
    settings = F.create_map(*[F.lit(str(x)) for kv in params.items() for x in kv])
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return counts.select(F.to_json(F.struct(
        F.lit(1).alias("schema_version"), stamp.alias("timestamp"), settings.alias("parameters"),
        sizes["n_cores"].alias("n_cores"), sizes["n_cells_total"].alias("n_cells_total"),
        "per_marker_positive_counts",
    )).alias("value"))


def geojson_features(df: DataFrame, ring: str = "ring") -> DataFrame:
    """``basename, cell_id, feature``: one GeoJSON polygon feature per cell that has a ring.

    The input has ``color_value, pred_prob, phenotype_name, confidence_stratum``.
    """
    stratum = F.when(F.col("confidence_stratum").isin("strong", "moderate"), F.col("confidence_stratum")).otherwise("weak")
    feature = F.struct(
        F.lit("Feature").alias("type"), F.col("cell_id").alias("id"),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.col(ring)).alias("coordinates")).alias("geometry"),
        F.struct(
            "cell_id", nan_to_null(F.col("color_value")).alias("color_value"),
            nan_to_null(F.col("pred_prob")).alias("pred_prob"),
            F.col("phenotype_name").alias("phenotype_call"), stratum.alias("confidence_stratum"),
        ).alias("properties"),
    )
    # absent values stay visible as null, as viewers expect
    text = F.to_json(feature, {"ignoreNullFields": "false"})
    return df.filter(F.col(ring).isNotNull()).select("basename", "cell_id", text.alias("feature"))


def export_geojson(df: DataFrame, path: str, ring: str = "ring") -> None:
    """Features as JSON lines in one folder per core; a collection of any size is never one string."""
    rows = geojson_features(df, ring).select("basename", F.col("feature").alias("value"))
    swap_in(
        df.sparkSession, path,
        lambda staged: clustered(rows).write.partitionBy("basename").text(staged),
    )


def export_core(bundle: Bundle, basename: str | None, path: str) -> None:
    """Cells and spatial summary as CSV, of one core or one folder per core."""
    def pick(df: DataFrame) -> DataFrame:
        return df if basename is None else df.filter(F.col("basename") == basename)

    tables = {"cells": bundle.cells}
    if bundle.spatial_summary is not None:
        tables["spatial_summary"] = bundle.spatial_summary
    for name, df in tables.items():
        rows = pick(df)
        swap_in(
            rows.sparkSession, f"{path}/{name}.csv",
            lambda staged, rows=rows: clustered(rows).write.partitionBy("basename").option("header", True).csv(staged),
        )


def union_rows(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables over the union of their columns, in first-seen order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_metric_rows(tables: Sequence[DataFrame], path: str) -> None:
    rows = union_rows(tables)
    swap_in(rows.sparkSession, path, lambda staged: rows.write.option("header", True).csv(staged))


def export_matrix(df: DataFrame, model: str, panel: MarkerPanel = DEFAULT_PANEL) -> dict[str, DataFrame]:
    """Annotated-matrix tables: ``obs``, ``var`` with prevalence, and the long matrices ``X`` and layer."""
    obs = [F.col(c) for c in ("basename", "cell_id")]
    obs += [F.col(c).cast("int").alias(c) for c in ("centroid_x", "centroid_y")]
    for n in panel.phenotypes:
        for what, kind in (("label", "tinyint"), ("call", "tinyint"), ("score", "float")):
            name = ph(n, what, None if what == "label" else model)
            if name in df.columns:
                obs.append(F.col(name).cast(kind).alias(name))
    agg = df.agg(*[
        F.avg(truthy(F.col(ch(c, "pos"))).cast("double")).alias(f"__p_{c}")
        for c in panel.channels if ch(c, "pos") in df.columns
    ])
    var = stack_columns(agg, [], [
        {
            "position": F.lit(i), "channel": F.lit(c), "name": F.lit(n),
            "prevalence": F.col(f"__p_{c}") if f"__p_{c}" in agg.columns else F.lit(None).cast("double"),
        }
        for i, (n, c) in enumerate(panel.pairs)
    ])

    def matrix(what: str, model_id: str | None) -> DataFrame:
        def value(c: int):
            name = ch(c, what, model_id)
            if name not in df.columns:
                return F.lit(0.0 if what == "pos" else None).cast("float")
            return F.col(name).cast("float")

        return stack_columns(df, ["basename", "cell_id"], [
            {"channel": F.lit(c), "value": value(c)} for c in panel.channels
        ])

    return {"obs": df.select(*obs), "var": var, "X": matrix("pos", None), f"pred_{model}": matrix("pred", model)}


def write_matrix(df: DataFrame, model: str, path: str, panel: MarkerPanel = DEFAULT_PANEL) -> None:
    for name, table in export_matrix(df, model, panel).items():
        write_table(table, f"{path}/{name}.parquet")
