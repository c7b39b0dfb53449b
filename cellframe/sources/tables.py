"""Readers for cell tables and bundles. Schemas are explicit; only wanted columns are read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.functions.expr import nan_to_null, require
from cellframe.operators.joins import polygon_coverage
from cellframe.panel import DEFAULT_PANEL, MarkerPanel, ch
from cellframe.sources.versions import exists, latest, locate

POLYGON_SCHEMA = T.StructType([
    T.StructField("basename", T.StringType(), False),
    T.StructField("cell_id", T.LongType(), False),
    T.StructField("centroid_y", T.DoubleType(), False),
    T.StructField("centroid_x", T.DoubleType(), False),
    T.StructField("nucleus_xy", T.ArrayType(T.ArrayType(T.DoubleType())), False),
    T.StructField("expanded_xy", T.ArrayType(T.ArrayType(T.DoubleType())), False),
    T.StructField("area_nucleus_px", T.DoubleType(), False),
    T.StructField("area_expanded_px", T.DoubleType(), False),
    T.StructField("n_verts_nucleus", T.IntegerType(), False),
    T.StructField("n_verts_expanded", T.IntegerType(), False),
    T.StructField("flags", T.StringType(), False),
])

SKIP_SCHEMA = T.StructType([
    T.StructField("basename", T.StringType()),
    T.StructField("cell_id", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("area_nucleus_px", T.DoubleType()),
    T.StructField("area_expanded_px", T.DoubleType()),
])


def cell_schema(
    panel: MarkerPanel = DEFAULT_PANEL, models: Sequence[str] = (), labels: Sequence[str] = ("pos",),
    extra: Sequence[tuple[str, str]] = (),
) -> T.StructType:
    """Schema of a cell table generated from the panel, for readers without embedded types."""
    schema = T.StructType().add("basename", "string").add("cell_id", "long")
    schema = schema.add("centroid_y", "double").add("centroid_x", "double")
    for c in panel.channels:
        schema = schema.add(ch(c, "true"), "double")
        for family in labels:
            schema = schema.add(ch(c, family), "boolean")
        for m in models:
            schema = schema.add(ch(c, "pred", m or None), "double")
    for name, kind in extra:
        schema = schema.add(name, kind)
    return schema


def read_cells(
    spark: SparkSession, path: str, panel: MarkerPanel = DEFAULT_PANEL,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A wide cell table from Parquet or CSV. The path must exist.

    The columns of a CSV are typed by name: its header is read first, panel columns take
    their type from the panel, others are strings.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if not path.rstrip("/").endswith(".csv"):
        return spark.read.parquet(path)
    if schema is None:
        known = {f.name: f.dataType for f in cell_schema(panel, ("",)).fields}
        header = spark.read.option("header", True).csv(path).columns
        schema = T.StructType([
            T.StructField(n, known.get(n, T.DoubleType() if n.startswith(("ch", "phenotype_")) else T.StringType()))
            for n in header
        ])
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def read_projected(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns; missing ones fail before any data is read."""
    df = read_cells(spark, path)
    require(df, columns)
    return df.select(*columns)


@dataclass
class Bundle:
    """The tables of one bundle folder and its manifest row."""

    cells: DataFrame
    cores: DataFrame
    manifest: DataFrame | None = None
    spatial_edges: DataFrame | None = None
    spatial_summary: DataFrame | None = None
    cell_polygons: DataFrame | None = None
    polygons_skipped: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)


REQUIRED = ("cells", "core_summary")
OPTIONAL = ("spatial_edges", "spatial_summary", "cell_polygons")


def load_bundle(spark: SparkSession, path: str, validate: bool = True) -> Bundle:
    """Read every table of a bundle's newest version, or of a folder without versions. Polygons, if there are any, must cover the cells."""
    version = latest(spark, path)

    def place(name: str) -> str | None:
        return locate(spark, path, name, version)

    tables = {}
    for name in REQUIRED:
        folder = place(f"{name}.parquet")
        if folder is None:
            raise FileNotFoundError(f"{path}/{name}.parquet")
        tables[name] = spark.read.parquet(folder)
    for name in OPTIONAL:
        folder = place(f"{name}.parquet")
        tables[name] = spark.read.parquet(folder) if folder else None
    skips = manifest = None
    if folder := place("polygons_skipped.csv"):
        skips = spark.read.option("header", True).schema(SKIP_SCHEMA).csv(folder)
    if folder := place("manifest.json"):
        manifest = spark.read.option("multiLine", True).json(folder)
    polygons = tables["cell_polygons"]
    if validate and polygons is not None:
        covered = skips if skips is not None else spark.createDataFrame([], SKIP_SCHEMA)
        problem = polygon_coverage(tables["cells"], polygons, covered).limit(1).first()
        if problem is not None:
            raise ValueError(f"bundle is inconsistent: {problem.asDict()}")
    return Bundle(
        cells=tables["cells"], cores=tables["core_summary"], manifest=manifest,
        spatial_edges=tables["spatial_edges"], spatial_summary=tables["spatial_summary"],
        cell_polygons=polygons, polygons_skipped=skips,
    )


def manifest_basenames(manifest: DataFrame, splits: Sequence[str] | None = None) -> DataFrame:
    """Non-blank core names of a manifest, of some splits only if given."""
    rows = manifest.filter(F.trim("basename") != "")
    if splits is not None:
        rows = rows.filter(F.col("split").isin(*splits))
    return rows.select("basename")


def read_per_core_ap(table: DataFrame, name: str = "name") -> DataFrame:
    """Wide metrics (one column per core) to ``name, per_core_ap`` without missing values, in column order."""
    require(table, [name])
    values = [c for c in table.columns if c != name]
    aps = F.array_compact(F.array(*[nan_to_null(F.col(c).cast("double")) for c in values]))
    return table.select(F.col(name).alias("name"), aps.alias("per_core_ap")).filter(F.size("per_core_ap") > 0)
