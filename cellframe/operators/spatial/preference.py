"""Neighbour preference and hotspot statistics over an annotated edge table, or over label counts per cell.

Edges are aggregated once to label pairs (map-side combined); everything after
that works on a few rows per core. Where neighbours are those within a radius, the counts per cell come without an
edge table (:mod:`cellframe.operators.spatial.quadtree`); every function that takes edges takes such counts too.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.expr import clip, ratio, stack_columns, two_sided_p
from cellframe.functions.running import join_salted
from cellframe.panel import BACKGROUND, PHENOTYPE_NAMES

LABELS = (*PHENOTYPE_NAMES, BACKGROUND)
# The hotspot cut, the guard of the deviation and the summary's columns, in order.
HOTSPOT_Z = 1.96
EPS = 1e-9
SUMMARY_COLUMNS = (
    "basename", "phenotype_a", "phenotype_b", "observed", "expected", "variance", "z",
    "p_two_sided", "obs_over_exp", "hotspot_overlap_iou", "n_a", "n_b", "n_total", "n_edges",
)


def label_counts(cells: DataFrame, label: str = "dominant_phenotype") -> DataFrame:
    return cells.groupBy("basename", F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))


def is_counted(edges: DataFrame) -> bool:
    """Whether the table has label counts per cell in place of edges."""
    return "n_neighbors" in edges.columns


def counted_labels(counts: DataFrame) -> list[str]:
    return [c.removeprefix("local_count_") for c in counts.columns if c.startswith("local_count_")]


def _pairs_of_counts(counts: DataFrame) -> DataFrame:
    """Edges per ordered label pair from counts per cell: one aggregation, then a row a label."""
    labels = counted_labels(counts)
    sums = counts.groupBy("basename", "src_phenotype").agg(*[F.sum(f"local_count_{n}").alias(f"__s_{i}") for i, n in enumerate(labels)])
    rows = stack_columns(sums, ["basename", "src_phenotype"], [{"dst_phenotype": F.lit(n), "observed": F.col(f"__s_{i}")} for i, n in enumerate(labels)])
    return rows.where("observed > 0")


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges per core and ordered label pair, with the source label's out-degree and the core's total."""
    if is_counted(edges):
        pairs = _pairs_of_counts(edges)
    else:
        pairs = edges.groupBy("basename", "src_phenotype", "dst_phenotype").agg(F.count("*").alias("observed"))
    # label pairs of one core: a few dozen rows per window
    return pairs.select(
        "basename", "src_phenotype", "dst_phenotype", "observed",
        F.sum("observed").over(Window.partitionBy("basename", "src_phenotype")).alias("out_degree"),
        F.sum("observed").over(Window.partitionBy("basename")).alias("n_edges"),
    )


def phenotype_pairs(counts: DataFrame) -> DataFrame:
    """All ordered pairs of labels present in a core, with their cell counts and the core's total."""
    total = Window.partitionBy("basename")
    a = counts.select(
        "basename", F.col("label").alias("phenotype_a"), F.col("n").alias("n_a"),
        F.sum("n").over(total).alias("n_total"),
    )
    b = counts.select("basename", F.col("label").alias("phenotype_b"), F.col("n").alias("n_b"))
    return a.join(b, "basename")


def _expected() -> tuple[Column, Column]:
    """Expected count and destination probability under label permutation on a fixed graph."""
    rest = F.greatest(F.col("n_total") - 1, F.lit(1)).cast("double")
    same = F.col("phenotype_a") == F.col("phenotype_b")
    free = F.when(same, F.greatest(F.col("n_a") - 1, F.lit(0))).otherwise(F.col("n_b")).cast("double")
    return F.col("out_degree") * free / rest, free / rest


def cozi(cells: DataFrame, edges: DataFrame, label: str = "dominant_phenotype") -> DataFrame:
    """Observed and expected edges, variance, z and two-sided p of every ordered label pair of a core.

    Sources without out-edges and self pairs of a single cell are left out, pairs never
    observed stay in, z and p are null where the variance is not positive. The p-value has
    an absolute error of about 1e-7.
    """
    seen = edge_counts(edges)
    degree = seen.groupBy("basename", F.col("src_phenotype").alias("phenotype_a")).agg(
        F.first("out_degree").alias("out_degree"), F.first("n_edges").alias("n_edges")
    )
    observed = seen.select(
        "basename", F.col("src_phenotype").alias("phenotype_a"),
        F.col("dst_phenotype").alias("phenotype_b"), "observed",
    )
    key = ["basename", "phenotype_a", "phenotype_b"]
    pairs = (
        phenotype_pairs(label_counts(cells, label))
        .filter(F.col("n_total") >= 2)
        .filter((F.col("phenotype_a") != F.col("phenotype_b")) | (F.col("n_a") >= 2))
        .join(degree, ["basename", "phenotype_a"])
        .join(observed, key, "left")
    )
    expected, p = _expected()
    variance = F.col("out_degree") * p * (F.lit(1.0) - p)
    z = F.when(
        F.col("variance") > 0, (F.col("observed") - F.col("expected")) / F.sqrt("variance")
    )
    return (
        pairs.withColumns({
            "observed": F.coalesce("observed", F.lit(0)), "expected": expected, "variance": variance,
        })
        .withColumn("z", z)
        .select(*key, "observed", "expected", "variance", "z", two_sided_p(F.col("z")).alias("p_two_sided"),
                "n_a", "n_b", "n_total", "n_edges")
    )


def observed_over_expected(
    cells: DataFrame, edges: DataFrame, label: str = "dominant_phenotype"
) -> DataFrame:
    """Ratio of observed to expected edges, for observed pairs only."""
    pairs = phenotype_pairs(label_counts(cells, label))
    seen = edge_counts(edges).withColumnsRenamed(
        {"src_phenotype": "phenotype_a", "dst_phenotype": "phenotype_b"}
    )
    key = ["basename", "phenotype_a", "phenotype_b"]
    expected, _ = _expected()
    joined = seen.join(pairs, key).withColumn("expected", expected)
    return joined.select(
        *key, "observed", "expected",
        (F.col("observed") / F.greatest(F.col("expected"), F.lit(1e-6))).alias("obs_over_exp"),
    )


def local_composition(edges: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Per source cell the count and fraction of every neighbour label."""
    if is_counted(edges):
        counts = edges.select("basename", "src_cell_id", "n_neighbors", *[f"local_count_{n}" for n in labels])
    else:
        aggs = [F.count("*").alias("n_neighbors")]
        aggs += [F.count_if(F.col("dst_phenotype") == n).alias(f"local_count_{n}") for n in labels]
        counts = edges.groupBy("basename", "src_cell_id").agg(*aggs)
    return counts.withColumns({
        f"local_frac_{n}": F.col(f"local_count_{n}") / F.greatest(F.col("n_neighbors"), F.lit(1)).cast("double")
        for n in labels
    })


def local_label_count(edges: DataFrame, label: str) -> DataFrame:
    """Per source cell its neighbours and those with the label, zeros kept."""
    if is_counted(edges):
        return edges.select("basename", "src_cell_id", "n_neighbors", F.col(f"local_count_{label}").alias("n_pheno"))
    return edges.groupBy("basename", "src_cell_id").agg(
        F.count("*").alias("n_neighbors"), F.count_if(F.col("dst_phenotype") == label).alias("n_pheno")
    )


def _z_flags(edges: DataFrame, labels: Sequence[str], z: float) -> DataFrame:
    """Per source cell: local fraction, z and hotspot flag of every label, in one pass over the edges."""
    local = local_composition(edges, labels)
    stats = local.groupBy("basename").agg(
        *[F.avg(f"local_frac_{n}").alias(f"__m_{n}") for n in labels],
        *[F.stddev_pop(f"local_frac_{n}").alias(f"__s_{n}") for n in labels],
    )
    scored = join_salted(local, stats, ["basename"], F.col("src_cell_id"))
    zs = {
        f"z_{n}": (F.col(f"local_frac_{n}") - F.col(f"__m_{n}")) / (F.col(f"__s_{n}") + F.lit(EPS))
        for n in labels
    }
    return scored.withColumns(zs).withColumns({f"hot_{n}": F.col(f"z_{n}") >= z for n in labels})


def hotspots(edges: DataFrame, label: str, z: float = HOTSPOT_Z) -> DataFrame:
    """Cells whose local share of a label is at least z deviations above their core's mean."""
    flagged = _z_flags(edges, [label], z)
    return flagged.select(
        "basename", "src_cell_id", "n_neighbors", F.col(f"local_count_{label}").alias("n_pheno"),
        F.col(f"local_frac_{label}").alias("local_frac"), F.col(f"z_{label}").alias("z"),
        F.col(f"hot_{label}").alias("is_hotspot"),
    )


def hotspot_overlap(
    edges: DataFrame, labels: Sequence[str] = LABELS, z: float = HOTSPOT_Z
) -> DataFrame:
    """Jaccard index of the hotspot sets of every ordered label pair per core.

    The flags of all labels are computed once and the pairs are counted in one
    aggregation. A self pair is 1; two empty sets give null.
    """
    flags = _z_flags(edges, labels, z)
    hot = {n: F.col(f"hot_{n}") for n in labels}
    aggs = [F.count_if(hot[n]).alias(f"__n_{i}") for i, n in enumerate(labels)]
    aggs += [
        F.count_if(hot[labels[i]] & hot[labels[j]]).alias(f"__b_{i}_{j}")
        for i, j in combinations(range(len(labels)), 2)
    ]
    counts = flags.groupBy("basename", "__salt").agg(*aggs)
    counts = counts.groupBy("basename").agg(*[F.sum(c).alias(c) for c in counts.columns if c not in ("basename", "__salt")])
    rows = []
    for i, a in enumerate(labels):
        for j, b in enumerate(labels):
            if i == j:
                value = F.lit(1.0)
            else:
                common = F.col(f"__b_{min(i, j)}_{max(i, j)}")
                value = ratio(common, F.col(f"__n_{i}") + F.col(f"__n_{j}") - common)
            rows.append({
                "phenotype_a": F.lit(a), "phenotype_b": F.lit(b), "hotspot_overlap_iou": value,
            })
    return stack_columns(counts, ["basename"], rows)


def spatial_summary_join(cozi_rows: DataFrame, ratios: DataFrame, overlap: DataFrame) -> DataFrame:
    """The full summary: preference rows with the ratio and the hotspot overlap where known."""
    key = ["basename", "phenotype_a", "phenotype_b"]
    return (
        cozi_rows.join(ratios.select(*key, "obs_over_exp"), key, "left")
        .join(overlap.select(*key, "hotspot_overlap_iou"), key, "left")
        .select(*SUMMARY_COLUMNS)
    )


def spatial_slice(summary: DataFrame, basename: str | None = None, n: int | None = None) -> DataFrame:
    """Pairs of different labels with a z-score, the largest absolute z first."""
    rows = summary if basename is None else summary.filter(F.col("basename") == basename)
    rows = rows.filter((F.col("phenotype_a") != F.col("phenotype_b")) & F.col("z").isNotNull())
    if n is None:
        return rows
    return rows.orderBy(F.abs("z").desc(), "basename", "phenotype_a", "phenotype_b").limit(n)


def cozi_matrix(summary: DataFrame, labels: Sequence[str] = LABELS, limit: float = 30.0) -> DataFrame:
    """Mean clipped z as a matrix: one row per source label, one column per target label."""
    cells = summary.withColumn("__z", clip(F.col("z"), -limit, limit))
    return cells.groupBy("phenotype_a").pivot("phenotype_b", list(labels)).agg(F.avg("__z"))
