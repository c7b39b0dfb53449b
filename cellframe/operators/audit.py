"""Label audit: three views of every (core, marker) pair compared."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.expr import nan_to_null, ratio0, stack_columns, truthy
from cellframe.functions.running import group_quantiles, join_salted
from cellframe.operators.cluster import cluster_zscore
from cellframe.operators.labels import otsu_cuts
from cellframe.operators.normalize import checked_intensity
from cellframe.panel import DEFAULT_PANEL, MarkerPanel, ch
from cellframe.session import cut

# Share of positives from which an alternative contradicts a zero consensus.
SUSPICIOUS_FRACTION = 0.05
DEFAULT_TAU = 0.5

# The exported columns, in order.
AUDIT_COLUMNS = (
    "basename", "marker", "channel", "n_cells", "n_pos_consensus", "n_pos_per_core_otsu",
    "n_pos_leiden_zscore", "frac_consensus", "frac_per_core_otsu", "frac_leiden",
    "per_core_otsu_threshold_log1p", "cohort_gmm_threshold_log1p", "cohort_otsu_threshold_log1p",
    "cohort_quantile_threshold_log1p", "max_leiden_cluster_zscore", "disagreement_score",
    "suspicious_zero_consensus",
)
MEASURES = ("frac_consensus", "frac_per_core_otsu", "frac_leiden", "disagreement_score")


def audit_markers(
    cells: DataFrame, thresholds: Mapping[int, Mapping[str, float]], cluster: str = "cluster_id",
    zscore: str = "zscore_spacec", panel: MarkerPanel = DEFAULT_PANEL, tau: float = DEFAULT_TAU,
    consensus: str = "pos_consensus", space: str = "raw",
) -> DataFrame:
    """One row per core and marker with the counts of the three views and what follows from them.

    ``cells`` carries the scaled matrix ``chXX_<zscore>`` and a cluster id. A missing
    consensus column counts as no positives; a missing intensity column is an error.
    """
    missing = [ch(c, "true") for c in panel.channels if ch(c, "true") not in cells.columns]
    if missing:
        raise ValueError(f"missing required intensity columns: {missing}")
    rows = []
    for n, c in panel.pairs:
        known = ch(c, consensus) in cells.columns
        rows.append({
            "marker": F.lit(n), "channel": F.lit(c),
            "v": checked_intensity(ch(c, "true"), space),
            "cons": F.coalesce(truthy(F.col(ch(c, consensus))), F.lit(False)) if known else F.lit(False),
        })
    long = stack_columns(cells, ["basename"], rows)
    cuts = otsu_cuts(long, ["basename", "marker"], "v").drop("n")
    key = ["basename", "marker", "channel", "otsu"]
    counts = join_salted(long, cuts, ["basename", "marker"], F.col("v")).groupBy(*key, "__salt").agg(
        F.count("*").alias("n_cells"),
        F.count_if("cons").alias("n_pos_consensus"),
        F.count_if(F.col("v") > F.col("otsu")).alias("n_pos_per_core_otsu"),
    ).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("n_cells", "n_pos_consensus", "n_pos_per_core_otsu")])
    cz = cluster_zscore(cells, cluster, zscore, panel)
    clusters = cz.groupBy("basename", "marker").agg(
        F.max("z").alias("max_z"),
        F.sum(F.when(F.col("z") > tau, F.col("n_cluster")).otherwise(F.lit(0))).alias("n_pos_leiden_zscore"),
        F.sort_array(F.collect_list(F.when(F.col("z") > tau, F.col(cluster)))).alias("positive_cluster_ids"),
    )

    def cohort(method: str) -> Column:
        out = F.lit(None).cast("double")
        for c, t in thresholds.items():
            if t.get(method) is not None:
                out = F.when(F.col("channel") == c, F.lit(float(t[method]))).otherwise(out)
        return out

    joined = counts.join(clusters, ["basename", "marker"], "left").withColumns({
        "n_pos_leiden_zscore": F.coalesce("n_pos_leiden_zscore", F.lit(0)),
    })
    return derive_audit(joined.withColumnsRenamed({
        "otsu": "per_core_otsu_threshold_log1p", "max_z": "max_leiden_cluster_zscore",
    }).withColumns({
        f"cohort_{m}_threshold_log1p": cohort(m) for m in ("gmm", "otsu", "quantile")
    }), extra=("positive_cluster_ids",))


def derive_audit(counts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Fractions, disagreement and the suspicious flag from the three counts."""
    n = F.col("n_cells")
    f0 = ratio0(F.col("n_pos_consensus"), n)
    f1 = ratio0(F.col("n_pos_per_core_otsu"), n)
    f2 = ratio0(F.col("n_pos_leiden_zscore"), n)
    suspicious = (F.col("n_pos_consensus") == 0) & (
        (f1 > SUSPICIOUS_FRACTION) | (f2 > SUSPICIOUS_FRACTION)
    )
    return counts.withColumns({
        "frac_consensus": f0, "frac_per_core_otsu": f1, "frac_leiden": f2,
        "disagreement_score": F.abs(f1 - f0) + F.abs(f2 - f0),
        "suspicious_zero_consensus": suspicious,
    }).select(*AUDIT_COLUMNS, *extra)


def audit_summary(audit: DataFrame) -> DataFrame:
    """Mean, population deviation and median over cores of the four measures, per marker."""
    rows = [{"measure": F.lit(m), "value": nan_to_null(F.col(m))} for m in MEASURES]
    # the moments and the median are separate branches over the whole audit
    long = cut(stack_columns(audit, ["marker"], rows))
    key = ["marker", "measure"]
    stats = long.groupBy(*key).agg(
        F.count("value").alias("n_cores"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    return stats.join(group_quantiles(long, key, "value", {"median": 0.5}).drop("n"), key, "left")


def top_suspicious(audit: DataFrame, n: int = 10) -> DataFrame:
    """Zero-consensus pairs that an alternative contradicts, the worst first."""
    return (
        audit.filter("suspicious_zero_consensus")
        .withColumn("alt_max", F.greatest("frac_per_core_otsu", "frac_leiden"))
        .orderBy(F.col("alt_max").desc(), "basename", "marker")
        .limit(n)
    )


def top_disagreement(audit: DataFrame, n: int = 10) -> DataFrame:
    return audit.orderBy(F.col("disagreement_score").desc(), "basename", "marker").limit(n)


def disagreement_gate(audit: DataFrame, maximum: float) -> DataFrame:
    """Mean disagreement per marker against the gate, with the suspicious count and the worst marker.

    One row per configured marker, so the windows hold a few dozen rows.
    """
    means = audit.groupBy("marker").agg(
        F.avg("disagreement_score").alias("mean_disagreement"),
        F.count_if("suspicious_zero_consensus").alias("n_suspicious"),
    )
    whole = Window.partitionBy()
    worst = F.max_by("marker", F.struct(F.round("mean_disagreement", 9), "marker")).over(whole)
    return means.select(
        "marker", "mean_disagreement", "n_suspicious",
        (F.col("mean_disagreement") > F.lit(float(maximum))).alias("fails"),
        (F.col("marker") == worst).alias("is_worst"),
        F.sum("n_suspicious").over(whole).alias("n_suspicious_total"),
    )


def reaudit(
    cells: DataFrame, thresholds: Mapping[int, Mapping[str, float]], new: str = "pos_spacec",
    panel: MarkerPanel = DEFAULT_PANEL, **kwargs,
) -> DataFrame:
    """The audit with the rebuilt labels in the place of the consensus."""
    swapped = cells.withColumns({
        ch(c, "pos_consensus"): F.col(ch(c, new)) for c in panel.channels if ch(c, new) in cells.columns
    })
    return audit_markers(swapped, thresholds, panel=panel, **kwargs)
