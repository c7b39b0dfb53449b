"""Registration manifests: status repair, retry lists and residual statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.functions.expr import finite, nan_to_null
from cellframe.functions.running import group_quantiles

# Statuses a manifest can hold.
USABLE = ("ok", "cached")
REJECTED = ("bad_alignment", "fail", "empty_he", "empty_codex")
STATUSES = USABLE + REJECTED


def manifest_status(manifest: DataFrame) -> DataFrame:
    """Cores per slide and status, zeros included."""
    counts = manifest.groupBy("tma").pivot("status", list(STATUSES)).agg(F.count(F.lit(1)))
    return counts.na.fill(0)


def residual_stats(manifest: DataFrame) -> DataFrame:
    """Count, mean, median, 95th percentile and maximum residual of the usable cores."""
    usable = manifest.filter(F.col("status").isin(*USABLE)).select(
        nan_to_null(F.col("rigid_D_px")).alias("v")
    ).filter("v is not null")
    stats = usable.agg(F.struct(F.avg("v").alias("mean"), F.max("v").alias("max")).alias("s")).scalar()
    quantiles = group_quantiles(usable, [], "v", {"median": 0.5, "p95": 0.95})
    return quantiles.select("n", stats["mean"].alias("mean"), "median", "p95", stats["max"].alias("max"))


def repair_manifest(manifest: DataFrame, meta: DataFrame, cutoff: float) -> DataFrame:
    """Statuses derived again from the recorded residual and the presence of the arrays.

    ``meta`` has ``tma, core, has_arrays, residual``. A residual replaces the stored one;
    with arrays and a finite residual the core is rejected above the cut-off and
    otherwise usable again.
    """
    joined = manifest.join(
        meta.select("tma", "core", "has_arrays", F.col("residual").alias("__r")), ["tma", "core"], "left"
    )
    decidable = F.coalesce(F.col("has_arrays"), F.lit(False)) & finite(F.col("__r")).isNotNull()
    above = decidable & (F.col("__r") > cutoff)
    revive = decidable & (F.col("__r") <= cutoff) & ~F.col("status").isin(*USABLE)
    note = F.concat(
        F.lit("rigid_D="), F.format_string("%.1f", F.bround("__r", 1)), F.lit(f"px > {cutoff}")
    )
    error = F.col("error") if "error" in manifest.columns else F.lit(None).cast("string")
    return joined.withColumns({
        "rigid_D_px": F.coalesce(F.col("__r"), F.col("rigid_D_px")),
        "error": F.when(above, note).when(revive, F.lit("")).otherwise(error),
        "status": F.when(above, F.lit("bad_alignment")).when(revive, F.lit("cached")).otherwise(F.col("status")),
    }).drop("__r", "has_arrays")


def retry_list(manifest: DataFrame, cutoff: float) -> DataFrame:
    """Cores that were rejected or whose residual is above the cut-off."""
    high = F.coalesce(nan_to_null(F.col("rigid_D_px")) > cutoff, F.lit(False))
    return manifest.filter(F.col("status").isin(*REJECTED) | high)


def purge_list(manifest: DataFrame) -> DataFrame:
    """Cores whose arrays must not be kept."""
    return manifest.filter(~F.coalesce(F.col("status").isin(*USABLE), F.lit(False)))


def todo_cores(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cores without a usable entry yet: what an interrupted run has left to do."""
    done = manifest.filter(F.col("status").isin(*USABLE)).select("tma", "core")
    return wanted.join(done, ["tma", "core"], "left_anti")
