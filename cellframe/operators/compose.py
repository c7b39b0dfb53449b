"""Composition statistics per core and per cohort.

Every operator makes one map-side-combined pass over the cells; the rows per
marker or phenotype are unpivoted from the aggregated row, never from the cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.expr import (
    any_of, nan_to_null, ratio0, stack_columns, truthy,
)
from cellframe.functions.running import group_quantiles
from cellframe.operators.metrics import average_precision
from cellframe.operators.rules import filter_cohort
from cellframe.panel import DEFAULT_PANEL, MarkerPanel, Thresholds, ch, ph
from cellframe.session import cut

NO_CALL = "no_call"
HISTOGRAM_BINS = 10


def _mean(c: Column) -> Column:
    return F.avg(nan_to_null(c.cast("double")))


def core_composition(
    df: DataFrame, models: Sequence[str], panel: MarkerPanel = DEFAULT_PANEL
) -> DataFrame:
    """Per core: cell count and null-skipping means of truth, calls and predictions."""
    aggs = [F.count("*").alias("n_cells")]
    wanted: list[tuple[str, str]] = []
    wanted += [(ch(c, "pos"), f"frac_ch{c:02d}_pos_truth") for c in panel.channels]
    wanted += [(ph(n, "label"), f"frac_phenotype_{n}_truth") for n in panel.phenotypes]
    for m in models:
        for c in panel.channels:
            wanted.append((ch(c, "call", m), f"frac_ch{c:02d}_pos_{m}"))
            wanted.append((ch(c, "pred", m), f"mean_ch{c:02d}_pred_{m}"))
        wanted += [(ph(n, "call", m), f"frac_phenotype_{n}_call_{m}") for n in panel.phenotypes]
    aggs += [_mean(F.col(s)).alias(o) for s, o in wanted if s in df.columns]
    return df.groupBy("basename").agg(*aggs)


def _called(df: DataFrame, name: str, model: str) -> Column:
    column = ph(name, "call", model)
    return F.coalesce(F.col(column).cast("int") > 0, F.lit(False)) if column in df.columns else F.lit(False)


def phenotype_distribution(
    df: DataFrame, model: str, by: Sequence[str] = (), panel: MarkerPanel = DEFAULT_PANEL
) -> DataFrame:
    """Count and fraction of every phenotype call and of cells without any.

    Phenotypes overlap; only ``no_call`` plus the cells with a call add up to the total.
    """
    calls = {n: _called(df, n, model) for n in panel.phenotypes}
    aggs = [F.count("*").alias("__n")]
    aggs += [F.count_if(c).alias(f"__c_{n}") for n, c in calls.items()]
    aggs.append(F.count_if(~any_of(calls.values())).alias(f"__c_{NO_CALL}"))
    rows = [
        {
            "position": F.lit(i), "name": F.lit(n), "count": F.col(f"__c_{n}"),
            "fraction": ratio0(F.col(f"__c_{n}"), F.col("__n")),
        }
        for i, n in enumerate([*panel.phenotypes, NO_CALL])
    ]
    return stack_columns(df.groupBy(*by).agg(*aggs), by, rows)


def marker_positivity(
    df: DataFrame, thr: Thresholds, model: str, by: Sequence[str] = (),
    panel: MarkerPanel = DEFAULT_PANEL,
) -> DataFrame:
    """Count and fraction of cells whose prediction is above (not at) the threshold."""
    aggs = [F.count("*").alias("__n")]
    for n, c in panel.pairs:
        column = ch(c, "pred", model)
        hit = nan_to_null(F.col(column)) > thr.marker[n] if column in df.columns else F.lit(False)
        aggs.append(F.count_if(hit).alias(f"__p_{c}"))
    rows = [
        {
            "position": F.lit(i), "name": F.lit(n), "n_positive": F.col(f"__p_{c}"),
            "fraction_positive": ratio0(F.col(f"__p_{c}"), F.col("__n")),
            "confidence_stratum": F.lit(thr.stratum(n)),
        }
        for i, (n, c) in enumerate(panel.pairs)
    ]
    return stack_columns(df.groupBy(*by).agg(*aggs), by, rows)


def truth_comparison(
    df: DataFrame, thr: Thresholds, model: str, label_set_suffix: str = "pos",
    panel: MarkerPanel = DEFAULT_PANEL,
) -> DataFrame:
    """Per core and marker: predicted and true fraction, absolute error and AP.

    Missing truth counts as negative; AP is null for a single-class core. Cores
    without any truth give no rows.
    """
    rows = []
    for i, (n, c) in enumerate(panel.pairs):
        pred, truth = ch(c, "pred", model), ch(c, label_set_suffix)
        rows.append({
            "position": F.lit(i), "name": F.lit(n), "cut": F.lit(float(thr.marker[n])),
            **{k: (F.col(c) if c in df.columns else F.lit(None)).cast("double") for k, c in (("truth", truth), ("score", pred))},
        })
    # unknown values are told after the rows are stacked: one expression for all markers
    score, y = nan_to_null(F.col("score")), truthy(F.col("truth"))
    long = stack_columns(df, ["basename"], rows).select(
        "basename", "position", "name", F.coalesce(y, F.lit(False)).cast("int").alias("y"), score.alias("score"),
        y.isNotNull().alias("known"), F.coalesce(score > F.col("cut"), F.lit(False)).alias("above"),
    )
    key = ["basename", "position", "name"]
    # one row per core and marker, read by two branches
    base = cut(long.groupBy(*key).agg(
        F.avg(F.col("above").cast("double")).alias("predicted_fraction"),
        F.avg(F.col("y").cast("double")).alias("truth_fraction"),
        F.bool_or("known").alias("__known"),
        F.count_if(F.col("score").isNull()).alias("__gaps"),
    ))
    truth_cores = base.groupBy("basename").agg(F.bool_or("__known").alias("__any"))
    ap = average_precision(long, key, "y", "score", single_class_null=True)
    return (
        base.join(truth_cores.filter("__any").select("basename"), "basename", "left_semi")
        .join(ap.select(*key, "ap"), key, "left")
        .select(
            *key, "predicted_fraction", "truth_fraction",
            F.abs(F.col("predicted_fraction") - F.col("truth_fraction")).alias("absolute_error"),
            F.when(F.col("__gaps") == 0, F.col("ap")).alias("ap"),
        )
    )


def cohort_cells(
    cells: DataFrame, cores: DataFrame, tissue: str | None = None, tma: str | None = None,
    split: str | None = None,
) -> DataFrame:
    """Cells of the cores that pass the cohort filter (semi-join on the core key)."""
    kept = filter_cohort(cores, tissue, tma, split).select("basename")
    return cells.join(kept, "basename", "left_semi")


def cohort_stats(
    cells: DataFrame, cores: DataFrame, thr: Thresholds, model: str, tissue: str | None = None,
    tma: str | None = None, split: str | None = None, panel: MarkerPanel = DEFAULT_PANEL,
) -> DataFrame:
    """Pooled phenotype and marker rows of a cohort: ``kind, position, name, count, fraction``."""
    sub = cohort_cells(cells, cores, tissue, tma, split)
    ph_rows = phenotype_distribution(sub, model, panel=panel)
    mk_rows = marker_positivity(sub, thr, model, panel=panel)
    return ph_rows.select(
        F.lit("phenotype").alias("kind"), "position", "name", "count", "fraction",
        F.lit(None).cast("string").alias("confidence_stratum"),
    ).unionByName(
        mk_rows.select(
            F.lit("marker").alias("kind"), "position", "name",
            F.col("n_positive").alias("count"), F.col("fraction_positive").alias("fraction"),
            "confidence_stratum",
        )
    )


def core_fraction_histogram(df: DataFrame, phenotype: str, model: str) -> DataFrame:
    """Ten-bin histogram over cores of the fraction of cells with the call; empty bins included."""
    fraction = F.avg(F.col(ph(phenotype, "call", model)).cast("int").cast("double"))
    binned = (
        df.groupBy("basename").agg(fraction.alias("f"))
        .filter(F.col("f").isNotNull())
        .groupBy(F.least(F.floor(F.col("f") * HISTOGRAM_BINS), F.lit(HISTOGRAM_BINS - 1)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    bins = df.sparkSession.range(HISTOGRAM_BINS).withColumnRenamed("id", "bin")
    return bins.join(binned, "bin", "left").select(
        "bin",
        (F.col("bin") / F.lit(float(HISTOGRAM_BINS))).alias("lower"),
        F.coalesce("n", F.lit(0)).alias("n_cores"),
    )


def cores_with_truth(cores: DataFrame, panel: MarkerPanel = DEFAULT_PANEL) -> DataFrame:
    """Number of cores with any known truth fraction."""
    cols = [f"frac_ch{c:02d}_pos_truth" for c in panel.channels]
    cols = [nan_to_null(F.col(c)) for c in cols if c in cores.columns]
    hit = F.coalesce(*cols).isNotNull() if cols else F.lit(False)
    return cores.agg(F.count_if(hit).alias("n_cores_with_truth"))


def _configured(names: Sequence[str], kind: str, thr: Thresholds) -> Column:
    return F.array(*[
        F.struct(
            F.lit(kind).alias("kind"), F.lit(i).alias("position"), F.lit(n).alias("name"),
            F.lit(thr.stratum(n)).alias("confidence_stratum"),
        )
        for i, n in enumerate(names)
    ])


def validation_table(
    models: DataFrame, model: str, thr: Thresholds, cores: DataFrame, per_core: DataFrame,
    panel: MarkerPanel = DEFAULT_PANEL,
) -> DataFrame:
    """Macro AP of a registered model for every marker and phenotype, in panel order.

    ``models`` carries the maps ``per_marker_ap`` and ``per_phenotype_ap``;
    ``per_core`` is ``name, per_core_ap``. A missing entry is an error.
    """
    entry = models.filter(F.col("id") == model).select(
        "id", "per_marker_ap", "per_phenotype_ap",
        F.inline(F.concat(
            _configured(panel.names, "marker", thr),
            _configured(panel.phenotypes, "phenotype", thr),
        )),
    )
    found = F.when(
        F.col("kind") == "marker", F.try_element_at("per_marker_ap", F.col("name"))
    ).otherwise(F.try_element_at("per_phenotype_ap", F.col("name")))
    checked = F.coalesce(
        found,
        F.raise_error(F.concat(F.lit("model validation metadata is incomplete: "), F.col("name"))).cast("double"),
    )
    return (
        entry.select("id", "kind", "position", "name", "confidence_stratum", checked.alias("macro_ap"))
        .join(per_core, "name", "left")
        .withColumn("n_cores_with_truth", cores_with_truth(cores, panel).scalar())
        .select(
            "kind", "position", "name", "macro_ap", "n_cores_with_truth", "confidence_stratum",
            "per_core_ap",
        )
    )


def summarize_ap(df: DataFrame, by: Sequence[str], ap: str = "ap") -> DataFrame:
    """Mean, median and population deviation of the finite values per group."""
    # the moments and the median are separate branches
    clean = cut(df.select(*by, nan_to_null(F.col(ap)).alias("__v")))
    stats = clean.groupBy(*by).agg(
        F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std"), F.count("__v").alias("n")
    )
    median = group_quantiles(clean, by, "__v", {"median": 0.5}).drop("n")
    return stats.join(median, list(by), "left").select(*by, "n", "mean", "median", "std")


def dominant_class(dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The most frequent phenotype, ``no_call`` left out; the earlier name wins a tie."""
    return (
        dist.filter(F.col("name") != NO_CALL)
        .groupBy(*by)
        .agg(
            F.max_by("name", F.struct(F.col("count"), -F.col("position"))).alias("name"),
            F.max("count").alias("count"),
        )
    )


def distribution_order(dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Table order of a distribution: by count descending, ``no_call`` last. Adds ``rank``.

    A group has one row per configured phenotype.
    """
    w = Window.partitionBy(*by).orderBy(
        (F.col("name") == NO_CALL).asc(), F.col("count").desc(), F.col("position").asc()
    )
    return dist.withColumn("rank", F.row_number().over(w))


def core_phenotype_summary(
    cores: DataFrame, basename: str | None, thr: Thresholds, model: str,
    panel: MarkerPanel = DEFAULT_PANEL,
) -> DataFrame:
    """Markers and phenotypes of a core (or of all) with fractions, threshold and confidence."""
    def column(name: str) -> Column:
        return nan_to_null(F.col(name)) if name in cores.columns else F.lit(None).cast("double")

    rows = []
    for i, (n, c) in enumerate(panel.pairs):
        rows.append({
            "kind": F.lit("marker"), "position": F.lit(i), "name": F.lit(n),
            "frac_pred": column(f"frac_ch{c:02d}_pos_{model}"),
            "frac_truth": column(f"frac_ch{c:02d}_pos_truth"),
            "threshold": F.lit(float(thr.marker[n])), "confidence": F.lit(thr.stratum(n)),
        })
    for i, n in enumerate(panel.phenotypes):
        rows.append({
            "kind": F.lit("phenotype"), "position": F.lit(i), "name": F.lit(n),
            "frac_pred": column(f"frac_phenotype_{n}_call_{model}"),
            "frac_truth": column(f"frac_phenotype_{n}_truth"),
            "threshold": F.lit(float(thr.phenotype[n])), "confidence": F.lit(thr.stratum(n)),
        })
    df = cores if basename is None else cores.filter(F.col("basename") == basename)
    return stack_columns(df, ["basename"], rows)


def info(cores: DataFrame, columns: Sequence[str] = ("tma", "tissue", "split")) -> DataFrame:
    """The distinct values of the core attributes, one row per attribute and value."""
    rows = [{"attribute": F.lit(c), "value": F.col(c)} for c in columns]
    return (
        stack_columns(cores, [], rows).filter(F.col("value").isNotNull())
        .groupBy("attribute", "value").agg(F.count("*").alias("n_cores"))
    )


def positive_counts(
    df: DataFrame, panel: MarkerPanel = DEFAULT_PANEL, family: str = "pos", by: Sequence[str] = ()
) -> DataFrame:
    """Positive cells per marker; an absent column counts as 0."""
    def hit(c: int) -> Column:
        name = ch(c, family)
        return truthy(F.col(name)) if name in df.columns else F.lit(False)

    agg = df.groupBy(*by).agg(*[F.count_if(hit(c)).alias(f"__p_{c}") for c in panel.channels])
    rows = [
        {"channel": F.lit(c), "marker": F.lit(n), "n_positive": F.col(f"__p_{c}")}
        for n, c in panel.pairs
    ]
    return stack_columns(agg, by, rows)


def label_change(
    df: DataFrame, panel: MarkerPanel = DEFAULT_PANEL, old: str = "pos_gmm_orig",
    new: str = "pos_consensus", disagree: str = "pos_disagree", by: Sequence[str] = (),
) -> DataFrame:
    """Per marker: old and new positive fraction, method disagreement and changed labels."""
    aggs, rows = [F.count("*").alias("n_cells")], []
    for n, c in panel.pairs:
        if ch(c, old) not in df.columns:
            continue
        a, b = truthy(F.col(ch(c, old))), truthy(F.col(ch(c, new)))
        aggs += [
            F.avg(a.cast("double")).alias(f"__a_{c}"),
            F.avg(b.cast("double")).alias(f"__b_{c}"),
            F.avg(truthy(F.col(ch(c, disagree))).cast("double")).alias(f"__d_{c}"),
            F.avg((a != b).cast("double")).alias(f"__x_{c}"),
        ]
        rows.append({
            "channel": F.lit(c), "name": F.lit(n), "n_cells": F.col("n_cells"),
            "frac_pos_gmm": F.col(f"__a_{c}"), "frac_pos_consensus": F.col(f"__b_{c}"),
            "frac_disagree_among_methods": F.col(f"__d_{c}"), "frac_changed_label": F.col(f"__x_{c}"),
        })
    return stack_columns(df.groupBy(*by).agg(*aggs), by, rows)


def split_counts(df: DataFrame, panel: MarkerPanel = DEFAULT_PANEL, by: Sequence[str] = ("split",)) -> DataFrame:
    """Per split: rows, cores and positives per marker and phenotype label."""
    per_core = df.groupBy(*by, "basename").agg(
        F.count("*").alias("__n"),
        *[F.count_if(truthy(F.col(ch(c, "pos")))).alias(f"__m_{c}") for c in panel.channels],
        *[F.count_if(truthy(F.col(ph(n, "label")))).alias(f"__f_{n}") for n in panel.phenotypes],
    )
    total = per_core.groupBy(*by).agg(
        F.sum("__n").alias("n_rows"), F.count("*").alias("n_cores"),
        *[F.sum(f"__m_{c}").alias(f"__m_{c}") for c in panel.channels],
        *[F.sum(f"__f_{n}").alias(f"__f_{n}") for n in panel.phenotypes],
    )
    rows = [
        {"kind": F.lit("marker"), "position": F.lit(i), "name": F.lit(n), "positives": F.col(f"__m_{c}")}
        for i, (n, c) in enumerate(panel.pairs)
    ] + [
        {"kind": F.lit("phenotype"), "position": F.lit(i), "name": F.lit(n), "positives": F.col(f"__f_{n}")}
        for i, n in enumerate(panel.phenotypes)
    ]
    return stack_columns(total, [*by, "n_rows", "n_cores"], rows)


def composition_with_other(
    df: DataFrame, by: Sequence[str], name: str = "name", fraction: str = "fraction",
    minimum: float = 0.01,
) -> DataFrame:
    """Fractions with everything below ``minimum`` pooled as ``other``; unknown fractions dropped."""
    f = nan_to_null(F.col(fraction))
    return (
        df.filter(f.isNotNull())
        .groupBy(*by, F.when(f < minimum, F.lit("other")).otherwise(F.col(name)).alias(name))
        .agg(F.sum(f).alias(fraction))
    )


def score_histogram(
    df: DataFrame, model: str, bins: int = 40, panel: MarkerPanel = DEFAULT_PANEL
) -> DataFrame:
    """Histogram on [0, 1] of every marker's prediction, split by truth, as a density.

    Values outside the range are left out, the last bin is closed.
    """
    rows = [
        {
            "marker": F.lit(n), "truth": F.coalesce(truthy(F.col(ch(c, "pos"))), F.lit(False)),
            "score": nan_to_null(F.col(ch(c, "pred", model))),
        }
        for n, c in panel.pairs
        if ch(c, "pred", model) in df.columns and ch(c, "pos") in df.columns
    ]
    counted = (
        stack_columns(df, [], rows)
        .filter(F.col("score").between(0.0, 1.0))
        .groupBy(
            "marker", "truth",
            F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin"),
        )
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("marker", "truth"))
    return counted.withColumn("density", F.col("n") * F.lit(float(bins)) / total)


def class_alpha(df: DataFrame, panel: MarkerPanel = DEFAULT_PANEL) -> DataFrame:
    """Smoothed share of negatives per class, the weight of its positives in a focal loss."""
    aggs, rows = [], []
    classes = [("marker", i, n, ch(c, "pos")) for i, (n, c) in enumerate(panel.pairs)]
    classes += [("phenotype", i, n, ph(n, "label")) for i, n in enumerate(panel.phenotypes)]
    for kind, i, n, column in classes:
        y = F.coalesce(truthy(F.col(column)), F.lit(False))
        aggs += [F.count_if(y).alias(f"__p_{column}"), F.count_if(~y).alias(f"__q_{column}")]
        p, q = F.col(f"__p_{column}"), F.col(f"__q_{column}")
        rows.append({
            "kind": F.lit(kind), "position": F.lit(i), "name": F.lit(n),
            "alpha": (q + F.lit(1.0)) / (p + q + F.lit(2.0)),
        })
    return stack_columns(df.agg(*aggs), [], rows)

