"""Exact ranking metrics and losses, grouped.

The metrics are built on running totals over distinct scores, so a group may
hold any share of the rows (see :mod:`cellframe.functions.running`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.expr import (
    clip, nan_to_null, ratio, stack_columns, truthy,
)
from cellframe.functions.running import running_totals, tie_totals
from cellframe.panel import DEFAULT_PANEL, MarkerPanel, ch, ph


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Give an ungrouped metric a constant key."""
    return (df, list(by)) if by else (df.withColumn("__all", F.lit(0)), ["__all"])


def pr_table(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    """One row per group and distinct score, from high to low, with running positives and count.

    Rows without a score or label are left out.
    """
    label = truthy(F.col(y))
    known = df.filter(label.isNotNull()).select(
        *by, label.cast("long").alias("__y"), nan_to_null(F.col(score)).alias(score)
    )
    ties = tie_totals(known, by, score, {"tp": F.col("__y"), "n": F.lit(1)})
    return running_totals(ties, by, score, ["tp", "n"], descending=True)


def _metrics_agg() -> list[Column]:
    tp, n, rtp, rn = (F.col(c).cast("double") for c in ("tp", "n", "run_tp", "run_n"))
    return [
        F.sum("tp").alias("n_pos"), F.sum("n").alias("n"),
        F.sum(tp * rtp / rn).alias("__ap"),
        F.sum((n - tp) * (rtp - tp / F.lit(2.0))).alias("__auc"),
    ]


def _best_cut(score: str) -> Column:
    """Best F1 with the lowest cut that reaches it, as a struct ``__b(f, s)``."""
    f1 = F.col("run_tp").cast("double") * 2.0 / (F.col("run_n") + F.col("tot_tp"))
    return F.max(F.struct(F.round(f1, 12).alias("f"), (-F.col(score)).alias("s"))).alias("__b")


def rank_metrics(
    df: DataFrame, by: Sequence[str], y: str, score: str, single_class_null: bool = True
) -> DataFrame:
    """``n``, ``n_pos``, step-wise average precision and ROC AUC per group.

    A group with one class gives null; with ``single_class_null=False`` only a
    group without positives does.
    """
    src, keys = _grouped(df, by)
    agg = pr_table(src, keys, y, score).groupBy(*keys).agg(*_metrics_agg())
    neg = F.col("n") - F.col("n_pos")
    two = (F.col("n_pos") > 0) & (neg > 0)
    ap_ok = two if single_class_null else F.col("n_pos") > 0
    return agg.select(
        *by, "n", "n_pos",
        F.when(ap_ok, ratio(F.col("__ap"), F.col("n_pos"))).alias("ap"),
        F.when(two, ratio(F.col("__auc"), F.col("n_pos") * neg)).alias("auc"),
    )


def average_precision(
    df: DataFrame, by: Sequence[str], y: str, score: str, single_class_null: bool = True
) -> DataFrame:
    return rank_metrics(df, by, y, score, single_class_null).select(*by, "n", "n_pos", "ap")


def roc_auc(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    return rank_metrics(df, by, y, score).select(*by, "n", "n_pos", "auc")


def best_f1(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    """Cut with the highest F1 on the precision-recall curve; the lowest cut wins a tie."""
    src, keys = _grouped(df, by)
    best = pr_table(src, keys, y, score).groupBy(*keys).agg(
        F.max("tot_tp").alias("n_pos"), F.max("tot_n").alias("n"), _best_cut(score)
    )
    two = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return best.select(
        *by, "n", "n_pos",
        F.when(two, -F.col("__b.s")).alias("best_threshold"),
        F.when(two, F.col("__b.f")).alias("best_f1"),
    )


def cut_metrics(df: DataFrame, by: Sequence[str], y: str, predicted: Column) -> DataFrame:
    """F1 and balanced accuracy of a Boolean prediction; null for a single class."""
    label, hit = truthy(F.col(y)), F.coalesce(predicted, F.lit(False))
    counts = df.filter(label.isNotNull()).groupBy(*by).agg(
        F.count_if(label & hit).alias("tp"), F.count_if(~label & hit).alias("fp"),
        F.count_if(label & ~hit).alias("fn"), F.count_if(~label & ~hit).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    two = (tp + fn > 0) & (fp + tn > 0)
    return counts.select(
        *by, "tp", "fp", "fn", "tn",
        F.when(two, F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))).alias("f1"),
        F.when(two, (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / F.lit(2.0)).alias("balanced_accuracy"),
    )


def fit_operating_threshold(
    train: DataFrame, by: Sequence[str], y: str, score: str
) -> DataFrame:
    """The best-F1 cut per group; a single-class group is an error."""
    return operating_threshold(best_f1(train, by, y, score), by, "best_f1")


def operating_threshold(best: DataFrame, by: Sequence[str], *keep: str) -> DataFrame:
    """``threshold`` from the ``best_threshold`` of every group; a single-class group is an error."""
    message = F.lit("cannot fit an operating threshold without both label classes")
    return best.select(
        *by,
        F.coalesce("best_threshold", F.raise_error(message).cast("double")).alias("threshold"),
        *keep,
    )


Item = tuple[str, int, str]


def checked(long: DataFrame) -> DataFrame:
    """Stacked rows with ``y`` as Boolean and ``score`` without NaN: one expression for all entries, not one for each."""
    return long.withColumns({"y": truthy(F.col("y")), "score": nan_to_null(F.col("score"))})


def item_rows(
    columns: Sequence[str], model: str | None, panel: MarkerPanel = DEFAULT_PANEL, pred: str = "pred", truth: str = "pos",
    markers: bool = True, phenotypes: bool = True, first: int = 0,
) -> tuple[list[dict[str, Column]], list[Item]]:
    """The ``item, y, score`` entry of every marker and phenotype that has both columns, numbered from ``first`` on.

    The values are as they are; :func:`checked` tells the unknown ones after the rows are stacked.
    """
    items: list[Item] = []
    rows = []

    def include(kind: str, position: int, name: str, score: str, label: str) -> None:
        if score in columns and label in columns:
            rows.append({
                "item": F.lit(first + len(items)), "y": F.col(label).cast("double"), "score": F.col(score).cast("double"),
            })
            items.append((kind, position, name))

    if markers:
        for i, (n, c) in enumerate(panel.pairs):
            include("marker", i, n, ch(c, pred, model), ch(c, truth))
    if phenotypes:
        for i, n in enumerate(panel.phenotypes):
            include("phenotype", i, n, ph(n, "score", model), ph(n, "label"))
    if not rows:
        raise ValueError(f"no evaluable predictions for model {model!r}")
    return rows, items


def melt_items(df: DataFrame, model: str | None, panel: MarkerPanel = DEFAULT_PANEL, keep: Sequence[str] = (), **options) -> tuple[DataFrame, list[Item]]:
    """Long ``item, y, score`` rows of every marker and phenotype that has both columns.

    ``item`` indexes the returned ``(kind, position, name)`` list: a small integer is
    shuffled instead of the names.
    """
    rows, items = item_rows(df.columns, model, panel, **options)
    return checked(stack_columns(df, keep, rows)), items


def name_items(df: DataFrame, items: Sequence[Item]) -> DataFrame:
    """Replace ``item`` by ``kind, position, name``."""
    table = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(i).alias("position"), F.lit(n).alias("name")) for k, i, n in items
    ])
    entry = F.get(table, F.col("item"))
    front = [c for c in df.columns if c == "basename"]
    rest = [c for c in df.columns if c not in ("item", *front)]
    return df.select(*front, *[entry[c].alias(c) for c in METRIC_KEY], *rest)


def melt_scored(df: DataFrame, model: str | None, panel: MarkerPanel = DEFAULT_PANEL, **options) -> DataFrame:
    """The rows of :func:`melt_items` with their names."""
    return name_items(*melt_items(df, model, panel, **options))


METRIC_KEY = ("kind", "position", "name")


def models_metrics(df: DataFrame, models: Sequence[str], panel: MarkerPanel = DEFAULT_PANEL) -> DataFrame:
    """:func:`model_metrics` of several models, which are ranked together in one pass over the cells.

    Adds ``model``. A model without any score column is an error; its kinds without an evaluable name have no row.
    """
    rows, items, owners = [], [], []
    for model in dict.fromkeys(models):
        more, named = item_rows(df.columns, model, panel, first=len(items))
        rows += more
        items += named
        owners += [model] * len(named)
    ap = average_precision(checked(stack_columns(df, [], rows)), ["item"], "y", "score", single_class_null=False).filter(
        (F.col("n") >= 2) & F.col("ap").isNotNull()
    )
    ap = name_items(ap.withColumn("model", F.get(F.array(*[F.lit(m) for m in owners]), F.col("item"))), items)
    # one row per model and configured name, so the window holds a few dozen rows
    macro = F.avg("ap").over(Window.partitionBy("model", "kind"))
    return ap.select("model", *METRIC_KEY, "n", "n_pos", "ap", macro.alias("macro_ap"))


def model_metrics(df: DataFrame, model: str, panel: MarkerPanel = DEFAULT_PANEL) -> DataFrame:
    """AP per marker and phenotype on rows that have both values, plus the macro mean per kind.

    Names without positives are left out; a kind without any evaluable name has no row.
    """
    return models_metrics(df, [model], panel).drop("model")


def within_core_lift(
    df: DataFrame, model: str, core_means: DataFrame, panel: MarkerPanel = DEFAULT_PANEL,
    truth: str = "pos",
) -> DataFrame:
    """AP of the model against AP of the core mean of the baseline prediction.

    ``core_means`` is ``df`` with ``core_mean_chXX_pred`` columns attached.
    """
    rows = []
    for i, (n, c) in enumerate(panel.pairs):
        y = F.col(ch(c, truth)).cast("double")
        for arm, column in (("model", ch(c, "pred", model)), ("base", f"core_mean_ch{c:02d}_pred")):
            rows.append({
                "position": F.lit(i), "channel": F.lit(c), "name": F.lit(n), "arm": F.lit(arm),
                "y": y, "score": F.col(column).cast("double"),
            })
    key = ["position", "channel", "name"]
    ap = average_precision(checked(stack_columns(core_means, [], rows)), [*key, "arm"], "y", "score")
    return (
        ap.groupBy(*key)
        .agg(
            F.max("n").alias("n_eval_cells"),
            F.max(ratio(F.col("n_pos"), F.col("n"))).alias("positive_fraction"),
            F.max(F.when(F.col("arm") == "model", F.col("ap"))).alias("model_ap"),
            F.max(F.when(F.col("arm") == "base", F.col("ap"))).alias("baseline_ap_core_mean"),
        )
        .withColumn("lift", F.col("model_ap") - F.col("baseline_ap_core_mean"))
    )


def macro_lift(lift: DataFrame) -> DataFrame:
    return lift.agg(
        F.avg("model_ap").alias("macro_model_ap"),
        F.avg("baseline_ap_core_mean").alias("macro_baseline_ap_core_mean"),
        F.avg("lift").alias("macro_within_core_lift"),
    )


def score_report(long: DataFrame, key: Sequence[str]) -> DataFrame:
    """n, prevalence, AUC, AP, F1 at 0.5 and the best F1 of long ``y, score`` rows.

    One precision-recall table feeds all of them: the cut at 0.5 is read off the
    running totals.
    """
    totals = pr_table(long, key, "y", "score").groupBy(*key).agg(
        *_metrics_agg(), _best_cut("score"),
        F.sum(F.when(F.col("score") > 0.5, F.col("tp")).otherwise(F.lit(0))).alias("__tp5"),
        F.sum(F.when(F.col("score") > 0.5, F.col("n")).otherwise(F.lit(0))).alias("__n5"),
    )
    neg = F.col("n") - F.col("n_pos")
    two = (F.col("n_pos") > 0) & (neg > 0)
    return totals.select(
        *key,
        F.col("n").alias("n_eval_cells"),
        ratio(F.col("n_pos"), F.col("n")).alias("positive_fraction"),
        F.when(two, ratio(F.col("__auc"), F.col("n_pos") * neg)).alias("auc"),
        F.when(two, ratio(F.col("__ap"), F.col("n_pos"))).alias("ap"),
        F.when(two, ratio(2 * F.col("__tp5"), F.col("__n5") + F.col("n_pos"))).alias("f1_at_0p5"),
        F.when(two, F.col("__b.f")).alias("best_possible_f1"),
        F.when(two, -F.col("__b.s")).alias("best_threshold"),
    )


def marker_metrics(df: DataFrame, model: str | None, panel: MarkerPanel = DEFAULT_PANEL,
                   pred: str = "pred") -> DataFrame:
    long, items = melt_items(df, model, panel, pred=pred, phenotypes=False)
    return name_items(score_report(long, ["item"]), items)


def phenotype_metrics(df: DataFrame, model: str | None, panel: MarkerPanel = DEFAULT_PANEL) -> DataFrame:
    long, items = melt_items(df, model, panel, markers=False)
    return name_items(score_report(long, ["item"]), items)


def per_core_ap(df: DataFrame, model: str, panel: MarkerPanel = DEFAULT_PANEL) -> DataFrame:
    long, items = melt_items(df, model, panel, keep=["basename"])
    return name_items(average_precision(long, ["basename", "item"], "y", "score"), items)


def focal_bce(
    logit: Column, target: Column, alpha: Column | float, gamma: float
) -> Column:
    """Class-balanced focal binary cross-entropy of one entry, from the logit."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    p = sigmoid(logit)
    positive = target > 0.5
    bce = F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))
    pt = F.when(positive, p).otherwise(F.lit(1.0) - p)
    weight = F.when(positive, a).otherwise(F.lit(1.0) - a)
    return weight * F.pow(F.lit(1.0) - pt, F.lit(float(gamma))) * bce


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def asymmetric_loss(
    logit: Column, target: Column, gamma_pos: float = 0.0, gamma_neg: float = 4.0,
    clip: float = 0.05, eps: float = 1e-8,
) -> Column:
    """Asymmetric multi-label loss of one entry: separate focusing and a shifted negative side."""
    if gamma_pos < 0 or gamma_neg < 0:
        raise ValueError("focusing exponents must be >= 0")
    if not 0 <= clip < 1:
        raise ValueError("clip must be in [0, 1)")
    p = sigmoid(logit)
    shifted = F.greatest(p - F.lit(clip), F.lit(0.0)) if clip > 0 else p
    log_p = F.least(logit, F.lit(0.0)) - F.log1p(F.exp(-F.abs(logit)))
    log_q = F.log(F.greatest(F.lit(1.0) - shifted, F.lit(eps)))
    w_pos = F.pow(F.lit(1.0) - p, F.lit(float(gamma_pos))) if gamma_pos > 0 else F.lit(1.0)
    w_neg = F.pow(shifted, F.lit(float(gamma_neg))) if gamma_neg > 0 else F.lit(1.0)
    return -(target * w_pos * log_p + (F.lit(1.0) - target) * w_neg * log_q)


def masked_mean(loss: Column, ignore: Column | None = None) -> Column:
    """Mean over entries that are not ignored; 0 if all are."""
    if ignore is None:
        return F.avg(loss)
    keep = ~F.coalesce(ignore, F.lit(False))
    total = F.coalesce(F.sum(F.when(keep, loss)), F.lit(0.0))
    return total / F.greatest(F.count_if(keep), F.lit(1)).cast("double")


def hierarchy_penalty(
    df: DataFrame, logits: dict[str, Column], by: Sequence[str] = (),
    panel: MarkerPanel = DEFAULT_PANEL,
) -> DataFrame:
    """Mean over the hierarchy pairs of the mean positive part of child minus parent logit.

    A cell without one of a pair's logits is no part of that pair's mean.
    """
    terms = [
        F.avg(clip(logits[c] - logits[p], 0.0, float("inf"))) for c, p in panel.hierarchy
    ]
    if not terms:
        return df.groupBy(*by).agg(F.lit(0.0).alias("hierarchy_penalty"))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.groupBy(*by).agg((total / F.lit(float(len(terms)))).alias("hierarchy_penalty"))

