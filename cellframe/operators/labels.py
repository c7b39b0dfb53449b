"""Threshold fitting and consensus labels over marker intensities."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from cellframe.functions.expr import literal_map, nan_to_null, ratio, stack_columns, truthy
from cellframe.functions.running import group_quantiles, join_salted
from cellframe.panel import DEFAULT_PANEL, MarkerPanel, ch
from cellframe.session import cut

OTSU_BINS = 256
GRID = 1024
METHODS = ("gmm", "otsu", "quantile")
FALLBACK_QUANTILE = 0.9
MIN_FIT_VALUES = 50
# Rounds, tolerances and the variance added to every component.
MIXTURE_ROUNDS, MIXTURE_TOLERANCE, ADDED_VARIANCE = 200, 1e-3, 1e-4
SPLIT_ROUNDS, SPLIT_TOLERANCE = 300, 1e-4
MIN_MASS = 1e-9


def otsu_cuts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Otsu cut per group: the centre of the 256-bin histogram bin with the largest between-class
    variance, the lowest one on a tie. Adds ``n``; the cut is +inf with fewer than two distinct values.

    Two map-side-combined passes; only the histogram (at most 256 rows per group) is ordered.
    """
    v = nan_to_null(F.col(value))
    clean = df.filter(v.isNotNull()).select(*by, v.alias("__v"))
    span = clean.groupBy(*by).agg(
        F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("__v").alias("n")
    )
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(OTSU_BINS))
    position = F.try_divide((F.col("__v") - F.col("__lo")) * F.lit(float(OTSU_BINS)), F.col("__hi") - F.col("__lo"))
    hist = (
        join_salted(clean, span, list(by), F.col("__v"))
        .select(
            *by, "__salt", "n", "__lo", "__hi",
            F.least(F.coalesce(F.floor(position), F.lit(0)), F.lit(OTSU_BINS - 1)).alias("__bin"),
        )
        .groupBy(*by, "__salt", "n", "__lo", "__hi", "__bin")
        .agg(F.count("*").alias("__c"))
        .groupBy(*by, "n", "__lo", "__hi", "__bin")
        .agg(F.sum("__c").cast("double").alias("__c"))
        .withColumn("__x", F.col("__lo") + width * (F.col("__bin") + F.lit(0.5)))
    )
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.select(
        *by, "n", "__lo", "__hi", "__bin", "__x",
        F.sum("__c").over(upto).alias("__w1"),
        F.sum(F.col("__c") * F.col("__x")).over(upto).alias("__s1"),
        F.sum("__c").over(whole).alias("__w"),
        F.sum(F.col("__c") * F.col("__x")).over(whole).alias("__s"),
    )
    w2 = F.col("__w") - F.col("__w1")
    gap = ratio(F.col("__s1"), F.col("__w1")) - ratio(F.col("__s") - F.col("__s1"), w2)
    variance = F.when(w2 > 0, F.round(F.col("__w1") * w2 * gap * gap, 4))
    best = ranked.groupBy(*by, "n", "__lo", "__hi").agg(
        F.max_by("__x", F.struct(variance.alias("v"), (-F.col("__bin")).alias("b"))).alias("__cut")
    )
    return best.select(
        *by, "n",
        F.when(F.col("__hi") > F.col("__lo"), F.col("__cut")).otherwise(F.lit(float("inf"))).alias("otsu"),
    )


def otsu(df: DataFrame, value: str, by: Sequence[str] = ("basename",), out: str = "otsu_pos") -> DataFrame:
    """Attach the group's Otsu cut and the strict ``value > cut`` call."""
    cuts = otsu_cuts(df, by, value).drop("n")
    return df.join(cuts, list(by), "left").withColumn(
        out, F.coalesce(nan_to_null(F.col(value)) > F.col("otsu"), F.lit(False))
    )


def melt_values(df: DataFrame, panel: MarkerPanel = DEFAULT_PANEL, keep: Sequence[str] = ()) -> DataFrame:
    """Long ``channel, name, v`` rows of the measured intensity as stored."""
    rows = [
        {"channel": F.lit(c), "name": F.lit(n), "v": nan_to_null(F.col(ch(c, "true")))}
        for n, c in panel.pairs
        if ch(c, "true") in df.columns
    ]
    return stack_columns(df, keep, rows)


def otsu_train(df: DataFrame, panel: MarkerPanel = DEFAULT_PANEL) -> DataFrame:
    """Otsu cut per channel over the training cells; few or flat values take the 0.9 quantile."""
    long = melt_values(df, panel)
    cuts = otsu_cuts(long, ["channel"], "v")
    fallback = group_quantiles(long, ["channel"], "v", {"q": FALLBACK_QUANTILE}).drop("n")
    usable = (F.col("n") > MIN_FIT_VALUES) & (F.col("otsu") < F.lit(float("inf")))
    return cuts.join(fallback, "channel").select(
        "channel", "n", F.when(usable, F.col("otsu")).otherwise(F.col("q")).alias("tau_otsu")
    )


def quantile_match(
    df: DataFrame, rates: Mapping[int, float], panel: MarkerPanel = DEFAULT_PANEL
) -> DataFrame:
    """Quantile per channel that leaves the target positive rate above it."""
    long = melt_values(df, panel).filter(F.col("channel").isin(list(rates)))
    return group_quantiles(long, ["channel"], "v", {"tau_quantile": quantile_level(rates)})


def quantile_level(rates: Mapping[int, float]) -> Column:
    level = F.lit(None).cast("double")
    for c, rate in rates.items():
        level = F.when(F.col("channel") == c, F.lit(min(max(1.0 - float(rate), 0.01), 0.999))).otherwise(level)
    return level


def crossing_on_grid(
    weights: Sequence[float], means: Sequence[float], variances: Sequence[float]
) -> float:
    """Last change of sign between two weighted normal densities on a 1024-point grid, else the midpoint."""
    import numpy as np

    order = np.argsort(means)
    w, m = np.asarray(weights)[order], np.asarray(means)[order]
    s = np.maximum(np.sqrt(np.asarray(variances)[order]), 1e-3)
    grid = np.linspace(m[0], m[1], GRID)
    density = w[:, None] / s[:, None] * np.exp(-0.5 * ((grid[None, :] - m[:, None]) / s[:, None]) ** 2)
    turns = np.flatnonzero(np.diff(np.sign(density[1] - density[0])))
    return float(grid[turns[-1]]) if turns.size else float(m.mean())


@dataclass
class Mixture:
    """Two normal components of one channel, and whether they have settled."""

    weights: tuple[float, float]
    means: tuple[float, float]
    variances: tuple[float, float]
    fit: float = float("-inf")
    settled: bool = False


def _per_slot(values: Sequence[float], slot: Column) -> Column:
    """The entry of a configuration list at ``slot``; a list is data to the generated code, which is made once."""
    return F.get(F.array(*[F.lit(float(v)) for v in values]), slot)


def _by_slot(rows: DataFrame, active: Sequence[bool], sums: Mapping[str, Column]) -> dict[int, Row]:
    """One aggregation over all values of the active channels: a row of sums for each."""
    picked = rows.filter(F.get(F.array(*[F.lit(bool(a)) for a in active]), F.col("slot")))
    return {r["slot"]: r for r in picked.groupBy("slot").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).toLocalIterator()}


def _split_centres(rows: DataFrame, means: list[float], spreads: list[float]) -> list[tuple[float, float]]:
    """Two centres of each channel by Lloyd's rounds, from one deviation to either side of the mean."""
    centres = [(m - sd, m + sd) for m, sd in zip(means, spreads)]
    active = [sd > 0 for sd in spreads]
    for _ in range(SPLIT_ROUNDS):
        if not any(active):
            break
        low, high = (_per_slot([c[k] for c in centres], F.col("slot")) for k in (0, 1))
        upper = F.col("v") - low > high - F.col("v")
        sums = {"n": upper.cast("double"), "s": F.when(upper, F.col("v")), "rest": F.when(~upper, F.lit(1.0)), "t": F.when(~upper, F.col("v"))}
        for i, r in _by_slot(rows, active, sums).items():
            was = centres[i]
            centres[i] = (r["t"] / r["rest"] if r["rest"] else was[0], r["s"] / r["n"] if r["n"] else was[1])
            active[i] = sum((x - y) ** 2 for x, y in zip(was, centres[i])) > SPLIT_TOLERANCE * spreads[i] ** 2
    return centres


def _round(rows: DataFrame, mixtures: Sequence[Mixture], shares: Sequence[Column], active: Sequence[bool], fit: Column) -> dict[int, tuple[Mixture, float]]:
    """The mixtures that follow from the values' shares in either component, and the mean of ``fit``.

    Deviations are from the present means, so that squares of large values don't cancel.
    """
    sums = {"n": F.lit(1.0), "fit": fit}
    for k in (0, 1):
        d = F.col("v") - _per_slot([m.means[k] for m in mixtures], F.col("slot"))
        sums |= {f"w{k}": shares[k], f"d{k}": shares[k] * d, f"q{k}": shares[k] * d * d}
    out = {}
    for i, r in _by_slot(rows, active, sums).items():
        mass = [max(r[f"w{k}"], MIN_MASS) for k in (0, 1)]
        step = [r[f"d{k}"] / mass[k] for k in (0, 1)]
        spread = [max(r[f"q{k}"] / mass[k] - step[k] ** 2, 0.0) + ADDED_VARIANCE for k in (0, 1)]
        means = [mixtures[i].means[k] + step[k] for k in (0, 1)]
        out[i] = (Mixture((mass[0] / sum(mass), mass[1] / sum(mass)), tuple(means), tuple(spread)), r["fit"] / r["n"])
    return out


def fit_mixtures(long: DataFrame, channels: Sequence[int], rounds: int = MIXTURE_ROUNDS) -> dict[int, Mixture]:
    """Two normal components per channel, over all values of ``long`` (channel, v).

    Expectation maximisation, started from a split into two clusters. A round is one map-side-combined aggregation of
    counts, sums and sums of squares over all values of all channels; the driver holds a few numbers a channel. A
    channel stops when the mean log-likelihood moves by less than MIXTURE_TOLERANCE, or after ``rounds``. Channels
    without values are left out.
    """
    slots = literal_map({c: i for i, c in enumerate(channels)})
    rows = cut(long.select(slots[F.col("channel")].alias("slot"), F.col("v").cast("double").alias("v")).filter("slot is not null and v is not null"))
    n = len(channels)
    about = {r["slot"]: r for r in rows.groupBy("slot").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd")).toLocalIterator()}
    means = [about[i]["m"] if i in about else 0.0 for i in range(n)]
    spreads = [about[i]["sd"] if i in about else 0.0 for i in range(n)]
    centres = _split_centres(rows, means, spreads)
    mixtures = [Mixture((0.5, 0.5), c, (1.0, 1.0)) for c in centres]
    low, high = (_per_slot([c[k] for c in centres], F.col("slot")) for k in (0, 1))
    upper = (F.col("v") - low > high - F.col("v")).cast("double")
    for i, (made, _) in _round(rows, mixtures, [F.lit(1.0) - upper, upper], [True] * n, F.lit(0.0)).items():
        mixtures[i] = made
    for _ in range(rounds):
        active = [i in about and not m.settled for i, m in enumerate(mixtures)]
        if not any(active):
            break
        logs = []
        for k in (0, 1):
            d = F.col("v") - _per_slot([m.means[k] for m in mixtures], F.col("slot"))
            base = _per_slot([math.log(m.weights[k]) - 0.5 * math.log(2 * math.pi * m.variances[k]) for m in mixtures], F.col("slot"))
            logs.append(base - d * d / _per_slot([2 * m.variances[k] for m in mixtures], F.col("slot")))
        top = F.greatest(*logs)
        whole = top + F.log(F.exp(logs[0] - top) + F.exp(logs[1] - top))
        for i, (made, fit) in _round(rows, mixtures, [F.exp(x - whole) for x in logs], active, whole).items():
            made.fit, made.settled = fit, abs(fit - mixtures[i].fit) < MIXTURE_TOLERANCE
            mixtures[i] = made
    return {c: mixtures[i] for i, c in enumerate(channels) if i in about}


def gmm_intersection(df: DataFrame, panel: MarkerPanel = DEFAULT_PANEL, rounds: int = MIXTURE_ROUNDS) -> dict[int, float]:
    """Cut per channel where a two-component mixture of all its values changes component.

    Fewer than 50 values take the 0.9 quantile.
    """
    long = melt_values(df, panel)
    counts = {r["channel"]: r["n"] for r in long.groupBy("channel").agg(F.count("v").alias("n")).toLocalIterator()}
    enough = [c for c in panel.channels if counts.get(c, 0) >= MIN_FIT_VALUES]
    cuts = {}
    if enough:
        cuts = {c: crossing_on_grid(m.weights, m.means, m.variances) for c, m in fit_mixtures(long, enough, rounds).items()}
    sparse = [c for c in panel.channels if 0 < counts.get(c, 0) < MIN_FIT_VALUES]
    if sparse:
        few = long.filter(F.col("channel").isin(sparse))
        for row in group_quantiles(few, ["channel"], "v", {"q": FALLBACK_QUANTILE}).toLocalIterator():
            cuts[row["channel"]] = float(row["q"])
    return cuts


def fit_thresholds(
    train: DataFrame, panel: MarkerPanel = DEFAULT_PANEL,
    existing: Mapping[int, tuple[float, float]] | None = None,
) -> DataFrame:
    """The three cuts, target rate and training positive rates per channel.

    ``existing`` maps a channel to a stored ``(mixture cut, target rate)`` that is reused.
    """
    existing = dict(existing or {})
    names = {c: n for n, c in panel.pairs}
    todo = panel.subset([names[c] for c in panel.channels if c not in existing])
    gmm = {c: t for c, (t, _) in existing.items()}
    if todo.pairs:
        gmm.update(gmm_intersection(train, todo))
    long = melt_values(train, panel)
    cut = _lookup(gmm)
    rate = long.groupBy("channel").agg(F.avg((F.col("v") > cut).cast("double")).alias("rate"))
    stored = _lookup({c: r for c, (_, r) in existing.items()})
    rates = rate.select("channel", F.coalesce(stored, F.col("rate")).alias("target_pos"))
    # one target rate per configured channel
    targets = {r["channel"]: r["target_pos"] for r in rates.toLocalIterator()}
    quantile = quantile_match(train, targets, panel).drop("n")
    table = (
        otsu_train(train, panel).drop("n").join(quantile, "channel")
        .withColumns({"tau_gmm": cut, "target_pos": _lookup(targets)})
    )
    return table.join(positive_rates(long, table), "channel")


def _lookup(table: Mapping[int, float]) -> Column:
    out = F.lit(None).cast("double")
    for c, value in table.items():
        out = F.when(F.col("channel") == c, F.lit(float(value))).otherwise(out)
    return out


def positive_rates(long: DataFrame, cuts: DataFrame, prefix: str = "train_pos") -> DataFrame:
    """Share of values above each cut per channel. ``cuts`` has one row per configured channel."""
    joined = long.join(F.broadcast(cuts.select("channel", *[f"tau_{m}" for m in METHODS])), "channel")
    return joined.groupBy("channel").agg(
        *[F.avg((F.col("v") > F.col(f"tau_{m}")).cast("double")).alias(f"{prefix}_{m}") for m in METHODS]
    )


def threshold_diagnostics(
    train: DataFrame, val: DataFrame, taus: Mapping[int, Mapping[str, float]],
    panel: MarkerPanel = DEFAULT_PANEL,
) -> DataFrame:
    """Cell count and positive rate of each method per channel for both splits."""
    def rates(df: DataFrame, prefix: str) -> DataFrame:
        aggs = [F.count("v").alias(f"{prefix}_cells")]
        for m in METHODS:
            cut = _lookup({c: t[m] for c, t in taus.items()})
            aggs.append(F.avg((F.col("v") > cut).cast("double")).alias(f"{prefix}_pos_{m}"))
        return melt_values(df, panel).groupBy("channel", "name").agg(*aggs)

    return rates(train, "train").join(rates(val, "val"), ["channel", "name"])


def _votes(df: DataFrame, c: int, taus: Mapping[str, float]) -> dict[str, Column]:
    v = nan_to_null(F.col(ch(c, "true")))
    return {m: F.coalesce(v > F.lit(float(taus[m])), F.lit(False)) for m in METHODS}


def consensus_labels(
    df: DataFrame, taus: Mapping[int, Mapping[str, float]], n: int = 2,
    panel: MarkerPanel = DEFAULT_PANEL,
) -> DataFrame:
    """Three strict votes per marker, their consensus and disagreement.

    The label that was there is kept as ``_pos_gmm_orig`` and replaced by the consensus.
    """
    need = min(max(int(n), 1), len(METHODS))
    out: dict[str, Column] = {}
    for c in panel.channels:
        if c not in taus or ch(c, "true") not in df.columns:
            continue
        votes = _votes(df, c, taus[c])
        total = sum((v.cast("int") for v in votes.values()), F.lit(0))
        if ch(c, "pos") in df.columns:
            out[ch(c, "pos_gmm_orig")] = F.col(ch(c, "pos"))
        for m, v in votes.items():
            out[ch(c, f"pos_{m}")] = v
        out[ch(c, "pos_consensus")] = total >= need
        out[ch(c, "pos_disagree")] = (total != 0) & (total != len(METHODS))
        out[ch(c, "pos")] = total >= need
    return df.withColumns(out)


def ensure_labels(
    df: DataFrame, cuts: Mapping[int, float], panel: MarkerPanel = DEFAULT_PANEL
) -> DataFrame:
    """Boolean ``chXX_pos`` for every channel: the stored label, or intensity above the cut."""
    out = {}
    for c in panel.channels:
        label = ch(c, "pos")
        if label in df.columns:
            out[label] = F.coalesce(truthy(F.col(label)), F.lit(False))
        else:
            out[label] = F.coalesce(nan_to_null(F.col(ch(c, "true"))) > F.lit(float(cuts[c])), F.lit(False))
    return df.withColumns(out)


def disagreement_strata(
    df: DataFrame, marker: str, taus: Mapping[str, float], panel: MarkerPanel = DEFAULT_PANEL,
    out: str = "stratum",
) -> DataFrame:
    """Which of the three methods call the marker positive, as one of six strata."""
    v = _votes(df, panel.channel(marker), taus)
    total = sum((x.cast("int") for x in v.values()), F.lit(0))
    return df.withColumn(
        out,
        F.when(total == 3, "all_three_pos").when(total == 0, "all_three_neg")
        .when(total == 2, "split_decision_2of3_pos")
        .when(v["gmm"], "gmm_only_pos").when(v["otsu"], "otsu_only_pos")
        .otherwise("quantile_only_pos"),
    )


AGREEMENT_PAIRS = (
    ("gmm", "otsu"), ("gmm", "quantile"), ("otsu", "quantile"), ("gmm_existing", "gmm"),
)


def threshold_agreement(
    val: DataFrame, taus: Mapping[int, Mapping[str, float]], panel: MarkerPanel = DEFAULT_PANEL
) -> DataFrame:
    """Jaccard, Cohen's kappa, disagreement and the F1 ceiling it implies, per channel and method pair."""
    rows = []
    for n, c in panel.pairs:
        if c not in taus:
            continue
        v = nan_to_null(F.col(ch(c, "true")))
        for i, (a, b) in enumerate(AGREEMENT_PAIRS):
            if a not in taus[c] or b not in taus[c]:
                continue
            rows.append({
                "channel": F.lit(c), "name": F.lit(n), "pair": F.lit(i),
                "method_a": F.lit(a), "method_b": F.lit(b),
                "a": F.coalesce(v > F.lit(float(taus[c][a])), F.lit(False)),
                "b": F.coalesce(v > F.lit(float(taus[c][b])), F.lit(False)),
            })
    key = ["channel", "name", "pair", "method_a", "method_b"]
    counts = stack_columns(val, [], rows).groupBy(*key).agg(
        F.count("*").cast("double").alias("n"),
        F.count_if(F.col("a") & F.col("b")).cast("double").alias("both"),
        F.count_if("a").cast("double").alias("na"), F.count_if("b").cast("double").alias("nb"),
    )
    n, both, na, nb = (F.col(x) for x in ("n", "both", "na", "nb"))
    differ = na + nb - both - both
    observed = F.lit(1.0) - differ / n
    chance = (na * nb + (n - na) * (n - nb)) / (n * n)
    p = F.greatest(F.least((na + nb) / (F.lit(2.0) * n), F.lit(0.999)), F.lit(0.001))
    e = F.greatest(F.least(differ / n / F.lit(2.0), F.lit(0.499)), F.lit(0.0))
    precision = p * (F.lit(1.0) - e) / (p * (F.lit(1.0) - e) + (F.lit(1.0) - p) * e)
    recall = F.lit(1.0) - e
    return counts.select(
        *key,
        ratio(both, na + nb - both).alias("jaccard"),
        ratio(observed - chance, F.lit(1.0) - chance).alias("cohen_kappa"),
        (differ / n).alias("disagree_rate"),
        (F.lit(2.0) * precision * recall / F.greatest(precision + recall, F.lit(1e-9))).alias("f1_ceiling"),
    )


def kappa_pivot(agreement: DataFrame) -> DataFrame:
    """One row per marker with a kappa column per method pair."""
    labels = [f"{a}_vs_{b}" for a, b in AGREEMENT_PAIRS]
    return (
        agreement.withColumn("__pair", F.concat_ws("_vs_", "method_a", "method_b"))
        .groupBy("name").pivot("__pair", labels).agg(F.first("cohen_kappa"))
    )
