"""Learned calibration of marker predictions: logistic models of all markers in shared passes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.expr import ratio, require, stack_columns, stratum_of_ap, truthy
from cellframe.operators.metrics import checked, cut_metrics, operating_threshold, score_report
from cellframe.operators.normalize import core_mean_preds
from cellframe.operators.rules import phenotype_labels, phenotype_scores
from cellframe.operators.sampling import sample_rows, shuffle_within_core
from cellframe.operators.spatial.knn import feature_columns, knn_edges, knn_features
from cellframe.panel import DEFAULT_PANEL, MarkerPanel, ch
from cellframe.session import cut, stored

MAX_FIT_CELLS = 300_000
#: A model is done when no coefficient moves by more.
STEP_TOLERANCE = 1e-8


def _scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature, one pass; a constant feature keeps scale 1."""
    # stacked: two aggregates, whose code stays short for any number of features
    stacked = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("at", "v"))
    rows = stacked.groupBy("at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not rows:
        raise ValueError("no cells to fit on")
    return {columns[r["at"]]: (float(r["m"]), float(r["s"]) or 1.0) for r in rows}


@dataclass
class Response:
    """One marker's model in the making: its accepted coefficients (the constant first) and the next ones to try."""

    label: str
    weights: tuple[float, float]
    best: np.ndarray
    trial: np.ndarray
    loss: float = float("inf")
    step: np.ndarray | None = None
    done: bool = False


def _batch_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """Loss, gradient and Hessian of one marker over a batch, in one row; unknown labels (NaN) weigh nothing."""
    w = np.where(y > 0, weights[1], weights[0]) * ~np.isnan(y)
    y = np.nan_to_num(y)
    t = x @ beta
    p = 0.5 * (1.0 + np.tanh(0.5 * t))
    loss = w @ (np.logaddexp(0.0, t) - y * t)
    curved = x * (w * p * (1.0 - p))[:, None]
    return np.concatenate([[loss], x.T @ (w * (p - y)), (x.T @ curved).ravel()])


def _pass(design: DataFrame, columns: Sequence[str], scaler: Mapping[str, tuple[float, float]], open_: Sequence[Response]) -> list[np.ndarray]:
    """One pass over all rows for all open models: each partition sends one row a marker, which Spark adds up."""
    mean = np.array([scaler[c][0] for c in columns])
    scale = np.array([scaler[c][1] for c in columns])
    width = 1 + (len(columns) + 1) * (len(columns) + 2)
    jobs = [(design.columns.index(m.label), m.trial, m.weights) for m in open_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(jobs), width))
        for batch in batches:
            raw = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]).astype(float)
            if np.isnan(raw).any():
                raise ValueError("a feature is missing")
            x = np.column_stack([np.ones(len(raw)), (raw - mean) / scale])
            for i, (at, beta, weights) in enumerate(jobs):
                total[i] += _batch_sums(x, batch.column(at).to_numpy(zero_copy_only=False).astype(float), beta, weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(jobs), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["marker", "sums"])

    parts = design.mapInArrow(run, "marker int, sums array<double>").select("marker", F.posexplode("sums"))
    out = [np.zeros(width) for _ in jobs]
    # markers x (features + 1)^2 numbers
    for r in parts.groupBy("marker", "pos").agg(F.sum("col").alias("v")).toLocalIterator():
        out[r["marker"]][r["pos"]] = r["v"]
    return out


def fit_logistic(design: DataFrame, columns: Sequence[str], scaler: Mapping[str, tuple[float, float]], responses: Sequence[Response], max_passes: int) -> int:
    """Ridge-penalised logistic models of all responses at once by Newton's method; gives the number of passes.

    Every pass over the rows serves all markers whose model is still open. The penalty is half the squared length of
    the coefficients, the constant left out. A step that raises the loss is halved.
    """
    size = len(columns) + 1
    ridge = np.diag([0.0] + [1.0] * len(columns))
    for passes in range(1, max_passes + 1):
        open_ = [m for m in responses if not m.done]
        if not open_:
            return passes - 1
        for m, sums in zip(open_, _pass(design, columns, scaler, open_)):
            loss = sums[0] + 0.5 * m.trial @ ridge @ m.trial
            if m.step is not None and loss > m.loss + 1e-9 * abs(m.loss):
                m.step = m.step / 2
                m.trial = m.best + m.step
                m.done = np.abs(m.step).max() < STEP_TOLERANCE
                continue
            m.best, m.loss = m.trial, loss
            gradient = sums[1 : 1 + size] + ridge @ m.best
            m.step = -np.linalg.lstsq(sums[1 + size :].reshape(size, size) + ridge, gradient, rcond=None)[0]
            m.trial = m.best + m.step
            m.done = np.abs(m.step).max() < STEP_TOLERANCE
    return max_passes


def _probability(beta: Sequence[float], columns: Sequence[str], scaler: Mapping[str, tuple[float, float]]) -> Column:
    """The model's probability as one expression."""
    t = F.lit(float(beta[0]))
    for c, b in zip(columns, beta[1:]):
        m, s = scaler[c]
        t = t + (F.col(c).cast("double") - F.lit(m)) / F.lit(s) * F.lit(float(b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-t))


def calibrate_markers(
    train: DataFrame, evaluation: DataFrame, panel: MarkerPanel = DEFAULT_PANEL,
    model: str | None = None, extra: Sequence[str] = (), max_fit_cells: int = MAX_FIT_CELLS,
    seed: int = 0, max_iter: int = 200,
) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``chXX_prob_logreg`` from one balanced logistic model per marker.

    The scaler and the models are fitted on at most ``max_fit_cells`` training cells, all markers in the same passes;
    the probabilities cover all cells of both tables. The penalty is a unit-strength ridge on the summed loss.
    """
    columns = [ch(c, "pred", model) for c in panel.channels] + list(extra)
    require(train, columns)
    require(evaluation, columns)
    labels = [ch(c, "pos") for c in panel.channels]
    known = [truthy(F.col(c)).cast("double").alias(c) for c in labels]
    sample = sample_rows(train, max_fit_cells, seed)
    design = cut(sample.select(*[F.col(c).cast("double").alias(c) for c in columns], *known))
    scaler = _scaler(design, columns)
    stats = design.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(labels)], *[F.sum(c).alias(f"p{i}") for i, c in enumerate(labels)]).first()
    out, responses = {}, {}
    for i, (c, label) in enumerate(zip(panel.channels, labels)):
        n, pos = stats[f"n{i}"], stats[f"p{i}"] or 0.0  # of the cells whose label is known
        if pos in (0, n):
            out[c] = F.lit(float(pos > 0))
            continue
        start = np.zeros(len(columns) + 1)
        responses[c] = Response(label, (n / (2.0 * (n - pos)), n / (2.0 * pos)), start, start)
    fit_logistic(design, columns, scaler, list(responses.values()), max_iter)
    out |= {c: _probability(m.best, columns, scaler) for c, m in responses.items()}
    added = {ch(c, "prob_logreg"): out[c] for c in panel.channels}
    return train.withColumns(added), evaluation.withColumns(added)


def calibration_rows(
    fit: DataFrame, evaluation: DataFrame, panel: MarkerPanel = DEFAULT_PANEL, model: str | None = None
) -> DataFrame:
    """Metrics of the raw and the calibrated score per marker on the evaluation cells.

    ``fit`` are the training cells the raw operating cut is taken from.
    """
    return _marker_rows(evaluation, ranked_together({
        "raw_train": (fit, _marker_items(panel, "pred", model)),
        "raw_eval": (evaluation, _marker_items(panel, "pred", model)),
        "prob_eval": (evaluation, _marker_items(panel, "prob_logreg")),
    }), panel, model)


Scores = Sequence[tuple[str, str]]


def _marker_items(panel: MarkerPanel, family: str, model: str | None = None) -> Scores:
    return [(ch(c, "pos"), ch(c, family, model)) for _, c in panel.pairs]


def _phenotype_items(panel: MarkerPanel) -> Scores:
    return [(f"phenotype_{n}_label", f"phenotype_{n}_score_logreg") for n in panel.phenotypes]


def ranked_together(parts: Mapping[str, tuple[DataFrame, Scores]]) -> dict[str, DataFrame]:
    """:func:`score_report` of every part's label and score columns, by ``position``; all parts are ranked in one pass.

    Parts over the same table are stacked from one scan of it.
    """
    first, rows, tables = {}, {}, {}
    total = 0
    for part, (df, items) in parts.items():
        first[part] = total
        tables[id(df)] = df
        rows.setdefault(id(df), []).extend(
            {"item": F.lit(total + i), "y": F.col(y).cast("double"), "score": F.col(score).cast("double")} for i, (y, score) in enumerate(items))
        total += len(items)
    stacks = [stack_columns(tables[at], [], entries) for at, entries in rows.items()]
    report = score_report(checked(reduce(DataFrame.unionByName, stacks)), ["item"])
    return {
        part: report.filter(F.col("item").between(first[part], first[part] + len(items) - 1))
        .withColumn("position", F.col("item") - F.lit(first[part])).drop("item")
        for part, (_, items) in parts.items()
    }


def _named(report: DataFrame, panel: MarkerPanel, phenotypes: bool = False) -> DataFrame:
    """Replace ``position`` by the phenotype's ``name``, or by the marker's ``channel`` and ``name``."""
    at = F.col("position")
    if phenotypes:
        key = {"name": F.get(F.array(*[F.lit(n) for n in panel.phenotypes]), at)}
    else:
        key = {
            "channel": F.get(F.array(*[F.lit(c) for _, c in panel.pairs]), at),
            "name": F.get(F.array(*[F.lit(n) for n, _ in panel.pairs]), at),
        }
    return report.select(*[c.alias(n) for n, c in key.items()], *[c for c in report.columns if c != "position"])


def _marker_rows(evaluation: DataFrame, reports: Mapping[str, DataFrame], panel: MarkerPanel, model: str | None) -> DataFrame:
    """The rows of :func:`calibration_rows` from the rankings of the raw and the calibrated scores."""
    def long(df: DataFrame, score: str) -> DataFrame:
        rows = [
            {
                "channel": F.lit(c), "name": F.lit(n), "y": truthy(F.col(ch(c, "pos"))),
                "score": F.col(ch(c, score, model if score == "pred" else None)).cast("double"),
            }
            for n, c in panel.pairs
        ]
        return stack_columns(df, [], rows)

    key = ["channel", "name"]
    raw, prob = long(evaluation, "pred"), long(evaluation, "prob_logreg")
    cuts = operating_threshold(_named(reports["raw_train"], panel), key).select(
        *key, F.col("threshold").alias("train_best_raw_threshold")
    )
    at_cut = cut_metrics(
        raw.join(F.broadcast(cuts), key), key, "y", F.col("score") > F.col("train_best_raw_threshold")
    ).select(
        *key, F.col("balanced_accuracy").alias("balanced_acc_train_best_raw_threshold"),
        F.col("f1").alias("f1_train_best_raw_threshold"),
    )
    at_half = cut_metrics(prob, key, "y", F.col("score") > 0.5).select(
        *key, F.col("balanced_accuracy").alias("balanced_acc_logreg_0p5"),
        F.col("f1").alias("f1_logreg_0p5"),
    )
    ranked = _named(reports["raw_eval"], panel).select(
        *key, F.col("auc").alias("auc_raw"), F.col("ap").alias("ap_raw")
    )
    report = _named(reports["prob_eval"], panel).select(
        *key, "n_eval_cells", "positive_fraction", F.col("auc").alias("auc_logreg"),
        F.col("ap").alias("ap_logreg"), F.col("best_possible_f1").alias("best_possible_f1_logreg"),
        F.col("best_threshold").alias("best_logreg_threshold_eval_only"),
    )
    out = report
    for part in (ranked, cuts, at_cut, at_half):
        out = out.join(part, key)
    return out


def threshold_artifact(
    marker_rows: DataFrame, phenotype_rows: DataFrame, provenance: Mapping[str, object]
) -> DataFrame:
    """The one-row threshold artifact: four maps, provenance and schema version.

    Both inputs have ``name, threshold, ap``, one row per configured name; marker cuts are
    keyed by ``channel``, as the loader of the artifact expects.
    """
    def maps(df: DataFrame, prefix: str) -> DataFrame:
        ap = F.coalesce("ap", F.raise_error(F.lit("cannot assign confidence from a non-finite AP")).cast("double"))
        key = F.col("channel").cast("string") if "channel" in df.columns else F.col("name")
        cuts = F.collect_list(F.struct(key.alias("k"), F.col("threshold")))
        strata = F.collect_list(F.struct("name", stratum_of_ap(ap).alias("c")))
        return df.agg(F.struct(
            F.map_from_entries(F.sort_array(cuts)).alias(f"{prefix}_thresholds"),
            F.map_from_entries(F.sort_array(strata)).alias(f"{prefix}_confidence"),
        ).alias(prefix))

    note = F.to_json(F.create_map(*[F.lit(str(x)) for kv in provenance.items() for x in kv]))
    both = maps(marker_rows, "marker").withColumn("phenotype", maps(phenotype_rows, "phenotype").scalar())
    return both.select("marker.*", "phenotype.*", F.lit(1).alias("schema_version"), note.alias("provenance"))


def calibration_run(
    train: DataFrame, evaluation: DataFrame, panel: MarkerPanel = DEFAULT_PANEL, model: str | None = None,
    core_mean: bool = False, shuffle_seed: int | None = None, ks: Sequence[int] = (),
    features: Sequence[str] = ("mean",), taus: Mapping[int, float] | None = None,
    seed: int = 0, max_fit_cells: int = MAX_FIT_CELLS, graphs: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Optional core means, shuffling and neighbourhood features, then calibration and its metrics.

    ``graphs`` are the neighbours of ``train`` and ``eval`` if they are known (:func:`neighbour_graphs`).
    Returns ``train``, ``eval`` (with probabilities, scores and labels), ``marker_metrics``,
    ``phenotype_metrics`` and ``artifact``.
    """
    extra: list[str] = []
    tables = {"train": train, "eval": evaluation}
    for name, df in tables.items():
        if shuffle_seed is not None:
            df = shuffle_within_core(
                df, [ch(c, "pred", model) for c in panel.channels] + [ch(c, "pos") for c in panel.channels],
                shuffle_seed,
            )
        if core_mean:
            df = core_mean_preds(df, model, panel)
        if ks:
            df = stored(knn_features(
                df, ks, features, dict(taus or {c: 0.5 for c in panel.channels}), panel.channels,
                "ch{:02d}_pred" + (f"_{model}" if model else ""), graphs[name] if graphs else None,
            ))
        tables[name] = df
    if core_mean:
        extra += [f"core_mean_ch{c:02d}_pred" for c in panel.channels]
    extra += feature_columns(ks, features, panel.channels)
    fitted, out = calibrate_markers(
        tables["train"], tables["eval"], panel, model, extra, max_fit_cells, seed
    )
    tables = {
        name: stored(phenotype_labels(phenotype_scores(df, "logreg", panel, family="prob_logreg"), panel))
        for name, df in (("train", fitted), ("eval", out))
    }

    markers, phenotypes = _marker_items(panel, "prob_logreg"), _phenotype_items(panel)
    raw = _marker_items(panel, "pred", model)
    reports = ranked_together({
        f"{kind}_{name}": (df, items)
        for name, df in tables.items() for kind, items in (("raw", raw), ("prob", markers), ("phenotype", phenotypes))
    })
    phenotype_report = _named(reports["phenotype_eval"], panel, phenotypes=True)
    marker_report = _marker_rows(tables["eval"], reports, panel, model)
    marker_cuts = operating_threshold(_named(reports["prob_train"], panel), ["channel", "name"])
    phenotype_cuts = operating_threshold(_named(reports["phenotype_train"], panel, phenotypes=True), ["name"])
    artifact = threshold_artifact(
        marker_cuts.join(marker_report.select("name", F.col("ap_logreg").alias("ap")), "name"),
        phenotype_cuts.join(phenotype_report.select("name", "ap"), "name"),
        {"model": model or "", "seed": seed},
    )
    return {
        **tables, "marker_metrics": marker_report, "phenotype_metrics": phenotype_report,
        "artifact": artifact,
    }


def neighbour_graphs(train: DataFrame, evaluation: DataFrame, ks: Sequence[int]) -> dict[str, DataFrame]:
    """The neighbours of both tables at the largest k, written once, as lists, for all arms whose cells are in the same places."""
    return {name: knn_edges(df, max(ks), expand=False) for name, df in (("train", train), ("eval", evaluation))} if ks else {}


def calibration_with_control(
    train: DataFrame, evaluation: DataFrame, shuffle_seed: int, panel: MarkerPanel = DEFAULT_PANEL, model: str | None = None,
    ks: Sequence[int] = (), **settings,
) -> dict[str, dict[str, DataFrame]]:
    """The run as it is (``real``) beside its control (``shuffled``), whose labels and scores are moved within their cores.

    A cell of the control keeps its place but has another cell's values, so what neighbours add there is what they add by
    chance. Both arms share all other settings, and the neighbours, which are searched once.
    """
    settings |= {"ks": ks, "graphs": neighbour_graphs(train, evaluation, ks)}
    return {
        "real": calibration_run(train, evaluation, panel, model, **settings),
        "shuffled": calibration_run(train, evaluation, panel, model, shuffle_seed=shuffle_seed, **settings),
    }


def prevalence(df: DataFrame, panel: MarkerPanel = DEFAULT_PANEL) -> DataFrame:
    """Share of positive cells per marker."""
    agg = df.agg(*[
        ratio(F.count_if(truthy(F.col(ch(c, "pos")))), F.count("*")).alias(f"__p_{c}") for c in panel.channels
    ])
    return stack_columns(agg, [], [
        {"channel": F.lit(c), "name": F.lit(n), "prevalence": F.col(f"__p_{c}")} for n, c in panel.pairs
    ])
