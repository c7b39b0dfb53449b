"""Thresholds, consensus, clustering, audit and calibration."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellframe.operators import audit, calibrate, cluster, labels, normalize, sampling
from cellframe.panel import DEFAULT_PANEL as P
from cellframe.panel import MarkerPanel, ch
from cellframe.plans.bundle import build_labels

TWO = MarkerPanel((("DAPI", 0), ("CD68", 27)), P.rules, P.hierarchy)


def test_otsu(spark):
    rng = np.random.default_rng(0)
    values = np.r_[rng.normal(0.5, 0.1, 500), rng.normal(3, 0.1, 500)]
    rows = [("two", float(v)) for v in values] + [("zeros", 0.0)] * 5 + [("flat", 3.0)] * 4
    df = spark.createDataFrame(rows, "basename string, v double")
    cuts = {r.basename: r.otsu for r in labels.otsu_cuts(df, ["basename"], "v").collect()}
    assert 0.7 < cuts["two"] < 2.7 and cuts["zeros"] == float("inf") and cuts["flat"] == float("inf")
    positive = {r.basename: r.n for r in labels.otsu(df, "v").groupBy("basename").agg(F.count_if("otsu_pos").alias("n")).collect()}
    # the cut is a bin centre, so a value of the lower class can lie just above it
    assert 498 <= positive["two"] <= 502 and positive["zeros"] == positive["flat"] == 0
    assert labels.otsu_cuts(df.filter("false"), ["basename"], "v").count() == 0


def test_otsu_train_falls_back_on_few_or_flat_values(spark):
    df = spark.createDataFrame([(float(i), 2.0) for i in range(20)], "ch00_true double, ch27_true double")
    got = {r.channel: r.tau_otsu for r in labels.otsu_train(df, TWO).collect()}
    assert got[0] == pytest.approx(np.quantile(np.arange(20), 0.9)) and got[27] == 2.0


def test_mixture_crossing(spark):
    rng = np.random.default_rng(1)
    v = np.r_[rng.normal(1.0, 0.2, 400), rng.normal(4.0, 0.3, 400)]
    df = spark.createDataFrame([(float(x), float(i)) for i, x in enumerate(v)], "ch00_true double, ch27_true double")
    cut = labels.gmm_intersection(df, TWO.subset(["DAPI"]))[0]
    assert 1.6 < cut < 3.2
    few = labels.gmm_intersection(df.limit(20), TWO.subset(["CD68"]))
    assert few[27] == pytest.approx(np.quantile(np.arange(20), 0.9))


def plain_mixture(v):
    """The split and EM of the module's rules on an array."""
    centres = np.array([v.mean() - v.std(), v.mean() + v.std()])
    while True:
        upper = v - centres[0] > centres[1] - v
        new = np.array([v[~upper].mean() if (~upper).any() else centres[0], v[upper].mean() if upper.any() else centres[1]])
        moved, centres = ((new - centres) ** 2).sum(), new
        if moved <= labels.SPLIT_TOLERANCE * v.var():
            break
    share, fit = np.stack([~(v - centres[0] > centres[1] - v), v - centres[0] > centres[1] - v]).astype(float), -np.inf
    for i in range(labels.MIXTURE_ROUNDS + 1):
        if i:
            logs = np.log(w)[:, None] - 0.5 * np.log(2 * np.pi * s)[:, None] - (v - m[:, None]) ** 2 / (2 * s[:, None])
            whole = np.logaddexp(*logs)
            share, before, fit = np.exp(logs - whole), fit, whole.mean()
        mass = share.sum(axis=1)
        w, m = mass / mass.sum(), share @ v / mass
        s = (share * (v - m[:, None]) ** 2).sum(axis=1) / mass + labels.ADDED_VARIANCE
        if i and abs(fit - before) < labels.MIXTURE_TOLERANCE:
            break
    return w, m, s


def test_mixtures_of_all_values_equal_a_plain_fit(spark):
    rng = np.random.default_rng(7)
    two = np.r_[rng.normal(0.5, 0.2, 3000), rng.normal(3.0, 1.0, 1000)]
    skewed = rng.lognormal(1.0, 1.0, 4000)
    saturated = np.r_[rng.normal(2.0, 0.4, 3999), 65535.0]
    rows = [(c, float(x)) for c, v in enumerate((two, skewed, saturated)) for x in v] + [(0, None), (1, None)]
    got = labels.fit_mixtures(spark.createDataFrame(rows, "channel int, v double").repartition(7), [0, 1, 2, 3])
    assert sorted(got) == [0, 1, 2]
    for c, v in enumerate((two, skewed, saturated)):
        w, m, s = plain_mixture(v)
        assert np.allclose(got[c].weights, w, rtol=1e-8) and np.allclose(got[c].means, m, rtol=1e-8) and np.allclose(got[c].variances, s, rtol=1e-6)
    assert labels.crossing_on_grid(got[0].weights, got[0].means, got[0].variances) == pytest.approx(1.1, abs=0.3)


def test_mixture_of_a_constant_channel(spark):
    df = spark.createDataFrame([(2.0, float(i % 2)) for i in range(80)], "ch00_true double, ch27_true double")
    cuts = labels.gmm_intersection(df, TWO)
    assert cuts[0] == 2.0 and 0.0 < cuts[27] < 1.0


def test_consensus_votes(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, 2.5, False), (3, 3.5, False), (4, 9.0, False), (5, 3.0, True)], "id int, ch27_true double, ch27_pos boolean")
    taus = {27: {"gmm": 3.0, "otsu": 2.0, "quantile": 5.0}}
    rows = {r.id: r for r in labels.consensus_labels(df, taus, 2).collect()}
    assert [rows[i].ch27_pos_consensus for i in (1, 2, 3, 4, 5)] == [False, False, True, True, False]
    assert [rows[i].ch27_pos_disagree for i in (1, 2, 3, 4)] == [False, True, True, False]
    assert rows[1].ch27_pos_gmm_orig is True and rows[1].ch27_pos is False
    assert labels.consensus_labels(df, taus, 9).filter("ch27_pos").count() == 1
    strata = {r.id: r.stratum for r in labels.disagreement_strata(df, "CD68", taus[27]).collect()}
    assert strata == {1: "all_three_neg", 2: "otsu_only_pos", 3: "split_decision_2of3_pos", 4: "all_three_pos", 5: "otsu_only_pos"}


def test_zscore_flat_marker_and_bad_input(spark):
    df = spark.createDataFrame([("c", i, 2.0, float(i)) for i in range(4)], "basename string, cell_id long, ch00_true double, ch27_true double")
    rows = normalize.zscore_by_core(df, TWO).collect()
    assert all(r.ch00_zscore_spacec == 0.0 for r in rows)
    x = np.log1p(np.arange(4))
    want = (x - x.mean()) / x.std()
    assert sorted(r.ch27_zscore_spacec for r in rows) == pytest.approx(sorted(want))
    plain = normalize.zscore_by_core(df, TWO, space="log1p").collect()
    assert max(r.ch27_zscore_spacec for r in plain) == pytest.approx(1.5 / np.arange(4).std())
    for bad in (-1.0, float("nan"), None):
        with pytest.raises(Exception, match="intensity"):
            normalize.zscore_by_core(df.union(spark.createDataFrame([("c", 9, 1.0, bad)], df.schema)), TWO).collect()


def test_cluster_zscore_is_strict(spark):
    rows = [("c", i, i // 2, z0, z1) for i, (z0, z1) in enumerate(zip(np.repeat([1.0, 0.5, -0.5], 2), np.repeat([-1.0, 0.0, 0.3], 2)))]
    df = spark.createDataFrame([(b, i, c, float(x), float(y)) for b, i, c, x, y in rows],
                               "basename string, cell_id long, cluster_id_spacec int, ch00_zscore_spacec double, ch27_zscore_spacec double")
    cz = cluster.cluster_zscore(df, panel=TWO)
    got = {r.marker: r for r in cluster.positive_clusters(cz, 0.5).collect()}
    assert got["DAPI"].positive_cluster_ids == [0] and got["DAPI"].max_z == 1.0 and got["CD68"].positive_cluster_ids == []
    cells = cluster.broadcast_positivity(df, cz, 0.0, panel=TWO).orderBy("cell_id").collect()
    assert [r.ch00_pos_spacec for r in cells] == [True] * 4 + [False] * 2
    assert [r.ch27_pos_spacec for r in cells] == [False] * 4 + [True] * 2


def bimodal(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.05, (n, 12))
    x[: n // 2, 6] += 4.0
    return x


def test_two_blobs_give_two_clusters():
    ids = cluster.cluster_matrix(bimodal(), resolution=0.1)
    assert set(ids) == {0, 1} and len(set(ids[:200])) == 1 and ids[0] != ids[-1]
    assert (ids == cluster.cluster_matrix(bimodal(), resolution=0.1)).all()
    assert cluster.cluster_matrix(np.zeros((1, 12))).tolist() == [0]
    assert len(cluster.cluster_matrix(np.random.default_rng(0).random((3, 12)))) == 3


def cohort(spark, n=60, cores=("a", "b")):
    rng = np.random.default_rng(2)
    rows = []
    for b in cores:
        for i in range(n):
            bright = 20.0 if i < n // 2 else 0.2
            rows.append((b, i, 1.0, float(bright + 0.1 * rng.random()), True, False))
    return spark.createDataFrame(rows, "basename string, cell_id long, ch00_true double, ch27_true double, ch00_pos_consensus boolean, ch27_pos_consensus boolean")


def test_every_cell_gets_a_cluster_and_far_groups_share_none(spark):
    scaled = normalize.zscore_by_core(cohort(spark), TWO)
    got = cluster.cluster_cells(scaled, TWO, k=8, resolution=0.05).toPandas()
    assert len(got) == 120 and not got.duplicated(["basename", "cell_id"]).any()
    for _, g in got.groupby("basename"):
        g = g.sort_values("cell_id").cluster_id_spacec.to_numpy()
        assert not set(g[:30]) & set(g[30:])


def test_labels_and_reaudit(spark):
    out, gate = build_labels(cohort(spark), {}, gate=0.5, panel=TWO, k=8, resolution=0.05)
    row = out.agg(F.count("*").alias("n"), F.count_if("ch27_pos_spacec").alias("p")).first()
    assert (row.n, row.p) == (120, 60)
    assert {r.marker for r in gate.collect()} == {"DAPI", "CD68"}


def test_audit_core(spark):
    df = normalize.zscore_by_core(cohort(spark, cores=("a",)), TWO).withColumn("cluster_id", F.when(F.col("cell_id") < 30, 0).otherwise(1))
    rows = {r.marker: r for r in audit.audit_markers(df, {27: {"gmm": 1.5}}, panel=TWO).collect()}
    cd68 = rows["CD68"]
    assert cd68.n_cells == 60 and 26 <= cd68.n_pos_per_core_otsu <= 34 and cd68.n_pos_leiden_zscore == 30
    assert cd68.n_pos_consensus == 0 and cd68.suspicious_zero_consensus and cd68.cohort_gmm_threshold_log1p == 1.5
    assert cd68.cohort_otsu_threshold_log1p is None and rows["DAPI"].n_pos_consensus == 60
    bare = audit.audit_markers(df.drop("ch27_pos_consensus"), {}, panel=TWO).filter("marker = 'CD68'").first()
    assert bare.n_pos_consensus == 0
    with pytest.raises(ValueError, match="intensity"):
        audit.audit_markers(df.drop("ch27_true"), {}, panel=TWO)


def test_derived_audit_columns(spark):
    cols = "basename string, marker string, channel int, n_cells long, n_pos_consensus long, n_pos_per_core_otsu long, n_pos_leiden_zscore long"
    df = spark.createDataFrame([("A-1", "CD8", 7, 100, 20, 40, 0), ("A-10", "CD68", 27, 100, 0, 50, 0), ("A-10", "CD8", 7, 100, 0, 5, 5)], cols)
    for m in ("per_core_otsu_threshold_log1p", "cohort_gmm_threshold_log1p", "cohort_otsu_threshold_log1p", "cohort_quantile_threshold_log1p", "max_leiden_cluster_zscore"):
        df = df.withColumn(m, F.lit(0.0))
    out = audit.derive_audit(df)
    assert out.columns == list(audit.AUDIT_COLUMNS) and len(out.columns) == 17
    rows = {(r.basename, r.marker): r for r in out.collect()}
    assert rows["A-1", "CD8"].disagreement_score == pytest.approx(0.40)
    assert rows["A-10", "CD68"].suspicious_zero_consensus and not rows["A-10", "CD8"].suspicious_zero_consensus
    assert [r.marker for r in audit.top_suspicious(out, 5).collect()] == ["CD68"]
    assert audit.top_disagreement(out, 1).first().marker == "CD68"
    gate = {r.marker: r for r in audit.disagreement_gate(out, 0.3).collect()}
    assert gate["CD68"].fails and gate["CD68"].is_worst and not gate["CD8"].fails


def test_agreement_of_identical_cuts(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "ch27_true double")
    taus = {27: {"gmm": 4.0, "otsu": 4.0, "quantile": 100.0}}
    rows = {(r.method_a, r.method_b): r for r in labels.threshold_agreement(df, taus, P).collect()}
    same = rows["gmm", "otsu"]
    assert same.jaccard == 1.0 and same.cohen_kappa == 1.0 and same.disagree_rate == 0.0
    assert rows["gmm", "quantile"].jaccard == 0.0 and rows["gmm", "quantile"].cohen_kappa == 0.0


def test_shuffle_keeps_every_value(spark):
    pdf = pd.DataFrame({"basename": ["hot"] * 500 + ["b"] * 3, "cell_id": range(503), "v": np.arange(503.0), "x": np.arange(503)})
    out = sampling.shuffle_within_core(spark.createDataFrame(pdf), ["v"], 3).toPandas().sort_values("cell_id")
    assert (out.x.to_numpy() == np.arange(503)).all() and (out.v.to_numpy() != np.arange(503.0)).sum() > 400
    for b, g in out.groupby("basename"):
        assert sorted(g.v) == sorted(pdf[pdf.basename == b].v)


def test_samples(spark):
    df = spark.range(100).selectExpr("'c' as basename", "id as cell_id", "id % 3 as s")
    assert sampling.sample_rows(df, 10, 1).count() == 10 and sampling.sample_rows(df, 0, 1).count() == 100
    first = {r.cell_id for r in sampling.sample_rows(df, 10, 1).collect()}
    assert first == {r.cell_id for r in sampling.sample_rows(df.repartition(9), 10, 1).collect()}
    assert first != {r.cell_id for r in sampling.epoch_sample(df, 10, 1, 1).collect()}
    assert sampling.stratified_sample(df, "s", 7, 0).groupBy("s").count().filter("count = 7").count() == 3
    tiles = spark.range(200).selectExpr("id", "id % 2 = 0 as positive", "case when id % 4 = 0 then 'a' else 'b' end as channel")
    got = sampling.weighted_positive_sample(tiles, 40, 0.75, {"a": 1.0}, 0, ["id"]).toPandas()
    assert len(got) == 40 and got.positive.sum() == 30 and set(got[got.positive].channel) == {"a"}


def test_calibration(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        y = rng.random(2) < 0.4
        p = np.clip(0.3 * y + rng.random(2) * 0.6, 0, 1)
        rows.append(("c", i, *map(float, p), *map(bool, y)))
    df = spark.createDataFrame(rows, "basename string, cell_id long, ch00_pred double, ch27_pred double, ch00_pos boolean, ch27_pos boolean")
    train, out = calibrate.calibrate_markers(df, df, TWO)
    pdf = out.toPandas()
    assert len(pdf) == 400 and pdf.ch27_prob_logreg.between(0, 1).all()
    assert pdf[pdf.ch27_pos].ch27_prob_logreg.mean() > pdf[~pdf.ch27_pos].ch27_prob_logreg.mean() + 0.2
    report = {r.name: r for r in calibrate.calibration_rows(train, out, TWO).collect()}
    assert report["CD68"].auc_logreg > 0.8 and report["CD68"].n_eval_cells == 400


@pytest.fixture(scope="module")
def scattered(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        y = rng.random(2) < 0.4
        rows.append(("ab"[i % 2], i, *map(float, rng.integers(0, 60, 2)), *map(float, np.clip(0.3 * y + rng.random(2) * 0.6, 0, 1)), *map(bool, y)))
    return spark.createDataFrame(rows, "basename string, cell_id long, centroid_x double, centroid_y double, ch00_pred double, ch27_pred double, ch00_pos boolean, ch27_pos boolean")


def test_neighbours_of_both_arms_are_searched_once(scattered, monkeypatch):
    from cellframe.operators.spatial import knn

    found, search = [], knn.knn_edges
    counted = lambda *a, **b: found.append(1) or search(*a, **b)
    monkeypatch.setattr(knn, "knn_edges", counted)
    monkeypatch.setattr(calibrate, "knn_edges", counted, raising=False)
    # the run goes as far as the features
    monkeypatch.setattr(calibrate, "calibrate_markers", lambda train, *_: (_ for _ in ()).throw(StopIteration(train)))
    run, tables = calibrate.calibration_run, []

    def features(*a, **b):
        try:
            run(*a, **b)
        except StopIteration as x:
            tables.append(x.value)

    monkeypatch.setattr(calibrate, "calibration_run", features)
    settings = {"ks": (2, 5), "features": ("mean",)}
    calibrate.calibration_with_control(scattered, scattered.filter("cell_id < 150"), 3, TWO, **settings)
    assert len(found) == 2
    calibrate.calibration_run(scattered, scattered.filter("cell_id < 150"), TWO, shuffle_seed=3, **settings)
    assert len(found) == 4
    columns = ["basename", "cell_id", "ch27_pred", "nbr2_ch27_pred_mean", "nbr5_ch27_pred_mean"]
    real, shared, alone = (t.select(*columns).toPandas().sort_values("cell_id", ignore_index=True) for t in tables)
    pd.testing.assert_frame_equal(shared, alone)
    assert not real.ch27_pred.equals(shared.ch27_pred)


def test_parts_ranked_together_equal_their_own_reports(scattered, monkeypatch):
    from cellframe.operators import metrics

    passes, run = [], metrics.running_totals
    monkeypatch.setattr(metrics, "running_totals", lambda *a, **b: passes.append(1) or run(*a, **b))
    few, items = scattered.filter("cell_id < 90"), [("ch00_pos", "ch00_pred"), ("ch27_pos", "ch27_pred")]
    got = calibrate.ranked_together({"all": (scattered, items), "few": (few, items[1:]), "again": (scattered, items[:1])})
    assert len(passes) == 1
    for part, df, (y, score) in (("all", scattered, items[0]), ("few", few, items[1]), ("again", scattered, items[0])):
        want = metrics.score_report(df.select(F.lit(0).alias("position"), F.col(y).alias("y"), F.col(score).alias("score")), ["position"]).first().asDict()
        assert got[part].filter("position = 0").first().asDict() == pytest.approx(want)


def test_features_of_any_number_are_scaled_by_two_aggregates(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 2.0)], "a double, b double, c double")
    assert calibrate._scaler(df, ["a", "b", "c"]) == {"a": (2.0, 1.0), "b": (5.0, 1.0), "c": (2.0, 1.0)}
    with pytest.raises(ValueError, match="no cells"):
        calibrate._scaler(df.filter("false"), ["a"])


def test_logistic_models_of_all_markers_share_their_passes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1.0, 5.0, 0.01] + [0, 2, 7]
    y = rng.random((600, 2)) < 1 / (1 + np.exp(-(x[:, :2] - [0, 2]) * [2.0, 0.3]))
    known = rng.random((600, 2)) < 0.9
    rows = [(*map(float, a), *[float(v) if k else None for v, k in zip(b, c)]) for a, b, c in zip(x, y, known)]
    design = spark.createDataFrame(rows, "a double, b double, c double, y0 double, y1 double").repartition(3)
    scaler = calibrate._scaler(design, ["a", "b", "c"])
    models = []
    for i in range(2):
        n, pos = known[:, i].sum(), (y[:, i] & known[:, i]).sum()
        models.append(calibrate.Response(f"y{i}", (n / (2 * (n - pos)), n / (2 * pos)), np.zeros(4), np.zeros(4)))
    passes = calibrate.fit_logistic(design, ["a", "b", "c"], scaler, models, 50)
    assert passes < 15 and all(m.done for m in models)
    z = np.column_stack([np.ones(600), (x - x.mean(axis=0)) / x.std(axis=0)])
    for i, m in enumerate(models):
        w = np.where(y[:, i], m.weights[1], m.weights[0]) * known[:, i]
        p = 1 / (1 + np.exp(-z @ m.best))
        assert np.abs(z.T @ (w * (p - y[:, i])) + np.r_[0, m.best[1:]]).max() < 1e-6  # the gradient is zero

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    scaled = design.select(*[((F.col(c) - scaler[c][0]) / scaler[c][1]).alias(c) for c in "abc"], "y0").filter("y0 is not null")
    n = int(known[:, 0].sum())
    weighted = VectorAssembler(inputCols=list("abc"), outputCol="x").transform(scaled).withColumn("w", F.when(F.col("y0") > 0, models[0].weights[1]).otherwise(models[0].weights[0]))
    fitted = LogisticRegression(featuresCol="x", labelCol="y0", weightCol="w", regParam=1.0 / n, standardization=False, maxIter=500, tol=1e-12).fit(weighted)
    assert np.allclose(np.r_[fitted.intercept, fitted.coefficients.toArray()], models[0].best, atol=1e-6)


def test_missing_features_are_an_error_and_one_sided_markers_constant(spark):
    df = spark.createDataFrame([("c", i, 0.1 * i, 0.5, True, i % 2 == 0) for i in range(10)], "basename string, cell_id long, ch00_pred double, ch27_pred double, ch00_pos boolean, ch27_pos boolean")
    out = calibrate.calibrate_markers(df, df, TWO)[1].collect()
    assert {r.ch00_prob_logreg for r in out} == {1.0} and all(0 < r.ch27_prob_logreg < 1 for r in out)
    with pytest.raises(Exception, match="a feature is missing"):
        calibrate.calibrate_markers(df.withColumn("ch27_pred", F.when(F.col("cell_id") < 5, F.col("ch27_pred"))), df, TWO)


def test_stratified_sample_takes_the_first_of_every_stratum(spark):
    import hashlib

    rows = [("c", i, [None, "a", "b", "hot", "hot", "hot"][i % 6]) for i in range(3000)] + [("c", 9000, "small")]
    df = spark.createDataFrame(rows, "basename string, cell_id long, stratum string").repartition(5)
    got = sampling.stratified_sample(df, "stratum", 70, 5).collect()
    by = {}
    for b, i, s in rows:
        by.setdefault(s, []).append((hashlib.md5(f"{b}|{i}|5".encode()).hexdigest(), i))
    want = {(s, i) for s, v in by.items() for _, i in sorted(v)[:70]}
    assert {(r.stratum, r.cell_id) for r in got} == want and len(got) == len(want) == 281


def test_a_core_of_any_size_is_clustered_on_all_its_cells(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.3, (9000, len(TWO.channels)))
    x[::2] += 3.0
    columns = [f"ch{c:02d}_{cluster.SCALED}" for c in TWO.channels]
    df = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(x)], "basename string, cell_id long, " + ", ".join(f"{c} double" for c in columns))
    got = cluster.cluster_cells(df, TWO, k=10).toPandas().sort_values("cell_id").cluster_id_spacec.to_numpy()
    assert (got == cluster.cluster_matrix(x, 10)).all()


def test_neighbours_in_blocks_equal_whole_rows_and_hold_little(monkeypatch):
    """The k nearest from blocks of rows and columns, in a fraction of the memory of whole rows."""
    import tracemalloc

    x = np.random.default_rng(8).normal(0, 1, (5000, 6))
    near = cluster._nearest(x, 7)
    monkeypatch.setattr(cluster, "WHOLE_ROWS", 1000)
    tracemalloc.start()
    blocks = cluster._nearest(x, 7)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.sort(blocks, 1) == np.sort(near, 1)).all() and held < 8 << 20


def test_graph_holds_links_in_flat_arrays():
    x = np.random.default_rng(3).normal(0, 1, (60, 4))
    graph = cluster.knn_graph(x, 5)
    d = ((x[:, None] - x[None]) ** 2).sum(2) + np.diag([np.inf] * 60)
    near = np.argsort(d, 1)[:, :5]
    want = np.zeros((60, 60))
    for i, row in enumerate(near):
        for j in row:
            want[i, j] += 0.5
            want[j, i] += 0.5
    got = np.zeros((60, 60))
    for i in range(60):
        got[i, graph.other[graph.first[i]:graph.first[i + 1]]] = graph.weight[graph.first[i]:graph.first[i + 1]]
    assert (got == want).all()


def test_neighbours_in_leaves_are_exact_and_look_at_few_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4)) + 40.0 * rng.integers(0, 3, (3000, 1))
    x[:700] = x[0]
    x[700:710] = 0.0
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :9]
    monkeypatch.setattr(cluster, "WHOLE_ROWS", 500)
    # pairs of equal rows are picked from as they come
    monkeypatch.setattr(cluster, "FOUND", 5000)
    rows, first = [], cluster._first
    monkeypatch.setattr(cluster, "_first", lambda row, *a: rows.append(len(row)) or first(row, *a))
    near = cluster._nearest(x, 9)
    assert all(i not in near[i] and len(set(near[i])) == 9 for i in range(len(x)))
    np.testing.assert_allclose(np.take_along_axis(d, near, axis=1), want, atol=1e-8)
    assert max(rows) <= 5000 + 256 * 2048
    # leaves whose box is too far are not looked at
    looked = []
    monkeypatch.setattr(np, "flatnonzero", lambda v, keep=np.flatnonzero: looked.append(v.size) or keep(v))
    cluster._nearest(x[710:], 9)
    assert sum(looked) < 0.6 * 2290**2
