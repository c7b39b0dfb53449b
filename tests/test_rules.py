"""Calls, phenotype rules, label families and filters on literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.operators import compose, joins, rules
from cellframe.panel import DEFAULT_PANEL as P
from cellframe.panel import MarkerPanel, Thresholds, ch, ph

THR = Thresholds({n: 0.25 for n in P.names}, {n: 0.35 for n in P.phenotypes}, {"CD8": "strong"}, {"pdl1_positive": "moderate"})


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(0)
    rows = []
    for core in ("ccRCC_TMA1__A-1", "ccOC_TMA2__G-5"):
        for i in range(50):
            rows.append((core, i, *[float(v) for v in rng.random(12).round(2)], *[int(v) for v in rng.random(12) < 0.4],
                         *[float(v) for v in rng.random(9).round(2)], *[int(v) for v in rng.random(9) < 0.4]))
    cols = ["basename string", "cell_id long"] + [f"{ch(c, 'pred', 'v1_1')} double" for c in P.channels]
    cols += [f"{ch(c, 'pos')} int" for c in P.channels] + [f"{ph(n, 'score')} double" for n in P.phenotypes]
    cols += [f"{ph(n, 'label')} int" for n in P.phenotypes]
    return spark.createDataFrame(rows, ", ".join(cols))


def test_calls_are_inclusive_and_composition_is_their_mean(predictions):
    df = rules.phenotype_calls(rules.marker_calls(predictions, THR, "v1_1"), THR, "v1_1")
    pdf = df.toPandas()
    for c in P.channels:
        assert (pdf[ch(c, "call", "v1_1")] == (pdf[ch(c, "pred", "v1_1")] >= 0.25)).all()
    for n in P.phenotypes:
        assert (pdf[ph(n, "call", "v1_1")] == (pdf[ph(n, "score")] >= 0.35)).all()
    comp = compose.core_composition(df, ["v1_1"]).toPandas().set_index("basename")
    for b, g in pdf.groupby("basename"):
        assert comp.loc[b, "n_cells"] == 50
        assert comp.loc[b, "frac_ch27_pos_v1_1"] == pytest.approx(g[ch(27, "call", "v1_1")].mean())
        assert comp.loc[b, "mean_ch27_pred_v1_1"] == pytest.approx(g[ch(27, "pred", "v1_1")].mean())
        assert comp.loc[b, "frac_phenotype_pdl1_positive_truth"] == pytest.approx(g[ph("pdl1_positive", "label")].mean())


def test_statistics_count_strictly_above(spark):
    df = spark.createDataFrame([("c", 1, 0.25), ("c", 2, 0.26), ("c", 3, float("nan"))], "basename string, cell_id long, ch27_pred_m double")
    row = compose.marker_positivity(df, THR, "m").filter("name = 'CD68'").first()
    assert row.n_positive == 1
    calls = rules.marker_calls(df, THR, "m").orderBy("cell_id").collect()
    assert [r.ch27_call_m for r in calls] == [1, 1, 0]


def test_single_precision_comparison(spark):
    df = spark.createDataFrame([(0.35,)], "ch27_pred_m float")
    assert rules.marker_calls(df, Thresholds({n: 0.35 for n in P.names}, {}), "m").first().ch27_call_m == 1


def test_two_dominant_rules(spark):
    names = ("immune_cd45", "t_cell_cd45_cd8", "pdl1_positive")
    cols = ", ".join(f"{ph(n, 'score', 'm')} double, {ph(n, 'call', 'm')} int" for n in names)
    df = spark.createDataFrame([(1, 0.5, 1, 0.5, 1, 0.9, 0), (2, 0.9, 0, 0.2, 0, 0.1, 0), (3, 0.6, 1, 0.7, 1, 0.8, 1)], f"id int, {cols}")
    out = rules.first_call_code(rules.dominant_phenotype(df, "m"), "m").orderBy("id").collect()
    assert [r.dominant_phenotype for r in out] == ["immune_cd45", "background", "pdl1_positive"]
    assert [r.phenotype_code for r in out] == [0, -1, 0]
    assert [r.phenotype_name for r in out] == ["immune_cd45", None, "immune_cd45"]


def test_no_call_and_any_positive_add_up(predictions):
    df = rules.phenotype_calls(predictions, THR, "v1_1")
    dist = {r["name"]: r["count"] for r in compose.phenotype_distribution(df, "v1_1").collect()}
    any_call = df.filter(" or ".join(f"{ph(n, 'call', 'v1_1')} = 1" for n in P.phenotypes)).count()
    assert dist["no_call"] + any_call == df.count()


def test_phenotype_scores_with_missing_markers(spark):
    df = spark.createDataFrame([(0.5, 0.4), (1.7, -1.0), (None, 0.3)], "ch03_pred_m double, ch16_pred_m double")
    rows = rules.phenotype_scores(df, "m").collect()
    assert rows[0][ph("t_cell_cd45_cd8", "score", "m")] == 0.0
    assert rows[0][ph("tumor_ca9_or_panck", "score", "m")] == pytest.approx(0.4)
    assert rows[1][ph("immune_cd45", "score", "m")] == 1.0 and rows[1][ph("tumor_ca9_or_panck", "score", "m")] == 0.0


def test_label_families(spark):
    families = ("pos", "pos_consensus", "pos_disagree", "pos_gmm_orig", "pos_spacec")
    cols = ", ".join(f"{ch(c, f)} boolean" for f in families for c in P.channels)
    row = tuple(bool((i + j) % (j + 2) == 0) for j in range(5) for i in range(12))
    df = spark.createDataFrame([("c", 1, *row)], f"basename string, cell_id long, {cols}")
    take = lambda j: [row[j * 12 + i] for i in range(12)]
    got = rules.targets(df, "consensus").first()
    assert got.marker_y == take(1) and got.ignore_mask == take(2) and got.marker_y_orig == take(3)
    got = rules.targets(df, "spacec").first()
    assert got.marker_y == take(4) and got.ignore_mask == [False] * 12
    assert rules.targets(df, "gmm").first().marker_y == take(3)
    bare = df.select("basename", "cell_id", *[ch(c, "pos") for c in P.channels])
    for family in ("gmm", "consensus"):
        got = rules.targets(bare, family).first()
        assert got.marker_y == take(0) and got.marker_y_orig == take(0)
    with pytest.raises(ValueError, match="missing"):
        rules.targets(bare, "spacec")
    with pytest.raises(ValueError, match="invalid"):
        rules.targets(df, "other")


def test_names_and_filters(spark):
    df = spark.createDataFrame(
        [("ccRCC_TMA1__A-1", "train", 10, 3.0), ("ccOC_TMA2__G-5", "val", 5, 40.0)],
        "basename string, split string, n_cells int, rigid_D_px double")
    named = rules.attach_tma_tissue(df)
    assert {(r.tma, r.tissue) for r in named.collect()} == {("ccRCC_TMA1", "ccRCC"), ("ccOC_TMA2", "ccOC")}
    assert rules.filter_cores(named, min_cells=6, max_rigid=10).count() == 1
    assert rules.filter_cohort(named, tma="TMA2").count() == 1
    assert rules.filter_cohort(named, tma="MA2").count() == 0
    with pytest.raises(Exception, match="unknown tissue"):
        rules.filter_cohort(named, tissue="liver").collect()
    with pytest.raises(KeyError):
        rules.filter_phenotypes(named, "immune_cd45, nonsense", "m")
    assert rules.restrict_cores(named, ["ccOC_TMA2__G-5"]).count() == 1
    with pytest.raises(Exception, match="cores not found: nowhere"):
        rules.restrict_cores(named, ["ccOC_TMA2__G-5", "nowhere"]).collect()


def test_color_value_errors(spark):
    df = spark.createDataFrame([(0.3,)], "ch27_pred_m double")
    with pytest.raises(KeyError, match="truth column"):
        rules.color_value(df, "marker_truth", "CD68", "m")
    with pytest.raises(ValueError):
        rules.color_value(df, "marker_pred", None, "m")
    assert np.isnan(rules.color_value(df, "marker_pred", "CD8", "m").first().color_value)


def test_min_prob_keeps_everything_at_zero(spark):
    df = spark.createDataFrame([(0.3,), (None,), (float("nan"),)], "pred_prob double")
    assert rules.filter_min_prob(df, 0).count() == 3
    assert rules.filter_min_prob(df, 0.1).count() == 1


def test_merge_model(spark):
    cells = spark.createDataFrame([("c", 1), ("c", 2)], "basename string, cell_id long")
    preds = spark.createDataFrame([("c", 1, 0.9)], "basename string, cell_id long, ch46_pred double")
    out = joins.merge_model(cells, preds, "v1", THR)
    rows = {r.cell_id: r for r in joins.merge_model(out, preds, "v1", THR).collect()}
    assert rows[1].ch46_pred_v1 == 0.9 and rows[1][ph("pdl1_positive", "call", "v1")] == 1
    assert rows[2].ch46_pred_v1 is None and rows[2][ph("pdl1_positive", "call", "v1")] is None
    with pytest.raises(Exception, match="duplicate key"):
        joins.merge_model(cells, preds.union(preds), "v1", THR).collect()
    with pytest.raises(ValueError, match="no prediction columns"):
        joins.merge_model(cells, preds, "other", THR)
    assert joins.ordered_models(["a", "b", "a"], "b") == ["b", "a"]


def test_panel_validation():
    with pytest.raises(ValueError):
        MarkerPanel((("A", 1), ("A", 2)))
    with pytest.raises(KeyError):
        P.subset(["nothing"])
    assert P.subset(["CD8", "DAPI"]).names == ("DAPI", "CD8")
    assert THR.stratum("CD8") == "strong" and THR.stratum("CD68") == "weak"


def test_sample_stops(spark):
    stops = ((0.0, (0, 0, 0)), (1.0, (100, 200, 255)))
    df = spark.createDataFrame([(1, -3.0), (2, 0.5), (3, 7.0), (4, None)], "id int, v double")
    got = {r.id: (r.rgb_r, r.rgb_g, r.rgb_b) for r in rules.sample_stops(df, "v", stops).collect()}
    assert got == {1: (0, 0, 0), 2: (50, 100, 128), 3: (100, 200, 255), 4: (0, 0, 0)}
    got = {r.id: r.rgb_r for r in rules.sample_stops(df, "v", stops, diverging=True).collect()}
    assert got[1] == 0 and got[2] == 75 and got[4] == 50


def test_emit_labels_sentinels(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "basename string, cell_id long")
    result = spark.createDataFrame(
        [("a", 1, 0, 0.5, True), ("a", 2, 1, 0.1, False)],
        "basename string, cell_id long, cluster_id_spacec int, ch27_zscore_spacec double, ch27_pos_spacec boolean")
    rows = {(r.basename, r.cell_id): r for r in joins.emit_labels(df, result).collect()}
    assert rows["a", 1].cluster_id_spacec == 0 and rows["b", 1].cluster_id_spacec == -1
    assert np.isnan(rows["b", 1].ch27_zscore_spacec) and rows["b", 1].ch27_pos_spacec is False
    with pytest.raises(ValueError, match="already present"):
        joins.emit_labels(df.withColumn("cluster_id_spacec", F.lit(1)), result)
    with pytest.raises(Exception, match="count mismatch"):
        joins.emit_labels(df, result.limit(1)).collect()
