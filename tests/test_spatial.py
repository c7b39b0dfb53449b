"""Neighbour graphs and statistics: literal tables, brute force and adversarial layouts."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from cellframe.operators import joins
from cellframe.operators.spatial import knn, polygons, preference, quadtree, tiles


def brute(pdf, k):
    rows = set()
    for b, g in pdf.groupby("basename"):
        x, y, ids = g.centroid_x.to_numpy(float), g.centroid_y.to_numpy(float), g.cell_id.to_numpy()
        d2 = (x[:, None] - x[None]) ** 2 + (y[:, None] - y[None]) ** 2
        for i in range(len(g)):
            order = np.lexsort((ids, d2[i]))
            order = [j for j in order if j != i][:k]
            rows |= {(b, ids[i], ids[j], r + 1, round(float(np.sqrt(d2[i, j])), 9)) for r, j in enumerate(order)}
    return rows


def as_set(df):
    return {(r.basename, r.src_cell_id, r.dst_cell_id, r["rank"], round(r.distance_px, 9)) for r in df.collect()}


def layout(seed, sizes):
    """Cores with a crowd on one spot, a dense patch, lines and lonely outliers."""
    rng = np.random.default_rng(seed)
    parts = []
    for name, n in sizes.items():
        spread = rng.uniform(0, 1000, (n, 2)).round()
        third = n // 3
        spread[:third // 2] = (500.0, 500.0)
        spread[third // 2:third] = 700 + rng.normal(0, 0.01, (third - third // 2, 2))
        spread[third:third + 5] = rng.uniform(5e4, 6e4, (5, 2)) if n > 20 else spread[third:third + 5]
        parts.append(pd.DataFrame({
            "basename": name, "cell_id": np.arange(n)[rng.permutation(n)], "centroid_x": spread[:, 0], "centroid_y": spread[:, 1],
        }))
    line = pd.DataFrame({"basename": "line", "cell_id": range(60), "centroid_x": np.arange(60) ** 2.0, "centroid_y": 5.0})
    return pd.concat([*parts, line], ignore_index=True)


def test_toy_square(spark):
    df = spark.createDataFrame(
        [("c", 0, 0, 0, "A"), ("c", 1, 1, 0, "A"), ("c", 2, 0, 1, "B"), ("c", 3, 1, 1, "B"), ("lonely", 9, 5, 5, "A")],
        "basename string, cell_id long, centroid_x int, centroid_y int, label string")
    edges = knn.knn_edges(df, 1, "label").collect()
    assert len(edges) == 4 and {e.distance_px for e in edges} == {1.0}
    assert {(e.src_cell_id, e.dst_cell_id) for e in edges} == {(0, 1), (1, 0), (2, 0), (3, 1)}
    assert len(knn.knn_edges(df, 16).collect()) == 12
    assert knn.radius_edges(df, 1.5).count() == 12
    assert knn.radius_edges(df, 1.0).count() == 8


@pytest.mark.parametrize("crowded", [6, 512])
def test_knn_is_exact_on_skewed_cores(spark, monkeypatch, crowded):
    monkeypatch.setattr(knn, "CROWDED", crowded)
    pdf = layout(1, {"hot": 900, "small": 12, "tiny": 3, "mid": 300})
    assert as_set(knn.knn_edges(spark.createDataFrame(pdf), 6)) == brute(pdf, 6)


def test_knn_does_not_depend_on_partitioning(spark):
    pdf = layout(2, {"hot": 300})
    df = spark.createDataFrame(pdf)
    assert as_set(knn.knn_edges(df.repartition(7), 4)) == as_set(knn.knn_edges(df.coalesce(1), 4))


def clustered(n_per=30, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 10, 2 * n_per)
    y = np.r_[rng.uniform(-10, -1, n_per), rng.uniform(1, 10, n_per)]
    return pd.DataFrame({
        "basename": "c", "cell_id": range(2 * n_per), "centroid_x": x, "centroid_y": y,
        "label": ["A"] * n_per + ["B"] * n_per})


def z_table(spark, pdf, k=6):
    df = spark.createDataFrame(pdf)
    edges = knn.knn_edges(df, k, "label")
    return {(r.phenotype_a, r.phenotype_b): r for r in preference.cozi(df, edges, "label").collect()}


def test_preference_of_clustered_and_random_labels(spark):
    z = z_table(spark, clustered())
    assert z["A", "A"].z > 5 and z["B", "B"].z > 5 and z["A", "B"].z < -5 and z["B", "A"].z < -5
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({
        "basename": "c", "cell_id": range(80), "centroid_x": rng.uniform(0, 100, 80), "centroid_y": rng.uniform(0, 100, 80),
        "label": rng.choice(["A", "B"], 80)})
    assert all(abs(r.z) < 4 for r in z_table(spark, pdf).values())


def test_preference_edge_cases(spark):
    df = spark.createDataFrame(
        [("c", 0, 0, 0, "A"), ("c", 1, 1, 0, "B"), ("c", 2, 9, 9, "C"), ("one", 5, 0, 0, "A")],
        "basename string, cell_id long, centroid_x int, centroid_y int, label string")
    edges = knn.radius_edges(df, 2.0, "label")
    rows = {(r.phenotype_a, r.phenotype_b): r for r in preference.cozi(df, edges, "label").collect()}
    # no self pair of a single cell, no source without out-edges, unobserved pairs kept
    assert set(rows) == {("A", "B"), ("A", "C"), ("B", "A"), ("B", "C")}
    assert rows["A", "C"].observed == 0 and rows["A", "B"].n_total == 3 and rows["A", "B"].n_edges == 2
    assert rows["A", "B"].expected == pytest.approx(0.5)
    ratios = {(r.phenotype_a, r.phenotype_b) for r in preference.observed_over_expected(df, edges, "label").collect()}
    assert ratios == {("A", "B"), ("B", "A")}
    assert preference.cozi(df, edges.filter("false"), "label").count() == 0


def test_p_value(spark):
    from pyspark.sql import functions as F

    from cellframe.functions.expr import two_sided_p

    got = spark.range(1).select(two_sided_p(F.lit(1.959963985)).alias("p"), two_sided_p(F.lit(0.0)).alias("one")).first()
    assert got.p == pytest.approx(0.05, abs=1e-6) and got.one == pytest.approx(1.0, abs=1e-6)


def test_hotspot_overlap(spark):
    edges = [("c", i, 100 + j, "X", "A" if i == 0 or j == 3 else "B") for i in range(20) for j in range(4)]
    df = spark.createDataFrame(edges, "basename string, src_cell_id long, dst_cell_id long, src_phenotype string, dst_phenotype string")
    hot = preference.hotspots(df, "A").filter("is_hotspot").collect()
    assert [r.src_cell_id for r in hot] == [0]
    iou = {(r.phenotype_a, r.phenotype_b): r.hotspot_overlap_iou for r in preference.hotspot_overlap(df, ["A", "B", "C"]).collect()}
    assert iou["A", "A"] == 1.0 and iou["A", "B"] == 0.0 and iou["B", "C"] is None
    zeros = preference.local_label_count(df, "nothing").collect()
    assert len(zeros) == 20 and all(r.n_pheno == 0 and r.n_neighbors == 4 for r in zeros)


def test_points_in_polygons_of_mixed_sizes(spark):
    def square(x, y, r):
        return [[x - r, y - r], [x + r, y - r], [x + r, y + r], [x - r, y + r], [x - r, y - r]]

    rng = np.random.default_rng(3)
    polys = [("c", i, square(*map(float, rng.uniform(0, 500, 2)), float(2 ** rng.uniform(-2, 8)))) for i in range(60)]
    points = [("c", i, *map(float, rng.uniform(-50, 550, 2))) for i in range(400)]
    p = spark.createDataFrame(polys, "basename string, cell_id long, expanded_xy array<array<double>>")
    q = spark.createDataFrame(points, "basename string, point_id long, x double, y double")
    got = {r.point_id: r.polygon_id for r in polygons.points_in_polygons(q, p).collect()}
    want = {}
    for _, i, x, y in points:
        hits = [j for _, j, ring in polys if ring[0][0] <= x <= ring[2][0] and ring[0][1] <= y <= ring[2][1]]
        if hits:
            want[i] = min(hits)
    assert got == want


def test_cap_ring(spark):
    from pyspark.sql import functions as F

    long = [[float(i), float(i * i)] for i in range(40)]
    df = spark.createDataFrame(
        [(1, long), (2, [[0.0, 0.0], [3.0, 0.0], [3.0, 3.0]]), (3, [[-2.0, 0.0], [5.0, 0.0], [5.0, 5.0], [-2.0, 0.0]]), (4, [[1.0, 1.0], [1.0, 1.0]])],
        "id int, ring array<array<double>>")
    whole = {r.id: r for r in polygons.cap_ring(df, "ring", F.lit(5000), F.lit(5000)).collect()}
    assert whole[1].n_verts == 40 and whole[1].ring == long + long[:1] and whole[1].flags == ""
    rows = {r.id: r for r in polygons.cap_ring(df, "ring", F.lit(5000), F.lit(5000), 32).collect()}
    assert rows[1].n_verts == 32 and rows[1].ring[0] == rows[1].ring[-1] and rows[1].flags == "truncated"
    assert rows[1].ring[:-1] == [long[i * 40 // 32] for i in range(32)]
    assert rows[2].n_verts == 3 and rows[2].ring[-1] == [0.0, 0.0] and rows[2].flags == ""
    assert rows[3].flags == "border" and min(p[0] for p in rows[3].ring) == 0.0
    assert rows[4].degenerate


def test_knn_features_defaults(spark):
    df = spark.createDataFrame(
        [("c", 0, 0.0, 0.0, 0.2), ("c", 1, 3.0, 4.0, 0.6), ("lonely", 9, 1.0, 1.0, 0.9)],
        "basename string, cell_id long, centroid_x double, centroid_y double, ch03_pred double")
    out = knn.knn_features(df, [5], ["mean", "density", "posfrac"], {3: 0.5}, [3])
    rows = {r.cell_id: r for r in out.collect()}
    assert rows[0].nbr5_ch03_pred_mean == 0.6 and rows[0].nbr5_density == pytest.approx(1 / 6)
    assert rows[0].nbr5_ch03_posfrac == 1.0 and rows[1].nbr5_ch03_posfrac == 0.0
    # a cell without neighbours takes the overall mean
    assert rows[9].nbr5_ch03_pred_mean == pytest.approx(0.4)


def counted(rows, radius, labels):
    """Label counts within the radius by comparing all pairs."""
    out = {}
    for b, i, x, y, _ in rows:
        near = [t for b2, j, u, v, t in rows if b2 == b and j != i and (x - u) * (x - u) + (y - v) * (y - v) <= radius * radius]
        if near:
            out[b, i] = (len(near), *[near.count(t) for t in labels])
    return out


@pytest.mark.parametrize("case", ["dense", "clusters", "one spot", "line", "sparse"])
def test_label_counts_of_the_tree_equal_all_pairs(spark, case):
    rng = np.random.default_rng(11)
    n = 500
    if case == "dense":
        xy = rng.integers(0, 60, (n, 2)) / 2
    elif case == "clusters":
        xy = np.r_[rng.normal(0, 0.01, (200, 2)), rng.normal(9.99, 0.01, (200, 2)), rng.uniform(-30, 30, (100, 2))]
    elif case == "one spot":
        xy = np.r_[np.zeros((300, 2)), np.full((100, 2), [6.0, 8.0]), np.full((100, 2), [6.0, 8.0000001])]
    elif case == "line":
        xy = np.column_stack([np.arange(n) * 0.5, np.zeros(n)])
    else:
        xy = rng.uniform(-500, 500, (n, 2))
    labels = ["a", "b"]
    rows = [("xy"[i % 7 == 0], i, float(x), float(y), ["a", "b", "c", None][i % 4]) for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame(rows, "basename string, cell_id long, centroid_x double, centroid_y double, label string")
    got = {(r.basename, r.src_cell_id): (r.n_neighbors, r.local_count_a, r.local_count_b) for r in quadtree.radius_counts(df, 10.0, "label", labels).collect()}
    assert got == counted(rows, 10.0, labels)


def test_tree_of_an_empty_table_and_unknown_places(spark):
    schema = "basename string, cell_id long, centroid_x double, centroid_y double, label string"
    assert quadtree.radius_counts(spark.createDataFrame([], schema), 5.0, "label", ["a"]).count() == 0
    df = spark.createDataFrame([("c", 1, None, 2.0, "a"), ("c", 2, 1.0, 2.0, "a"), ("c", 3, 1.0, 7.0, "a")], schema)
    assert quadtree.radius_counts(df, 5.0, "label", ["a"]).count() == 2
    with pytest.raises(ValueError):
        quadtree.radius_counts(df, 0.0, "label", ["a"])


def test_pairs_of_nodes_grow_slower_than_pairs_of_cells(spark):
    """Four times the density: 16 times the edges, but far fewer rows of the tree."""
    made = []
    for side in (40, 80):
        grid = spark.range(side * side).select(F.lit("c").alias("basename"), F.col("id").alias("cell_id"), (F.col("id") % side * (200.0 / side)).alias("centroid_x"),
                                               (F.floor(F.col("id") / side) * (200.0 / side)).alias("centroid_y"), F.lit("a").alias("label"))
        spots = quadtree._spots(quadtree._points(grid, "label"), ["a"])
        levels, leaves = quadtree._tree(spots, 100.0, ["n", "n0"])
        inside, border = quadtree._descend(levels, 100.0)
        compared = sum(p.count() for p in inside) + quadtree.LEAF_SPOTS ** 2 * sum(p.count() for p in border)
        edges = quadtree.radius_counts(grid, 100.0, "label", ["a"]).agg(F.sum("n_neighbors")).first()[0]
        made.append((compared, edges))
    assert made[1][1] > 14 * made[0][1] and made[1][0] < 10 * made[0][0]


def placed(seed, n=400):
    rng = np.random.default_rng(seed)
    xy = np.r_[rng.normal(0, 3, (n // 2, 2)), rng.integers(-60, 60, (n // 2, 2)) / 2.0]
    return [("xy"[i % 7 == 0], i, float(x), float(y), ["a", "b", "c", None][i % 4]) for i, (x, y) in enumerate(xy)]


PLACED = "basename string, cell_id long, centroid_x double, centroid_y double, label string"


def all_pairs(rows, radius):
    for b, i, x, y, s in rows:
        for c, j, u, v, t in rows:
            d2 = (x - u) * (x - u) + (y - v) * (y - v)
            if b == c and i != j and d2 <= radius * radius:
                yield b, i, j, s, t, float(np.sqrt(d2))


@pytest.mark.parametrize("most", [10**6, 150])
def test_radius_graph_in_tiles_equals_all_pairs(spark, monkeypatch, most):
    """Also where some tiles are too large for a task (``most``), and with an id that comes twice."""
    monkeypatch.setattr(tiles, "TILE_ROWS", most)
    monkeypatch.setattr(tiles, "PAIRS", 500)
    rows = placed(5) + [("y", 3, 0.5, 0.5, "b"), ("x", 900, None, 1.0, "a"), ("x", 901, float("inf"), 1.0, "a"), ("x", None, 1.0, 1.0, "a")]
    df = spark.createDataFrame(rows, PLACED)
    known = [r for r in rows if r[1] not in (900, 901, None)]
    want = sorted(all_pairs(known, 10.0), key=str)
    names = ["basename", "src_cell_id", "dst_cell_id", "src_phenotype", "dst_phenotype", "distance_px"]
    assert sorted((tuple(r) for r in knn.radius_edges(df, 10.0, "label").select(*names).collect()), key=str) == want

    ranked = knn.rank_neighbours(knn.radius_edges(df, 10.0, "label", expand=False))
    plain = knn.rank_neighbours(knn.radius_edges(df, 10.0, "label"))
    columns = ["basename", "src_cell_id", "dst_cell_id", "distance_px", "rank"]
    assert sorted(map(tuple, ranked.select(*columns).collect())) == sorted(map(tuple, plain.select(*columns).collect()))

    graph, labels = knn.radius_edges(df, 10.0, expand=False), df.withColumnRenamed("label", "kind").where("cell_id is null or cell_id != 8")
    named = joins.annotate_edges(graph, labels, "kind").select(*names)
    joined = joins.annotate_edges(knn.radius_edges(df, 10.0), labels, "kind").select(*names)
    assert sorted((tuple(r) for r in named.collect()), key=str) == sorted((tuple(r) for r in joined.collect()), key=str)


@pytest.mark.parametrize("most", [10**6, 150])
def test_label_counts_in_tiles_equal_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(tiles, "TILE_ROWS", most)
    monkeypatch.setattr(tiles, "PAIRS", 500)
    rows = placed(6) + [("x", 900, None, 1.0, "a"), ("x", 901, float("nan"), 1.0, "a")]
    got = quadtree.radius_counts(spark.createDataFrame(rows, PLACED), 10.0, "label", ["a", "b"]).collect()
    assert {(r.basename, r.src_cell_id): (r.n_neighbors, r.local_count_a, r.local_count_b) for r in got} == counted(rows[:-2], 10.0, ["a", "b"])


def test_radius_queries_shuffle_cells_and_no_pairs(spark):
    """Ranking and naming edges, and counting labels, take one exchange of cells each, none of edges."""
    df = spark.createDataFrame(placed(7), PLACED)
    graph = knn.radius_edges(df, 10.0, "label", expand=False)
    for out, most in ((knn.radius_edges(df, 10.0), 1), (knn.rank_neighbours(graph), 1), (quadtree.radius_counts(df, 10.0, "label", ["a"]), 1)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == most and "Window" not in plan


def test_pairs_meet_by_their_cell_before_features_are_summed(spark):
    """The sums of a feature are wider than the pair they begin with: none are sent."""
    df = spark.createDataFrame([("c", i, float(i), 0.0, i / 10) for i in range(10)], "basename string, cell_id long, centroid_x double, centroid_y double, ch00_pred double")
    edges = knn.knn_edges(df, 3)
    sums = knn.pairs_by_cell(edges, df.select("basename", "cell_id", "ch00_pred"), ["ch00_pred"]).groupBy("basename", "src_cell_id").agg(F.avg("ch00_pred"))
    lines = sums._jdf.queryExecution().executedPlan().toString().splitlines()
    aggregates = [i for i, line in enumerate(lines) if "HashAggregate" in line]
    assert not any("Exchange" in line for line in lines[aggregates[0]:aggregates[1]])


def _odd_points(spark, many_labels, text_ids):
    rng = np.random.default_rng(3)
    rows = []
    for core in ("a", "b"):
        for i in range(160):
            label = f"l{int(rng.integers(0, 60 if many_labels else 4))}" if i % 9 else None
            rows.append((core, None if i == 50 else i - i % 7 if i < 14 else i, float(rng.integers(0, 60)), float(rng.integers(0, 60)), label))
    rows += [("a", 900, float("nan"), 1.0, "l1"), ("a", 901, 400.0, 400.0, "far"), (None, 902, 1.0, 1.0, "l1")]
    if text_ids:
        rows = [(r[0], None if r[1] is None else f"c{r[1]:03d}", *r[2:]) for r in rows]
    return rows, spark.createDataFrame(rows, f"basename string, cell_id {'string' if text_ids else 'long'}, centroid_x double, centroid_y double, t string")


@pytest.mark.parametrize("many_labels, text_ids", [(False, False), (True, True)])
def test_edges_leave_their_tiles_as_lists_and_label_pairs_without_edges(spark, monkeypatch, many_labels, text_ids):
    from collections import Counter

    rows, df = _odd_points(spark, many_labels, text_ids)
    radius = 9.0
    want = Counter()
    for p in rows:
        for q in rows:
            if p[0] is not None and p[0] == q[0] and p[1] is not None and q[1] is not None and p[1] != q[1]:
                d2 = (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2
                if d2 <= radius * radius:
                    want[(p[0], p[1], q[1], p[4], q[4], d2**0.5)] += 1
    graph = knn.radius_edges(df, radius, "t", expand=False)
    # a tile's cells of a task are one row
    assert tiles.packs(graph).count() < graph.count() / 2
    edges = knn.radius_edges(df, radius, "t").select("basename", "src_cell_id", "dst_cell_id", "src_phenotype", "dst_phenotype", "distance_px")
    assert Counter(map(tuple, edges.collect())) == want
    pairs = {(k[3], k[4]) for k in want}
    monkeypatch.setattr(knn, "pair_tiles", None)
    got = [tuple(r) for r in knn.label_pairs(graph).collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    got = [tuple(r) for r in knn.label_pairs(edges).collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    monkeypatch.setattr(tiles, "TILE_ROWS", 20)
    got = [tuple(r) for r in knn.label_pairs(graph).collect()]
    assert set(got) == pairs and len(got) == len(pairs)


def test_doubles_are_rounded_as_their_decimal_text_is(spark):
    from catalog.derived import rounded6

    rng = np.random.default_rng(5)
    values = [0.0, -0.0, 5e-7, -5e-7, 4.9999999e-7, 1.0000005, 2.5e-6, 1.2345675, 8589934592.0000005, 1e300, -1e18, 0.1 + 0.2, 5e-324, 123456.7890125]
    values += [float(v) for s in (1e-6, 1e-3, 1.0, 1e3, 1e6, 1e12) for v in rng.normal(0, s, 300)]
    values += [i / 1e6 + 5e-7 for i in range(300)] + [i / 128 for i in range(-300, 300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.where(~(F.round("v", 6) + F.lit(0.0)).eqNullSafe(rounded6(F.col("v")) + F.lit(0.0))).collect() == []


@pytest.mark.parametrize("text_ids", [False, True])
def test_features_of_lists_equal_those_of_edges(spark, monkeypatch, text_ids):
    from cellframe.operators.spatial import lists

    rows, df = _odd_points(spark, False, text_ids)
    # unknown and undefined values, a core of one cell and cells without a place
    df = df.unionByName(spark.createDataFrame([("lone", "c0" if text_ids else 0, 1.0, 1.0, "x"), ("a", "c9" if text_ids else 9999, None, 1.0, "x")], df.schema))
    v = F.pmod(F.xxhash64("cell_id", "centroid_x"), F.lit(97)) / F.lit(96.0)
    df = df.withColumns({"ch03_pred": F.when(v > 0.1, v), "ch05_pred": F.when(F.col("centroid_x") < 3, F.lit(float("nan"))).otherwise(v * v)})
    ask = ([2, 6], knn.FEATURES, {3: 0.5, 5: 0.3}, [3, 5])
    want = knn.knn_features(df, *ask, edges=knn.knn_edges(df, 6))
    monkeypatch.setattr(lists, "PIECE", 50)
    joined, join = [], knn.pairs_by_cell
    monkeypatch.setattr(knn, "pairs_by_cell", lambda edges, *a: joined.append(edges.select("basename", "src_cell_id").distinct().count()) or join(edges, *a))
    got = knn.knn_features(df, *ask)
    # pairs are joined for the ids that come twice alone: two in each of the two cores
    assert joined == [4]
    assert got.columns == want.columns and got.count() == want.count()
    order = ["basename", "cell_id", "centroid_x", "centroid_y", "t"]
    one, other = (t.toPandas().sort_values(order, ignore_index=True) for t in (got, want))
    pd.testing.assert_frame_equal(one, other, rtol=1e-9, atol=1e-12)
    edges = {tuple(r)[:2] + (r.rank,): r for r in knn.knn_edges(df, 6).collect() if r.src_cell_id not in (0, 7, "c000", "c007")}
    graph = knn.knn_edges(df, 6, expand=False)
    listed = [r for r in lists.listed_edges(graph.where("not twice")).collect()]
    assert {tuple(r)[:2] + (r.rank,): (r.dst_cell_id, r.distance_px) for r in listed} == {k: (r.dst_cell_id, r.distance_px) for k, r in edges.items()}
    assert len(listed) == len(edges)
