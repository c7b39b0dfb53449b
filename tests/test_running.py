"""Ordered aggregates against NumPy, with hot groups, hot values and outliers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellframe.functions import running
from cellframe.operators import metrics


@pytest.fixture
def skewed():
    rng = np.random.default_rng(4)
    n = 6000
    group = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    value = rng.normal(size=n)
    third = rng.random(n) < 0.33
    value[third] = 0.3 + rng.random(third.sum()) * 1e-7
    value[:20] = 1e9
    value[20:600] = 0.0
    value[600:900] = 1.0 - 10.0 ** -rng.uniform(1, 12, 300)
    return pd.DataFrame({"g": group, "v": value, "y": rng.random(n) < 0.3})


@pytest.mark.parametrize("rows_per_bin, levels", [(7, 4), (7, 32), (4096, 32)])
def test_running_totals_match_a_plain_cumulative_sum(spark, skewed, monkeypatch, rows_per_bin, levels):
    monkeypatch.setattr(running, "ROWS_PER_BIN", rows_per_bin)
    monkeypatch.setattr(running, "LEVELS", levels)
    monkeypatch.setattr(running, "FAN", levels * levels)
    df = spark.createDataFrame(skewed)
    ties = running.tie_totals(df, ["g"], "v", {"tp": F.col("y").cast("long"), "n": F.lit(1)})
    binned, depth = running._binned(ties, ["g"], "v")
    # no window holds more: neither rows of a bin nor bins under one parent
    assert binned.groupBy("g", "__b1", "__b2").count().agg(F.max("count")).first()[0] <= rows_per_bin
    assert depth >= {4: 2, 32: 1}[levels] if rows_per_bin == 7 else depth == 0
    for descending in (False, True):
        got = running.running_totals(ties, ["g"], "v", ["tp", "n"], descending).toPandas()
        for g, part in got.groupby("g"):
            ref = skewed[skewed.g == g].groupby("v").y.agg(["sum", "count"])
            ref = ref.sort_index(ascending=not descending).cumsum()
            part = part.set_index("v").loc[ref.index]
            assert (part.run_tp.to_numpy() == ref["sum"].to_numpy()).all()
            assert (part.run_n.to_numpy() == ref["count"].to_numpy()).all()
            assert part.tot_n.unique().tolist() == [(skewed.g == g).sum()]


@pytest.mark.parametrize("rows_per_bin", [7, 4096])
def test_quantiles_are_exact(spark, skewed, monkeypatch, rows_per_bin):
    monkeypatch.setattr(running, "ROWS_PER_BIN", rows_per_bin)
    levels = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q999": 0.999, "q1": 1.0}
    got = running.group_quantiles(spark.createDataFrame(skewed), ["g"], "v", levels).toPandas().set_index("g")
    for g, part in skewed.groupby("g"):
        for name, q in levels.items():
            assert got.loc[g, name] == pytest.approx(np.quantile(part.v, q), rel=1e-12, abs=1e-12)
        assert got.loc[g, "n"] == len(part)


def test_quantile_without_groups_and_with_nulls(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "v double")
    row = running.group_quantiles(df, [], "v", {"m": 0.5}).first()
    assert (row["n"], row["m"]) == (2, 2.0)


def average_precision(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    last = np.r_[np.flatnonzero(np.diff(s)), len(s) - 1]
    tp = np.cumsum(y)[last]
    precision, recall = tp / (last + 1), tp / y.sum()
    return float(np.sum(np.diff(np.r_[0.0, recall]) * precision))


def test_rank_metrics_against_numpy(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = metrics.rank_metrics(df, ["g"], "y", "v").toPandas().set_index("g")
    for g, part in skewed.groupby("g"):
        y, s = part.y.to_numpy().astype(int), part.v.to_numpy()
        assert got.loc[g, "ap"] == pytest.approx(average_precision(y, s), abs=1e-9)
        rank = pd.Series(s).rank().to_numpy()
        p, n = y.sum(), (1 - y).sum()
        auc = (rank[y == 1].sum() - p * (p + 1) / 2) / (p * n)
        assert got.loc[g, "auc"] == pytest.approx(auc, abs=1e-9)


def test_single_class_and_best_cut(spark):
    df = spark.createDataFrame(
        [("one", True, 0.5), ("one", True, 0.7), ("two", True, 0.9), ("two", False, 0.4), ("two", True, 0.6)],
        "g string, y boolean, s double")
    got = {r["g"]: r for r in metrics.rank_metrics(df, ["g"], "y", "s").collect()}
    assert got["one"]["ap"] is None and got["one"]["auc"] is None
    assert got["two"]["ap"] == 1.0 and got["two"]["auc"] == 1.0
    best = {r["g"]: r for r in metrics.best_f1(df, ["g"], "y", "s").collect()}
    assert best["one"]["best_threshold"] is None
    assert best["two"]["best_threshold"] == 0.6 and best["two"]["best_f1"] == 1.0
    with pytest.raises(Exception, match="both label classes"):
        metrics.fit_operating_threshold(df, ["g"], "y", "s").collect()


def test_losses(spark):
    df = spark.createDataFrame([(2.0, 1.0), (-3.0, 0.0), (0.5, 0.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    bce = np.mean([np.log1p(np.exp(-2.0)), np.log1p(np.exp(-3.0)), np.log1p(np.exp(0.5))])
    got = df.agg(
        metrics.masked_mean(metrics.asymmetric_loss(x, y, 0.0, 0.0, 0.0)).alias("a"),
        (metrics.masked_mean(metrics.focal_bce(x, y, 0.5, 0.0)) * 2).alias("f"),
        metrics.masked_mean(metrics.asymmetric_loss(x, y), F.lit(True)).alias("masked"),
        F.max(F.when(x == -3.0, metrics.asymmetric_loss(x, y))).alias("easy"),
    ).first()
    assert got["a"] == pytest.approx(bce) and got["f"] == pytest.approx(bce)
    assert got["masked"] == 0.0 and got["easy"] == 0.0
    with pytest.raises(ValueError):
        metrics.asymmetric_loss(x, y, clip=1.0)


def test_bins_hold_equal_counts(spark):
    """Nearly all values within a ten-thousandth of each other, with outliers in the same decade."""
    from pyspark.sql import functions as F

    from cellframe.functions import running

    n = 400_000
    df = spark.range(n).select(F.lit("g").alias("g"), F.when(F.col("id") == 0, 0.11).when(F.col("id") == 1, 0.89).otherwise(0.5 + F.col("id") * 1e-10).alias("v"))
    binned, depth = running._binned(running.tie_totals(df, ["g"], "v", {"n": F.lit(1)}), ["g"], "v")
    largest = binned.groupBy("__b1", "__b2").count().agg(F.max("count")).first()[0]
    assert largest <= running.ROWS_PER_BIN and depth >= 1
    out = running.group_quantiles(df, ["g"], "v", {"q": 0.5}).first()
    assert out.n == n and abs(out.q - (0.5 + (n / 2 + 0.5) * 1e-10)) < 1e-12


def test_bins_are_cut_by_place_and_small_groups_share_ranges(spark, monkeypatch):
    """One large group among many small ones: places fill every bin of a range but its last, and all sums are exact."""
    monkeypatch.setattr(running, "ROWS_PER_BIN", 50)
    rng = np.random.default_rng(9)
    hot = pd.DataFrame({"g": "hot", "v": np.r_[0.5 + rng.random(5000) * 1e-9, -1e12, 1e12, 0.0]})
    small = pd.DataFrame({"g": rng.integers(0, 200, 1500).astype(str), "v": rng.normal(size=1500)})
    data = pd.concat([hot, small], ignore_index=True).assign(w=lambda d: rng.integers(1, 9, len(d)))
    ties = running.tie_totals(spark.createDataFrame(data), ["g"], "v", {"w": F.col("w")})
    binned, depth = running._binned(ties, ["g"], "v")
    sizes = binned.groupBy("__b1", "__b2").count().toPandas()
    full = sizes.sort_values("__b2").groupby("__b1")["count"].apply(lambda c: (c.iloc[:-1] == 50).all() and c.iloc[-1] <= 50)
    assert full.all() and depth == 1 and sizes["count"].sum() == len(data)
    got = running.running_totals(ties, ["g"], "v", ["w"]).toPandas().sort_values(["g", "v"])
    want = data.sort_values(["g", "v"])
    assert (got.run_w.to_numpy() == want.groupby("g").w.cumsum().to_numpy()).all()
    assert (got.tot_w.to_numpy() == want.groupby("g").w.transform("sum").to_numpy()).all()
