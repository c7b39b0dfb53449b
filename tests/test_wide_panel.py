"""Wide panels: generated methods stay compilable, and stacked rows carry plain values."""

import math

from pyspark.sql import Row

from catalog import derived as D
from cellframe import session
from cellframe.operators import compose, metrics
from cellframe.panel import ch


def explained(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reading_cells_bounds_generated_methods(spark):
    was = spark.conf.get(session.HUGE_METHOD_CONF)
    try:
        spark.conf.set(session.HUGE_METHOD_CONF, 65535)
        session.bound_methods(spark)
        assert int(spark.conf.get(session.HUGE_METHOD_CONF)) == session.HUGE_METHOD
        spark.conf.set(session.HUGE_METHOD_CONF, 100)
        session.bound_methods(spark)
        assert int(spark.conf.get(session.HUGE_METHOD_CONF)) == 100
    finally:
        spark.conf.set(session.HUGE_METHOD_CONF, was)


def wide(spark):
    nan = math.nan
    values = [("a", 1.0, 0.9), ("a", 0.0, 0.2), ("a", nan, 0.5), ("a", 1.0, nan), ("a", None, None), ("b", None, 0.3), ("b", nan, 0.4)]
    rows = [Row(basename=b, **{ch(c, "pos"): y for c in D.P.channels}, **{ch(c, "pred", "m"): s for c in D.P.channels}) for b, y, s in values]
    fields = ", ".join(f"{name} double" for name in list(rows[0].asDict())[1:])
    return spark.createDataFrame(rows, f"basename string, {fields}")


def test_unknown_values_are_told_once_after_stacking(spark):
    long, items = metrics.melt_items(wide(spark), "m", D.P, phenotypes=False, keep=["basename"])
    assert explained(long).lower().count("isnan") < len(items)
    got = sorted((r.basename, str(r.y), str(r.score)) for r in long.where("item = 0").collect())
    assert got == [("a", "False", "0.2"), ("a", "None", "0.5"), ("a", "None", "None"), ("a", "True", "0.9"), ("a", "True", "None"), ("b", "None", "0.3"), ("b", "None", "0.4")]


def test_truth_comparison_of_unknown_values(spark):
    out = compose.truth_comparison(wide(spark), D.THR, "m", panel=D.P).collect()
    assert len(out) == len(D.P.channels) and {r.basename for r in out} == {"a"}  # a core without any truth gives no rows
    for r in out:
        cut = D.THR.marker[r.name]
        assert math.isclose(r.predicted_fraction, sum(s > cut for s in (0.9, 0.2, 0.5)) / 5)
        assert math.isclose(r.truth_fraction, 2 / 5) and r.ap is None  # a score is missing
