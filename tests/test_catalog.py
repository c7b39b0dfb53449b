"""Registered queries against DuckDB on the smallest tables.

A quick selection runs by default; set CATALOG=all for every query.
"""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUICK = (
    "p1_marker_calls", "p5_dominant_phenotype", "d1_core_composition", "d5_cohort_stats", "j2_merge_model",
    "e6_model_metrics", "o1_otsu_cuts", "w2_zscore_by_core", "d14_cozi", "j8_knn_edges", "q5_preflight", "k8_export_geojson",
)
ALL = os.environ.get("CATALOG") == "all"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value.item() if hasattr(value, "item") else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, "" if x is None else str(type(x)), 0 if x is None else x) for x in r))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if ALL else QUICK)
def test_query_matches_oracle(spark, oracle, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = oracle.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = ordered(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert got == want


def test_registry_is_complete():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    inventory = (
        [f"p{i}" for i in range(1, 27)] + [f"j{i}" for i in range(1, 18)] + [f"d{i}" for i in range(1, 39)]
        + [f"o{i}" for i in range(1, 11)] + [f"e{i}" for i in range(1, 14)] + [f"w{i}" for i in range(1, 8)]
        + [f"c{i}" for i in range(1, 8)] + [f"r{i}" for i in range(1, 18)] + [f"t{i}" for i in range(1, 8)]
        + [f"u{i}" for i in range(1, 4)] + [f"q{i}" for i in range(1, 8)] + [f"x{i}" for i in range(1, 4)]
        + [f"s{i}" for i in range(1, 13)] + [f"k{i}" for i in (1, 2, 3, 4, 6, 7, 8, 9, 10, 11)]
    )
    covered = {n.split("_")[0] for n in entry.queries()}
    assert [i for i in inventory if i not in covered] == []


def test_entry_is_lazy_and_has_the_summary_columns(spark):
    from cellframe.operators.spatial.preference import SUMMARY_COLUMNS

    assert entry.entry(spark).columns == list(SUMMARY_COLUMNS)


def test_cells_of_one_small_file_are_dealt_over_all_cores(spark, tmp_path, monkeypatch):
    from catalog import derived

    monkeypatch.setattr(derived, "DEALT_BYTES", 0, raising=False)
    spark.createDataFrame([(i, i % 7, "click") for i in range(200)], "event_id long, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spread = derived.cells(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(spread) == spark.sparkContext.defaultParallelism and sum(r["count"] for r in spread) == 200
