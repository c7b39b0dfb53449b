"""Readers, writers, manifests, quality checks and region tables."""

import json
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from cellframe.operators import joins, quality, regions, registry
from cellframe.panel import DEFAULT_PANEL as P
from cellframe.panel import Thresholds
from cellframe.sources import artifacts, files, listing, sinks, tables, versions


def artifact():
    return {
        "schema_version": 1,
        "marker_thresholds": {str(c): 0.25 for c in P.channels}, "phenotype_thresholds": {n: 0.35 for n in P.phenotypes},
        "marker_confidence": {n: "strong" for n in P.names}, "phenotype_confidence": {n: "weak" for n in P.phenotypes},
        "provenance": {"run": "x"},
    }


def dump(tmp_path, doc, name="a.json"):
    path = tmp_path / name
    path.write_text(json.dumps(doc))
    return str(path)


def test_threshold_artifact(spark, tmp_path):
    thr = artifacts.thresholds(artifacts.load_threshold_artifact(spark, dump(tmp_path, artifact())))
    assert thr.marker["CD68"] == 0.25 and thr.stratum("CD68") == "strong" and thr.stratum("pdl1_positive") == "weak"
    broken = [
        (lambda d: d.pop("schema_version"), "schema_version"),
        (lambda d: d["marker_thresholds"].pop("27"), "marker_thresholds keys"),
        (lambda d: d["phenotype_thresholds"].update(extra=0.1), "phenotype_thresholds keys"),
        (lambda d: d["marker_thresholds"].update({"27": 1.5}), "must be in"),
        (lambda d: d["marker_confidence"].update(CD68="certain"), "invalid strata"),
        (lambda d: d.update(provenance={}), "provenance"),
    ]
    for i, (spoil, message) in enumerate(broken):
        doc = artifact()
        spoil(doc)
        with pytest.raises(Exception, match=message):
            artifacts.load_threshold_artifact(spark, dump(tmp_path, doc, f"b{i}.json")).collect()


def test_cohort_thresholds(spark, tmp_path):
    doc = {"0": {"gmm": 1.0, "otsu": 1.1, "quantile": 1.2, "target_pos": 0.3}, "27": {"gmm": 2.0}}
    got = artifacts.threshold_dict(artifacts.load_cohort_thresholds(spark, dump(tmp_path, doc)))
    assert got[0]["target_pos"] == 0.3 and got[27] == {"gmm": 2.0}
    with pytest.raises(Exception, match="non-integer channel"):
        artifacts.load_cohort_thresholds(spark, dump(tmp_path, {"x": {"gmm": 1.0}}, "c.json")).collect()


def test_threshold_rows_and_scaler(spark, tmp_path):
    rows = [{"channel": 3, "threshold": 0.4}, {"channel": 7, "threshold": 0.5, "train_positive_fraction": 0.2}]
    for i, doc in enumerate((rows, {"thresholds": rows})):
        got = {r.channel: r.train_positive_fraction for r in artifacts.load_threshold_rows(spark, dump(tmp_path, doc, f"t{i}.json"), [3]).collect()}
        assert got == {3: 0.1, 7: 0.2}
    with pytest.raises(Exception, match="lacks channels"):
        artifacts.load_threshold_rows(spark, dump(tmp_path, rows, "t.json"), [99]).collect()
    good = {"C": 2, "qlo": [0, 1], "qhi": [1, 3]}
    assert artifacts.load_quantile_scaler(spark, dump(tmp_path, good, "q.json")).count() == 2
    for i, (bad, message) in enumerate((({"C": 3, "qlo": [0, 1], "qhi": [1, 3]}, "C values"), ({"C": 1, "qlo": [2], "qhi": [2]}, "exceed"))):
        with pytest.raises(Exception, match=message):
            artifacts.load_quantile_scaler(spark, dump(tmp_path, bad, f"q{i}.json")).collect()


def test_model_metadata(spark, tmp_path):
    entry = {"id": "m", "name": "M", "backbone": "b", "training_split": "train", "provenance": {"run": "1"}}
    doc = {"schema_version": 1, "models": [entry]}
    assert artifacts.load_model_metadata(spark, dump(tmp_path, doc), ["m"]).count() == 1
    with pytest.raises(Exception, match="ids mismatch"):
        artifacts.load_model_metadata(spark, dump(tmp_path, doc), ["m", "n"]).collect()
    with pytest.raises(Exception, match="non-empty"):
        artifacts.load_model_metadata(spark, dump(tmp_path, {"schema_version": 1, "models": [{**entry, "name": " "}]}, "e.json"), ["m"]).collect()


def polygons(spark, ids):
    ring = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]
    return spark.createDataFrame([("c", i, 1.0, 1.0, ring, ring, 2.0, 2.0, 3, 3, "") for i in ids], tables.POLYGON_SCHEMA)


def test_bundle_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("c", i, 1.0, 2.0) for i in range(3)], "basename string, cell_id long, centroid_y double, centroid_x double")
    cores = spark.createDataFrame([("c", "train", 3)], "basename string, split string, n_cells int")
    skips = spark.createDataFrame([("c", 2, "tiny", 3.0, 5.0)], tables.SKIP_SCHEMA)
    path = str(tmp_path / "bundle")
    manifest = spark.createDataFrame([(1, "v1_1")], "schema_version int, model string")
    bundle = tables.Bundle(cells, cores, cell_polygons=polygons(spark, [0, 1]), polygons_skipped=skips)
    for _ in range(2):
        sinks.write_bundle(bundle, path, Thresholds({"CD8": 0.3}, {"pdl1_positive": 0.4}), manifest)
    back = tables.load_bundle(spark, path)
    assert back.cells.count() == 3 and back.cores.first().n_cells == 3 and back.manifest.first().model == "v1_1"
    assert back.cell_polygons.columns == [f.name for f in tables.POLYGON_SCHEMA.fields]
    assert dict(back.cell_polygons.dtypes)["n_verts_nucleus"] == "int"
    assert not [n for n in os.listdir(path) if "staging" in n or ".old-" in n]
    sinks.write_polygons(polygons(spark, [0]), skips, path)
    with pytest.raises(ValueError, match="missing_polygon"):
        tables.load_bundle(spark, path)
    sinks.write_polygons(polygons(spark, [0, 0, 1]), skips, path)
    with pytest.raises(ValueError, match="duplicate_polygon"):
        tables.load_bundle(spark, path)
    with pytest.raises(FileNotFoundError):
        tables.load_bundle(spark, str(tmp_path / "nothing"))


def test_skip_log_is_written_when_empty(spark, tmp_path):
    sinks.write_polygons(polygons(spark, [0]), spark.createDataFrame([], tables.SKIP_SCHEMA), str(tmp_path))
    assert os.path.isdir(versions.locate(spark, str(tmp_path), "polygons_skipped.csv"))


def small_bundle(spark, n):
    cells = spark.createDataFrame([("c", i) for i in range(n)], "basename string, cell_id long")
    return tables.Bundle(cells, spark.createDataFrame([("c", n)], "basename string, n_cells int"))


def sizes(spark, path):
    back = tables.load_bundle(spark, path)
    return back.cells.count(), back.cores.first().n_cells


@pytest.mark.parametrize("step", ["first table", "second table", "commit", "half a commit"])
def test_a_stopped_writer_leaves_the_bundle_as_it_was(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "bundle")
    sinks.write_bundle(small_bundle(spark, 3), path)
    real, calls = sinks.parquet_writer, []

    def stopping(df, partition_by=()):
        def write(folder):
            calls.append(folder)
            if step in ("first table", "second table") and len(calls) == (1 if step == "first table" else 2):
                raise OSError("stopped")
            real(df, partition_by)(folder)

        return write

    monkeypatch.setattr(sinks, "parquet_writer", stopping)
    if step == "commit":
        monkeypatch.setattr(versions, "_commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    if step == "half a commit":
        with open(os.path.join(path, "versions", f"{1:012d}.json"), "w") as out:
            out.write('{"tables": {"cel')
    else:
        with pytest.raises(OSError, match="stopped"):
            sinks.write_bundle(small_bundle(spark, 5), path)
    assert sizes(spark, path) == (3, 3)
    monkeypatch.undo()
    sinks.write_bundle(small_bundle(spark, 7), path)
    assert sizes(spark, path) == (7, 7)


def test_versions_conflict_keep_other_tables_and_can_be_dropped(spark, tmp_path):
    path = str(tmp_path / "bundle")
    sinks.write_bundle(small_bundle(spark, 2), path)
    held = tables.load_bundle(spark, path)
    sinks.rewrite_cells(small_bundle(spark, 4).cells, path)
    assert sizes(spark, path) == (4, 2) and held.cells.count() == 2  # a reader keeps its version
    with pytest.raises(versions.Conflict):
        versions._commit(spark, path, versions.Version(1, {}))
    assert versions.drop_versions(spark, path, keep=1) == 1 and versions.drop_versions(spark, path, keep=1) == 0
    assert sizes(spark, path) == (4, 2)


def test_a_folder_without_versions_is_read_and_taken_over(spark, tmp_path):
    path = str(tmp_path / "plain")
    for name, df in (("cells", small_bundle(spark, 3).cells), ("core_summary", small_bundle(spark, 3).cores)):
        df.write.parquet(f"{path}/{name}.parquet")
    assert sizes(spark, path) == (3, 3)
    sinks.rewrite_cells(small_bundle(spark, 6).cells, path)
    assert sizes(spark, path) == (6, 3) and os.path.isdir(f"{path}/cells.parquet")


def test_csv_cells_and_projection(spark, tmp_path):
    path = str(tmp_path / "cells.csv")
    with open(path, "w") as f:
        f.write("basename,cell_id,centroid_y,centroid_x,ch27_true,ch27_pos,note\nc,1,2,3,0.5,True,hi\n")
    df = tables.read_cells(spark, path)
    assert dict(df.dtypes)["ch27_true"] == "double" and dict(df.dtypes)["ch27_pos"] == "boolean" and df.first().note == "hi"
    assert tables.read_projected(spark, path, ["cell_id"]).columns == ["cell_id"]
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_projected(spark, path, ["nope"])
    with pytest.raises(FileNotFoundError):
        tables.read_cells(spark, str(tmp_path / "none.parquet"))


def test_projection_reaches_the_scan(spark):
    df = tables.read_projected(spark, "/root/testdata/sf0.001/events.parquet", ["event_id"]).filter("event_id > 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint>" in plan and "GreaterThan(event_id,5)" in plan


def test_listing(spark, tmp_path):
    names = ["B-2.tif", "A-1.tif", "A-3.tif", "not-a-core.tif", "C-x.tif", "p_HE.npy", "p_CODEX.npy", "q_HE.npy"]
    for n in names:
        (tmp_path / n).write_text(n)
    listed = listing.list_files(spark, str(tmp_path))
    cores = listing.discover_cores(listed).orderBy("row", "col")
    assert [(r.row, r.col) for r in cores.collect()] == [("A", 1), ("A", 3), ("B", 2)]
    assert [r.basename for r in listing.discover_pairs(listed).collect()] == ["p"]
    hashes = listing.artifact_hashes(spark, str(tmp_path), "*.tif").collect()
    assert len(hashes) == 5 and all(len(r.sha256) == 64 and not r.duplicate_name for r in hashes)
    lattice = regions.dense_lattice(cores.withColumn("tma", F.lit("t"))).collect()
    assert len(lattice) == 6 and sum(r.present for r in lattice) == 3
    ids = spark.createDataFrame([("A-10",), ("A-2",), ("B-1",)], "core string")
    assert [r.core for r in regions.core_sort(ids).collect()] == ["A-2", "A-10", "B-1"]


def test_files_of_any_size_are_hashed_in_blocks(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.bin").write_bytes(b"abc")
    (tmp_path / "a.bin").write_bytes(b"")
    (tmp_path / "_hidden.bin").write_bytes(b"x")
    (tmp_path / ".part").mkdir()
    (tmp_path / ".part" / "b.bin").write_bytes(b"x")
    size = (2 << 30) + 12345
    with open(tmp_path / "huge.bin", "wb") as out:
        out.truncate(size)  # a hole: takes no disk
    want = hashlib.sha256()
    for at in range(0, size, 1 << 24):
        want.update(bytes(min(1 << 24, size - at)))
    got = sorted((r.name, r.bytes, r.sha256, r.duplicate_name) for r in listing.artifact_hashes(spark, str(tmp_path), "*.bin").collect())
    empty, abc = (hashlib.sha256(x).hexdigest() for x in (b"", b"abc"))
    assert got == sorted([("a.bin", 0, empty, True), ("a.bin", 3, abc, True), ("huge.bin", size, want.hexdigest(), False)])
    assert listing.artifact_hashes(spark, f"file:{tmp_path}/deep").first().sha256 == abc
    assert listing.list_files(spark, str(tmp_path), "none*").count() == 0


def test_listing_reads_no_content_and_deals_files_by_size(tmp_path, monkeypatch):
    for i in range(6):
        (tmp_path / f"{i}").write_bytes(bytes(100 * i))
    monkeypatch.setattr(files, "PARTITION_BYTES", 300)
    monkeypatch.setattr(files.FileReader, "sha256", None)
    listed = files.FileReader(str(tmp_path), "*", False)
    assert [len(p.files) for p in listed.partitions()] == [6]
    assert [r[2] for r in listed.read(listed.partitions()[0])] == [None] * 6
    assert [[n for _, n in p.files] for p in files.FileReader(str(tmp_path), "*", True).partitions()] == [[0, 100, 200], [300], [400], [500]]


def test_manifest_repair(spark):
    man = spark.createDataFrame(
        [("t", "A-1", "cached", 2.0, ""), ("t", "A-2", "bad_alignment", 200.0, "x"), ("t", "A-3", "bad_alignment", 50.0, "x"), ("t", "A-4", "ok", 1.0, "")],
        "tma string, core string, status string, rigid_D_px double, error string")
    stats = registry.residual_stats(man).first()
    assert stats.n == 2 and stats.max == 2.0
    meta = spark.createDataFrame([("t", "A-3", True, 18.0), ("t", "A-4", True, 31.0)], "tma string, core string, has_arrays boolean, residual double")
    rows = {r.core: r for r in registry.repair_manifest(man, meta, 30.0).collect()}
    assert (rows["A-3"].status, rows["A-3"].rigid_D_px, rows["A-3"].error) == ("cached", 18.0, "")
    assert rows["A-4"].status == "bad_alignment" and rows["A-4"].error == "rigid_D=31.0px > 30.0"
    assert rows["A-2"].rigid_D_px == 200.0
    assert {r.core for r in registry.retry_list(man, 30.0).collect()} == {"A-2", "A-3"}
    assert registry.purge_list(man).count() == 2
    table = registry.manifest_status(man).first()
    assert (table.ok, table.cached, table.bad_alignment, table.fail) == (1, 1, 2, 0)
    assert registry.todo_cores(man.select("tma", "core"), man).count() == 2


def test_quality(spark):
    df = spark.createDataFrame(
        [("c", 1, 5.0, 5.0), ("c", 1, 6.0, 6.0), ("c", None, -1.0, 5.0), ("d", 2, float("nan"), 95.0)],
        "basename string, cell_id long, centroid_y double, centroid_x double")
    assert quality.duplicate_keys(df).count() == 2
    row = quality.violation_counts(df).first()
    assert (row.null_keys, row.non_finite, row.negative_coords) == (1, 1, 1)
    dims = spark.createDataFrame([("c", 100, 100), ("d", 100, 100)], "basename string, height int, width int")
    got = {r.basename: (r.cells, r.cells_with_full_patch) for r in quality.incomplete_patches(df.na.fill(0.0), dims, 10).collect()}
    assert got == {"c": (3, 2), "d": (1, 0)}
    with pytest.raises(ValueError, match="even"):
        quality.incomplete_patches(df, dims, 7)


def test_hygiene(spark):
    files = spark.createDataFrame(
        [("src/logs/a.py", "ok"), ("x.npy", ""), ("a/b.md", "see /home/users/me/data"), ("c.min.js", "/home/users/me/x"), ("ok.py", "fine")],
        "path string, content string")
    got = {(r.path, r.violation) for r in quality.hygiene_scan(files).collect()}
    assert got == {("src/logs/a.py", "forbidden directory"), ("x.npy", "forbidden binary or notebook type"), ("a/b.md", "contains machine-specific path")}


def test_regions(spark):
    px = spark.createDataFrame([("c", y, x, 1) for y in range(2) for x in range(3)] + [("c", 9, 9, 2), ("c", 0, 9, 0)], "basename string, y int, x int, label int")
    rows = {r.label: r for r in regions.region_properties(px).collect()}
    assert set(rows) == {1, 2} and rows[1].area == 6 and rows[1].centroid_x == 1.0 and rows[1].max_x == 3
    kept = regions.filter_regions(regions.region_properties(px), 1, 3).collect()
    assert [(r.label, r.new_label) for r in kept] == [(2, 1)]
    cells = spark.createDataFrame([("c", 1), ("c", 2), ("c", 3)], "basename string, cell_id long")
    props = regions.region_properties(px)
    got = {r.cell_id: r.reason for r in regions.classify_skips(cells, props, props).collect()}
    assert got == {1: None, 2: "tiny", 3: "out_of_mask"}


def test_rescale_of_flat_and_empty_channels(spark):
    px = spark.createDataFrame(
        [("c", 1, 0, i, float(v)) for i, v in enumerate((0, 7, 7))] + [("c", 2, 0, i, 0.0) for i in range(2)] + [("c", 3, 0, i, float(i)) for i in range(11)],
        "basename string, channel int, y int, x int, value double")
    rows = {(r.channel, r.x): r for r in regions.nonzero_window_rescale(px, 0.0, 100.0).collect()}
    assert [rows[1, i].rescaled for i in range(3)] == [0, 255, 255] and rows[2, 1].rescaled == 0 and rows[2, 1].p_high == 0.0
    assert rows[3, 1].rescaled == 0 and rows[3, 10].rescaled == 255


def test_tile_grid_and_pyramid(spark):
    cores = spark.createDataFrame([("small", 10, 10), ("big", 100, 64)], "basename string, height int, width int")
    got = sorted((r.basename, r.y0, r.x0) for r in regions.tile_grid(cores, 64, 32).collect())
    assert got == [("big", 0, 0), ("big", 32, 0), ("small", 0, 0)]
    pts = spark.createDataFrame([("c", 1, 256, 10, 512, 512)], "basename string, cell_id long, x int, y int, height int, width int")
    rows = {(r.level, r.col, r.row) for r in regions.tile_pyramid(pts).collect()}
    assert {r for r in rows if r[0] == 9} == {(9, 0, 0), (9, 1, 0)} and min(r[0] for r in rows) == 0


def test_detail_and_polygon_join(spark):
    cells = spark.createDataFrame([("c", 0, 1.0, 2.0, 9.0), ("c", 5, 1.0, 2.0, 9.0)], "basename string, cell_id long, centroid_x double, centroid_y double, area_nucleus_px double")
    thr = Thresholds({n: 0.3 for n in P.names}, {n: 0.3 for n in P.phenotypes})
    polys = polygons(spark, [0])
    assert joins.cell_detail(cells, polys, thr, "m", "c", 0).first().area_nucleus_px == 2.0
    assert joins.cell_detail(cells, polys, thr, "m", "c", 5).first().area_nucleus_px == 9.0
    with pytest.raises(Exception, match="cell not found"):
        joins.cell_detail(cells, polys, thr, "m", "c", 77).collect()
    with pytest.raises(Exception, match="no cells with polygons"):
        joins.cells_with_polygons(cells, polys, "elsewhere").collect()
    open_ring = polys.withColumn("expanded_xy", F.slice("expanded_xy", 1, 3))
    assert joins.cells_with_polygons(cells, open_ring, "c").first().ring[-1] == [0.0, 0.0]


def test_mask_summary_reads_the_regions_once(spark):
    from cellframe.operators.regions import mask_summary

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("c", i, a) for i, a in enumerate([3, 9, 4, 4, 7])] + [("d", 1, None), ("d", 2, 5)]
    schema = "basename string, label long, area long"
    df = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    got = {r.basename: tuple(r)[1:] for r in mask_summary(df).collect()}
    assert got["c"][:3] == (5, 5.4, 4.0) and got["d"] == (1, 5.0, 5.0, 5.0, 5.0)
    assert seen.value == len(rows)


def test_image_sends_cells_and_no_pixels(spark):
    from catalog import load

    load()
    from catalog import table_queries

    plan = table_queries.image(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("== Initial Plan ==")[-1].splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert len(exchanges) == 1 and sum("Generate explode" in line for line in lines[:exchanges[0]]) == 2


def test_vertices_are_told_apart_in_linear_time(spark):
    from pyspark.sql import functions as F

    from cellframe.operators.spatial.polygons import cap_ring

    rings = {1: [[1.0, 1.0]], 2: [[1.0, 1.0], [2.0, 1.0], [1.0, 1.0]], 3: [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0]], 4: [[1.0, 1.0], [1.0, 1.0], [2.0, 1.0], [2.0, 1.0]]}
    df = spark.createDataFrame(list(rings.items()), "cell_id long, ring array<array<double>>")
    out = cap_ring(df, "ring", F.lit(100), F.lit(100))
    assert {r.cell_id: r.degenerate for r in out.collect()} == {1: True, 2: True, 3: False, 4: True}
    assert "array_distinct" not in out._jdf.queryExecution().analyzed().toString()


def test_ring_neither_broadcasts_nor_sends_a_mask(spark):
    from catalog import load

    load()
    from catalog import table_queries
    from cellframe.operators.regions import ring_compartment

    plan = table_queries.ring(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("== Initial Plan ==")[-1].splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
    # below every exchange the cells still lie in one row each
    assert "Broadcast" not in plan and len(exchanges) == 2 and not any("Window" in line for line in lines[exchanges[0]:])

    schema = "basename string, y long, x long, label long"
    expanded = [("c", 1, 1, 3), ("c", 1, 1, 4), ("c", 1, 2, 3), ("c", 2, 2, 0), ("d", 1, 1, 9), ("c", None, 5, 7), (None, 1, 1, 2)]
    nuclei = [("c", 1, 1, 3), ("c", 1, 1, 3), ("c", 1, 2, 0), ("c", None, 5, 7), (None, 1, 1, 2), ("d", 8, 8, 1)]
    want = sorted(map(str, [("c", 1, 2, 3), ("d", 1, 1, 9), ("c", None, 5, 7), (None, 1, 1, 2)]))
    masks = [spark.createDataFrame(rows, schema) for rows in (expanded, nuclei)]
    assert sorted(str(tuple(r)) for r in ring_compartment(*masks).collect()) == want
    tiled = [m.withColumn("t", F.coalesce(F.floor(F.col("y") / 2), F.lit(-1))) for m in masks]
    assert sorted(str(tuple(r)[:4]) for r in ring_compartment(*tiled, ["t"]).collect()) == want
