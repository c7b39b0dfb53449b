"""Queries for the row-wise rules, filters and table reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derived as D
from catalog.derived import CELLS, MANIFEST, MODEL, P, SCORED, THR, TYPED, cc, r6
from catalog.registry import add
from cellframe.operators import rules as R
from cellframe.panel import MarkerPanel, PhenotypeRule, ch, ph
from cellframe.session import scratch_folder
from cellframe.sources import listing, tables

PN = P.phenotypes


def calls(names):
    return [f"phenotype_{n}_call_{MODEL}" for n in names]


# ---- reads

def s1(spark, d):
    """Half of the cells written as CSV, half as Parquet, and both read back."""
    c = D.cells(spark, d).select("basename", "cell_id", "centroid_x", "centroid_y", *[f"{cc(c)}_true" for c in P.channels])
    folder = scratch_folder(spark, "cells")
    c.where("cell_id % 2 = 0").write.option("header", True).csv(f"{folder}/cells.csv")
    c.where("cell_id % 2 = 1").write.parquet(f"{folder}/cells.parquet")
    return tables.read_cells(spark, f"{folder}/cells.csv", P).unionByName(tables.read_cells(spark, f"{folder}/cells.parquet", P)).select(
        "basename", F.col("cell_id").cast("long").alias("cell_id"), *[F.col(x).cast("long").alias(x) for x in ("centroid_x", "centroid_y")],
        *[F.col(f"{cc(c)}_true").cast("double").alias(f"{cc(c)}_true") for c in P.channels])


add("s1_read_cells", s1, f"with {CELLS} select basename, cell_id, centroid_x, centroid_y, "
    + ", ".join(r6(f"{cc(c)}_true", f"{cc(c)}_true") for c in P.channels) + " from cells")
add("s2_read_projected",
    lambda s, d: tables.read_projected(s, f"{d}/events.parquet", ["event_id", "value"]),
    f"select event_id, {r6('value', 'value')} from events")


def pair_files(spark, d):
    m = D.manifest(spark, d)
    he = m.select(F.concat(F.lit("/pairs/"), "basename", F.lit("_HE.npy")).alias("path"))
    codex = m.filter("status in ('ok', 'cached')").select(
        F.concat(F.lit("/pairs/"), "basename", F.lit("_CODEX.npy")).alias("path"))
    return he.unionByName(codex)


add("s9_discover_pairs", lambda s, d: listing.discover_pairs(pair_files(s, d)),
    f"with {CELLS}, {MANIFEST} select basename from cores where status in ('ok','cached')")
add("s10_manifest_basenames", lambda s, d: tables.manifest_basenames(D.manifest(s, d), ["train", "val"]),
    f"with {CELLS}, {MANIFEST} select basename from cores where split in ('train','val')")


def core_files(spark, d):
    m = D.manifest(spark, d)
    return m.select(
        F.concat(F.lit("/focus/"), F.when(F.col("status") == "fail", F.lit("scan_")).otherwise(F.lit("")), "core",
                 F.lit(".tif")).alias("path")
    ).unionByName(m.select(F.concat(F.lit("/focus/"), "tma", F.lit(".tif")).alias("path"))).unionByName(
        m.select(F.concat(F.lit("/focus/C-x"), "k", F.lit(".tif")).alias("path")))


add("s11_discover_cores", lambda s, d: listing.discover_cores(core_files(s, d)).orderBy("row", "col"),
    f"""with {CELLS}, {MANIFEST} select concat(case when status='fail' then 'scan_' else '' end,
    split_part(core,'-',1)) as row, cast(split_part(core,'-',2) as bigint) as col from cores""")

# ---- calls and scores

add("p1_marker_calls",
    lambda s, d: R.marker_calls(D.cells(s, d), THR, MODEL, P).select("basename", "cell_id", *[ch(c, "call", MODEL) for c in P.channels]),
    f"with {SCORED} select basename, cell_id, " + ", ".join(f"cast({cc(c)}_call_{MODEL} as bigint) as {cc(c)}_call_{MODEL}" for c in P.channels) + " from scored")
add("p2_phenotype_calls",
    lambda s, d: D.scored(s, d).select("basename", "cell_id", *calls(PN)),
    f"with {SCORED} select basename, cell_id, " + ", ".join(f"cast({c} as bigint) as {c}" for c in calls(PN)) + " from scored")
add("p3_phenotype_labels",
    lambda s, d: R.phenotype_labels(D.cells(s, d), P).select("basename", "cell_id", *[ph(n, "label") for n in PN]),
    f"with {SCORED} select basename, cell_id, " + ", ".join(f"phenotype_{n}_label" for n in PN) + " from scored")
add("p4_phenotype_scores",
    lambda s, d: R.phenotype_scores(D.cells(s, d), MODEL, P).select("basename", "cell_id", *[ph(n, "score", MODEL) for n in PN]),
    f"with {SCORED} select basename, cell_id, " + ", ".join(r6(f"phenotype_{n}_score_{MODEL}", f"phenotype_{n}_score_{MODEL}") for n in PN) + " from scored")


def gaps(spark, d):
    """Cells some of whose predictions are unknown: null in every 17th cell, NaN in every 19th."""
    gap = lambda c: F.when(F.col("cell_id") % 17 == c % 17, F.lit(None)).when(F.col("cell_id") % 19 == c % 19, F.lit(float("nan"))).otherwise(F.col(ch(c, "pred", MODEL)))
    return D.cells(spark, d).withColumns({ch(c, "pred", MODEL): gap(c) for c in P.channels})


GAPS = CELLS + ", gaps as (select * replace (" + ", ".join(
    f"case when cell_id % 17 = {c % 17} or cell_id % 19 = {c % 19} then null else {cc(c)}_pred_{MODEL} end as {cc(c)}_pred_{MODEL}" for c in P.channels) + ") from cells)"
add("p4_scores_of_unknown",
    lambda s, d: R.phenotype_scores(gaps(s, d), MODEL, P).select("basename", "cell_id", *[ph(n, "score", MODEL) for n in PN]),
    f"with {GAPS} select basename, cell_id, " + ", ".join(
        r6(e, f"phenotype_{n}_score_{MODEL}") for n, e in D.score_sql({n: f"{cc(c)}_pred_{MODEL}" for n, c in P.pairs}).items()) + " from gaps")
add("p5_dominant_phenotype", lambda s, d: D.typed(s, d).select("basename", "cell_id", "dominant_phenotype"),
    f"with {TYPED} select basename, cell_id, dominant_phenotype from typed")
_code = "case " + " ".join(f"when {c}=1 then {i}" for i, c in enumerate(calls(PN))) + " else -1 end"
_name = "case " + " ".join(f"when {c}=1 then '{n}'" for n, c in zip(PN, calls(PN))) + " end"
add("p6_first_call_code",
    lambda s, d: R.first_call_code(D.scored(s, d), MODEL, P).select("basename", "cell_id", "phenotype_code", "phenotype_name"),
    f"with {SCORED} select basename, cell_id, cast({_code} as bigint) as phenotype_code, {_name} as phenotype_name from scored")
add("p7_color_value",
    lambda s, d: R.color_value(D.scored(s, d), "marker_error", "CD68", MODEL, "gmm", P).select("basename", "cell_id", "color_value"),
    f"with {SCORED} select basename, cell_id, {r6(f'ch27_pred_{MODEL} - cast(ch27_pos as int)', 'color_value')} from scored")
add("p7_color_phenotype",
    lambda s, d: R.color_value(D.scored(s, d), "phenotype", None, MODEL, "gmm", P).select("basename", "cell_id", "color_value"),
    f"with {SCORED} select basename, cell_id, cast({_code} as double) as color_value from scored")
add("p8_pred_prob",
    lambda s, d: R.pred_prob(D.cells(s, d), "panCK", MODEL, P).select("basename", "cell_id", "pred_prob"),
    f"with {CELLS} select basename, cell_id, {r6(f'ch52_pred_{MODEL}', 'pred_prob')} from cells")


def bare(spark, d):
    """The table as a first model wrote it: predictions without a model suffix."""
    c = D.cells(spark, d)
    return c.withColumnsRenamed({ch(k, "pred", MODEL): ch(k, "pred") for k in P.channels})


add("p9_resolve_pred_cols",
    lambda s, d: R.canonical_pred_cols(bare(s, d), "v1", P).select("cell_id", *[ch(c, "pred", "v1") for c in P.channels]),
    f"with {CELLS} select cell_id, " + ", ".join(r6(f"{cc(c)}_pred_{MODEL}", f"{cc(c)}_pred_v1") for c in P.channels) + " from cells")


def p10(spark, d):
    from cellframe.operators.joins import attach_consensus

    t = R.targets(attach_consensus(D.cells(spark, d), D.consensus(spark, d)), "consensus", P)
    def bits(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a * 2 + x.cast("long"))
    return t.select("basename", "cell_id", *[bits(c).alias(c) for c in ("marker_y", "ignore_mask", "phenotype_y", "marker_y_orig")])


def _bits(exprs):
    n = len(exprs)
    return "cast(" + "+".join(f"cast({e} as int)*{2 ** (n - 1 - i)}" for i, e in enumerate(exprs)) + " as bigint)"


_cons = {n: f"({D.total_sql(c)} >= 2)" for n, c in P.pairs}
_clabel = [
    _cons["CD45"], f"({_cons['CD45']} and {_cons['CD8']})", f"({_cons['CA9']} or {_cons['panCK']})",
    f"({_cons['CD68']} or {_cons['CD163']})", f"({_cons['CD68']} and {_cons['CD163']})",
    f"({_cons['FAP']} or {_cons['aSMA']})", _cons["Ki67"], _cons["PDL1"],
    f"({_cons['PDL1']} and ({_cons['CA9']} or {_cons['panCK']}))",
]
add("p10_targets", p10,
    f"with {CELLS} select basename, cell_id, {_bits(list(_cons.values()))} as marker_y, "
    + _bits([f"({D.total_sql(c)} in (1,2))" for c in P.channels]) + " as ignore_mask, "
    + _bits(_clabel) + " as phenotype_y, " + _bits([f"{cc(c)}_pos" for c in P.channels]) + " as marker_y_orig from cells")
add("p11_attach_tma_tissue",
    lambda s, d: R.attach_tma_tissue(D.cells(s, d).select("basename", "cell_id")),
    f"with {CELLS} select basename, cell_id, split_part(basename,'__',1) as tma, split_part(basename,'_',1) as tissue from cells")


def cores(spark, d):
    n = D.cells(spark, d).groupBy("basename").agg(F.count("*").alias("n_cells"))
    return D.manifest(spark, d).join(n, "basename")


CORES = f"{CELLS}, {MANIFEST}, sized as (select c.*, n.n_cells from cores c join (select basename, count(*) as n_cells from cells group by 1) n using (basename))"
add("p12_filter_cores",
    lambda s, d: R.filter_cores(cores(s, d), tissue="ccRCC", split="train", min_cells=10, max_rigid=30.0).select("basename", "n_cells"),
    f"with {CORES} select basename, n_cells from sized where tissue='ccRCC' and split='train' and n_cells>=10 and rigid_D_px<=30.0")
add("p13_filter_cohort",
    lambda s, d: R.filter_cohort(D.manifest(s, d), tissue="ccOC", tma="TMA2").select("basename", "tma"),
    f"with {CELLS}, {MANIFEST} select basename, tma from cores where tissue='ccOC' and (tma='TMA2' or tma like '%\\_TMA2' escape '\\')")
add("p14_filter_phenotypes",
    lambda s, d: R.filter_phenotypes(D.scored(s, d), "pdl1_positive, proliferating_ki67", MODEL, P).select("basename", "cell_id"),
    f"with {SCORED} select basename, cell_id from scored where phenotype_pdl1_positive_call_{MODEL}=1 or phenotype_proliferating_ki67_call_{MODEL}=1")
add("p15_filter_min_prob",
    lambda s, d: R.filter_min_prob(R.pred_prob(D.cells(s, d), "CD8", MODEL, P), 0.4).select("basename", "cell_id", "pred_prob"),
    f"with {CELLS} select basename, cell_id, {r6(f'ch07_pred_{MODEL}', 'pred_prob')} from cells where ch07_pred_{MODEL} >= 0.4")
add("p16_filter_border",
    lambda s, d: R.filter_border(D.cells(s, d), D.manifest(s, d), 64).select("basename", "cell_id"),
    f"with {CELLS} select basename, cell_id from cells where centroid_x>=32 and centroid_x+32<={D.SIDE} and centroid_y>=32 and centroid_y+32<={D.SIDE}")
_some = ["ccRCC_TMA1__A-1", "ccOC_TMA2__B-2", "ccRCC_TMA3__C-3"]
add("p17_restrict_cores",
    lambda s, d: R.restrict_cores(D.cells(s, d), _some).groupBy("basename").agg(F.count("*").alias("n")),
    f"with {CELLS} select basename, count(*) as n from cells where basename in ({', '.join(repr(x) for x in _some)}) group by 1")
add("p18_first_n_cores",
    lambda s, d: R.first_n_cores(D.cells(s, d), 7).groupBy("basename").agg(F.count("*").alias("n")),
    f"with {CELLS} select basename, count(*) as n from cells where basename in (select distinct basename from cells order by 1 limit 7) group by 1")
add("p19_hierarchy_gate",
    lambda s, d: R.hierarchy_gate(D.cells(s, d), panel=P).select("basename", "cell_id", "ch07_pos", "ch07_pos_orig"),
    f"with {CELLS} select basename, cell_id, (ch07_pos and ch03_pos) as ch07_pos, ch07_pos as ch07_pos_orig from cells")


def per_core_rates(spark, d):
    """A score per core and marker that stands in for an AP: the share of confident cells."""
    c = D.cells(spark, d)
    return c.groupBy("basename").agg(F.avg((F.col(ch(27, "pred", MODEL)) >= 0.25).cast("double")).alias("ap"))


add("p20_confidence_stratum", lambda s, d: R.confidence_stratum(per_core_rates(s, d)),
    f"""with {CELLS}, a as (select basename, avg(case when ch27_pred_{MODEL}>=0.25 then 1.0 else 0.0 end) as ap from cells group by 1)
    select basename, {r6('ap', 'ap')}, case when ap>=0.70 then 'strong' when ap>=0.55 then 'moderate' else 'weak' end as confidence from a""")


def p21(spark, d):
    df = R.first_call_code(D.scored(spark, d), MODEL, P)
    df = R.feature_stratum(df, "phenotype", None, THR, out="by_phenotype")
    return R.feature_stratum(df, "marker_pred", "CD68", THR, out="by_marker").select("basename", "cell_id", "by_phenotype", "by_marker")


_strat = "case " + " ".join(f"when {c}=1 then '{THR.stratum(n)}'" for n, c in zip(PN, calls(PN))) + " else 'unknown' end"
add("p21_feature_stratum", p21,
    f"with {SCORED} select basename, cell_id, {_strat} as by_phenotype, '{THR.stratum('CD68')}' as by_marker from scored")
STOPS = ((0.0, (68, 1, 84)), (0.25, (59, 82, 139)), (0.5, (33, 145, 140)), (0.75, (94, 201, 98)), (1.0, (253, 231, 37)))


def _stops_sql(v, i):
    out = str(STOPS[-1][1][i])
    for (t0, c0), (t1, c1) in reversed(list(zip(STOPS, STOPS[1:]))):
        out = f"case when {v} <= {t1} then {c0[i]}+({v}-{t0})/cast({t1 - t0} as double)*{c1[i] - c0[i]} else {out} end"
    return f"cast(floor({out} + 0.5) as bigint)"


add("p23_sample_stops",
    lambda s, d: R.sample_stops(D.cells(s, d), f"ch27_pred_{MODEL}", STOPS).select("basename", "cell_id", "rgb_r", "rgb_g", "rgb_b"),
    f"with {CELLS} select basename, cell_id, " + ", ".join(f"{_stops_sql(f'ch27_pred_{MODEL}', i)} as rgb_{n}" for i, n in enumerate("rgb")) + " from cells")
add("p24_melt_markers",
    lambda s, d: R.melt_markers(D.cells(s, d), {"value": "true", "prob": f"pred_{MODEL}"}, P),
    f"with {CELLS} " + " union all ".join(
        f"select basename, cell_id, '{n}' as marker, cast({c} as bigint) as channel, {r6(f'{cc(c)}_true', 'value')}, {r6(f'{cc(c)}_pred_{MODEL}', 'prob')} from cells" for n, c in P.pairs))
add("p25_to_log1p",
    lambda s, d: D.cells(s, d).select(
        "basename", "cell_id", R.to_log1p(F.col("ch03_true"), F.lit(1.0), F.lit(15.0), 2.0).alias("z")
    ).withColumn("back", R.from_log1p(F.col("z"), F.lit(1.0), F.lit(15.0))),
    f"""with {CELLS}, z as (select basename, cell_id, ln(1+greatest((ch03_true/2.0-1.0)/(15.0-1.0+1e-6), 0.0)) as z from cells)
    select basename, cell_id, {r6('z', 'z')}, {r6('(exp(z)-1)*14.0+1.0', 'back')} from z""")
add("p25_log1p_of_unknown",
    lambda s, d: gaps(s, d).select("basename", "cell_id", *[
        R.to_log1p(F.col(ch(c, "pred", MODEL)), F.lit(0.2), F.lit(0.9)).alias(f"z{c}") for c in P.channels]),
    f"with {GAPS} select basename, cell_id, " + ", ".join(
        r6(f"case when {cc(c)}_pred_{MODEL} is not null then ln(1+greatest(({cc(c)}_pred_{MODEL}-0.2)/(0.9-0.2+1e-6), 0.0)) end", f"z{c}") for c in P.channels) + " from gaps")
add("p26_to_float01",
    lambda s, d: R.to_float01(
        D.cells(s, d).select("basename", "cell_id", F.floor(F.col("ch03_true") * 100).alias("value")), "value", "uint16"
    ).select("basename", "cell_id", "value01"),
    f"""with {CELLS}, v as (select basename, cell_id, floor(ch03_true*100) as value from cells),
    q as (select basename, max(value) as mx, quantile_cont(value, 0.999) as p from v group by 1)
    select v.basename, cell_id, {r6('value/(case when mx>1.5 then p else 1.0 end)', 'value01')} from v join q using (basename)""")

# ---- user rules and panels


def x1(spark, d):
    mine = PhenotypeRule(
        "stromal_immune", lambda m: m["Vimentin"] & m["CD45"], lambda m: m["Vimentin"] * m["CD45"], "user rule")
    panel = MarkerPanel(P.pairs, (mine,), ())
    df = R.phenotype_scores(R.phenotype_labels(D.cells(spark, d), panel), MODEL, panel)
    return df.select("basename", "cell_id", ph("stromal_immune", "label"), ph("stromal_immune", "score", MODEL))


add("x1_phenotype_rule", x1,
    f"with {CELLS} select basename, cell_id, (ch17_pos and ch03_pos) as phenotype_stromal_immune_label, "
    + r6(f"ch17_pred_{MODEL}*ch03_pred_{MODEL}", f"phenotype_stromal_immune_score_{MODEL}") + " from cells")


def x2(spark, d):
    """A custom marker order with missing channels still gives the canonical phenotypes."""
    panel = MarkerPanel((("panCK", 52), ("CD45", 3), ("CD8", 7)), P.rules, P.hierarchy)
    return R.phenotype_labels(D.cells(spark, d), panel).select("basename", "cell_id", *[ph(n, "label") for n in PN])


add("x2_marker_panel", x2,
    f"""with {CELLS} select basename, cell_id, ch03_pos as phenotype_immune_cd45_label,
    (ch03_pos and ch07_pos) as phenotype_t_cell_cd45_cd8_label, ch52_pos as phenotype_tumor_ca9_or_panck_label,
    false as phenotype_macrophage_cd68_or_cd163_label, false as phenotype_m2_like_cd68_cd163_label,
    false as phenotype_caf_fap_or_asma_label, false as phenotype_proliferating_ki67_label,
    false as phenotype_pdl1_positive_label, false as phenotype_pdl1_tumor_like_label from cells""")
