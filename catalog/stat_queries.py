"""Queries for joins, composition statistics, labels, thresholds and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derived as D
from catalog.derived import CELLS, MANIFEST, MODEL, MODEL2, P, SCORED, TAUS, THR, cc, r6
from catalog.registry import add
from cellframe.operators import audit as A
from cellframe.operators import cluster as CL
from cellframe.operators import compose as C
from cellframe.operators import joins as J
from cellframe.operators import labels as L
from cellframe.operators import normalize as N
from cellframe.operators import registry as RG
from cellframe.operators import rules as R
from cellframe.panel import ch, ph
from cellframe.plans import bundle as PL
from cellframe.session import scratch_folder
from cellframe.sources import sinks, tables

PN = P.phenotypes
CALL = {n: f"phenotype_{n}_call_{MODEL}" for n in PN}

# ---- joins

add("j1_attach_consensus",
    lambda s, d: J.attach_consensus(D.cells(s, d), D.consensus(s, d)).select(
        "basename", "cell_id", *[ch(c, "pos_consensus") for c in P.channels]),
    f"with {CELLS} select basename, cell_id, " + ", ".join(f"{D.total_sql(c)} >= 2 as {cc(c)}_pos_consensus" for c in P.channels) + " from cells")


def merged(spark, d):
    return J.merge_model(D.scored(spark, d), D.model2(spark, d), MODEL2, THR, P)


_m2 = {n: (f"{cc(c)}_pred_{MODEL2}" if c in D.MODEL2_CHANNELS else "0.0") for n, c in P.pairs}
_s2 = D.score_sql(_m2)
MERGED = (
    f"{CELLS}, {D.MODEL2_SQL}, m2 as (select *, " + ", ".join(f"{e} as phenotype_{n}_score_{MODEL2}" for n, e in _s2.items())
    + " from preds2), merged as (select c.basename, c.cell_id, "
    + ", ".join(f"c.{cc(c)}_pos" for c in P.channels) + ", "
    + ", ".join(f"{e} as phenotype_{n}_label" for n, e in D.label_sql().items()) + ", "
    + ", ".join(f"m2.{cc(c)}_pred_{MODEL2}" for c in D.MODEL2_CHANNELS) + ", "
    + ", ".join(
        f"m2.phenotype_{n}_score_{MODEL2}, cast(cast(m2.phenotype_{n}_score_{MODEL2} as float) >= cast({THR.phenotype[n]} as float) as int) as phenotype_{n}_call_{MODEL2}"
        for n in PN)
    + " from cells c left join m2 using (basename, cell_id))"
)
add("j2_merge_model",
    lambda s, d: merged(s, d).select("basename", "cell_id", *[ch(c, "pred", MODEL2) for c in D.MODEL2_CHANNELS],
                                     *[ph(n, w, MODEL2) for n in PN for w in ("score", "call")]),
    f"with {MERGED} select basename, cell_id, " + ", ".join(r6(f"{cc(c)}_pred_{MODEL2}", f"{cc(c)}_pred_{MODEL2}") for c in D.MODEL2_CHANNELS)
    + ", " + ", ".join(f"{r6(f'phenotype_{n}_score_{MODEL2}', f'phenotype_{n}_score_{MODEL2}')}, cast(phenotype_{n}_call_{MODEL2} as bigint) as phenotype_{n}_call_{MODEL2}" for n in PN)
    + " from merged")


def j3(spark, d):
    cells = J.add_models(
        D.cells(spark, d).select("basename", "cell_id"),
        [("v1", D.cells(spark, d).withColumnsRenamed({ch(k, "pred", MODEL): ch(k, "pred", "v1") for k in P.channels})),
         (MODEL2, D.model2(spark, d))], THR, P)
    order = J.ordered_models(["v1", MODEL2, "v1"], MODEL2)
    rows = C.stack_columns(
        cells.agg(*[F.count(ph("pdl1_positive", "score", m)).alias(m) for m in order]), [],
        [{"position": F.lit(i), "model": F.lit(m), "covered": F.col(m)} for i, m in enumerate(order)])
    return rows


add("j3_add_models", j3,
    f"with {CELLS} select cast(0 as bigint) as position, '{MODEL2}' as model, sum(cast({D.MODEL2_COVER} as int))::bigint as covered from cells "
    "union all select 1, 'v1', count(*) from cells")


def summary(spark, d):
    return J.core_summary(
        D.manifest(spark, d).drop("k", "height", "width", "status"), C.core_composition(D.scored(spark, d), [MODEL], P), MODEL)


_comp = (
    "count(*) as n_cells, "
    + ", ".join(r6(f"avg(cast({cc(c)}_pos as int))", f"frac_ch{c:02d}_pos_truth") for c in P.channels) + ", "
    + ", ".join(r6(f"avg(cast(phenotype_{n}_label as int))", f"frac_phenotype_{n}_truth") for n in PN) + ", "
    + ", ".join(r6(f"avg({cc(c)}_call_{MODEL})", f"frac_ch{c:02d}_pos_{MODEL}") for c in P.channels) + ", "
    + ", ".join(r6(f"avg({cc(c)}_pred_{MODEL})", f"mean_ch{c:02d}_pred_{MODEL}") for c in P.channels) + ", "
    + ", ".join(r6(f"avg({CALL[n]})", f"frac_phenotype_{n}_call_{MODEL}") for n in PN)
)
COMP = f"{SCORED}, comp as (select basename, {_comp} from scored group by 1)"
add("d1_core_composition", lambda s, d: C.core_composition(D.scored(s, d), [MODEL], P), f"with {COMP} select * from comp")
add("j4_core_summary", summary,
    f"with {COMP}, {MANIFEST} select c.basename, c.tma, c.core, c.tissue, c.split, c.rigid_D_px, comp.* exclude(basename), "
    f"'{MODEL}' as model_id from cores c left join comp using (basename)")


def bundle(spark, d):
    from cellframe.plans.bundle import build_cell_tables

    cells = D.cells(spark, d)
    scores = R.phenotype_scores(R.phenotype_labels(cells, P), MODEL, P)
    return build_cell_tables(scores, D.consensus(spark, d), D.manifest(spark, d).drop("tissue", "tma"), THR, MODEL, "train", P)


_bundle_calls = [f"phenotype_{n}_call_{MODEL}" for n in P.phenotypes] + [f"{cc(c)}_call_{MODEL}" for c in P.channels]
add("j4_bundle_cells",
    lambda s, d: bundle(s, d).cells.select("basename", "cell_id", *[ch(c, "pos_consensus") for c in P.channels], *_bundle_calls),
    f"with {SCORED}, {MANIFEST} select s.basename, s.cell_id, " + ", ".join(f"{D.total_sql(c)} >= 2 as {cc(c)}_pos_consensus" for c in P.channels)
    + ", " + ", ".join(f"cast({c} as bigint) as {c}" for c in _bundle_calls) + " from scored s join cores using (basename) where split = 'train'")
add("j4_bundle_cores", lambda s, d: bundle(s, d).cores,
    f"with {COMP}, {MANIFEST} select c.basename, c.core, c.split, c.rigid_D_px, c.tma, c.tissue, c.k, c.height, c.width, c.status, comp.* exclude(basename), "
    f"'{MODEL}' as model_id from cores c left join comp using (basename) where c.split = 'train'")
POLY = f"{CELLS}, {D.POLYGONS}"
add("j5_cells_with_polygons",
    lambda s, d: J.cells_with_polygons(D.cells(s, d).select("basename", "cell_id", "ch27_true"), D.polygons(s, d)).select(
        "basename", "cell_id", "ch27_true", "area_expanded_px", F.size("ring").alias("n_ring")),
    f"with {POLY} select c.basename, c.cell_id, {r6('c.ch27_true', 'ch27_true')}, {r6('p.area_expanded_px', 'area_expanded_px')}, "
    "cast(5 as bigint) as n_ring from cells c join polys p using (basename, cell_id)")


def j6(spark, d):
    """The skip log of one tissue is lost, so that the check has something to find."""
    return J.polygon_coverage(D.cells(spark, d), D.polygons(spark, d), D.skips(spark, d).filter("basename like 'ccRCC%'"))


add("j6_polygon_coverage", j6,
    f"with {POLY} select basename, cell_id, 'missing_polygon' as problem from skips where basename not like 'ccRCC%'")
add("j13_cell_detail",
    lambda s, d: J.cell_detail(D.scored(s, d), D.polygons(s, d), THR, MODEL, panel=P).select(
        "basename", "cell_id", "x", "y", "area_nucleus_px", "area_expanded_px", "eccentricity",
        F.aggregate("markers", F.lit(0.0), lambda a, m: a + m["prob"]).alias("prob_sum"),
        F.size(F.filter("markers", lambda m: m["truth"])).alias("n_true"),
        F.size(F.filter("phenotypes", lambda m: m["call"])).alias("n_calls")),
    f"with {SCORED}, {D.POLYGONS} select c.basename, c.cell_id, cast(centroid_x as double) as x, cast(centroid_y as double) as y, "
    f"{r6('coalesce(p.a1, 0.0)', 'area_nucleus_px')}, {r6('coalesce(p.a2, 0.0)', 'area_expanded_px')}, 0.0e0 as eccentricity, "
    + r6("+".join(f"{cc(c)}_pred_{MODEL}" for c in P.channels), "prob_sum") + ", cast("
    + "+".join(f"cast({cc(c)}_pos as int)" for c in P.channels) + " as bigint) as n_true, cast(" + "+".join(CALL.values())
    + " as bigint) as n_calls from scored c left join (select basename, cell_id, area_nucleus_px a1, area_expanded_px a2 from polys) p using (basename, cell_id)")


# ---- scaled values, clusters and labels

STAND_IN = "cell_id % 5"


def scaled(spark, d):
    return N.zscore_by_core(D.cells(spark, d), P, space="raw")


def clustered(spark, d):
    """Scaled cells with a stand-in cluster id, which an oracle can share."""
    return scaled(spark, d).withColumn("cluster_id_spacec", F.expr(f"cast({STAND_IN} as int)"))


_z = {c: f"greatest(-5.0, least(5.0, (x{c}-m{c})/s{c}))" for c in P.channels}
SCALED = (
    f"{CELLS}, lx as (select *, " + ", ".join(f"ln(1+{cc(c)}_true) as x{c}" for c in P.channels) + " from cells), "
    "st as (select basename, " + ", ".join(f"avg(x{c}) as m{c}, stddev_pop(x{c}) as s{c}" for c in P.channels) + " from lx group by 1), "
    "scaled as (select lx.*, " + STAND_IN + " as cluster, " + ", ".join(f"{e} as z{c}" for c, e in _z.items()) + " from lx join st using (basename))"
)
add("w2_zscore_by_core",
    lambda s, d: scaled(s, d).select("basename", "cell_id", *[ch(c, "zscore_spacec") for c in P.channels]),
    f"with {SCALED} select basename, cell_id, " + ", ".join(r6(f"z{c}", f"{cc(c)}_zscore_spacec") for c in P.channels) + " from scaled")
CZ = (
    SCALED + ", cz as (" + " union all ".join(
        f"select basename, cluster, count(*) as n_cluster, '{n}' as marker, {c} as channel, avg(z{c}) as z from scaled group by 1,2" for n, c in P.pairs) + ")"
)
add("c2_cluster_zscore",
    lambda s, d: CL.cluster_zscore(clustered(s, d), panel=P).withColumnRenamed("cluster_id_spacec", "cluster"),
    f"with {CZ} select basename, cluster, n_cluster, marker, cast(channel as bigint) as channel, {r6('z', 'z')} from cz")
TAU = 0.05
add("c3_positive_clusters",
    lambda s, d: CL.positive_clusters(CL.cluster_zscore(clustered(s, d), panel=P), TAU).drop("channel"),
    f"with {CZ} select basename, marker, coalesce(string_agg(case when z > {TAU} then cast(cluster as varchar) end, ',' order by cluster), '') "
    f"as positive_cluster_ids, {r6('max(z)', 'max_z')} from cz group by 1,2")


def c4(spark, d):
    c = clustered(spark, d)
    return CL.broadcast_positivity(c, CL.cluster_zscore(c, panel=P), TAU, panel=P)


add("c4_broadcast_positivity",
    lambda s, d: c4(s, d).select("basename", "cell_id", *[ch(c, "pos_spacec") for c in P.channels]),
    f"with {CZ}, fl as (select basename, cluster, " + ", ".join(f"bool_or(channel={c} and z > {TAU}) as p{c}" for c in P.channels)
    + " from cz group by 1,2) select basename, cell_id, " + ", ".join(f"p{c} as {cc(c)}_pos_spacec" for c in P.channels)
    + " from scaled join fl using (basename, cluster)")


def j14(spark, d):
    """Labels of the train and validation cores only; the rest gets the sentinels."""
    labelled = c4(spark, d).join(D.manifest(spark, d).filter("split <> 'test'").select("basename"), "basename", "left_semi")
    result = labelled.select("basename", "cell_id", "cluster_id_spacec", *[ch(c, w) for c in P.channels for w in ("zscore_spacec", "pos_spacec")])
    return J.emit_labels(D.cells(spark, d).select("basename", "cell_id"), result, P).select(
        "basename", "cell_id", "cluster_id_spacec", "ch27_pos_spacec", "ch27_zscore_spacec")


add("j14_emit_labels", j14,
    f"with {CZ}, {MANIFEST}, fl as (select basename, cluster, bool_or(channel=27 and z > {TAU}) as p27 from cz group by 1,2) "
    f"select basename, cell_id, case when split='test' then -1 else cluster end as cluster_id_spacec, "
    f"case when split='test' then false else p27 end as ch27_pos_spacec, case when split='test' then null else {r6('z27')} end as ch27_zscore_spacec "
    "from scaled join fl using (basename, cluster) join cores using (basename)")
add("j15_split_overlap",
    lambda s, d: J.split_overlap(
        D.manifest(s, d).filter("split in ('train', 'val')"), D.manifest(s, d).filter("split in ('val', 'test')")),
    f"with {CELLS}, {MANIFEST} select basename from cores where split='val'")


# ---- composition

_dist = {**{n: f"sum(case when {CALL[n]}=1 then 1 else 0 end)" for n in PN},
         "no_call": "sum(case when " + " and ".join(f"{c}=0" for c in CALL.values()) + " then 1 else 0 end)"}


def dist_sql(by="", where=""):
    keys = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    return " union all ".join(
        f"select {keys}cast({i} as bigint) as position, '{n}' as name, cast(coalesce({e},0) as bigint) as count, "
        + r6(f"coalesce({e},0)/cast(greatest(count(*),1) as double)", "fraction") + f" from scored {where}{group}"
        for i, (n, e) in enumerate(_dist.items()))


add("d2_phenotype_distribution", lambda s, d: C.phenotype_distribution(D.scored(s, d), MODEL, panel=P), f"with {SCORED} {dist_sql()}")
add("d2_phenotype_distribution_by_core",
    lambda s, d: C.phenotype_distribution(D.scored(s, d), MODEL, ["basename"], P), f"with {SCORED} {dist_sql('basename')}")


def pos_sql(by="", where="", src="scored"):
    keys = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    out = []
    for i, (n, c) in enumerate(P.pairs):
        e = f"sum(case when {cc(c)}_pred_{MODEL} > {THR.marker[n]} then 1 else 0 end)"
        out.append(f"select {keys}cast({i} as bigint) as position, '{n}' as name, cast(coalesce({e},0) as bigint) as n_positive, "
                   + r6(f"coalesce({e},0)/cast(greatest(count(*),1) as double)", "fraction_positive")
                   + f", '{THR.stratum(n)}' as confidence_stratum from {src} {where}{group}")
    return " union all ".join(out)


add("d3_marker_positivity", lambda s, d: C.marker_positivity(D.cells(s, d), THR, MODEL, ["basename"], P),
    f"with {CELLS} {pos_sql('basename', src='cells')}")
_coh = "where basename in (select basename from cores where tissue='ccRCC' and split='train')"
add("d5_cohort_stats",
    lambda s, d: C.cohort_stats(D.scored(s, d), D.manifest(s, d), THR, MODEL, tissue="ccRCC", split="train", panel=P),
    f"with {SCORED}, {MANIFEST} select 'phenotype' as kind, position, name, count, fraction, null as confidence_stratum from ({dist_sql('', _coh)}) "
    f"union all select 'marker', position, name, n_positive, fraction_positive, confidence_stratum from ({pos_sql('', _coh)})")
_h = CALL["tumor_ca9_or_panck"]
add("d6_core_fraction_histogram",
    lambda s, d: C.core_fraction_histogram(D.scored(s, d), "tumor_ca9_or_panck", MODEL),
    f"""with {SCORED}, f as (select basename, avg({_h}) as f from scored group by 1),
    b as (select least(cast(floor(f*10) as bigint), 9) as bin, count(*) as n from f group by 1)
    select r.range as bin, r.range/10.0e0 as lower, coalesce(n, 0) as n_cores from range(10) r left join b on b.bin=r.range""")
add("d7_cores_with_truth", lambda s, d: C.cores_with_truth(summary(s, d), P),
    f"with {CELLS} select count(distinct basename) as n_cores_with_truth from cells")
add("d10_dominant_class",
    lambda s, d: C.dominant_class(C.phenotype_distribution(D.scored(s, d), MODEL, ["basename"], P), ["basename"]),
    f"""with {SCORED}, dist as ({dist_sql('basename')}) select basename, name, count from (select *, row_number() over
    (partition by basename order by count desc, position) rn from dist where name <> 'no_call') where rn=1""")
add("d10_distribution_order",
    lambda s, d: C.distribution_order(C.phenotype_distribution(D.scored(s, d), MODEL, panel=P)).select("name", "rank"),
    f"""with {SCORED}, dist as ({dist_sql()}) select name, row_number() over (order by case when name='no_call' then 1 else 0 end, count desc, position) as rank from dist""")
_sumrows = [("marker", i, n, f"frac_ch{c:02d}_pos_{MODEL}", f"frac_ch{c:02d}_pos_truth", THR.marker[n]) for i, (n, c) in enumerate(P.pairs)]
_sumrows += [("phenotype", i, n, f"frac_phenotype_{n}_call_{MODEL}", f"frac_phenotype_{n}_truth", THR.phenotype[n]) for i, n in enumerate(PN)]
SUMROWS = " union all ".join(
    f"select basename, '{k}' as kind, cast({i} as bigint) as position, '{n}' as name, {a} as frac_pred, {b} as frac_truth, "
    f"cast({t} as double) as threshold, '{THR.stratum(n)}' as confidence from comp" for k, i, n, a, b, t in _sumrows)
add("d11_core_phenotype_summary", lambda s, d: C.core_phenotype_summary(summary(s, d), None, THR, MODEL, P), f"with {COMP} {SUMROWS}")
add("d12_info", lambda s, d: C.info(D.manifest(s, d)),
    f"with {CELLS}, {MANIFEST} " + " union all ".join(f"select '{c}' as attribute, {c} as value, count(*) as n_cores from cores group by 2" for c in ("tma", "tissue", "split")))
add("d19_positive_counts", lambda s, d: C.positive_counts(D.cells(s, d), P),
    f"with {CELLS} " + " union all ".join(f"select cast({c} as bigint) as channel, '{n}' as marker, cast(sum(cast({cc(c)}_pos as int)) as bigint) as n_positive from cells" for n, c in P.pairs))


def consensus_cells(spark, d):
    return L.consensus_labels(D.cells(spark, d), TAUS, 2, P)


add("o6_consensus_labels",
    lambda s, d: consensus_cells(s, d).select("basename", "cell_id", *[
        ch(c, w) for c in P.channels for w in ("pos", "pos_gmm_orig", "pos_gmm", "pos_otsu", "pos_quantile", "pos_consensus", "pos_disagree")]),
    f"with {CELLS} select basename, cell_id, " + ", ".join(
        f"{D.total_sql(c)} >= 2 as {cc(c)}_pos, {cc(c)}_pos as {cc(c)}_pos_gmm_orig, {v['gmm']} as {cc(c)}_pos_gmm, {v['otsu']} as {cc(c)}_pos_otsu, "
        f"{v['quantile']} as {cc(c)}_pos_quantile, {D.total_sql(c)} >= 2 as {cc(c)}_pos_consensus, {D.total_sql(c)} in (1,2) as {cc(c)}_pos_disagree"
        for c in P.channels for v in [D.votes_sql(c)]) + " from cells")
add("d26_label_change", lambda s, d: C.label_change(consensus_cells(s, d), P, by=["basename"]),
    f"with {CELLS} " + " union all ".join(
        f"select basename, cast({c} as bigint) as channel, '{n}' as name, count(*) as n_cells, {r6(f'avg(cast({cc(c)}_pos as int))', 'frac_pos_gmm')}, "
        f"{r6(f'avg(cast({D.total_sql(c)}>=2 as int))', 'frac_pos_consensus')}, {r6(f'avg(cast({D.total_sql(c)} in (1,2) as int))', 'frac_disagree_among_methods')}, "
        f"{r6(f'avg(cast({cc(c)}_pos <> ({D.total_sql(c)}>=2) as int))', 'frac_changed_label')} from cells group by 1" for n, c in P.pairs))
add("o7_ensure_labels",
    lambda s, d: L.ensure_labels(D.cells(s, d).drop("ch03_pos"), {c: 9.5 for c in P.channels}, P).select("basename", "cell_id", "ch03_pos", "ch07_pos"),
    f"with {CELLS} select basename, cell_id, ch03_true > 9.5 as ch03_pos, ch07_pos from cells")
_v = D.votes_sql(3)
add("o8_disagreement_strata",
    lambda s, d: L.disagreement_strata(D.cells(s, d), "CD45", TAUS[3], P).groupBy("basename", "stratum").agg(F.count("*").alias("n")),
    f"""with {CELLS}, t as (select basename, case when {D.total_sql(3)}=3 then 'all_three_pos' when {D.total_sql(3)}=0 then 'all_three_neg'
    when {D.total_sql(3)}=2 then 'split_decision_2of3_pos' when {_v['gmm']} then 'gmm_only_pos' when {_v['otsu']} then 'otsu_only_pos'
    else 'quantile_only_pos' end as stratum from cells) select basename, stratum, count(*) as n from t group by 1,2""")


def splits(spark, d, *names):
    m = D.manifest(spark, d).filter(F.col("split").isin(*names)).select("basename")
    return D.cells(spark, d).join(m, "basename", "left_semi")


def _split_sql(name):
    return f"cells where basename in (select basename from cores where split='{name}')"


add("d27_threshold_diagnostics",
    lambda s, d: L.threshold_diagnostics(splits(s, d, "train"), splits(s, d, "val"), TAUS, P),
    f"with {CELLS}, {MANIFEST}, tr as (select * from {_split_sql('train')}), va as (select * from {_split_sql('val')}) " + " union all ".join(
        f"select cast({c} as bigint) as channel, '{n}' as name, "
        f"(select count(*) from tr) as train_cells, (select count(*) from va) as val_cells, "
        + ", ".join(f"(select {r6(f'avg(cast({cc(c)}_true > {TAUS[c][m]} as int))')} from {t}) as {p}_pos_{m}"
                    for t, p in (("tr", "train"), ("va", "val")) for m in ("gmm", "otsu", "quantile"))
        for n, c in P.pairs))


def _agree(c, n):
    out = []
    for i, (a, b) in enumerate(L.AGREEMENT_PAIRS):
        x, y = f"({cc(c)}_true > {TAUS[c][a]})", f"({cc(c)}_true > {TAUS[c][b]})"
        out.append(f"select cast({c} as bigint) as channel, '{n}' as name, cast({i} as bigint) as pair, '{a}' as method_a, '{b}' as method_b, "
                   f"cast(count(*) as double) as n, cast(sum(cast({x} and {y} as int)) as double) as bo, cast(sum(cast({x} as int)) as double) as na, "
                   f"cast(sum(cast({y} as int)) as double) as nb from cells")
    return " union all ".join(out)


AGREE = (
    f"{CELLS}, ag as (" + " union all ".join(_agree(c, n) for n, c in P.pairs) + "), "
    "ag2 as (select *, na+nb-2*bo as df, 1-(na+nb-2*bo)/n as po, (na*nb+(n-na)*(n-nb))/(n*n) as pe, "
    "greatest(least((na+nb)/(2*n),0.999),0.001) as p, greatest(least((na+nb-2*bo)/n/2,0.499),0.0) as e from ag), "
    "ag3 as (select *, p*(1-e)/(p*(1-e)+(1-p)*e) as pr, 1-e as rc from ag2)"
)
add("o9_threshold_agreement", lambda s, d: L.threshold_agreement(D.cells(s, d), TAUS, P),
    f"with {AGREE} select channel, name, pair, method_a, method_b, {r6('bo/nullif(na+nb-bo,0)', 'jaccard')}, "
    f"{r6('(po-pe)/nullif(1-pe,0)', 'cohen_kappa')}, {r6('df/n', 'disagree_rate')}, {r6('2*pr*rc/greatest(pr+rc,1e-9)', 'f1_ceiling')} from ag3")
add("o10_kappa_pivot", lambda s, d: L.kappa_pivot(L.threshold_agreement(D.cells(s, d), TAUS, P)),
    f"with {AGREE} select name, " + ", ".join(
        r6(f"max(case when method_a='{a}' and method_b='{b}' then (po-pe)/nullif(1-pe,0) end)", f"{a}_vs_{b}") for a, b in L.AGREEMENT_PAIRS)
    + " from ag3 group by 1")
add("d28_split_counts",
    lambda s, d: C.split_counts(D.scored(s, d).join(D.manifest(s, d).select("basename", "split"), "basename"), P),
    f"with {SCORED}, {MANIFEST}, sp as (select scored.*, split from scored join cores using (basename)) " + " union all ".join(
        [f"select split, count(*) as n_rows, count(distinct basename) as n_cores, 'marker' as kind, cast({i} as bigint) as position, '{n}' as name, "
         f"cast(sum(cast({cc(c)}_pos as int)) as bigint) as positives from sp group by 1" for i, (n, c) in enumerate(P.pairs)]
        + [f"select split, count(*), count(distinct basename), 'phenotype', {i}, '{n}', cast(sum(cast(phenotype_{n}_label as int)) as bigint) from sp group by 1" for i, n in enumerate(PN)]))
add("d34_composition_with_other",
    lambda s, d: C.composition_with_other(C.phenotype_distribution(D.scored(s, d), MODEL, ["basename"], P), ["basename"], minimum=0.2),
    f"""with {SCORED}, tot as (select basename, count(*) as t from scored group by 1), dist as ({dist_sql('basename')}),
    f as (select basename, name, count/cast(t as double) as f from dist join tot using (basename))
    select basename, case when f < 0.2 then 'other' else name end as name, {r6('sum(f)', 'fraction')} from f group by 1,2""")
add("d35_score_histogram", lambda s, d: C.score_histogram(D.cells(s, d), MODEL, 40, P),
    f"with {CELLS}, l as (" + " union all ".join(f"select '{n}' as marker, {cc(c)}_pos as truth, {cc(c)}_pred_{MODEL} as s from cells" for n, c in P.pairs)
    + "), b as (select marker, truth, least(cast(floor(s*40) as bigint), 39) as bin, count(*) as n from l where s between 0 and 1 group by 1,2,3) "
    + f"select marker, truth, bin, n, {r6('n*40.0/sum(n) over (partition by marker, truth)', 'density')} from b")
_cls = [("marker", i, n, f"{cc(c)}_pos") for i, (n, c) in enumerate(P.pairs)] + [("phenotype", i, n, f"phenotype_{n}_label") for i, n in enumerate(PN)]
add("d37_class_alpha", lambda s, d: C.class_alpha(D.scored(s, d), P),
    f"with {SCORED} " + " union all ".join(
        f"select '{k}' as kind, cast({i} as bigint) as position, '{n}' as name, {r6(f'(sum(case when {c} then 0 else 1 end)+1.0)/(count(*)+2.0)', 'alpha')} from scored" for k, i, n, c in _cls))

# ---- manifests

MAN = f"{CELLS}, {MANIFEST}"
add("d29_manifest_status", lambda s, d: RG.manifest_status(D.manifest(s, d)),
    f"with {MAN} select tma, " + ", ".join(f"sum(case when status='{x}' then 1 else 0 end)::bigint as {x}" for x in RG.STATUSES) + " from cores group by 1")
add("d30_residual_stats", lambda s, d: RG.residual_stats(D.manifest(s, d)),
    f"with {MAN} select count(*) as n, {r6('avg(rigid_D_px)', 'mean')}, {r6('quantile_cont(rigid_D_px,0.5)', 'median')}, "
    f"{r6('quantile_cont(rigid_D_px,0.95)', 'p95')}, {r6('max(rigid_D_px)', 'max')} from cores where status in ('ok','cached')")


def meta(spark, d):
    return D.manifest(spark, d).selectExpr(
        "tma", "core", "k % 4 <> 1 as has_arrays", "case when k % 5 = 0 then null else cast((k*11)%45 + 0.25 as double) end as residual")


_res = "(case when k % 5 = 0 then null else cast((k*11)%45 + 0.25 as double) end)"
_dec = f"((k % 4 <> 1) and {_res} is not null)"
add("d31_repair_manifest",
    lambda s, d: RG.repair_manifest(D.manifest(s, d), meta(s, d), 30.0).select("tma", "core", "status", "rigid_D_px", "error"),
    f"""with {MAN} select tma, core, case when {_dec} and {_res} > 30 then 'bad_alignment' when {_dec} and status not in ('ok','cached') then 'cached' else status end as status,
    coalesce({_res}, rigid_D_px) as rigid_D_px, case when {_dec} and {_res} > 30 then concat('rigid_D=', printf('%.1f', {_res}), 'px > 30.0')
    when {_dec} and status not in ('ok','cached') then '' end as error from cores""")
add("d32_retry_list", lambda s, d: RG.retry_list(D.manifest(s, d), 30.0).select("tma", "core", "status"),
    f"with {MAN} select tma, core, status from cores where status in ('bad_alignment','fail','empty_he','empty_codex') or rigid_D_px > 30")
add("d32_purge_list", lambda s, d: RG.purge_list(D.manifest(s, d)).select("tma", "core", "status"),
    f"with {MAN} select tma, core, status from cores where status not in ('ok','cached')")

# ---- thresholds

_vw = "l as (" + " union all ".join(f"select basename, cell_id, {c} as channel, '{n}' as marker, ln(1+{cc(c)}_true) as v from cells" for n, c in P.pairs) + ")"


def otsu_sql(src, by, value="v", name="cuts"):
    """CTE ``name`` with the Otsu cut of every group of ``by``."""
    k = ", ".join(by)
    part = f"partition by {k}"
    return (
        f"sp_ as (select {k}, min({value}) lo, max({value}) hi, count(*) n from {src} group by {k}), "
        f"hi_ as (select {k}, n, lo, hi, least(coalesce(cast(floor(({value}-lo)*256.0/nullif(hi-lo,0)) as bigint),0),255) as bin, cast(count(*) as double) as c "
        f"from {src} join sp_ using ({k}) group by {k}, n, lo, hi, bin), "
        f"hx_ as (select *, lo + (hi-lo)/256.0*(bin+0.5) as x from hi_), "
        f"hw_ as (select *, sum(c) over ({part} order by bin) w1, sum(c*x) over ({part} order by bin) s1, sum(c) over ({part}) w, sum(c*x) over ({part}) s from hx_), "
        f"hv_ as (select *, case when w-w1>0 then round(w1*(w-w1)*power(s1/w1-(s-s1)/(w-w1),2),4) end as var from hw_), "
        f"hr_ as (select *, row_number() over ({part} order by var desc nulls last, bin) rn from hv_), "
        f"{name} as (select {k}, n, case when hi>lo then x end as otsu from hr_ where rn=1)"
    )


def long_log(spark, d):
    return L.melt_values(D.cells(spark, d), P, ["basename"]).withColumn("v", F.log1p("v")).withColumnRenamed("name", "marker")


add("o1_otsu_cuts", lambda s, d: L.otsu_cuts(long_log(s, d), ["basename", "marker"], "v"),
    f"with {CELLS}, {_vw}, {otsu_sql('l', ['basename', 'marker'])} select basename, marker, n, {r6('otsu', 'otsu')} from cuts")
add("o1_otsu",
    lambda s, d: L.otsu(D.cells(s, d).select("basename", "cell_id", "ch27_true"), "ch27_true").select("basename", "cell_id", "otsu", "otsu_pos"),
    f"with {CELLS}, {otsu_sql('cells', ['basename'], 'ch27_true')} select basename, cell_id, {r6('otsu', 'otsu')}, ch27_true > otsu as otsu_pos from cells join cuts using (basename)")
_raw = "l as (" + " union all ".join(f"select {c} as channel, {cc(c)}_true as v from tr" for c in P.channels) + ")"
_tr = f"{CELLS}, {MANIFEST}, tr as (select * from {_split_sql('train')}), {_raw}"
add("o2_otsu_train", lambda s, d: L.otsu_train(splits(s, d, "train"), P).withColumn("tau_otsu", F.round("tau_otsu", 4)),
    f"with {_tr}, {otsu_sql('l', ['channel'])} select cast(channel as bigint) as channel, n, round(otsu, 4) as tau_otsu from cuts")
RATES = {c: 0.05 + 0.07 * i for i, c in enumerate(P.channels)}
add("o4_quantile_match", lambda s, d: L.quantile_match(splits(s, d, "train"), RATES, P),
    f"with {_tr} " + " union all ".join(
        f"select cast({c} as bigint) as channel, count(*) as n, {r6(f'quantile_cont(v, {min(max(1.0 - r, 0.01), 0.999)!r})', 'tau_quantile')} from l where channel={c}" for c, r in RATES.items()))


def _mixture_sql(values="l"):
    """The split and the mixtures' rounds as recursive tables over all values, then the last change of the denser component on the grid."""
    log = lambda i: f"ln(w{i}) - 0.5*ln(2*pi()*v{i}) - (x-m{i})*(x-m{i})/(2*v{i})"
    sd = lambda i: f"greatest(sqrt(v{i}), 1e-3)"
    moments = ", ".join(
        f"sum(r{k})/(sum(r1)+sum(r2)) as s{k}, m{k}+sum(r{k}*(x-m{k}))/sum(r{k}) as a{k}, "
        f"sum(r{k}*(x-m{k})*(x-m{k}))/sum(r{k})-power(sum(r{k}*(x-m{k}))/sum(r{k}), 2)+{L.ADDED_VARIANCE} as b{k}" for k in (1, 2))
    return (
        f"mv as materialized (select channel, cast(v as double) as x from {values}), "
        "ms as (select channel, avg(x) as a, stddev_pop(x) as sd from mv group by 1), "
        "km as (select 0 as i, channel, a-sd as m1, a+sd as m2, sd, sd > 0 as go from ms union all "
        f"select i+1, channel, n1, n2, sd, (n1-m1)*(n1-m1)+(n2-m2)*(n2-m2) > {L.SPLIT_TOLERANCE}*sd*sd from ("
        "select i, channel, m1, m2, sd, coalesce(avg(x) filter (not x-m1 > m2-x), m1) as n1, coalesce(avg(x) filter (x-m1 > m2-x), m2) as n2 "
        f"from km join mv using (channel) where go and i < {L.SPLIT_ROUNDS} group by i, channel, m1, m2, sd) z), "
        "kf as (select channel, arg_max(m1, i) as m1, arg_max(m2, i) as m2 from km group by 1), "
        f"k0 as (select channel, {moments} from (select *, cast(not x-m1 > m2-x as int) as r1, cast(x-m1 > m2-x as int) as r2 "
        "from kf join mv using (channel)) y group by channel, m1, m2), "
        "em as (select 0 as i, channel, s1 as w1, s2 as w2, a1 as m1, a2 as m2, b1 as v1, b2 as v2, cast('-inf' as double) as fit, true as go from k0 union all "
        f"select i+1, channel, s1, s2, a1, a2, b1, b2, f, not abs(f-fit) < {L.MIXTURE_TOLERANCE} from (select i, channel, fit, {moments}, avg(ll) as f from ("
        "select *, exp(l1-ll) as r1, exp(l2-ll) as r2 from (select *, greatest(l1, l2)+ln(exp(l1-greatest(l1, l2))+exp(l2-greatest(l1, l2))) as ll "
        f"from (select *, {log(1)} as l1, {log(2)} as l2 from em join mv using (channel) where go and i < {L.MIXTURE_ROUNDS}) x) y) z group by i, channel, fit, m1, m2) q), "
        "fm as (select channel, unnest(arg_max(struct_pack(w1, w2, m1, m2, v1, v2), i)) from em group by 1), "
        f"gr as (select *, unnest(range(0, {L.GRID})) as k from fm), "
        f"gd as (select channel, k, m1+(m2-m1)*k/{L.GRID - 1}.0 as g, sign(w2/{sd(2)}*exp(-0.5*power((m1+(m2-m1)*k/{L.GRID - 1}.0-m2)/{sd(2)}, 2)) - w1/{sd(1)}*exp(-0.5*power((m1+(m2-m1)*k/{L.GRID - 1}.0-m1)/{sd(1)}, 2))) as s from gr), "
        "gl as (select *, lead(s) over (partition by channel order by k) as nx from gd)"
    )


def _cuts(spark, cells):
    cuts = L.gmm_intersection(cells, P)
    return spark.createDataFrame([(int(c), float(v)) for c, v in cuts.items()], "channel int, tau_gmm double")


SATURATED = 65535.0
add("o3_gmm_intersection", lambda s, d: _cuts(s, splits(s, d, "train")),
    f"with recursive {_tr.strip()}, {_mixture_sql()} select cast(channel as bigint) as channel, {r6('max(g)', 'tau_gmm')} from gl where nx is not null and nx <> s group by 1")
# one cell of the whole cohort is saturated in every channel
add("o3_saturated_value",
    lambda s, d: _cuts(s, D.cells(s, d).withColumns({ch(c, "true"): F.when(F.col("cell_id") == 77, SATURATED).otherwise(F.col(ch(c, "true"))) for c in P.channels})),
    f"with recursive {CELLS}, sl as (" + " union all ".join(f"select {c} as channel, case when cell_id = 77 then {SATURATED} else {cc(c)}_true end as v from cells" for c in P.channels)
    + f"), {_mixture_sql('sl')} select cast(channel as bigint) as channel, {r6('max(g)', 'tau_gmm')} from gl where nx is not null and nx <> s group by 1")
add("o5_fit_mixtures",
    lambda s, d: L.fit_thresholds(splits(s, d, "train"), P).select("channel", "tau_gmm", "target_pos", "train_pos_gmm", F.round("tau_otsu", 4).alias("tau_otsu")),
    f"with recursive {_tr.strip()}, {_mixture_sql()}, ct as (select channel, max(g) as tau from gl where nx is not null and nx <> s group by 1), {otsu_sql('l', ['channel'])} "
    f"select cast(channel as bigint) as channel, {r6('tau', 'tau_gmm')}, {r6('avg(cast(v > tau as int))', 'target_pos')}, {r6('avg(cast(v > tau as int))', 'train_pos_gmm')}, round(any_value(otsu), 4) as tau_otsu "
    "from l join ct using (channel) join cuts using (channel) group by channel, tau")
add("o5_fit_thresholds",
    lambda s, d: L.fit_thresholds(splits(s, d, "train"), P, {c: (9.0, 0.25) for c in P.channels}).withColumn(
        "tau_otsu", F.round("tau_otsu", 4)),
    f"with {_tr}, {otsu_sql('l', ['channel'])}, q as (select channel, quantile_cont(v, 0.75) as q from l group by 1), "
    "tt as (select channel, otsu, q from cuts join q using (channel)) "
    f"select cast(channel as bigint) as channel, round(otsu, 4) as tau_otsu, {r6('q', 'tau_quantile')}, 9.0e0 as tau_gmm, 0.25e0 as target_pos, "
    f"{r6('avg(cast(v > 9.0 as int))', 'train_pos_gmm')}, {r6('avg(cast(v > otsu as int))', 'train_pos_otsu')}, {r6('avg(cast(v > q as int))', 'train_pos_quantile')} "
    "from l join tt using (channel) group by channel, otsu, q")

# ---- audit

COHORT = {c: {"gmm": 2.3, "otsu": 2.2, "quantile": 2.4} for c in P.channels}


def audit(spark, d):
    cells = clustered(spark, d).join(
        D.consensus(spark, d).select("basename", "cell_id", *[ch(c, "pos_consensus") for c in P.channels if c != 52]), ["basename", "cell_id"])
    return A.audit_markers(cells, COHORT, "cluster_id_spacec", panel=P, tau=TAU)


_cons_case = "case channel " + " ".join(f"when {c} then cast({D.total_sql(c)} >= 2 as int)" for c in P.channels if c != 52) + " else 0 end"
AUDIT = (
    f"{CZ}, {_vw}, {otsu_sql('l', ['basename', 'marker'])}, "
    f"cn as (" + " union all ".join(
        f"select basename, cell_id, {c} as channel, " + (f"cast({D.total_sql(c)} >= 2 as int)" if c != 52 else "0") + " as cons from cells" for c in P.channels) + "), "
    "ac as (select basename, marker, channel, otsu, count(*) as n_cells, sum(cons) as k0, sum(cast(v > otsu as int)) as k1 from l join cuts using (basename, marker) "
    "join cn using (basename, cell_id, channel) group by 1,2,3,4), "
    f"az as (select basename, marker, max(z) as mz, sum(case when z > {TAU} then n_cluster else 0 end) as k2 from cz group by 1,2), "
    "af as (select *, k0/cast(n_cells as double) f0, k1/cast(n_cells as double) f1, k2/cast(n_cells as double) f2 from ac join az using (basename, marker)), "
    "audit as (select basename, marker, channel, n_cells, k0 as n_pos_consensus, k1 as n_pos_per_core_otsu, k2 as n_pos_leiden_zscore, f0 as frac_consensus, "
    "f1 as frac_per_core_otsu, f2 as frac_leiden, otsu as per_core_otsu_threshold_log1p, 2.3e0 as cohort_gmm_threshold_log1p, 2.2e0 as cohort_otsu_threshold_log1p, "
    "2.4e0 as cohort_quantile_threshold_log1p, mz as max_leiden_cluster_zscore, abs(f1-f0)+abs(f2-f0) as disagreement_score, "
    "(k0=0 and (f1>0.05 or f2>0.05)) as suspicious_zero_consensus from af)"
)
_acols = ("basename, marker, cast(channel as bigint) as channel, n_cells, cast(n_pos_consensus as bigint) as n_pos_consensus, "
          "cast(n_pos_per_core_otsu as bigint) as n_pos_per_core_otsu, cast(n_pos_leiden_zscore as bigint) as n_pos_leiden_zscore, "
          + ", ".join(r6(c, c) for c in ("frac_consensus", "frac_per_core_otsu", "frac_leiden", "per_core_otsu_threshold_log1p",
                                         "cohort_gmm_threshold_log1p", "cohort_otsu_threshold_log1p", "cohort_quantile_threshold_log1p",
                                         "max_leiden_cluster_zscore", "disagreement_score")) + ", suspicious_zero_consensus")
add("d20_audit_markers", lambda s, d: audit(s, d).drop("positive_cluster_ids"), f"with {AUDIT} select {_acols} from audit")


def k4(spark, d):
    """The audit written as CSV and read back by the types of its rows."""
    rows = audit(spark, d)
    path = f"{scratch_folder(spark, 'audit')}/audit.csv"
    sinks.write_audit_csv(rows, path, P)
    return spark.read.option("header", True).schema(sinks.audit_csv_rows(rows, P).schema).csv(path)


add("k4_audit_csv_rows", k4, f"with {AUDIT} select {_acols} from audit")
_lm = "al as (" + " union all ".join(f"select marker, '{m}' as measure, {m} as value from audit" for m in A.MEASURES) + ")"
add("d21_audit_summary", lambda s, d: A.audit_summary(audit(s, d)),
    f"with {AUDIT}, {_lm} select marker, measure, count(*) as n_cores, {r6('avg(value)', 'mean')}, {r6('stddev_pop(value)', 'std')}, "
    f"{r6('quantile_cont(value, 0.5)', 'median')} from al group by 1,2")
add("d22_top_suspicious",
    lambda s, d: A.top_suspicious(audit(s, d), 15).select("basename", "marker", "alt_max"),
    f"with {AUDIT} select basename, marker, {r6('greatest(frac_per_core_otsu, frac_leiden)', 'alt_max')} from audit where suspicious_zero_consensus "
    "order by greatest(frac_per_core_otsu, frac_leiden) desc, basename, marker limit 15")
add("d23_top_disagreement",
    lambda s, d: A.top_disagreement(audit(s, d), 15).select("basename", "marker", "disagreement_score"),
    f"with {AUDIT} select basename, marker, {r6('disagreement_score', 'disagreement_score')} from audit order by audit.disagreement_score desc, basename, marker limit 15")
GATE = 0.28
_gate = (f"g as (select marker, avg(disagreement_score) as md, sum(cast(suspicious_zero_consensus as int)) as ns from audit group by 1), "
         "w as (select marker as wm from g order by round(md,9) desc, marker desc limit 1)")
_gcols = (f"marker, {r6('md', 'mean_disagreement')}, cast(ns as bigint) as n_suspicious, md > {GATE} as fails, marker = wm as is_worst, "
          "cast(sum(ns) over () as bigint) as n_suspicious_total from g, w")
add("d24_disagreement_gate", lambda s, d: A.disagreement_gate(audit(s, d), GATE), f"with {AUDIT}, {_gate} select {_gcols}")


def d25(spark, d):
    cells = c4(spark, d)
    return A.reaudit(cells, COHORT, panel=P, cluster="cluster_id_spacec", tau=TAU).select(
        "basename", "marker", "n_pos_consensus", "n_pos_leiden_zscore", "disagreement_score")


add("d25_reaudit", d25,
    f"with {AUDIT} select basename, marker, cast(n_pos_leiden_zscore as bigint) as n_pos_consensus, cast(n_pos_leiden_zscore as bigint) as n_pos_leiden_zscore, "
    f"{r6('abs(frac_per_core_otsu-frac_leiden)', 'disagreement_score')} from audit")
add("k6_audit_json",
    lambda s, d: sinks.audit_json(audit(s, d)).select(
        "basename", F.get_json_object("value", "$.n_cells").cast("long").alias("n_cells"),
        F.get_json_object(F.get_json_object("value", "$.per_marker.CD68"), "$.n_pos_consensus").cast("long").alias("cd68")),
    f"with {AUDIT} select basename, n_cells, cast(n_pos_consensus as bigint) as cd68 from audit where marker='CD68'")
add("k7_label_provenance",
    lambda s, d: sinks.label_provenance(c4(s, d), {"zscore_tau": TAU}, P).select(
        F.get_json_object("value", "$.n_cores").cast("long").alias("n_cores"),
        F.get_json_object("value", "$.n_cells_total").cast("long").alias("n_cells_total"),
        F.get_json_object("value", "$.per_marker_positive_counts.CD68").cast("long").alias("cd68")),
    f"with {CZ} select (select count(distinct basename) from cells) as n_cores, (select count(*) from cells) as n_cells_total, "
    f"cast(sum(n_cluster) as bigint) as cd68 from cz where channel=27 and z > {TAU}")
