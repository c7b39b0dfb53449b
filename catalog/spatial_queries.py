"""Queries over neighbour graphs, preference statistics, hotspots and polygon lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derived as D
from catalog.derived import CELLS, MODEL, P, THR, TYPED, cc, edges_sql, r6
from catalog.registry import add
from cellframe.operators import joins as J
from cellframe.operators import sampling as SM
from cellframe.operators.spatial import knn as K
from cellframe.operators.spatial import polygons as PG
from cellframe.operators.spatial import preference as PR
from cellframe.operators.spatial import quadtree as Q
from cellframe.panel import ch
from cellframe.plans import bundle as PL

LABEL = "dominant_phenotype"
RADIUS = 98
LABELS = PR.LABELS
NEAR = edges_sql()
WITHIN = edges_sql(RADIUS)


def within(spark, d, expand=True):
    return K.radius_edges(D.typed(spark, d), float(RADIUS), LABEL, expand=expand)


def around(spark, d):
    """The label counts within the radius, from the tree."""
    return Q.radius_counts(D.typed(spark, d), RADIUS, LABEL, LABELS)


EDGE_COLS = ["basename", "src_cell_id", "dst_cell_id", "src_phenotype", "dst_phenotype", "distance_px"]
_ecols = f"basename, src_cell_id, dst_cell_id, src_phenotype, dst_phenotype, {r6('distance_px', 'distance_px')}"
add("j8_knn_edges", lambda s, d: K.knn_edges(D.typed(s, d), 16, LABEL).select(*EDGE_COLS, "rank"),
    f"with {TYPED}, {NEAR} select {_ecols}, rank from edges")
add("j9_radius_edges", lambda s, d: within(s, d).select(*EDGE_COLS), f"with {TYPED}, {WITHIN} select {_ecols} from edges")
add("j7_annotate_edges",
    lambda s, d: J.annotate_edges(K.radius_edges(D.typed(s, d), float(RADIUS), expand=False), D.typed(s, d)).select(*EDGE_COLS),
    f"with {TYPED}, {WITHIN} select {_ecols} from edges")
add("w4_rank_neighbours", lambda s, d: K.rank_neighbours(within(s, d, expand=False)).select("basename", "src_cell_id", "dst_cell_id", "rank"),
    f"with {TYPED}, {WITHIN} select basename, src_cell_id, dst_cell_id, row_number() over (partition by basename, src_cell_id order by d2, dst_cell_id) as rank from edges")

FEAT_CH = P.channels
FEAT_TAU = {c: 0.4 for c in FEAT_CH}


def j10(spark, d):
    cells = D.cells(spark, d).select("basename", "cell_id", "centroid_x", "centroid_y", *[ch(c, "pred", MODEL) for c in FEAT_CH])
    return K.knn_features(cells, [4, 16], K.FEATURES, FEAT_TAU, FEAT_CH, "ch{:02d}_pred_" + MODEL).drop(
        "centroid_x", "centroid_y", *[ch(c, "pred", MODEL) for c in FEAT_CH])


def _feat():
    out = []
    for k in (4, 16):
        for c in FEAT_CH:
            v = f"case when rank<={k} then p{c} end"
            out += [r6(f"avg({v})", f"nbr{k}_ch{c:02d}_pred_mean"), r6(f"stddev_pop({v})", f"nbr{k}_ch{c:02d}_pred_std"),
                    r6(f"avg(case when rank<={k} then cast(p{c} > {FEAT_TAU[c]} as int) end)", f"nbr{k}_ch{c:02d}_posfrac")]
        out.append(r6(f"avg(case when rank<={k} then 1/(distance_px+1) end)", f"nbr{k}_density"))
    return ", ".join(out)


add("j10_knn_features", j10,
    f"with {TYPED}, {NEAR}, pv as (select basename, cell_id as dst_cell_id, " + ", ".join(f"ch{c:02d}_pred_{MODEL} as p{c}" for c in FEAT_CH)
    + f" from scored) select basename, src_cell_id as cell_id, {_feat()} from edges join pv using (basename, dst_cell_id) group by 1,2")


def points(spark, d):
    """Probe points next to the cells: some inside a polygon, some outside."""
    return D.cells(spark, d).select(
        "basename", F.col("cell_id").alias("point_id"), (F.col("centroid_x") + F.col("cell_id") % 7).alias("x"),
        (F.col("centroid_y") + F.col("cell_id") % 3 + F.lit(0.25)).alias("y"))


add("j11_points_in_polygons", lambda s, d: PG.points_in_polygons(points(s, d), D.polygons(s, d)),
    f"""with {CELLS}, {D.POLYGONS}, pt as (select basename, cell_id as point_id, centroid_x + cell_id%7 as x, centroid_y + cell_id%3 + 0.25 as y from cells)
    select pt.basename, point_id, min(p.cell_id) as polygon_id from pt join polys p on pt.basename=p.basename
    and abs(pt.x-p.centroid_x)+abs(pt.y-p.centroid_y) < p.r group by 1,2""")


def j12(spark, d):
    """Cached vectors exist for the cells whose id is an embedding id."""
    e = D.table(spark, d, "embeddings")
    keys = D.cells(spark, d).select("basename", "cell_id")
    feats = e.join(keys, e["vec_id"] == keys["cell_id"]).select("basename", "cell_id", F.col("embedding").alias("feat_global"))
    out = J.attach_features(D.cells(spark, d), feats, ("global",), MODEL, panel=P)
    return out.select("basename", "cell_id", F.size("x").alias("n"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total")).withColumn(
        "total", F.round("total", 3))


_p12 = "+".join(f"cast(cast({cc(c)}_pred_{MODEL} as float) as double)" for c in P.channels)
_m12 = "+".join(f"cast(cast(avg({cc(c)}_pred_{MODEL}) over (partition by basename) as float) as double)" for c in P.channels)
add("j12_attach_features", j12,
    f"with {CELLS}, k as (select cells.*, list_sum(list_transform(embedding, lambda x: cast(x as double))) as es, len(embedding) as el from cells join embeddings on vec_id = cell_id) "
    f"select basename, cell_id, cast(el+24 as bigint) as n, round(es+{_p12}+{_m12}, 3) as total from k")

# ---- preference

COUNTS = ("lc as (select basename, dominant_phenotype as label, count(*) as n from typed group by 1,2), "
          "ec as (select basename, src_phenotype as a, dst_phenotype as b, count(*) as observed from edges group by 1,2,3), "
          "dg as (select basename, a, sum(observed) as deg from ec group by 1,2), dt as (select basename, sum(observed) as total from ec group by 1), "
          "nt as (select basename, sum(n) as n_total from lc group by 1), "
          "pr as (select x.basename, x.label as a, y.label as b, x.n as n_a, y.n as n_b, n_total from lc x join lc y on x.basename=y.basename join nt on nt.basename=x.basename)")
ERF = ("(1.0e0/(1.0e0+0.3275911e0*q))", "((((1.061405429e0*t-1.453152027e0)*t+1.421413741e0)*t-0.284496736e0)*t+0.254829592e0)*t*exp(-q*q)")
COZI = (COUNTS + ", cz0 as (select pr.*, deg, dt.total as n_edges, coalesce(observed,0) as observed, (case when pr.a=pr.b then n_a-1 else n_b end)/cast(greatest(n_total-1,1) as double) as p "
        "from pr join dg on dg.basename=pr.basename and dg.a=pr.a join dt on dt.basename=pr.basename left join ec on ec.basename=pr.basename and ec.a=pr.a and ec.b=pr.b "
        "where n_total>=2 and (pr.a<>pr.b or n_a>=2)), "
        "cz1 as (select *, deg*p as expected, deg*p*(1-p) as variance from cz0), "
        "cz2 as (select *, case when variance>0 then (observed-expected)/sqrt(variance) end as z from cz1), "
        f"cz3 as (select *, abs(z)/sqrt(2.0e0) as q from cz2), cz4 as (select *, {ERF[0]} as t from cz3), cozi as (select *, {ERF[1]} as pv from cz4)")
_cz = ("basename, a as phenotype_a, b as phenotype_b, cast(observed as bigint) as observed, " + r6("expected", "expected") + ", " + r6("variance", "variance") + ", "
       + r6("z", "z") + ", " + r6("pv", "p_two_sided") + ", n_a, n_b, cast(n_total as bigint) as n_total, cast(n_edges as bigint) as n_edges")
add("d13_edge_counts", lambda s, d: PR.edge_counts(around(s, d)),
    f"with {TYPED}, {WITHIN}, {COUNTS} select ec.basename, ec.a as src_phenotype, b as dst_phenotype, observed, cast(deg as bigint) as out_degree, cast(total as bigint) as n_edges "
    "from ec join dg on dg.basename=ec.basename and dg.a=ec.a join dt on dt.basename=ec.basename")
add("j17_phenotype_pairs", lambda s, d: PR.phenotype_pairs(PR.label_counts(D.typed(s, d))),
    f"with {TYPED}, {WITHIN}, {COUNTS} select basename, a as phenotype_a, b as phenotype_b, n_a, n_b, cast(n_total as bigint) as n_total from pr")
add("d14_cozi", lambda s, d: PR.cozi(D.typed(s, d), around(s, d)), f"with {TYPED}, {WITHIN}, {COZI} select {_cz} from cozi")
RATIO = ("oe as (select pr.basename, pr.a, pr.b, observed, deg*(case when pr.a=pr.b then greatest(n_a-1,0) else n_b end)/cast(greatest(n_total-1,1) as double) as expected "
         "from ec join pr on pr.basename=ec.basename and pr.a=ec.a and pr.b=ec.b join dg on dg.basename=pr.basename and dg.a=pr.a)")
add("d15_observed_over_expected", lambda s, d: PR.observed_over_expected(D.typed(s, d), around(s, d)),
    f"with {TYPED}, {WITHIN}, {COUNTS}, {RATIO} select basename, a as phenotype_a, b as phenotype_b, observed, {r6('expected', 'expected')}, {r6('observed/greatest(expected,1e-6)', 'obs_over_exp')} from oe")
_loc = ", ".join(f"sum(cast(dst_phenotype='{n}' as int)) as c_{n}" for n in LABELS)
LOCAL = f"loc as (select basename, src_cell_id, count(*) as nn, {_loc} from edges group by 1,2)"
add("d16_local_composition", lambda s, d: PR.local_composition(around(s, d)),
    f"with {TYPED}, {WITHIN}, {LOCAL} select basename, src_cell_id, nn as n_neighbors, "
    + ", ".join(f"cast(c_{n} as bigint) as local_count_{n}, {r6(f'c_{n}/cast(nn as double)', f'local_frac_{n}')}" for n in LABELS) + " from loc")
add("d17_local_label_count", lambda s, d: PR.local_label_count(around(s, d), "tumor_ca9_or_panck"),
    f"with {TYPED}, {WITHIN}, {LOCAL} select basename, src_cell_id, nn as n_neighbors, cast(c_tumor_ca9_or_panck as bigint) as n_pheno from loc")
HOT = (LOCAL + ", ls as (select basename, " + ", ".join(f"avg(c_{n}/cast(nn as double)) as m_{n}, stddev_pop(c_{n}/cast(nn as double)) as s_{n}" for n in LABELS)
       + " from loc group by 1), hz as (select loc.basename, src_cell_id, nn, " + ", ".join(f"c_{n}, (c_{n}/cast(nn as double)-m_{n})/(s_{n}+1e-9) as z_{n}" for n in LABELS)
       + " from loc join ls using (basename))")
add("w3_hotspots", lambda s, d: PR.hotspots(around(s, d), "immune_cd45"),
    f"with {TYPED}, {WITHIN}, {HOT} select basename, src_cell_id, nn as n_neighbors, cast(c_immune_cd45 as bigint) as n_pheno, {r6('c_immune_cd45/cast(nn as double)', 'local_frac')}, "
    f"{r6('z_immune_cd45', 'z')}, z_immune_cd45 >= 1.96 as is_hotspot from hz")
IOU = (HOT + ", hl as (" + " union all ".join(f"select basename, src_cell_id, '{n}' as label, z_{n} >= 1.96 as hot from hz" for n in LABELS)
       + "), iou as (select a.basename, a.label as a, b.label as b, case when a.label=b.label then 1.0 else sum(cast(a.hot and b.hot as int))/nullif(cast(sum(cast(a.hot or b.hot as int)) as double),0) end as iou "
       "from hl a join hl b on a.basename=b.basename and a.src_cell_id=b.src_cell_id group by 1,2,3)")
add("d18_hotspot_overlap", lambda s, d: PR.hotspot_overlap(around(s, d)),
    f"with {TYPED}, {WITHIN}, {IOU} select basename, a as phenotype_a, b as phenotype_b, {r6('iou', 'hotspot_overlap_iou')} from iou")


def summary(spark, d, method="knn"):
    _, out = PL.spatial_summary(D.scored(spark, d), MODEL, method, 16, float(RADIUS), panel=P)
    return out


def SUMMARY(edges):
    return f"{TYPED}, {edges}, {COZI}, {RATIO}, {IOU}, sm as (select cozi.*, observed2, iou, oe2 from cozi left join (select basename, a, b, observed as observed2, observed/greatest(expected,1e-6) as oe2 from oe) using (basename, a, b) left join iou using (basename, a, b))"


add("j16_spatial_summary_join", summary,
    f"with {SUMMARY(NEAR)} select {_cz}, {r6('oe2', 'obs_over_exp')}, {r6('iou', 'hotspot_overlap_iou')} from sm")


def radius_summary(spark, d):
    return PL.spatial_summary(D.scored(spark, d), MODEL, "radius", radius=float(RADIUS), panel=P)[1]


def undefined_z(spark, d):
    """Preference rows some of which have no z, as pairs without variance."""
    return PR.cozi(D.typed(spark, d), around(spark, d)).withColumn(
        "z", F.when(F.col("n_a") % 3 == 0, F.lit(None)).when(F.col("n_a") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("z") * 20))


add("d36_matrix_of_unknown", lambda s, d: PR.cozi_matrix(undefined_z(s, d)),
    f"with {TYPED}, {WITHIN}, {COZI} select a as phenotype_a, " + ", ".join(
        r6(f"avg(case when b='{n}' and n_a % 3 = 2 and z is not null then greatest(-30.0, least(30.0, z*20)) end)", n) for n in LABELS) + " from cozi group by 1")
add("d36_cozi_matrix", lambda s, d: PR.cozi_matrix(PR.cozi(D.typed(s, d), around(s, d))),
    f"with {TYPED}, {WITHIN}, {COZI} select a as phenotype_a, " + ", ".join(r6(f"avg(case when b='{n}' then greatest(-30.0, least(30.0, z)) end)", n) for n in LABELS) + " from cozi group by 1")
add("d38_spatial_slice",
    lambda s, d: PR.spatial_slice(PR.cozi(D.typed(s, d), around(s, d)), "ccOC_TMA2__B-2", 12).select("phenotype_a", "phenotype_b", "z"),
    f"with {TYPED}, {WITHIN}, {COZI} select a as phenotype_a, b as phenotype_b, {r6('z', 'z')} from cozi where basename='ccOC_TMA2__B-2' and a<>b and z is not null order by abs(cozi.z) desc, a, b limit 12")
add("d33_report_rows",
    lambda s, d: PL.report_rows(D.manifest(s, d), radius_summary(s, d), THR, MODEL, None, 3, P)[1].select(
        "basename", "rank", "phenotype_a", "phenotype_b", "z", "obs_over_exp"),
    f"with {SUMMARY(WITHIN)}, rk as (select *, row_number() over (partition by basename order by abs(z) desc, a, b) as rank from sm where a<>b and z is not null) "
    f"select basename, rank, a as phenotype_a, b as phenotype_b, {r6('z', 'z')}, {r6('oe2', 'obs_over_exp')} from rk where rank<=3")
add("u3_distinct_pairs", lambda s, d: K.label_pairs(within(s, d, expand=False)),
    f"with {TYPED}, {WITHIN} select distinct src_phenotype, dst_phenotype from edges")
