"""Queries for ranking metrics, losses, windows, calibration, clustering and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import derived as D
from catalog.derived import CELLS, MANIFEST, MODEL, P, SCORED, THR, cc, r6
from catalog.registry import add
from catalog.stat_queries import MERGED, SCALED, clustered, merged, scaled, splits
from cellframe.functions.expr import stack_columns
from cellframe.operators import calibrate as CB
from cellframe.operators import cluster as CL
from cellframe.operators import compose as C
from cellframe.operators import labels as L
from cellframe.operators import metrics as M
from cellframe.operators import normalize as N
from cellframe.operators import rules as R
from cellframe.operators import sampling as SM
from cellframe.panel import ch, ph
from cellframe.plans import bundle as PL
from cellframe.session import scratch_folder
from cellframe.sources import sinks, tables

PN = P.phenotypes


def long_sql(model=MODEL, src="scored", keep="", markers=True, phenotypes=True, channels=P.channels):
    k = f"{keep}, " if keep else ""
    rows = []
    if markers:
        rows += [f"select {k}'marker' as kind, cast({i} as bigint) as position, '{n}' as name, {cc(c)}_pos as y, {cc(c)}_pred_{model} as score from {src}"
                 for i, (n, c) in enumerate(P.pairs) if c in channels]
    if phenotypes:
        rows += [f"select {k}'phenotype' as kind, cast({i} as bigint) as position, '{n}' as name, phenotype_{n}_label as y, phenotype_{n}_score_{model} as score from {src}"
                 for i, n in enumerate(PN)]
    return "long as (" + " union all ".join(rows) + ")"


def pr_sql(by, src="long", y="y", s="score", tag=""):
    """CTE pr: one row per group and score with running and total counts."""
    k = ", ".join(by)
    return (
        f"tie{tag} as (select {k}, {s} as score, sum(cast({y} as int)) as tp, count(*) as n from {src} where {s} is not null and {y} is not null group by {k}, {s}), "
        f"pr{tag} as (select *, sum(tp) over (partition by {k} order by score desc) as rtp, sum(n) over (partition by {k} order by score desc) as rn, "
        f"sum(tp) over (partition by {k}) as p, sum(n) over (partition by {k}) as t from tie{tag})"
    )


_AP = "sum(cast(tp as double)*rtp/rn)/max(p)"
_AUC = "sum((n-tp)*(rtp-tp/2.0e0))/(cast(max(p) as double)*(max(t)-max(p)))"
BOTH = "max(p)>0 and max(p)<max(t)"


def scored_long(spark, d, **kw):
    return M.melt_scored(D.scored(spark, d), MODEL, P, **kw)


KEY = list(M.METRIC_KEY)
_k = "kind, position, name"
add("e1_average_precision",
    lambda s, d: M.average_precision(scored_long(s, d), KEY, "y", "score"),
    f"with {SCORED}, {long_sql()}, {pr_sql(KEY)} select {_k}, cast(max(t) as bigint) as n, cast(max(p) as bigint) as n_pos, case when {BOTH} then {r6(_AP)} end as ap from pr group by {_k}")
add("e2_roc_auc",
    lambda s, d: M.roc_auc(scored_long(s, d), KEY, "y", "score"),
    f"with {SCORED}, {long_sql()}, {pr_sql(KEY)} select {_k}, cast(max(t) as bigint) as n, cast(max(p) as bigint) as n_pos, case when {BOTH} then {r6(_AUC)} end as auc from pr group by {_k}")
_F1 = "round(2.0e0*rtp/(rn+p), 12)"
_best = f"bf as (select *, {_F1} as f1 from pr), br as (select *, row_number() over (partition by {{k}} order by f1 desc, score) as r_ from bf)"
add("e3_best_f1",
    lambda s, d: M.best_f1(scored_long(s, d), KEY, "y", "score"),
    f"with {SCORED}, {long_sql()}, {pr_sql(KEY)}, {_best.format(k=_k)} select {_k}, cast(t as bigint) as n, cast(p as bigint) as n_pos, "
    f"{r6('score', 'best_threshold')}, {r6('f1', 'best_f1')} from br where r_=1")
add("e4_cut_metrics",
    lambda s, d: M.cut_metrics(scored_long(s, d), KEY, "y", F.col("score") > 0.5),
    f"""with {SCORED}, {long_sql()}, c as (select {_k}, sum(cast(y and score>0.5 as int)) tp, sum(cast(not y and score>0.5 as int)) fp,
    sum(cast(y and not score>0.5 as int)) fn, sum(cast(not y and not score>0.5 as int)) tn from long group by {_k})
    select {_k}, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tn as bigint) as tn,
    {r6('2.0*tp/(2*tp+fp+fn)', 'f1')}, {r6('(tp/cast(tp+fn as double)+tn/cast(tn+fp as double))/2', 'balanced_accuracy')} from c""")
add("e5_fit_operating_threshold",
    lambda s, d: M.fit_operating_threshold(M.melt_scored(splits(s, d, "train"), MODEL, P, phenotypes=False), KEY, "y", "score"),
    f"with {CELLS}, {MANIFEST}, tr as (select * from cells where basename in (select basename from cores where split='train')), "
    f"{long_sql(src='tr', phenotypes=False)}, {pr_sql(KEY)}, {_best.format(k=_k)} select {_k}, {r6('score', 'threshold')}, {r6('f1', 'best_f1')} from br where r_=1")
add("e6_model_metrics",
    lambda s, d: M.model_metrics(merged(s, d), D.MODEL2, P),
    f"with {MERGED}, {long_sql(D.MODEL2, 'merged', channels=D.MODEL2_CHANNELS)}, {pr_sql(KEY)}, m as (select {_k}, max(t) as t, max(p) as p, {_AP} as ap from pr group by {_k} having max(p)>0) "
    f"select {_k}, cast(t as bigint) as n, cast(p as bigint) as n_pos, {r6('ap', 'ap')}, {r6('avg(ap) over (partition by kind)', 'macro_ap')} from m")


add("p22_strata_buckets",
    lambda s, d: R.strata_buckets(R.confidence_stratum(M.model_metrics(D.scored(s, d), MODEL, P)), "name", "confidence"),
    f"with {SCORED}, {long_sql()}, {pr_sql(KEY)}, m as (select name, {_AP} as ap from pr group by {_k}), "
    "b as (select name, case when ap>=0.70 then 'strong' when ap>=0.55 then 'moderate' else 'weak' end as stratum from m) "
    "select stratum, count(*) as n, string_agg(name, ',' order by name) as names from b group by 1")


def lift(spark, d):
    return M.within_core_lift(D.cells(spark, d), MODEL, N.core_mean_preds(D.cells(spark, d), MODEL, P), P)


_long7 = "long as (" + " union all ".join(
    f"select {i} as position, {c} as channel, '{n}' as name, 'model' as arm, {cc(c)}_pos as y, {cc(c)}_pred_{MODEL} as score from cells union all "
    f"select {i}, {c}, '{n}', 'base', {cc(c)}_pos, m{c} from cells join cm using (basename)" for i, (n, c) in enumerate(P.pairs)) + ")"
# the baseline has exact ties inside a core only, so the mean is rounded before it is compared
_cm = "cm as (select basename, " + ", ".join(f"round(avg({cc(c)}_pred_{MODEL}), 9) as m{c}" for c in P.channels) + " from cells group by 1)"
LIFT = (f"{CELLS}, {_cm}, {_long7}, {pr_sql(['position', 'channel', 'name', 'arm'])}, lm as (select position, channel, name, arm, max(t) as t, max(p) as p, {_AP} as ap from pr group by 1,2,3,4), "
        "lf as (select position, channel, name, max(t) as t, max(p) as p, max(case when arm='model' then ap end) as a, max(case when arm='base' then ap end) as b from lm group by 1,2,3)")
add("e7_within_core_lift", lift,
    f"with {LIFT} select cast(position as bigint) as position, cast(channel as bigint) as channel, name, cast(t as bigint) as n_eval_cells, {r6('p/cast(t as double)', 'positive_fraction')}, "
    f"{r6('a', 'model_ap')}, {r6('b', 'baseline_ap_core_mean')}, {r6('a-b', 'lift')} from lf")
add("e7_macro_lift", lambda s, d: M.macro_lift(lift(s, d)),
    f"with {LIFT} select {r6('avg(a)', 'macro_model_ap')}, {r6('avg(b)', 'macro_baseline_ap_core_mean')}, {r6('avg(a-b)', 'macro_within_core_lift')} from lf")
add("t7_lift_order", lambda s, d: SM.lift_order(lift(s, d)).select("name", "lift").withColumn("place", F.monotonically_increasing_id()).withColumn(
        "place", F.rank().over(Window.orderBy("place"))),
    f"with {LIFT} select name, {r6('a-b', 'lift')}, row_number() over (order by a-b desc, name) as place from lf")


def report_sql(cte, key=_k):
    return (f"with {cte}, {_best.format(k=key)}, ag as (select {key}, max(t) as t, max(p) as p, {_AP} as ap, {_AUC} as auc, "
            f"sum(case when score>0.5 then tp else 0 end) as tp5, sum(case when score>0.5 then n else 0 end) as n5 from pr group by {key}) "
            f"select {key}, cast(ag.t as bigint) as n_eval_cells, {r6('ag.p/cast(ag.t as double)', 'positive_fraction')}, {r6('auc', 'auc')}, {r6('ap', 'ap')}, "
            f"{r6('2.0*tp5/(n5+ag.p)', 'f1_at_0p5')}, {r6('f1', 'best_possible_f1')}, {r6('score', 'best_threshold')} from ag join (select * from br where r_=1) using ({key})")


add("e8_marker_metrics", lambda s, d: M.marker_metrics(D.cells(s, d), MODEL, P),
    report_sql(f"{CELLS}, {long_sql(src='cells', phenotypes=False)}, {pr_sql(KEY)}"))
add("e8_phenotype_metrics", lambda s, d: M.phenotype_metrics(D.scored(s, d), MODEL, P),
    report_sql(f"{SCORED}, {long_sql(markers=False)}, {pr_sql(KEY)}"))
PC = f"{SCORED}, {long_sql(keep='basename')}, {pr_sql(['basename', *KEY])}, pc as (select basename, {_k}, max(t) as t, max(p) as p, case when {BOTH} then {_AP} end as ap from pr group by basename, {_k})"
add("e9_per_core_ap", lambda s, d: M.per_core_ap(D.scored(s, d), MODEL, P),
    f"with {PC} select basename, {_k}, cast(t as bigint) as n, cast(p as bigint) as n_pos, {r6('ap', 'ap')} from pc")
add("d9_summarize_ap", lambda s, d: C.summarize_ap(M.per_core_ap(D.scored(s, d), MODEL, P), ["name"]),
    f"with {PC} select name, count(ap) as n, {r6('avg(ap)', 'mean')}, {r6('quantile_cont(ap, 0.5)', 'median')}, {r6('stddev_pop(ap)', 'std')} from pc group by 1")
_thr = "case name " + " ".join(f"when '{n}' then {t}" for n, t in THR.marker.items()) + " end"
add("d4_truth_comparison", lambda s, d: C.truth_comparison(D.cells(s, d), THR, MODEL, panel=P),
    f"with {CELLS}, {long_sql(src='cells', keep='basename', phenotypes=False)}, {pr_sql(['basename', 'position', 'name'])}, "
    f"b as (select basename, position, name, avg(cast(score > {_thr} as int)) as pf, avg(cast(y as int)) as tf from long group by 1,2,3), "
    f"a as (select basename, name, case when {BOTH} then {_AP} end as ap from pr group by 1,2) "
    f"select basename, position, name, {r6('pf', 'predicted_fraction')}, {r6('tf', 'truth_fraction')}, {r6('abs(pf-tf)', 'absolute_error')}, {r6('ap', 'ap')} from b join a using (basename, name)")


def per_core_table(spark, d):
    """The per-core metrics file: one row per name, one column per core."""
    rows = M.per_core_ap(D.scored(spark, d), MODEL, P)
    names = [f"core_{i}" for i in range(30)]
    number = F.concat(F.lit("core_"), F.element_at(F.split("basename", "-"), -1).cast("int") - 1)
    return rows.withColumn("__c", number).groupBy("name").pivot("__c", names).agg(F.first("ap"))


add("s12_read_per_core_ap",
    lambda s, d: tables.read_per_core_ap(per_core_table(s, d)).select(
        "name", F.size("per_core_ap").alias("n"), F.aggregate("per_core_ap", F.lit(0.0), lambda a, x: a + x).alias("total")),
    f"with {PC} select name, count(ap) as n, {r6('sum(ap)', 'total')} from pc group by 1")


def d8(spark, d):
    from catalog.stat_queries import summary

    models = PL.model_entry(M.model_metrics(D.scored(spark, d), MODEL, P), MODEL)
    per_core = tables.read_per_core_ap(per_core_table(spark, d))
    return C.validation_table(models, MODEL, THR, summary(spark, d), per_core, P).select(
        "kind", "position", "name", "macro_ap", "n_cores_with_truth", "confidence_stratum", F.size("per_core_ap").alias("n_per_core"))


_str = "case name " + " ".join(f"when '{n}' then '{THR.stratum(n)}'" for n in [*P.names, *PN]) + " end"
add("d8_validation_table", d8,
    f"with {PC}, {pr_sql(KEY, tag='2')}, g as (select {_k}, {_AP} as ap from pr2 group by {_k}), c as (select name, count(ap) as n from pc group by 1) "
    f"select {_k}, {r6('ap', 'macro_ap')}, (select count(distinct basename) from cells) as n_cores_with_truth, {_str} as confidence_stratum, n as n_per_core from g join c using (name)")

# ---- losses

LOGIT = "ln(({p}+0.001)/(1.001-{p}))"


def loss_rows(spark, d):
    df = D.scored(spark, d)
    rows = [{"name": F.lit(n), "x": F.log((F.col(ch(c, "pred", MODEL)) + 0.001) / (F.lit(1.001) - F.col(ch(c, "pred", MODEL)))),
             "y": F.col(ch(c, "pos")).cast("double"), "ignore": F.col(ch(c, "noise")) < 0.1} for n, c in P.pairs]
    return stack_columns(df, ["basename"], rows)


_lr = "lr as (" + " union all ".join(
    f"select basename, '{n}' as name, {LOGIT.format(p=f'{cc(c)}_pred_{MODEL}')} as x, cast({cc(c)}_pos as int) as y, {cc(c)}_noise < 0.1 as ig from cells" for n, c in P.pairs) + ")"
add("e10_focal_bce",
    lambda s, d: loss_rows(s, d).groupBy("name").agg(
        M.masked_mean(M.focal_bce(F.col("x"), F.col("y"), 0.75, 2.0)).alias("loss"),
        M.masked_mean(M.focal_bce(F.col("x"), F.col("y"), 0.75, 2.0), F.col("ignore")).alias("masked_loss")),
    f"""with {CELLS}, {_lr}, q as (select name, ig, case when y>0.5 then 0.75*power(1-1/(1+exp(-x)),2)*ln(1+exp(-x)) else 0.25*power(1/(1+exp(-x)),2)*(x+ln(1+exp(-x))) end as l from lr)
    select name, {r6('avg(l)', 'loss')}, {r6('sum(case when not ig then l end)/greatest(count(case when not ig then 1 end),1)', 'masked_loss')} from q group by 1""")
add("e11_asymmetric_loss",
    lambda s, d: loss_rows(s, d).groupBy("name").agg(
        M.masked_mean(M.asymmetric_loss(F.col("x"), F.col("y"), 1.0, 4.0, 0.05), F.col("ignore")).alias("loss")),
    f"""with {CELLS}, {_lr}, q as (select name, ig, 1/(1+exp(-x)) as p, y from lr), q2 as (select *, greatest(p-0.05,0.0) as pm from q)
    select name, {r6('avg(-(y*(1-p)*ln(p) + (1-y)*power(pm,4)*ln(greatest(1-pm,1e-8))))', 'loss')} from q2 where not ig group by 1""")


def e12(spark, d):
    df = D.scored(spark, d)
    logits = {n: F.log((F.col(ph(n, "score", MODEL)) + 0.001) / (F.lit(1.001) - F.col(ph(n, "score", MODEL)))) for n in PN}
    return M.hierarchy_penalty(df, logits, ["basename"], P)


add("e12_hierarchy_penalty", e12,
    f"with {SCORED} select basename, " + r6("(" + "+".join(
        f"avg(greatest({LOGIT.format(p=f'phenotype_{a}_score_{MODEL}')}-{LOGIT.format(p=f'phenotype_{b}_score_{MODEL}')}, 0.0))" for a, b in P.hierarchy) + f")/{len(P.hierarchy)}", "hierarchy_penalty")
    + " from scored group by 1")


def e12_gaps(spark, d):
    df = D.scored(spark, d)
    known = lambda i, n: F.when(F.col("cell_id") % 7 == i % 7, F.lit(None)).otherwise(F.log((F.col(ph(n, "score", MODEL)) + 0.001) / (F.lit(1.001) - F.col(ph(n, "score", MODEL)))))
    return M.hierarchy_penalty(df, {n: known(i, n) for i, n in enumerate(PN)}, ["basename"], P)


def _gap_logit(n):
    return f"case when cell_id % 7 <> {PN.index(n) % 7} then {LOGIT.format(p=f'phenotype_{n}_score_{MODEL}')} end"


add("e12_penalty_of_unknown", e12_gaps,
    f"with {SCORED}, g as (select basename, " + ", ".join(f"{_gap_logit(n)} as g{i}" for i, n in enumerate(PN)) + " from scored) select basename, " + r6("(" + "+".join(
        "avg(case when g{0} is not null and g{1} is not null then greatest(g{0}-g{1}, 0.0) end)".format(PN.index(a), PN.index(b)) for a, b in P.hierarchy) + f")/{len(P.hierarchy)}", "hierarchy_penalty")
    + " from g group by 1")


def e13(spark, d):
    from catalog.artifact_queries import artifact

    return artifact(spark, d).select(
        "schema_version", F.size("marker_thresholds").alias("n_markers"), F.size("phenotype_thresholds").alias("n_phenotypes"),
        F.element_at("marker_thresholds", "27").alias("cd68"), F.element_at("marker_confidence", "CD68").alias("cd68_confidence"))


add("e13_threshold_artifact", e13,
    f"with {CELLS}, {long_sql(src='cells', phenotypes=False)}, {pr_sql(KEY)}, {_best.format(k=_k)}, ap as (select name, {_AP} as ap from pr group by 1) "
    f"select cast(1 as bigint) as schema_version, cast(12 as bigint) as n_markers, cast(9 as bigint) as n_phenotypes, {r6('score', 'cd68')}, "
    "case when ap>=0.70 then 'strong' when ap>=0.55 then 'moderate' else 'weak' end as cd68_confidence from br join ap using (name) where r_=1 and name='CD68'")
add("x3_safe_metric",
    lambda s, d: M.rank_metrics(
        D.cells(s, d).select("basename", (F.col("ch27_pos") & F.col("basename").startswith("ccRCC")).alias("y"), F.col(ch(27, "pred", MODEL)).alias("score")),
        ["basename"], "y", "score"),
    f"with {CELLS}, l as (select basename, (ch27_pos and basename like 'ccRCC%') as y, ch27_pred_{MODEL} as score from cells), {pr_sql(['basename'], 'l')} "
    f"select basename, cast(max(t) as bigint) as n, cast(max(p) as bigint) as n_pos, case when {BOTH} then {r6('sum(cast(tp as double)*rtp/rn)/nullif(max(p),0)')} end as ap, "
    f"case when {BOTH} then {r6('sum((n-tp)*(rtp-tp/2.0e0))/nullif(cast(max(p) as double)*(max(t)-max(p)),0)')} end as auc from pr group by 1")

# ---- windows

add("w1_core_means",
    lambda s, d: N.core_mean_preds(D.cells(s, d), MODEL, P).select("basename", "cell_id", *[f"core_mean_ch{c:02d}_pred" for c in P.channels]),
    f"with {CELLS} select basename, cell_id, " + ", ".join(r6(f"avg({cc(c)}_pred_{MODEL}) over (partition by basename)", f"core_mean_ch{c:02d}_pred") for c in P.channels) + " from cells")
add("w6_pr_table",
    lambda s, d: M.pr_table(D.cells(s, d), ["basename"], "ch27_pos", ch(27, "pred", MODEL)).select(
        "basename", F.col(ch(27, "pred", MODEL)).alias("score"), "tp", "n", "run_tp", "run_n"),
    f"with {CELLS}, {pr_sql(['basename'], 'cells', 'ch27_pos', f'ch27_pred_{MODEL}')} select basename, {r6('score', 'score')}, cast(tp as bigint) as tp, n, cast(rtp as bigint) as run_tp, cast(rn as bigint) as run_n from pr")
add("w7_global_fill",
    lambda s, d: N.global_fill(merged(s, d).select("basename", "cell_id", ch(27, "pred", D.MODEL2)), [ch(27, "pred", D.MODEL2)]),
    f"with {MERGED} select basename, cell_id, {r6(f'coalesce(ch27_pred_{D.MODEL2}, avg(ch27_pred_{D.MODEL2}) over ())', f'ch27_pred_{D.MODEL2}')} from merged")


def w5(spark, d):
    """Every key once with what stayed, and every moved pair of values once, row by row."""
    c = D.cells(spark, d).select("basename", "cell_id", "centroid_x", ch(27, "pred", MODEL), F.col("cell_id").alias("was"))
    moved = SM.shuffle_within_core(c, [ch(27, "pred", MODEL), "was"], 7)
    stayed = moved.select("basename", F.lit("stayed").alias("kind"), F.col("cell_id").alias("id"), F.col("centroid_x").cast("double").alias("value"))
    return stayed.unionByName(moved.select("basename", F.lit("moved").alias("kind"), F.col("was").alias("id"), F.col(ch(27, "pred", MODEL)).alias("value")))


add("w5_shuffle_within_core", w5,
    f"with {CELLS} select basename, 'stayed' as kind, cell_id as id, {r6('centroid_x', 'value')} from cells union all select basename, 'moved', cell_id, {r6(f'ch27_pred_{MODEL}', 'value')} from cells")

# ---- clustering and calibration

add("c1_cluster_cells",
    lambda s, d: CL.cluster_cells(scaled(s, d), P).groupBy("basename").agg(
        F.count("*").alias("n_cells"), F.countDistinct("cluster_id_spacec").alias("n_clusters"), F.min("cluster_id_spacec").alias("first_id")))
add("c5_label_cores",
    lambda s, d: CL.label_cores(D.cells(s, d), P).groupBy("basename").agg(
        F.count("*").alias("n_cells"), F.count_if("ch27_pos_spacec").alias("cd68"), F.count_if(ph("immune_cd45", "call_spacec")).alias("immune")))


def optimum(fit, evaluation):
    """Every marker's model: at the optimum of a balanced fit the mean residuals of both classes are equal."""
    def long(df, part):
        return stack_columns(df, [], [
            {"part": F.lit(part), "channel": F.lit(c), "y": F.col(ch(c, "pos")), "p": F.col(ch(c, "prob_logreg"))} for c in P.channels])

    p, y = F.col("p"), F.col("y")
    gap = F.avg(F.when(y, 1.0 - p)) - F.avg(F.when(~y, p))
    return long(fit, "fit").unionByName(long(evaluation, "evaluation")).groupBy("part", "channel").agg(
        F.count_if(p.between(0, 1)).alias("n"), F.count_if("y").alias("n_pos"), (F.round(F.when(F.col("part") == "fit", gap), 6) + 0.0).alias("residual"))


def c6(spark, d):
    return optimum(*CB.calibrate_markers(splits(spark, d, "train"), splits(spark, d, "val"), P, MODEL))


def _optimum_sql(lead=""):
    return " union all ".join(
        f"select {lead}'{part}' as part, cast({c} as bigint) as channel, count(*) as n, cast(sum(cast({cc(c)}_pos as int)) as bigint) as n_pos, {value} as residual "
        f"from cells join cores using (basename) where split = '{split}'" for part, split, value in (("fit", "train", "0.0e0"), ("evaluation", "val", "cast(null as double)")) for c in P.channels)


add("c6_calibrate_markers", c6, f"with {CELLS}, {MANIFEST} {_optimum_sql()}")


def c7(spark, d):
    """Core means as features: the run's metrics per marker."""
    out = CB.calibration_run(splits(spark, d, "train"), splits(spark, d, "val"), P, MODEL, core_mean=True)
    return out["marker_metrics"].select("channel", "name", "n_eval_cells", "positive_fraction", "auc_raw", "ap_raw", "train_best_raw_threshold", "balanced_acc_train_best_raw_threshold", "f1_train_best_raw_threshold")


def _raw_metrics_sql():
    """What the run says of the raw scores, with the operating cut from the training cells."""
    ev = long_sql(src="ev", phenotypes=False).replace("long as (", "evl as (", 1)
    return (
        f"with {CELLS}, {MANIFEST}, tr as (select cells.* from cells join cores using (basename) where split = 'train'), ev as (select cells.* from cells join cores using (basename) where split = 'val'), "
        f"{long_sql(src='tr', phenotypes=False)}, {pr_sql(KEY)}, {_best.format(k=_k)}, cut as (select name, score as cut from br where r_ = 1), {ev}, {pr_sql(KEY, src='evl', tag='e')}, "
        f"rk as (select name, max(t) as n, max(p) as np, case when {BOTH} then {_AUC} end as auc, case when {BOTH} then {_AP} end as ap from pre group by {_k}), "
        "cf as (select name, cut, sum(cast(y and score > cut as int)) as tp, sum(cast(not y and score > cut as int)) as fp, sum(cast(y and not score > cut as int)) as fn, sum(cast(not y and not score > cut as int)) as tn "
        "from evl join cut using (name) group by 1, 2), "
        "nm as (" + " union all ".join(f"select cast({c} as bigint) as channel, '{n}' as name" for n, c in P.pairs) + ") "
        f"select channel, name, cast(n as bigint) as n_eval_cells, {r6('np/cast(n as double)', 'positive_fraction')}, {r6('auc', 'auc_raw')}, {r6('ap', 'ap_raw')}, {r6('cut', 'train_best_raw_threshold')}, "
        f"{r6('(tp/cast(tp+fn as double)+tn/cast(tn+fp as double))/2', 'balanced_acc_train_best_raw_threshold')}, {r6('2.0*tp/(2*tp+fp+fn)', 'f1_train_best_raw_threshold')} from rk join cf using (name) join nm using (name)")


add("c7_calibration_run", c7, _raw_metrics_sql())


def c7_control(spark, d):
    """Neighbour features on, real and shuffled: both arms at their optimum, with the counts that shuffling leaves."""
    arms = CB.calibration_with_control(splits(spark, d, "train"), splits(spark, d, "val"), 11, P, MODEL, ks=(4, 16), features=("mean", "posfrac"))
    rows = [optimum(out["train"], out["eval"]).withColumn("arm", F.lit(arm)) for arm, out in arms.items()]
    return rows[0].unionByName(rows[1])


add("c7_shuffle_control", c7_control,
    f"with {CELLS}, {MANIFEST} " + " union all ".join(_optimum_sql(f"'{arm}' as arm, ") for arm in ("real", "shuffled")))

# ---- sampling

add("t1_head", lambda s, d: SM.head(D.cells(s, d), "ccOC_TMA2__B-2", 25, ["cell_id", "ch27_true"]),
    f"with {CELLS} select cell_id, {r6('ch27_true', 'ch27_true')} from cells where basename='ccOC_TMA2__B-2' order by cell_id limit 25")
add("t2_top_by_abs",
    lambda s, d: SM.top_by_abs(
        D.cells(s, d).withColumn("gap", F.col(ch(27, "pred", MODEL)) - F.col("ch27_pos").cast("int")).select("basename", "cell_id", "gap"), "gap", 20, ["cell_id"]),
    f"with {CELLS} select basename, cell_id, {r6('gap', 'gap')} from (select *, ch27_pred_{MODEL}-cast(ch27_pos as int) as gap from cells) order by abs(gap) desc, cell_id limit 20")
def _draw(seed, *keys):
    return f"md5(concat_ws('|', {', '.join(keys)}, '{seed}'))"


add("t3_sample_rows", lambda s, d: SM.sample_rows(D.cells(s, d).select("basename", "cell_id"), 500, 3),
    f"with {CELLS} select basename, cell_id from cells order by {_draw(3, 'basename', 'cell_id')}, basename, cell_id limit 500")
add("t4_epoch_sample", lambda s, d: SM.epoch_sample(D.cells(s, d).select("basename", "cell_id"), 500, 3, 4),
    f"with {CELLS} select basename, cell_id from cells order by {_draw(7, 'basename', 'cell_id')}, basename, cell_id limit 500")
_v3 = D.votes_sql(3)
add("t5_stratified_sample",
    lambda s, d: SM.stratified_sample(
        L.disagreement_strata(D.cells(s, d), "CD45", D.TAUS[3], P).select("basename", "cell_id", "stratum"), "stratum", 40, 5),
    f"""with {CELLS}, t as (select basename, cell_id, case when {D.total_sql(3)}=3 then 'all_three_pos' when {D.total_sql(3)}=0 then 'all_three_neg'
    when {D.total_sql(3)}=2 then 'split_decision_2of3_pos' when {_v3['gmm']} then 'gmm_only_pos' when {_v3['otsu']} then 'otsu_only_pos'
    else 'quantile_only_pos' end as stratum from cells), r as (select *, row_number() over (partition by stratum order by {_draw(5, 'basename', 'cell_id')}, basename, cell_id) as rn from t)
    select basename, cell_id, stratum from r where rn <= 40""")


def t6(spark, d, n=60):
    from catalog.table_queries import tile_pixels
    from cellframe.operators.regions import positive_tiles

    tiles = positive_tiles(tile_pixels(spark, d), 9.0, 0.6).select("basename", "tile_y", "tile_x", "positive", "channel")
    return SM.weighted_positive_sample(tiles, n, 0.5, {c: float(i) for i, c in enumerate(P.channels)}, 11, ["basename", "tile_y", "tile_x"])


def t6_sql(n):
    """Positives by weighted draw, negatives and weightless positives by plain draw; each side fills up the other."""
    from catalog.table_queries import _tp

    u = f"((('0x' || substr({_draw(11, 'basename', 'tile_y', 'tile_x')}, 1, 13))::bigint::double + 0.5) / {float(1 << 52)})"
    w = "case channel " + " ".join(f"when {c} then {float(i)}" for i, c in enumerate(P.channels)) + " end"
    return f"""with {CELLS}, {_tp}, sh as (select basename, tile_y, tile_x, channel, avg(cast(value > 9.0 as int)) as share from tp group by 1,2,3,4),
    bt as (select basename, tile_y, tile_x, bool_or(share >= 0.6) as positive, arg_max(channel, (share, channel)) as channel from sh group by 1,2,3),
    kd as (select *, case when not positive then 1 when {w} > 0 then 0 else 2 end as kind, -ln({u}) / case when positive and {w} > 0 then {w} else 1.0 end as draw from bt),
    hv as (select count(*) filter (kind = 0) as n0, count(*) filter (kind = 1) as n1, count(*) filter (kind = 2) as n2 from kd),
    tk as (select least(n0, greatest({round(n * 0.5)}, {n} - n1)) as k0, n1, n2 from hv),
    tl as (select k0, least(n1, {n} - k0) as k1, least(n2, {n} - k0 - least(n1, {n} - k0)) as k2 from tk),
    rk as (select *, row_number() over (partition by kind order by draw, basename, tile_y, tile_x) as rn from kd)
    select basename, tile_y, tile_x, positive, cast(channel as bigint) as channel from rk, tl where rn <= case kind when 0 then k0 when 1 then k1 else k2 end"""


add("t6_weighted_positive_sample", t6, t6_sql(60))
add("t6_short_of_positives", lambda s, d: t6(s, d, 700), t6_sql(700))

# ---- exports


def k10(spark, d):
    """Metric rows with different columns written as one CSV and read back."""
    path = f"{scratch_folder(spark, 'metrics')}/metrics.csv"
    sinks.write_metric_rows([
        M.marker_metrics(D.cells(spark, d), MODEL, P).select("name", "ap"),
        M.phenotype_metrics(D.scored(spark, d), MODEL, P).select("name", "ap", "auc")], path)
    return spark.read.option("header", True).schema("name string, ap double, auc double").csv(path)


add("k10_metric_rows", k10,
    f"with {SCORED}, {long_sql()}, {pr_sql(KEY)} select name, {r6(_AP, 'ap')}, case when kind='phenotype' then {r6(_AUC)} end as auc from pr group by {_k}")
def matrix(spark, d, name):
    """One table of the written matrix folder."""
    folder = scratch_folder(spark, "matrix")
    sinks.write_matrix(D.scored(spark, d), MODEL, folder, P)
    return spark.read.parquet(f"{folder}/{name}.parquet")


add("k11_export_matrix_obs", lambda s, d: matrix(s, d, "obs").select("basename", "cell_id", "centroid_x", "centroid_y", *[ph(n, "label") for n in PN], *[ph(n, "call", MODEL) for n in PN]),
    f"with {SCORED} select basename, cell_id, centroid_x, centroid_y, " + ", ".join(f"cast(phenotype_{n}_label as bigint) as phenotype_{n}_label, cast(phenotype_{n}_call_{MODEL} as bigint) as phenotype_{n}_call_{MODEL}" for n in PN) + " from scored")
add("k11_export_matrix_layer", lambda s, d: matrix(s, d, f"pred_{MODEL}"),
    f"with {CELLS} " + " union all ".join(f"select basename, cell_id, cast({c} as bigint) as channel, round(cast(cast({cc(c)}_pred_{MODEL} as float) as double), 6) + 0.0 as value from cells" for c in P.channels))
add("k11_export_matrix_var", lambda s, d: matrix(s, d, "var"),
    f"with {CELLS} " + " union all ".join(f"select cast({i} as bigint) as position, cast({c} as bigint) as channel, '{n}' as name, {r6(f'avg(cast({cc(c)}_pos as int))', 'prevalence')} from cells" for i, (n, c) in enumerate(P.pairs)))
add("k11_export_matrix_x", lambda s, d: matrix(s, d, "X"),
    f"with {CELLS} " + " union all ".join(f"select basename, cell_id, cast({c} as bigint) as channel, cast(cast({cc(c)}_pos as int) as double) as value from cells" for c in P.channels))
