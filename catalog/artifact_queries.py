"""Queries that derive an artifact from the tables, write it, and read it back through its loader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import derived as D
from catalog.derived import CELLS, MANIFEST, MODEL, P, SCORED, cc, r6
from catalog.metric_queries import KEY, _AP, _best, _k, long_sql, pr_sql
from catalog.registry import add
from catalog.stat_queries import MERGED, splits
from cellframe.functions.running import group_quantiles
from cellframe.operators import calibrate as CB
from cellframe.operators import labels as L
from cellframe.operators import metrics as M
from cellframe.panel import ch
from cellframe.plans import bundle as PL
from cellframe.session import scratch_folder
from cellframe.sources import artifacts, sinks


def stored(df: DataFrame, name: str) -> str:
    """Write a one-row JSON document and give its path."""
    path = scratch_folder(df.sparkSession, name)
    sinks.write_json_rows(df.select(F.to_json(F.struct("*")).alias("value")), path)
    return path


def s4(spark, d):
    cuts = group_quantiles(
        L.melt_values(splits(spark, d, "train"), P), ["channel"], "v", {"otsu": 0.7, "gmm": 0.8, "quantile": 0.9})
    table = F.map_from_entries(F.collect_list(F.struct(
        F.col("channel").cast("string"), F.create_map(*[x for m in ("otsu", "gmm", "quantile") for x in (F.lit(m), F.col(m))]))))
    path = scratch_folder(spark, "cohort")
    sinks.write_json_rows(cuts.agg(F.to_json(table).alias("value")), path)
    return artifacts.load_cohort_thresholds(spark, path)


_tr = f"{CELLS}, {MANIFEST}, tr as (select * from cells where basename in (select basename from cores where split='train'))"
add("s4_load_cohort_thresholds", s4,
    f"with {_tr} " + " union all ".join(
        f"select cast({c} as bigint) as channel, '{m}' as method, {r6(f'quantile_cont({cc(c)}_true, {q})', 'value')} from tr"
        for c in P.channels for m, q in (("otsu", 0.7), ("gmm", 0.8), ("quantile", 0.9))))


def artifact(spark, d):
    df = D.scored(spark, d)
    mk = M.marker_metrics(df, MODEL, P).select("name", F.col("best_threshold").alias("threshold"), "ap")
    channel = F.lit(None).cast("int")
    for n, c in P.pairs:
        channel = F.when(F.col("name") == n, F.lit(c)).otherwise(channel)
    fk = M.phenotype_metrics(df, MODEL, P).select("name", F.col("best_threshold").alias("threshold"), "ap")
    out = CB.threshold_artifact(mk.withColumn("channel", channel), fk, {"source": "derived"})
    return out.withColumn("provenance", F.from_json("provenance", "map<string,string>"))


def s5(spark, d):
    return artifacts.load_threshold_artifact(spark, stored(artifact(spark, d), "thresholds"), P)


_ap = "sum(cast(tp as double)*rtp/rn)/max(p)"
add("s5_load_threshold_artifact", s5,
    f"with {SCORED}, {long_sql()}, {pr_sql(KEY)}, {_best.format(k=_k)}, ap as (select {_k}, {_ap} as ap from pr group by {_k}) "
    f"select kind, name, {r6('score', 'threshold')}, case when ap>=0.70 then 'strong' when ap>=0.55 then 'moderate' else 'weak' end as confidence "
    f"from ap join (select {_k}, score from br where r_=1) using ({_k})")


def s6(spark, d):
    rows = L.melt_values(splits(spark, d, "train"), P).groupBy("channel").agg(
        F.avg("v").alias("threshold"), F.avg((F.col("v") > 9.0).cast("double")).alias("train_positive_fraction"))
    rows = rows.withColumn("train_positive_fraction", F.when(F.col("channel") != 0, F.col("train_positive_fraction")))
    doc = rows.agg(F.sort_array(F.collect_list(F.struct("channel", "threshold", "train_positive_fraction"))).alias("thresholds"))
    return artifacts.load_threshold_rows(spark, stored(doc, "threshold-rows"), P.channels)


add("s6_load_threshold_rows", s6,
    f"with {_tr} " + " union all ".join(
        f"select cast({c} as bigint) as channel, {r6(f'avg({cc(c)}_true)', 'threshold')}, "
        + (r6(f"avg(cast({cc(c)}_true > 9.0 as int))", "train_positive_fraction") if c else "0.1e0 as train_positive_fraction") + " from tr" for c in P.channels))


def s7(spark, d):
    """Metadata of the two models, with the number of cells each covers in the notes."""
    n = D.cells(spark, d).agg(F.count("*").alias("n")).withColumn("id", F.lit(MODEL)).unionByName(
        D.model2(spark, d).agg(F.count("*").alias("n")).withColumn("id", F.lit(D.MODEL2)))
    entry = F.struct(
        "id", F.concat(F.lit("Model "), "id").alias("name"), F.lit("vit").alias("backbone"), F.lit("train").alias("training_split"),
        F.create_map(F.lit("cells"), F.col("n").cast("string")).alias("provenance"), F.col("n").cast("string").alias("notes"))
    doc = n.agg(F.lit(1).alias("schema_version"), F.collect_list(entry).alias("models"))
    return artifacts.load_model_metadata(spark, stored(doc, "models"), [MODEL, D.MODEL2]).select("id", "name", "notes")


add("s7_load_model_metadata", s7,
    f"with {CELLS} select '{MODEL}' as id, 'Model {MODEL}' as name, cast(count(*) as varchar) as notes from cells union all "
    f"select '{D.MODEL2}', 'Model {D.MODEL2}', cast(count(*) as varchar) from cells where {D.MODEL2_COVER}")


def s8(spark, d):
    q = group_quantiles(L.melt_values(D.cells(spark, d), P), ["channel"], "v", {"qlo": 0.01, "qhi": 0.99})
    pairs = F.sort_array(F.collect_list(F.struct("channel", "qlo", "qhi")))
    doc = q.agg(pairs.alias("p")).select(
        F.size("p").alias("C"), F.transform("p", lambda x: x["qlo"]).alias("qlo"), F.transform("p", lambda x: x["qhi"]).alias("qhi"))
    return artifacts.load_quantile_scaler(spark, stored(doc, "scaler"))


add("s8_load_quantile_scaler", s8,
    f"with {CELLS} " + " union all ".join(
        f"select cast({i} as bigint) as channel, {r6(f'quantile_cont({cc(c)}_true, 0.01)', 'qlo')}, {r6(f'quantile_cont({cc(c)}_true, 0.99)', 'qhi')} from cells"
        for i, c in enumerate(sorted(P.channels))))


def rebuilt(spark, d):
    """Two models added to the bundle; the registry carries their metrics, the default first."""
    from cellframe.sources.tables import Bundle

    cells = D.scored(spark, d)
    keep = ["basename", "cell_id", *[ch(c, "pos") for c in P.channels], *[f"phenotype_{n}_label" for n in P.phenotypes]]
    first = cells.select("basename", "cell_id", *[ch(c, "pred", MODEL) for c in P.channels])
    meta = cells.agg(F.count("*").alias("n_cells"))
    meta = meta.select(F.explode(F.array(F.lit(MODEL), F.lit(D.MODEL2))).alias("id"), "n_cells")
    _, registry = PL.rebuild_cell_tables(
        Bundle(cells=cells.select(*keep), cores=D.manifest(spark, d)),
        [(MODEL, first), (D.MODEL2, D.model2(spark, d))], meta, D.THR, D.MODEL2, P)
    return registry.select("id", "position", "macro_marker_ap", "macro_phenotype_ap", F.size("per_marker_ap").alias("n_markers"), "n_cells")


def _registry_sql():
    """Macro means of both models, each over the names with a positive cell."""
    second = long_sql(D.MODEL2, "merged", channels=D.MODEL2_CHANNELS).replace("long as (", "long2 as (", 1)
    ap = lambda tag: f"select {_k}, {_AP} as ap from pr{tag} group by {_k} having max(p) > 0"
    one = lambda name, position, tag: (
        f"select '{name}' as id, cast({position} as bigint) as position, {r6(f'(select avg(ap) from m{tag} where kind = $$marker$$)', 'macro_marker_ap')}, "
        f"{r6(f'(select avg(ap) from m{tag} where kind = $$phenotype$$)', 'macro_phenotype_ap')}, (select count(*) from m{tag} where kind = 'marker') as n_markers, (select count(*) from cells) as n_cells")
    return (
        f"with {MERGED}, {SCORED.removeprefix(CELLS + ', ')}, {long_sql()}, {second}, {pr_sql(KEY)}, {pr_sql(KEY, src='long2', tag='2')}, "
        f"m as ({ap('')}), m2x as ({ap('2')}) " + one(MODEL, 1, "") + " union all " + one(D.MODEL2, 0, "2x"))


add("j3_rebuild_registry", rebuilt, _registry_sql())
