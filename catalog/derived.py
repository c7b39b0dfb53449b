"""The cell tables derived from the ``events`` table, for Spark and as SQL text.

One event is one cell. The SQL text is shared by both engines, so a query and
its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.operators import rules
from cellframe.panel import DEFAULT_PANEL, Thresholds
from cellframe.session import bound_methods, dealt

P = DEFAULT_PANEL
MODEL = "v1_1"
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
SIDE = 2950

STRATA_CYCLE = ("strong", "moderate", "weak")
THR = Thresholds(
    marker={n: round(0.30 + 0.01 * i, 2) for i, n in enumerate(P.names)},
    phenotype={n: round(0.35 + 0.02 * i, 2) for i, n in enumerate(P.phenotypes)},
    marker_confidence={n: STRATA_CYCLE[i % 3] for i, n in enumerate(P.names)},
    phenotype_confidence={n: STRATA_CYCLE[(i + 1) % 3] for i, n in enumerate(P.phenotypes)},
    provenance={"source": "derived"},
)


def cc(channel: int) -> str:
    return f"ch{channel:02d}"


def _base(text: str) -> list[str]:
    cols = [
        "event_id as cell_id",
        f"concat(case when k%2=0 then 'ccRCC' else 'ccOC' end, '_TMA', cast(k%3+1 as {text}), '__', "
        f"chr(cast(65+k%6 as int)), '-', cast(k+1 as {text})) as basename",
        f"cast((event_id*7919 + k*131) % {SIDE} as bigint) as centroid_x",
        f"cast(((event_id%3571)*(event_id%2089) + k*17) % {SIDE} as bigint) as centroid_y",
        "cast(k as bigint) as core_no",
    ]
    for c in P.channels:
        t = EVENT_TYPES[c % 5]
        cols.append(
            f"cast(((event_id*({c}+11)*37) % 1009)/cast(100 as double) "
            f"+ case when event_type = '{t}' then 8.0 else 0.0 end as double) as {cc(c)}_true"
        )
        cols.append(
            f"cast(((event_id*({c}+3)*41) % 997)/cast(997 as double) as double) as {cc(c)}_noise"
        )
    return cols


def _prob(c: int, signal: float, noise: float) -> str:
    """A probability on a fixed grid, in plain arithmetic that both engines share."""
    mix = f"{cc(c)}_true/20*cast({signal} as double) + {cc(c)}_noise*cast({noise} as double)"
    return f"(floor(least(1.0e0, greatest(0.0e0, {mix}))*1009.0e0 + 0.5e0)/1009.0e0)"


def _second() -> list[str]:
    cols = ["basename", "cell_id", "centroid_x", "centroid_y", "core_no"]
    for c in P.channels:
        cols += [
            f"{cc(c)}_true", f"{cc(c)}_noise",
            f"({cc(c)}_true > 9.0) as {cc(c)}_pos",
            f"{_prob(c, 0.6, 0.4)} as {cc(c)}_pred_{MODEL}",
        ]
    return cols


# ---------------------------------------------------------------- Spark side

#: Bytes of a table's files from which its rows are dealt out.
DEALT_BYTES = 1 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table out over the session's cores, or over as many tasks as ``cellframe.catalog.partitions`` names.

    The narrow rows of a table grow into wide cells after they are read, and Spark deals files out by their bytes: a few
    compressed MB, or a few row groups, would leave all of that to one or two tasks. Files of less than DEALT_BYTES stay.
    """
    n = df.sparkSession.conf.get("cellframe.catalog.partitions", None)
    if n:
        return df.repartition(int(n), key)
    return dealt(df, key) if stated_bytes(df) >= DEALT_BYTES else df


def stated_bytes(df: DataFrame) -> int:
    """The size Spark expects of a table, from its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PLANS: dict = {}
MOST_PLANS = 64


def planned(build):
    """Build each derived plan once per session and folder; the plan is lazy, no data is kept."""
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (build.__name__, spark.sparkContext.applicationId, sf_dir, spark.conf.get("cellframe.catalog.partitions", None))
        if key not in _PLANS:
            if len(_PLANS) >= MOST_PLANS:
                _PLANS.clear()
            _PLANS[key] = build(spark, sf_dir)
        return _PLANS[key]
    return get


@planned
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with intensities, labels and the predictions of the first model."""
    bound_methods(spark)
    e = spread(table(spark, sf_dir, "events"), "event_id").withColumn("k", F.expr("user_id % 30"))
    return e.selectExpr(*_base("string")).selectExpr(*_second())


@planned
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with phenotype labels, scores, calls and marker calls."""
    df = rules.phenotype_labels(cells(spark, sf_dir), P)
    df = rules.phenotype_scores(df, MODEL, P)
    df = rules.phenotype_calls(df, THR, MODEL, P)
    return rules.marker_calls(df, THR, MODEL, P)


@planned
def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, position and one dominant phenotype per cell: the input of the spatial operators."""
    df = rules.dominant_phenotype(scored(spark, sf_dir), MODEL, P)
    return df.select("basename", "cell_id", "centroid_x", "centroid_y", "dominant_phenotype")


@planned
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per core, found in the data."""
    k = cells(spark, sf_dir).select("basename", F.col("core_no").alias("k")).distinct()
    return k.selectExpr(*_manifest("string"))


@planned
def model2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a second model: nine channels, only where the nuclear stain is visible."""
    c = cells(spark, sf_dir).filter(MODEL2_COVER)
    return c.selectExpr(*_model2())


def _manifest(text: str) -> list[str]:
    return [
        "basename",
        "cast(k as bigint) as k",
        "case when k%2=0 then 'ccRCC' else 'ccOC' end as tissue",
        f"concat(case when k%2=0 then 'ccRCC' else 'ccOC' end, '_TMA', cast(k%3+1 as {text})) as tma",
        f"concat(chr(cast(65+k%6 as int)), '-', cast(k+1 as {text})) as core",
        "case when k%10<7 then 'train' when k%10<9 then 'val' else 'test' end as split",
        "cast((k*7)%40 + 0.5 as double) as rigid_D_px",
        f"cast({SIDE} as bigint) as height", f"cast({SIDE} as bigint) as width",
        "case when k%11=3 then 'fail' when k%7=2 then 'bad_alignment' when k%3=0 then 'cached' else 'ok' end as status",
    ]


MODEL2 = "m2"
MODEL2_COVER = "ch00_true >= 2.0"
MODEL2_CHANNELS = P.channels[:9]


def _model2() -> list[str]:
    return ["basename", "cell_id"] + [
        f"{_prob(c, 0.5, 0.5)} as {cc(c)}_pred_{MODEL2}"
        for c in MODEL2_CHANNELS
    ]


@planned
def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed diamond around every cell with a visible nucleus."""
    c = cells(spark, sf_dir).filter(f"not ({TINY})")
    return c.selectExpr(
        "basename", "cell_id", "cast(centroid_y as double) as centroid_y", "cast(centroid_x as double) as centroid_x",
        f"cell_id % 5 + 2 as r",
    ).selectExpr(
        "basename", "cell_id", "centroid_y", "centroid_x",
        "array(array(centroid_x-r/2,centroid_y),array(centroid_x,centroid_y-r/2),array(centroid_x+r/2,centroid_y),"
        "array(centroid_x,centroid_y+r/2),array(centroid_x-r/2,centroid_y)) as nucleus_xy",
        "array(array(centroid_x-r,centroid_y),array(centroid_x,centroid_y-r),array(centroid_x+r,centroid_y),"
        "array(centroid_x,centroid_y+r),array(centroid_x-r,centroid_y)) as expanded_xy",
        "r*r/2.0e0 as area_nucleus_px", "2.0e0*r*r as area_expanded_px",
        "4 as n_verts_nucleus", "4 as n_verts_expanded", "'' as flags",
    )


@planned
def skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).filter(TINY).selectExpr(
        "basename", "cell_id", "'tiny' as reason", "3.0e0 as area_nucleus_px", "9.0e0 as area_expanded_px"
    )


@planned
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus columns on their own, as a labelling run leaves them."""
    from cellframe.operators.labels import consensus_labels

    out = consensus_labels(cells(spark, sf_dir), TAUS, 2, P)
    names = [f"{cc(c)}_pos_{x}" for c in P.channels for x in ("consensus", "disagree", "gmm_orig")]
    return out.select("basename", "cell_id", *names)


TINY = "ch00_noise < 0.02"
TAUS = {
    c: {"gmm": round(9.0 + 0.05 * i, 2), "otsu": 8.4, "quantile": 10.0, "gmm_existing": 8.8}
    for i, c in enumerate(P.channels)
}

# ---------------------------------------------------------------- SQL side

CELLS = (
    "e as (select *, user_id % 30 as k from events), "
    "cells0 as (select " + ", ".join(_base("varchar")) + " from e), "
    "cells as (select " + ", ".join(_second()) + " from cells0)"
)
MANIFEST = (
    "mk as (select distinct basename, core_no as k from cells), "
    "cores as (select " + ", ".join(_manifest("varchar")) + " from mk)"
)
MODEL2_SQL = "preds2 as (select " + ", ".join(_model2()) + f" from cells where {MODEL2_COVER})"

# Phenotype rules as SQL over the columns {name}_p of the markers.
_AND = "({a}*{b})"
_OR = "(1.0-(1.0-{a})*(1.0-{b}))"


def score_sql(col: dict[str, str]) -> dict[str, str]:
    """Phenotype score expressions from one probability expression per marker name."""
    tumor = _OR.format(a=col["CA9"], b=col["panCK"])
    return {
        "immune_cd45": col["CD45"],
        "t_cell_cd45_cd8": _AND.format(a=col["CD45"], b=col["CD8"]),
        "tumor_ca9_or_panck": tumor,
        "macrophage_cd68_or_cd163": _OR.format(a=col["CD68"], b=col["CD163"]),
        "m2_like_cd68_cd163": _AND.format(a=col["CD68"], b=col["CD163"]),
        "caf_fap_or_asma": _OR.format(a=col["FAP"], b=col["aSMA"]),
        "proliferating_ki67": col["Ki67"],
        "pdl1_positive": col["PDL1"],
        "pdl1_tumor_like": f"({col['PDL1']}*{tumor})",
    }


def label_sql(suffix: str = "pos") -> dict[str, str]:
    m = {n: f"{cc(c)}_{suffix}" for n, c in P.pairs}
    return {
        "immune_cd45": m["CD45"],
        "t_cell_cd45_cd8": f"({m['CD45']} and {m['CD8']})",
        "tumor_ca9_or_panck": f"({m['CA9']} or {m['panCK']})",
        "macrophage_cd68_or_cd163": f"({m['CD68']} or {m['CD163']})",
        "m2_like_cd68_cd163": f"({m['CD68']} and {m['CD163']})",
        "caf_fap_or_asma": f"({m['FAP']} or {m['aSMA']})",
        "proliferating_ki67": m["Ki67"],
        "pdl1_positive": m["PDL1"],
        "pdl1_tumor_like": f"({m['PDL1']} and ({m['CA9']} or {m['panCK']}))",
    }


def _pred(n: str, c: int) -> str:
    return f"{cc(c)}_pred_{MODEL}"


_SCORES = score_sql({n: _pred(n, c) for n, c in P.pairs})
_LABELS = label_sql()
SCORED = (
    CELLS
    + ", scored0 as (select *, "
    + ", ".join(f"{e} as phenotype_{n}_score_{MODEL}" for n, e in _SCORES.items())
    + ", "
    + ", ".join(f"{e} as phenotype_{n}_label" for n, e in _LABELS.items())
    + " from cells), scored as (select *, "
    + ", ".join(
        f"cast(cast(phenotype_{n}_score_{MODEL} as float) >= cast({THR.phenotype[n]} as float) as int) "
        f"as phenotype_{n}_call_{MODEL}"
        for n in P.phenotypes
    )
    + ", "
    + ", ".join(
        f"cast(cast({_pred(n, c)} as float) >= cast({THR.marker[n]} as float) as int) as {cc(c)}_call_{MODEL}"
        for n, c in P.pairs
    )
    + " from scored0)"
)


def _dominant() -> str:
    gated = [
        f"case when phenotype_{n}_call_{MODEL} = 1 then cast(phenotype_{n}_score_{MODEL} as float) end"
        for n in P.phenotypes
    ]
    best = "greatest(" + ", ".join(gated) + ")"
    whens = " ".join(f"when ({g}) = best then '{n}'" for g, n in zip(gated, P.phenotypes))
    return (
        f"dom0 as (select *, {best} as best from scored), "
        f"typed as (select basename, cell_id, centroid_x, centroid_y, "
        f"case {whens} else 'background' end as dominant_phenotype from dom0)"
    )


TYPED = SCORED + ", " + _dominant()


def r6(expr: str, alias: str | None = None) -> str:
    """A double rounded like :func:`tidy` does."""
    text = f"(round(cast({expr} as double), 6) + 0.0)"
    return f"{text} as {alias}" if alias else text


def rounded6(c: Column) -> Column:
    """``F.round(c, 6)`` of a finite double, without going through its decimal text where the scaled value is no near tie."""
    scaled = c * F.lit(1e6)
    whole = F.rint(scaled)
    clear = (F.abs(scaled) < F.lit(float(1 << 40))) & (F.abs(scaled - whole) < F.lit(0.499))
    # the quotient of two whole numbers is the double next to the rounded decimal
    return F.when(clear, whole / F.lit(1e6)).otherwise(F.round(c, 6))


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles rounded with NaN as null, integers as bigint, arrays as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = c.cast("double")
            c = F.when(F.abs(c) < F.lit(float("inf")), rounded6(c) + F.lit(0.0))
        elif kind in ("tinyint", "smallint", "int", "bigint"):
            c = c.cast("bigint")
        elif kind.startswith("array<"):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        out.append(c.alias(name))
    return df.select(*out)


def votes_sql(c: int) -> dict[str, str]:
    t = TAUS[c]
    return {m: f"({cc(c)}_true > {t[m]})" for m in ("gmm", "otsu", "quantile")}


def total_sql(c: int) -> str:
    return "(" + "+".join(f"cast({v} as int)" for v in votes_sql(c).values()) + ")"


POLYGONS = (
    f"polys as (select basename, cell_id, cast(centroid_y as double) as centroid_y, "
    f"cast(centroid_x as double) as centroid_x, cell_id % 5 + 2 as r, "
    f"(cell_id % 5 + 2)*(cell_id % 5 + 2)/2.0 as area_nucleus_px, 2.0*(cell_id % 5 + 2)*(cell_id % 5 + 2) as area_expanded_px "
    f"from cells where not ({TINY})), "
    f"skips as (select basename, cell_id from cells where {TINY})"
)


def edges_sql(radius: float | None = None, k: int = 16, table: str = "typed") -> str:
    """CTE ``edges`` (with ``rank`` for the nearest-neighbour graph)."""
    pairs = (
        f"select a.basename, a.cell_id as src_cell_id, b.cell_id as dst_cell_id, "
        f"a.dominant_phenotype as src_phenotype, b.dominant_phenotype as dst_phenotype, "
        f"(a.centroid_x-b.centroid_x)*(a.centroid_x-b.centroid_x)+(a.centroid_y-b.centroid_y)*(a.centroid_y-b.centroid_y) as d2 "
        f"from {table} a join {table} b on a.basename=b.basename and a.cell_id<>b.cell_id"
    )
    if radius is not None:
        return (
            f"pairs as ({pairs}), edges as (select *, sqrt(cast(d2 as double)) as distance_px from pairs "
            f"where d2 <= {radius * radius})"
        )
    return (
        f"pairs as ({pairs}), ranked as (select *, row_number() over (partition by basename, src_cell_id "
        f"order by d2, dst_cell_id) as rank from pairs), "
        f"edges as (select *, sqrt(cast(d2 as double)) as distance_px from ranked where rank <= {k})"
    )
