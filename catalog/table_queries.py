"""Queries over pixel, region and tile tables, quality checks, set operations and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import derived as D
from catalog.derived import CELLS, MANIFEST, MODEL, P, SCORED, THR, cc, r6
from catalog.registry import add
from catalog.stat_queries import splits
from cellframe.operators import joins as J
from cellframe.operators import quality as Q
from cellframe.operators import regions as RE
from cellframe.operators import rules as R
from cellframe.operators.spatial import polygons as PG
from cellframe.session import scratch_folder
from cellframe.sources import sinks, tables, versions

# ---- pixels: an 8 x 8 block round every cell, in the label image of its core

#: Side of the squares an image is painted by, and the bytes of cells a task paints: their pixels are fifty times as many.
PAINT_TILE, PAINT_BYTES = 128, 1 << 18
PAINT_KEY = ("ty", "tx")


def nuclei(spark, d):
    return D.cells(spark, d).select("basename", "cell_id", "centroid_x", "centroid_y", "ch27_true")


def painted(c, *keep):
    """The 64 pixels of every cell's block."""
    px = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    return px.select(
        "basename", F.pmod(F.col("centroid_y") + F.col("i"), F.lit(D.SIDE)).alias("y"), F.pmod(F.col("centroid_x") + F.col("j"), F.lit(D.SIDE)).alias("x"),
        (F.col("cell_id") + 1).alias("label"), F.floor(F.col("ch27_true") * 40 + F.col("i") * 3 + F.col("j")).alias("value"), *keep)


def pixels(spark, d):
    """Pixel table of all cells; a later cell overwrites an earlier one, as in a label image."""
    return painted(nuclei(spark, d))


def image(spark, d):
    """The label image, painted tile by tile: cells go to the tiles their block touches, so no pixel is sent."""
    return image_tiles(spark, d).drop(*PAINT_KEY)


def image_tiles(spark, d):
    """The pixels of :func:`image` with the tile they lie in, which they are dealt out by.

    The number of tasks follows the cells read; adaptive execution would merge cells that are few bytes but many pixels.
    """
    def tile(c):
        return F.coalesce(F.floor(c / F.lit(PAINT_TILE)), F.lit(-1))

    def touched(c):
        return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: tile(F.pmod(F.col(c) + i, F.lit(D.SIDE))))))

    cells = nuclei(spark, d)
    tasks = max(spark.sparkContext.defaultParallelism, D.stated_bytes(D.table(spark, d, "events")) // PAINT_BYTES)
    dealt = cells.withColumn("ty", touched("centroid_y")).withColumn("tx", touched("centroid_x")).repartition(tasks, "basename", *PAINT_KEY)
    px = painted(dealt, *PAINT_KEY).where((F.col("ty") == tile(F.col("y"))) & (F.col("tx") == tile(F.col("x"))))
    return px.groupBy("basename", *PAINT_KEY, "y", "x").agg(F.max("label").alias("label"), F.max("value").alias("value"))


def nuclear(pixels):
    """The nucleus mask: the pixels on even diagonals."""
    return pixels.filter((F.col("x") + F.col("y")) % 2 == 0)


def inner(spark, d):
    return nuclear(image(spark, d))


def ring(spark, d):
    """The ring's pixels; both masks lie dealt by tile, so neither is sent."""
    return RE.ring_compartment(image_tiles(spark, d), nuclear(image_tiles(spark, d)), PAINT_KEY)


def regions(spark, d):
    return RE.region_properties(image(spark, d))


PX = (
    f"{CELLS}, i_ as (select range as i from range(8)), j_ as (select range as j from range(8)), px as (select basename, (centroid_y+i)%{D.SIDE} as y, (centroid_x+j)%{D.SIDE} as x, "
    "cell_id+1 as label, cast(floor(ch27_true*40+i*3+j) as bigint) as value from cells, i_, j_), "
    "image as (select basename, y, x, max(label) as label, max(value) as value from px group by 1,2,3)"
)
REG = PX + ", reg as (select basename, label, count(*) as area, avg(y) as centroid_y, avg(x) as centroid_x, min(y) as min_y, min(x) as min_x, max(y)+1 as max_y, max(x)+1 as max_x from image group by 1,2)"
add("r1_region_properties", regions,
    f"with {REG} select basename, label, area, {r6('centroid_y', 'centroid_y')}, {r6('centroid_x', 'centroid_x')}, min_y, min_x, max_y, max_x from reg")
add("r2_filter_regions", lambda s, d: RE.filter_regions(regions(s, d), 40, 63).select("basename", "label", "new_label"),
    f"with {REG} select basename, label, row_number() over (partition by basename order by label) as new_label from reg where area between 40 and 63")
add("r3_mask_summary", lambda s, d: RE.mask_summary(regions(s, d)),
    f"with {REG} select basename, count(*) as n_regions, {r6('avg(area)', 'mean_area')}, {r6('quantile_cont(area,0.5)', 'median_area')}, "
    f"{r6('quantile_cont(area,0.05)', 'p05_area')}, {r6('quantile_cont(area,0.95)', 'p95_area')} from reg group by 1")
add("r4_assert_nucleus_subset",
    lambda s, d: RE.assert_nucleus_subset(pixels(s, d), image(s, d).filter("value > 100")),
    f"with {PX} select distinct basename, label from px where (basename, label) not in (select basename, label from image where value > 100)")
add("r5_ring_compartment",
    lambda s, d: ring(s, d).groupBy("basename").agg(F.count("*").alias("n"), F.sum("x").alias("sx")),
    f"with {PX} select basename, count(*) as n, cast(sum(x) as bigint) as sx from image where (x+y)%2 <> 0 group by 1")


def r6q(spark, d):
    nuclei = RE.region_properties(inner(spark, d)).select("basename", F.col("label"), (F.col("area") - 8).alias("area"), (F.col("area") < 32).alias("has_contour"))
    return RE.classify_skips(D.cells(spark, d).withColumn("cell_id", F.col("cell_id") + 1), nuclei, regions(spark, d).filter("area > 20"))


add("r6_classify_skips", r6q,
    f"""with {REG}, nu as (select basename, label, count(*)-8 as area, count(*) < 32 as hc from image where (x+y)%2=0 group by 1,2),
    c as (select basename, cell_id+1 as cell_id from cells)
    select c.basename, c.cell_id, case when nu.area is null or reg.area is null then 'out_of_mask' when nu.area <= 4 then 'tiny' when not hc then 'empty' end as reason,
    coalesce(cast(nu.area as double),0.0) as area_nucleus_px, coalesce(cast(reg.area as double),0.0) as area_expanded_px
    from c left join nu on c.basename=nu.basename and c.cell_id=nu.label left join (select * from reg where area > 20) reg on c.basename=reg.basename and c.cell_id=reg.label""")
add("r7_cap_ring",
    lambda s, d: PG.cap_ring(D.polygons(s, d), "expanded_xy", F.lit(D.SIDE), F.lit(D.SIDE)).select(
        "basename", "cell_id", "n_verts", "flags", "degenerate",
        F.aggregate("expanded_xy", F.lit(0.0), lambda a, p: a + p[0] + p[1]).alias("total")),
    f"""with {CELLS}, {D.POLYGONS}, v as (select basename, cell_id, centroid_x as x, centroid_y as y, r from polys)
    select basename, cell_id, cast(4 as bigint) as n_verts, case when x-r<0 or y-r<0 or x+r>{D.SIDE - 1} or y+r>{D.SIDE - 1} then 'border' else '' end as flags, false as degenerate,
    cast(2*greatest(x-r,0.0)+least(x+r,{D.SIDE - 1})+2*x+3*y+greatest(y-r,0.0)+least(y+r,{D.SIDE - 1}) as double) as total from v""")


def long_rings(spark, d):
    """Rings of 5 to 200 vertices on a circle around every cell, some of them over the image's border."""
    c = D.cells(spark, d).select("basename", "cell_id", "centroid_x", "centroid_y", (F.col("cell_id") % 196 + 5).alias("m"))
    angle = lambda i: i * F.lit(6.283185307179586) / F.col("m")
    point = lambda i: F.array(F.col("centroid_x") + F.lit(40.0) * F.cos(angle(i)), F.col("centroid_y") + F.lit(40.0) * F.sin(angle(i)))
    return c.withColumn("ring", F.transform(F.sequence(F.lit(0), F.col("m").cast("int") - 1), point))


def ring_area(ring):
    """Area of a closed ring by the sums of its edges."""
    edge = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.get(ring, i - 1)[0] * F.get(ring, i)[1] - F.get(ring, i)[0] * F.get(ring, i - 1)[1])
    return F.abs(F.aggregate(edge, F.lit(0.0), lambda a, x: a + x)) / 2


def _clamped(axis, wave, j):
    return f"least({D.SIDE - 1}.0, greatest(0.0, centroid_{axis} + 40.0*{wave}(({j})*6.283185307179586/t)))"


def _ring_sql(keep):
    """Area of each circle after keeping ``keep`` vertices at most, as SQL."""
    return (
        "u as (select basename, cell_id, centroid_x, centroid_y, cell_id % 196 + 5 as t from cells), "
        # after clamping, a last vertex that equals the first within the relative tolerance of the operator closes the ring, as it is
        f"le as (select *, {_clamped('x', 'cos', 't-1')} as lx, {_clamped('y', 'sin', 't-1')} as ly, {_clamped('x', 'cos', '0')} as fx, {_clamped('y', 'sin', '0')} as fy from u), "
        "v as (select *, abs(fx-lx) <= 1e-8 + 1e-5*abs(lx) and abs(fy-ly) <= 1e-8 + 1e-5*abs(ly) as closed, t - cast(closed as int) as m from le), "
        f"i as (select *, least(m, {keep}) as k, unnest(range(0, least(m, {keep}))) as i from v), "
        "p as (select *, case when m > k then floor(i*m/cast(k as double)) else i end as j from i), "
        f"q as (select basename, cell_id, m, k, i, closed and m <= k as own, lx, ly, {_clamped('x', 'cos', 'j')} as x, {_clamped('y', 'sin', 'j')} as y from p), "
        "r as (select *, coalesce(lead(x) over w, case when own then lx else first_value(x) over w end) as x1, coalesce(lead(y) over w, case when own then ly else first_value(y) over w end) as y1 "
        "from q window w as (partition by basename, cell_id order by i rows between unbounded preceding and unbounded following)) "
    )


for _name, _most in (("r7_long_rings", None), ("r7_thinned_rings", 32)):
    add(_name,
        lambda s, d, most=_most: PG.cap_ring(long_rings(s, d), "ring", F.lit(D.SIDE), F.lit(D.SIDE), most).select(
            "basename", "cell_id", "n_verts", F.col("flags").contains("truncated").alias("truncated"), ring_area(F.col("ring")).alias("area")),
        f"with {CELLS}, {_ring_sql(_most or 1000)} select basename, cell_id, cast(max(k) as bigint) as n_verts, bool_or(m > k) as truncated, {r6('abs(sum(x*y1 - x1*y))/2', 'area')} from r group by 1,2")
add("r8_ring_bbox",
    lambda s, d: PG.ring_bbox(D.polygons(s, d), "expanded_xy").select("basename", "cell_id", "min_x", "min_y", "max_x", "max_y"),
    f"with {CELLS}, {D.POLYGONS} select basename, cell_id, centroid_x-r as min_x, centroid_y-r as min_y, centroid_x+r as max_x, centroid_y+r as max_y from polys")
add("r9_nonzero_window_rescale",
    lambda s, d: RE.nonzero_window_rescale(image(s, d), 1.0, 99.0, ["basename"]).groupBy("basename", "rescaled", "p_low", "p_high").agg(F.count("*").alias("n")),
    f"""with {PX}, w as (select basename, quantile_cont(value,0.01) as lo, quantile_cont(value,0.99) as hi from image where value>0 group by 1)
    select basename, cast(floor((least(greatest(value,lo),hi)-lo)/(hi-lo)*255.0e0+0.5e0) as bigint) as rescaled, {r6('lo', 'p_low')}, {r6('hi', 'p_high')}, count(*) as n
    from image join w using (basename) group by 1,2,lo,hi""")
add("r10_core_norm", lambda s, d: RE.core_norm(image(s, d)),
    f"with {PX} select basename, {r6('greatest(quantile_cont(value, 0.999), 1e-6)', 'norm')} from image group by 1")
add("r10_strided_norm", lambda s, d: RE.core_norm(image(s, d), 4),
    f"with {PX} select basename, {r6('greatest(quantile_cont(value, 0.999), 1e-6)', 'norm')} from image where x%4=0 and y%4=0 group by 1")
add("r11_percentile_window",
    lambda s, d: RE.percentile_window(image(s, d)).groupBy("basename").agg(F.avg("normalized").alias("mean"), F.count_if(F.col("normalized") >= 1.0).alias("saturated")),
    f"""with {PX}, w as (select basename, quantile_cont(value,0.005) as lo, quantile_cont(value,0.998) as hi from image group by 1),
    n as (select basename, least(1.0e0, greatest(0.0e0, (value-lo)/(hi-lo))) as v from image join w using (basename))
    select basename, {r6('avg(v)', 'mean')}, cast(sum(cast(v>=1.0 as int)) as bigint) as saturated from n group by 1""")

# ---- tiles

add("r12_tile_grid", lambda s, d: RE.tile_grid(D.manifest(s, d), 512, 256),
    f"with {CELLS}, {MANIFEST}, o as (select range as o from range(0, {D.SIDE - 512 + 1}, 256)) select basename, a.o as y0, b.o as x0 from cores, o a, o b")
TILE = 590


def tile_pixels(spark, d):
    """Marker pixels at the cell centres, filed under the tile they lie in."""
    c = D.cells(spark, d)
    rows = [{"channel": F.lit(k), "value": F.col(f"{cc(k)}_true")} for k in P.channels]
    from cellframe.functions.expr import stack_columns

    t = F.lit(TILE)
    return stack_columns(c, [
        "basename", (F.floor(F.col("centroid_y") / t) * t).alias("tile_y"), (F.floor(F.col("centroid_x") / t) * t).alias("tile_x"),
        (F.col("centroid_y") % t).alias("y"), (F.col("centroid_x") % t).alias("x")], rows)


_tp = (f"tp as (" + " union all ".join(
    f"select basename, centroid_y//{TILE}*{TILE} as tile_y, centroid_x//{TILE}*{TILE} as tile_x, centroid_y%{TILE} as y, centroid_x%{TILE} as x, {c} as channel, {cc(c)}_true as value from cells" for c in P.channels) + ")")
add("r13_positive_tiles",
    lambda s, d: RE.positive_tiles(tile_pixels(s, d), 9.0, 0.45, center=400, size=TILE).drop("channel"),
    f"with {CELLS}, {_tp}, sh as (select basename, tile_y, tile_x, channel, avg(cast(value > 9.0 as int)) as sh from tp where y between 95 and 494 and x between 95 and 494 group by 1,2,3,4) "
    f"select basename, tile_y, tile_x, bool_or(sh >= 0.45) as positive, {r6('max(sh)', 'max_share')} from sh group by 1,2,3")
WIN = 64


def overlapping(spark, d):
    """Every cell seen by the two tiles along x that cover it, each with its own prediction."""
    c = D.cells(spark, d)
    base = F.floor(F.col("centroid_x") / 32)
    return c.select(
        "basename", F.explode(F.array(base, F.greatest(base - 1, F.lit(0)))).alias("tx"), "centroid_x", "centroid_y", "ch27_true",
    ).distinct().select(
        "basename", (F.floor(F.col("centroid_y") / WIN) * WIN).alias("tile_y"), (F.col("tx") * 32).alias("tile_x"),
        (F.col("centroid_y") % WIN).alias("y"), (F.col("centroid_x") - F.col("tx") * 32).alias("x"), (F.col("ch27_true") + F.col("tx")).alias("value"))


_ov = (f"ov0 as (select distinct basename, centroid_x, centroid_y, ch27_true, unnest([centroid_x//32, greatest(centroid_x//32-1,0)]) as tx from cells), "
       f"ov as (select basename, centroid_y as gy, centroid_x as gx, centroid_y//{WIN}*{WIN} as ty, tx*32 as tx, centroid_y%{WIN} as y, centroid_x-tx*32 as x, ch27_true+tx as v from ov0)")
_hw = f"((0.5-0.5*cos(y*2*pi()/{WIN - 1}))*(0.5-0.5*cos(x*2*pi()/{WIN - 1})))"
add("r14_overlap_add", lambda s, d: RE.overlap_add(overlapping(s, d), WIN, F.lit(D.SIDE), F.lit(D.SIDE)),
    f"with {CELLS}, {_ov} select basename, gy as y, gx as x, {r6(f'sum({_hw}*v)/greatest(sum({_hw}),1e-6)', 'value')} from ov group by 1,2,3")
add("r14_overlap_add_cropped", lambda s, d: RE.overlap_add(overlapping(s, d), WIN, F.lit(D.SIDE), F.lit(D.SIDE), crop=8),
    f"""with {CELLS}, {_ov}, w as (select *, cast(y >= case when ty=0 then 0 else 8 end and y < case when ty+{WIN}>={D.SIDE} then {WIN} else {WIN - 8} end
    and x >= case when tx=0 then 0 else 8 end and x < case when tx+{WIN}>={D.SIDE} then {WIN} else {WIN - 8} end as int) as k from ov)
    select basename, gy as y, gx as x, {r6('sum(k*v)/greatest(sum(k),1e-6)', 'value')} from w group by 1,2,3""")


def pyramid(spark, d):
    pts = D.cells(spark, d).select("basename", "cell_id", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    dims = D.manifest(spark, d).select("basename", "height", "width")
    return RE.tile_pyramid(pts.join(dims, "basename"))


_top = 11
add("r15_tile_pyramid", lambda s, d: pyramid(s, d).groupBy("basename", "level", "col", "row").agg(F.count("*").alias("n_cells")),
    f"""with {CELLS}, s as (select range as s from range({_top + 1})), lv as (select basename, cell_id, {_top}-s as level, greatest({D.SIDE}>>cast(s as int),1) as len,
    least(centroid_x>>cast(s as int), greatest({D.SIDE}>>cast(s as int),1)-1) as x, least(centroid_y>>cast(s as int), greatest({D.SIDE}>>cast(s as int),1)-1) as y from cells, s),
    c as (select *, unnest(range(greatest((x-1)//256,0), least((x+1)//256, (len+255)//256-1)+1)) as col from lv),
    r as (select *, unnest(range(greatest((y-1)//256,0), least((y+1)//256, (len+255)//256-1)+1)) as row from c)
    select basename, cast(level as bigint) as level, col, row, count(*) as n_cells from r group by 1,2,3,4""")


def slots(spark, d):
    parts = F.split("core", "-")
    return D.manifest(spark, d).select("tma", parts[0].alias("row"), parts[1].cast("int").alias("col"))


add("r16_dense_lattice", lambda s, d: RE.dense_lattice(slots(s, d), flip_cols=True),
    f"""with {CELLS}, {MANIFEST}, sl as (select tma, split_part(core,'-',1) as row, cast(split_part(core,'-',2) as int) as col from cores),
    sp as (select tma, min(ascii(row)) r0, max(ascii(row)) r1, min(col) c0, max(col) c1 from sl group by 1),
    g as (select *, unnest(range(r0, r1+1)) as r from sp), g2 as (select *, unnest(range(c0, c1+1)) as c from g)
    select tma, chr(cast(r as int)) as row, c as col, cast(r-r0 as bigint) as grid_y, cast(c1-c as bigint) as grid_x,
    exists (select 1 from sl where sl.tma=g2.tma and sl.row=chr(cast(g2.r as int)) and sl.col=g2.c) as present from g2""")
add("r17_core_sort",
    lambda s, d: RE.core_sort(D.manifest(s, d).select("core")).withColumn("place", F.monotonically_increasing_id()).withColumn(
        "place", F.row_number().over(Window.orderBy("place"))),
    f"with {CELLS}, {MANIFEST} select core, row_number() over (order by split_part(core,'-',1), cast(split_part(core,'-',2) as int)) as place from cores")

# ---- sets

add("u1_union_cores",
    lambda s, d: sinks.union_rows([
        D.manifest(s, d).filter("split='train'").select("basename", "split"),
        D.manifest(s, d).filter("split<>'train'").select("basename", "tma")]),
    f"with {CELLS}, {MANIFEST} select basename, case when split='train' then split end as split, case when split<>'train' then tma end as tma from cores")
add("u2_missing",
    lambda s, d: D.cells(s, d).select("basename", "cell_id").exceptAll(D.model2(s, d).select("basename", "cell_id")),
    f"with {CELLS} select basename, cell_id from cells where not ({D.MODEL2_COVER})")

# ---- quality


def dirty(spark, d):
    """Cells with the flaws the checks look for: repeated keys, nulls, missing and negative numbers."""
    c = D.cells(spark, d)
    return c.select(
        "basename", F.expr("case when ch00_noise < 0.01 then null else cell_id - cell_id % 2 end").alias("cell_id"),
        F.expr("case when ch03_noise < 0.02 then cast('NaN' as double) else cast(centroid_x as double) end").alias("centroid_x"),
        (F.col("centroid_y") - 20).alias("centroid_y"), "ch27_true")


_dk = "dirty as (select basename, case when ch00_noise < 0.01 then null else cell_id - cell_id % 2 end as cell_id, ch03_noise < 0.02 as bad, centroid_x, centroid_y-20 as centroid_y, ch27_true from cells)"
add("q1_duplicate_keys", lambda s, d: Q.duplicate_keys(dirty(s, d).filter("cell_id is not null")).select("basename", "cell_id", "ch27_true"),
    f"with {CELLS}, {_dk}, k as (select *, count(*) over (partition by basename, cell_id) as n from dirty where cell_id is not null) select basename, cell_id, {r6('ch27_true', 'ch27_true')} from k where n > 1")
add("q2_violation_counts", lambda s, d: Q.violation_counts(dirty(s, d), numeric=["ch27_true"], by=["basename"]),
    f"""with {CELLS}, {_dk} select basename, cast(sum(cast(cell_id is null as int)) as bigint) as null_keys, cast(sum(cast(bad as int)) as bigint) as non_finite,
    cast(sum(cast(centroid_y < 0 or (not bad and centroid_x < 0) as int)) as bigint) as negative_coords from dirty group by 1""")
add("q3_both_classes", lambda s, d: Q.both_classes(D.scored(s, d), P),
    f"with {SCORED} " + " union all ".join([f"select 'marker' as kind, '{n}' as name, count(distinct {cc(c)}_pos)=2 as has_both from scored" for n, c in P.pairs]
    + [f"select 'phenotype', '{n}', count(distinct phenotype_{n}_label)=2 from scored" for n in P.phenotypes]))
_fits = f"centroid_x>=64 and centroid_x+64<={D.SIDE} and centroid_y>=64 and centroid_y+64<={D.SIDE}"
add("q4_incomplete_patches", lambda s, d: Q.incomplete_patches(D.cells(s, d), D.manifest(s, d), 128),
    f"with {CELLS} select basename, count(*) as cells, cast(sum(cast({_fits} as int)) as bigint) as cells_with_full_patch from cells group by 1")


def q5(spark, d):
    scored = D.scored(spark, d)
    m = D.manifest(spark, d)
    train = scored.join(m.filter("split in ('train', 'val')").select("basename"), "basename", "left_semi")
    val = scored.join(m.filter("split in ('val', 'test')").select("basename"), "basename", "left_semi")
    return Q.preflight(train, val, m, 128, P)


add("q5_preflight", q5,
    f"""with {CELLS}, {MANIFEST}, a as (select cells.*, split from cells join cores using (basename)),
    b as (select 'train' as s, * from a where split in ('train','val') union all select 'val', * from a where split in ('val','test'))
    select s as split, c as "check", cast(v as bigint) as violations from (
      select s, 'incomplete_patch' as c, sum(cast(not ({_fits}) as int)) as v from b group by 1
      union all select s, c, 0 from (select distinct s from b), (select unnest(['duplicate_keys','null_keys','non_finite','negative_coords','single_class']) as c)
      union all select 'both', 'split_overlap', (select count(*) from cores where split='val'))""")
add("q6_artifact_hashes", lambda s, d: Q.content_hashes(D.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("name"), "text"), "name", "text"),
    "select cast(doc_id as varchar) as name, octet_length(encode(text)) as bytes, sha256(text) as sha256, count(*) over (partition by doc_id) > 1 as duplicate_name from documents")
TEXT_RULES = {**Q.FORBIDDEN_TEXT, "web address": r"https?://[A-Za-z0-9.-]+", "license line": r"(?i)licensed under"}


def documents_as_files(spark, d):
    return D.table(spark, d, "documents").select(
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc"), F.col("doc_id"), F.when(F.col("n_chars") > 2000, ".pdf").otherwise(".md")).alias("path"),
        F.col("text").alias("content"))


_hf = "files as (select concat(source, '/', lang, '/doc', doc_id, case when n_chars > 2000 then '.pdf' else '.md' end) as path, text as content, n_chars > 2000 as pdf from documents)"
add("q7_hygiene_scan", lambda s, d: Q.hygiene_scan(documents_as_files(s, d), text_rules=TEXT_RULES, text_only=False),
    f"with {_hf} select path, 'forbidden binary or notebook type' as violation from files where pdf union all select path, 'exceeds 5 MiB' from files where octet_length(encode(content)) > 5242880 union all "
    "select path, 'forbidden directory' from files where len(list_intersect(string_split(path,'/')[1:2], [" + ", ".join(f"'{x}'" for x in Q.FORBIDDEN_PARTS) + "])) > 0 union all "
    + " union all ".join(f"select path, 'contains {k}' from files where regexp_matches(content, '{v}')" for k, v in TEXT_RULES.items()))
add("q7_hygiene_scan_pages",
    lambda s, d: Q.hygiene_scan(D.table(s, d, "pages").select(F.concat(F.lit("site/"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("content")), text_rules=TEXT_RULES),
    " union all ".join(f"select concat('site/', page_id, '.html') as path, 'contains {k}' as violation from pages where regexp_matches(html, '{v}')" for k, v in TEXT_RULES.items()))

# ---- sinks that write and read back


def bundle(spark, d):
    from catalog.stat_queries import summary

    return tables.Bundle(
        cells=D.scored(spark, d).drop("core_no", *[f"{cc(c)}_noise" for c in P.channels]), cores=summary(spark, d),
        cell_polygons=D.polygons(spark, d), polygons_skipped=D.skips(spark, d))


def k1(spark, d):
    """Write the bundle, load and validate it again, and summarise what came back."""
    path = scratch_folder(spark, "bundle")
    sinks.write_bundle(bundle(spark, d), path, THR)
    back = tables.load_bundle(spark, path)
    return back.cells.groupBy("basename").agg(
        F.count("*").alias("n"), F.sum("ch27_true").alias("total"), F.count_if("ch27_pos").alias("n_pos"))


_k1 = f"with {CELLS} select basename, count(*) as n, {r6('sum(ch27_true)', 'total')}, cast(sum(cast(ch27_pos as int)) as bigint) as n_pos from cells group by 1"
add("k1_write_bundle", k1, _k1)


def s3(spark, d):
    path = scratch_folder(spark, "bundle")
    sinks.write_bundle(bundle(spark, d), path, THR)
    back = tables.load_bundle(spark, path)
    return back.cell_polygons.join(back.cores, "basename").groupBy("basename", "n_cells").agg(F.count("*").alias("n_polygons"))


add("s3_load_bundle", s3,
    f"with {CELLS}, {D.POLYGONS} select basename, (select count(*) from cells c where c.basename=p.basename) as n_cells, count(*) as n_polygons from polys p group by 1")


def k2(spark, d):
    """Rewriting twice gives the same rows, with columns in name order."""
    path = scratch_folder(spark, "rewrite")
    for _ in range(2):
        sinks.rewrite_cells(D.cells(spark, d).select("basename", "cell_id", "ch27_true", "ch27_pos"), path)
    back = tables.read_cells(spark, versions.locate(spark, path, "cells.parquet"))
    return back.groupBy("basename").agg(F.count("*").alias("n"), F.sum("ch27_true").alias("total"), F.count_if("ch27_pos").alias("n_pos"))


add("k2_rewrite_cells", k2, _k1)


def k2_stopped(spark, d):
    """A bundle whose rewrite stopped half-way still holds the cells and the summary of the version before."""
    path = scratch_folder(spark, "bundle")
    whole = bundle(spark, d)
    sinks.write_bundle(whole, path, THR)
    before = versions.latest(spark, path)

    def stops(folder):
        raise RuntimeError("stopped")

    try:
        versions.publish(spark, path, {"cells.parquet": sinks.parquet_writer(whole.cells.filter("ch27_pos"), ["basename"]), "core_summary.parquet": stops})
    except RuntimeError:
        pass
    assert versions.latest(spark, path) == before
    back = tables.load_bundle(spark, path)
    return back.cells.groupBy("basename").agg(F.count("*").alias("n"), F.sum("ch27_true").alias("total"), F.count_if("ch27_pos").alias("n_pos"))


add("k2_stopped_rewrite", k2_stopped, _k1)


def k3(spark, d):
    path = scratch_folder(spark, "polygons")
    sinks.write_polygons(D.polygons(spark, d), D.skips(spark, d), path)
    polys = spark.read.parquet(versions.locate(spark, path, "cell_polygons.parquet"))
    skipped = spark.read.option("header", True).schema(tables.SKIP_SCHEMA).csv(versions.locate(spark, path, "polygons_skipped.csv"))
    return polys.select("basename", "cell_id", F.lit("polygon").alias("kind"), "area_nucleus_px").unionByName(
        skipped.select("basename", "cell_id", F.col("reason").alias("kind"), "area_nucleus_px"))


add("k3_write_polygons", k3,
    f"with {CELLS}, {D.POLYGONS} select basename, cell_id, 'polygon' as kind, cast(area_nucleus_px as double) as area_nucleus_px from polys "
    "union all select basename, cell_id, 'tiny', 3.0e0 from skips")


def k9(spark, d):
    path = scratch_folder(spark, "export")
    b = bundle(spark, d)
    sinks.export_core(tables.Bundle(cells=b.cells.select("basename", "cell_id", "ch27_true"), cores=b.cores), None, path)
    back = spark.read.option("header", True).schema("cell_id long, ch27_true double, basename string").csv(f"{path}/cells.csv")
    return back.groupBy("basename").agg(F.count("*").alias("n"), F.sum("ch27_true").alias("total"))


add("k9_export_core", k9, f"with {CELLS} select basename, count(*) as n, {r6('sum(ch27_true)', 'total')} from cells group by 1")


def features(spark, d):
    df = J.cells_with_polygons(D.scored(spark, d), D.polygons(spark, d))
    df = R.color_value(df, "marker_pred", "CD68", MODEL, panel=P)
    df = R.pred_prob(df, "CD68", MODEL, P)
    df = R.first_call_code(df, MODEL, P)
    return R.feature_stratum(df, "phenotype", None, THR)


def k8(spark, d):
    path = f"{scratch_folder(spark, 'geojson')}/features"
    sinks.export_geojson(features(spark, d), path)
    f = spark.read.schema("value string, basename string").text(path).select("basename", F.col("value").alias("feature"))
    return f.withColumn("cell_id", F.get_json_object("feature", "$.id").cast("long")).select(
        "basename", "cell_id", F.get_json_object("feature", "$.type").alias("type"),
        F.get_json_object("feature", "$.geometry.coordinates[0][0][0]").cast("double").alias("x0"),
        F.get_json_object("feature", "$.properties.pred_prob").cast("double").alias("pred_prob"),
        F.get_json_object("feature", "$.properties.phenotype_call").alias("phenotype_call"),
        F.get_json_object("feature", "$.properties.confidence_stratum").alias("confidence_stratum"))


_calls = [(n, f"phenotype_{n}_call_{MODEL}") for n in P.phenotypes]
_nm = "case " + " ".join(f"when {c}=1 then '{n}'" for n, c in _calls) + " end"
_st = "case " + " ".join(f"when {c}=1 then '{THR.stratum(n)}'" for n, c in _calls) + " else 'weak' end"
add("k8_export_geojson", k8,
    f"with {SCORED}, {D.POLYGONS} select s.basename, s.cell_id, 'Feature' as type, cast(s.centroid_x - r as double) as x0, {r6(f'ch27_pred_{MODEL}', 'pred_prob')}, "
    f"{_nm} as phenotype_call, {_st} as confidence_stratum from scored s join polys using (basename, cell_id)")
