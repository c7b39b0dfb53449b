"""Ordered aggregates over groups of any size.

A window over a whole group puts the group into one task. The helpers here
order a group by value without that: ties are collapsed first, dealt in ranges of
(group, value) and sorted there, so a row's place in its range is known. Every
ROWS_PER_BIN places are a bin, every FAN bins have a parent, and so on. Sums before
a bin are prefix sums among its siblings plus those before its parent, so a window
holds at most FAN bins (or the ranges of one group), and the exact running sum is
finished inside a bin. Ranges are as many as the session's shuffle partitions; how
evenly they are cut changes no sum.

Joins with the statistics of a group carry a salt of the row in their key, so a
group with a third of all rows is dealt over SALTS tasks (:func:`join_salted`).

Group keys must not be null. The tie table is written once and read by every step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.session import scratch_folder

ROWS_PER_BIN = 4096
#: Bins under one parent.
LEVELS = 32
FAN = LEVELS * LEVELS
#: Slices of a group in joins with its statistics.
SALTS = 16


def tie_totals(
    df: DataFrame, by: Sequence[str], value: str, sums: dict[str, Column]
) -> DataFrame:
    """One row per ``by`` and distinct non-null ``value`` with the given sums (map-side combined)."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias(value))
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    )


def join_salted(big: DataFrame, small: DataFrame, keys: Sequence[str], row: Column, how: str = "inner") -> DataFrame:
    """Join a table with a few rows per key: the key carries a salt of ``row``, the few rows are repeated.

    The salt stays in the column ``__salt``, for an aggregate by (keys, ``__salt``) that needs no
    further shuffle; drop it after.
    """
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int"))
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*keys, "__salt"], how)


BIN = ("__b1", "__b2")
#: Bits of a row's place in its range, in the id that Spark numbers rows by.
PLACE_BITS = 33


def _ranged(ties: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The ties in sorted ranges of (group, value), written once: ``__b1`` is a row's range, ``__at`` its place there.

    A range holds few of the large groups, so it is sorted by value first, which Spark compares without reading the rows.
    """
    row = F.monotonically_increasing_id()
    ordered = ties.repartitionByRange(*by, value).sortWithinPartitions(value, *by).withColumn("__row", row).select(
        *ties.columns, F.shiftright("__row", PLACE_BITS).cast("int").alias("__b1"),
        F.col("__row").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("__at"))
    folder = scratch_folder(ties.sparkSession, "ties")
    ordered.write.parquet(folder)
    return ties.sparkSession.read.schema(ordered.schema).parquet(folder)


def _binned(ties: DataFrame, by: Sequence[str], value: str) -> tuple[DataFrame, int]:
    """The ties with their bin, and the depth of the tree: ``__b1`` is the range, ``__b2`` the path below it in base FAN."""
    rows = _ranged(ties, by, value)
    last, most = rows.groupBy(*by, "__b1").agg(F.max("__at").alias("__last"), F.count("*").alias("__rows")).agg(
        F.max("__last"), F.max("__rows")).first()
    depth, bins = 0, 1
    if (most or 0) <= ROWS_PER_BIN:
        return rows.withColumn("__b2", F.lit(0).cast("long")).drop("__at"), depth
    while bins * ROWS_PER_BIN <= last:
        depth, bins = depth + 1, bins * FAN
    return rows.withColumn("__b2", F.expr(f"__at div {ROWS_PER_BIN}")).drop("__at"), depth


def _offsets(binned: DataFrame, by: Sequence[str], sums: Sequence[str], descending: bool, depth: int) -> DataFrame:
    """Per bin: the sum of everything ordered before it, its own sum and the group's total.

    Bottom up, bins are added to their parents; top down, what lies before the parent is added to what lies before a bin
    among its siblings.
    """
    def before(parent: Sequence[str], column: str) -> Window:
        order = F.col(column).desc() if descending else F.col(column)
        return Window.partitionBy(*parent).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def among(totals: DataFrame, parent: Sequence[str], column: str) -> list[Column]:
        return [F.coalesce(F.sum(f"__t_{s}").over(before(parent, column)), F.lit(0)).alias(f"__o_{s}") for s in sums]

    levels = [binned.groupBy(*by, *BIN).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])]
    for _ in range(depth):
        up = levels[-1].withColumn("__b2", F.expr(f"__b2 div {FAN}"))
        levels.append(up.groupBy(*by, *BIN).agg(*[F.sum(f"__t_{s}").alias(f"__t_{s}") for s in sums]))
    whole = Window.partitionBy(*by)
    found = levels[-1].select(
        *by, *BIN, *among(levels[-1], by, "__b1"), *[F.col(f"__t_{s}") for s in sums], *[F.sum(f"__t_{s}").over(whole).alias(f"tot_{s}") for s in sums])
    for totals in reversed(levels[:-1]):
        up = found.select(*by, "__b1", F.col("__b2").alias("__up"), *[F.col(f"__o_{s}").alias(f"__p_{s}") for s in sums], *[f"tot_{s}" for s in sums])
        own = totals.withColumn("__up", F.expr(f"__b2 div {FAN}"))
        own = own.select("*", *among(own, [*by, "__b1", "__up"], "__b2")).join(up, [*by, "__b1", "__up"])
        found = own.select(
            *by, *BIN, *[(F.col(f"__o_{s}") + F.col(f"__p_{s}")).alias(f"__o_{s}") for s in sums], *[f"__t_{s}" for s in sums], *[f"tot_{s}" for s in sums])
    return found


def _within_bins(
    rows: DataFrame, offsets: DataFrame, by: Sequence[str], value: str,
    sums: Sequence[str], descending: bool,
) -> DataFrame:
    """Finish the running sums: inside the bins first, whose order the join with what lies before them can use."""
    keys = [*reversed(BIN), *by]
    order = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    wanted = offsets.select(*keys, *[f"__o_{s}" for s in sums], *[f"tot_{s}" for s in sums])
    inside = rows.select(*keys, value, *sums, *[F.sum(s).over(w).alias(f"__i_{s}") for s in sums])
    return inside.join(wanted, keys).select(
        *by, value, *sums, *[f"tot_{s}" for s in sums],
        *[(F.col(f"__o_{s}") + F.col(f"__i_{s}")).alias(f"run_{s}") for s in sums],
    )


def running_totals(
    ties: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], descending: bool = False
) -> DataFrame:
    """Per row of a group, in order of ``value``: the inclusive running sum ``run_<s>`` and the
    group's total ``tot_<s>`` of every ``s``.

    ``ties`` must have one row per (group, value), as :func:`tie_totals` gives;
    ``by`` must not be empty.
    """
    binned, depth = _binned(ties, by, value)
    offsets = _offsets(binned, by, sums, descending, depth)
    return _within_bins(binned, offsets, by, value, sums, descending)


def group_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float | Column]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, for groups of any size.

    ``quantiles`` maps an output column to a level in [0, 1]; a Column level may
    use the group's columns. Only the bins that hold a wanted rank are ordered.
    Adds ``n`` (non-null values per group).
    """
    keys = list(by) or ["__all"]
    src = df if by else df.withColumn("__all", F.lit(0))
    out = tie_quantiles(tie_totals(src, keys, value, {"n": F.lit(1)}), keys, value, quantiles)
    return out if by else out.drop("__all")


def tie_quantiles(ties: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float | Column]) -> DataFrame:
    """:func:`group_quantiles` of the counts ``n`` of every group's values, as :func:`tie_totals` gives them."""
    binned, depth = _binned(ties, keys, value)
    offsets = _offsets(binned, keys, ["n"], False, depth)
    ranks = [
        (q if isinstance(q, Column) else F.lit(float(q))) * (F.col("tot_n") - F.lit(1))
        for q in quantiles.values()
    ]

    wanted = F.lit(False)
    for rank in ranks:
        for edge in (F.floor(rank), F.ceil(rank)):
            wanted = wanted | ((edge >= F.col("__o_n")) & (edge < F.col("__o_n") + F.col("__t_n")))
    offsets = offsets.filter(wanted)
    rows = binned.join(offsets.select(*keys, *BIN), [*keys, *BIN], "left_semi")
    ordered = _within_bins(rows, offsets, keys, value, ["n"], False)

    picks = []
    for i, rank in enumerate(ranks):
        for tag, edge in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            picks.append(F.min(F.when(F.col("run_n") > edge, F.col(value))).alias(f"__{tag}{i}"))
    agg = ordered.groupBy(*keys, "tot_n").agg(*picks)
    outs = []
    for i, (name, rank) in enumerate(zip(quantiles, ranks)):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        outs.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return agg.select(*keys, F.col("tot_n").alias("n"), *outs)
