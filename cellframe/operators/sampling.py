"""Deterministic sampling, heads and permutations.

Random order is a digest of the row key and a seed, so a result does not depend
on partitioning and repeats after a lost executor.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.running import join_salted
from cellframe.panel import CELL_KEY


SLICES = 64
#: Ranges of the order that :func:`smallest` counts.
RANGES = 1 << 16


def digest(seed: int, keys: Sequence[str]) -> Column:
    """The random order as text: MD5 of the key's parts and the seed, which any engine can repeat."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(int(seed)))))


def _order(seed: int, keys: Sequence[str]) -> list[Column]:
    return [digest(seed, keys), *[F.col(k) for k in keys]]


def uniform(seed: int, keys: Sequence[str]) -> Column:
    """A number in (0, 1) from the key and the seed."""
    bits = F.conv(F.substring(digest(seed, keys), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def smallest(df: DataFrame, n: int, order: Sequence[Column], part: Column, by: Sequence[str] = ()) -> DataFrame:
    """The n first rows in an order, all if there are fewer, without bringing n rows together; of every group if ``by``.

    ``part`` is a number from 0 to RANGES - 1 that never falls along the order. The rows of each part are
    counted, lower parts are kept whole, and only the part that holds the n-th row is ranked. Groups must not be null.
    """
    marked = df.withColumn("__part", part.cast("int"))
    counts = marked.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    # RANGES rows a group at most
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part"))
    edge = counts.select(*by, "__part", "__n", upto.alias("__upto")).where(F.col("__upto") - F.col("__n") < n)
    edge = edge.groupBy(*by).agg(F.max("__part").alias("__last"), F.max(F.col("__upto") - F.col("__n")).alias("__before"))
    met = join_salted(marked, edge, by, F.col("__part")) if by else marked.join(F.broadcast(edge))  # one row without groups
    kept = met.where(F.col("__part") <= F.col("__last"))
    last = F.col("__part") == F.col("__last")
    rank = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    ranked = kept.where(last).withColumn("__rank", rank).where(F.col("__rank") + F.col("__before") <= n)
    return kept.where(~last).select(*df.columns).unionByName(ranked.select(*df.columns))


def head(df: DataFrame, basename: str | None, limit: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The first rows of a core by cell id."""
    rows = df if basename is None else df.filter(F.col("basename") == basename)
    if columns is not None:
        rows = rows.select(*dict.fromkeys([*columns, "basename", "cell_id"]))
    rows = rows.orderBy("basename", "cell_id").limit(limit)
    return rows if columns is None else rows.select(*columns)


def top_by_abs(df: DataFrame, column: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).orderBy(F.abs(column).desc(), *ties).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int, keys: Sequence[str] = CELL_KEY) -> DataFrame:
    """n rows without replacement, all of them if there are fewer or n is not positive."""
    if n <= 0:
        return df
    part = F.conv(F.substring(digest(seed, keys), 1, 4), 16, 10)
    return smallest(df, int(n), _order(seed, keys), part)


def epoch_sample(
    df: DataFrame, n: int, seed: int, epoch: int, keys: Sequence[str] = CELL_KEY
) -> DataFrame:
    return sample_rows(df, n, seed + epoch, keys)


def stratified_sample(
    df: DataFrame, stratum: str, n: int, seed: int, keys: Sequence[str] = CELL_KEY
) -> DataFrame:
    """At most n rows per stratum: the first in the random order, by the counts of its ranges.

    Only the range that holds a stratum's n-th row is ranked, so no task sees more of a stratum. A null stratum is one
    of its own.
    """
    groups = {"__known": F.col(stratum).isNotNull(), "__stratum": F.coalesce(F.col(stratum).cast("string"), F.lit(""))}
    part = F.conv(F.substring(digest(seed, keys), 1, 4), 16, 10)
    return smallest(df.withColumns(groups), int(n), _order(seed, keys), part, list(groups)).drop(*groups)


def weighted_positive_sample(
    tiles: DataFrame, n: int, positive_fraction: float, weights: Mapping[str, float], seed: int,
    keys: Sequence[str], positive: str = "positive", channel: str = "channel",
) -> DataFrame:
    """n tiles of which a set share is positive, a positive one drawn in proportion to its channel's weight.

    Where either side runs short the other fills up, positives without weight last, so n rows come back
    unless the table has fewer.
    """
    weight = F.lit(0.0)
    for name, value in weights.items():
        weight = F.when(F.col(channel) == name, F.lit(float(value))).otherwise(weight)
    draw = -F.log(uniform(seed, keys))
    rows = tiles.withColumn("__w", F.when(F.coalesce(F.col(positive), F.lit(False)), weight)).withColumn(
        "__kind", F.when(F.col("__w") > 0, 0).when(F.col("__w").isNull(), 1).otherwise(2)
    ).withColumn("__key", F.when(F.col("__kind") == 0, draw / F.col("__w")).otherwise(draw))
    count = rows.groupBy("__kind").count()
    have = {r["__kind"]: r["count"] for r in count.collect()}  # three rows at most
    heavy = min(have.get(0, 0), max(int(round(n * positive_fraction)), n - have.get(1, 0)))
    plain = min(have.get(1, 0), n - heavy)
    # a draw is exponential: its logarithm spreads evenly enough over the parts
    part = F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), F.floor((F.log("__key") + F.lit(40.0)) * F.lit(800.0))))
    out = None
    for kind, many in enumerate((heavy, plain, min(have.get(2, 0), n - heavy - plain))):
        chosen = smallest(rows.where(F.col("__kind") == kind), many, [F.col("__key"), *[F.col(k) for k in keys]], part)
        out = chosen if out is None else out.unionByName(chosen)
    return out.select(*tiles.columns)


def shuffle_within_core(
    df: DataFrame, columns: Sequence[str], seed: int, by: str = "basename", key: str = "cell_id",
) -> DataFrame:
    """Permute the given columns together among the cells of a core; everything else stays in place.

    A core is cut into hashed slices, the slices' ranks are offset by their running
    sizes, and the rows at equal rank under two orders are matched: no task sees a
    whole core.
    """
    moved = [c for c in columns if c in df.columns]

    def ranked(table: DataFrame, order: Sequence[Column], salt: Column) -> DataFrame:
        """Rank inside the core: the slice number leads the order."""
        size = table.groupBy(by).agg(F.ceil(F.count("*") / F.lit(4096)).alias("__slices"))
        sliced = table.join(size, by).withColumn("__slice", F.pmod(salt, F.col("__slices")))
        counts = sliced.groupBy(by, "__slice").agg(F.count("*").alias("__c"))
        before = Window.partitionBy(by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        offset = counts.select(by, "__slice", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
        inner = Window.partitionBy(by, "__slice").orderBy(*order)
        return (
            sliced.join(offset, [by, "__slice"])
            .withColumn("__rank", F.row_number().over(inner) + F.col("__o"))
            .drop("__slice", "__slices", "__o")
        )

    place = ranked(
        df.select(*[c for c in df.columns if c not in moved]), [F.col(key)], F.xxhash64(key)
    )
    values = ranked(
        df.select(by, key, *moved), _order(seed, [key]), F.xxhash64(F.lit(int(seed)), key)
    ).drop(key)
    return place.join(values, [by, "__rank"]).select(*df.columns)


def lift_order(metrics: DataFrame, column: str = "lift", ties: Sequence[str] = ("name",)) -> DataFrame:
    return metrics.orderBy(F.col(column).desc_nulls_last(), *ties)
