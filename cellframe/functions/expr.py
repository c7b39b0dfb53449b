"""Column expressions shared by the operators. All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.panel import MODERATE_AP, STRATA, STRONG_AP


def finite(c: Column) -> Column:
    """NaN and infinities become null, so that comparisons and aggregates skip them."""
    d = c.cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def nan_to_null(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def truthy(c: Column) -> Column:
    """Label column (boolean, 0/1 or float) as boolean; null stays null."""
    return nan_to_null(c.cast("double")) != 0.0


def clip(c: Column, lo: float, hi: float) -> Column:
    """The value kept inside the bounds; an unknown one (null or NaN) is null, not a bound."""
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def ratio(num: Column, den: Column) -> Column:
    """Null instead of an error when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio0(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def any_of(cols: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


def all_of(cols: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols, F.lit(True))


# Coefficients of the rational error-function approximation,
# Abramowitz and Stegun, formula 7.1.26.
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, absolute error below 1.5e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERFC_P) * x)
    poly = reduce(lambda acc, a: (acc + F.lit(a)) * t, reversed(ERFC_A), F.lit(0.0))
    return poly * F.exp(-x * x)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value; accurate to the absolute error of :func:`erfc`."""
    return erfc(F.abs(z) / F.lit(2.0**0.5))


def stratum_of_ap(ap: Column) -> Column:
    """Confidence stratum of an average precision; an unknown value is weak."""
    v = nan_to_null(ap)
    return (
        F.when(v >= STRONG_AP, STRATA[0])
        .when(v >= MODERATE_AP, STRATA[1])
        .otherwise(STRATA[2])
    )


def literal_map(values: dict) -> Column:
    """A constant map for lookups in configuration tables of a few dozen entries."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """Fail while the plan is being built if columns are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def fail_when(df: DataFrame, broken: DataFrame, message: str) -> DataFrame:
    """``df``, with a run-time error if the one-row ``broken`` table says so in its column ``broken``.

    The check is a branch of its own (a union that adds no rows), so it also runs
    where ``df`` turns out to be empty.
    """
    verdict = F.when(F.col("broken"), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(False))
    rows = broken.filter(verdict).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.unionByName(rows)


def fail_if_empty(df: DataFrame, message: str) -> DataFrame:
    return fail_when(df, df.agg((F.count("*") == 0).alias("broken")), message)


def stack_columns(
    df: DataFrame, keep: Iterable[str | Column], rows: Iterable[dict[str, Column]]
) -> DataFrame:
    """One output row per entry of ``rows`` for every input row (a typed unpivot).

    The rows are built as one array of structs and inlined: a single pass over
    the input, no union of scans.
    """
    structs = [F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows]
    return df.select(*keep, F.inline(F.array(*structs)))
