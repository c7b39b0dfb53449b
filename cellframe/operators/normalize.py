"""Per-core means, z-scores and fills.

Statistics are aggregated per core and joined back: unlike a window over the
core this combines on the map side, and a very large core is split by the
adaptive skew join instead of being sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.expr import clip, nan_to_null, require
from cellframe.panel import DEFAULT_PANEL, MarkerPanel, ch

EPSILON = 2.220446049250313e-16


def core_means(df: DataFrame, columns: dict[str, str], by: Sequence[str] = ("basename",)) -> DataFrame:
    """Attach the null-skipping group mean of ``{output: input}`` columns to every row."""
    means = df.groupBy(*by).agg(*[F.avg(nan_to_null(F.col(c))).alias(o) for o, c in columns.items()])
    return df.join(means, list(by))


def core_mean_preds(
    df: DataFrame, model: str | None = None, panel: MarkerPanel = DEFAULT_PANEL
) -> DataFrame:
    return core_means(
        df,
        {
            f"core_mean_ch{c:02d}_pred": ch(c, "pred", model)
            for c in panel.channels
            if ch(c, "pred", model) in df.columns
        },
    )


def checked_intensity(name: str, space: str) -> Column:
    """Log-transformed intensity; missing, NaN or negative input is an error."""
    if space not in ("raw", "log1p"):
        raise ValueError(f"unknown intensity space: {space!r}")
    v = F.col(name).cast("double")
    bad = v.isNull() | F.isnan(v) | (v < 0)
    v = F.when(bad, F.raise_error(F.lit(f"{name}: intensity must be finite and >= 0")).cast("double")).otherwise(v)
    return F.log1p(v) if space == "raw" else v


def zscore_by_core(
    df: DataFrame, panel: MarkerPanel = DEFAULT_PANEL, max_value: float = 5.0, space: str = "raw",
    suffix: str = "zscore_spacec",
) -> DataFrame:
    """Population z-score of every marker inside its core, clipped to +-max_value.

    A marker that is constant in a core gives 0 there.
    """
    require(df, [ch(c, "true") for c in panel.channels])
    x = {c: checked_intensity(ch(c, "true"), space) for c in panel.channels}
    logged = df.withColumns({f"__x_{c}": v for c, v in x.items()})
    stats = logged.groupBy("basename").agg(
        *[F.avg(f"__x_{c}").alias(f"__m_{c}") for c in panel.channels],
        *[F.stddev_pop(f"__x_{c}").alias(f"__s_{c}") for c in panel.channels],
    )
    out = {}
    for c in panel.channels:
        m, s = F.col(f"__m_{c}"), F.col(f"__s_{c}")
        flat = s <= F.greatest(F.abs(m) * F.lit(16 * EPSILON), F.lit(EPSILON))
        z = F.when(flat, F.lit(0.0)).otherwise((F.col(f"__x_{c}") - m) / s)
        out[ch(c, suffix)] = clip(z, -max_value, max_value)
    keep = [F.col(c) for c in df.columns if c not in out]
    return logged.join(stats, "basename").select(*keep, *[v.alias(n) for n, v in out.items()])


def global_fill(df: DataFrame, columns: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """Replace missing values by the mean over all rows, 0 if a column has none.

    The means are one row and become literals, so the rows to fill are not joined with
    anything. ``source`` names a cheaper table with the same known values.
    """
    if not columns:
        return df
    table = source if source is not None else df
    means = table.agg(*[F.avg(nan_to_null(F.col(c))).alias(c) for c in columns]).first()
    return df.withColumns({
        c: F.coalesce(nan_to_null(F.col(c)), F.lit(float(means[c] or 0.0))) for c in columns
    })
