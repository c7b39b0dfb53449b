"""Data-quality and provenance checks: each returns its violations or counts as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.expr import any_of, stack_columns, truthy
from cellframe.operators.joins import split_overlap
from cellframe.operators.rules import patch_fits
from cellframe.panel import CELL_KEY, DEFAULT_PANEL, MarkerPanel, ch, ph


def duplicate_keys(df: DataFrame, keys: Sequence[str] = CELL_KEY) -> DataFrame:
    """All rows that share a key with another one."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").select(*keys)
    return df.join(repeated, list(keys), "left_semi")


def _bad_number(c: Column) -> Column:
    d = c.cast("double")
    return d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))


def violation_counts(
    df: DataFrame, keys: Sequence[str] = CELL_KEY, numeric: Sequence[str] = (),
    coords: Sequence[str] = ("centroid_y", "centroid_x"), by: Sequence[str] = (),
) -> DataFrame:
    """Rows with a null key, a missing or non-finite number, or a negative coordinate."""
    return df.groupBy(*by).agg(
        F.count_if(any_of(F.col(k).isNull() for k in keys)).alias("null_keys"),
        F.count_if(any_of(_bad_number(F.col(c)) for c in [*coords, *numeric])).alias("non_finite"),
        F.count_if(any_of(F.col(c) < 0 for c in coords)).alias("negative_coords"),
    )


def null_keys(df: DataFrame, keys: Sequence[str] = CELL_KEY) -> DataFrame:
    return violation_counts(df, keys, coords=()).select("null_keys")


def both_classes(df: DataFrame, panel: MarkerPanel = DEFAULT_PANEL, by: Sequence[str] = ()) -> DataFrame:
    """Whether each marker and phenotype label occurs with both values."""
    classes = [("marker", n, ch(c, "pos")) for n, c in panel.pairs if ch(c, "pos") in df.columns]
    classes += [("phenotype", n, ph(n, "label")) for n in panel.phenotypes if ph(n, "label") in df.columns]
    aggs = []
    for _, _, column in classes:
        y = truthy(F.col(column)).cast("int")
        aggs += [F.min(y).alias(f"__lo_{column}"), F.max(y).alias(f"__hi_{column}")]
    rows = [
        {
            "kind": F.lit(k), "name": F.lit(n),
            "has_both": F.coalesce(F.col(f"__lo_{c}") != F.col(f"__hi_{c}"), F.lit(False)),
        }
        for k, n, c in classes
    ]
    return stack_columns(df.groupBy(*by).agg(*aggs), by, rows)


def incomplete_patches(df: DataFrame, dims: DataFrame, patch: int) -> DataFrame:
    """Per core: cells, and cells whose patch fits into the image."""
    fits = patch_fits(F.col("height"), F.col("width"), patch)
    return (
        df.join(dims.select("basename", "height", "width"), "basename")
        .groupBy("basename")
        .agg(F.count("*").alias("cells"), F.count_if(fits).alias("cells_with_full_patch"))
    )


def preflight(
    train: DataFrame, val: DataFrame, dims: DataFrame, patch: int, panel: MarkerPanel = DEFAULT_PANEL,
    numeric: Sequence[str] = (),
) -> DataFrame:
    """One report of all checks: ``split, check, violations``; a usable input has zeros only."""
    def checks(df: DataFrame, split: str) -> DataFrame:
        counts = violation_counts(df, numeric=numeric)
        dup = df.groupBy(*CELL_KEY).agg(F.count("*").alias("__n")).filter("__n > 1")
        parts = [
            dup.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("violations")).select(
                F.lit("duplicate_keys").alias("check"), "violations"),
            stack_columns(counts, [], [
                {"check": F.lit(n), "violations": F.col(n)}
                for n in ("null_keys", "non_finite", "negative_coords")
            ]),
            both_classes(df, panel).agg(F.count_if(~F.col("has_both")).alias("violations")).select(
                F.lit("single_class").alias("check"), "violations"),
            incomplete_patches(df, dims, patch).agg(
                F.coalesce(F.sum(F.col("cells") - F.col("cells_with_full_patch")), F.lit(0)).alias("violations")
            ).select(F.lit("incomplete_patch").alias("check"), "violations"),
        ]
        return reduce(DataFrame.unionByName, parts).select(F.lit(split).alias("split"), "check", "violations")

    overlap = split_overlap(train, val).agg(F.count("*").alias("violations")).select(
        F.lit("both").alias("split"), F.lit("split_overlap").alias("check"), "violations"
    )
    return checks(train, "train").unionByName(checks(val, "val")).unionByName(overlap)


def content_hashes(df: DataFrame, name: str, content: str) -> DataFrame:
    """Size and SHA-256 of each named content; a repeated name is flagged."""
    repeats = df.groupBy(name).agg(F.count("*").alias("__n"))
    return df.join(repeats, name).select(
        F.col(name).alias("name"), F.octet_length(content).alias("bytes"),
        F.sha2(F.col(content).cast("binary"), 256).alias("sha256"),
        (F.col("__n") > 1).alias("duplicate_name"),
    )


# What a published tree must not contain.
FORBIDDEN_NAMES = ("CLAUDE.md", "TODO_PUBLIC_RELEASE.md", ".DS_Store")
FORBIDDEN_PARTS = (
    ".claude", "archive", "benchmarks", "checkpoints", "logs", "notebooks", "outputs", "paper",
    "presentations", "runs", "trash", "wandb",
)
FORBIDDEN_SUFFIXES = (
    ".ckpt", ".h5", ".hdf5", ".ipynb", ".npy", ".npz", ".pdf", ".pt", ".pth", ".safetensors",
    ".svs", ".tif", ".tiff",
)
TEXT_SUFFIXES = (
    ".cff", ".css", ".html", ".ini", ".js", ".json", ".md", ".py", ".sh", ".toml", ".yaml", ".yml",
)
FORBIDDEN_TEXT = {
    "machine-specific path": r"(?:/scratch/(?:users/)?|/home/users/|/Users/)[A-Za-z0-9_.-]+/",
    "AI coauthor trailer": r"(?i)co-authored-by:.*(?:claude|chatgpt|openai)",
    "internal assistant file": r"\bCLAUDE\.md\b",
}
MAX_FILE_BYTES = 5 * 1024 * 1024


def hygiene_scan(
    files: DataFrame, path: str = "path", content: str = "content", size: str | None = None,
    text_rules: Mapping[str, str] = FORBIDDEN_TEXT, text_only: bool = True,
) -> DataFrame:
    """One row per file and broken rule: names, folders, types, size and text patterns.

    ``text_only`` limits the text rules to text file types that are not minified.
    """
    p = F.col(path)
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    length = F.col(size) if size else F.octet_length(content)
    checks = [
        F.when(name.isin(*FORBIDDEN_NAMES), F.lit("forbidden publication artifact")),
        F.when(
            F.arrays_overlap(folders, F.array(*[F.lit(x) for x in FORBIDDEN_PARTS])),
            F.lit("forbidden directory"),
        ),
        F.when(suffix.isin(*FORBIDDEN_SUFFIXES), F.lit("forbidden binary or notebook type")),
        F.when(length > MAX_FILE_BYTES, F.lit("exceeds 5 MiB")),
    ]
    readable = F.lit(True)
    if text_only:
        readable = suffix.isin(*TEXT_SUFFIXES) & ~name.contains(".min.")
    for label, pattern in text_rules.items():
        hit = F.col(content).cast("string").rlike(pattern)
        checks.append(F.when(readable & hit, F.lit(f"contains {label}")))
    return files.select(p.alias("path"), F.explode(F.array_compact(F.array(*checks))).alias("violation"))
