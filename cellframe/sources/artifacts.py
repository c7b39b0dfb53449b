"""Readers for the JSON artifacts: thresholds, model metadata and scalers.

All of them are configuration of a few dozen entries. Each reader returns rows
and checks them in the plan: a malformed artifact fails when it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.panel import DEFAULT_PANEL, STRATA, MarkerPanel, Thresholds


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def _ensure(ok: Column, message: str, value: Column, kind: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def load_cohort_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """``channel, method, value`` rows of a channel -> method -> value map; a channel must be an integer."""
    table = F.from_json("value", "map<string,map<string,double>>")
    rows = _text(spark, path).select(F.explode(table).alias("key", "methods"))
    channel = F.expr("try_cast(key as int)")
    checked = F.coalesce(
        channel, F.raise_error(F.concat(F.lit("non-integer channel key: "), F.col("key"))).cast("int")
    )
    return rows.select(checked.alias("channel"), F.explode("methods").alias("method", "value"))


def threshold_dict(rows: DataFrame) -> dict[int, dict[str, float]]:
    """The rows of :func:`load_cohort_thresholds` as a configuration mapping (a few dozen entries)."""
    out: dict[int, dict[str, float]] = {}
    for r in rows.toLocalIterator():
        out.setdefault(int(r["channel"]), {})[r["method"]] = r["value"]
    return out


_ARTIFACT = (
    "schema_version int, marker_thresholds map<string,double>, phenotype_thresholds map<string,double>, "
    "marker_confidence map<string,string>, phenotype_confidence map<string,string>, "
    "provenance map<string,string>"
)


def load_threshold_artifact(
    spark: SparkSession, path: str, panel: MarkerPanel = DEFAULT_PANEL
) -> DataFrame:
    """``kind, name, threshold, confidence`` rows of a complete version-1 artifact.

    Key sets must match the panel exactly, cuts lie in [0, 1], strata are known and
    the provenance is not empty.
    """
    def same_keys(column: str, names: Sequence[str]) -> Column:
        wanted = F.array(*[F.lit(n) for n in names])
        found = F.map_keys(column)
        return (F.size(F.array_except(found, wanted)) == 0) & (F.size(F.array_except(wanted, found)) == 0)

    channels = [str(c) for c in panel.channels]
    checks = [
        (F.col("schema_version") == 1, "threshold artifact must have schema_version 1"),
        (F.size("provenance") > 0, "threshold artifact provenance must be a non-empty JSON object"),
    ]
    for column, names in (
        ("marker_thresholds", channels), ("phenotype_thresholds", panel.phenotypes),
        ("marker_confidence", panel.names), ("phenotype_confidence", panel.phenotypes),
    ):
        checks.append((same_keys(column, names), f"{column} keys mismatch"))
        if column.endswith("thresholds"):
            good = F.forall(F.map_values(column), lambda v: (v >= 0.0) & (v <= 1.0))
            checks.append((good, f"{column} values must be in [0, 1]"))
        else:
            good = F.forall(F.map_values(column), lambda v: v.isin(*STRATA))
            checks.append((good, f"{column} contains invalid strata"))
    verdict = F.lit(True)
    for ok, message in reversed(checks):
        verdict = F.when(F.coalesce(ok, F.lit(False)), verdict).otherwise(
            F.raise_error(F.lit(message)).cast("boolean")
        )
    doc = _text(spark, path).select(F.from_json("value", _ARTIFACT).alias("d")).select("d.*")
    doc = doc.filter(verdict)
    entries = [
        F.struct(
            F.lit("marker").alias("kind"), F.lit(n).alias("name"),
            F.element_at("marker_thresholds", F.lit(str(c))).alias("threshold"),
            F.element_at("marker_confidence", F.lit(n)).alias("confidence"),
        )
        for n, c in panel.pairs
    ] + [
        F.struct(
            F.lit("phenotype").alias("kind"), F.lit(n).alias("name"),
            F.element_at("phenotype_thresholds", F.lit(n)).alias("threshold"),
            F.element_at("phenotype_confidence", F.lit(n)).alias("confidence"),
        )
        for n in panel.phenotypes
    ]
    return doc.select(F.inline(F.array(*entries)))


def thresholds(rows: DataFrame) -> Thresholds:
    """The rows of :func:`load_threshold_artifact` as operator configuration (21 entries)."""
    table = {"marker": {}, "phenotype": {}}
    strata = {"marker": {}, "phenotype": {}}
    for r in rows.toLocalIterator():
        table[r["kind"]][r["name"]] = r["threshold"]
        strata[r["kind"]][r["name"]] = r["confidence"]
    return Thresholds(table["marker"], table["phenotype"], strata["marker"], strata["phenotype"])


_ROW = "array<struct<channel:int,threshold:double,train_positive_fraction:double>>"


def load_threshold_rows(
    spark: SparkSession, path: str, channels: Sequence[int] = (), default_rate: float = 0.1
) -> DataFrame:
    """``channel, threshold, train_positive_fraction`` of a list, bare or under ``thresholds``.

    A missing rate is ``default_rate``; a wanted channel that is absent is an error.
    """
    doc = _text(spark, path)
    rows = F.coalesce(
        F.from_json("value", f"struct<thresholds:{_ROW}>")["thresholds"], F.from_json("value", _ROW)
    )
    have = doc.select(rows.alias("rows"))
    wanted = F.array(*[F.lit(int(c)) for c in channels]).cast("array<int>")
    absent = F.array_except(wanted, F.transform("rows", lambda r: r["channel"]))
    have = have.filter(_ensure(F.size(absent) == 0, "threshold list lacks channels", F.lit(True), "boolean"))
    return have.select(F.inline("rows")).withColumn(
        "train_positive_fraction", F.coalesce("train_positive_fraction", F.lit(float(default_rate)))
    )


_MODEL = (
    "schema_version int, models array<struct<id:string,name:string,backbone:string,"
    "training_split:string,provenance:map<string,string>,notes:string>>"
)


def load_model_metadata(spark: SparkSession, path: str, ids: Sequence[str]) -> DataFrame:
    """One row per model. Identity fields are non-empty and the ids match exactly."""
    doc = _text(spark, path).select(F.from_json("value", _MODEL).alias("d")).select("d.*")
    wanted = F.array(*[F.lit(i) for i in ids]).cast("array<string>")
    found = F.transform("models", lambda m: m["id"])
    fields = ("id", "name", "backbone", "training_split")
    complete = F.forall("models", lambda m: (
        F.coalesce(F.trim(m["id"]) != "", F.lit(False)) & F.coalesce(F.trim(m["name"]) != "", F.lit(False))
        & F.coalesce(F.trim(m["backbone"]) != "", F.lit(False))
        & F.coalesce(F.trim(m["training_split"]) != "", F.lit(False))
    ))
    checks = [
        (F.col("schema_version") == 1, "model metadata must have schema_version 1"),
        (F.col("models").isNotNull(), "model metadata 'models' must be a list"),
        (complete, f"model identity fields must be non-empty: {', '.join(fields)}"),
        (F.forall("models", lambda m: F.size(m["provenance"]) > 0), "each model requires non-empty provenance"),
        ((F.size(F.array_except(wanted, found)) == 0) & (F.size(F.array_except(found, wanted)) == 0),
         "model metadata ids mismatch"),
    ]
    for ok, message in checks:
        doc = doc.filter(_ensure(ok, message, F.lit(True), "boolean"))
    return doc.select(F.inline("models"))


def load_quantile_scaler(spark: SparkSession, path: str) -> DataFrame:
    """``channel, qlo, qhi`` rows; both lists have C entries and every upper one is larger."""
    doc = _text(spark, path).select(
        F.from_json("value", "C int, qlo array<double>, qhi array<double>").alias("d")
    ).select("d.*")
    sizes = (F.size("qlo") == F.col("C")) & (F.size("qhi") == F.col("C"))
    doc = doc.filter(_ensure(sizes, "qlo and qhi must each contain C values", F.lit(True), "boolean"))
    rows = doc.select(F.posexplode(F.arrays_zip("qlo", "qhi")).alias("channel", "q"))
    ordered = F.col("q.qhi") > F.col("q.qlo")
    return rows.select(
        "channel", F.col("q.qlo").alias("qlo"),
        _ensure(ordered, "every upper quantile must exceed its lower quantile", F.col("q.qhi"), "double").alias("qhi"),
    )
