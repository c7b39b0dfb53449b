"""Marker panel, phenotype rules and operating thresholds.

Everything here is configuration: it decides which columns the operators
generate, and never holds data that grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The focused panel, in order.
MARKER_NAMES = (
    "DAPI", "CD45", "CD8", "Ki67", "CA9", "Vimentin",
    "CD68", "FAP", "CD163", "PDL1", "aSMA", "panCK",
)
MARKER_CHANNELS = (0, 3, 7, 13, 16, 17, 27, 31, 34, 46, 50, 52)

# Phenotypes, in order.
PHENOTYPE_NAMES = (
    "immune_cd45",
    "t_cell_cd45_cd8",
    "tumor_ca9_or_panck",
    "macrophage_cd68_or_cd163",
    "m2_like_cd68_cd163",
    "caf_fap_or_asma",
    "proliferating_ki67",
    "pdl1_positive",
    "pdl1_tumor_like",
)

# A child phenotype implies its parent.
PHENOTYPE_HIERARCHY = (
    ("t_cell_cd45_cd8", "immune_cd45"),
    ("m2_like_cd68_cd163", "macrophage_cd68_or_cd163"),
    ("pdl1_tumor_like", "pdl1_positive"),
    ("pdl1_tumor_like", "tumor_ca9_or_panck"),
)

# Markers whose threshold methods disagree most.
UNSTABLE_MARKERS = ("CD45", "CD8", "Ki67", "PDL1", "aSMA")

# Label families a target table can be built from, and their column suffixes.
LABEL_SETS = ("gmm", "consensus", "spacec")
TRUTH_SUFFIX = {"gmm": "", "consensus": "_consensus", "spacec": "_spacec"}

# Confidence strata and their lower AP bounds.
STRATA = ("strong", "moderate", "weak")
STRONG_AP = 0.70
MODERATE_AP = 0.55

BACKGROUND = "background"
CELL_KEY = ("basename", "cell_id")

Markers = Mapping[str, Column]


@dataclass(frozen=True)
class PhenotypeRule:
    """A named phenotype: one Boolean and one probability expression over markers.

    Both callables receive ``{marker name: Column}`` and return a Column, so a
    user rule is inlined into the plan and never becomes a Python UDF.
    """

    name: str
    label: Callable[[Markers], Column]
    score: Callable[[Markers], Column]
    description: str = ""


def soft_or(a: Column, b: Column) -> Column:
    """Probability that at least one of two independent events holds."""
    return F.lit(1.0) - (F.lit(1.0) - a) * (F.lit(1.0) - b)


def single(name: str, marker: str) -> PhenotypeRule:
    return PhenotypeRule(name, lambda m: m[marker], lambda m: m[marker], marker)


def both(name: str, a: str, b: str) -> PhenotypeRule:
    return PhenotypeRule(name, lambda m: m[a] & m[b], lambda m: m[a] * m[b], f"{a} and {b}")


def either(name: str, a: str, b: str) -> PhenotypeRule:
    return PhenotypeRule(name, lambda m: m[a] | m[b], lambda m: soft_or(m[a], m[b]), f"{a} or {b}")


DEFAULT_RULES = (
    single("immune_cd45", "CD45"),
    both("t_cell_cd45_cd8", "CD45", "CD8"),
    either("tumor_ca9_or_panck", "CA9", "panCK"),
    either("macrophage_cd68_or_cd163", "CD68", "CD163"),
    both("m2_like_cd68_cd163", "CD68", "CD163"),
    either("caf_fap_or_asma", "FAP", "aSMA"),
    single("proliferating_ki67", "Ki67"),
    single("pdl1_positive", "PDL1"),
    PhenotypeRule(
        "pdl1_tumor_like",
        lambda m: m["PDL1"] & (m["CA9"] | m["panCK"]),
        lambda m: m["PDL1"] * soft_or(m["CA9"], m["panCK"]),
        "PDL1 and (CA9 or panCK)",
    ),
)


@dataclass(frozen=True)
class MarkerPanel:
    """Ordered ``(marker name, channel)`` pairs plus the phenotype rules over them."""

    pairs: tuple[tuple[str, int], ...] = tuple(zip(MARKER_NAMES, MARKER_CHANNELS))
    rules: tuple[PhenotypeRule, ...] = DEFAULT_RULES
    hierarchy: tuple[tuple[str, str], ...] = PHENOTYPE_HIERARCHY

    def __post_init__(self) -> None:
        names = [n for n, _ in self.pairs]
        channels = [c for _, c in self.pairs]
        if len(set(names)) != len(names) or len(set(channels)) != len(channels):
            raise ValueError("marker names and channels must be unique")

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.pairs)

    @property
    def channels(self) -> tuple[int, ...]:
        return tuple(c for _, c in self.pairs)

    @property
    def phenotypes(self) -> tuple[str, ...]:
        return tuple(r.name for r in self.rules)

    def channel(self, name: str) -> int:
        for n, c in self.pairs:
            if n == name:
                return c
        raise KeyError(f"unknown marker: {name!r}")

    def position(self, name: str) -> int:
        return self.names.index(name)

    def subset(self, names: Sequence[str]) -> "MarkerPanel":
        """The panel restricted to ``names`` in canonical order, rules kept as they are."""
        unknown = sorted(set(names) - set(self.names))
        if unknown:
            raise KeyError(f"unknown markers: {unknown}")
        keep = set(names)
        return MarkerPanel(tuple(p for p in self.pairs if p[0] in keep), self.rules, self.hierarchy)


DEFAULT_PANEL = MarkerPanel()


@dataclass(frozen=True)
class Thresholds:
    """Calibrated cut per marker and phenotype with a confidence stratum for each."""

    marker: Mapping[str, float]
    phenotype: Mapping[str, float]
    marker_confidence: Mapping[str, str] = field(default_factory=dict)
    phenotype_confidence: Mapping[str, str] = field(default_factory=dict)
    provenance: Mapping[str, object] = field(default_factory=dict)

    def stratum(self, name: str) -> str:
        table = self.marker_confidence if name in self.marker else self.phenotype_confidence
        value = table.get(name, "weak")
        return value if value in STRATA else "weak"


def ch(channel: int, what: str, model: str | None = None) -> str:
    """Column name of one channel family, e.g. ``ch(3, "pred", "v1_1")`` -> ``ch03_pred_v1_1``."""
    return f"ch{channel:02d}_{what}" + (f"_{model}" if model else "")


def ph(name: str, what: str, model: str | None = None) -> str:
    """Column name of one phenotype family, e.g. ``phenotype_pdl1_positive_call_v1_1``."""
    return f"phenotype_{name}_{what}" + (f"_{model}" if model else "")
