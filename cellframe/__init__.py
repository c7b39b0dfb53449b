"""Spark-native analytics for tables of segmented cells grouped into tissue cores."""

from cellframe.panel import DEFAULT_PANEL, MarkerPanel, PhenotypeRule, Thresholds

__all__ = ["DEFAULT_PANEL", "MarkerPanel", "PhenotypeRule", "Thresholds"]
