"""Robust scaling by median and interquartile range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import constants as C
from palisade.operators.quantiles import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]


def long_form(rows: DataFrame, names: list[str]) -> DataFrame:
    """One ``(name, x)`` row per feature value."""
    return rows.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names])))


def robust_stats(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``feature, q1, center, q3, scale``; a zero range scales by 1."""
    names = names or C.FLOW_FEATURES
    found = exact_quantiles(long_form(rows, names), {n: QUARTILES for n in names})
    out = [(n, q1, mid, q3, (q3 - q1) or 1.0)
           for n, (q1, mid, q3) in ((n, found[n]) for n in names)]
    return rows.sparkSession.createDataFrame(
        out, "feature string, q1 double, center double, q3 double, scale double")


def scale_map(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """Center and scale per feature; the table has one row per feature."""
    return {r["feature"]: (r["center"], r["scale"]) for r in stats.collect()}


def scaled(rows: DataFrame, by: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds ``<feature>_scaled``: plain arithmetic, no model object."""
    return rows.withColumns({
        f"{n}_scaled": (F.col(n).cast("double") - F.lit(center)) / F.lit(scale)
        for n, (center, scale) in by.items()})
