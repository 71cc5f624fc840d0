"""Exact quantiles without sorting and without holding all values in one task.

Each order statistic is bracketed by a histogram; the bin that holds it becomes the next
bracket, bounded by the smallest and largest value seen in it. Ties collapse to a bracket of
one value, so a value shared by any number of rows ends the search. There is one way for all
sizes. Infinities are counted apart and rank below or above all numbers; NaN is no number and is
left out, like null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096


@dataclass
class _Search:
    name: str
    rank: int          # 0-based rank of the wanted value
    low: float
    high: float
    before: int = 0    # rows below the bracket

    @property
    def done(self) -> bool:
        return self.low == self.high


def _positions(count: int, prob: float, method: str) -> tuple[int, int, float]:
    at = prob * (count - 1)
    if method == "lower":
        at = max(0, math.floor(prob * count + 1e-9))
        at = min(at, count - 1)
    low = math.floor(at)
    return low, min(low + 1, count - 1), at - low


def exact_quantiles(values: DataFrame, probs: dict[str, list[float]],
                    method: str = "linear") -> dict[str, list[float]]:
    """Quantiles of ``x`` (double) per ``name``; both columns are given by ``values``.

    A ``weight`` column counts a row several times. ``linear`` interpolates; ``lower`` takes
    the value that has at most ``prob`` of the rows strictly below it. Only histograms of a
    fixed size reach the driver.
    """
    weight: Column = F.col("weight") if "weight" in values.columns else F.lit(1)
    values = values.where(F.col("x").isNotNull() & ~F.isnan("x"))
    copies = weight.cast("bigint")
    infinite = F.col("x").isin(math.inf, -math.inf)
    spans = {r["name"]: r for r in values.groupBy("name").agg(
        F.min(F.when(~infinite, F.col("x"))).alias("low"),
        F.max(F.when(~infinite, F.col("x"))).alias("high"),
        F.coalesce(F.sum(F.when(F.col("x") == -math.inf, copies)), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(~infinite, copies)), F.lit(0)).alias("finite"),
        F.sum(copies).alias("n")).collect()}
    values = values.where(~infinite)

    searches: dict[tuple[str, int], _Search] = {}
    wanted = {}
    for name, span in spans.items():
        for prob in probs.get(name, []):
            low, high, part = _positions(span["n"], prob, method)
            wanted[name, prob] = (low, high, part)
            for rank in (low, high) if part else (low,):
                searches[name, rank] = _search(name, rank, span)

    while open_ones := [s for s in searches.values() if not s.done]:
        _narrow(values, weight, open_ones)

    def value(name: str, prob: float) -> float:
        low, high, part = wanted[name, prob]
        bottom = searches[name, low].low
        top = searches[name, high].low if part else bottom
        return bottom if bottom == top else bottom + (top - bottom) * part

    return {n: [value(n, p) for p in probs[n]] for n in probs if n in spans}


def _search(name: str, rank: int, span) -> _Search:
    """A search among the finite values, or one that an infinity ends at once."""
    inside = rank - span["below"]
    if inside < 0:
        return _Search(name, inside, -math.inf, -math.inf)
    if inside >= span["finite"]:
        return _Search(name, inside, math.inf, math.inf)
    return _Search(name, inside, span["low"], span["high"])


def _narrow(values: DataFrame, weight: Column, searches: list[_Search]) -> None:
    spark = values.sparkSession
    table = spark.createDataFrame(
        [(i, s.name, s.low, s.high) for i, s in enumerate(searches)],
        "search int, name string, low double, high double")
    width = F.col("high") / BINS - F.col("low") / BINS
    # In a bracket too narrow to cut, the lowest value is parted from the others.
    position = F.when(width > 0, F.col("x") / width - F.col("low") / width).otherwise(
        F.when(F.col("x") > F.col("low"), 1.0).otherwise(0.0))
    bins = (
        values.withColumn("_w", weight.cast("bigint"))
        .join(F.broadcast(table), "name")   # a handful of searches
        .where(F.col("x").between(F.col("low"), F.col("high")))
        .withColumn("bin", F.least(F.floor(position), F.lit(BINS - 1)))
        .groupBy("search", "bin")
        .agg(F.sum("_w").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        .orderBy("search", "bin").collect()
    )
    below = {i: s.before for i, s in enumerate(searches)}
    settled = set()
    for row in bins:
        i = row["search"]
        if i in settled:
            continue
        search = searches[i]
        if below[i] + row["n"] > search.rank:
            # the two ends of a bracket fall into different bins, so it always shrinks
            search.low, search.high, search.before = row["low"], row["high"], below[i]
            settled.add(i)
        else:
            below[i] += row["n"]
