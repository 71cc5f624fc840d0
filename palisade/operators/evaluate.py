"""Confusion counts and the measures derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import text


def confusion(judged: DataFrame, *keys: str) -> DataFrame:
    """Counts of ``truth`` against ``pred`` (0 or 1), per key."""
    def cell(truth: int, pred: int) -> Column:
        return F.count_if((F.col("truth") == truth) & (F.col("pred") == pred))

    return judged.groupBy(*keys).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(
        top.cast("double") / F.when(bottom == 0, F.lit(None)).otherwise(bottom).cast("double"))


def measures(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1; a division by zero gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "accuracy": _ratio(tn + tp, tn + fp + fn + tp),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    })


def specialist_judgements(scored: DataFrame) -> DataFrame:
    """``tag, truth, pred`` of each layer's own model, whitelist or not.

    ``scored`` holds every frame with ``payload, act, dataset`` and the verdict ``base``.
    """
    tag = text.specialist_of(text.refined_layer(F.col("payload"), F.col("act")))
    return scored.select(
        tag.alias("tag"),
        text.truth_label(F.col("payload"), F.col("act"), F.col("dataset")).alias("truth"),
        F.when(F.col("base") > 0, 1).otherwise(0).alias("pred"))


def fusion_judgements(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``truth, pred`` of the fused verdict; a whitelisted frame counts as predicted 0.

    Only alerts predict 1, so the join carries alerts, not all frames.
    """
    raised = verdicts.where("is_anomaly").select("seq", F.lit(1).alias("_raised"))
    return scored.join(raised, "seq", "left").select(
        text.truth_label(F.col("payload"), F.col("act"), F.col("dataset")).alias("truth"),
        F.coalesce("_raised", F.lit(0)).alias("pred"))
