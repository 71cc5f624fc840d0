"""Column expressions over scores and evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import constants as C


def layer_weight(tag: Column) -> Column:
    """Weight by literal tag; the long host names have none and get the default."""
    out = None
    for name, weight in C.LAYER_WEIGHTS.items():
        out = F.when(tag == name, F.lit(weight)) if out is None else out.when(
            tag == name, F.lit(weight))
    return out.otherwise(F.lit(C.DEFAULT_WEIGHT))


def fused(base: Column, tag: Column, bonus: Column) -> Column:
    raw = base * layer_weight(tag) / F.lit(C.WEIGHT_SCALE) + bonus
    return F.least(F.lit(1.0), raw)


def verdict(prediction: Column) -> Column:
    """A model's -1 becomes 1.0, anything else 0.0."""
    return F.when(prediction == -1, F.lit(1.0)).otherwise(F.lit(0.0))


def severity(score: Column) -> Column:
    return F.when(score > C.HIGH_SEVERITY, F.lit("high")).otherwise(F.lit("medium"))


def p_normal(decision: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-decision))


def p_anomaly(decision: Column) -> Column:
    return F.lit(1.0) - p_normal(decision)


def flow_evidence_text(name: Column, value: Column, shap: Column) -> Column:
    return F.format_string("%s: %d (SHAP: %.2f)", name, value, shap)


def flow_evidence(found: Column, explained: Column, error: Column) -> Column:
    """Evidence of a flagged flow: what was found, or why nothing was.

    ``explained`` is false when no explainer exists, ``error`` holds its failure text.
    """
    return (
        F.when(~explained, F.array(F.lit(C.EVIDENCE_NO_EXPLAINER)))
        .when(error.isNotNull(),
              F.array(F.format_string(C.EVIDENCE_EXPLAINER_ERROR, error)))
        .when(F.size(found) > 0, found)
        .otherwise(F.array(F.lit(C.EVIDENCE_NO_FLOW_FEATURE)))
    )


def text_evidence(found: Column, failed: Column) -> Column:
    return F.when(failed, F.array(F.lit(C.EVIDENCE_TEXT_TIMEOUT))).otherwise(found)


def evidence_or_default(found: Column) -> Column:
    empty = found.isNull() | (F.size(found) == 0)
    return F.when(empty, F.array(F.lit(C.EVIDENCE_DEFAULT))).otherwise(found)


def evidence_display(found: Column) -> Column:
    ticked = F.transform(found, lambda e: F.concat(F.lit("`"), e, F.lit("`")))
    return F.array_join(ticked, " ")
