"""Fused scores, the ledger of suspicious frames and the alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import constants as C
from palisade.functions import scoring, text, times
from palisade.operators import correlate

ALERT_COLUMNS = ["seq", "ts", "src_ip", "tag", "base", "score", "is_anomaly", "payload"]


def fuse(frames: DataFrame) -> DataFrame:
    """Frames with ``base`` and ``bonus`` to one verdict per frame.

    The verdict uses the unrounded score.
    """
    fused = scoring.fused(F.col("base"), F.col("tag"), F.col("bonus"))
    extra = [c for c in frames.columns if c == "forensics"]
    return frames.withColumn("_fused", fused).select(
        "seq", "ts", "src_ip", "tag", "base",
        F.round("_fused", 2).alias("score"),
        (F.col("_fused") >= C.ALERT_THRESHOLD).alias("is_anomaly"),
        text.preview(F.col("payload")).alias("payload"),
        *[scoring.evidence_or_default(F.col(c)).alias(c) for c in extra],
    )


def verdicts(frames: DataFrame) -> DataFrame:
    """A verdict for every enriched, scored frame."""
    return fuse(correlate.with_bonus(frames))


def ledger(frames: DataFrame) -> DataFrame:
    """Verdicts of the suspicious frames only.

    History holds nothing but suspicious frames, so the rest is dropped before the join.
    """
    return verdicts(frames.where(F.col("base") > 0))


def alerts(frames: DataFrame) -> DataFrame:
    """The ledger's rows at or above the threshold; a frame without suspicion never is."""
    return ledger(frames).where("is_anomaly")


def recent_verdicts(frames: DataFrame, at: str = "at",
                    span: int = C.CORRELATION_SECONDS) -> DataFrame:
    """Verdicts with the time-limited correlation."""
    return fuse(correlate.with_recent_bonus(frames, at, span))


def exported(found: DataFrame) -> DataFrame:
    """Rows as they are written out: ISO time text, evidence never empty."""
    forensics = (F.col("forensics") if "forensics" in found.columns
                 else F.lit(None).cast("array<string>"))
    return found.select(
        times.iso_text(F.col("ts")).alias("ts"), "src_ip", "tag", "score", "is_anomaly",
        scoring.evidence_or_default(forensics).alias("forensics"), "payload")
