"""Writers for frames, alerts and raw fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame

from palisade.operators import fusion


def write_frames(frames: DataFrame, path: str) -> None:
    """One folder per dataset."""
    frames.write.mode("overwrite").partitionBy("dataset").parquet(path)


def write_frames_json(frames: DataFrame, path: str) -> None:
    frames.write.mode("overwrite").json(path)


def write_alerts(found: DataFrame, path: str) -> None:
    """Replaces the alerts table: ISO time text, evidence never empty."""
    fusion.exported(found).write.mode("overwrite").json(path)


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("append").json(path)
