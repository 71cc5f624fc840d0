"""Fusion over a stream of scored frames, and the push policy of the alerts table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from palisade import constants as C
from palisade.operators import correlate, fusion

_COLUMNS = ["seq", "ts", "src_ip", "tag", "base", "payload", "bonus"]
_BONUSED = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("base", T.DoubleType()),
    T.StructField("payload", T.StringType()),
    T.StructField("bonus", T.DoubleType()),
])


class SourceHistory(StatefulProcessor):
    """Counts the suspicious frames of a source per layer, up to the number that matters.

    ``base`` is positive on every row: frames without suspicion never alert and leave no
    history, so they do not come here.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "tag string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame],
                        timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", ignore_index=True)
        known = {t[0]: n[0] for t, n in self.seen.iterator()}
        # hits before each row, per layer and over all layers, as running counts
        own = batch.groupby("tag").cumcount() + batch["tag"].map(known).fillna(0)
        every = batch.index.to_series() + sum(known.values())
        hit = (every > own) | (own > C.REPEAT_LIMIT)
        batch["bonus"] = hit.map({True: C.CORRELATION_BONUS, False: 0.0})
        for tag, n in batch["tag"].value_counts().items():
            total = min(known.get(tag, 0) + int(n), correlate.NEEDED_HITS)
            self.seen.updateValue((tag,), (total,))
        yield batch[_COLUMNS]

    def close(self) -> None:
        pass


def ledger(frames: DataFrame) -> DataFrame:
    """Ledger rows of a stream of enriched, scored frames.

    Frames with an unknown address have no history: they pass by the state and are not
    gathered under one key.
    """
    suspect = frames.where(F.col("base") > 0)
    plain = suspect.select(*_COLUMNS[:-1])
    known = plain.where(F.col("src_ip") != C.UNKNOWN_IP)
    unknown = plain.where(F.col("src_ip") == C.UNKNOWN_IP).withColumn("bonus", F.lit(0.0))
    correlated = known.groupBy("src_ip").transformWithStateInPandas(
        statefulProcessor=SourceHistory(), outputStructType=_BONUSED, outputMode="append",
        timeMode="none")
    return fusion.fuse(correlated.unionByName(unknown))


def in_pushes(batch: DataFrame, frames: int = C.PUSH_FRAMES) -> DataFrame:
    """Adds ``push``, the number of the push inside a batch of tailed frames.

    A batch holds at most the source's ``most`` lines, so one task may number them.
    """
    order = Window.orderBy("file", "at")
    return batch.withColumn("push", F.floor((F.row_number().over(order) - 1) / frames))


def push(rows: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str,
         seconds: float | None = None, once: bool = False):
    """Hands every batch to ``publish``.

    A ``tail`` with ``frames`` lets a batch through after 30 frames or 20 seconds, whichever
    comes first. Other sources take a batch every ``seconds``.
    """
    trigger = {"availableNow": True} if once else {
        "processingTime": f"{seconds} seconds" if seconds else "100 milliseconds"}
    return (
        rows.writeStream.foreachBatch(publish).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


#: Rows this much older than the newest are past all use; only they are lost to the engine's
#: rule that drops what is older than the watermark.
PAST_SECONDS = 3650 * 86400


def recent_hits(held: dict[str, np.ndarray], batch: pd.DataFrame, span: int,
                timely: np.ndarray) -> np.ndarray:
    """Which rows of ``batch`` (in order of time) earn the bonus; ``timely`` ones make history.

    ``held`` has the remembered times per layer, ascending. Layers are a short list; everything
    per layer is a search in sorted times.
    """
    at, tag = batch["at"].to_numpy(np.int64), batch["tag"].to_numpy(object)
    place, since = np.arange(len(batch)), at - span
    hit = np.zeros(len(batch), bool)
    for layer in {*held, *tag}:
        old = held.get(layer, np.zeros(0, np.int64))
        where = np.flatnonzero((tag == layer) & timely)
        times, own = at[where], tag == layer
        before = np.searchsorted(where, place)
        expired = np.minimum(np.searchsorted(times, since), before)
        n = before - expired + np.maximum(
            np.searchsorted(old, at, "right") - np.searchsorted(old, since), 0)
        hit |= np.where(own, n > C.REPEAT_LIMIT, n > 0)
    return hit


def remembered(old: np.ndarray, new: np.ndarray, oldest: int) -> np.ndarray:
    """Times from ``oldest`` on, ascending; of equal ones no more than can matter."""
    times = np.sort(np.concatenate((old, new)))
    times = times[times >= oldest]
    more = np.zeros(len(times), bool)
    more[correlate.NEEDED_HITS:] = times[correlate.NEEDED_HITS:] == times[:-correlate.NEEDED_HITS]
    return times[~more]


class RecentHistory(StatefulProcessor):
    """Keeps, per layer, the times of a source's hits that can still matter.

    Rows carry the whole-number time ``at``; the watermark is the newest time of earlier batches.
    A row later than ``lateness`` is scored but not remembered. The state of a source holds at most
    six times per layer and time unit of the span and the lateness, and a timer clears it when the
    watermark has passed its last hit by both: a source that never returns leaves nothing.
    """

    def __init__(self, span: int, lateness: int):
        self.span = span
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "tag string", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame],
                        timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"], ignore_index=True)
        held = self._held()
        newest = timerValues.getCurrentWatermarkInMs() // 1000
        timely = (batch["at"] >= newest - self.lateness).to_numpy()
        hit = recent_hits(held, batch, self.span, timely)
        batch["bonus"] = np.where(hit, C.CORRELATION_BONUS, 0.0)
        newest = max(newest, int(batch["at"].iloc[-1]))
        fresh = {tag: own.to_numpy(np.int64) for tag, own in batch[timely].groupby("tag")["at"]}
        self._keep(held, fresh, newest, timed=bool(held))
        yield batch[_COLUMNS]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._held(), {}, timerValues.getCurrentWatermarkInMs() // 1000, timed=False)
        return iter([])

    def _held(self) -> dict[str, np.ndarray]:
        return {t[0]: np.array(times[0], np.int64) for t, times in self.seen.iterator()}

    def _keep(self, held: dict[str, np.ndarray], fresh: dict[str, np.ndarray], newest: int,
              timed: bool) -> None:
        """Stores what can still matter; a source with a state has one timer."""
        none, reach, last = np.zeros(0, np.int64), self.span + self.lateness, None
        for tag in {*held, *fresh}:
            times = remembered(held.get(tag, none), fresh.get(tag, none), newest - reach)
            if len(times):
                self.seen.updateValue((tag,), (times.tolist(),))
                last = max(last or times[-1], times[-1])
            elif tag in held:
                self.seen.removeKey((tag,))
        if last is not None and not timed:
            self.handle.registerTimer((int(last) + reach + 1) * 1000)

    def close(self) -> None:
        pass


def recent_ledger(frames: DataFrame, at: str = "at", span: int = C.CORRELATION_SECONDS,
                  lateness: int = C.CORRELATION_SECONDS) -> DataFrame:
    """Ledger rows with the time-limited correlation, for frames that may be out of order.

    The clock runs ahead by ``PAST_SECONDS`` and the watermark stays behind by as much, so the
    watermark is the newest time seen, and late rows still reach the state.
    """
    ahead = F.timestamp_seconds(F.col("at") + F.lit(PAST_SECONDS))
    suspect = frames.where(F.col("base") > 0).select(
        *_COLUMNS[:-1], F.col(at).cast("bigint").alias("at")).withColumn("clock", ahead)
    suspect = suspect.withWatermark("clock", f"{PAST_SECONDS} seconds")
    known = suspect.where(F.col("src_ip") != C.UNKNOWN_IP)
    unknown = suspect.where(F.col("src_ip") == C.UNKNOWN_IP).withColumn("bonus", F.lit(0.0))
    correlated = known.groupBy("src_ip").transformWithStateInPandas(
        statefulProcessor=RecentHistory(span, lateness), outputStructType=_BONUSED,
        outputMode="append", timeMode="EventTime")
    return fusion.fuse(correlated.unionByName(unknown.drop("at", "clock")))
