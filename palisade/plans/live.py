"""Queries over growing files: tails, pushes and logs that are appended once."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade import constants as C
from palisade import session
from palisade.operators import snapshots
from palisade.plans import adapters as A
from palisade.sources import tail
from palisade.streaming import fusion as live_fusion
from palisade.streaming import snapshots as live_snapshots

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Growing files per kind of dump, and phases in which they grow.
COLLECTORS = 4
PHASES = 4
#: Time limit of a push here; the live one is ``constants.PUSH_SECONDS``.
PUSH_WAIT = 1.0
STUCK_SECONDS = 600


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def local_path(uri: str) -> str:
    """A shared folder as the collectors see it: they write plain files."""
    if "://" in uri and not uri.startswith("file://"):
        raise ValueError("growing files need a shared folder that is a file system path")
    return uri.removeprefix("file://").removeprefix("file:")


def grow(lines: DataFrame, folder: str) -> None:
    """Appends ``line`` to the growing file ``file`` in the order of ``seq``: the collectors.

    A task that runs again first cuts its files back to their sizes before this call.
    """
    place = local_path(folder)
    os.makedirs(place, exist_ok=True)
    sizes = {name: os.path.getsize(f"{place}/{name}") for name in os.listdir(place)}

    def write(rows: Iterator[Row]) -> None:
        name = stream = None
        for row in rows:
            if row.file != name:
                if stream:
                    stream.close()
                name = row.file
                stream = open(f"{place}/{name}", "ab")
                stream.truncate(sizes.get(name, 0))
            stream.write(row.line.encode() + b"\n")
        if stream:
            stream.close()

    lines.select("file", "seq", "line").repartition("file").sortWithinPartitions(
        "file", "seq").foreachPartition(write)


def turn_over(folder: str, name: str) -> None:
    """Renames a growing file as collectors do; the next line starts a new one."""
    place = local_path(folder)
    if os.path.exists(f"{place}/{name}"):
        os.rename(f"{place}/{name}", f"{place}/{name}.1")


@query
def stream_tail(spark, sf_dir):
    """Dumps that grow while a stream follows them from their end on; one is turned over."""
    folder = session.scratch_path(spark, "tailed")
    kind = F.lower("source")
    number = (F.col("seq") % COLLECTORS).cast("string")
    # The first lines tell files apart, so they name their file.
    lines = session.materialize(A.snapshot_lines(spark, sf_dir).select(
        F.concat(kind, F.lit("-"), number, F.lit(".log")).alias("file"), "seq", "line"), "lines")
    top = lines.agg(F.max("seq")).first()[0] or 0
    heads = lines.select("file").distinct().select(
        "file", F.lit(-1).cast("long").alias("seq"),
        F.concat(F.lit("--- ["), "file", F.lit("] ---")).alias("line"))
    phase = F.least(F.floor(F.col("seq") * PHASES / F.lit(top + 1)), F.lit(PHASES - 1))
    parts = [lines.where(phase == k) for k in range(PHASES)]
    grow(heads.unionByName(parts[0]), folder)
    own = spark.newSession()
    records = live_snapshots.normalized(live_snapshots.tail_lines(own, folder))
    log, mark = (session.scratch_path(spark, n) for n in ("tail-log", "mark"))
    run = tail.append(records, log, mark)
    try:
        run.processAllAvailable()
        for k in range(1, PHASES):
            if k == 2:
                turn_over(folder, "network-1.log")
                grow(heads.where(F.col("file") == "network-1.log").withColumn(
                    "line", F.concat("line", F.lit(" again ---"))), folder)
            grow(parts[k], folder)
            run.processAllAvailable()
    finally:
        run.stop()
    out = tail.read_log(spark, log, records.schema)
    return out.select("source", snapshots.state_text(F.col("data")).alias("state")).groupBy(
        "source", "state").agg(F.count("*").alias("n"))


@query
def stream_append(spark, sf_dir):
    """Records appended by a stream; every batch is run again and adds nothing."""
    folder, log = (session.scratch_path(spark, n) for n in ("records", "log"))
    lines = session.materialize(A.snapshot_lines(spark, sf_dir), "lines")
    for k in range(3):
        lines.where(F.pmod("seq", F.lit(3)) == k).write.mode("append").parquet(folder)
    own = spark.newSession()
    files = len(spark.read.parquet(folder).inputFiles())
    for _ in range(2):
        rows = own.readStream.schema(lines.schema).option(
            "maxFilesPerTrigger", max(1, files // 3)).parquet(folder)
        records = live_snapshots.normalized(rows)
        live_snapshots.write_records(records, log, session.scratch_path(spark, "mark"),
                                     availableNow=True).awaitTermination()
    out = tail.read_log(spark, log, records.schema)
    return out.select("seq", "source", snapshots.state_text(F.col("data")).alias("state"))


@query
def stream_push(spark, sf_dir):
    """Frames and suspicious frames of every push: after 30 frames, or when time is up.

    Frames lie in one growing file per dataset, in the order in which datasets are read.
    """
    folder, state, mark, out = (session.scratch_path(spark, n)
                                for n in ("frames", "state", "mark", "pushes"))
    names = {name: f"{k:02d}-{name}.json" for k, (name, _, _) in enumerate(C.DATASETS)}
    names = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    frames = session.materialize(A.event_frames(spark, sf_dir).select(
        names[F.col("dataset")].alias("file"), "seq",
        F.to_json(F.struct("seq", "dataset", "base")).alias("line")), "frames")
    total = frames.count()
    grow(frames, folder)
    own = spark.newSession()
    most = max(1, -(-total // (8 * C.PUSH_FRAMES))) * C.PUSH_FRAMES
    rows = tail.tail(own, folder, from_="start", frames=C.PUSH_FRAMES, most=most,
                     seconds=PUSH_WAIT, state=state)
    done = {}

    def publish(batch: DataFrame, number: int) -> None:
        given = batch.withColumn("frame", F.from_json("line", "seq long, dataset string, base double"))
        counted = live_fusion.in_pushes(given).groupBy("push").agg(
            F.count("*").alias("frames"),
            F.sum((F.col("frame.base") > 0).cast("long")).alias("suspicious"))
        path = f"{out}/batch={number}"
        counted.write.mode("overwrite").parquet(path)
        done[number] = batch.sparkSession.read.parquet(path).agg(F.sum("frames")).first()[0] or 0

    run = live_fusion.push(rows, publish, mark)
    end = time.monotonic() + STUCK_SECONDS
    try:
        while sum(done.values()) < total:
            if not run.isActive or time.monotonic() > end:
                raise RuntimeError(f"{sum(done.values())} of {total} frames were pushed")
            time.sleep(0.2)
    finally:
        run.stop()
    if not total:
        return spark.createDataFrame([], "push long, frames long, suspicious long")
    pushes = spark.read.parquet(out)
    # One row per batch: how many pushes came before it.
    by_batch = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    before = pushes.groupBy("batch").agg(F.max("push").alias("last")).select("batch", F.coalesce(
        F.sum(F.col("last") + 1).over(by_batch), F.lit(0)).alias("before"))
    return pushes.join(F.broadcast(before), "batch").select(
        (F.col("before") + F.col("push")).alias("push"), "frames", "suspicious")
