"""Live snapshots as streams: collect, normalise, keep changes only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palisade import schema
from palisade.operators import snapshots
from palisade.sources import tail

FILES_PER_TRIGGER = 100  # bounds what one batch, and so one entity in it, can hold
ENTITY_BUCKETS = 1024     # of the state, fixed in a checkpoint; a task takes one after the other
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE_COLUMNS = ["uid", "seq", "timestamp", "source", "state", "record"]
_CHANGES = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("record", T.StringType()),
])


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store the stateful operators need."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


def source_of(name: Column) -> Column:
    """The kind of a dump, told by its file's name."""
    name = F.lower(name)
    return (
        F.when(name.startswith("network"), F.lit("NETWORK"))
        .when(name.startswith("os"), F.lit("OS"))
        .when(name.startswith("app"), F.lit("APP"))
    )


def tail_lines(spark: SparkSession, folder: str, start: str = "end") -> DataFrame:
    """New lines of the growing dumps in ``folder``: ``source`` and ``line``."""
    rows = tail.tail(spark, folder, from_=start)
    return rows.select(source_of(F.col("file")).alias("source"), "line")


def rolled_lines(spark: SparkSession, folder: str, since=None) -> DataFrame:
    """Lines of dumps that are rolled, not appended to, so that whole files arrive.

    With ``since`` older files are passed over.
    """
    rows = spark.readStream.option("maxFilesPerTrigger", FILES_PER_TRIGGER).text(folder)
    if since is not None:
        rows = rows.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    return rows.select(source_of(F.col("_metadata.file_name")).alias("source"),
                       F.col("value").alias("line"))


def normalized(lines: DataFrame) -> DataFrame:
    """Snapshot records of a stream of lines; stateless."""
    records = snapshots.parse_lines(lines)
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return records.select(at.alias("timestamp"), "source", "data",
                          *[c for c in ("seq",) if c in records.columns])


def write_records(records: DataFrame, path: str, checkpoint: str, **trigger):
    """Appends records as JSON lines, each batch once; ``tail.read_log`` reads them."""
    return tail.append(records, path, checkpoint, **trigger)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of stored records with their order column ``seq``."""
    fields = T.StructType([*schema.SNAPSHOT.fields, T.StructField("seq", T.LongType())])
    return (
        spark.readStream.schema(fields).option("maxFilesPerTrigger", FILES_PER_TRIGGER)
        .option("mode", "DROPMALFORMED").json(folder)
    )


class ChangeFilter(StatefulProcessor):
    """Passes a row when its entity is new or its data differs from the entity's last row.

    A call takes a bucket of entities, so its fixed cost is shared by all of them. The state is a
    log of entities' last data, the latest entry counting: it is read at once, changes are added
    at once, and it is written anew when most of it is out of date.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "uid string, state string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.last.appendList(list(zip(initialState["uid"], initialState["state"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame],
                        timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        batch = pd.concat(parts) if len(parts) > 1 else parts[0]
        # an absent id is an entity of its own; no id is empty
        uids, states = batch["uid"].fillna("").to_numpy(), batch["state"].to_numpy()
        entity, names = pd.factorize(uids)
        # arrival order inside a batch is the order column's
        order = np.lexsort((batch["seq"].to_numpy(), entity))
        entity, states = entity[order], states[order]
        first = np.diff(entity, prepend=-1) > 0
        before = np.empty(len(order), object)
        before[1:] = states[:-1]
        entries = list(self.last.get())
        held = dict(entries)
        before[first] = [held.get(uid) for uid in names]
        latest = zip(names, states[np.append(first[1:], True)])
        news = [(uid, state) for uid, state in latest if uid not in held or held[uid] != state]
        held.update(news)
        if len(entries) + len(news) > 2 * len(held):
            self.last.put(list(held.items()))
        elif news:
            self.last.appendList(news)
        changed = batch.iloc[order[pd.isna(before) | (before != states)]]
        if len(changed):
            yield changed[CHANGE_COLUMNS]

    def close(self) -> None:
        pass


def _bucket(uid: Column) -> Column:
    return F.pmod(F.xxhash64(uid), F.lit(ENTITY_BUCKETS)).alias("bucket")


def changes(records: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Stream of state changes; ``seed`` (``uid``, ``data``) carries on an earlier output."""
    rows = snapshots.identified(records).select(
        _bucket(F.col("uid")), "uid", "seq", "timestamp", "source",
        snapshots.state_text(F.col("data")).alias("state"),
        F.to_json("data").alias("record"))
    start = None
    if seed is not None:
        start = seed.select(
            _bucket(F.col("uid")), F.coalesce("uid", F.lit("")).alias("uid"),
            snapshots.state_text(F.col("data")).alias("state")).groupBy("bucket")
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=ChangeFilter(), outputStructType=_CHANGES, outputMode="append",
        timeMode="none", initialState=start)
