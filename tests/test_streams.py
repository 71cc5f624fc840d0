"""Streams in several batches give what the batch operators give."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.operators import correlate, fusion, snapshots
from palisade.plans import queries
from palisade.sources import tail
from palisade.streaming import fusion as live_fusion
from palisade.streaming import snapshots as live
from tests.test_fusion import frame, random_frames
from tests.test_sequences import loop_changes, random_snapshots


def written_one_by_one(df, folder, cuts):
    """One file per range of ``seq``, each newer than the last."""
    for low, high in zip(cuts, cuts[1:]):
        df.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode(
            "append").parquet(folder)


def stream_of(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option(
        "maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def stateful(spark):
    return live.stateful_session(spark)


def snapshot_table(spark, rows):
    return spark.createDataFrame(
        rows, "seq bigint, source string, data map<string,string>").withColumn(
        "timestamp", F.lit("t"))


def test_changes_over_batches(spark, stateful, tmp_path):
    rows = random_snapshots(300, 11)
    folder = str(tmp_path / "in")
    written_one_by_one(snapshot_table(spark, rows), folder, [0, 70, 150, 300])
    got = queries._run_stream(live.changes(stream_of(stateful, folder)), spark, "changes")
    assert sorted(r["seq"] for r in got.collect()) == loop_changes(rows)


def test_changes_start_from_earlier_output(spark, stateful, tmp_path):
    old, new = random_snapshots(100, 12), random_snapshots(200, 13)
    kept = snapshots.distinct_states(snapshot_table(spark, old))
    seed_path = str(tmp_path / "seed")
    snapshots.last_states(kept).write.parquet(seed_path)
    cache = {r["uid"]: r["data"] for r in spark.read.parquet(seed_path).collect()}
    folder = str(tmp_path / "in")
    written_one_by_one(snapshot_table(spark, new), folder, [0, 90, 200])
    seed = stateful.read.parquet(seed_path)
    got = queries._run_stream(live.changes(stream_of(stateful, folder), seed), spark, "changes")
    assert sorted(r["seq"] for r in got.collect()) == loop_changes(new, cache)


def test_ledger_over_batches(spark, stateful, tmp_path):
    df = frame(spark, random_frames(400, 14))
    folder = str(tmp_path / "in")
    written_one_by_one(df, folder, [0, 100, 180, 400])
    got = queries._run_stream(live_fusion.ledger(stream_of(stateful, folder)), spark, "ledger")
    want = fusion.ledger(df)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_recent_ledger_over_batches(spark, stateful, tmp_path):
    df = frame(spark, random_frames(400, 15, base=0.6))
    folder = str(tmp_path / "in")
    written_one_by_one(df, folder, [0, 120, 250, 400])
    got = queries._run_stream(
        live_fusion.recent_ledger(stream_of(stateful, folder)), spark, "recent")
    want = fusion.fuse(correlate.with_recent_bonus(df).where("base > 0"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def loop_recent(rows, order, span, lateness, newest_of):
    """Bonus by a plain loop over rows in arrival order; ``newest_of`` knows earlier batches."""
    seen, out = [], {}
    for k in order:
        at, src, tag, seq = rows[k]
        near = [t for a, s, t, _ in seen if s == src and at - span <= a <= at]
        out[seq] = any(t != tag for t in near) or sum(t == tag for t in near) > 5
        if at >= newest_of(k) - lateness:
            seen.append(rows[k])
    return out


def test_recent_hits_against_a_loop():
    """Batches out of order: rows too late are scored and not remembered."""
    rng = random.Random(21)
    rows = [(k // 3 + rng.choice([0, 0, 0, -8, -40]), "s", rng.choice("abc"), k) for k in range(400)]
    span, lateness, held, high, got, order = 9, 5, {}, -10**6, {}, []
    newest = {}
    for start in range(0, 400, 37):
        part = sorted(range(start, min(start + 37, 400)), key=lambda k: (rows[k][0], k))
        batch = pd.DataFrame({"at": [rows[k][0] for k in part], "tag": [rows[k][2] for k in part]})
        on_time = (batch["at"] >= high - lateness).to_numpy()
        got |= dict(zip(part, live_fusion.recent_hits(held, batch, span, on_time)))
        newest |= dict.fromkeys(part, high)
        order += part
        timely = batch[on_time]
        high = max(high, int(batch["at"].max()))
        for tag in "abc":
            held[tag] = live_fusion.remembered(
                held.get(tag, np.zeros(0, np.int64)),
                timely["at"][timely["tag"] == tag].to_numpy(np.int64), high - span - lateness)
            assert len(held[tag]) <= 6 * (span + lateness + 1)
    want = loop_recent(rows, order, span, lateness, newest.get)
    exact = [k for k in order if rows[k][0] >= newest[k] - lateness]  # later rows may miss the pruned
    assert len(exact) < 400 and all(got[k] == want[k] for k in exact)
    assert all(want[k] or not got[k] for k in order)


def test_idle_sources_hold_no_state(spark, stateful, tmp_path):
    """The watermark of a later batch clears the sources of the first."""
    rows = [(k, f"10.0.0.{k}", "a", 1.0, 100 + k % 5) for k in range(50)]
    rows += [(k, "10.0.1.1", "b", 1.0, 100 + 20 * k) for k in range(50, 90)]
    df = spark.createDataFrame(rows, "seq long, src_ip string, tag string, base double, at long")
    df = df.withColumns({"ts": F.lit("2026-01-01").cast("timestamp_ntz"), "payload": F.lit("p")})
    folder = str(tmp_path / "in")
    written_one_by_one(df, folder, [0, 50, 60, 70, 90])
    rows = live_fusion.recent_ledger(stream_of(stateful, folder))
    run = rows.writeStream.format("noop").option(
        "checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    run.awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "mark"))
    assert {r[0] for r in held.select("key.src_ip").distinct().collect()} == {"10.0.1.1"}


def test_rolled_lines_know_their_source(spark, tmp_path):
    folder = tmp_path / "dumps"
    folder.mkdir()
    (folder / "network-001.log").write_text("--- [t] NETWORK DUMP ---\nTCP a:1 b:2 LISTEN 7\n")
    (folder / "os-001.log").write_text("svc up\nlone\n")
    records = live.normalized(live.rolled_lines(spark, str(folder)))
    path, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    live.write_records(records, path, mark, availableNow=True).awaitTermination()
    rows = tail.read_log(spark, path, records.schema).collect()
    assert {(r["source"], r["data"]["pid"] if r["source"] == "NETWORK" else None)
            for r in rows} == {("NETWORK", "7"), ("OS", None)}


def test_push_publishes_every_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    written_one_by_one(frame(spark, random_frames(60, 16)), folder, [0, 30, 60])
    seen = []
    live_fusion.push(stream_of(spark, folder), lambda batch, _: seen.append(batch.count()),
                     str(tmp_path / "mark"), once=True).awaitTermination()
    assert seen == [30, 30]


class HeldList:
    """Stands in for the list state of a bucket and counts its calls."""

    def __init__(self):
        self.held, self.calls = [], 0

    def get(self):
        self.calls += 1
        return iter(list(self.held))

    def appendList(self, rows):
        self.calls += 1
        self.held += rows

    def put(self, rows):
        self.calls += 1
        self.held = list(rows)


def test_a_call_takes_many_entities_and_writes_only_changes():
    filter_ = live.ChangeFilter()
    filter_.last = HeldList()
    rows = [(f"APP:{k % 50}", k, "t", "APP", f"s{k % 50 % 3}", "{}") for k in range(400)]
    batch = pd.DataFrame(rows, columns=live.CHANGE_COLUMNS).sample(frac=1.0, random_state=3)
    out = pd.concat(filter_.handleInputRows((0,), iter([batch[:150], batch[150:]]), None))
    assert sorted(out["seq"]) == list(range(50))
    assert (filter_.last.calls, len(filter_.last.held)) == (2, 50)
    more = batch.assign(seq=batch["seq"] + 400)
    more.loc[more["seq"] == 799, ["uid", "state"]] = [None, "new"]
    out = pd.concat(filter_.handleInputRows((0,), iter([more]), None))
    assert list(out["seq"]) == [799] and len(filter_.last.held) == 51
    assert not list(filter_.handleInputRows((0,), iter([more]), None))
    for k in range(5):  # the log stays within twice its entities
        last = more.assign(seq=more["seq"] + 400 * k, state=f"t{k}")
        assert len(pd.concat(filter_.handleInputRows((0,), iter([last]), None))) == 51
        assert len(filter_.last.held) <= 2 * 51
        assert dict(filter_.last.held) == dict.fromkeys({"", *batch["uid"]}, f"t{k}")


def test_changes_group_by_bucket(spark, stateful, tmp_path):
    folder = str(tmp_path / "in")
    written_one_by_one(snapshot_table(spark, random_snapshots(30, 17)), folder, [0, 30])
    plan = live.changes(stream_of(stateful, folder))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan and "bucket" in plan
