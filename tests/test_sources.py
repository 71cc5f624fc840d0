"""Readers and writers on small generated files."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from palisade import constants as C
from palisade.operators import fusion, normalize, sequence, synth
from palisade.sources import models, readers, sinks



def base():
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


def test_flow_csv_with_blanks_missing_columns_and_bad_numbers(spark, tmp_path):
    file = tmp_path / "flow.csv"
    file.write_text(" Destination Port, Total Length of Fwd Packets, Label,Other\n"
                    " 80, 10, BENIGN,1\n443,7.0,DDoS,2\nInfinity,1,BENIGN,3\n")
    flows = readers.flow_csv(spark, str(file), "d")
    assert set(flows.columns) == {"dst_pt", "b_out", "label", "dataset", "seq"}
    rows = normalize.normalize_flow(flows, base()).orderBy("seq").collect()
    assert [(r["dst_pt"], r["b_out"], r["b_in"], r["payload"]) for r in rows] == [
        (80, 10, 0, "BENIGN"), (443, 7, 0, "DDoS")]
    assert [r["ts"] for r in rows] == ["2026-01-01T00:00:00Z", "2026-01-01T00:00:01Z"]
    assert normalize.unreadable_flows(flows).count() == 1


def test_log_csv_quotes_and_empty_cells(spark, tmp_path):
    file = tmp_path / "log.csv"
    file.write_text('LineId,Month,Date,Time,EventId,Content\n'
                    '1,Jun,04,15:16:01,E1,"say ""hi"", C:\\Windows"\n2,Jun,14,,E2,\n')
    rows = normalize.normalize_log(
        readers.log_csv(spark, str(file), "d"), "HOST_LINUX").orderBy("seq").collect()
    assert rows[0]["payload"] == 'say "hi", C:\\Windows' and rows[0]["ts"] == "Jun 4 15:16:01"
    assert rows[1]["payload"] == "nan" and rows[1]["ts"] == "Jun 14 nan"
    assert rows[0]["evt_id"] == "E1" and rows[0]["act"] == "HOST_LINUX"


def test_bz2_lines_keep_their_order(spark, tmp_path):
    file = tmp_path / "wls.bz2"
    file.write_bytes(bz2.compress("".join(f"  line {i} \n" for i in range(50)).encode()))
    lines = sequence.head_rows(readers.text_lines(spark, str(file), "w"), 20)
    rows = normalize.normalize_auth_line(lines, base()).orderBy("seq").collect()
    assert [r["payload"] for r in rows] == [f"line {i}" for i in range(20)]


def test_array_documents_and_broken_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(
        [{"src_ip": "1.1.1.1", "evt_id": 1000, "b_in": 5}, {"evt_id": "E7", "payload": "x"}]))
    (tmp_path / "bad.json").write_text('[{"src_ip": "2.2.2.2"')
    rows = readers.frames_json(spark, str(tmp_path / "*.json"), array_documents=True).collect()
    assert sorted(r["evt_id"] for r in rows) == ["1000", "E7"]


@pytest.mark.parametrize("again", [0, 1])
def test_records_are_judged_whole(spark, tmp_path, again):
    """Counts, narrow and full reads agree, also on the second read of a session."""
    file = tmp_path / "frames.json"
    file.write_text('{"src_ip": "1.1.1.1", "b_in": 5}\n{"src_ip": "2.2.2.2", "b_in": "no number"}\n'
                    '{"src_ip": \n\n')
    rows = readers.frames_json(spark, str(file))
    assert rows.count() == 1
    assert [r["src_ip"] for r in rows.select("src_ip").collect()] == ["1.1.1.1"]
    assert [r["b_in"] for r in rows.collect()] == [5]
    file = tmp_path / "snapshots.json"
    file.write_text('{"timestamp": "t", "source": "OS", "data": {"a": "b"}}\n'
                    '{"timestamp": "t", "source": "OS", "data": 7}\nbroken\n')
    rows = readers.snapshot_json(spark, str(file))
    assert rows.count() == rows.select("source").count() == len(rows.collect()) == 1


def test_other_column_order_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Destination Port,Label\n80,BENIGN\n")
    (tmp_path / "b.csv").write_text("Label,Destination Port\nDDoS,443\n")
    with pytest.raises(Exception, match="header"):
        readers.flow_csv(spark, str(tmp_path), "d").collect()


def test_logs_keep_leading_blanks(spark, tmp_path):
    file = tmp_path / "log.csv"
    file.write_text("Time,Content\n1,   two\n")
    assert readers.log_csv(spark, str(file), "d").first()["Content"] == "   two"


def test_unreadable_flows_are_listed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Destination Port,Label\n80,BENIGN\nx,BENIGN\n")
    rows = readers.unreadable(spark, [("a", "flow", "L3_L4", str(tmp_path / "a.csv"))]).collect()
    assert [(r["dataset"], r["seq"]) for r in rows] == [("a", 1)]


def test_missing_datasets_are_skipped_and_formats_united(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Destination Port,Label\n80,BENIGN\n")
    (tmp_path / "b.csv").write_text("Time,Content\n1,hello\n")
    out = readers.routed(spark, [
        ("a", "flow", "L3_L4", str(tmp_path / "a.csv")),
        ("b", "log", "WEB_APP", str(tmp_path / "b.csv")),
        ("c", "lines", "AUTH_WINDOWS", str(tmp_path / "none.bz2"))], base())
    assert {(r["dataset"], r["act"]) for r in out.collect()} == {
        ("a", "L3_L4"), ("b", "WEB_APP")}


def test_alert_sink_overwrites_and_writes_iso_time(spark, tmp_path):
    path = str(tmp_path / "alerts")
    df = spark.createDataFrame(
        [(0, "2026-01-01 10:00:00", "a", "HOST_LIN", 1.0, "p" * 80),
         (1, "2026-01-01 10:00:00.5", "a", "HOST_LIN", 1.0, "q")],
        "seq bigint, ts string, src_ip string, tag string, base double, payload string"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for _ in range(2):
        sinks.write_alerts(fusion.alerts(df), path)
    rows = sorted(spark.read.json(path).collect(), key=lambda r: r["ts"])
    assert [r["ts"] for r in rows] == ["2026-01-01T10:00:00", "2026-01-01T10:00:00.500000"]
    assert rows[0]["forensics"] == [C.EVIDENCE_DEFAULT] and len(rows[0]["payload"]) == 50


def test_frames_are_stored_by_dataset_and_models_may_be_absent(spark, tmp_path):
    path = str(tmp_path / "frames")
    df = spark.createDataFrame([(0, "a"), (1, "b")], "seq bigint, dataset string")
    sinks.write_frames(df, path)
    assert (tmp_path / "frames" / "dataset=a").is_dir()
    assert readers.frames_parquet(spark, path).count() == 2
    assert models.load(spark, str(tmp_path / "none"), "forest") is None


def test_row_ranges_touch_the_attack_capture_only(spark):
    name = C.ATTACK_CAPTURE + ".pcap_ISCX"
    df = spark.range(2000).select(F.col("id").alias("seq"), F.lit(name).alias("dataset"))
    kept = sequence.row_ranges(df)
    assert kept.count() == 30
    other = df.withColumn("dataset", F.lit("Apache"))
    assert sequence.row_ranges(other).count() == 2000


def test_injection_picks_the_first_matching_name(spark):
    got = synth.injected_attacks(
        spark, ["OpenSSH_2k.log_structured", "Linux_2k.log_structured", "flows"], 100)
    counts = {r["dataset"]: r["count"] for r in got.groupBy("dataset").count().collect()}
    assert counts == {"OpenSSH_2k.log_structured": 25, "Linux_2k.log_structured": 25}
    assert got.agg(F.min("seq"), F.max("seq")).first() == (100, 124)


def test_baseline_sizes_and_bounds(spark):
    sizes = {layer: synth.baseline_lines(spark, layer).count() for layer in C.BASELINES}
    assert sizes == {"WEB_APP": 600, "AUTH_LINUX": 900, "HOST_LIN": 900, "HOST_WIN": 600}
    ports = synth.baseline_lines(spark, "AUTH_LINUX").select(
        F.regexp_extract("payload", r"port (\d+)", 1).try_cast("int").alias("p"))
    low, high = ports.agg(F.min("p"), F.max("p")).first()
    assert 30000 <= low and high <= 60000
