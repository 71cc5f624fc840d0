"""Queries over the driver's tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import constants as C
from palisade import session
from palisade.functions import scoring, text, times
from palisade.operators import (
    correlate, evaluate, explain, forest, fusion, normalize, ocsvm, quantiles, report, scaling,
    sequence, snapshots, synth, tfidf,
)
from palisade.plans import adapters as A
from palisade.plans import fixed_forest, fixed_text, live, pipeline
from palisade.sources import readers, sinks
from palisade.streaming import fusion as stream_fusion_rows
from palisade.streaming import snapshots as stream_snapshots

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

BASE = "timestamp_ntz'2026-01-01 00:00:00'"


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _base():
    return F.expr(BASE)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched and routed event frames with the stand-in verdict."""
    return normalize.route_to_models(normalize.enrich(A.event_frames(spark, sf_dir)))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.alerts(_scored(spark, sf_dir))


# --- fusion ------------------------------------------------------------------------------

@query
def fusion_alerts(spark, sf_dir):
    return fusion.verdicts(_scored(spark, sf_dir))


@query
def fusion_windowed(spark, sf_dir):
    return fusion.fuse(correlate.with_window_bonus(_scored(spark, sf_dir)))


@query
def fusion_alerts_60s(spark, sf_dir):
    timed = _scored(spark, sf_dir).withColumn("at", A.elapsed_thousandths(F.col("ts")))
    return fusion.recent_verdicts(timed)


@query
def correlate_60s(spark, sf_dir):
    timed = _scored(spark, sf_dir).withColumn("at", A.elapsed_thousandths(F.col("ts")))
    return correlate.with_recent_bonus(timed).select(
        "seq", "src_ip", "tag", "at", "bonus")


@query
def correlate_join(spark, sf_dir):
    return correlate.with_bonus(_scored(spark, sf_dir)).select("seq", "src_ip", "tag", "bonus")


@query
def cross_layer(spark, sf_dir):
    return correlate.with_marks(_scored(spark, sf_dir)).select(
        "seq", "src_ip", "tag", "cross_layer")


@query
def freq_escalation(spark, sf_dir):
    return correlate.with_marks(_scored(spark, sf_dir)).select(
        "seq", "src_ip", "tag", "repeated")


@query
def ledger(spark, sf_dir):
    return fusion.ledger(_scored(spark, sf_dir))


@query
def alerts(spark, sf_dir):
    return _alerts(spark, sf_dir)


@query
def export_alerts(spark, sf_dir):
    """Written as JSON, read back: the table that reports start from."""
    path = session.scratch_path(spark, "alerts")
    sinks.write_alerts(_alerts(spark, sf_dir), path)
    back = spark.read.schema("ts string, src_ip string, tag string, score double, "
                             "is_anomaly boolean, forensics array<string>, payload string")
    return back.json(path).withColumn("forensics", scoring.evidence_display(F.col("forensics")))


# --- scans and sinks -----------------------------------------------------------------------

def _in_order(rows: DataFrame, key: str) -> DataFrame:
    """Range partitioned and sorted, so that part files follow each other in key order."""
    return rows.repartitionByRange(4, key).sortWithinPartitions(key)


def _write_flow_csv(spark, sf_dir) -> str:
    path = session.scratch_path(spark, "flows")
    raw = A.flows(spark, sf_dir).select(
        "seq", F.col("dst_pt").alias(" Destination Port"),
        F.col("b_out").alias("Total Length of Fwd Packets"),
        F.col("b_in").alias(" Total Length of Bwd Packets"),
        F.when(F.col("seq") % 50 == 0, F.lit("DDoS")).otherwise(F.lit("BENIGN")).alias(" Label"),
        F.lit("unused").alias("Flow Duration"))
    _in_order(raw, "seq").drop("seq").write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).csv(path)
    return path


def _write_log_csv(spark, sf_dir) -> str:
    path = session.scratch_path(spark, "logs")
    frames = A.event_frames(spark, sf_dir)
    raw = frames.select(
        "seq", F.date_format("ts", "MMM").alias("Month"), F.date_format("ts", "dd").alias("Date"),
        F.date_format("ts", "HH:mm:ss").alias("Time"),
        F.concat(F.lit("E"), F.col("seq") % 20).alias("EventId"),
        F.when(F.col("seq") % 97 == 0, F.lit(None)).otherwise(F.col("payload")).alias("Content"))
    _in_order(raw, "seq").drop("seq").write.option("header", True).option(
        "escape", '"').csv(path)
    return path


def _write_bz2(spark, sf_dir) -> str:
    path = session.scratch_path(spark, "lines")
    frames = A.event_frames(spark, sf_dir)
    raw = frames.select("seq", F.concat(F.lit(" "), F.col("payload"), F.lit("  ")).alias("value"))
    _in_order(raw, "seq").drop("seq").write.option("compression", "bzip2").text(path)
    return path


@query
def scan_flow_csv(spark, sf_dir):
    return readers.flow_csv(spark, _write_flow_csv(spark, sf_dir), "flows")


@query
def scan_log_csv(spark, sf_dir):
    rows = readers.log_csv(spark, _write_log_csv(spark, sf_dir), "logs")
    return normalize.normalize_log(rows, "HOST_LINUX").select(
        "seq", "ts", "evt_id", "act", "payload")


@query
def scan_bz2_lines(spark, sf_dir):
    rows = readers.text_lines(spark, _write_bz2(spark, sf_dir), "lines")
    return normalize.normalize_auth_line(rows, _base()).drop("dataset")


@query
def head_rows(spark, sf_dir):
    rows = readers.text_lines(spark, _write_bz2(spark, sf_dir), "lines")
    return sequence.head_rows(rows, C.AUTH_LINES).select("seq", F.trim("value").alias("payload"))


@query
def scan_frames(spark, sf_dir):
    path = session.scratch_path(spark, "frames")
    frames = A.event_frames(spark, sf_dir).select(
        times.iso_text(F.col("ts")).alias("ts"), "src_ip", "dst_pt", "act", "b_in", "b_out",
        "payload", (F.col("seq") % 7).alias("evt_id"))
    sinks.write_frames_json(frames, path)
    return readers.frames_json(spark, path).select(
        "ts", "src_ip", "dst_pt", "evt_id", "act", "b_in", "b_out", "payload")


@query
def frame_sink(spark, sf_dir):
    path = session.scratch_path(spark, "frames")
    sinks.write_frames(A.event_frames(spark, sf_dir), path)
    return readers.frames_parquet(spark, path).groupBy("dataset").agg(
        F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query
def scan_snapshots(spark, sf_dir):
    """Records with every eleventh line broken on purpose."""
    path = session.scratch_path(spark, "snapshots")
    rows = A.snapshots(spark, sf_dir)
    lines = rows.select("seq", F.when(F.col("seq") % 11 == 0, F.lit('{"timestamp": "x", ')).otherwise(
        F.to_json(F.struct("timestamp", "source", "data"))).alias("value"))
    _in_order(lines, "seq").drop("seq").write.text(path)
    return readers.snapshot_json(spark, path).select(
        "timestamp", "source", snapshots.state_text(F.col("data")).alias("state"))


@query
def route_datasets(spark, sf_dir):
    entries = [
        ("Monday-WorkingHours.pcap_ISCX", "flow", "L3_L4", _write_flow_csv(spark, sf_dir)),
        ("Linux_2k.log_structured", "log", "HOST_LINUX", _write_log_csv(spark, sf_dir)),
        ("LANL_WLS_2k", "lines", "AUTH_WINDOWS", _write_bz2(spark, sf_dir)),
        ("Apache_2k.log_structured", "log", "WEB_APP", f"{sf_dir}/no-such-folder"),
    ]
    return readers.routed(spark, entries, _base()).groupBy("dataset", "act").agg(
        F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"),
        F.sum(F.length("payload")).alias("chars"))


@query
def route_by_model(spark, sf_dir):
    """Frames whose layer has no model are dropped; here one model is missing."""
    have = [t for t in C.MODEL_TAGS if t != "AUTH_LINUX"]
    frames = normalize.route_to_models(
        normalize.enrich(A.event_frames(spark, sf_dir)), have)
    return frames.select("seq", "tag", "model_tag")


@query
def row_index(spark, sf_dir):
    rows = readers.text_lines(spark, _write_bz2(spark, sf_dir), "lines")
    return rows.select("seq", F.trim("value").alias("payload"))


# --- projections ---------------------------------------------------------------------------

@query
def normalize_flow(spark, sf_dir):
    rows = A.flows(spark, sf_dir).withColumns({
        "label": F.when(F.col("seq") % 50 == 0, F.lit("DDoS")).when(
            F.col("seq") % 51 == 0, F.lit(None)).otherwise(F.lit("BENIGN")),
        "b_in": F.when(F.col("seq") % 53 == 0, F.lit("Infinity")).otherwise(
            F.col("b_in").cast("string")),
        "dataset": F.lit("flows")})
    return normalize.normalize_flow(rows, _base())


@query
def synthetic_ts(spark, sf_dir):
    return A.event_frames(spark, sf_dir).select(
        "seq", times.synthetic_ts(F.col("seq"), _base()).alias("ts"))


@query
def normalize_log(spark, sf_dir):
    rows = A.event_frames(spark, sf_dir).select(
        "seq", F.lit("web").alias("dataset"), F.date_format("ts", "HH:mm:ss").alias("Time"),
        F.when(F.col("seq") % 97 != 0, F.col("payload")).alias("Content"))
    return normalize.normalize_log(rows, "WEB_APP")


@query
def log_timestamp(spark, sf_dir):
    rows = A.event_frames(spark, sf_dir).select(
        "seq", F.date_format("ts", "MMM").alias("Month"), F.date_format("ts", "dd").alias("Date"),
        F.date_format("ts", "EEE").alias("Day"),
        F.when(F.col("seq") % 31 != 0, F.date_format("ts", "HH:mm:ss")).alias("Time"))
    variants = [["Month", "Date", "Time"], ["Date", "Day", "Time"], ["Date", "Time"], ["Time"],
                ["Day"]]
    out = None
    for i, names in enumerate(variants):
        one = rows.select("seq", *names).select(
            "seq", F.lit(i).alias("variant"), times.log_ts_text(names).alias("ts"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def normalize_auth_line(spark, sf_dir):
    rows = A.event_frames(spark, sf_dir).select(
        "seq", F.lit("wls").alias("dataset"),
        F.concat(F.lit(" \t"), F.col("payload"), F.lit("  ")).alias("value"))
    return normalize.normalize_auth_line(rows, _base())


@query
def parse_ts(spark, sf_dir):
    n, ts = F.col("seq") % 8, F.col("ts")
    iso = times.iso_text(ts)
    raw = (
        F.when(n == 0, F.concat(iso, F.lit("Z")))
        .when(n == 1, F.concat(F.substring(iso, 1, 19), F.lit("Z")))
        .when(n == 2, F.substring(iso, 1, 10))
        .when(n == 3, F.substring(iso, 1, 16))
        .when(n == 4, F.date_format(ts, "MMM d HH:mm:ss"))
        .when(n == 5, F.concat(F.lit(" "), iso))
        .when(n == 6, F.substring(iso, 12, 8))
        .otherwise(F.date_format(ts, "yyyyMMdd"))
    )
    return A.event_frames(spark, sf_dir).select(
        "seq", times.parsed_ts(raw, _base()).alias("ts"))


@query
def extract_ip(spark, sf_dir):
    docs = A.document_frames(spark, sf_dir)
    given = F.when(F.col("seq") % 9 == 0, F.lit("")).when(
        F.col("seq") % 10 == 0, F.lit("8.8.8.8")).otherwise(F.lit(C.UNKNOWN_IP))
    return docs.select("seq", text.resolved_ip(F.col("payload"), given).alias("src_ip"))


@query
def detect_os(spark, sf_dir):
    frames = A.event_frames(spark, sf_dir)
    return frames.select("seq", "act", text.refined_layer(
        F.col("payload"), F.col("act")).alias("tag"))


@query
def model_tag(spark, sf_dir):
    return A.event_frames(spark, sf_dir).select(
        "seq", "act", text.model_of(F.col("act")).alias("model_tag"))


@query
def alert_projection(spark, sf_dir):
    return A.document_frames(spark, sf_dir).select(
        "seq", text.preview(F.col("payload")).alias("payload"))


@query
def evidence_fallback(spark, sf_dir):
    """Whole evidence chain over explained flows, failed ones and unexplained ones."""
    n = F.col("seq") % 5
    shap = -F.col("value_cut")
    found = F.when((n == 0) & (shap < C.SHAP_CUT), F.array(scoring.flow_evidence_text(
        F.lit("b_in"), F.col("b_in"), shap))).otherwise(F.array().cast("array<string>"))
    flow = scoring.flow_evidence(
        found, n != 1, F.when(n == 2, F.lit("bad shape")).otherwise(F.lit(None)))
    words = scoring.text_evidence(F.array().cast("array<string>"), n == 3)
    evidence = F.when(F.col("act") == C.FLOW_TAG, flow).otherwise(words)
    frames = A.event_frames(spark, sf_dir).withColumn(
        "value_cut", (F.col("b_in") % 200) / F.lit(100.0))
    return frames.select("seq", scoring.evidence_display(
        scoring.evidence_or_default(evidence)).alias("evidence"))


@query
def evidence_text(spark, sf_dir):
    return A.document_frames(spark, sf_dir).select(
        "seq", scoring.evidence_display(F.split("payload", "\n")).alias("evidence"))


@query
def parse_snapshot_line(spark, sf_dir):
    rows = snapshots.parse_lines(A.snapshot_lines(spark, sf_dir))
    return rows.select("seq", "source", snapshots.state_text(F.col("data")).alias("state"))


@query
def snapshot_header(spark, sf_dir):
    return snapshots.headers(A.snapshot_lines(spark, sf_dir)).select("seq", "header")


@query
def entity_id(spark, sf_dir):
    rows = A.snapshots(spark, sf_dir).withColumn(
        "source", F.when(F.col("seq") % 7 == 0, F.lit("OTHER")).otherwise(F.col("source")))
    return snapshots.identified(rows).select("seq", "uid")


@query
def severity(spark, sf_dir):
    return _alerts(spark, sf_dir).select(
        "seq", "score", scoring.severity(F.col("score")).alias("severity"))


@query
def anomaly_proba(spark, sf_dir):
    d = (F.col("value") - 50.0) / 25.0
    return A.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.round(scoring.p_anomaly(d), 9).alias("p_anomaly"),
        F.round(scoring.p_normal(d), 9).alias("p_normal"))


@query
def ground_truth(spark, sf_dir):
    frames = A.event_frames(spark, sf_dir).withColumn("payload", F.when(
        (F.col("act") == C.FLOW_TAG) & (F.col("seq") % 3 == 0), F.lit("Benign")).otherwise(
        F.col("payload")))
    return frames.select("seq", text.truth_label(
        F.col("payload"), F.col("act"), F.col("dataset")).alias("truth"))


# --- filters ---------------------------------------------------------------------------------

@query
def whitelist_filter(spark, sf_dir):
    return A.event_frames(spark, sf_dir).where(
        ~text.is_whitelisted(F.col("payload"))).select("seq", "payload")


@query
def clean_baseline(spark, sf_dir):
    return A.event_frames(spark, sf_dir).where(
        ~text.is_ssh_attack(F.col("payload"))).select("seq", "payload")


@query
def garbage_filter(spark, sf_dir):
    return A.snapshot_lines(spark, sf_dir).where(
        ~text.is_garbage(F.col("line"))).select("seq", "line")


@query
def row_range_scan(spark, sf_dir):
    return sequence.row_ranges(A.event_frames(spark, sf_dir)).select("seq", "dataset")


# --- alerts reports ----------------------------------------------------------------------------

@query
def alerts_by_tag(spark, sf_dir):
    return report.of_tag(_alerts(spark, sf_dir), "HOST_LIN")


@query
def alert_kpis(spark, sf_dir):
    return report.kpis(_alerts(spark, sf_dir))


@query
def alerts_per_tag(spark, sf_dir):
    return report.per_tag(_alerts(spark, sf_dir))


@query
def top_ips(spark, sf_dir):
    return report.top_sources(_alerts(spark, sf_dir))


@query
def alert_feed(spark, sf_dir):
    return report.feed(_alerts(spark, sf_dir))


@query
def distinct_tags(spark, sf_dir):
    return report.tags(_alerts(spark, sf_dir))


@query
def run_totals(spark, sf_dir):
    return report.run_totals(A.table(spark, sf_dir, "events"), _alerts(spark, sf_dir))


# --- evaluation --------------------------------------------------------------------------------

@query
def confusion(spark, sf_dir):
    return evaluate.confusion(A.judged_labels(spark, sf_dir), "tag")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@query
def classification_metrics(spark, sf_dir):
    return _rounded(evaluate.measures(
        evaluate.confusion(A.judged_labels(spark, sf_dir), "tag")))


@query
def specialist_metrics(spark, sf_dir):
    judged = evaluate.specialist_judgements(A.event_frames(spark, sf_dir))
    return _rounded(evaluate.measures(evaluate.confusion(judged, "tag")))


@query
def fusion_metrics(spark, sf_dir):
    judged = evaluate.fusion_judgements(
        A.event_frames(spark, sf_dir), fusion.alerts(_scored(spark, sf_dir)))
    return _rounded(evaluate.measures(evaluate.confusion(judged)))


EVENT_DATASETS = [name for name, _, _ in C.DATASETS]


def _inject_start(frames: DataFrame) -> int:
    """The first number after those of the frames."""
    return (frames.agg(F.max("seq")).first()[0] or 0) + 1


def evaluation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample, injected attacks, random order, one running position over all datasets."""
    frames = A.event_frames(spark, sf_dir)
    sampled = sequence.sample_per_dataset(frames.drop("ts"))
    mixed = synth.inject(sampled, EVENT_DATASETS, _inject_start(frames))
    judged = normalize.with_defaults(mixed).withColumns({
        "base": F.coalesce("base", F.lit(1.0)),
        "ts": times.parsed_ts(F.coalesce("ts", F.lit("")), _base())})
    return sequence.chain(sequence.shuffle_order(judged), EVENT_DATASETS)


@query
def evaluation_run(spark, sf_dir):
    """The evaluation with stand-in verdicts: every layer's model, then the fusion."""
    frames = session.materialize(evaluation_frames(spark, sf_dir), "evaluation")
    scored = normalize.route_to_models(normalize.enrich(frames))
    fused = evaluate.confusion(evaluate.fusion_judgements(
        frames, fusion.alerts(scored))).withColumn("tag", F.lit("FUSION"))
    layers = evaluate.confusion(evaluate.specialist_judgements(frames), "tag")
    return _rounded(evaluate.measures(layers.unionByName(fused)))


# --- snapshots -----------------------------------------------------------------------------------

@query
def state_changes(spark, sf_dir):
    rows = snapshots.state_changes(A.snapshots(spark, sf_dir), block_rows=2000)
    return rows.select("seq", "uid", snapshots.state_text(F.col("data")).alias("state"))


@query
def distinct_states(spark, sf_dir):
    rows = snapshots.distinct_states(A.snapshots(spark, sf_dir))
    return rows.select("seq", "uid", snapshots.state_text(F.col("data")).alias("state"))


@query
def last_states(spark, sf_dir):
    rows = snapshots.last_states(snapshots.distinct_states(A.snapshots(spark, sf_dir)))
    return rows.select("uid", snapshots.state_text(F.col("data")).alias("state"))


# --- order, samples, sets ------------------------------------------------------------------------

@query
def sample_per_dataset(spark, sf_dir):
    return sequence.sample_per_dataset(A.event_frames(spark, sf_dir)).select("seq", "dataset")


@query
def shuffle_seq(spark, sf_dir):
    frames = A.event_frames(spark, sf_dir).withColumn("event_id", F.col("seq"))
    return sequence.shuffle_order(frames).select("event_id", "dataset", "seq")


@query
def insert_at(spark, sf_dir):
    rows = A.flows(spark, sf_dir)
    outlier = spark.createDataFrame(
        [(C.OUTLIER_FLOW["dst_pt"], C.OUTLIER_FLOW["b_in"], C.OUTLIER_FLOW["b_out"])],
        "dst_pt bigint, b_in bigint, b_out bigint")
    return sequence.insert_at(rows, outlier, C.OUTLIER_POSITION)


@query
def dataset_order(spark, sf_dir):
    frames = A.event_frames(spark, sf_dir).withColumn("event_id", F.col("seq"))
    return sequence.chain(frames, EVENT_DATASETS).select("event_id", "dataset", "seq")


@query
def inject_threats(spark, sf_dir):
    frames = A.event_frames(spark, sf_dir).select("dataset", "src_ip", "payload", "act", "seq")
    mixed = synth.inject(frames, EVENT_DATASETS, _inject_start(frames))
    return mixed.select("dataset", "src_ip", "payload", "act", "seq", "ts")


def _layer_payloads(spark: SparkSession, sf_dir: str, act: str) -> DataFrame:
    return A.event_frames(spark, sf_dir).where(F.col("act") == act)


@query
def augment_web(spark, sf_dir):
    return synth.augmented(A.page_frames(spark, sf_dir), "WEB_APP")


@query
def augment_ssh(spark, sf_dir):
    return synth.augmented(_layer_payloads(spark, sf_dir, "AUTH_LINUX"), "AUTH_LINUX")


@query
def augment_linux(spark, sf_dir):
    return synth.augmented(_layer_payloads(spark, sf_dir, "HOST_LINUX"), "HOST_LIN")


@query
def augment_windows(spark, sf_dir):
    return synth.augmented(_layer_payloads(spark, sf_dir, "HOST_WINDOWS"), "HOST_WIN")


# --- features ----------------------------------------------------------------------------------

@query
def robust_stats(spark, sf_dir):
    return scaling.robust_stats(A.flow_volume(spark, sf_dir))


@query
def robust_scale(spark, sf_dir):
    rows = A.flows(spark, sf_dir)
    by = scaling.scale_map(scaling.robust_stats(rows))
    return scaling.scaled(rows, by).select(
        "seq", *[F.round(f"{n}_scaled", 9).alias(f"{n}_scaled") for n in C.FLOW_FEATURES])


@query
def score_threshold(spark, sf_dir):
    """Cut values of given scores, one per return flag, found by histogram search."""
    rows = A.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("name"), F.col("l_extendedprice").alias("x"))
    names = ["A", "N", "R"]
    found = quantiles.exact_quantiles(
        rows, {n: [C.FOREST_CONTAMINATION, 0.01] for n in names})
    return spark.createDataFrame(
        [(n, *found[n]) for n in names],
        "name string, at_contamination double, at_nu double")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.spread(A.document_frames(spark, sf_dir), "seq")


@query
def term_stats(spark, sf_dir):
    return tfidf.term_stats(_documents(spark, sf_dir), "char", 3, 5)


@query
def top_terms(spark, sf_dir):
    return tfidf.vocabulary(_documents(spark, sf_dir), "char", 3, 6)


def _weights(docs: DataFrame, analyzer: str, shortest: int, longest: int) -> DataFrame:
    vocab = tfidf.with_idf(
        tfidf.vocabulary(docs, analyzer, shortest, longest), docs.count())
    vector = tfidf.vectorizer(vocab, analyzer, shortest, longest)
    return tfidf.weights(docs, vector).withColumn("weight", F.round("weight", 6))


@query
def char_tfidf(spark, sf_dir):
    return _weights(A.page_frames(spark, sf_dir), "char", 3, 5)


@query
def word_tfidf(spark, sf_dir):
    return _weights(_documents(spark, sf_dir), "word", 1, 3)


# --- learned models ------------------------------------------------------------------------------

_TRAINED: dict[tuple[str, str], str] = {}


def _layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "WEB_APP": augment_web(spark, sf_dir),
        "AUTH_LINUX": augment_ssh(spark, sf_dir),
        "AUTH_WINDOWS": synth.augmented(
            A.table(spark, sf_dir, "benchmark").select(F.col("text").alias("payload")),
            "AUTH_WINDOWS"),
        "HOST_LIN": augment_linux(spark, sf_dir),
        "HOST_WIN": augment_windows(spark, sf_dir),
    }


def trained(spark: SparkSession, sf_dir: str, part: str) -> pipeline.Models:
    """Models over the driver's tables; trained once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir, part)
    if key not in _TRAINED:
        root = session.scratch_path(spark, f"models-{part}")
        if part == "flow":
            pipeline.train_flow(session.spread(A.flows(spark, sf_dir), "seq"), root)
        else:
            pipeline.train_text(_layers(spark, sf_dir), root)
        _TRAINED[key] = root
    return pipeline.load_models(spark, _TRAINED[key])


@query
def iforest_score(spark, sf_dir):
    model = trained(spark, sf_dir, "flow").flow
    rows = session.spread(A.flows(spark, sf_dir), "seq")
    return pipeline.score_flows(rows, model).select("seq", "score", "prediction")


@query
def shap_evidence(spark, sf_dir):
    model = trained(spark, sf_dir, "flow").flow
    rows = session.spread(A.flows(spark, sf_dir), "seq")
    flagged = pipeline.score_flows(rows, model).where(F.col("prediction") == -1)
    shown = explain.with_shapley(flagged, model.trees, pipeline.SCALED)
    return shown.select(
        "seq", "score", "shap", "expected",
        scoring.evidence_display(explain.flow_evidence(F.col("shap"), C.FLOW_FEATURES)).alias(
            "evidence"),
        scoring.evidence_display(explain.flow_directions(F.col("shap"), C.FLOW_FEATURES)).alias(
            "directions"))


def _fixed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = forest.Forest(fixed_forest.nodes(), fixed_forest.SUBSAMPLE)
    rows = forest.scored(A.flows(spark, sf_dir), trees, C.FLOW_FEATURES)
    return forest.predicted(rows, fixed_forest.CUT)


def _fixed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = forest.Forest(fixed_forest.nodes(), fixed_forest.SUBSAMPLE)
    flagged = _fixed_scores(spark, sf_dir).where(F.col("prediction") == -1)
    return explain.with_shapley(flagged, trees, C.FLOW_FEATURES)


@query
def forest_fixed(spark, sf_dir):
    """Scores of a forest whose nodes are given."""
    return _fixed_scores(spark, sf_dir).select("seq", F.round("score", 9).alias("score"),
                                               "prediction")


@query
def shapley_fixed(spark, sf_dir):
    """Shapley values of the flagged flows under that forest."""
    return _fixed_evidence(spark, sf_dir).select(
        "seq", *[F.round(F.get("shap", F.lit(i)), 9).alias(f"shap{i}") for i in range(3)],
        F.round("expected", 9).alias("expected"))


@query
def first_anomaly(spark, sf_dir):
    """The first flagged flow and its Shapley values; one row per task is moved."""
    return _fixed_evidence(spark, sf_dir).agg(F.min_by(F.struct(
        "seq", *C.FLOW_FEATURES, F.round("score", 9).alias("score"),
        *[F.round(F.get("shap", F.lit(i)), 9).alias(f"shap{i}") for i in range(3)]), "seq")
        .alias("first")).select("first.*")


def _text_frames(spark: SparkSession, sf_dir: str, models) -> DataFrame:
    return normalize.route_to_models(
        normalize.enrich(A.event_frames(spark, sf_dir)), list(models))


@query
def ocsvm_score(spark, sf_dir):
    models = trained(spark, sf_dir, "text").text
    frames = _text_frames(spark, sf_dir, models)
    return ocsvm.predicted(ocsvm.decided(frames, models)).select(
        "seq", "tag", "model_tag", "decision", "prediction")


@query
def ocsvm_fixed(spark, sf_dir):
    """Decisions, verdicts and probabilities of text models that are given."""
    models = fixed_text.models()
    found = ocsvm.predicted(ocsvm.decided(_text_frames(spark, sf_dir, models), models))
    return found.select("seq", "tag", "model_tag", F.round("decision", 9).alias("decision"),
                        "prediction", F.round(scoring.p_anomaly(F.col("decision")), 9).alias("chance"))


def _fixed_models() -> pipeline.Models:
    flow = pipeline.FlowModel(dict.fromkeys(C.FLOW_FEATURES, (0.0, 1.0)),
                              forest.Forest(fixed_forest.nodes(), fixed_forest.SUBSAMPLE),
                              fixed_forest.CUT)
    return pipeline.Models(flow, fixed_text.models())


@query
def reconstruction_fixed(spark, sf_dir):
    """The whole chain with given models; the evidence of words is left out."""
    frames = A.event_frames(spark, sf_dir).drop("base")
    return pipeline.reconstruct(frames, _fixed_models())[0].drop("forensics")


@query
def evaluation_fixed(spark, sf_dir):
    """The evaluation of every layer and of the fusion with given models."""
    frames = A.event_frames(spark, sf_dir).drop("base")
    return _rounded(pipeline.evaluation(
        frames, EVENT_DATASETS, _fixed_models(), _inject_start(frames)))


@query
def lime_evidence(spark, sf_dir):
    models = trained(spark, sf_dir, "text").text
    scored = ocsvm.predicted(ocsvm.decided(_text_frames(spark, sf_dir, models), models))
    flagged = session.materialize(scored.where(F.col("prediction") == -1), "flagged")
    shown = explain.with_word_weights(flagged, models)
    return shown.select("seq", "tag", "payload", scoring.evidence_display(
        scoring.evidence_or_default(explain.text_evidence(F.col("words")))).alias("evidence"))


@query
def reconstruction(spark, sf_dir):
    """The whole chain with learned models: route, score, explain, correlate."""
    models = pipeline.Models(trained(spark, sf_dir, "flow").flow,
                             trained(spark, sf_dir, "text").text)
    return pipeline.reconstruct(A.event_frames(spark, sf_dir).drop("base"), models)[0]


@query
def learned_evaluation(spark, sf_dir):
    models = pipeline.Models(trained(spark, sf_dir, "flow").flow,
                             trained(spark, sf_dir, "text").text)
    frames = A.event_frames(spark, sf_dir).drop("base")
    return _rounded(pipeline.evaluation(
        frames, EVENT_DATASETS, models, _inject_start(frames)))


# --- streams -------------------------------------------------------------------------------------

STREAM_FILES = 4
FILE_ROWS = 1_000_000


def _files_in_order(rows: DataFrame, name: str, key: str = "seq") -> tuple[str, int, int]:
    """Rows as parquet files, one range of ``key`` after the other: path, files a range, ranges.

    A file stream takes files by age, so ranges are written in turn; a batch is the files of one
    range. Rows are worked out once, and a range has as many files as its rows need. Null keys come
    first.
    """
    spark = rows.sparkSession
    path = session.scratch_path(spark, name)
    rows = session.materialize(rows, f"{name}-rows")
    total = rows.count()
    each = max(1, -(-total // (STREAM_FILES * FILE_ROWS)))
    cuts = sorted(set(rows.approxQuantile(
        key, [k / STREAM_FILES for k in range(1, STREAM_FILES)], 0.01))) if total else []
    ranges = 0
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True) if low is None else F.col(key) >= low
        inside = inside if high is None else inside & (F.col(key) < high)
        part = rows.where(inside | F.col(key).isNull() if low is None else inside)
        if not part.isEmpty():
            part.repartition(each).write.mode("append").parquet(path)
            ranges += 1
    if not ranges:
        rows.limit(0).write.parquet(path)
    return path, each, ranges


def _file_stream(spark: SparkSession, rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A stream over ``rows`` in order, with the state store that state needs, and its batches."""
    path, each, ranges = _files_in_order(rows, name)
    own = stream_snapshots.stateful_session(spark)
    return own.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path), ranges


def _run_stream(stream: DataFrame, spark: SparkSession, name: str, batches: int = 0) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote.

    Fewer batches with rows than ``batches`` are an error: state would not have been carried.
    """
    path, mark = session.scratch_path(spark, name), session.scratch_path(spark, "mark")
    run = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", mark).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    full = sum(p["numInputRows"] > 0 for p in run.recentProgress)
    if full < batches:
        raise RuntimeError(f"{name} ran in {full} batches")
    return spark.read.schema(stream.schema).parquet(path)


@query
def stream_normalize(spark, sf_dir):
    """Lines rolled into one folder per source, parsed as they arrive."""
    path = session.scratch_path(spark, "dumps")
    lines = A.snapshot_lines(spark, sf_dir)
    for source, prefix in (("NETWORK", "network"), ("OS", "os"), ("APP", "app")):
        own = lines.where(F.col("source") == source).select("line")
        own.write.mode("append").text(f"{path}/{prefix}")
    own = spark.newSession()
    streams = None
    for source in C.SNAPSHOT_COLUMNS:
        rows = own.readStream.text(f"{path}/{source.lower()}").select(
            F.lit(source).alias("source"), F.col("value").alias("line"))
        streams = rows if streams is None else streams.unionByName(rows)
    records = stream_snapshots.normalized(streams)
    out = _run_stream(records.drop("timestamp"), spark, "records")
    return out.select("source", snapshots.state_text(F.col("data")).alias("state")).groupBy(
        "source", "state").agg(F.count("*").alias("n"))


@query
def stream_state_changes(spark, sf_dir):
    rows, batches = _file_stream(spark, A.snapshots(spark, sf_dir), "snapshots")
    return _run_stream(stream_snapshots.changes(rows), spark, "changes", batches).select(
        "seq", "uid", "state")


@query
def stream_seeded_changes(spark, sf_dir):
    """Starts from the states that an earlier run left and reads only the rows after it."""
    rows = A.snapshots(spark, sf_dir)
    cut = (rows.agg(F.max("seq")).first()[0] or 0) // 2
    earlier, later = rows.where(F.col("seq") < cut), rows.where(F.col("seq") >= cut)
    seed = session.materialize(
        snapshots.last_states(snapshots.distinct_states(earlier)), "seed")
    rows, batches = _file_stream(spark, later, "snapshots")
    known = rows.sparkSession.read.schema(seed.schema).parquet(*seed.inputFiles())
    return _run_stream(stream_snapshots.changes(rows, known), spark, "changes", batches).select(
        "seq", "uid", "state")


@query
def stream_fusion(spark, sf_dir):
    rows, batches = _file_stream(spark, _scored(spark, sf_dir), "scored")
    return _run_stream(stream_fusion_rows.ledger(rows), spark, "ledger", batches)


@query
def stream_fusion_60s(spark, sf_dir):
    timed = _scored(spark, sf_dir).withColumn("at", A.elapsed_thousandths(F.col("ts")))
    rows, batches = _file_stream(spark, timed, "scored")
    return _run_stream(stream_fusion_rows.recent_ledger(rows), spark, "ledger", batches)


REGISTRY |= live.REGISTRY
