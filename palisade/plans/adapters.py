"""The driver's tables seen as security logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import constants as C
from palisade import session

MONDAY, FRIDAY, APACHE, SSH, LANL, LINUX, WINDOWS = [name for name, _, _ in C.DATASETS]
START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PAYLOADS = [
    "sshd[77]: Accepted publickey from 172.16.0.<host>",
    "A new process has been created. Process Name: C:\\Windows\\System32\\svchost.exe",
    "authentication failure; rhost=218-22-3-<host>",
    "session closed for user news",
    "GET /login.php?user=admin' OR '1'='1 HTTP/1.1",
    "kernel: generic message without signature",
    "Failed password for root from 999.1.1.999 port 22 ssh2",
    "mod_jk child workerEnv in error state 6",
]


def _payload(user: Column, seq: Column) -> Column:
    template = F.get(F.array(*[F.lit(p) for p in PAYLOADS]), (seq % 8).cast("int"))
    return F.replace(template, F.lit("<host>"), (user % 200).cast("string"))


def _pick(kind: Column, names: dict[str, str], rest: str) -> Column:
    out = None
    for event_type, name in names.items():
        step = (kind == event_type, F.lit(name))
        out = F.when(*step) if out is None else out.when(*step)
    return out.otherwise(F.lit(rest))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as frames, with a stand-in verdict ``base``."""
    user, seq, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    # The payload of a real log is a stored column. Here a one-row generator stands between
    # its expression and the predicates over it, which would copy it once per signature.
    held = F.inline(F.array(F.struct(_payload(user, seq).alias("payload"))))
    events = session.spread(table(spark, sf_dir, "events"), "event_id")
    odd = (seq % 2) == 1  # sign-ups and purchases alternate between two datasets each
    return events.select("*", held).select(
        seq.alias("seq"),
        "ts",
        F.when(user % 5 == 0, F.lit("0.0.0.0")).otherwise(
            F.concat(F.lit("10.0.0."), (user % 250).cast("string"))).alias("src_ip"),
        F.when((kind == "signup") & odd, F.lit("AUTH_WINDOWS")).otherwise(
            _pick(kind, {"error": "HOST_LINUX", "view": "HOST_WINDOWS", "signup": "AUTH_LINUX",
                         "click": "WEB_APP"}, "L3_L4")).alias("act"),
        F.get_json_object("props", "$.k").cast("bigint").alias("dst_pt"),
        F.floor(F.col("value") * 100).cast("bigint").alias("b_in"),
        (seq % 1500).alias("b_out"),
        "payload",
        F.when(F.col("value") >= 100, F.lit(1.0)).otherwise(F.lit(0.0)).alias("base"),
        F.when(odd & (kind == "signup"), F.lit(LANL)).when(odd & (kind == "purchase"), F.lit(MONDAY))
        .otherwise(_pick(kind, {"error": LINUX, "view": WINDOWS, "signup": SSH, "click": APACHE},
                         FRIDAY)).alias("dataset"),
    )


def elapsed_thousandths(ts: Column) -> Column:
    """Seconds since the start of the table, a thousandth of them: makes 60 s worth testing."""
    return F.expr(
        f"timestampdiff(SECOND, timestamp_ntz'{START}', ts) div 1000").cast("bigint")


def document_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("text").alias("payload"),
        F.col("source").alias("dataset"))


def page_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"), F.concat(F.lit("GET "), F.col("url")).alias("payload"),
        F.lit("WEB_APP").alias("act"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        (F.col("o_custkey") % 65536).alias("dst_pt"),
        F.floor("o_totalprice").cast("bigint").alias("b_in"),
        (F.col("o_orderkey") % 1500).alias("b_out"))


def flow_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("dst_pt"),
        F.floor("l_extendedprice").cast("bigint").alias("b_in"),
        F.floor(F.col("l_quantity") * 100).cast("bigint").alias("b_out"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as live snapshots: an entity per user, its state from the value."""
    user = F.col("user_id").cast("string")
    state = F.floor(F.col("value") / 20).cast("string")
    kind = F.col("event_type")
    data = (
        F.when(kind == "error", F.create_map(
            F.lit("service_name"), F.concat(F.lit("svc"), user), F.lit("status"), state))
        .when(kind == "view", F.create_map(
            F.lit("protocol"), F.lit("TCP"),
            F.lit("local_address"), F.concat(F.lit("10.0.0."), user),
            F.lit("foreign_address"), F.lit("0.0.0.0:0"), F.lit("state"), state,
            F.lit("pid"), user))
        .otherwise(F.create_map(
            F.lit("image_name"), F.lit("app.bin"), F.lit("pid"), user,
            F.lit("mem_usage"), state))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("string").alias("timestamp"),
        _pick(kind, {"error": "OS", "view": "NETWORK"}, "APP").alias("source"),
        data.alias("data"))


def snapshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as lines of the three dumps: headers, rulers, short and long rows."""
    user, n = F.col("user_id").cast("string"), F.col("event_id") % 9
    value = F.col("value").cast("bigint").cast("string")
    kind = F.col("event_type")
    row = (
        F.when(kind == "error", F.concat(F.lit("svc"), user, F.lit("   running")))
        .when(kind == "view", F.concat(F.lit("  TCP  10.0.0."), user,
                                       F.lit(":22\t0.0.0.0:0 LISTEN "), user))
        .otherwise(F.concat(F.lit("app"), user, F.lit(".bin "), user,
                            F.lit(" Console 1 "), value, F.lit("K up")))
    )
    line = (
        F.when(n == 0, F.concat(F.lit("--- ["),
                                F.substring(F.col("ts").cast("string"), 1, 19),
                                F.lit("] NETWORK DUMP ---")))
        .when(n == 1, F.lit("Proto  Local Address  State"))
        .when(n == 2, F.lit("   "))
        .when(n == 3, F.concat(F.lit("lone"), user))
        .when(n == 4, F.concat(row, F.lit("  user "), user, F.lit("   title")))
        .otherwise(row)
    )
    held = F.inline(F.array(F.struct(line.alias("line"))))  # as in event_frames
    events = session.spread(table(spark, sf_dir, "events"), "event_id")
    return events.select("*", held).select(
        F.col("event_id").alias("seq"), "ts",
        _pick(kind, {"error": "OS", "view": "NETWORK"}, "APP").alias("source"), "line")


def judged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as verdicts of six specialists."""
    tags = F.array(*[F.lit(t) for t in
                     ("L3_L4", "WEB_APP", "AUTH_LINUX", "AUTH_WINDOWS", "HOST_LIN",
                      "HOST_WIN")])
    return table(spark, sf_dir, "labels").select(
        F.get(tags, (F.col("doc_id") % 6).cast("int")).alias("tag"),
        (F.lit(1) - F.col("quality")).alias("truth"),
        F.col("toxic").alias("pred"))
