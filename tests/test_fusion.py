"""Correlation against a plain loop, and the traps of the scoring rules."""

import random

import pytest
from pyspark.sql import functions as F

from palisade import constants as C
from palisade.operators import correlate, fusion, normalize

TAGS = ["HOST_LIN", "HOST_LINUX", "AUTH_LINUX", "WEB_APP", "L3_L4"]


def random_frames(n, seed, hot=0.4, base=0.3, times=False):
    rng = random.Random(seed)
    rows, at = [], 0
    for seq in range(n):
        ip = "10.0.0.1" if rng.random() < hot else rng.choice(
            ["0.0.0.0", "", "10.0.0.2", "10.0.0.3", "1.2.3.4"])
        at += rng.choice([0, 0, 1, 5, 30])
        rows.append((seq, ip, rng.choice(TAGS), 1.0 if rng.random() < base else 0.0, at))
    return rows


def loop_bonus(rows, span=None):
    """Frame by frame, with a growing list of suspicious ones."""
    out = {}
    for seq, ip, tag, base, at in rows:
        earlier = [] if ip == "0.0.0.0" else [
            r for r in rows if r[3] > 0 and r[1] == ip and (
                r[0] < seq if span is None else
                at - span <= r[4] <= at and (r[4] < at or r[0] < seq))]
        other = any(r[2] != tag for r in earlier)
        same = sum(r[2] == tag for r in earlier)
        out[seq] = 0.3 if other or same > 5 else 0.0
    return out


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "seq bigint, src_ip string, tag string, base double, at bigint").withColumns(
        {"payload": F.lit("x"), "ts": F.lit("2026-01-01").cast("timestamp_ntz")})


@pytest.mark.parametrize("seed,base", [(1, 0.3), (2, 0.05), (3, 0.9)])
def test_bonus_equals_loop(spark, seed, base):
    rows = random_frames(600, seed, base=base)
    want = loop_bonus(rows)
    for form in (correlate.with_bonus, correlate.with_window_bonus):
        got = {r["seq"]: r["bonus"] for r in form(frame(spark, rows)).collect()}
        assert got == want


@pytest.fixture(params=[1, 3, 40])
def ranges(spark, request):
    """So many ranges of rows, none of them put together again."""
    names = {"spark.sql.shuffle.partitions": str(request.param),
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def test_scans_equal_loops_for_any_ranges(spark, ranges):
    rows = random_frames(300, 4, base=0.5)
    rows += [(1000 + k, "1.2.3.4", TAGS[0], 1.0, rows[-1][4]) for k in range(5)]
    rows += [(2000 + k, None, TAGS[k % 3], 1.0, rows[-1][4]) for k in range(5)]
    known = [r for r in rows if r[1] is not None]
    df = frame(spark, rows)
    got = {r["seq"]: r["bonus"] for r in correlate.with_recent_bonus(df, span=60).collect()}
    assert got == loop_bonus(known, 60) | {2000 + k: 0.0 for k in range(5)}
    got = {r["seq"]: r["bonus"] for r in correlate.with_window_bonus(
        df.where("src_ip IS NOT NULL")).collect()}
    assert got == loop_bonus(known)


def test_recent_bonus_with_many_equal_times(spark):
    rows = [(i, "h", TAGS[i % 2], 1.0, i // 10) for i in range(100)]
    got = {r["seq"]: r["bonus"] for r in
           correlate.with_recent_bonus(frame(spark, rows), span=2).collect()}
    assert got == loop_bonus(rows, 2)


def test_long_host_name_is_another_layer_and_has_weight_one(spark):
    rows = [(0, "a", "HOST_LINUX", 1.0, 0), (1, "a", "HOST_LIN", 1.0, 0),
            (2, "b", "HOST_LIN", 1.0, 0)]
    got = {r["seq"]: r["score"] for r in fusion.verdicts(frame(spark, rows)).collect()}
    assert got == {0: 0.33, 1: 1.0, 2: 0.83}


def test_only_the_eight_scores_appear(spark):
    rows = random_frames(800, 5)
    got = {r["score"] for r in fusion.verdicts(frame(spark, rows)).collect()}
    assert got <= {0.0, 0.3, 0.33, 0.5, 0.63, 0.8, 0.83, 1.0}


def test_alerts_need_suspicion_and_come_from_the_ledger(spark):
    df = frame(spark, random_frames(800, 6))
    every = fusion.verdicts(df)
    alerts = {r["seq"] for r in fusion.alerts(df).collect()}
    assert alerts == {r["seq"] for r in every.where("is_anomaly").collect()}
    assert fusion.ledger(df).count() == df.where("base > 0").count()


def test_marks_stay_small_for_a_hot_source(spark):
    rows = [(i, "hot", "WEB_APP", 1.0, i) for i in range(5000)]
    assert correlate.source_marks(frame(spark, rows)).count() == 1
    plan = correlate.with_bonus(frame(spark, rows))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_group_limit_works_before_the_shuffle(spark):
    df = frame(spark, random_frames(50, 7))
    plan = correlate.source_marks(df)._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("Partial")
    assert "Exchange hashpartitioning(src_ip" in plan[:partial]


def test_address_rules(spark):
    rows = [
        (0, "0.0.0.0", "from 10.1.2.3 port 1"), (1, "", "from 10.1.2.3 port 1"),
        (2, "9.9.9.9", "from 10.1.2.3"), (3, "0.0.0.0", "rhost=218-22-3-51 user"),
        (4, "0.0.0.0", "999.1.1.999 first, rhost=1-2-3-4"), (5, "", "nothing"),
        (6, "0.0.0.0", "nothing"), (7, "0.0.0.0", "v1.2.3.4.5"),
    ]
    df = spark.createDataFrame(rows, "seq int, src_ip string, payload string").withColumn(
        "act", F.lit("WEB_APP"))
    got = {r["seq"]: r["src_ip"] for r in normalize.enrich(df).collect()}
    assert got == {0: "10.1.2.3", 1: "10.1.2.3", 2: "9.9.9.9", 3: "218.22.3.51",
                   4: "999.1.1.999", 5: "", 6: "0.0.0.0", 7: "2.3.4.5"}


def test_windows_wins_over_linux_and_only_host_layers_change(spark):
    rows = [(0, "HOST_LINUX", "sshd started a.exe"), (1, "HOST_WINDOWS", "sshd up"),
            (2, "HOST_LINUX", "plain"), (3, "WEB_APP", "sshd a.exe")]
    df = spark.createDataFrame(rows, "seq int, act string, payload string").withColumn(
        "src_ip", F.lit("1.1.1.1"))
    got = {r["seq"]: r["tag"] for r in normalize.enrich(df).collect()}
    assert got == {0: "HOST_WIN", 1: "HOST_LIN", 2: "HOST_LINUX", 3: "WEB_APP"}


def test_whitelist_is_case_sensitive_and_covers_flows(spark):
    rows = [(0, "L3_L4", "SQM: x"), (1, "L3_L4", "sqm: x"), (2, "WEB_APP", "mod_jk up")]
    df = spark.createDataFrame(rows, "seq int, act string, payload string").withColumn(
        "src_ip", F.lit("1.1.1.1"))
    assert [r["seq"] for r in normalize.enrich(df).collect()] == [1]


def test_missing_fields_get_defaults(spark):
    df = spark.createDataFrame([(0, None)], "seq int, src_ip string")
    row = normalize.with_defaults(df).first()
    assert (row["src_ip"], row["act"], row["payload"], row["b_in"]) == (
        C.UNKNOWN_IP, "L3_L4", "", 0)
