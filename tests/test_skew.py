"""A source that holds a third of all rows, with broadcasting switched off."""

import pytest
from pyspark.sql import functions as F

from palisade.operators import blocks, correlate, snapshots

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "500KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def no_broadcast(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skewed_frames(spark):
    n = F.col("id")
    return spark.range(0, 300_000, 1, 12).select(
        n.alias("seq"),
        F.when(n % 3 == 0, "9.9.9.9").otherwise(
            F.concat(F.lit("10.0."), n % 5000)).alias("src_ip"),
        F.when(F.xxhash64("id") % 2 == 0, "WEB_APP").otherwise("HOST_LIN").alias("tag"),
        F.when(F.xxhash64("id", F.lit(1)) % 50 == 0, 1.0).otherwise(0.0).alias("base"),
        F.md5(n.cast("string")).alias("payload"))


def test_hot_source_is_cut_and_the_result_is_whole(no_broadcast):
    frames = skewed_frames(no_broadcast)
    joined = correlate.with_bonus(frames)
    rows = joined.groupBy("bonus").count()
    got = {r["bonus"]: r["count"] for r in rows.collect()}
    want = {r["bonus"]: r["count"] for r in
            correlate.with_window_bonus(frames).groupBy("bonus").count().collect()}
    assert got == want and sum(got.values()) == 300_000
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "skew=true" in plan


@pytest.mark.parametrize("scan", [correlate.with_recent_bonus, correlate.with_window_bonus])
def test_one_source_in_one_minute_is_cut(no_broadcast, monkeypatch, scan):
    """A third of all rows on one source and one time: every range holds a part of them."""
    no_broadcast.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    frames = skewed_frames(no_broadcast).where("seq < 60000").withColumn(
        "at", F.when(F.col("src_ip") == "9.9.9.9", 7).otherwise(F.col("seq")).cast("long"))
    seen = {}

    def in_ranges(df, order, name, ranges=None):
        seen["dealt"] = dealt = in_order(df, order, name, ranges)
        return dealt

    in_order = blocks.in_ranges
    monkeypatch.setattr(blocks, "in_ranges", in_ranges)
    try:
        got = scan(frames)
        sizes = [r["count"] for r in seen["dealt"].groupBy("_range").count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * 60_000 / 16
        hot = got.where("src_ip = '9.9.9.9'")
        hits = [tuple(r) for r in frames.where("src_ip = '9.9.9.9' AND base > 0").select(
            "seq", "tag").orderBy("seq").collect()]
        first = {t: [s for s, tag in hits if tag == t] for t in ("WEB_APP", "HOST_LIN")}
        other = {"WEB_APP": first["HOST_LIN"][0], "HOST_LIN": first["WEB_APP"][0]}
        want = sum((F.col("tag") == t).cast("int") * (
            (F.col("seq") > other[t]) | (F.col("seq") > first[t][5])).cast("int") for t in other)
        assert hot.where((F.col("bonus") > 0) != (want > 0)).count() == 0
        assert got.count() == 60_000
    finally:
        no_broadcast.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_positions_in_ranges_of_bounded_size(no_broadcast):
    """Positions of a dataset with most of the rows, and of one row."""
    rows = no_broadcast.range(0, 40_000, 1, 8).select(
        F.when(F.col("id") == 5, "lone").otherwise("big").alias("dataset"), F.col("id").alias("seq"))
    found = blocks.range_rank(rows, [F.col("dataset"), F.desc("seq")], "place", 500, ["dataset"])
    assert found.where((F.col("dataset") == "big") & (
        F.col("place") != F.lit(39_999) - F.col("seq") - (F.col("seq") < 5).cast("int"))).count() == 0
    assert found.where("dataset = 'lone'").first().place == 0
    whole = blocks.range_rank(rows, [F.asc("seq")], "place", 500)
    assert whole.where("place != seq").count() == 0 and whole.count() == 40_000


def test_hot_entity_is_spread_over_blocks(no_broadcast):
    n = F.col("id")
    rows = no_broadcast.range(0, 100_000, 1, 8).select(
        n.alias("seq"), F.lit("OS").alias("source"),
        F.create_map(
            F.lit("service_name"), F.when(n % 3 < 2, "hot").otherwise(n.cast("string")),
            F.lit("status"), (F.xxhash64("id") % 2).cast("string")).alias("data"))
    found = snapshots.state_changes(rows, block_rows=5000)
    hot = found.where(F.col("uid") == "OS:hot").count()
    states = [r["s"] for r in rows.where(F.col("data")["service_name"] == "hot").orderBy(
        "seq").select(F.col("data")["status"].alias("s")).collect()]
    assert hot == 1 + sum(a != b for a, b in zip(states, states[1:]))
    assert found.count() == hot + rows.where(F.col("data")["service_name"] != "hot").count()
