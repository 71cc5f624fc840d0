"""Order-sensitive operators against plain loops, with small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.functions import times
from palisade.operators import blocks, quantiles, sequence, snapshots
from palisade.sources import readers


def random_snapshots(n, seed):
    rng = random.Random(seed)
    return [(i, "OS", {"service_name": "hot" if rng.random() < 0.5 else rng.choice("abc"),
                       "status": rng.choice("xyz")}) for i in range(n)]


def snapshot_df(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, source string, data map<string,string>")


def loop_changes(rows, known=None):
    cache, out = dict(known or {}), []
    for seq, _, data in rows:
        uid = "OS:" + data["service_name"]
        if uid not in cache or cache[uid] != data:
            cache[uid] = data
            out.append(seq)
    return out


@pytest.mark.parametrize("block_rows", [7, 50, 1000])
def test_state_changes_equal_loop(spark, block_rows):
    rows = random_snapshots(400, 1)
    got = snapshots.state_changes(snapshot_df(spark, rows), block_rows=block_rows)
    assert sorted(r["seq"] for r in got.collect()) == loop_changes(rows)


def test_seeded_changes_and_distinct_states_equal_loop(spark):
    rows = random_snapshots(300, 2)
    kept, seen, cache = [], set(), {}
    for seq, _, data in rows:
        uid = "OS:" + data["service_name"]
        state = (uid, tuple(sorted(data.items())))
        if state not in seen:
            seen.add(state)
            kept.append(seq)
            cache[uid] = data
    distinct = snapshots.distinct_states(snapshot_df(spark, rows))
    assert sorted(r["seq"] for r in distinct.collect()) == kept
    seed = snapshots.last_states(distinct)
    assert {r["uid"]: r["data"] for r in seed.collect()} == cache

    later = random_snapshots(200, 3)
    got = snapshots.state_changes(snapshot_df(spark, later), seed, block_rows=20)
    assert sorted(r["seq"] for r in got.collect()) == loop_changes(later, cache)


def test_unknown_source_is_identified_by_content(spark):
    df = spark.createDataFrame([(0, "X", {"a": "1"}), (1, "X", {"a": "1"}), (2, "X", {"a": "2"})],
                               "seq bigint, source string, data map<string,string>")
    got = snapshots.state_changes(df)
    assert sorted(r["seq"] for r in got.collect()) == [0, 2]


def test_entity_id_prints_none_for_absent_parts(spark):
    df = spark.createDataFrame([(0, "APP", {"pid": "7"})],
                               "seq bigint, source string, data map<string,string>")
    assert snapshots.identified(df).first()["uid"] == "APP:None-7"


def test_lines_with_odd_blanks(spark):
    rows = [(0, "OS", " svc up  extra\x1cmore "), (1, "OS", "short"),
            (2, "OS", " 　 "), (3, "OS", "Name up"), (4, "??", "a b")]
    df = spark.createDataFrame(rows, "seq bigint, source string, line string")
    got = {r["seq"]: r["data"] for r in snapshots.parse_lines(df).collect()}
    assert got == {0: {"service_name": "svc", "status": "up", "extra_info": "extra more"},
                   4: {"extra_info": "a b"}}


def test_ordered_rank_is_dense_for_hot_keys(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), F.col("id").alias("seq"))
    ranked = blocks.ordered_rank(df, ["k"], ["seq"], blocks.block_of(F.col("seq"), 13), "r")
    for key in ("hot", "cold"):
        got = [r["r"] for r in ranked.where(F.col("k") == key).orderBy("seq").collect()]
        assert got == list(range(len(got)))


def test_file_order_over_many_files(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(0, 5000, 1, 7).select(F.col("id").cast("string").alias("value")).write.option(
        "compression", "bzip2").text(path)
    rows = readers.text_lines(spark, path, "d").collect()
    assert all(r["seq"] == int(r["value"]) for r in rows) and len(rows) == 5000


def test_file_order_when_files_are_cut_into_splits(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(0, 20000, 1, 2).select(F.col("id").cast("string").alias("value")).write.text(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = readers.text_lines(spark, path, "d").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r["seq"] == int(r["value"]) for r in rows) and len(rows) == 20000


def test_sample_takes_whole_small_sets_and_repeats(spark):
    df = spark.range(900).select(
        F.when(F.col("id") < 880, "big").otherwise("small").alias("dataset"),
        F.col("id").alias("seq"))
    one = sequence.sample_per_dataset(df, 100)
    two = sequence.sample_per_dataset(df.repartition(7), 100)
    counts = {r["dataset"]: r["count"] for r in one.groupBy("dataset").count().collect()}
    assert counts == {"big": 100, "small": 20}
    assert one.exceptAll(two).count() == 0


@pytest.mark.parametrize("kind", ["random", "ties", "constant", "two"])
def test_quantiles_equal_the_built_in(spark, kind):
    x = {"random": F.rand(7) * 1e6, "ties": F.floor(F.rand(7) * 5).cast("double"),
         "constant": F.lit(3.5), "two": F.when(F.col("id") % 3 == 0, 1.0).otherwise(1e300)}[kind]
    df = spark.range(4001).select(F.lit("n").alias("name"), x.alias("x")).cache()
    probs = [0.0, 0.007, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, {"n": probs})["n"]
    want = df.agg(F.percentile("x", probs)).first()[0]
    assert got == pytest.approx(want, rel=1e-12)


def test_lower_quantile_leaves_at_most_its_share_below(spark):
    df = spark.createDataFrame([("n", float(i), 1 + i % 3) for i in range(100)],
                               "name string, x double, weight int")
    cut = quantiles.exact_quantiles(df, {"n": [0.1]}, method="lower")["n"][0]
    total = df.agg(F.sum("weight")).first()[0]
    below = df.where(F.col("x") < cut).agg(F.sum("weight")).first()[0]
    upto = df.where(F.col("x") <= cut).agg(F.sum("weight")).first()[0]
    assert below <= 0.1 * total < upto


def test_timestamps_that_must_not_parse(spark):
    texts = ["2026", " 2026-01-01", "20260101", "12:00:00", "2026-01-01T00:00:00+05:30",
             "2026-13-01", "Jun 14 15:16:01", "", "nan"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    base = F.lit("1999-01-01").cast("timestamp_ntz")
    got = {r[0] for r in df.select(times.parsed_ts(F.col("t"), base)).collect()}
    assert {str(t) for t in got} == {"1999-01-01 00:00:00"}


def test_every_z_is_removed(spark):
    df = spark.createDataFrame([("2026-04-30ZT12:00:00ZZ",)], "t string")
    got = df.select(times.parsed_ts(F.col("t"), F.lit(None).cast("timestamp_ntz"))).first()[0]
    assert str(got) == "2026-04-30 12:00:00"


@pytest.mark.parametrize("values", [
    [1.0, float("nan"), 3.0, 2.0], [float("inf"), 1.0, 2.0], [float("-inf"), 5.0, float("inf")],
    [5e-324, 1e-323, 0.0, 1.5e-323], [float("inf")] * 3, [-1.7e308, 1.7e308, 0.0]])
def test_quantiles_of_odd_numbers(spark, values):
    df = spark.createDataFrame([("n", v) for v in values], "name string, x double")
    got = quantiles.exact_quantiles(df, {"n": [0.0, 0.5, 1.0]})["n"]
    kept = sorted(v for v in values if v == v)
    middle = (kept[(len(kept) - 1) // 2], kept[len(kept) // 2])
    want = [kept[0], middle[0] if middle[0] == middle[1] else sum(middle) / 2, kept[-1]]
    assert got == pytest.approx(want, rel=1e-12)


def test_chain_takes_large_numbers_and_refuses_what_has_no_place(spark):
    df = spark.createDataFrame([("a", 2_000_000_000), ("b", 5)], "dataset string, seq bigint")
    rows = {r["dataset"]: r["seq"] for r in sequence.chain(df, ["a", "b"]).collect()}
    assert rows == {"a": 2_000_000_000, "b": sequence.DATASET_SHIFT + 5}
    for names, bad in ((["a"], df), (["a", "b"], df.withColumn(
            "seq", F.lit(sequence.DATASET_SHIFT)))):
        with pytest.raises(Exception, match="no place in the order"):
            sequence.chain(bad, names).collect()
