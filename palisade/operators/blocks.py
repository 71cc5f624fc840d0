"""Ordered per-key work split into blocks, so that no key has to fit in one task.

A window over a whole key puts a hot key into one task. Here the window runs inside
(key, block); what a block needs from earlier blocks is a summary of one row per
(key, block), joined back on the same columns the window is partitioned by.
Keys must not be null, and ``block`` must grow with the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.session import materialize

BLOCK_ROWS = 1_000_000


def block_of(seq: Column, rows: int = BLOCK_ROWS) -> Column:
    """Blocks of consecutive sequence numbers; unique numbers bound a block's size."""
    return F.floor(seq / F.lit(rows)).cast("bigint")


def ordered_rank(df: DataFrame, keys: list[str], order: list[str], block: Column,
                 name: str) -> DataFrame:
    """Adds the 0-based position of each row inside its key."""
    tagged = df.withColumn("_block", block)
    per_block = tagged.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        tagged.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_block", "_inside", "_offset")
    )


def previous_value(df: DataFrame, keys: list[str], order: str, value: Column,
                   block: Column) -> DataFrame:
    """Adds ``previous``: a one-field struct with the key's previous value.

    It is null only on a key's first row, so a null value stays distinguishable.
    """
    tagged = df.withColumn("_block", block).withColumn("_held", F.struct(value.alias("v")))
    last = tagged.groupBy(*keys, "_block").agg(F.max_by("_held", order).alias("_last"))
    blocks = Window.partitionBy(*keys).orderBy("_block")
    carried = last.select(*keys, "_block", F.lag("_last").over(blocks).alias("_carry"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        tagged.withColumn("_near", F.lag("_held").over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn("previous", F.coalesce("_near", "_carry"))
        .drop("_block", "_held", "_near", "_carry")
    )


def in_ranges(df: DataFrame, order: list[Column], name: str,
              ranges: int | None = None) -> DataFrame:
    """The table cut into ranges of the order, with the range's number as ``_range``.

    Spark samples the order, so ranges are of like size whatever the keys; there are as many as
    shuffle partitions unless ``ranges`` says otherwise. Rows that are equal in ``order`` stay in
    one range. The result is written, so numbers do not change.
    """
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *order)
    return materialize(dealt.withColumn("_range", F.spark_partition_id()), name)


def range_rank(df: DataFrame, order: list[Column], name: str,
               rows: int = BLOCK_ROWS, keys: list[str] | None = None) -> DataFrame:
    """Adds the 0-based position of each row of the whole table, or of its key, in the order.

    Ranges hold about ``rows`` rows at most; a row's position is its place in its range after the
    rows of the ranges before. With ``keys`` the order must begin with them. Windows over the whole
    table see a row per range (and key), never the data.
    """
    spark, keys = df.sparkSession, keys or []
    held = materialize(df, "unordered")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_ranges(held, order, "ordered", max(least, -(-held.count() // rows)))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).select(
        *keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (dealt.withColumn("_place", F.row_number().over(inside) - 1)
            .join(starts, [*keys, "_range"])
            .withColumn(name, F.col("_start") + F.col("_place"))
            .drop("_range", "_place", "_start"))
