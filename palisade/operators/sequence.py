"""Row order as data: file order, row ranges, sampling, shuffling, insertion, chaining."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade import constants as C
from palisade.operators import blocks

DATASET_SHIFT = 1 << 40  # rows a dataset may hold before its numbers reach the next one


def with_file_order(rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Adds ``seq``, the position of a row in its dataset's files taken in path order.

    ``rows`` is a file scan. The ids of ``monotonically_increasing_id`` run on within a file
    split; counting rows per split and summing over the splits in file order gives each split
    its start. The window sees one row per split, never the data.
    """
    marked = rows.withColumns({
        "_file": F.col("_metadata.file_path"),
        "_start": F.col("_metadata.file_block_start"),
        "_id": F.monotonically_increasing_id(),
    })
    splits = marked.groupBy(dataset, "_file", "_start").agg(
        F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(dataset).orderBy("_file", "_start").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = splits.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        marked.join(starts, [dataset, "_file", "_start"])
        .withColumn("seq", F.col("_offset") + F.col("_id") - F.col("_first"))
        .drop("_file", "_start", "_id", "_first", "_offset")
    )


def head_rows(rows: DataFrame, n: int) -> DataFrame:
    return rows.where(F.col("seq") < n)


def row_ranges(rows: DataFrame, ranges=None, only: str = C.ATTACK_CAPTURE) -> DataFrame:
    """Keeps the given half-open row ranges of datasets whose name holds ``only``."""
    spans = C.ATTACK_CAPTURE_RANGES if ranges is None else ranges
    inside = reduce(lambda a, b: a | b,
                    [(F.col("seq") >= lo) & (F.col("seq") < hi) for lo, hi in spans])
    return rows.where(~F.col("dataset").contains(only) | inside)


def insert_at(rows: DataFrame, new: DataFrame, position: int) -> DataFrame:
    """Puts the rows of ``new`` in front of ``position``; no shuffle."""
    shift = F.when(F.col("seq") >= position, F.col("seq") + 1).otherwise(F.col("seq"))
    placed = new.withColumn("seq", F.lit(position).cast("bigint"))
    return rows.withColumn("seq", shift).unionByName(placed, allowMissingColumns=True)


def keyed_digest(seed: int) -> Column:
    """A digest of seed and position: the only source of randomness here."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("seq").cast("string")))


def sample_per_dataset(rows: DataFrame, n: int = C.SAMPLE_LIMIT, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each dataset, the ones with the smallest digests.

    The limit on the rank works below the shuffle, so a task sends at most ``n`` rows per
    dataset.
    """
    w = Window.partitionBy("dataset").orderBy("_digest", "seq")
    return (
        rows.withColumn("_digest", keyed_digest(seed))
        .withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
        .drop("_digest", "_rank")
    )


def shuffle_order(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Replaces ``seq`` by a random position inside the dataset.

    The order is cut into ranges of a bounded number of rows; positions are counts of the ranges
    before.
    """
    marked = rows.withColumn("_digest", keyed_digest(seed))
    ranked = blocks.range_rank(marked, [F.col(c) for c in ("dataset", "_digest", "seq")], "_rank",
                               keys=["dataset"])
    return ranked.withColumn("seq", F.col("_rank")).drop("_rank", "_digest")


def dataset_rank(dataset: Column, names: list[str] | None = None) -> Column:
    order = names or [name for name, _, _ in C.DATASETS]
    return (F.array_position(F.array(*[F.lit(n) for n in order]), dataset) - 1).cast("bigint")


def chain(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One running order over all datasets: dataset by dataset, row by row.

    A dataset that is not listed, or one with too many rows for its share of the numbers, ends
    the run with an error.
    """
    ordinal = dataset_rank(F.col("dataset"), names)
    fits = (ordinal >= 0) & (F.col("seq") >= 0) & (F.col("seq") < DATASET_SHIFT)
    place = F.when(fits, ordinal * F.lit(DATASET_SHIFT) + F.col("seq")).otherwise(F.raise_error(
        F.concat(F.lit("no place in the order for row "), F.col("seq").cast("string"),
                 F.lit(" of "), F.col("dataset"))).cast("bigint"))
    return rows.withColumn("seq", place)
