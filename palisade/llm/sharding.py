"""Sharding by best-fit-decreasing bin packing (operator 12).

Documents of equal text form a group that no shard boundary cuts. Groups enter in order of
falling size the bin with the tightest remaining capacity that still holds them; bins wait in a
balanced tree keyed by what they have left. Groups of one size follow each other, and the tightest
bin stays the tightest until it is too small, so a run of equal sizes fills bin after bin: the plan
needs the number of groups per size only. Different sizes number at most the square root of twice
the bytes, whatever the number of documents, and that is all that reaches the driver. Which groups
of a size go where follows from their position in the sorted table, which Spark finds by ranges.

``packed`` opens as few bins of a given capacity as best fit needs. ``sharded`` has a given number
of bins and takes the first capacity, from the equal share up, with which they suffice. A group
above the equal share gets a shard of its own and the rest share what is left.

Defined results: a null text is the empty text and takes the eight bytes of a row; equal rows are
rows each; groups of equal size go by their digest, rows of a shard by task, id and checksum; an
empty table gives no row; other columns are left out. With fewer groups than shards some are empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import whole_text
from palisade.operators import blocks
from palisade.session import materialize

SHARDS = 24
#: Bytes that a row takes beside its text.
ROW_BYTES = 8
#: The first slack above the equal share that is tried, as a power of one half; it doubles.
FIRST_SLACK = 20

Fill = tuple[int, int, int, int]


class BinTree:
    """Bins in order of (bytes left, number): a treap with priorities hashed from the number."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, left: int, number: int) -> None:
        priority = zlib.crc32(number.to_bytes(8, "little"))
        below, above = self._split(self.root, (left, number))
        self.root = self._joined(self._joined(below, [(left, number), priority, None, None]), above)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least room that holds ``size``."""
        below, fitting = self._split(self.root, (size, -1))
        if fitting is None:
            self.root = below
            return None
        parent, node = None, fitting
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            fitting = node[3]
        else:
            parent[2] = node[3]
        self.root = self._joined(below, fitting)
        return node[0]

    def _split(self, node: list | None, key: tuple[int, int]):
        """The parts below ``key`` and from it on."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], above = self._split(node[3], key)
            return node, above
        below, node[2] = self._split(node[2], key)
        return below, node

    def _joined(self, a: list | None, b: list | None):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._joined(a[3], b)
            return a
        b[2] = self._joined(a, b[2])
        return b


def best_fit(sizes: list[tuple[int, int]], capacity: int, most: int | None = None,
             first_bin: int = 0, start: int = 0) -> list[Fill] | None:
    """Fills (size, first position, end position, bin) for (size, groups) in falling order.

    None where more than ``most`` bins would be needed. A group above the capacity has a bin of
    its own.
    """
    tree, fills, opened = BinTree(), [], 0
    least = sizes[-1][0] if sizes else 0
    for size, groups in sizes:
        while groups:
            found = tree.take_tightest(size)
            if found is None:
                if opened == most:
                    return None
                found = (max(capacity, size), first_bin + opened)
                opened += 1
            left, number = found
            n = min(groups, left // size)
            fills.append((size, start, start + n, number))
            start, groups, left = start + n, groups - n, left - n * size
            if left >= least:  # else nothing fits any more
                tree.add(left, number)
    return fills


def equal_shares(sizes: list[tuple[int, int]], shards: int) -> list[Fill]:
    """Best fit into ``shards`` bins, at the least capacity tried that suffices."""
    fills: list[Fill] = []
    total, start, rest = sum(s * n for s, n in sizes), 0, list(sizes)
    while rest and len(fills) < shards - 1 and rest[0][0] * (shards - len(fills)) >= total:
        size, groups = rest[0]
        fills.append((size, start, start + 1, len(fills)))
        total, start = total - size, start + 1
        rest = [(size, groups - 1), *rest[1:]] if groups > 1 else rest[1:]
    if not rest:
        return fills
    bins, alone = shards - len(fills), len(fills)
    share = max(-(-total // bins), rest[0][0])
    slack = max(share >> FIRST_SLACK, 1)
    found = best_fit(rest, share, bins, alone, start)
    while found is None:
        found = best_fit(rest, share + slack, bins, alone, start)
        slack *= 2
    return fills + found


def groups_of(rows: DataFrame) -> DataFrame:
    """A row per different text with the bytes of all its copies."""
    return rows.groupBy("digest").agg(F.sum("size").alias("group_size"))


def placed(docs: DataFrame, plan: Callable[[list[tuple[int, int]]], list[Fill]]) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` by ``plan``, a function from sizes to fills.

    Slots are counted per shard and task of the first scan, then added up over the tasks.
    """
    spark = docs.sparkSession
    text = whole_text()
    rows = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"),
        F.spark_partition_id().alias("task")), "rows")
    ranked = materialize(blocks.range_rank(
        groups_of(rows), [F.desc("group_size"), F.asc("digest")], "position"), "groups")
    sizes = ranked.groupBy("group_size").agg(F.count("*").alias("n")).toPandas()
    order = sorted(zip(sizes["group_size"].tolist(), sizes["n"].tolist(), strict=True), reverse=True)
    fills = materialize(spark.createDataFrame(
        plan(order), "group_size long, first long, end long, shard int"), "fills")
    inside = (F.col("position") >= F.col("first")) & (F.col("position") < F.col("end"))
    chosen = materialize(ranked.join(fills, "group_size").where(inside).select("digest", "shard"),
                         "chosen")
    dealt = materialize(rows.join(chosen, "digest").drop("digest"), "dealt")
    return blocks.ordered_rank(dealt, ["shard"], ["doc_id", "text_crc32", "size"], F.col("task"),
                               "slot").drop("task")


def packed(docs: DataFrame, capacity: int) -> DataFrame:
    """As few shards of ``capacity`` bytes as best fit needs."""
    if capacity < 1:
        raise ValueError("a shard must hold a byte")
    return placed(docs, lambda sizes: best_fit(sizes, capacity))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``shards`` shards of nearly equal bytes."""
    if shards < 1:
        raise ValueError("there must be a shard")
    found = placed(docs, lambda sizes: equal_shares(sizes, shards))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                        F.col("slot").cast("long").alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"))
