"""Conversation prefix trie with totals by centroid decomposition (operator 11).

Conversations are rebuilt (a shared head, then their own turns), and every distinct sequence of
first turns is a node. A sequence is known by the exclusive or of 128-bit hashes of (place, turn):
that can be carried from one range of a conversation's rows to the next, so no conversation has to
fit in a task.

Totals over subtrees come from centroid decomposition of the forest of parent edges below the
root. A component is split at its centroid: the deepest node that still has half of the
component's weight below it, a node weighing as many conversations as pass it. The centroid's
total within the component (its own value and all parts hanging from it) is added to every node on
the path from the centroid to the component's top. Each pair of a node and one above it is parted
exactly once, so the additions make up the subtree's total; weights halve, so a tree of n rows is
split at most log2 n times, however deep. Large components are split by joins, where the path is
read from the rows of the conversation that the centroid is named after; components of at most
``LOCAL_NODES`` nodes are split further inside a task, many at a time.

Defined results: turns of equal number go by a digest of role and text; equal rows are turns each;
rows without a conversation's id are left out; an empty table gives no node, not even the root;
other columns are left out. Ids below zero round towards zero when heads are looked up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import words_of
from palisade.session import materialize

GROUP = 20
HEADS = 4
#: Components up to this size are split inside one task.
LOCAL_NODES = 256
#: Nodes that a task splits at once, and bytes of ids that travel as one row.
BATCH_NODES = 200_000
CHUNK_BYTES = 1 << 16

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256"]
KEY = ["k1", "k2"]


# --- rebuilding -------------------------------------------------------------------------------

def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Turns reduced to hashes and word counts, with the range of the order they lie in."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.md5(role), text))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.unhex(digest).alias("d"), F.size(words_of(text)).cast("long").alias("words"))
    turns = turns.where(F.col("conv").isNotNull())
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("d")]
    return materialize(turns.repartitionByRange(*order)
                       .withColumn("range", F.spark_partition_id()), "turns")


def spans(turns: DataFrame) -> DataFrame:
    """A row per conversation and range: turns before it, the head's length, the whole length.

    ``asked`` turns come from the group's first conversation as far as it has them (``given``).
    """
    parts = turns.groupBy("conv", "range").agg(F.count("*").alias("n"))
    own = Window.partitionBy("conv")
    before = own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    head = F.col("conv") - F.col("conv") % GROUP
    parts = parts.select("conv", "range", head.alias("head"), F.sum("n").over(own).alias("n"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    first = F.max(F.when(F.col("conv") == F.col("head"), F.col("n"))).over(
        Window.partitionBy("head"))
    asked = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    given = F.least("asked", F.coalesce("first", F.lit(0).cast("long")))
    return materialize(
        parts.withColumns({"asked": asked, "first": first}).withColumn("given", given)
        .withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("asked"), F.lit(0)))
        .drop("first", "n"), "spans")


def hashes(place: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), place, F.col("d")) for k in (1, 2)]


def rebuilt(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """A row per turn of a rebuilt conversation.

    ``conv, depth, words``; ``k1, k2`` name the prefix that ends here, ``u1, u2`` the one before
    and ``t1, t2`` the first turn; ``left`` counts the turns from here on.
    """
    inside = Window.partitionBy("range", "conv").orderBy(F.asc_nulls_first("turn"), F.asc("d"))
    rows = turns.join(spans.drop("head"), ["range", "conv"]).withColumn(
        "pos", F.col("before") + F.row_number().over(inside))
    place = F.when(F.col("pos") > F.col("asked"), F.col("pos") - F.col("asked") + F.col("given"))
    rows = rows.withColumn("depth", place)
    g1, g2 = hashes(F.col("depth"))
    rows = rows.withColumns({"g1": F.when(F.col("depth").isNotNull(), g1),
                             "g2": F.when(F.col("depth").isNotNull(), g2)})
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = materialize(rows.select(
        "conv", "range", "pos", "depth", "d", "words", "g1", "g2",
        *[F.coalesce(F.bit_xor(f"g{k}").over(running), F.lit(0).cast("long")).alias(f"x{k}")
          for k in (1, 2)],
        (F.col("length") - F.col("depth") + 1).alias("left")), "numbered")

    # Heads: up to three turns of the group's first conversation, once for each member.
    convs = spans.select("conv", "head", "given", "length").distinct()
    lent = rows.where((F.col("pos") < HEADS) & (F.col("conv") % GROUP == 0)).select(
        F.col("conv").alias("head"), F.col("pos").alias("depth"), "d", "words")
    lent = lent.join(convs.where("given > 0"), "head").where(F.col("depth") <= F.col("given"))
    g1, g2 = hashes(F.col("depth"))
    by_conv = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    heads = materialize(lent.select(
        "conv", "depth", "words", g1.alias("g1"), g2.alias("g2"),
        (F.col("length") - F.col("depth") + 1).alias("left")).withColumns(
            {f"k{k}": F.bit_xor(f"g{k}").over(by_conv) for k in (1, 2)}), "heads")
    tops = heads.groupBy("conv").agg(
        *[F.max_by(f"k{k}", "depth").alias(f"h{k}") for k in (1, 2)],
        *[F.min_by(f"k{k}", "depth").alias(f"t{k}") for k in (1, 2)])

    # What comes before a range: the head and the conversation's ranges before.
    carried = rows.groupBy("range", "conv").agg(
        *[F.max_by(f"x{k}", "pos").alias(f"x{k}") for k in (1, 2)],
        *[F.max(F.when(F.col("depth") == 1, F.col(f"g{k}"))).alias(f"f{k}") for k in (1, 2)])
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    nought = F.lit(0).cast("long")
    carried = carried.join(tops, "conv", "left").select(
        "range", "conv",
        *[F.coalesce(f"h{k}", nought).bitwiseXOR(
            F.coalesce(F.bit_xor(f"x{k}").over(earlier), nought)).alias(f"c{k}") for k in (1, 2)],
        *[F.coalesce(F.col(f"t{k}"), F.max(f"f{k}").over(whole)).alias(f"t{k}") for k in (1, 2)])
    own = rows.where(F.col("depth").isNotNull()).join(
        materialize(carried, "carried"), ["range", "conv"]).select(
        "conv", "depth", "words", "left", "g1", "g2", "t1", "t2",
        *[F.col(f"x{k}").bitwiseXOR(F.col(f"c{k}")).alias(f"k{k}") for k in (1, 2)])
    given = heads.join(tops.select("conv", "t1", "t2"), "conv")
    every = own.unionByName(given)
    return materialize(every.select(
        "conv", "depth", "words", "left", "k1", "k2",
        *[F.col(f"k{k}").bitwiseXOR(F.col(f"g{k}")).alias(f"u{k}") for k in (1, 2)],
        "t1", "t2"), "rebuilt")


# --- ends -------------------------------------------------------------------------------------

def ends_digests(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends``: the digest over the ids (``conv``) of each key, ascending.

    Ids are put in order by ranges and joined into chunks there; a key's chunks are then read in
    order by one task, which keeps no more than the digest's state.
    """
    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            one, two, conv = (frame[c].to_numpy(np.int64) for c in ("k1", "k2", "conv"))
            names = [str(c) for c in conv.tolist()]
            chunk = np.cumsum([len(x) + 1 for x in names]) // CHUNK_BYTES
            new = np.ones(len(names), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (chunk[1:] != chunk[:-1])
            heads = np.flatnonzero(new)
            stops = np.append(heads[1:], len(names))
            yield pd.DataFrame({"k1": one[heads], "k2": two[heads], "first": conv[heads], "ids": [
                ",".join(names[a:b]) for a, b in zip(heads.tolist(), stops.tolist(), strict=True)]})

    def digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for frame in frames:
            done = []
            for k1, k2, ids in zip(frame["k1"].tolist(), frame["k2"].tolist(),
                                   frame["ids"].tolist(), strict=True):
                if (k1, k2) == held:
                    state.update(b",")
                else:
                    if held is not None:
                        done.append((*held, state.digest()))
                    held, state = (k1, k2), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["k1", "k2", "ends"])
        if held is not None:
            yield pd.DataFrame([(*held, state.digest())], columns=["k1", "k2", "ends"])

    order = ["k1", "k2", "conv"]
    chunks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(
        *order).mapInPandas(joined, "k1 long, k2 long, first long, ids string")
    return chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInPandas(
        digested, "k1 long, k2 long, ends binary")


# --- centroids in a task ------------------------------------------------------------------------

def centroid_totals(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray,
                    values: np.ndarray) -> np.ndarray:
    """Totals of ``values`` (a column each) over the subtree of every node of a forest.

    ``parent`` holds places or -1, ``weight`` the summed weight of each node's subtree. All trees
    are split at once, a level of the decomposition per round.
    """
    n = len(parent)
    order = np.argsort(depth, kind="stable")
    heads = np.flatnonzero(np.diff(depth[order], prepend=-1)) if n else np.zeros(0, np.int64)
    layers = np.split(order, heads[1:])
    top = np.arange(n)
    for layer in layers:
        inner = layer[parent[layer] >= 0]
        top[inner] = top[parent[inner]]
    weight, total = weight.copy(), np.zeros_like(values)
    alive = np.ones(n, bool)
    while alive.any():
        at = np.flatnonzero(alive)
        heavy = at[2 * weight[at] >= weight[top[at]]]
        deepest = np.full(n, -1, np.int64)
        np.maximum.at(deepest, top[heavy], depth[heavy])
        centroid = heavy[depth[heavy] == deepest[top[heavy]]]
        is_centroid = np.zeros(n, bool)
        is_centroid[centroid] = True
        # The part each node falls into: a child of the centroid, or -1 for the upper part.
        part = np.full(n, -1, np.int64)
        for layer in layers:
            own = layer[alive[layer] & (top[layer] != layer)]
            if len(own):
                above = parent[own]
                part[own] = np.where(is_centroid[above], own, part[above])
        sums = np.zeros_like(values)
        below = at[(part[at] >= 0) | is_centroid[at]]
        np.add.at(sums, top[below], values[below])
        # Add along the paths from the centroids to their tops, and take the weight off there.
        walk, goal, lost = centroid, top[centroid], weight[centroid]
        while len(walk):
            total[walk] += sums[goal]
            more = walk != goal
            walk, goal, lost = parent[walk[more]], goal[more], lost[more]
            weight[walk] -= lost
        alive[centroid] = False
        hung = at[part[at] >= 0]
        top[hung] = part[hung]
    return total


def split_locally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``centroid_totals`` of whole components; their rows arrive one component after the other."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size < BATCH_NODES:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = ((rows["t1"] == rows["t1"].iloc[-1]) & (rows["t2"] == rows["t2"].iloc[-1])).to_numpy()
        held, size = [rows[last]], int(last.sum())
        if not last.all():
            yield _totals(rows[~last])
    if size:
        yield _totals(pd.concat(held, ignore_index=True))


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.reset_index(drop=True)
    names = pd.MultiIndex.from_arrays([rows["k1"], rows["k2"]])
    parent = names.get_indexer(pd.MultiIndex.from_arrays([rows["u1"], rows["u2"]]))
    # A component's top may have its parent in another component of the batch.
    label = rows[["t1", "t2"]].to_numpy()
    parent = np.where((parent >= 0) & (label[parent] == label).all(axis=1), parent, -1)
    totals = centroid_totals(parent, rows["depth"].to_numpy(np.int64),
                             rows["weight"].to_numpy(np.int64),
                             rows[["leaf", "saved"]].to_numpy(np.int64))
    children = np.bincount(parent[parent >= 0], minlength=len(rows))
    conv = rows["conv"].to_numpy()
    return pd.DataFrame({
        "k1": rows["k1"], "k2": rows["k2"], "leaves": totals[:, 0], "saved": totals[:, 1],
        "children": children, "parent_conv": np.where(parent >= 0, conv[parent], -1),
        "inside": parent >= 0})


LOCAL = ("k1 long, k2 long, leaves long, saved long, children long, parent_conv long, "
         "inside boolean")


def local_totals(nodes: DataFrame) -> DataFrame:
    """Totals within each component (named by ``t1, t2``) of bounded size."""
    need = nodes.select("conv", "depth", *KEY, "u1", "u2", "t1", "t2", "weight", "leaf", "saved")
    return need.repartition("t1", "t2").sortWithinPartitions("t1", "t2").mapInPandas(
        split_locally, LOCAL)


# --- centroids by joins -------------------------------------------------------------------------

def split_large(nodes: DataFrame, paths: DataFrame,
                most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Splits components at centroids until each has at most ``most`` nodes.

    ``nodes`` are whole trees, ``paths`` (``member, depth, conv``) names the node of every depth on
    the way of the conversations that own a node. Returns the nodes that are no centroid, with the
    top of their component (``top, top_depth``), and the additions of every level.
    """
    comp, node = ["top", "top_depth"], ["conv", "depth"]
    settled, additions = [], []
    tops = materialize(nodes.where("depth = 1").select("t1", "t2", F.col("conv").alias("top")), "tops")
    active = materialize(nodes.join(tops, ["t1", "t2"]).select(
        *node, "weight", "leaf", "saved", "top", F.lit(1).cast("long").alias("top_depth")), "active")
    while True:
        sizes = active.groupBy(*comp).agg(F.max("weight").alias("all"), F.count("*").alias("n"))
        sizes = materialize(sizes, "sizes")
        large = sizes.where(F.col("n") > most)
        settled.append(active.join(sizes.where(F.col("n") <= most).select(*comp), comp))
        if large.isEmpty():
            break
        inner = active.join(large.drop("n"), comp)
        centroids = materialize(
            inner.where(2 * F.col("weight") >= F.col("all")).groupBy(*comp)
            .agg(F.max(F.struct("depth", "conv", "weight")).alias("c")).select(
                *comp, F.col("c.conv").alias("c_conv"), F.col("c.depth").alias("c_depth"),
                F.col("c.weight").alias("c_weight")), "centroids")
        # Nodes of one owner in a component share what lies above them at a given depth.
        owners = active.select(*comp, "conv").distinct().join(centroids, comp)
        looked = owners.select(*comp, F.col("conv").alias("member"), "c_conv", "c_depth", F.explode(
            F.array(F.col("c_depth"), F.col("c_depth") + 1)).alias("depth"))
        seen = looked.join(paths, ["member", "depth"]).groupBy(*comp, "member").agg(
            F.max(F.when(F.col("depth") == F.col("c_depth"), F.col("conv"))).alias("at"),
            F.max(F.when(F.col("depth") > F.col("c_depth"), F.col("conv"))).alias("next"))
        seen = materialize(seen.withColumnRenamed("member", "conv"), "seen")
        marked = active.join(centroids, comp).join(seen, [*comp, "conv"], "left").select(
            *comp, *node, "weight", "leaf", "saved", "c_conv", "c_depth", "next",
            F.coalesce((F.col("depth") > F.col("c_depth")) & (F.col("at") == F.col("c_conv")),
                       F.lit(False)).alias("below"),
            ((F.col("depth") == F.col("c_depth")) & (F.col("conv") == F.col("c_conv")))
            .alias("is_centroid"))
        marked = materialize(marked, "marked")
        totals = marked.where(F.col("below") | F.col("is_centroid")).groupBy(*comp).agg(
            F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
        ways = centroids.join(totals, comp).withColumnRenamed("c_conv", "member").join(
            paths, "member").where((F.col("depth") >= F.col("top_depth"))
                                   & (F.col("depth") <= F.col("c_depth")))
        ways = materialize(ways.select(
            *node, "leaves", "saved",
            F.when(F.col("depth") < F.col("c_depth"), F.col("c_weight")).alias("lost")), "ways")
        additions.append(ways.select(*node, "leaves", "saved"))
        active = marked.where(~F.col("is_centroid")).join(ways.select(*node, "lost"), node, "left")
        active = materialize(active.select(
            *node, (F.col("weight") - F.coalesce("lost", F.lit(0))).alias("weight"), "leaf", "saved",
            F.when(F.col("below"), F.col("next")).otherwise(F.col("top")).alias("top"),
            F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth"))
            .alias("top_depth")), "active")
    return reduce(DataFrame.unionByName, settled), additions


def large_totals(nodes: DataFrame, trees: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """Totals, children and parents of trees with more than ``most`` nodes.

    Right sides of joins with hot keys are written first, so that adaptive execution can cut the
    other side.
    """
    names = materialize(nodes.select(*KEY, "conv"), "names")
    owners = materialize(nodes.select(F.col("conv").alias("member")).distinct(), "owners")
    paths = rows.join(trees, ["t1", "t2"], "left_semi").select(
        F.col("conv").alias("member"), "depth", *KEY).join(owners, "member", "left_semi")
    paths = materialize(paths.join(names, KEY).select("member", "depth", "conv"), "paths")
    settled, additions = split_large(nodes, paths, most)
    parts = nodes.drop("weight", "t1", "t2").join(
        settled.select("conv", "depth", "weight", F.col("top").alias("t1"),
                       F.col("top_depth").alias("t2")), ["conv", "depth"])
    inside = local_totals(parts).select(*KEY, "leaves", "saved")
    added = nodes.select("conv", "depth", *KEY).join(
        reduce(DataFrame.unionByName, additions), ["conv", "depth"]).select(*KEY, "leaves", "saved")
    totals = inside.unionByName(added).groupBy(*KEY).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    children = nodes.groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(
        F.count("*").alias("children"))
    parents = nodes.where("depth > 1").select("conv", (F.col("depth") - 1).alias("depth"), *KEY)
    parents = parents.join(paths.select(F.col("member").alias("conv"), "depth",
                                        F.col("conv").alias("parent_conv")), ["conv", "depth"])
    return totals.join(children, KEY, "left").join(
        parents.select(*KEY, "parent_conv"), KEY, "left").select(
        *KEY, "leaves", "saved", F.coalesce("children", F.lit(0)).cast("long").alias("children"),
        "parent_conv", F.col("parent_conv").isNotNull().alias("inside"))


# --- the trie -----------------------------------------------------------------------------------

def trie(conversations: DataFrame, most: int = LOCAL_NODES) -> DataFrame:
    """A row per node of the trie over all rebuilt conversations."""
    turns = ordered_turns(conversations)
    span = spans(turns)
    rows = rebuilt(turns, span)
    convs = span.groupBy("conv").agg(F.max("length").alias("length"))
    root = convs.where("length = 0").select(F.lit(0).cast("long").alias("k1"),
                                            F.lit(0).cast("long").alias("k2"), "conv")
    ends = ends_digests(rows.where(F.col("left") == 1).select(*KEY, "conv").unionByName(root))
    ends = materialize(ends, "ends")
    nodes = rows.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n"), F.sum("left").alias("weight"),
        F.sum((F.col("left") == 1).cast("long")).alias("stop"),
        *[F.max(c).alias(c) for c in ("depth", "words", "u1", "u2", "t1", "t2")])
    nodes = materialize(nodes.select(
        *KEY, "conv", "depth", "n", "weight", "u1", "u2", "t1", "t2",
        (F.col("n") == F.col("stop")).cast("long").alias("leaf"),
        ((F.col("n") - 1) * F.col("words")).alias("saved")), "nodes")
    trees = materialize(nodes.groupBy("t1", "t2").agg(F.count("*").alias("size"))
                        .where(F.col("size") > most).drop("size"), "trees")
    if trees.isEmpty():
        totals = local_totals(nodes)
    else:
        small = nodes.join(trees, ["t1", "t2"], "left_anti")
        large = materialize(nodes.join(trees, ["t1", "t2"]), "large")
        totals = local_totals(small).unionByName(large_totals(large, trees, rows, most))
    found = nodes.drop("saved", "leaf").join(totals, KEY).join(ends, KEY, "left")
    found = materialize(found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv", "inside", F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), digest_text(F.col("ends")).alias("ends_sha256")), "trie")
    return with_root(found, convs, ends.where((F.col("k1") == 0) & (F.col("k2") == 0)))


def digest_text(digest: Column) -> Column:
    return F.coalesce(F.lower(F.hex(digest)), F.lit(hashlib.sha256().hexdigest()))


def with_root(found: DataFrame, convs: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes below and the root above them; the driver sees one row of sums."""
    smallest, n = convs.agg(F.min("conv"), F.count("*")).first()
    below = found.select(
        "conv_id", "depth", F.when(F.col("inside"), F.col("parent_conv")).otherwise(
            F.lit(smallest).cast("long")).alias("parent_conv_id"), *COLUMNS[3:])
    if not n:
        return below
    long = {c: F.lit(v).cast("long").alias(c) for c, v in (
        ("conv_id", smallest), ("depth", 0), ("parent_conv_id", None), ("n_convs", n))}
    root = found.where("depth = 1").agg(
        F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    last = ends.agg(F.max("ends")).first()[0]
    return root.select(*long.values(), *COLUMNS[4:7], digest_text(
        F.lit(last).cast("binary")).alias("ends_sha256")).unionByName(below)
