"""N-gram Jaccard join with Bayesian candidate pruning (operator 10).

Texts are sets of five-word shingles. Exact copies are one text from the start. Bands of MinHash
values put similar texts into groups; inside a group MinHash values are compared a few at a
time, pairs whose chance of reaching the threshold falls below a tolerance are dropped, and the
rest is verified on the shingle sets. Pairs stay inside the task that compares them: what leaves
it is a count of links per text and one link per text to its component.

Defined results: a null text is the empty text; a text of fewer than five words is one shingle of
all its words; texts without a word have no links; rows of equal text are copies, whatever their
id; the class of a text is the smallest id of its group (ids that are null come last); an empty
table gives an empty result. Other columns are left out by ``classes`` and kept by
``without_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.bpe import batches
from palisade.llm.common import SIMILARITY, shingle_hashes, whole_text
from palisade.llm.components import components
from palisade.session import materialize

#: MinHash values of a text. They are dealt into bands of ROWS values twice, in two orders: a
#: pair at the threshold of 0.8 shares one of the 64 bands with probability 0.9999.
HASHES, ROWS = 256, 8

#: MinHash values per comparison, and the chance of reaching the threshold below which a pair is
#: dropped.
STEP, TOLERANCE = 32, 1e-6

#: A group is cut into chunks of about so many texts and shingles; chunks meet pairwise.
CHUNK_TEXTS, CHUNK_SHINGLES = 512, 1 << 19

_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_SECOND_ORDER = _RNG.permutation(HASHES)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(text, hash) MinHash values of non-empty shingle sets."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        to, total = at, 0
        while to < len(sets) and (to == at or total + len(sets[to]) < 1 << 15):
            total += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to])
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at:to - 1])])
        for k in range(HASHES):
            v = x * _MULTIPLY[k] + _ADD[k]
            v ^= v >> np.uint32(15)
            out[at:to, k] = np.minimum.reduceat(v * np.uint32(0x846CA68B), starts)
        at = to
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """(text, band) keys; the number of the band is part of a key."""
    both = np.concatenate([signatures, signatures[:, _SECOND_ORDER]], 1).astype(np.uint64)
    both = both.reshape(len(signatures), -1, ROWS)
    key = np.broadcast_to(np.arange(both.shape[1], dtype=np.uint64), both.shape[:2]).copy()
    for k in range(ROWS):
        key = (key ^ both[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def fewest_matches(threshold: float, compared: int, tolerance: float = TOLERANCE) -> int:
    """The fewest matches among ``compared`` values with which a pair is kept.

    Under a uniform prior the similarity of a pair with m matches of n is Beta(m + 1, n - m + 1);
    its chance to reach t is that of at most m successes in n + 1 draws of chance t.
    """
    chance = 0.0
    for m in range(compared + 1):
        chance += comb(compared + 1, m) * threshold ** m * (1 - threshold) ** (compared + 1 - m)
        if chance >= tolerance:
            return m
    return compared + 1


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], same: bool,
                 threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two lists of shingle sets that reach the threshold."""
    a = minhashes(left)
    b = a if same else minhashes(right)
    need = {n: fewest_matches(threshold, n) for n in range(STEP, HASHES + 1, STEP)}
    kept_i, kept_j = [], []
    for i in range(len(a)):
        first = i + 1 if same else 0
        js = np.arange(first, len(b))
        matches = np.zeros(len(js), np.int64)
        for n in range(STEP, HASHES + 1, STEP):
            if not len(js):
                break
            matches = matches + (b[js, n - STEP:n] == a[i, n - STEP:n]).sum(1)
            keep = matches >= need[n]
            js, matches = js[keep], matches[keep]
        kept_i.append(np.full(len(js), i))
        kept_j.append(js)
    i, j = np.concatenate([*kept_i, [0]])[:-1], np.concatenate([*kept_j, [0]])[:-1]
    if not len(i):
        return i.astype(np.int64), j.astype(np.int64)
    return _verified(left, right, i.astype(np.int64), j.astype(np.int64), threshold)


def _verified(left, right, i, j, threshold):
    """The pairs whose sets really reach the threshold."""
    values, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes_l, sizes_r = np.array(list(map(len, left))), np.array(list(map(len, right)))
    cut = np.cumsum([0, *sizes_l, *sizes_r])
    codes_r = [codes[a:b] for a, b in zip(cut[len(left):], cut[len(left) + 1:])]
    good = np.zeros(len(i), bool)
    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    mark = np.zeros(len(values), bool)
    for at, to in zip(starts, np.append(starts[1:], len(i))):
        own = codes[cut[i[at]]:cut[i[at] + 1]]
        mark[own] = True
        others = j[at:to]
        lengths = sizes_r[others]
        inside = mark[np.concatenate([codes_r[k] for k in others])]
        common = np.add.reduceat(inside, np.cumsum([0, *lengths[:-1]]), dtype=np.int64)
        union = sizes_l[i[at]] + lengths - common
        good[at:to] = common >= threshold * union - 1e-9
        mark[own] = False
    return i[good], j[good]


def text_key(column: str = "text") -> Column:
    """64 bits that stand for a whole text."""
    return F.xxhash64(whole_text(column))


def banded(docs: DataFrame) -> DataFrame:
    """``key`` and ``bands`` for every row with a word."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, texts = frame["key"].to_numpy(), frame["text"].tolist()
            for part in batches(texts):
                sets = [shingle_hashes(t) for t in texts[part]]
                full = [k for k, s in enumerate(sets) if len(s)]
                if full:
                    rows = bands(minhashes([sets[k] for k in full]))
                    yield pd.DataFrame({"key": keys[part][full], "bands": list(rows)})

    return docs.select(text_key().alias("key"), whole_text().alias("text")).mapInPandas(
        run, "key long, bands array<long>")


def grouped(docs: DataFrame) -> DataFrame:
    """``key`` and ``grp`` of every text that shares a band with another text.

    A band's smallest text is found before rows are moved; every text of the band is then linked
    to it, and connected texts form a group.
    """
    # Copies send their bands once.
    rows = materialize(banded(docs).groupBy("key").agg(F.first("bands").alias("bands")), "bands")
    each = rows.select("key", F.explode("bands").alias("band"))
    meeting = each.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    # Both joins are of tables that grow alike, so they are merged at every size. The side with a
    # row per band is written first: joined as it leaves the aggregation, it would keep adaptive
    # execution from cutting a hot band.
    meeting = materialize(
        meeting.where(F.col("low") != F.col("high")).select("band", "low"), "meeting")
    links = each.join(meeting.hint("merge"), "band").where(F.col("key") != F.col("low"))
    groups = components(links.select(F.col("key").alias("a"), F.col("low").alias("b")).distinct())
    return groups.select(F.col("node").alias("key"), F.col("component").alias("grp"))


def links(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``key``, ``n_links`` and ``near`` of the texts that have a near-duplicate.

    ``near`` is a text of the same class, for the component search over all chunks.
    """
    groups = grouped(docs)
    texts = docs.select(text_key().alias("key"), whole_text().alias("text"))

    def shingles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for part in batches(texts):
                rows = frame.iloc[part]
                yield pd.DataFrame({"key": rows["key"], "grp": rows["grp"], "shingles": [
                    np.unique(shingle_hashes(t)).view(np.int64) for t in texts[part]]})

    # Copies become one row per task before texts are moved.
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    members = texts.join(groups.hint("merge"), "key")
    members = materialize(members.mapInPandas(
        shingles, "key long, grp long, shingles array<long>"), "sets")
    sizes = materialize(members.groupBy("grp").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_TEXTS),
                   F.ceil(F.sum(F.size("shingles")) / CHUNK_SHINGLES)).cast("int").alias("chunks")),
        "sizes")
    dealt = members.join(sizes, "grp").withColumn(
        "chunk", F.pmod(F.xxhash64("key", F.lit(5)), F.col("chunks")).cast("int"))
    dealt = dealt.select("key", "grp", "shingles", "chunk", F.explode(
        F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("grp", F.least("chunk", "other").alias("one"),
                         F.greatest("chunk", "other").alias("two"), "key", "chunk", "shingles")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        one, two = int(frame["one"].iloc[0]), int(frame["two"].iloc[0])
        frame = frame.sort_values("key")
        keys = frame["key"].to_numpy()
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in frame["shingles"]]
        if one == two:
            place = np.arange(len(keys))
            i, j = linked_pairs(sets, sets, True, threshold)
            other = place
        else:
            place, other = (np.flatnonzero(frame["chunk"].to_numpy() == c) for c in (one, two))
            if not len(place) or not len(other):
                return pd.DataFrame({"key": [], "n_links": [], "near": []})
            i, j = linked_pairs([sets[k] for k in place], [sets[k] for k in other], False, threshold)
        i, j = place[i], other[j]
        count = np.bincount(i, minlength=len(keys)) + np.bincount(j, minlength=len(keys))
        root = _roots(len(keys), i, j)
        on = count > 0
        return pd.DataFrame({"key": keys[on], "n_links": count[on], "near": keys[root[on]]})

    found = dealt.groupBy("grp", "one", "two").applyInPandas(
        compare, "key long, n_links long, near long")
    return materialize(found, "links")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first place of each place's component."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def text_classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """A row per different text: ``key``, ``first_id``, ``copies``, ``n_links``, ``class_key``,
    ``class_id``."""
    found = links(docs, threshold)
    texts = materialize(docs.select("doc_id", text_key().alias("key")).groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "texts")
    counts = found.groupBy(F.col("key").alias("k")).agg(F.sum("n_links").alias("n_links"))
    groups = components(found.select(F.col("key").alias("a"), F.col("near").alias("b")))
    rows = materialize(texts.join(counts, F.col("key") == F.col("k"), "left").join(
        groups, F.col("key") == F.col("node"), "left").select(
        "key", "first_id", "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "key").alias("grp")), "grouped")
    # The first text of a group names its class: the smallest id, and among equal ids (or none)
    # the smallest key.
    order = F.struct(F.col("first_id").isNull().alias("last"), "first_id", "key")
    heads = materialize(rows.groupBy("grp").agg(F.min(order).alias("head")).select(
        "grp", F.col("head.first_id").alias("class_id"), F.col("head.key").alias("class_key")),
        "heads")
    return materialize(rows.join(heads, "grp").drop("grp"), "classes")


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """A row per document: its class, the different texts it links to, and its text's copies."""
    texts = text_classes(docs, threshold)
    return docs.select("doc_id", text_key().alias("key")).join(texts, "key").select(
        "doc_id", "class_id", "n_links", "copies")


def without_copies(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """All columns of one row of each class: the row with the smallest id.

    Of rows that share that id and text one stays; a task drops the others before rows are moved.
    """
    texts = text_classes(docs, threshold)
    heads = texts.where(F.col("key") == F.col("class_key")).select(
        F.col("key").alias("_head_key"), F.col("first_id").alias("_head_id"))
    keyed = docs.withColumn("_head_key", text_key())
    rows = keyed.join(heads, "_head_key").where(F.col("doc_id").eqNullSafe(F.col("_head_id")))
    return rows.select("_head_key", *[docs[c] for c in docs.columns]).dropDuplicates(
        ["_head_key"]).drop("_head_key")
