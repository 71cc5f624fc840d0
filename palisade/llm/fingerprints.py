"""SimHash fingerprints of documents (operator 4), DataFrame functions only.

A term is a pair of neighbouring words (a lone word is a term); its weight is its length. Every
term's hash votes with its weight on the signed bits of a 128-bit fingerprint.
``within_radius`` finds fingerprints within a Hamming radius with permuted block tables.

Defined results: a null text is the empty text; a text without words has the zero fingerprint;
rows of equal id are ordered by a hash of their text, and a null id comes last; equal rows share
one place in the order and give a row each; an empty table gives an empty result. Other columns
are left out.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import whole_text, words_of
from palisade.session import materialize

BITS = 128
#: Two 32-bit counters per sum: texts of up to 2^32 / 31 terms do not overflow them.
LANES = (1 << 32) + 1
MAX_WEIGHT = 31
NULL_ID = -(1 << 63)


def votes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``f1`` and ``f2``, the two halves of the fingerprint, for each of ``keys``.

    ``texts`` has the keys and ``text``. Bits s and s + 32 of a hash are counted in one sum, so
    that a term costs 64 additions. Words are grouped by the keys: a table dealt by some of them
    is not shuffled again.
    """
    terms = texts.select(*keys, words_of(F.col("text")).alias("words"))
    terms = terms.select(*keys, F.explode_outer(F.when(F.size("words") < 2, F.col("words")).otherwise(
        F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))),
                   F.slice("words", 2, F.size("words")),
                   lambda a, b: F.concat(a, F.lit(" "), b)))).alias("term"))
    terms = terms.select(*keys, F.xxhash64("term").alias("h1"),
                         F.least(F.length("term"), F.lit(MAX_WEIGHT)).cast("long").alias("w"))
    terms = terms.withColumn("h2", F.xxhash64("h1", F.lit(1)))
    sums = [F.sum(F.shiftrightunsigned(h, s).bitwiseAND(F.lit(LANES)) * F.col("w"))
            .alias(f"{h}_{s}") for h in ("h1", "h2") for s in range(32)]
    counted = terms.groupBy(*keys).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("all"), *sums)

    def half(h: str) -> Column:
        bits = []
        for s in range(32):
            both = F.coalesce(F.col(f"{h}_{s}"), F.lit(0).cast("long"))
            low = both.bitwiseAND(F.lit((1 << 32) - 1))
            high = F.shiftrightunsigned(both, 32)
            for count, place in ((low, s), (high, s + 32)):
                bit = F.lit(1 << place if place < 63 else -(1 << 63)).cast("long")
                bits.append(F.when(2 * count > F.col("all"), bit).otherwise(F.lit(0).cast("long")))
        return reduce(Column.bitwiseOR, bits)

    return counted.select(*keys, half("h1").alias("f1"), half("h2").alias("f2"))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return 1 - distance(a1, a2, b1, b2) / F.lit(float(BITS))


def hexed(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def in_order(docs: DataFrame) -> DataFrame:
    """A row per different (id, text): its key, length, and the key of the next row.

    Only ids, hashes and lengths are put in order, in ranges that Spark cuts; a range's last row
    gets the first row of the next range.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k1"),
                      F.xxhash64("text").alias("k2"), F.length("text").cast("long").alias("n_chars"))
    ids = ids.repartitionByRange(F.desc("k1"), F.desc("k2"))
    return materialize(ids.withColumn("range", F.spark_partition_id()), "order")


def neighbours(ordered: DataFrame) -> DataFrame:
    rows = ordered.groupBy("range", "k1", "k2").agg(F.first("n_chars").alias("n_chars"))
    key = F.struct("k1", "k2")
    inside = Window.partitionBy("range").orderBy(F.desc("k1"), F.desc("k2"))
    firsts = rows.groupBy("range").agg(F.max(key).alias("first"))
    by_range = Window.orderBy("range")  # one row per range
    firsts = firsts.select("range", F.coalesce(
        F.lead("first").over(by_range),
        F.first("first").over(by_range.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    rows = rows.withColumn("lead", F.lead(key).over(inside)).join(firsts, "range")
    following = F.coalesce("lead", "after")
    return rows.select("k1", "k2", "n_chars", following["k1"].alias("next_k1"),
                       following["k2"].alias("next_k2"))


def with_edited(docs: DataFrame, order: DataFrame) -> DataFrame:
    """Each different row with its text and its edited text.

    Texts are dealt by their key once, and the needed heads of the next texts once more.
    """
    one = Window.partitionBy("k1", "k2").orderBy("k1")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k1"),
                        F.xxhash64("text").alias("k2"), "text")
    texts = texts.withColumn("place", F.row_number().over(one)).where("place = 1").drop("place")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    takers = order.select(F.col("next_k1").alias("k1"), F.col("next_k2").alias("k2"),
                          F.col("k1").alias("to1"), F.col("k2").alias("to2"), half.alias("take"))
    heads = texts.join(takers, ["k1", "k2"]).select(
        F.col("to1").alias("k1"), F.col("to2").alias("k2"),
        F.substring(F.col("text"), F.lit(1), F.col("take")).alias("head"))
    return texts.join(order, ["k1", "k2"]).join(heads, ["k1", "k2"]).select(
        "k1", "k2", "n_chars", "next_k1", "next_k2", "text", F.concat(
            F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
            F.col("head")).alias("edited"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    docs = docs.select("doc_id", whole_text().alias("text"))
    ordered = in_order(docs)
    order = materialize(neighbours(ordered), "neighbours")
    both = with_edited(docs, order).select(
        "k1", "k2", "n_chars", "next_k1", "next_k2", F.explode(F.array(
            F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
            F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("side"))
    both = both.select("k1", "k2", "n_chars", "next_k1", "next_k2", F.col("side.kind").alias("kind"),
                       F.when(F.col("side.kind") == 1, F.sha2("side.text", 256)).alias("sha"),
                       F.col("side.text").alias("text"))
    keys = ["k1", "k2", "n_chars", "next_k1", "next_k2", "kind", "sha"]
    sides = votes(both, keys)
    plain, edited = F.col("kind") == 0, F.col("kind") == 1
    found = materialize(sides.groupBy("k1", "k2", "n_chars", "next_k1", "next_k2").agg(
        F.max("sha").alias("edited_sha256"),
        *[F.max(F.when(plain, F.col(f))).alias(f) for f in ("f1", "f2")],
        *[F.max(F.when(edited, F.col(f))).alias(f"e{f[1]}") for f in ("f1", "f2")]), "votes")
    after = found.select(F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"),
                         F.col("f1").alias("n1"), F.col("f2").alias("n2"))
    rows = ordered.select("k1", "k2").join(
        found.join(after, ["next_k1", "next_k2"]), ["k1", "k2"])
    f1, f2 = F.col("f1"), F.col("f2")
    return rows.select(
        F.when(F.col("k1") != NULL_ID, F.col("k1")).alias("doc_id"), "n_chars", "edited_sha256",
        hexed(f1, f2).alias("fingerprint"),
        hexed(F.col("e1"), F.col("e2")).alias("edited_fingerprint"),
        likeness(f1, f2, F.col("e1"), F.col("e2")).alias("near_edited"),
        likeness(f1, f2, F.col("n1"), F.col("n2")).alias("near_next"))


def tables(fingerprint: Column, radius: int, more: int = 3) -> Column:
    """Keys of the permuted block tables.

    The hexadecimal fingerprint is cut into ``radius + more`` blocks. Two fingerprints within
    the radius agree in ``more`` whole blocks at least, so each choice of ``more`` blocks is a
    table, and the pair meets in one of them.
    """
    blocks, digits = radius + more, BITS // 4
    cuts = [round(k * digits / blocks) for k in range(blocks + 1)]
    return F.array(*[
        F.concat(F.lit(f"{t}:"), *[F.substring(fingerprint, cuts[b] + 1, cuts[b + 1] - cuts[b])
                                   for b in chosen])
        for t, chosen in enumerate(combinations(range(blocks), more))])


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int) -> DataFrame:
    """Pairs (``query``, ``fingerprint``, ``distance``) of different fingerprints in the radius.

    Both inputs have ``fingerprint`` (hexadecimal). Equal fingerprints are one, so groups of
    copies make no pairs; the owner joins them back by value.
    """
    def dealt(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        return one.select(name, F.explode(tables(F.col(name), radius)).alias("key"))

    pairs = dealt(queries, "query").join(dealt(fingerprints, "found"), "key")
    halves = [F.substring(F.col(side), place, 8) for side in ("query", "found")
              for place in (1, 9, 17, 25)]
    numbers = [F.conv(h, 16, 10).cast("long") for h in halves]
    apart = reduce(Column.__add__, [F.bit_count(a.bitwiseXOR(b))
                                    for a, b in zip(numbers[:4], numbers[4:], strict=True)])
    near = pairs.where(F.col("query") != F.col("found")).withColumn("distance", apart)
    return (near.where(F.col("distance") <= radius)
            .select("query", F.col("found").alias("fingerprint"), "distance").distinct())
