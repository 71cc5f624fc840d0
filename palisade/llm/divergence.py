"""Source divergence audit (operator 13): which terms set a source apart within its language.

Terms are counted in numpy, in parts of bounded size. A term of up to 8 bytes is packed into one
uint64, one of up to 16 bytes into two; such words are put in order by a radix sort over 16-bit
digits and runs are counted. Longer terms go into buckets by length and are sorted as bytes. What
leaves a part is one row per group and term, which Spark adds up.

The sum over all kept terms of a pair of sources is split: where a term occurs in one of the two
only, its share depends on that count alone, so counts of counts are enough; terms of both are
met once, in a task that holds the sources of a term side by side and sends one sum per pair.

Defined results: null text, language and source are empty strings; a text without terms still
makes its group; equal rows count each; an empty table gives no row; other columns are left out.
A language without kept terms has pairs of value 0 and no term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.session import materialize

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Bytes of text that are counted at once; a longer text is counted in several parts.
PART_BYTES = 8 << 20
SALTS = 64

COUNTS = "lang string, source string, term string, n long, docs long"


# --- counting in a task -------------------------------------------------------------------

def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with A-Z lower-cased, and which of them belong to terms."""
    upper = (data - np.uint8(65)) < 26
    low = np.where(upper, data | np.uint8(32), data)
    return low, (low >= 128) | ((low - np.uint8(97)) < 26)


def term_spans(letter: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of terms; none crosses a bound between texts."""
    edge = np.zeros(len(letter) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], letter[:-1]))
    after = np.concatenate((letter[1:], [False]))
    return (np.flatnonzero(letter & (~before | edge[:-1])),
            np.flatnonzero(letter & (~after | edge[1:])) + 1)


def packed(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start as one number, the first byte the highest.

    ``low`` has eight spare bytes at its end. No term holds a zero byte, so zeros after a short
    term leave different terms different.
    """
    words = np.ndarray((len(low) - 7,), ">u8", low, strides=(1,))[start].astype(np.uint64)
    spare = ((8 - np.minimum(length, 8)) * 8).astype(np.uint64)
    return (words >> spare) << spare


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order by ``keys``, the last one the most significant.

    One pass per 16-bit digit, the lowest first; digits that are the same everywhere are skipped.
    """
    order = np.arange(len(keys[0]))
    for key in keys:
        digits = np.ascontiguousarray(key).view(np.uint16).reshape(len(key), -1)
        for d in range(digits.shape[1]):  # little-endian machines: the lowest digit comes first
            digit = digits[:, d]
            if (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First member, size and number of texts of each run of equal keys."""
    order = radix_order(keys)
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys:
        own = key[order]
        new[1:] |= own[1:] != own[:-1]
    first = np.flatnonzero(new)
    other = new.copy()
    own = doc[order]
    other[1:] |= own[1:] != own[:-1]  # the order is stable, so texts ascend within a run
    return order[first], np.diff(np.append(first, len(order))), np.add.reduceat(other, first)


def long_runs(terms: list[tuple[int, bytes, int, int]]) -> Iterator[tuple[int, int, int]]:
    """The same for one bucket of long terms, given as (group, bytes, text, member)."""
    terms.sort()
    k = 0
    while k < len(terms):
        group, term, last, member = terms[k]
        n = texts = 1
        k += 1
        while k < len(terms) and terms[k][0] == group and terms[k][1] == term:
            n, texts, last = n + 1, texts + (terms[k][2] != last), terms[k][2]
            k += 1
        yield member, n, texts


def counted(data: np.ndarray, bounds: np.ndarray, group: np.ndarray):
    """Counts of a part: the folded bytes, then text, start, length, count, texts per term.

    ``bounds`` cuts ``data`` into texts, ``group`` numbers the group of each text.
    """
    low, letter = folded(data)
    start, end = term_spans(letter, bounds)
    low = np.concatenate((low, np.zeros(16, np.uint8)))
    length = end - start
    doc = np.searchsorted(bounds, start, "right") - 1
    own = group[doc].astype(np.uint32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for least, most in ((1, 8), (9, 16)):
        at = np.flatnonzero((length >= least) & (length <= most))
        if len(at):
            keys = [packed(low, start[at], length[at])]
            if least == 9:
                keys.insert(0, packed(low, start[at] + 8, length[at] - 8))
            first, n, texts = runs([*keys, own[at]], doc[at])
            found.append((at[first], n, texts))
    buckets: dict[int, list] = {}
    raw = low.tobytes() if (length > 16).any() else b""
    for k in np.flatnonzero(length > 16).tolist():
        buckets.setdefault(int(length[k]), []).append(
            (int(own[k]), raw[start[k]:end[k]], int(doc[k]), k))
    for bucket in buckets.values():
        found.append(tuple(np.array(list(long_runs(bucket)), np.int64).T))
    if found:
        member, n, texts = (np.concatenate(c) for c in zip(*found, strict=True))
    else:
        member = n = texts = np.zeros(0, np.int64)
    return low, doc[member], start[member], length[member], n, texts


def text_column(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(length)))
    at = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.string(), len(start), [
        None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(low[at])])


def cuts(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive texts of up to ``most`` bytes together; a longer one stands alone."""
    start = 0
    while start < len(bounds) - 1:
        end = max(int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1, start + 1)
        yield start, end
        start = end


def long_text(data: np.ndarray, most: int) -> Counter:
    """Counts of one long text, taken in parts that end between terms."""
    total: Counter = Counter()
    start = 0
    while start < len(data):
        end = min(start + most, len(data))
        while end < len(data):  # on to the next byte outside a term
            gap = np.flatnonzero(~folded(data[end:end + 65536])[1])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + 65536, len(data))
        part = data[start:end]
        low, _, at, length, n, _ = counted(part, np.array([0, len(part)]), np.zeros(1, np.uint32))
        for term, k in zip(text_column(low, at, length).cast(pa.binary()).to_pylist(), n.tolist(),
                           strict=True):
            total[term] += k
        start = end
    return total


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``COUNTS`` for batches of lang, source, text (none of them null)."""
    names = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        lang, source = (batch.column(k).cast(pa.string()) for k in (0, 1))
        text = batch.column(2).cast(pa.large_string())
        if not len(text):
            continue
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        body = text.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        codes = [c.dictionary_encode().indices.to_numpy().astype(np.int64) for c in (lang, source)]
        _, group = np.unique(codes[0] * (len(text) + 1) + codes[1], return_inverse=True)
        for a, b in cuts(offsets, PART_BYTES):
            part = data[offsets[a]:offsets[b]]
            if not len(part):
                continue
            if len(part) > PART_BYTES:
                total = long_text(part, PART_BYTES)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang[a].as_py()] * len(total), pa.string()),
                    pa.array([source[a].as_py()] * len(total), pa.string()),
                    pa.array(list(total), pa.binary()).cast(pa.string()),
                    pa.array(list(total.values()), pa.int64()),
                    pa.array([1] * len(total), pa.int64())], names)
                continue
            low, doc, start, length, n, texts = counted(
                part, offsets[a:b + 1] - offsets[a], group[a:b])
            at = pa.array(doc + a)
            yield pa.RecordBatch.from_arrays([
                lang.take(at), source.take(at), text_column(low, start, length),
                pa.array(n.astype(np.int64)), pa.array(texts.astype(np.int64))], names)


# --- shares and divergences -----------------------------------------------------------------

def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact beyond 64 bits."""
    return F.lit(1) + F.call_function(
        "div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"),
        (total + terms).cast("decimal(20,0)"))


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


def kept_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """``lang, source, term, n, lang_n, first`` of the kept terms that occur."""
    counts = docs.mapInArrow(count_batches, COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term")
    return counts.select(
        "lang", "source", "term", "n", F.sum("n").over(by_term).alias("lang_n"),
        F.sum("docs").over(by_term).alias("docs"),
        (F.row_number().over(by_term.orderBy("source")) == 1).alias("first"),
    ).where(F.col("docs") >= min_docs).drop("docs")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every occurring group with its totals, those of its language and the share of count 0."""
    groups = docs.select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("present"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"),
                                     F.sum(F.col("first").cast("long")).alias("terms"))
    zero = F.lit(0).cast("long")
    full = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(F.col(c), zero).alias(a) for c, a in (
            ("n", "total"), ("present", "present"), ("lang_total", "lang_total"),
            ("terms", "terms"))])
    return full.withColumn("p0", F.when(F.col("terms") > 0, share(
        zero, F.col("total"), F.col("terms"))).otherwise(F.lit(1)))


def top_terms(shared: DataFrame, top: int) -> DataFrame:
    """The strongest terms of each group, ranked in salted parts first."""
    scored = shared.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"),
        F.pmod(F.xxhash64("term"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("value"), F.asc("item")]
    parts = Window.partitionBy("lang", "source", "salt").orderBy(*order)
    whole = Window.partitionBy("lang", "source").orderBy(*order)
    few = scored.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    return (few.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
            .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def meetings(frame: pd.DataFrame) -> pd.DataFrame:
    """What terms of two sources add beyond their single shares, summed per pair of sources.

    Rows are in order of (lang, term). Shifting the rows by 1, 2, ... meets each pair of sources
    of a term; sums are taken per shift, so memory stays that of the rows and the pairs.
    """
    lang, names = pd.factorize(frame["lang"])[0], frame["source"]
    source, sources = pd.factorize(names)
    p, p0 = (frame[c].to_numpy(np.int64) for c in ("p", "p0"))
    term = frame["term"].to_numpy(object)
    new = np.ones(len(frame), bool)
    new[1:] = (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])
    start = np.flatnonzero(new)
    left = np.repeat(np.append(start[1:], len(frame)), np.diff(np.append(start, len(frame))))
    left = left - np.arange(len(frame)) - 1  # rows of the same term that follow
    sums: dict[tuple[int, int, int], int] = {}
    width = len(sources)
    for shift in range(1, int(left.max(initial=0)) + 1):
        one = np.flatnonzero(left >= shift)
        for a, b in ((one, one + shift), (one + shift, one)):
            value = _gap(p[a], p[b]) - _gap(p[a], p0[b]) - _gap(p0[a], p[b]) + _gap(p0[a], p0[b])
            code = (lang[a].astype(np.int64) * width + source[a]) * width + source[b]
            order = np.argsort(code, kind="stable")
            heads = np.flatnonzero(np.diff(code[order], prepend=-1))
            for c, v in zip(code[order][heads].tolist(),
                            np.add.reduceat(value[order], heads).tolist(), strict=True):
                sums[c] = sums.get(c, 0) + v
    codes = np.array(list(sums), np.int64)
    langs = frame["lang"].to_numpy(object)[np.unique(lang, return_index=True)[1]]
    return pd.DataFrame({
        "lang": langs[codes // (width * width)] if len(codes) else [],
        "source": np.asarray(sources, object)[codes // width % width] if len(codes) else [],
        "item": np.asarray(sources, object)[codes % width] if len(codes) else [],
        "value": np.array(list(sums.values()), np.int64)})


def meeting_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``meetings`` of whole terms; the rows of a batch's last term wait for the next batch."""
    held = None
    for frame in frames:
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        last = (frame["term"] == frame["term"].iloc[-1]) & (frame["lang"] == frame["lang"].iloc[-1])
        held = frame[last]
        if not last.all():
            yield meetings(frame[~last])
    if held is not None:
        yield meetings(held)


def pair_values(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Value of each ordered pair of sources of a language, ranked."""
    one = groups.select("lang", "source", "present", "terms", "p0")
    other = groups.select("lang", F.col("source").alias("item"),
                          F.col("present").alias("other_present"), F.col("p0").alias("other_p0"))
    differ = F.col("source") != F.col("item")
    neither = one.join(other, "lang").where(differ).select(
        "lang", "source", "item", ((F.col("terms") - F.col("present") - F.col("other_present"))
                                   * gap(F.col("p0"), F.col("other_p0"))).alias("value"))
    sizes = shared.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    ways = sizes.join(other, "lang").where(differ).select("lang", F.explode(F.array(
        F.struct("source", "item", (F.col("n") * gap(F.col("p"), F.col("other_p0"))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"),
                 (F.col("n") * gap(F.col("other_p0"), F.col("p"))).alias("value")))).alias("w"))
    single = ways.select("lang", "w.source", "w.item", "w.value")
    both = shared.select("lang", "term", "source", "p", "p0").repartition("lang", "term")
    both = both.sortWithinPartitions("lang", "term").mapInPandas(
        meeting_batches, "lang string, source string, item string, value long")
    whole = neither.unionByName(single).unionByName(both)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return (whole.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
            .select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                    F.row_number().over(order).alias("rank")))


def audited(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Divergences between the sources of a language, and the terms that stand out."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                         for c in ("lang", "source", "text")])
    kept = materialize(kept_counts(docs, min_docs), "kept-terms")
    groups = materialize(group_totals(docs, kept), "groups")
    shared = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    return pair_values(shared, groups).unionByName(top_terms(shared, top))
