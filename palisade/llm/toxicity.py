"""Toxicity by class-conditional Kneser-Ney models (operator 2).

Two models over the bytes of words, one for toxic and one for ordinary texts, differ in their
highest order only. What they share is interpolated Kneser-Ney: discounted counts of six-byte
strings over continuation counts of shorter ones. A class's probability is the shared one times
its own count over the count that the shared model expects of it, both smoothed by shared backoff
counts; so a string that is rare or new in either class says nothing, and a new word is judged by
its parts.

The log-likelihood ratio of a text, divided by its words, and those of its most telling words go
into a logistic scale. Counts come from every labelled text that may be learned from; the scale
is fitted on a bounded sample with counts from the other fold.

Every table is keyed by the exact string or word and grows with the corpus: words with their counts,
strings of the words, ratios per string, ratios per word. Texts are read twice, once for the words
and once for the measures. The ratios of the ``COMMON_WORDS`` words that most texts hold are sent to
every task; a text's other words meet theirs in a join. Both ways add up the same whole numbers, so
the bound only decides which way a word goes.

Defined results: a null text is the empty text and gets the score of a text without a telling
word; labels that are null are left out; of several labels of one id the largest counts; rows
with a null id are scored and never learned from; repeated rows are rows of their own; without
labels of both classes every score is 0. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.bpe import batches
from palisade.llm.common import whole_text
from palisade.session import materialize

#: Bytes of a string whose counts are kept by class, and of the shared shorter ones.
ORDER, SHARED = 6, (2, 4)
DISCOUNT = 0.75
#: Counts by which either class's own count is smoothed towards the shared model.
BACKOFF = 0.5
#: Ratios are whole numbers of this unit, so that sums do not depend on their order.
UNIT = float(1 << 30)

#: Bound of the words whose ratios every task gets; the others are joined.
COMMON_WORDS = 100_000
#: Longer words go by their first letters and a digest.
NAME_CHARS = 64

#: Bound of the labelled texts that the logistic scale is fitted on.
SCALE_TEXTS = 20_000

#: A text is toxic from this score on.
THRESHOLD = 0.7

#: A word's ratio from which it counts by itself.
TELLING = 2.5
FOLDS = 3
#: Words that a task counts before it hands them on.
FLUSH_WORDS = 200_000
#: Of the written tables, which are mostly strings and random numbers.
CODEC = "zstd"
#: Texts that hold a word: all, and those to learn from by fold and class.
COUNTS = ["n", "n00", "n01", "n20", "n21"]
#: The two models by the counts of ordinary and toxic texts they rest on.
MODELS = {"whole": ("n00 + n20", "n01 + n21"), "part": ("n00", "n01")}
MEASURES = ["mean", "told", "share", "length"]


#: Signs at either end of a word, which are no part of it.
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"

#: Different words that are added to a text's own, so that a word weighs less in a short text.
STEADY = 20


def words_in(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(SIGNS))]


def fold(doc_id: Column) -> Column:
    """Which third a document is in; the rows of third 1 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def strings_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-byte strings that end at every byte of ' word ', and the word of each.

    The first bytes of a word have zeros before them.
    """
    raw = [f" {w} ".encode("utf-8", "replace") for w in words]
    lengths = np.array([len(r) + ORDER - 1 for r in raw])
    pad = bytes(ORDER - 1)
    flat = np.frombuffer(pad + pad.join(raw), np.uint8).astype(np.int64)
    packed = np.zeros(len(flat) - ORDER + 1, np.int64)
    for k in range(ORDER):
        packed = (packed << 8) | flat[k:len(packed) + k]
    owner = np.repeat(np.arange(len(raw)), lengths)[:len(packed)]
    # A string that ends in padding belongs to no word; one that ends in a word's first blank
    # is the same for all.
    ends = flat[ORDER - 1:]
    inside = (ends != 0) & ((packed >> 8) != 0)
    return packed[inside], owner[inside]


def name_of(word: str) -> str:
    """The word itself, or a name of bounded length that no short word has."""
    if len(word) <= NAME_CHARS:
        return word
    return word[:NAME_CHARS // 2] + " " + hashlib.blake2b(word.encode("utf-8", "replace"),
                                                          digest_size=16).hexdigest()


def counted(rows: DataFrame) -> DataFrame:
    """Every word of (``text``, ``fold``, ``toxic``) with the numbers of texts that hold it.

    A text whose ``toxic`` is null only adds its words. Repeats in one text tell nothing more.
    ``word`` is null where it is the ``name``.
    """
    def flush(held: list[Counter]) -> pd.DataFrame:
        words = list(set().union(*held))
        counts = np.array([[c[w] for w in words] for c in held], np.int64)
        counts[0] = counts.sum(axis=0)
        names = list(map(name_of, words))
        return pd.DataFrame({"name": names, "word": [
            None if n == w else w for n, w in zip(names, words)], **dict(zip(COUNTS, counts))})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [Counter() for _ in COUNTS]
        for frame in frames:
            for text, f, toxic in zip(frame["text"], frame["fold"], frame["toxic"]):
                own = held[0 if toxic < 0 else 1 + f + int(toxic)]
                own.update(set(words_in(text)))
                if len(own) > FLUSH_WORDS:
                    yield flush(held)
                    held = [Counter() for _ in COUNTS]
        if any(held):
            yield flush(held)

    kept = rows.select("text", F.coalesce("fold", F.lit(0)).cast("int").alias("fold"),
                       F.coalesce("toxic", F.lit(-1)).cast("int").alias("toxic"))
    found = kept.mapInPandas(run, "name string, word string, "
                             + ", ".join(f"{n} long" for n in COUNTS))
    return found.groupBy("name", "word").agg(*[F.sum(n).alias(n) for n in COUNTS])


def spelled() -> Column:
    return F.coalesce("word", "name").alias("word")


def strings(words: DataFrame) -> DataFrame:
    """Counts of every string (``gram``) of the words, those of words to learn from added up."""
    names = COUNTS[1:]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame["word"].tolist()):
                some = frame.iloc[part]
                packed, owner = strings_of(some["word"].tolist())
                found, back = np.unique(packed, return_inverse=True)
                yield pd.DataFrame({"gram": found, **{
                    n: np.bincount(back, some[n].to_numpy()[owner], len(found)).astype(np.int64)
                    for n in names}})

    found = words.select(spelled(), *names).mapInPandas(
        run, "gram long, " + ", ".join(f"{n} long" for n in names))
    return found.groupBy("gram").agg(*[F.sum(n).alias(n) for n in names])


def _interpolated(count: Column, total: Column, kinds: Column, below: Column) -> Column:
    """Kneser-Ney: the discounted share, and what the discounts left times the shorter string's."""
    return F.when(total > 0, (F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * below)
                  / total).otherwise(below)


def string_ratios(grams: DataFrame) -> DataFrame:
    """Log-likelihood ratio, toxic to ordinary, of every string under either model, unless 0.

    Strings of a context differ in their last byte, so a context's window holds 256 rows at most,
    and a four-byte string ends at most 65,536 longer ones.
    """
    rows = grams.select("gram", *[F.expr(e).alias(f"{m}{c}") for m, own in MODELS.items()
                                  for c, e in enumerate(own)])
    below = None
    for order in SHARED:
        end = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))
        shorter = rows.groupBy(end.alias("short")).agg(*[
            F.sum((F.col(f"{m}0") + F.col(f"{m}1") > 0).cast("long")).alias(f"{m}_n")
            for m in MODELS])
        context = Window.partitionBy(F.shiftright("short", 8))
        shorter = shorter.select(
            "short", F.col("short").bitwiseAND(F.lit((1 << 16) - 1)).alias("last"),
            *[F.col(f"{m}_n") for m in MODELS],
            *[F.sum(f"{m}_n").over(context).alias(f"{m}_t") for m in MODELS],
            *[F.sum((F.col(f"{m}_n") > 0).cast("long")).over(context).alias(f"{m}_k")
              for m in MODELS])
        if below is None:
            shorter = shorter.select("*", *[F.lit(1 / 256).alias(f"{m}_p") for m in MODELS])
        else:  # strings of two bytes: 65,536 rows at most
            shorter = shorter.join(F.broadcast(below.withColumnRenamed("short", "last")), "last")
        below = shorter.select("short", *[_interpolated(
            *[F.col(f"{m}_{x}") for x in "ntkp"]).alias(f"{m}_p") for m in MODELS])
    context = Window.partitionBy(F.shiftright("gram", 8))
    rows = rows.select(
        "*", F.col("gram").bitwiseAND(F.lit((1 << 8 * SHARED[-1]) - 1)).alias("short"),
        *[F.sum(f"{m}{c}").over(context).alias(f"{m}_t{c}") for m in MODELS for c in (0, 1)],
        *[F.sum((F.col(f"{m}0") + F.col(f"{m}1") > 0).cast("long")).over(context).alias(f"{m}_k")
          for m in MODELS])
    # A context that was never learned from says nothing under either model.
    rows = rows.where("whole_t0 + whole_t1 > 0").join(below.hint("merge"), "short")

    def ratio(m: str) -> Column:
        c0, c1, t0, t1 = (F.col(f"{m}{x}") for x in ("0", "1", "_t0", "_t1"))
        p = _interpolated(c0 + c1, t0 + t1, F.col(f"{m}_k"), F.col(f"{m}_p"))
        # What each class has against what the common model expects of it.
        toxic = (c1 + BACKOFF) / (t1 * p + BACKOFF)
        ordinary = (c0 + BACKOFF) / (t0 * p + BACKOFF)
        return F.round(F.log(toxic / ordinary) * UNIT).cast("long")

    return rows.select("gram", *[ratio(m).alias(m) for m in MODELS]).where(
        " or ".join(f"{m} <> 0" for m in MODELS))


def word_ratios(words: DataFrame, grams: DataFrame) -> DataFrame:
    """``name``, ``n`` and both models' ratios of every word: the sum over its strings."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame["word"].tolist()):
                some = frame.iloc[part]
                packed, owner = strings_of(some["word"].tolist())
                yield pd.DataFrame({"id": some["id"].to_numpy()[owner], "gram": packed})

    said = materialize(string_ratios(grams), "string_ratios", CODEC)
    summed = words.select("id", spelled()).mapInPandas(run, "id long, gram long").join(
        said.hint("merge"), "gram").groupBy("id").agg(*[F.sum(m).alias(m) for m in MODELS])
    return words.select("id", "name", "n").join(summed.hint("merge"), "id", "left").select(
        "name", "n", *[F.coalesce(m, F.lit(0)).alias(m) for m in MODELS])


def common_of(ratios: DataFrame, most: int) -> pd.DataFrame:
    """The words of the highest levels of ``n`` that hold ``most`` words together at most.

    A level is a sixteenth of a doubling, so few numbers per level reach the driver.
    """
    level = F.floor(F.log2("n") * 16)
    sizes = ratios.groupBy(level.alias("level")).count().toPandas().sort_values(
        "level", ascending=False)
    fits = sizes[sizes["count"].cumsum() <= most]["level"]
    if fits.empty:
        return pd.DataFrame(columns=["name", *MODELS])
    return ratios.where(level >= int(fits.min())).select("name", *MODELS).toPandas()


def measured(rows: DataFrame, ratios: DataFrame, common: pd.DataFrame, model: str) -> DataFrame:
    """Replaces ``text`` by the measures of the texts under a model.

    The measures: the ratio divided by the words; the telling words' ratios in all, and divided by
    the different words; the logarithm of the number of words.
    """
    kept = [f for f in rows.schema.fields if f.name != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(  # COMMON_WORDS entries at most
        dict(zip(common["name"], common[model].tolist())))
    least = TELLING * UNIT

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for frame in frames:
            out = []
            for text in frame.pop("text"):
                words = words_in(text)
                own = Counter(map(name_of, words))
                met = [(known[w], n) for w, n in own.items() if w in known]
                rest = [(w, n) for w, n in own.items() if w not in known]
                out.append((len(words), len(own), sum([r * n for r, n in met]),
                            sum([r for r, _ in met if r > least]),
                            [w for w, _ in rest], [n for _, n in rest]))
            yield frame.assign(**dict(zip(
                ["words", "different", "total", "telling", "rare", "times"],
                zip(*out) if out else [[]] * 6)))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    first = materialize(rows.select(*[f.name for f in kept], "text").mapInPandas(
        run, names + ", words long, different long, total long, telling long, "
        "rare array<string>, times array<long>").withColumn(
        "row", F.monotonically_increasing_id()), "measures", CODEC)
    pairs = first.where(F.size("rare") > 0).select(
        "row", F.explode(F.arrays_zip("rare", "times")).alias("one")).select(
        "row", F.col("one.rare").alias("name"), F.col("one.times").alias("times"))
    ratio = F.col(model)
    added = pairs.join(ratios.select("name", model).hint("merge"), "name").groupBy("row").agg(
        F.sum(ratio * F.col("times")).alias("more"),
        F.sum(F.when(ratio > least, ratio)).alias("more_telling"))
    first = first.drop("rare", "times").join(added.hint("merge"), "row", "left")
    total = (F.col("total") + F.coalesce("more", F.lit(0))) / UNIT
    told = (F.col("telling") + F.coalesce("more_telling", F.lit(0))) / UNIT
    values = [total / F.greatest("words", F.lit(1)), F.log1p(told),
              told / (F.col("different") + STEADY), F.log1p("words")]
    return first.select(*[f.name for f in kept],
                        *[v.cast("double").alias(m) for m, v in zip(MEASURES, values)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, ...]:
    """Mean, scale and weights (the constant last) of a logistic fit by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + ridge * np.append(w[:-1], 0)
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, half way to the next value below it."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = 0
    k = int(f1.argmax())
    return float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def marks_of(labels: DataFrame) -> DataFrame:
    """One label per document that may be learned from."""
    found = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max("toxic") > 0).cast("int").alias("toxic"))
    return found.where(fold(F.col("doc_id")) != 1)


def ratios_of(docs: DataFrame, marks: DataFrame) -> DataFrame | None:
    """The ratios of every word of ``docs``, or None where a class has no text to learn from."""
    texts = texts_of(docs).withColumn("fold", fold(F.col("doc_id")))
    # Labels grow with the corpus, so both sides are dealt by id at every size; the held-out third
    # only adds its words and stays where it is.
    aside = F.coalesce(F.col("fold") == 1, F.lit(True))
    learned = texts.where(~aside).join(marks.hint("merge"), "doc_id", "left").select(
        "text", "fold", "toxic")
    others = texts.where(aside).select("text", F.lit(0).alias("fold"),
                                       F.lit(None).cast("int").alias("toxic"))
    words = materialize(counted(learned.unionByName(others)).withColumn(
        "id", F.monotonically_increasing_id()), "words", CODEC)
    ordinary, toxic = words.select(*[F.sum(F.expr(e)) for e in MODELS["whole"]]).first()
    if not ordinary or not toxic:
        return None
    grams = materialize(strings(words), "strings", CODEC)
    return materialize(word_ratios(words, grams), "word_ratios", CODEC)


def scale_of(docs: DataFrame, marks: DataFrame, ratios: DataFrame, common: pd.DataFrame,
             scale_texts: int) -> tuple[np.ndarray, ...] | None:
    """Mean, scale and weights of the measures, from labelled texts of fold 2.

    The words are judged by fold 0 alone, where it has both classes.
    """
    chosen = marks.where(fold(F.col("doc_id")) == 2).orderBy(
        F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(scale_texts)
    apart = ratios.where("part <> 0").limit(1).count() > 0
    # At most scale_texts rows of two numbers are sent to every task.
    rows = texts_of(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    sample = measured(rows, ratios, common, "part" if apart else "whole").select(
        *MEASURES, "toxic").toPandas()
    sample = sample.sort_values(list(sample.columns))
    y = sample.pop("toxic").to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    mean, scale, w = logistic(sample.to_numpy(), y)
    z = (sample.to_numpy() - mean) / scale @ w[:-1] + w[-1]
    # The threshold goes where it serves the sample best.
    w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(z, y)
    return mean, scale, w


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
           common_words: int = COMMON_WORDS, scale_texts: int = SCALE_TEXTS) -> DataFrame:
    """A score from 0 to 1 and a verdict for every document."""
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    marks = materialize(marks_of(labels), "marks")
    ratios, scale = ratios_of(docs, marks), None
    if ratios is not None:
        common = common_of(ratios, common_words)
        scale = scale_of(docs, marks, ratios, common, scale_texts)
    if scale is None:
        rows = docs.select("doc_id", held_out, F.lit(0.0).alias("score"))
    else:
        rows = measured(docs.select("doc_id", held_out, whole_text().alias("text")), ratios,
                        common, "whole")
        mean, spread, w = scale
        z = F.lit(float(w[-1]))
        for k, name in enumerate(MEASURES):
            z = z + (F.col(name) - float(mean[k])) / float(spread[k]) * float(w[k])
        z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
        rows = rows.select("doc_id", "held_out", (1 / (1 + F.exp(-z))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
