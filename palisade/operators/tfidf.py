"""Term statistics, vocabularies and TF-IDF weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import constants as C
from palisade import session
from palisade.functions.grams import batch_counts, ngrams

HELD_ROWS = 200_000  # weights a task holds before it passes them on
MOST_PARTS = 100_000  # terms sent to tasks; with more, all longer ones are counted


def term_stats(docs: DataFrame, analyzer: str, shortest: int, longest: int,
               among: set[str] | None = None) -> DataFrame:
    """Corpus and document frequency of every term of ``payload``.

    A task adds up the counts of its batches; what it passes on is added up before and after the
    one shuffle. A ``weight`` column counts a document several times. With ``among`` only terms
    between two of these, which are shorter by one, are counted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(among)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = ((batch["payload"].tolist(), batch["weight"].tolist()) for batch in batches)
        for terms, tf, df in batch_counts(given, analyzer, shortest, longest, shared.value):
            yield pd.DataFrame({"term": terms, "tf": tf, "df": df})

    weight = F.col("weight") if "weight" in docs.columns else F.lit(1)
    rows = docs.select(F.coalesce("payload", F.lit("")).alias("payload"),
                       weight.cast("bigint").alias("weight"))
    partial = rows.mapInPandas(count, "term string, tf bigint, df bigint")
    return partial.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocabulary(docs: DataFrame, analyzer: str, shortest: int, longest: int,
               size: int = C.VOCABULARY_SIZE) -> DataFrame:
    """The ``size`` most frequent terms, ties by term.

    Nearly every run of three words is a new one, so runs of words are counted length by length: a
    run is no more frequent than the shorter runs in it, and a length only counts runs whose parts
    are as frequent as the last of the ``size`` best terms so far. That loses no term of the result.
    """
    if analyzer != "word" or shortest == longest:
        stats = term_stats(docs, analyzer, shortest, longest)
        return stats.orderBy(F.desc("tf"), "term").limit(size)
    best, among, least = None, None, 0
    for n in range(shortest, longest + 1):
        level = session.materialize(term_stats(docs, analyzer, n, n, among), "terms")
        best = level if best is None else best.unionByName(level)
        best = session.materialize(best.orderBy(F.desc("tf"), "term").limit(size), "best")
        found = best.agg(F.count("*").alias("n"), F.min("tf").alias("least")).first()
        least = found["least"] if found["n"] == size else 0
        parts = level.where(F.col("tf") >= least).select("term").limit(MOST_PARTS + 1).collect()
        among = {r["term"] for r in parts} if len(parts) <= MOST_PARTS else None
    return best.orderBy(F.desc("tf"), "term")


def with_idf(vocab: DataFrame, documents: int) -> DataFrame:
    smooth = F.log((F.lit(1.0) + documents) / (F.lit(1.0) + F.col("df"))) + 1.0
    return vocab.withColumn("idf", smooth)


class Vectorizer:
    """A vocabulary of at most a few thousand terms, ready for use inside tasks."""

    def __init__(self, analyzer: str, shortest: int, longest: int, terms: list[str],
                 idf: np.ndarray):
        self.analyzer, self.shortest, self.longest = analyzer, shortest, longest
        self.names = list(terms)
        self.terms = {t: i for i, t in enumerate(self.names)}
        self.idf = np.asarray(idf, float)

    def tfidf(self, text: str) -> tuple[list[int], np.ndarray]:
        """Term numbers in use and their weights, of unit length together."""
        counts: dict[int, int] = {}
        for gram in ngrams(text, self.analyzer, self.shortest, self.longest):
            at = self.terms.get(gram)
            if at is not None:
                counts[at] = counts.get(at, 0) + 1
        where = list(counts)
        values = np.fromiter(counts.values(), float, len(counts)) * self.idf[where]
        norm = np.sqrt((values * values).sum())
        return where, values / norm if norm else values


def vectorizer(vocab: DataFrame, analyzer: str, shortest: int, longest: int) -> Vectorizer:
    """Collects a vocabulary (``term``, ``idf``); its size is fixed."""
    rows = vocab.select("term", "idf").collect()
    return Vectorizer(analyzer, shortest, longest, [r["term"] for r in rows],
                      np.array([r["idf"] for r in rows]))


def weights(docs: DataFrame, vector: Vectorizer) -> DataFrame:
    """``seq, term, weight`` with unit length per document; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vector)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(shared.value.names, object)
        for batch in batches:
            seqs, terms, values, held = [], [], [], 0
            for seq, text in zip(batch["seq"], batch["payload"]):
                where, one = shared.value.tfidf(text)
                seqs.append(np.full(len(where), seq))
                terms.append(np.array(where, np.int64))
                values.append(one)
                held += len(where)
                if held >= HELD_ROWS:
                    yield _weight_rows(seqs, terms, values, names)
                    seqs, terms, values, held = [], [], [], 0
            if held:
                yield _weight_rows(seqs, terms, values, names)

    rows = docs.select("seq", F.coalesce("payload", F.lit("")).alias("payload"))
    return rows.mapInPandas(weigh, "seq bigint, term string, weight double")


def _weight_rows(seqs: list, terms: list, values: list, names: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"seq": np.concatenate(seqs), "term": names[np.concatenate(terms)],
                         "weight": np.concatenate(values)})
