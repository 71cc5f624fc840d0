"""Evidence for flagged frames: Shapley values of flows, word weights of text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as C
from palisade import session
from palisade.functions import scoring
from palisade.operators.forest import Forest
from palisade.operators.ocsvm import TextModel

_ROWS = 64           # rows whose coalitions are worked out together
_TASK_LINES = 2000    # lines a task explains
_KERNEL_WIDTH = 25.0
_RIDGE = 1.0
_SPLIT = re.compile(r"\s+")


def shapley(forest: Forest, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact Shapley values of the mean path length, and its expectation without features.

    Negative values shorten the path: they push towards an anomaly.
    """
    n = x.shape[1]
    everyone = range(n)
    value = {}
    for k in range(n + 1):
        for team in combinations(everyone, k):
            value[team] = np.concatenate([
                forest.expected_length(x[i:i + _ROWS], team) for i in range(0, len(x), _ROWS)])
    phi = np.zeros(x.shape)
    for i in everyone:
        others = [j for j in everyone if j != i]
        for k in range(n):
            share = factorial(k) * factorial(n - k - 1) / factorial(n)
            for team in combinations(others, k):
                joined = tuple(sorted((*team, i)))
                phi[:, i] += share * (value[joined] - value[team])
    return phi, value[()]


def with_shapley(flagged: DataFrame, forest: Forest, features: list[str]) -> DataFrame:
    """Adds ``shap`` (one value per feature) and ``expected`` to flagged flows."""
    shared = flagged.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("shap array<double>, expected double")
    def explain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            rows, back = np.unique(x, axis=0, return_inverse=True)
            phi, expected = shapley(shared.value, rows)
            back = back.reshape(-1)
            yield pd.DataFrame({"shap": list(phi[back]), "expected": expected[back]})

    return flagged.withColumn("_e", explain(*[F.col(f) for f in features])).withColumns(
        {"shap": F.col("_e.shap"), "expected": F.col("_e.expected")}).drop("_e")


def flow_evidence(shap: Column, names: list[str], cut: float = C.SHAP_CUT) -> Column:
    """Texts of the features below ``cut``, with their unscaled values."""
    parts = [F.when(F.get(shap, F.lit(i)) < cut, scoring.flow_evidence_text(
        F.lit(n), F.col(n), F.get(shap, F.lit(i)))) for i, n in enumerate(names)]
    return scoring.flow_evidence(
        F.array_compact(F.array(*parts)), F.lit(True), F.lit(None).cast("string"))


def flow_directions(shap: Column, names: list[str]) -> Column:
    """All features with the direction they push in."""
    def part(i: int, name: str) -> Column:
        value = F.get(shap, F.lit(i))
        side = F.when(value > 0, F.lit("Pushed toward Normal")).otherwise(
            F.lit("Pushed toward Anomaly"))
        return F.format_string("%s: %d (Score: %.3f -> %s)", F.lit(name), F.col(name), value, side)

    return F.array(*[part(i, n) for i, n in enumerate(names)])


def _ridge(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    share = share / share.sum()
    x0, y0 = x - share @ x, y - share @ y
    weighted = x0 * (share * len(y))[:, None]
    return np.linalg.solve(weighted.T @ x0 + _RIDGE * np.eye(x.shape[1]), weighted.T @ y0)


def word_weights(model: TextModel, text: str, samples: int = C.LIME_SAMPLES,
                 top: int = C.LIME_FEATURES, seed: int = C.FOREST_SEED) -> list[tuple]:
    """Words of ``text`` with their local weight towards an anomaly, strongest first.

    Words are dropped at random and a weighted ridge is fitted to the probability of an
    anomaly. The draws depend on seed and text only. The blanks around a dropped word stay.
    """
    pieces = re.split(r"(\s+)", text)
    words = [p for p in pieces if p and not _SPLIT.fullmatch(p)]
    names = list(dict.fromkeys(words))
    if not names:
        return []
    place = {w: i for i, w in enumerate(names)}
    rng = np.random.default_rng([seed, zlib.crc32(text.encode())])
    dropped = rng.integers(1, len(names) + 1, samples - 1)
    ranks = rng.random((samples - 1, len(names))).argsort(axis=1).argsort(axis=1)
    keep = np.ones((samples, len(names)), bool)
    keep[1:] = ranks >= dropped[:, None]

    rows, back = np.unique(keep, axis=0, return_inverse=True)
    texts = ["".join(p for p in pieces if p not in place or row[place[p]]) for row in rows]
    decision = model.decision(texts)[back.reshape(-1)]
    chance = 1.0 - 1.0 / (1.0 + np.exp(-decision))
    kept = keep.sum(axis=1)
    distance = 100.0 * (1.0 - np.sqrt(kept / len(names)))
    share = np.sqrt(np.exp(-(distance ** 2) / _KERNEL_WIDTH ** 2))

    x = keep.astype(float)
    strongest = np.argsort(-np.abs(_ridge(x, chance, share)), kind="stable")[:top]
    final = _ridge(x[:, strongest], chance, share)
    order = np.argsort(-np.abs(final), kind="stable")
    return [(names[strongest[k]], float(final[k])) for k in order]


def with_word_weights(flagged: DataFrame, models: dict[str, TextModel],
                      samples: int = C.LIME_SAMPLES, top: int = C.LIME_FEATURES) -> DataFrame:
    """Adds ``words`` to flagged text frames: every one is explained.

    A payload is explained once per layer, in tasks of at most about ``_TASK_LINES`` lines;
    the frames, which are read twice and so best lie written, meet the explanations by a join.
    """
    spark = flagged.sparkSession
    shared = spark.sparkContext.broadcast(models)

    @F.pandas_udf("array<struct<word: string, weight: double>>")
    def explain(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tags, payloads in batches:
            yield pd.Series([
                [{"word": w, "weight": v} for w, v in word_weights(
                    shared.value[tag], payload, samples, top)]
                for tag, payload in zip(tags, payloads)], dtype=object)

    lines = session.materialize(flagged.select("model_tag", "payload").distinct(), "lines")
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // _TASK_LINES))
    found = session.materialize(
        lines.repartition(tasks, "model_tag", "payload").withColumn(
            "words", explain("model_tag", "payload")), "words")
    return flagged.join(found, ["model_tag", "payload"], "left").select(*flagged.columns, "words")


def text_evidence(words: Column) -> Column:
    """Words that push towards an anomaly."""
    return F.transform(F.filter(words, lambda w: w["weight"] > 0), lambda w: w["word"])
