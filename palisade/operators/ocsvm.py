"""One-class SVM on text: TF-IDF, a radial kernel on landmark lines, a linear margin.

The kernel is taken against a fixed number of landmark lines (Nystroem method, Williams and
Seeger 2001); with no more distinct lines than landmarks it is exact. In the space they span,
the one-class problem (Schoelkopf 2001) asks for the shortest vector of the reduced hull of
all training rows. Each round adds the mean of the rows the present solution scores lowest and
takes the shortest mixture of all means so far. A round is two passes over the features: a
histogram of scores, then sums of the tail. Only those sums reach the driver.
All layers train in the same passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade import constants as C
from palisade import session
from palisade.operators import tfidf
from palisade.operators.quantiles import exact_quantiles

LANDMARKS = 512
COVER_ROUNDS = 4      # passes that look for lines the landmarks do not cover yet
ROUNDS = 200          # at most; a layer stops when its gap is within the tolerance
TOLERANCE = 0.02      # gap to the shortest vector, as a share of its squared length
SCORE_BINS = 4096
TIE = 1e-6            # single-precision features: scores closer than this are equal
_DENSE_ROWS = 512
_RANK_CUT = 1e-7      # directions the landmarks do not span are left out


class TextModel(tfidf.Vectorizer):
    """Everything needed to score one layer's text."""

    number = np.float32  # of term weights; a model may ask for more digits

    def __init__(self, tag: str, terms: list[str], idf: np.ndarray, gamma: float = 0.0,
                 landmarks: list[str] | None = None, weight: np.ndarray | None = None,
                 rho: float = 0.0, gap: float = 0.0):
        analyzer, shortest, longest, self.nu = C.TEXT_PROFILES[tag]
        super().__init__(analyzer, shortest, longest, terms, idf)
        self.tag, self.gamma, self.rho, self.gap = tag, gamma, rho, gap
        self.landmarks = landmarks or []
        self.weight = np.zeros(len(self.landmarks)) if weight is None else weight
        self._basis = None

    def __getstate__(self):
        return {**self.__dict__, "_basis": None}  # rebuilt where it is used

    def _landmark_rows(self) -> np.ndarray:
        if self._basis is None:
            self._basis = np.zeros((len(self.landmarks), len(self.terms)), self.number)
            for row, line in enumerate(self.landmarks):
                where, values = self.tfidf(line)
                self._basis[row, where] = values
        return self._basis

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts against the landmarks; only terms in use are multiplied."""
        basis = self._landmark_rows()
        own = (basis * basis).sum(axis=1)
        parts = []
        for start in range(0, len(texts), _DENSE_ROWS):
            rows = [self.tfidf(t) for t in texts[start:start + _DENSE_ROWS]]
            used = sorted({i for where, _ in rows for i in where})
            place = {term: k for k, term in enumerate(used)}
            dense = np.zeros((len(rows), len(used)), self.number)
            for r, (where, values) in enumerate(rows):
                dense[r, [place[i] for i in where]] = values
            apart = ((dense * dense).sum(axis=1)[:, None] + own
                     - 2.0 * (dense @ basis[:, used].T))
            parts.append(np.exp(-self.gamma * np.maximum(apart, 0.0)))
        return np.concatenate(parts) if parts else np.zeros((0, len(own)), self.number)

    def whitening(self) -> np.ndarray:
        """Turns kernel rows into features whose products give the kernel back."""
        values, vectors = np.linalg.eigh(self.kernel(self.landmarks).astype(float))
        kept = values > _RANK_CUT * values[-1]
        return vectors[:, kept] / np.sqrt(values[kept])

    def decision(self, texts: list[str]) -> np.ndarray:
        """Positive for normal text, negative for anomalies."""
        parts = [self.kernel(texts[at:at + _DENSE_ROWS]).astype(float) @ self.weight
                 for at in range(0, len(texts), _DENSE_ROWS)]
        return (np.concatenate(parts) if parts else np.zeros(0)) - self.rho


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame]]:
    """Rows by layer, ``_DENSE_ROWS`` at most: a row takes kilobytes once it has features."""
    for batch in batches:
        for tag, group in batch.groupby("tag"):
            for at in range(0, len(group), _DENSE_ROWS):
                yield tag, group.iloc[at:at + _DENSE_ROWS]


def corpus(layers: dict[str, DataFrame]) -> DataFrame:
    """Distinct ``tag, payload`` with ``weight``: copies collapse before the shuffle."""
    out = None
    for tag, lines in layers.items():
        one = lines.select(F.lit(tag).alias("tag"), "payload")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("tag", "payload").agg(F.count("*").alias("weight"))


def _untrained(lines: DataFrame, tags: list[str], size: int) -> dict[str, TextModel]:
    """Vocabularies of all layers; their size is fixed."""
    models = {}
    totals = {r["tag"]: r["n"] for r in lines.groupBy("tag").agg(
        F.sum("weight").alias("n")).collect()}
    for tag in tags:
        analyzer, shortest, longest, _ = C.TEXT_PROFILES[tag]
        own = lines.where(F.col("tag") == tag)
        vocab = tfidf.with_idf(
            tfidf.vocabulary(own, analyzer, shortest, longest, size), totals[tag]).collect()
        models[tag] = TextModel(
            tag, [r["term"] for r in vocab], np.array([r["idf"] for r in vocab]))
    return models


def _first_of(rows: DataFrame, order: list, n: int) -> dict[str, list[str]]:
    """The first ``n`` payloads of every layer; a task sends at most ``n`` per layer."""
    place = F.row_number().over(Window.partitionBy("tag").orderBy(*order))
    out: dict[str, list[str]] = {}
    for r in rows.withColumn("nth", place).where(F.col("nth") <= n).orderBy(
            "tag", "nth").collect():
        out.setdefault(r["tag"], []).append(r["payload"])
    return out


def _set_landmarks(lines: DataFrame, models: dict[str, TextModel], seed: int,
                   count: int) -> None:
    """The commonest lines first, then, round by round, the lines covered worst so far.

    What a line has in common with no landmark would be lost to the model.
    """
    share = max(count // (COVER_ROUNDS + 1), 1)
    chance = F.xxhash64(F.lit(seed), "payload")
    for tag, found in _first_of(lines, [F.desc("weight"), chance, "payload"],
                                count - COVER_ROUNDS * share).items():
        models[tag].landmarks = found
    for _ in range(COVER_ROUNDS):
        turn = {tag: m.whitening() for tag, m in models.items()}
        shared = lines.sparkSession.sparkContext.broadcast((models, turn))

        def uncovered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, basis = shared.value
            for tag, group in _groups(batches):
                z = known[tag].kernel(group["payload"].tolist()) @ basis[tag]
                yield pd.DataFrame({"tag": tag, "payload": group["payload"].to_numpy(),
                                    "rest": np.round(1.0 - (z * z).sum(axis=1), 6)})

        rest = lines.select("tag", "payload").mapInPandas(
            uncovered, "tag string, payload string, rest double").where(F.col("rest") > 1e-3)
        worst = _first_of(rest, [F.desc("rest"), chance, "payload"], share)
        for tag, found in worst.items():
            models[tag].landmarks = models[tag].landmarks + found
            models[tag]._basis = None
        if not worst:
            break


def _set_gamma(lines: DataFrame, models: dict[str, TextModel]) -> None:
    """1 / (terms x variance of all matrix entries), from plain sums."""
    shared = lines.sparkSession.sparkContext.broadcast(models)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(t, w, shared.value[t].tfidf(p)[1]) for t, p, w in
                    zip(batch["tag"], batch["payload"], batch["weight"])]
            yield pd.DataFrame([(t, w, w * v.sum(), w * (v * v).sum()) for t, w, v in rows],
                               columns=["tag", "n", "s", "q"])

    found = lines.select("tag", "payload", "weight").mapInPandas(
        sums, "tag string, n double, s double, q double").groupBy("tag").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    for row in found:
        model = models[row["tag"]]
        cells = row["n"] * max(len(model.terms), 1)
        variance = row["q"] / cells - (row["s"] / cells) ** 2
        model.gamma = 1.0 / (max(len(model.terms), 1) * variance) if variance > 0 else 1.0


def _feature_rows(lines: DataFrame, models: dict[str, TextModel],
                  whitening: dict[str, np.ndarray]) -> DataFrame:
    shared = lines.sparkSession.sparkContext.broadcast((models, whitening))

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, turn = shared.value
        for tag, group in _groups(batches):
            z = (known[tag].kernel(group["payload"].tolist()) @ turn[tag]).astype(np.float32)
            yield pd.DataFrame({"tag": tag, "weight": group["weight"].to_numpy(),
                                "z": [row.tobytes() for row in z]})

    return lines.select("tag", "payload", "weight").mapInPandas(
        mapped, "tag string, weight long, z binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def _bin_of(score: np.ndarray) -> np.ndarray:
    """Scores lie in about [-1, 1]; the outer bins take the rest."""
    return np.clip(((score + 1.0) * (SCORE_BINS / 2)).astype(np.int64), 0, SCORE_BINS - 1)


def _scores(z: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """``tag, weight, score`` of feature rows under the given vectors."""
    shared = z.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tag, group in _groups(batches):
            value = _matrix(group["z"]) @ shared.value[tag].astype(np.float32)
            yield pd.DataFrame({"tag": tag, "weight": group["weight"].to_numpy(),
                                "score": value.astype(float)})

    return z.mapInPandas(score, "tag string, weight long, score double")


def _histogram(z: DataFrame, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Row weight per score bin and layer."""
    shared = z.sparkSession.sparkContext.broadcast(weights)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for tag, group in _groups(batches):
            bins = _bin_of(_matrix(group["z"]) @ shared.value[tag].astype(np.float32))
            held = np.bincount(bins, group["weight"].to_numpy(float), SCORE_BINS)
            total[tag] = total.get(tag, 0.0) + held
        for tag, held in total.items():
            used = np.flatnonzero(held)
            yield pd.DataFrame({"tag": tag, "bin": used, "n": held[used]})

    rows = z.mapInPandas(count, "tag string, bin int, n double").groupBy("tag", "bin").agg(
        F.sum("n").alias("n")).collect()
    out = {tag: np.zeros(SCORE_BINS) for tag in weights}
    for r in rows:
        out[r["tag"]][r["bin"]] = r["n"]
    return out


def _sums(z: DataFrame, weights: dict[str, np.ndarray] | None,
          edge: dict[str, int] | None) -> dict[tuple[str, int], tuple[float, np.ndarray]]:
    """Summed features per layer: part 0 below the edge bin, part 1 in it.

    Without weights everything is part 0. A task sends one vector per layer and part.
    """
    shared = z.sparkSession.sparkContext.broadcast((weights, edge))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, edges = shared.value
        total: dict[tuple[str, int], np.ndarray] = {}
        mass: dict[tuple[str, int], float] = {}
        for tag, group in _groups(batches):
            rows, share = _matrix(group["z"]), group["weight"].to_numpy(float)
            if vectors is None:
                parts = [(0, np.ones(len(rows), bool))]
            else:
                bins = _bin_of(rows @ vectors[tag].astype(np.float32))
                parts = [(0, bins < edges[tag]), (1, bins == edges[tag])]
            for part, chosen in parts:
                if chosen.any():
                    key = (tag, part)
                    total[key] = total.get(key, 0.0) + share[chosen] @ rows[chosen].astype(
                        float)
                    mass[key] = mass.get(key, 0.0) + share[chosen].sum()
        if total:
            yield pd.DataFrame([(t, p, mass[t, p], v.tolist()) for (t, p), v in total.items()],
                               columns=["tag", "part", "n", "v"])

    parts = z.mapInPandas(add, "tag string, part int, n double, v array<double>")
    # A row per vector place: sums are taken before and after the shuffle, in no one task.
    rows = parts.select("tag", "part", F.posexplode(F.concat(F.array("n"), "v"))).groupBy(
        "tag", "part", "pos").agg(F.sum("col").alias("v")).orderBy("tag", "part", "pos").collect()
    out: dict[tuple[str, int], list[float]] = {}
    for r in rows:
        out.setdefault((r["tag"], r["part"]), []).append(r["v"])
    return {key: (v[0], np.array(v[1:])) for key, v in out.items()}


def _tail_edge(held: np.ndarray, mass: float) -> tuple[int, float]:
    """The bin where the lowest ``mass`` ends, and how much of that bin belongs to it."""
    filled = np.cumsum(held)
    at = int(np.searchsorted(filled, mass - 1e-9))
    at = min(at, len(held) - 1)
    before = filled[at] - held[at]
    return at, (mass - before) / held[at] if held[at] else 0.0


def _shortest(points: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Mixture of a few points with the smallest length, by exact pairwise steps."""
    gram = points @ points.T
    share = start.copy()
    for _ in range(5000):
        slope = gram @ share
        used = np.flatnonzero(share > 0)
        to, out = int(slope.argmin()), int(used[slope[used].argmax()])
        if slope[out] - slope[to] < 1e-10:
            break
        bend = max(gram[to, to] + gram[out, out] - 2.0 * gram[to, out], 1e-15)
        step = min(share[out], (slope[out] - slope[to]) / bend)
        share[to] += step
        share[out] -= step
    return share


def fit(lines: DataFrame, tags: list[str], seed: int = C.FOREST_SEED,
        landmarks: int = LANDMARKS, rounds: int = ROUNDS, size: int = C.VOCABULARY_SIZE,
        tolerance: float = TOLERANCE) -> dict[str, TextModel]:
    """Models of all layers from ``corpus`` lines, each with a certificate.

    The lowest-scoring share of the rows bounds the optimum from below, so a round also tells how
    far half the squared length of the vector can be from the least one. That gap, as a share of
    the squared length, is stored; a layer leaves the rounds when it is within ``tolerance``, and
    one that is not after ``rounds`` ends the training with an error.
    """
    lines = session.spread(session.materialize(lines, "corpus"))
    models = _untrained(lines, tags, size)
    _set_gamma(lines, models)
    _set_landmarks(lines, models, seed, landmarks)
    whitening = {tag: models[tag].whitening() for tag in tags}
    z = session.materialize(_feature_rows(lines, models, whitening), "features")
    means = _sums(z, None, None)
    total = {tag: means[tag, 0][0] for tag in tags}
    points = {tag: (means[tag, 0][1] / total[tag])[None, :] for tag in tags}
    shares = {tag: np.ones(1) for tag in tags}
    weights = {tag: points[tag][0] for tag in tags}
    open_tags = list(tags)
    for _ in range(rounds):
        rows = z.where(F.col("tag").isin(open_tags))
        own = {t: weights[t] for t in open_tags}
        held = _histogram(rows, own)
        ends = {t: _tail_edge(held[t], models[t].nu * total[t]) for t in open_tags}
        sums = _sums(rows, own, {t: ends[t][0] for t in open_tags})
        for tag in open_tags:
            low = sums.get((tag, 0), (0.0, 0.0))[1]
            edge = sums.get((tag, 1), (0.0, 0.0))[1]
            target = (low + ends[tag][1] * edge) / (models[tag].nu * total[tag])
            squared = float(weights[tag] @ weights[tag])
            models[tag].gap = max(float(weights[tag] @ (weights[tag] - target)), 0.0) / (squared or 1.0)
            if models[tag].gap > tolerance:
                points[tag] = np.vstack([points[tag], target])
                shares[tag] = _shortest(points[tag], np.append(shares[tag], 0.0))
                weights[tag] = shares[tag] @ points[tag]
                kept = shares[tag] > 0
                points[tag], shares[tag] = points[tag][kept], shares[tag][kept]
        open_tags = [t for t in open_tags if models[t].gap > tolerance]
        if not open_tags:
            break
    else:
        raise RuntimeError("no margin within the tolerance: " + ", ".join(
            f"{t} {models[t].gap:.2g}" for t in open_tags))
    scored = _scores(z, weights).select(
        F.col("tag").alias("name"), F.col("score").alias("x"), "weight")
    rho = exact_quantiles(scored, {t: [models[t].nu] for t in tags}, method="lower")
    for tag in tags:
        models[tag].weight = whitening[tag] @ weights[tag]
        models[tag].rho = rho[tag][0]
    return models


def decided(frames: DataFrame, models: dict[str, TextModel]) -> DataFrame:
    """Adds ``decision`` to frames with ``model_tag`` and ``payload``; no shuffle.

    Repeated payloads of a batch are scored once, so hot copies cost nothing.
    """
    shared = frames.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("double")
    def text_decision(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tags, payloads in batches:
            out = np.full(len(tags), np.nan)
            for tag in tags.unique():
                model = shared.value.get(tag)
                if model is None:
                    continue
                rows = np.flatnonzero((tags == tag).to_numpy())
                codes, texts = pd.factorize(payloads.iloc[rows])
                out[rows] = model.decision(list(texts))[codes]
            yield pd.Series(out)

    return frames.withColumn("decision", text_decision("model_tag", "payload"))


def predicted(frames: DataFrame) -> DataFrame:
    """Adds ``prediction``: -1 below the margin, 1 otherwise; a tie is normal."""
    return frames.withColumn("prediction", F.when(F.col("decision") < -TIE, -1).otherwise(1))


def to_tables(spark: SparkSession, models: dict[str, TextModel]) -> dict[str, DataFrame]:
    """Vocabulary, landmarks and settings as tables keyed by layer; sizes are fixed."""
    vocab = [(t, term, i, float(m.idf[i])) for t, m in models.items()
             for i, term in enumerate(m.names)]
    svm = [(t, i, line, float(m.weight[i])) for t, m in models.items()
           for i, line in enumerate(m.landmarks)]
    settings = [(t, float(m.rho), float(m.gamma), float(m.gap)) for t, m in models.items()]
    return {
        "vocab": spark.createDataFrame(vocab, "tag string, term string, idx int, idf double"),
        "svm": spark.createDataFrame(svm, "tag string, idx int, payload string, weight double"),
        "svm_settings": spark.createDataFrame(settings, "tag string, rho double, gamma double,"
                                              " gap double"),
    }


def from_tables(vocab: DataFrame, svm: DataFrame, settings: DataFrame) -> dict[str, TextModel]:
    words, lines = vocab.toPandas(), svm.toPandas()
    models = {}
    for row in settings.collect():
        own = words[words["tag"] == row["tag"]].sort_values("idx")
        kept = lines[lines["tag"] == row["tag"]].sort_values("idx")
        models[row["tag"]] = TextModel(
            row["tag"], own["term"].tolist(), own["idf"].to_numpy(), row["gamma"],
            kept["payload"].tolist(), kept["weight"].to_numpy(), row["rho"], row["gap"])
    return models
