"""Quality classifier from weak labels (operator 3).

Overlapping heuristics vote on every text: good, bad or no opinion. Expectation-maximisation over
the counts of vote patterns estimates how far each heuristic can be trusted, without any label;
the posterior of a text's pattern then is the soft label that a hashed linear scorer learns from.
The scorer decides, so a text is judged by all of its letters and not by one rule.

Defined results: a null text is the empty text, on which most heuristics have no opinion and the
length one votes bad; repeated rows are judged one by one; an empty table gives an empty result.
Other columns are left out by ``scored`` and kept by ``accepted``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.bpe import batches
from palisade.llm.common import whole_text

#: Length of the scorer's feature vector.
HASHED = 512
#: Bound of the texts that the scorer is fitted on, those with the smallest hashes.
FIT_TEXTS = 6_000
#: Score from which a document is kept.
KEEP_FROM = 0.4
EM_ROUNDS = 500
#: What is believed of a heuristic at first, as shares of the documents that would have shown it:
#: (bad, -, good) votes on junk, of which each sees one kind, and on good texts.
BELIEF = np.array([[0.1, 0, 0.4], [0.0003, 0, 0.9997]])
#: Texts of fewer words are too short for any opinion but that on their length.
FEW_WORDS = 10

SYMBOLS = b"#*$%&|<>{}[]=~^\\_@"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
FUNCTION_WORDS = frozenset(
    "the of and to in is that for with on der die und von zu das ist nicht den sich "
    "de la le les et des que un est pour el los las y en por una se".split())

MEASURES = ("words", "symbols", "shouting", "beside", "lines", "function", "length", "marks")


def measures(text: str) -> tuple[float, ...]:
    """Number of words; symbols per character; capitals per letter; most words in a row
    that equal the one before; repeated lines; function words; mean word length; exclamations per word."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(MEASURES)
    raw = text.encode("utf-8", "replace")
    letters = len(raw) - len(raw.translate(None, LETTERS))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        float(n),
        (len(raw) - len(raw.translate(None, SYMBOLS))) / len(raw),
        (len(raw) - len(raw.translate(None, UPPER))) / max(letters, 1),
        float(max(map(len, bytes(map(str.__eq__, words, words[1:])).split(b"\0")))),
        1 - len(set(lines)) / len(lines),
        sum([counts[w] for w in FUNCTION_WORDS if w in counts]) / n,
        sum(map(len, words)) / n,
        raw.count(b"!") / n,
    )


#: Per measure: bad below, good from, good to, bad above. Between them there is no opinion.
VOTES = {
    "words": (2, 20, np.inf, np.inf),
    "symbols": (-1, 0, 0.02, 0.06),
    "shouting": (-1, 0, 0.15, 0.4),
    "beside": (-1, 0, 2, 5),
    "lines": (-1, 0, 0.1, 0.3),
    "function": (0.02, 0.08, 0.7, 0.9),
    "length": (1.5, 2.5, 10, 15),
    "marks": (-1, 0, 0.05, 0.3),
}


def votes(found: tuple[float, ...]) -> str:
    """A digit per heuristic: 0 bad, 1 no opinion, 2 good."""
    out, few = [], found[0] < FEW_WORDS
    for k, (name, x) in enumerate(zip(MEASURES, found)):
        low, good, to, high = VOTES[name]
        if few and k:
            out.append("1")  # too short to say
        else:
            out.append("0" if x < low or x > high else "2" if good <= x <= to else "1")
    return "".join(out)


def features(text: str, found: tuple[float, ...]) -> np.ndarray:
    """Hashed features: square roots of byte trigram shares, and the size of every measure."""
    out = np.zeros(HASHED, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) >= 3:
        gram = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
        place = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - (HASHED - 1).bit_length())
        out += np.sqrt(np.bincount(place, minlength=HASHED) / len(gram))
    for k, x in enumerate(found):
        step = min(int(np.log2(1 + x) * 2) if not k else int(min(x, 20.0) * 20), 400)
        out[(k * 7919 + step * 104729 + 13) % HASHED] += 1
    return out


class WeakLabels:
    """Reliability of the heuristics, from the counts of their vote patterns."""

    def __init__(self, patterns: dict[str, int]):
        names = sorted(patterns)
        v = np.array([[int(c) for c in p] for p in names]).reshape(len(names), len(MEASURES))
        n = np.array([patterns[p] for p in names], float)
        # Junk comes in kinds, and one heuristic sees one kind: a bad vote outweighs the good ones.
        lean = (v - 1).sum(1) - 10 * (v == 0).sum(1)
        good = 1 / (1 + np.exp(-lean.astype(float)))
        one_hot = np.stack([v == k for k in range(3)], 2).astype(float)
        for _ in range(EM_ROUNDS):
            sides = np.stack([n * (1 - good), n * good])
            self.prior = (sides.sum(1) + 1) / (n.sum() + 2)
            seen = np.einsum("sp,pmk->smk", sides, one_hot) + 0.1
            seen[:, :, 1] = 0  # no opinion says nothing
            seen += BELIEF[:, None] * n.sum()
            self.chance = seen / seen.sum(2, keepdims=True)
            score = np.log(self.prior)[:, None] + np.einsum(
                "pmk,smk->sp", one_hot[:, :, [0, 2]], np.log(self.chance[:, :, [0, 2]]))
            new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
            moved = np.abs(new - good).max(initial=0)
            good = new
            if moved < 1e-9:
                break
        self.posterior = dict(zip(names, good.tolist()))

    def accuracy(self) -> dict[str, float]:
        """Share of each heuristic's opinions that agree with the estimated truth."""
        p = self.prior[:, None, None] * self.chance
        return {m: float((p[0, k, 0] + p[1, k, 2]) / (p[:, k, [0, 2]].sum()))
                for k, m in enumerate(MEASURES)}


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the constant last) of a logistic fit to soft labels by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p) / len(y))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fitted(docs: DataFrame) -> tuple[np.ndarray, WeakLabels] | None:
    """Scorer and label model; None without documents.

    The patterns of all documents are counted (3^8 at most); the scorer's sample is bounded.
    """
    @F.pandas_udf("string")
    def pattern(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            yield pd.Series([votes(measures(t)) for t in column], dtype=object)

    @F.pandas_udf("struct<pattern string, x binary>")
    def described(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            rows = [(votes(m := measures(t)), features(t, m).tobytes()) for t in column]
            yield pd.DataFrame(rows, columns=["pattern", "x"])

    texts = docs.select(whole_text().alias("text"))
    patterns = texts.select(pattern("text").alias("pattern")).groupBy("pattern").count().collect()
    if not patterns:
        return None
    labels = WeakLabels({r["pattern"]: r["count"] for r in patterns})
    key = F.xxhash64("text", F.lit(4))
    keys = texts.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(
        "key").limit(FIT_TEXTS)
    # At most FIT_TEXTS keys are sent to every task; of equal texts one is described.
    sample = texts.withColumn("key", key).join(F.broadcast(keys), "key").groupBy("key").agg(
        F.first("text").alias("text")).select("key", described("text").alias("d")).select(
        "key", "d.*").toPandas().sort_values("key")
    x = np.stack([np.frombuffer(b, np.float32) for b in sample["x"]])
    y = np.array([labels.posterior[p] for p in sample["pattern"]])
    return fit_linear(x, y), labels


def with_score(docs: DataFrame, name: str = "score") -> DataFrame:
    """``docs`` with the scorer's probability of good quality."""
    found = fitted(docs)
    weights = None if found is None else found[0]

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            texts, out = column.tolist(), []
            for part in batches(texts):
                x = np.stack([features(t, measures(t)) for t in texts[part]])
                out.append(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, score(whole_text()))


def scored(docs: DataFrame) -> DataFrame:
    rows = with_score(docs.select("doc_id", "text"))
    return rows.select("doc_id", "score", (F.col("score") >= KEEP_FROM).alias("kept"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with their own columns."""
    name = "_quality_score"
    rows = with_score(docs, name)
    return rows.where(F.col(name) >= KEEP_FROM).select(*[docs[c] for c in docs.columns])
