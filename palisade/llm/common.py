"""Column expressions and array helpers that several operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters between words: blank, tab, line feed, vertical tab, form feed, carriage return.
GAP_CHARS = " \t\n\x0b\x0c\r"
GAPS = r"[\x20\x09-\x0D]+"

#: Words of a shingle, and the similarity from which two texts are near-duplicates.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text; an empty array where it has none."""
    trimmed = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAPS))


def ids_only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that others of clashing names stay away."""
    return docs.select(*columns)


def extended(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    """``schema`` with further fields at its end."""
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields.items())])


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing step over 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word, the same in every process.

    Prefix sums of the bytes weighted by powers of an odd base give the polynomial of any word
    as a difference; powers of the inverse move it to the word's start.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate(([False], ~_IS_GAP[raw], [False]))
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turn[::2], turn[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, back = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    return mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_hashes(text: str, width: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash for each run of ``width`` words; a shorter text is one shingle, no words none."""
    words = word_hashes(text)
    width = min(width, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    total = words[:n].copy()
    for k in range(1, width):
        total = total * _BASE + words[k:n + k]
    return mixed(total)
