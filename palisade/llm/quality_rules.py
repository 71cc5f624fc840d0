"""Quality rules with a verdict per host (operator 1), DataFrame functions only.

Every document is measured by itself; failures of the rules are added up per host (the column
``source`` of a document), the rates are shrunk towards a beta prior that the hosts themselves
give, and the hosts' verdicts go back to their documents.

Defined results: a null text has no words and fails; a null host is a host of its own; repeated
rows are judged one by one; an empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import SHINGLE_WORDS, whole_text, words_of
from palisade.session import materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEATED = 20  # of 100 words
MAX_SYMBOLS = 10  # of 100 characters in words
MAX_DUP_LINES = 30  # of 100 lines with a word
WORD_LENGTHS = (2, 15)  # mean length of a word, from and to

#: A host is blocked when a rule fails for so large a share of its documents.
BLOCK_RATE = 0.5
#: A failed rule is forgiven at a host where it hardly ever fails. The two base rules never are.
FORGIVE_RATE = 0.01

RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")


def _repeated(sorted_windows: Column, width: int) -> Column:
    """Words covered by windows that are found twice or more.

    ``sorted_windows`` are (hash, place) pairs in order: equal windows are neighbours. Places of
    repeated ones in order cover ``width`` words each, less where they overlap.
    """
    again = F.filter(sorted_windows, lambda s, k: (
        (k > 0) & (F.get(sorted_windows, k - 1)["h"] == s["h"])) | (
        F.coalesce(F.get(sorted_windows, k + 1)["h"] == s["h"], F.lit(False))))
    places = F.array_sort(F.transform(again, lambda s: s["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("long").alias("last"))
    return F.aggregate(places, start, lambda a, p: F.struct(
        (a["n"] + F.least(F.lit(width).cast("long"), p.cast("long") - a["last"])).alias("n"),
        p.cast("long").alias("last")), lambda a: a["n"])


def measures(docs: DataFrame, carry: Column | None = None,
             width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``host``, the measures of every whole text, and ``carry`` as ``row``.

    Windows are compared by 64-bit hashes within one text; arrays stay inside their row, so no
    shuffle is needed.
    """
    row = [] if carry is None else ["row"]
    rows = docs.select("doc_id", F.col("source").cast("string").alias("host"),
                       whole_text().alias("text"), *[carry.alias(r) for r in row])
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("lines", F.filter(
        F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "doc_id", "host", *row,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    rows = rows.withColumn("windows", F.when(
        F.size("hashes") >= width,
        F.transform(F.sequence(F.lit(0), F.size("hashes") - width), lambda i: F.xxhash64(
            *[F.get(F.col("hashes"), i + k) for k in range(width)]))))
    rows = rows.withColumn("sorted", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    return rows.select(
        "doc_id", "host", *row, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(_repeated(F.col("sorted"), width), F.lit(0).cast("long"))
        .alias("n_repeat_words"))


def failures() -> dict[str, Column]:
    """The rules over the measures, true where a document fails."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEATED * n,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
        "word_length": (F.col("word_chars") < WORD_LENGTHS[0] * n)
        | (F.col("word_chars") > WORD_LENGTHS[1] * n),
    }


def host_rates(judged: DataFrame) -> DataFrame:
    """A row per host: its documents and the shrunk failure rate of every rule.

    The prior of a rule is the beta distribution with the mean and variance of the hosts' rates,
    hosts weighted by their documents. Hosts of equal rates tell no variance: then the prior
    counts as many documents as a mean host has. Counts are added up before the shuffle, and
    the prior is two numbers per rule, which go to the driver.
    """
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"f_{r}") for r in RULES])
    total = hosts.agg(
        F.sum("n").alias("docs"), F.count(F.lit(1)).alias("hosts"),
        *[F.sum(f"f_{r}").alias(f"all_{r}") for r in RULES],
        *[F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"sq_{r}") for r in RULES])
    found = total.first()
    rates = {}
    for r in RULES:
        mean, size = _prior(found["docs"], found["hosts"], found[f"all_{r}"], found[f"sq_{r}"])
        rates[r] = (F.col(f"f_{r}") + mean * size) / (F.col("n") + size)
    return hosts.select("host", "n", *[c.alias(f"rate_{r}") for r, c in rates.items()])


def _prior(docs: int, hosts: int, failed: int, squares: float) -> tuple[float, float]:
    """Mean and weight of the beta prior from sums over the hosts."""
    if not docs:
        return 0.0, 1.0
    mean = failed / docs
    variance = squares / docs - mean * mean
    if variance > 1e-9:
        return mean, max(mean * (1 - mean) / variance - 1, 1.0)
    return mean, docs / hosts


def _with_failures(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"fail_{r}": F.coalesce(c, F.lit(False))
                             for r, c in failures().items()})


def _with_verdicts(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """``rows`` with the verdicts of their hosts, which ``counted`` gives.

    The hosts' side has one row for a hot host and is written first, so the adaptive skew join can
    cut the other side.
    """
    hosts = materialize(host_rates(counted).select(
        F.col("host").alias("h"),
        (F.greatest(*[F.col(f"rate_{r}") for r in RULES]) >= BLOCK_RATE).alias("host_blocked"),
        *[(F.col(f"rate_{r}") >= FORGIVE_RATE).alias(f"held_{r}") for r in RULES]), "hosts")
    base = F.col("fail_short") | F.col("fail_repeats")
    strict = F.greatest(*[F.col(f"fail_{r}") & F.col(f"held_{r}") for r in RULES])
    return rows.join(hosts, rows["host"].eqNullSafe(hosts["h"])).withColumns({
        "base_failed": base, "kept": ~base & ~F.col("host_blocked") & ~strict})


def judged(docs: DataFrame) -> DataFrame:
    """Measures, host verdict and ``kept`` of every document.

    The measures, a few numbers per document, are written to the shared folder once, then read
    for the hosts and for the join back.
    """
    rows = materialize(_with_failures(measures(docs)), "rules")
    return _with_verdicts(rows, rows).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_blocked", "kept")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Texts are measured once: rows are written with their failures, the hosts are counted from the
    narrow columns of what was written, and the rows are read again for the join.
    """
    rows = materialize(_with_failures(measures(docs, F.struct(*[docs[c] for c in docs.columns])))
                       .select("row", "host", *[f"fail_{r}" for r in RULES]), "measured")
    return _with_verdicts(rows, rows).where("kept").select("row.*")
