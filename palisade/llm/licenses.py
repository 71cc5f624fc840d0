"""License scans (operator 8): winnowed fingerprints find candidates, an alignment measures them.

Templates are cut into strings of K letters and digits; of every run of W such strings the one
with the smallest hash goes into an inverted index, so any K + W - 1 characters that a text shares
with a template hit it. A hit says where the template would lie; there the words of text and
template are aligned in a band around that diagonal.

Licences differ by single words. In a notice the words that decide (version numbers, "Lesser",
"NC", ...) must all be matched, and none may be put in between; words put in between count against
the coverage of any template. A text whose licence is not in the table is thus left unnamed. The
templates (``license_texts``: 28 licences as sentences name them, notices, and short full texts)
are an argument; their index is broadcast with the code and grows with the templates only. Of the
long licences (GNU, Apache, Mozilla, Boost) the title line and the notice are in the table, not the
body.

Defined results: a null text is the empty text and matches nothing; repeated rows give a row
each; of overlapping matches the one nearest to its template stays (matched words less missing and
added ones), then the first by name; an empty table gives an empty result. Other columns are left
out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import license_texts
from palisade.llm.common import mixed, whole_text

TEMPLATES = license_texts.templates()

K, W = 12, 8
#: Words by which an alignment may leave its diagonal, for each 10 words of the template.
BAND_SHARE = 3
#: Least coverage: matched words against those of the template and those put in between.
COVERAGE = 0.8
#: Up to this many words a template is a notice, in which every deciding word counts.
NOTICE_WORDS = 80

_KEEP = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _KEEP[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _KEEP[_c] = _c + 32
_WORD = re.compile("[a-z0-9]+")
#: First, second and fourth power of the hash's base.
_B, _B2, _B4 = (np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4))


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case ASCII letters and digits of a text, and the byte of each."""
    kept = _KEEP[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    at = np.flatnonzero(kept)
    return kept[at], at


def grams(x: np.ndarray) -> np.ndarray:
    """Hashes of all strings of K letters, by doubling."""
    if len(x) < K:
        return np.zeros(0, np.uint64)
    h1 = x.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * _B + h1[1:]
    h4 = h2[:-2] * _B2 + h2[2:]
    h8 = h4[:-4] * _B4 + h4[4:]
    return mixed(h8[:len(x) - K + 1] * _B4 + h4[8:8 + len(x) - K + 1])


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Places of the smallest hash of every run of W."""
    if len(hashes) <= W:
        return np.array([int(hashes.argmin())]) if len(hashes) else np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(hashes, W)
    return np.unique(runs.argmin(1) + np.arange(len(runs)))


def decides(word: str) -> bool:
    return word in license_texts.DECIDING or any(c.isdigit() for c in word)


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [_WORD.findall(templates[n].lower()) for n in self.names]
        self.deciding = [{w for w in words if decides(w)} if len(words) <= NOTICE_WORDS else set()
                         for words in self.words]
        entries = []
        self.lengths = []
        for k, name in enumerate(self.names):
            x, _ = letters(templates[name])
            hashes = grams(x)
            if not len(hashes):
                raise ValueError(f"template {name} has fewer than {K} letters")
            self.lengths.append(len(x))
            entries += [(int(hashes[p]), k, int(p)) for p in winnowed(hashes)]
        entries.sort()
        self.hashes = np.array([e[0] for e in entries], np.uint64)
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for h, k, p in entries:
            self.places[h].append((k, p))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def candidates(self, x: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first letter, letter after the last) where a template may lie."""
        hashes = grams(x)
        some = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        some = some[np.isin(hashes[some], self.hashes)]
        starts = defaultdict(list)
        for p, h in zip(some.tolist(), hashes[some].tolist()):
            for k, at in self.places[h]:
                starts[k].append(p - at)
        out = []
        for k, found in sorted(starts.items()):
            found.sort()
            slack = max(20, self.lengths[k] // 3)
            low = high = found[0]
            for s in [*found[1:], None]:
                if s is None or s > high + slack:
                    out.append((k, max(0, low - slack),
                                min(len(x), high + self.lengths[k] + slack)))
                    low = s
                high = s
        return out


def aligned(a: list[str], b: list[str], band: int) -> tuple[int, int, int]:
    """Most words of ``a`` matched in order by ``b``, with the first and last matched word of
    ``b``; of equal counts the shortest stretch. ``b`` is tried from each of its words that ``a``
    starts with nearby, and cells further than ``band`` from that diagonal are left out."""
    best = (0, 0, 0)
    heads = {w: k for k, w in reversed(list(enumerate(a[:band + 1])))}
    for start, word in enumerate(b):
        if word not in heads:
            continue
        shift = start - heads[word]
        last: dict[int, tuple[int, int]] = {}
        for i, w in enumerate(a):
            now: dict[int, tuple[int, int]] = {}
            for j in range(max(start, i + shift - band), min(len(b), i + shift + band + 1)):
                up, side = last.get(j, (0, -1)), now.get(j - 1, (0, -1))
                cell = max(up, side, key=lambda c: (c[0], -c[1]))
                if w == b[j]:
                    n = last.get(j - 1, (0, -1))[0] + 1
                    if n > cell[0]:
                        cell = (n, j)
                now[j] = cell
            last = now
        score = max(last.values(), key=lambda c: (c[0], -c[1]), default=(0, -1))
        if score[0] > best[0] or score[0] == best[0] and score[1] - start < best[2] - best[1]:
            best = (score[0], start, score[1])
    return best


def unmatched(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Places of ``a`` and of ``b`` that a longest common subsequence leaves out."""
    rows = [[0] * (len(b) + 1)]
    for w in a:
        above, row = rows[-1], [0]
        for j, v in enumerate(b):
            row.append(above[j] + 1 if w == v else max(above[j + 1], row[j]))
        rows.append(row)
    left, right = set(range(len(a))), set(range(len(b)))
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            left.discard(i)
            right.discard(j)
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return left, right


def fits(template: list[str], deciding: set[str], stretch: list[str]) -> bool:
    """Whether all deciding words are matched and none is put in between."""
    if not deciding:
        return True
    missing, added = unmatched(template, stretch)
    return not (any(template[k] in deciding for k in missing)
                or any(decides(stretch[k]) and stretch[k] != "by" for k in added))


def matches(text: str, index: Index, coverage: float = COVERAGE) -> list[tuple]:
    """(start, end, licence, coverage) of the licences in a text, by start; code points."""
    x, at = letters(text)
    parts = index.candidates(x)
    if not parts:
        return []
    raw = text.encode("utf-8", "replace")
    found = []
    for k, low, high in parts:
        first, last = int(at[low]), int(at[high - 1]) + 1
        own = [(m.start() + first, m.end() + first, m[0].decode())
               for m in re.finditer(rb"[a-z0-9]+", raw[first:last].lower())]
        template, deciding = index.words[k], index.deciding[k]
        band = max(2, len(template) * BAND_SHARE // 10)
        todo = [own]
        while todo:
            own = todo.pop()
            words = [w for _, _, w in own]
            if len(words) < coverage * len(template) or not deciding.issubset(words):
                continue
            n, a, b = aligned(template, words, band)
            added = b - a + 1 - n
            if n < coverage * len(template):
                continue
            todo += [own[:a], own[b + 1:]]  # copies before and after this one
            cover = n / (len(template) + added)
            if cover >= coverage and fits(template, deciding, words[a:b + 1]):
                found.append((2 * n - len(template) - added, cover, own[a][0], own[b][1],
                              index.names[k].partition("/")[0]))
    found.sort(key=lambda m: (-m[0], -m[1], m[4], m[2]))
    kept: list[tuple] = []
    for _, cover, a, b, name in found:
        if all(b <= c or a >= d for c, d, _, _ in kept):
            kept.append((a, b, name, cover))
    return [(len(raw[:a].decode()), len(raw[:b].decode()), name, cover)
            for a, b, name, cover in sorted(kept)]


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Best licence, its coverage and all matched spans of every document.

    The templates are a setting; their index goes to the tasks with the code.
    """
    index = Index(templates)

    @F.pandas_udf("n_matches long, license string, coverage double, spans string")
    def scan(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            rows = []
            for text in column:
                found = matches(text, index)
                best = max(found, key=lambda m: (m[3], m[1] - m[0]), default=None)
                rows.append((len(found), best and best[2], best and best[3], ",".join(
                    f"{name}:{a}:{b}:{cover:.4f}" for a, b, name, cover in found)))
            yield pd.DataFrame(rows, columns=["n_matches", "license", "coverage", "spans"])

    return docs.select("doc_id", scan(whole_text()).alias("found")).select("doc_id", "found.*")
