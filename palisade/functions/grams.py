"""n-grams of texts, for batches inside tasks.

Column expressions can build the same n-grams as an array of strings per row, but sorting and
exploding those arrays took several times as long as counting packed numbers per batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np

_BLANK_RUN = re.compile(r"\s{2,}")
_WORD = re.compile(r"\w{2,}")


def ngrams(text: str, analyzer: str, shortest: int, longest: int) -> list[str]:
    """All n-grams of the lower-cased text.

    ``char`` folds runs of two or more blanks to one space; ``word`` takes tokens of two or
    more word characters.
    """
    out: list[str] = []
    if analyzer == "char":
        folded = _BLANK_RUN.sub(" ", text.lower())
        for n in range(shortest, longest + 1):
            out += [folded[i:i + n] for i in range(len(folded) - n + 1)]
        return out
    words = _WORD.findall(text.lower())
    for n in range(shortest, longest + 1):
        out += [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    return out


SLICE_SYMBOLS = 2_000_000  # symbols counted together; bounds the memory of a task
_HELD_TERMS = 1_000_000    # different n-grams of a length a task holds before it passes them on
_HELD_SYMBOLS = 200_000    # different symbols it holds
_SPELL_ROWS = 100_000      # n-grams that are strings at a time

Part = tuple[list[str], np.ndarray, np.ndarray]


def gram_counts(texts: list[str], weights: list[int], analyzer: str, shortest: int,
                longest: int) -> Iterator[Part]:
    """Partial counts ``(terms, tf, df)`` of the texts, a text counting ``weight`` times."""
    return batch_counts([(texts, weights)], analyzer, shortest, longest)


def batch_counts(batches: Iterable[tuple[list[str], list[int]]], analyzer: str, shortest: int,
                 longest: int, among: set[str] | None = None) -> Iterator[Part]:
    """Partial counts ``(terms, tf, df)`` of the texts of all batches of a task.

    n-grams are packed into whole numbers and counted by sorting; the counts of slices are added up
    as numbers, and only what is passed on turns into strings. The same term may come in several
    parts. With ``among`` an n-gram counts only when both n-grams it holds that are shorter by one
    are in the set.
    """
    held = _Held(analyzer, shortest, longest)
    for texts, weights in batches:
        start, size = 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size >= SLICE_SYMBOLS or end == len(texts):
                yield from held.add(texts[start:end], np.array(weights[start:end]), among)
                start, size = end, 0
    yield from held.passed_on()


class _Held:
    """Counts of a task so far, under numbers of the symbols that hold for all its slices."""

    def __init__(self, analyzer: str, shortest: int, longest: int):
        self.analyzer, self.sizes = analyzer, range(shortest, longest + 1)
        self.bits = 63 // longest
        self.numbers: dict = {}
        self.counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, texts: list[str], weights: np.ndarray, among: set[str] | None) -> Iterator[Part]:
        ids, lengths, names = _symbols(texts, self.analyzer)
        bits = max(int(ids.max(initial=0)).bit_length(), 1)
        room = min(_HELD_SYMBOLS, 1 << self.bits)
        if self.numbers and len(self.numbers) + len(names) > room:
            yield from self.passed_on()
        alone = len(names) > room  # these symbols fit no common numbers
        if not alone:
            common = np.array([self.numbers.setdefault(x, len(self.numbers)) for x in names],
                              np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        for n in self.sizes:
            if bits * n > 63:  # too many different symbols to pack this many
                yield from _plain_counts(texts, weights, self.analyzer, n, among)
                continue
            chosen = None if among is None else _chosen(ids, names, n, bits, among)
            keys, tf, df = _sorted_counts(ids, owner, weights, n, bits, chosen)
            if alone:
                yield from _spelled(keys, tf, df, n, bits, names, self.analyzer)
                continue
            packed = np.zeros(len(keys), np.int64)
            for part in _parts(keys, n, bits):
                packed <<= self.bits
                packed |= common[part]
            order = packed.argsort()
            new = packed[order], tf[order], df[order]
            self.counts[n] = _merged(self.counts[n], new) if n in self.counts else new
            if len(self.counts[n][0]) > _HELD_TERMS:
                yield from _spelled(*self.counts.pop(n), n, self.bits, list(self.numbers),
                                    self.analyzer)

    def passed_on(self) -> Iterator[Part]:
        names = list(self.numbers)
        for n in list(self.counts):
            yield from _spelled(*self.counts.pop(n), n, self.bits, names, self.analyzer)
        self.numbers.clear()


def _sorted_counts(ids, owner, weights, n, bits, chosen):
    """Different n-grams as packed numbers in order, their counts and their texts' weights."""
    size = max(len(ids) - n + 1, 0)
    inside = owner[:size] == owner[n - 1:]
    if chosen is not None:
        inside &= chosen
    keys = _packed(ids, n, bits)[inside]
    docs = owner[:size][inside]
    del inside
    text_bits = int(owner[-1]).bit_length() if len(owner) else 0
    terms = None
    if bits * n + text_bits > 63:  # rank the n-grams, so that the text's number fits beside
        terms, keys = np.unique(keys, return_inverse=True)
    # One sort brings an n-gram's places together, and among them those of a text.
    keys <<= text_bits
    keys |= docs
    del docs
    keys.sort()
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    often = np.diff(starts, append=len(keys))
    keys = keys[starts]
    share = weights[keys & ((1 << text_bits) - 1)].astype(np.int64)
    keys >>= text_bits
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    if not len(firsts):
        return keys, often, share
    keys = keys[firsts]
    return (keys if terms is None else terms[keys], np.add.reduceat(often * share, firsts),
            np.add.reduceat(share, firsts))


def _packed(ids: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The n symbols from every place on as one number."""
    size = max(len(ids) - n + 1, 0)
    keys = ids[:size].copy()
    for k in range(1, n):
        keys <<= bits
        keys |= ids[k:size + k]
    return keys


def _parts(keys: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    return [(keys >> (bits * k)) & ((1 << bits) - 1) for k in range(n - 1, -1, -1)]


def _chosen(ids, names, n, bits, among):
    """Places whose n-gram holds two n-grams of the set, shorter by one."""
    place = {name: k for k, name in enumerate(names)}
    wanted = []
    for term in among:
        found = [place.get(word) for word in term.split(" ")]
        if None not in found:
            key = 0
            for k in found:
                key = key << bits | k
            wanted.append(key)
    hit = np.isin(_packed(ids, n - 1, bits), np.array(wanted, np.int64))
    return hit[:-1] & hit[1:]


def _merged(held, new):
    keys = np.concatenate([held[0], new[0]])
    order = keys.argsort(kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    if not len(firsts):
        return held
    return (keys[firsts], *[np.add.reduceat(np.concatenate([a, b])[order], firsts)
                            for a, b in zip(held[1:], new[1:])])


def _spelled(keys, tf, df, n, bits, names, analyzer) -> Iterator[Part]:
    codes = np.array(names, np.uint32) if analyzer == "char" else None
    for at in range(0, len(keys), _SPELL_ROWS):
        to = at + _SPELL_ROWS
        rows = np.stack(_parts(keys[at:to], n, bits), axis=1)
        if analyzer != "char":
            terms = [" ".join([names[i] for i in row]) for row in rows.tolist()]
        elif codes.all():
            terms = np.ascontiguousarray(codes[rows]).view(f"U{n}").ravel().tolist()
        else:  # NUL would end a string
            terms = ["".join(map(chr, row)) for row in codes[rows].tolist()]
        yield terms, tf[at:to], df[at:to]


def _symbols(texts, analyzer):
    """Texts as one run of small numbers, their lengths, and the numbers' symbols."""
    if analyzer == "char":
        folded = [_BLANK_RUN.sub(" ", t.lower()) for t in texts]
        codes = np.frombuffer("".join(folded).encode("utf-32-le"), np.uint32)
        used = np.flatnonzero(np.bincount(codes)) if len(codes) else np.zeros(0, np.int64)
        table = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
        table[used] = np.arange(len(used))
        return table[codes], np.array([len(t) for t in folded], np.int64), used.tolist()
    numbers: dict[str, int] = {}
    split = [_WORD.findall(t.lower()) for t in texts]
    ids = np.array([numbers.setdefault(w, len(numbers)) for words in split for w in words],
                   np.int64)
    return ids, np.array([len(words) for words in split], np.int64), list(numbers)


def _plain_counts(texts, weights, analyzer, n, among=None):
    tf, df = Counter(), Counter()
    for text, weight in zip(texts, weights.tolist()):
        for term, often in Counter(ngrams(text, analyzer, n, n)).items():
            if among is not None:
                words = term.split(" ")
                if not {" ".join(words[1:]), " ".join(words[:-1])} <= among:
                    continue
            tf[term] += often * weight
            df[term] += weight
    if tf:
        yield list(tf), np.array(list(tf.values())), np.array([df[t] for t in tf])
