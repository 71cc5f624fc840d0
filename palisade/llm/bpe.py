"""BPE encoding and decoding with a word-end vocabulary (operator 6): speculate and verify.

Greedy longest match proposes the tokens of a word. A proposal is the true encoding exactly when
every adjacent pair of tokens would also come out of merging the two alone; that test runs over
all pairs of a batch at once, by walking the two tokens' merge trees. Only words with a pair that
fails are merged exactly. Words repeat, so each worker keeps the ids of words it has seen; the
memory for that is bounded and decides nothing but speed.

Defined results: a null text is the empty text; empty texts have no ids; repeated rows give a row
each; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import whole_text

#: Fixed values of the vocabulary's normaliser and pre-tokenizer.
SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
         "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
SPACES = re.compile(f"[{SPACE}]+")
#: str.split() also cuts at these; they are no white space here.
NOT_SPACE = re.compile("[\x1c-\x1f]")

#: Words that a worker remembers, and characters of the longest word among them.
MEMORY_WORDS = 300_000
MEMORY_CHARS = 64

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for letters from code point 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


NO_RANK = 1 << 60


class PairTable:
    """Rank and result of a pair's merge, looked up for many pairs at once.

    A hash table with linear probing in three arrays.
    """

    def __init__(self, keys: np.ndarray, rank: np.ndarray, whole: np.ndarray):
        self.bits = int(len(keys)).bit_length() + 2
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank, self.whole = np.full(size, NO_RANK), np.zeros(size, np.int64)
        for slot, k, r, w in zip(self.slots(keys).tolist(), keys.tolist(), rank, whole):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % size
            self.keys[slot], self.rank[slot], self.whole[slot] = k, r, w

    def slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.slots(keys)
        held = self.keys[at]
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.keys)
            held = self.keys[at[todo]]
            todo = todo[(held != keys[todo]) & (held >= 0)]
        found = self.keys[at] == keys
        return np.where(found, self.rank[at], NO_RANK), self.whole[at]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        size = max(self.strings) + 1
        self.left, self.right = np.arange(size), np.arange(size)
        self.made = np.full(size, -1)
        for k, pair in enumerate(model["merges"]):
            a, b = (self.ids[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = self.ids[self.strings[a] + self.strings[b]]
            self.rank.setdefault((a, b), (k, whole))
            if self.made[whole] < 0:
                self.left[whole], self.right[whole], self.made[whole] = a, b, k
        self.size = size
        self.merges = PairTable(
            np.array([a * size + b for a, b in self.rank], np.int64),
            np.array([k for k, _ in self.rank.values()]),
            np.array([whole for _, whole in self.rank.values()]))
        self.letters = byte_letters()
        self.longest = max(map(len, self.ids))
        # A proposal may only hold tokens that merging can make.
        tokens = sorted(self.ids, key=self.ids.get)
        makeable = [(s, self.ids[s]) for s, made in zip(tokens, self.merge_words(
            list(map(self.spelt, tokens)))) if made == [self.ids[s]]]
        end = len(self.end)
        self.inner = {s: i for s, i in makeable if not s.endswith(self.end)}
        self.last = {s[:-end]: i for s, i in makeable if s.endswith(self.end)}
        cut = re.escape
        self.cutter = re.compile("(" + "|".join(map(cut, self.special)) + ")") if self.special else None
        self.proposed = self.merged = 0
        self.forget()

    def forget(self) -> None:
        """Starts the memory anew; special tokens are never cut."""
        self.seen: dict[str, tuple[bytes, str]] = {
            s: (np.array([i], "<u4").tobytes(), s) for s, i in self.special.items()}

    def spelt(self, token: str) -> list[str]:
        """The smallest tokens of a token's string."""
        if token.endswith(self.end):
            body = token[:-len(self.end)]
            return [*body[:-1], body[-1] + self.end] if body else [token]
        return list(token)

    def greedy(self, word: str) -> list[int]:
        """Longest match from the left over the letters of a word; empty where nothing matches."""
        found, at, stop, inner = [], 0, len(word), self.inner
        while at < stop:
            if stop - at <= self.longest and (token := self.last.get(word[at:])) is not None:
                found.append(token)
                return found
            for to in range(min(stop - 1, at + self.longest), at, -1):
                if (token := inner.get(word[at:to])) is not None:
                    found.append(token)
                    at = to
                    break
            else:
                return []
        return found

    def merge_words(self, words: list[list[str]]) -> list[list[int]]:
        """Exact merging of many words at once, each given as its smallest tokens.

        A round merges the pair of lowest rank of every word, wherever the word has it, from the
        left; a merge never makes a pair of lower rank than its own.
        """
        lengths = np.array(list(map(len, words)), np.int64)
        ids = np.fromiter((self.ids[s] for w in words for s in w), np.int64, lengths.sum())
        owner = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_owner = [], []
        while len(ids):
            rank, whole = self.merges.find(ids[:-1] * self.size + ids[1:])
            rank[owner[:-1] != owner[1:]] = NO_RANK
            rank = np.append(rank, NO_RANK)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(first, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            ready = best == NO_RANK
            done_ids.append(ids[ready])
            done_owner.append(owner[ready])
            hit = (rank == best) & ~ready
            # Overlapping equal pairs: every second one of a run, from its first.
            run = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
            place = np.arange(len(ids))
            since = np.zeros(len(ids), np.int64)
            since[run] = np.diff(np.append(0, run))
            hit &= (place - np.cumsum(since)) % 2 == 0
            ids[hit] = np.append(whole, 0)[hit]
            keep = ~ready & ~np.append(False, hit[:-1])
            ids, owner = ids[keep], owner[keep]
        ids, owner = np.concatenate([*done_ids, ids]), np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(words)))
        flat, ends = ids[order].tolist(), ends.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two adjacent tokens stay as they are when their letters are merged.

        Merging goes wrong exactly if, at some moment, a merge across the border ranks before
        the merge that the tokens themselves need next on their side of it. The border's two
        neighbours are followed backwards from the whole tokens: the one that was made later is
        cut into its parts, and a merge over the border may not come earlier than that one.
        Equal ranks go to the left pair first.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 59)  # rank of the merge that ends the border pair
        tie = np.zeros(len(a), bool)  # whether that merge loses to an equal one over the border
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across, _ = self.merges.find(x * self.size + y)
            bad = (across < limit[live]) | ((across == limit[live]) & tie[live])
            good[live[bad]] = False
            made_x, made_y = self.made[x], self.made[y]
            done = bad | ((made_x < 0) & (made_y < 0))
            live, x, y, made_x, made_y = (v[~done] for v in (live, x, y, made_x, made_y))
            # Of equal ranks the left merge came first, so the right one is undone first.
            undo_left = made_x > made_y
            limit[live] = np.where(undo_left, made_x, made_y)
            tie[live] = ~undo_left
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return good

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Ids of words (strings of byte letters), and how many needed exact merging."""
        coded = list(map(self.greedy, words))
        lengths = np.array(list(map(len, coded)), np.int64)
        flat = np.fromiter((t for p in coded for t in p), np.int64, lengths.sum())
        failed = lengths == 0
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        codes, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        good = self.compatible(codes // self.size, codes % self.size)
        failed[owner[inside[~good[back]]]] = True
        again = np.flatnonzero(failed).tolist()
        exact = self.merge_words([[*words[k][:-1], words[k][-1] + self.end] for k in again])
        for k, ids in zip(again, exact):
            coded[k] = ids
        return coded, len(again)

    def learn(self, chunks: list[str]) -> dict[str, tuple[bytes, str]]:
        """Id bytes and token strings of chunks without white space."""
        cut = [[c] if c.isalpha() else PIECES.findall(c) for c in chunks]
        pieces = list({p for own in cut for p in own})
        letters = self.letters
        coded, merged = self.encode_words([p if p.isascii() and p.isprintable() else "".join(
            [letters[x] for x in p.encode("utf-8", "replace")]) for p in pieces])
        self.proposed += len(pieces)
        self.merged += merged
        strings = self.strings
        made = {p: (np.array(t, "<u4").tobytes(), " ".join([strings[i] for i in t]))
                for p, t in zip(pieces, coded)}
        return {c: made[own[0]] if len(own) == 1 else (
            b"".join([made[p][0] for p in own]), " ".join([made[p][1] for p in own]))
            for c, own in zip(chunks, cut)}

    def normal(self, text: str) -> str:
        """Composed form in lower case; each letter by itself, so a final sigma is no other."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str]:
        """Runs without white space; special tokens as chunks of their own."""
        if self.cutter and "<|" in text:
            found = []
            for k, part in enumerate(self.cutter.split(text)):
                found += [part] if k % 2 else self.chunks_of(part)
            return found
        return self.chunks_of(text)

    def chunks_of(self, text: str) -> list[str]:
        text = self.normal(text)
        if NOT_SPACE.search(text):
            return [c for c in SPACES.split(text) if c]
        return text.split()

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as bytes (little-endian, 32 bits) and its decoded text."""
        cut = [self.chunks(t) for t in texts]
        known = self.seen
        new = list({c for own in cut for c in own}.difference(known))
        known.update(self.learn(new))
        out = []
        for own in cut:
            got = [known[c] for c in own]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])))
        for c in new:
            if len(c) > MEMORY_CHARS:
                del known[c]
        if len(known) > MEMORY_WORDS:
            self.forget()
        return out


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The vocabulary of a worker process, read once."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


#: Characters of the texts that are worked on together.
BATCH_CHARS = 4_000_000


def batches(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[slice]:
    """Consecutive slices of bounded size; a longer text is a slice of its own."""
    start, total = 0, 0
    for k, text in enumerate(texts):
        if k > start and total + len(text) > chars:
            yield slice(start, k)
            start, total = k, 0
        total += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Digests of ids and decoded text per document."""
    @F.pandas_udf(SCHEMA)
    def digests(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for column in columns:
            texts, rows = column.tolist(), []
            for part in batches(texts):
                rows += [(len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                          hashlib.sha256(text.encode()).hexdigest())
                         for ids, text in bpe.encode_batch(texts[part])]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests(whole_text()).alias("found")).select("doc_id", "found.*")


def decode(ids: bytes, path: str) -> str:
    """The text of ids as the vocabulary has it: token strings joined by blanks."""
    strings = loaded(path).strings
    return " ".join(strings[i] for i in np.frombuffer(ids, "<u4").tolist())
