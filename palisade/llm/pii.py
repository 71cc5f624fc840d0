"""Personal data (operator 7): fixed patterns, and a character BiLSTM-CRF that adds spans.

The fixed patterns label the text they match. The tagger is trained in numpy on a bounded sample
of windows labelled that way, some of them with the marks removed that the patterns rely on (a
plus sign, an at sign, dots) and with other words and numbers in their place, so that it learns
what such data looks like in its surroundings. All kinds hold a digit, an at sign or the word that
spells it, so the tagger reads the stretches around those: windows overlap, their tag scores are
merged where the windows are surest, and one decoding runs over each whole stretch. A span that
cuts a word is widened to it; an address without a plain at sign must read as a spelled one.

Defined results: a null text is the empty text and has no spans; repeated rows give a row each;
an empty table, or one without a labelled span, trains nothing and adds nothing. Other columns
are left out by ``scanned`` and kept by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.bpe import batches
from palisade.llm.char_crf import PAD, Tagger, classes_of
from palisade.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone")

#: Characters read on each side of a digit, an at sign or a spelled one, at least.
REACH = 24
#: Length of a window and of the part that two neighbours share.
WINDOW, SHARED = 64, 24

#: Bound of the training sample: windows per kind, and windows without a span.
FIT_PER_KIND, FIT_OTHERS = 250, 500
EPOCHS = 8

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits, which makes the search linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile("[0-9@]+")
#: At signs and dots that are spelled out, in brackets or not.
MARK = re.compile(r"(?<![^\W\d_])(?:at|dot)(?![^\W\d_])|\(a\)", re.I)
#: Most characters of the parts of an address before and after the at sign (RFC 5321).
LOCAL_MOST, DOMAIN_MOST = 64, 255
_AFTER = re.compile(rf"[\s)\]}}>]{{0,4}}\S{{0,{DOMAIN_MOST}}}")
_AT, _DOT = (rf"(?:\s{{0,2}}[(\[{{<]?\s?\b{w}\b\s?[)\]}}>]?\s{{0,2}}|_{w}_{more})"
             for w, more in (("at", r"|\(a\)|\s{1,2}@\s{1,2}"), ("dot", "")))
#: An address whose at sign is spelled out, with dots of either kind.
SPELLED = re.compile(rf"[\w%+-]{{1,{LOCAL_MOST}}}(?:(?:\.|{_DOT})[\w%+-]{{1,{LOCAL_MOST}}}){{0,9}}{_AT}"
                     rf"[\w-]{{1,63}}(?:(?:\.|{_DOT})[\w-]{{1,63}})+", re.I)
#: How disguised training windows spell an at sign and a domain's dots.
AT_FORMS = (" (at) ", " at ", "(at)", " [at] ", " AT ", "_at_", "(a)", " @ ")
DOT_FORMS = (".", ".", " dot ", "(dot)", ".")
NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind as listed."""
    if not TRIGGER.search(text):
        return []
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            found.append((start, last, "email"))
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255
               for x in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text within reach of a digit or at sign, or of one that is spelled out.

    Around a spelled one the words on both sides are read whole.
    """
    near = [(m.start() - REACH, m.end() + REACH) for m in TRIGGER.finditer(text)]
    for m in MARK.finditer(text):
        head = text[max(0, m.start() - LOCAL_MOST - 4):m.start()]
        core = head.rstrip(" \t\r\n([{<")
        word = core.split()[-1] if core.strip() else ""
        near.append((m.start() - max(REACH, len(head) - len(core) + len(word)),
                     max(m.end() + REACH, _AFTER.match(text, m.end()).end())))
    out: list[list[int]] = []
    for start, end in sorted(near):
        start, end = max(0, start), min(len(text), end)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def windows(start: int, end: int) -> list[int]:
    """Starts of overlapping windows over a stretch; the last one may end after it."""
    step = WINDOW - SHARED
    return list(range(start, max(start + 1, end - SHARED), step))


def tags_of(text: str, start: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """Tags of the window at ``start``; the first of overlapping spans counts."""
    tags, free = np.zeros(WINDOW, np.int64), 0
    for a, b, kind in spans:
        if a >= free and b > start and a < start + WINDOW:
            tag = 1 + 2 * KINDS.index(kind)
            tags[max(a, start) - start:min(b, start + WINDOW) - start] = tag + 1
            if a >= start:
                tags[a - start] = tag
            else:
                tags[0] = tag
            free = b
    return tags


def labelled_windows(docs: DataFrame) -> DataFrame:
    """The bounded training sample: ``window`` and its tags as a string of digits.

    Per kind the windows with the smallest hashes; Spark keeps only that many per task before
    it moves them.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                spans = base_spans(text)
                for a, b in stretches(text):
                    for start in windows(a, b):
                        tags = tags_of(text, start, spans)
                        kinds = {KINDS[(t - 1) // 2] for t in set(tags.tolist()) if t}
                        for kind in sorted(kinds) or [""]:
                            rows.append((kind, text[start:min(b, start + WINDOW)],
                                         "".join(map(str, tags))))
            yield pd.DataFrame(rows, columns=["kind", "window", "tags"])

    found = docs.select(whole_text().alias("text")).mapInPandas(
        run, "kind string, window string, tags string")
    order = Window.partitionBy("kind").orderBy(F.xxhash64("window", F.lit(3)), "window")
    ranked = found.withColumn("place", F.row_number().over(order))
    most = max(FIT_PER_KIND, FIT_OTHERS)
    return ranked.where(F.col("place") <= most).where(
        F.col("place") <= F.when(F.col("kind") == "", FIT_OTHERS).otherwise(FIT_PER_KIND))


def disguised(window: str, tags: np.ndarray, form: int = 0) -> tuple[str, np.ndarray]:
    """The window with the mark of its kind removed: a phone's plus, an e-mail's at sign and,
    in some forms, its domain's dots."""
    chars, kept, domain = [], [], False
    sign, dot = AT_FORMS[form % len(AT_FORMS)], DOT_FORMS[form % len(DOT_FORMS)]
    for c, t in zip(window, tags):
        kind = KINDS[(t - 1) // 2] if t else ""
        if kind == "phone" and c == "+":
            continue
        domain = kind == "email" and (domain and t % 2 == 0 or c == "@")
        if domain and c in "@.":
            spelled = sign if c == "@" else dot
            chars += spelled
            kept += [t + (t % 2)] * len(spelled)
        else:
            chars.append(c)
            kept.append(t)
    chars, kept = chars[:WINDOW], kept[:WINDOW]
    for k, t in enumerate(kept):  # a span that lost its first character starts at its next
        if t and t % 2 == 0 and (k == 0 or (kept[k - 1] + 1) // 2 != t // 2):
            kept[k] = t - 1
    return "".join(chars), np.array(kept + [0] * (WINDOW - len(kept)), np.int64)


#: Endings of domains, and ways to write a number without a country code, in varied windows.
ENDINGS = ("com", "org", "net", "edu", "de", "fr", "io", "co.uk", "info")
NUMBERS = ("{0} {1} {2}", "{0}-{1}-{2}", "0{0} {1}{2}", "00{0} {1} {2}", "({0}) {1} {2}")


def varied(window: str, tags: np.ndarray, form: int = 0) -> tuple[str, np.ndarray]:
    """The window with other spans of the same kind: an e-mail made of words from around it, a
    phone with its digits in other groups."""
    words = [w.lower() for w in re.findall("[A-Za-z]{3,9}", "".join(
        c if not t else " " for c, t in zip(window, tags)))] or ["name", "place"]
    chars, kept, k = [], [], 0
    while k < len(window):
        end = k + 1
        if tags[k] % 2:
            while end < len(window) and tags[end] == tags[k] + 1:
                end += 1
        own, kind = window[k:end], KINDS[(tags[k] - 1) // 2] if tags[k] % 2 else ""
        if kind == "email":
            own = words[form % len(words)] + (f".{words[form // 2 % len(words)]}" if form % 3 == 0 else "")
            own += f"@{words[form // 3 % len(words)]}.{ENDINGS[form % len(ENDINGS)]}"
        elif kind == "phone":
            digits = NOT_DIGIT.sub("", own)[-10:]
            own = NUMBERS[form % len(NUMBERS)].format(digits[:3], digits[3:6], digits[6:])
        chars += own
        kept += [tags[k], *[tags[k] + tags[k] % 2] * (len(own) - 1)] if end > k + 1 or kind else [tags[k]]
        k = end
    kept = [int(t) for t in kept[:WINDOW]]
    return "".join(chars[:WINDOW]), np.array(kept + [0] * (WINDOW - len(kept)), np.int64)


def fitted(docs: DataFrame) -> Tagger | None:
    """A tagger trained on the driver from the bounded sample; None without a labelled span."""
    rows = sorted((r["kind"], r["window"], r["tags"]) for r in labelled_windows(docs).collect())
    if not any(kind for kind, _, _ in rows):
        return None
    x, y, counts = [], [], Counter(kind for kind, _, _ in rows)
    for k, (kind, window, digits) in enumerate(rows):
        tags = np.array(list(map(int, digits)))
        forms = [(window, tags)]
        if kind == "email" or kind == "phone" and k % 2:
            forms.append(disguised(window, tags, k))
        if kind in ("email", "phone"):
            # As many variants in all, however few windows the corpus gives.
            for n in range(k, k + 7 * max(1, FIT_PER_KIND // counts[kind]), 7):
                other = varied(window, tags, n)
                forms.append(disguised(*other, n // 2) if kind == "email" else other)
        for text, own in forms:
            ids = np.full(WINDOW, PAD)
            found = classes_of(text)
            ids[:len(found)] = found
            x.append(ids)
            y.append(own)
    tagger = Tagger(len(KINDS))
    tagger.fit(np.array(x), np.array(y), EPOCHS)
    return tagger


#: How sure a window is of a place: its distance to the window's nearer end.
_TRUST = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32) + 1
#: Windows, and cells of decoding, that are worked on together.
MOST_WINDOWS, MOST_CELLS = 4096, 1 << 20


def tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans that the tagger finds in every text, not yet set against the base ones."""
    parts = [(k, a, b) for k, text in enumerate(texts) for a, b in stretches(text)]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    parts.sort(key=lambda p: p[2] - p[1])
    at = 0
    while at < len(parts):
        to = at + 1
        width = parts[at][2] - parts[at][1]
        while to < len(parts) and (parts[to][2] - parts[to][1]) * (to - at + 1) <= MOST_CELLS \
                and parts[to][2] - parts[to][1] <= max(2 * width, WINDOW):
            to += 1
        for (k, a, _), tags in zip(parts[at:to], _decoded(tagger, texts, parts[at:to])):
            out[k] += _spans(texts[k], a, tags)
        at = to
    return [sorted(s) for s in out]


def _decoded(tagger: Tagger, texts: list[str], parts: list[tuple[int, int, int]]) -> list:
    widest = max(b - a for _, a, b in parts)
    scores = np.zeros((len(parts), widest + WINDOW, tagger.n_tags), np.float32)
    weight = np.zeros((len(parts), widest + WINDOW, 1), np.float32)
    todo = [(row, start - a) for row, (_, a, b) in enumerate(parts) for start in windows(a, b)]
    codes = np.full((len(parts), widest + WINDOW), PAD)
    for row, (k, a, b) in enumerate(parts):
        codes[row, :b - a] = classes_of(texts[k][a:b])
    for at in range(0, len(todo), MOST_WINDOWS):
        some = np.array(todo[at:at + MOST_WINDOWS])
        place = some[:, 1:] + np.arange(WINDOW)
        found = tagger.emissions(codes[some[:, :1], place])
        np.add.at(scores, (some[:, :1], place), found * _TRUST[:, None])
        np.add.at(weight, (some[:, :1], place, 0), _TRUST)
    scores = scores[:, :widest] / np.maximum(weight[:, :widest], 1e-6)
    scores[codes[:, :widest] == PAD] = np.eye(1, tagger.n_tags, dtype=np.float32) * 50
    tags = tagger.decode(scores)
    return [row[:b - a].tolist() for row, (_, a, b) in zip(tags, parts)]


#: Fewest digits of what the tagger may call a span of the kind.
FEWEST_DIGITS = {"email": 0, "ip": 4, "card": 12, "phone": 9}


#: Longest piece by which a span is widened to whole words.
WIDEN_MOST = 64


def whole_words(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """The span with the rest of the words that it cuts; of an address also its further labels."""
    def inner(k: int) -> bool:
        c = text[k]
        return c.isalnum() or kind == "email" and c in ".-_+%" and 0 < k < len(text) - 1 and (
            text[k - 1].isalnum() and text[k + 1].isalnum())

    low, high = max(0, a - WIDEN_MOST), min(len(text), b + WIDEN_MOST)
    while a > low and text[a].isalnum() and inner(a - 1):
        a -= 1
    while b < high and (text[b - 1].isalnum() or text[b - 1] in ".-_+%") and inner(b):
        b += 1
    return a, b


def _spans(text: str, start: int, tags: list[int]) -> list[tuple[int, int, str]]:
    found, k, n = [], 0, len(tags)
    while k < n:
        if not tags[k]:
            k += 1
            continue
        kind, end = (tags[k] - 1) // 2, k + 1
        while end < n and tags[end] == 2 + 2 * kind:
            end += 1
        a, b, name = start + k, start + end, KINDS[kind]
        k = end
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        a, b = whole_words(text, a, b, name)
        k = max(k, b - start)
        own = text[a:b]
        digits = sum("0" <= c <= "9" for c in own)
        if name == "ip" and any(int(p) > 255 for p in own.split(".") if 0 < len(p) < 9 and p.isdecimal()):
            continue
        if digits < FEWEST_DIGITS[name] or name == "ip" and own.count(".") < 3:
            continue
        if name == "email" and ("@" not in own or " " in own):
            # The whole address counts when the tagger has found a part of it.
            low, high = max(start, a - LOCAL_MOST - 8), min(start + n, b + DOMAIN_MOST)
            whole = next((m.span() for m in SPELLED.finditer(text, low, high)
                          if m.start() < b and a < m.end()), None)
            if not whole:
                continue
            a, b = whole
            k = max(k, b - start)
            while found and found[-1][0] >= a:
                found.pop()
        elif name == "email" and "." not in own:
            continue
        if name in ("card", "phone") and sum(c.isalpha() for c in own):
            continue
        found.append((a, b, name))
    return found


def all_spans(tagger: Tagger | None, texts: list[str]):
    """(base spans, all spans) of every text; added spans overlap no base span."""
    base = [base_spans(t) for t in texts]
    more = tagged(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for own, found in zip(base, more):
        spans, k, reach = list(own), 0, 0
        for a, b, kind in found:
            while k < len(own) and own[k][0] < b:
                reach = max(reach, own[k][1])
                k += 1
            if reach <= a:
                spans.append((a, b, kind))
        out.append((own, sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """Spans of every document: counts and digest of the base ones, and the list of all."""
    tagger = fitted(docs)
    fields = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    @F.pandas_udf(", ".join(f"{f} {'long' if f[0] == 'n' else 'string'}" for f in fields))
    def found(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            texts, rows = column.tolist(), []
            for part in batches(texts):
                for base, spans in all_spans(tagger, texts[part]):
                    kinds = [s[2] for s in base]
                    rows.append((*map(kinds.count, KINDS),
                                 hashlib.sha256(listed(base).encode()).hexdigest(),
                                 listed(spans), len(spans) - len(base)))
            yield pd.DataFrame(rows, columns=fields)

    return docs.select("doc_id", found(whole_text()).alias("found")).select("doc_id", "found.*")


def cleaned(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, last = [], 0
    for a, b, kind in spans:
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, with personal data in ``text`` replaced by its kind.

    A null text stays null; ``n_chars`` follows the new text where the column is there.
    """
    tagger = fitted(docs)

    @F.pandas_udf("string")
    def clean(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            texts, new = column.tolist(), []
            for part in batches(texts):
                new += [cleaned(t, spans) for t, (_, spans) in zip(
                    texts[part], all_spans(tagger, texts[part]))]
            yield pd.Series(new, dtype=object)

    out = docs.withColumn("text", F.when(F.col("text").isNotNull(), clean(whole_text())))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
