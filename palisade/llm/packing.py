"""Packing by power-of-two decomposition (operator 9).

A document's ids, with an end id, are cut into pieces whose lengths are powers of two: as many
whole sequences as fit, then the binary digits of the rest. A piece is a sequence of its own, so
no sequence crosses documents and none is padded; pieces of equal length form a bucket.

Defined results: a null text is the empty text, which is one piece of the end id; repeated rows
are packed one by one; an empty table gives no piece; other columns are left out. Sequence ids
follow the partitions of the input, so they are the same when a task runs again.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm.bpe import MEMORY_CHARS, MEMORY_WORDS, batches
from palisade.llm.common import whole_text

MAX_TOKENS = 1024
END_ID = 0

#: Blanks beside other white space: there a blank is not simply the start of the next word.
UNSAFE = re.compile(r" \s|\s ")


class ByteBpe:
    """Ids of a byte-level vocabulary, as the tokenizers library makes them.

    No token of the pre-tokenizer crosses a lone blank between two words, so texts are cut there
    and runs that a worker has met before are looked up. Texts with a special token, with blanks
    beside other white space or with blanks at an end go to the library whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.runs = tiktoken.Encoding("runs", pat_str=pattern, mergeable_ranks=ranks,
                                      special_tokens={})
        self.seen: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if (any(s in text for s in self.special) or text[:1] == " " or text[-1:] == " "
                or UNSAFE.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text:
            return b""
        first, *rest = text.split(" ")
        seen, out = self.seen, [self.run(first)]
        for word in rest:
            ids = seen.get(word)
            if ids is None:
                ids = self.run(" " + word)
                if len(word) <= MEMORY_CHARS:
                    if len(seen) >= MEMORY_WORDS:
                        seen.clear()
                    seen[word] = ids
            out.append(ids)
        return b"".join(out)

    def run(self, text: str) -> bytes:
        return np.array(self.runs.encode_ordinary(text), "<u4").tobytes()


_LOADED: dict[tuple, ByteBpe] = {}


def loaded(*spec: str) -> ByteBpe:
    if spec not in _LOADED:
        _LOADED[spec] = ByteBpe(*spec)
    return _LOADED[spec]


def cuts(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Lengths of the pieces of ``n`` tokens; ``most`` is a power of two."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


SCHEMA = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, spec: tuple[str, str, str], most: int = MAX_TOKENS,
           with_ids: bool = False) -> DataFrame:
    """Every piece of every document; with ``with_ids`` also its ids as bytes."""
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    end = np.array([END_ID], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(*spec)
        for frame in frames:
            texts, names = frame["text"].tolist(), frame["doc_id"].tolist()
            for part in batches(texts):
                rows = []
                for name, text in zip(names[part], texts[part]):
                    ids = bpe.encode(text) + end
                    start, total = 0, len(ids) // 4
                    for n in cuts(total, most):
                        own = ids[4 * start:4 * (start + n)]
                        rows.append((name, start, n, zlib.crc32(own), total,
                                     *([own] if with_ids else [])))
                        start += n
                columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                           *(["ids"] if with_ids else [])]
                yield pd.DataFrame(rows, columns=columns)

    # Ids travel as text: pandas would turn a column of numbers with nulls into floats.
    found = docs.select(F.col("doc_id").cast("string"), whole_text().alias("text")).mapInPandas(
        run, SCHEMA + (", ids binary" if with_ids else ""))
    return found.select(
        F.col("doc_id").cast("long"), *[c for c in found.columns if c not in ("doc_id", "ids")],
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"), *(["ids"] if with_ids else []))


def write_sequences(docs: DataFrame, spec: tuple[str, str, str], path: str,
                    most: int = MAX_TOKENS) -> None:
    """Writes the sequences with their ids, a folder per bucket of equal lengths."""
    pieces(docs, spec, most, with_ids=True).write.partitionBy("bucket").parquet(path)
