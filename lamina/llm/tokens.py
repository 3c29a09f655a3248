"""Token counts by offset-mapped attribution.

Each whole text is encoded once with a byte-level vocabulary, so the tokens' byte lengths add up to their spans. The
spans are interval-joined to the text's sections, and every token goes to exactly one of them: by rule "majority" to
the section that holds most of its bytes (the earlier of equals), by "start" or "end" to the section of its first or
last byte. So the counts of all sections, with the rest outside of them, add up to the text's tokens.

Defined results: a null or empty text has no sections and so no row in count_sections, and 0 tokens in count_documents;
sections without a token have 0; repeated rows are counted each on its own; only the id and text columns are read. A
very long text is encoded whole, in the memory of its task, also if it is one run of white space.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import attach, kept

RULES = ("majority", "start", "end")
LONG_RUN = regex.compile(r"\s{5000}")


class ByteTokens:
    """Byte lengths of a text's tokens, by a file of ranks (base64 of the bytes, rank) and a split pattern."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]

    @classmethod
    def shared(cls, path: str, pattern: str) -> ByteTokens:
        return kept(("byte tokens", path, pattern), lambda: cls(path, pattern))

    def ids(self, text: str) -> list[int]:
        """The encoder's own splitting keeps a stack of a white-space run's length, so texts with very long runs are
        split here by the same pattern."""
        if not LONG_RUN.search(text):
            return self.encoding.encode_ordinary(text)
        single = functools.lru_cache(1 << 16)(self.encoding._encode_single_piece)
        return [k for m in self.pattern.finditer(text) for k in single(m[0].encode())]

    def ends(self, text: str) -> np.ndarray:
        """Byte offsets at which tokens end."""
        ids = self.ids(text)
        return np.cumsum(self.size[np.fromiter(ids, np.int64, len(ids))])


def lines(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of a text's lines, each with its line feed; they tile the text."""
    cuts = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if not len(cuts) or cuts[-1] < len(text):
        cuts = np.append(cuts, len(text))
    return np.concatenate([[0], cuts[:-1]]), cuts


def attribute(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, int]:
    """Tokens of each section, and those of none. Sections are disjoint and sorted; tokens tile the text. Both sides
    are sorted, so the join is two binary searches for all tokens at once."""
    n = len(starts)
    if not n or not len(token_ends):
        return np.zeros(n, np.int64), len(token_ends)
    token_starts = np.concatenate([[0], token_ends[:-1]])
    low = np.searchsorted(ends, token_starts, "right")  # the first section that ends after the token's start
    high = np.searchsorted(starts, token_ends, "left") - 1  # the last that starts before its end
    if rule == "start":
        owner = np.where((low < n) & (starts[np.minimum(low, n - 1)] <= token_starts), low, -1)
    elif rule == "end":
        owner = np.where((high >= 0) & (ends[high] >= token_ends), high, -1)
    elif rule == "majority":
        owner = np.where(low <= high, low, -1)
        for k in np.flatnonzero(low < high):
            held = np.minimum(ends[low[k] : high[k] + 1], token_ends[k]) - np.maximum(starts[low[k] : high[k] + 1], token_starts[k])
            owner[k] = low[k] + int(np.argmax(held))
    else:
        raise ValueError(f"the rule is one of {RULES}, not {rule!r}")
    return np.bincount(owner[owner >= 0], minlength=n), int((owner < 0).sum())


def count_sections(docs: DataFrame, vocabulary: str, pattern: str, rule: str = "majority", split: Callable = lines, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per section: id, section (from 0), start and end in code points, tokens of the section (n_tokens), of the whole
    text (doc_tokens) and of the text outside all sections (doc_rest)."""
    attach(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens.shared(vocabulary, pattern)
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                row, cols = [], [[] for _ in range(6)]
                for k, text in enumerate(b["text"].to_pylist()):
                    if not text:
                        continue
                    raw = text.encode()
                    starts, ends = split(raw)
                    token_ends = tokens.ends(text)
                    n, rest = attribute(token_ends, starts, ends, rule)
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                    row.append(np.full(len(n), k))
                    for col, x in zip(cols, (np.arange(len(n)), chars[starts], chars[ends], n, np.full(len(n), len(token_ends)), np.full(len(n), rest)), strict=True):
                        col.append(x)
                none = np.empty(0, np.int64)
                at = pa.array(np.concatenate([none, *row]).astype(np.int64))
                found = [pa.array(np.concatenate([none, *c]).astype(np.int64)) for c in cols]
                yield pa.RecordBatch.from_arrays([b["id"].take(at), *found], names=["id", "section", "start", "end", "n_tokens", "doc_tokens", "doc_rest"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, f"id {kind}, section long, start long, end long, n_tokens long, doc_tokens long, doc_rest long").withColumnRenamed("id", id_col)


def count_documents(docs: DataFrame, vocabulary: str, pattern: str, rule: str = "majority", split: Callable = lines, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_sections and section_tokens, the tokens of each section in order."""
    attach(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens.shared(vocabulary, pattern)
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                total, parts = [], []
                for text in b["text"].to_pylist():
                    raw = (text or "").encode()
                    token_ends = tokens.ends(text or "")
                    starts, ends = split(raw) if raw else (np.empty(0, np.int64),) * 2
                    total.append(len(token_ends))
                    parts.append(attribute(token_ends, starts, ends, rule)[0])
                sections = pa.array(parts, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(total, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), sections], names=["id", "n_tokens", "n_sections", "section_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, f"id {kind}, n_tokens long, n_sections long, section_tokens array<long>").withColumnRenamed("id", id_col)
