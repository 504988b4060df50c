"""Encoding of the whole corpus with a public tokenizer (problem 8).

Method. Each text is cut by the tokenizer's pattern; the bytes of each piece form a doubly linked list of symbols. A
priority queue holds the ranks of possible merges; an entry that no longer fits the list is stale and skipped when it
comes up. A piece of length n costs O(n log n), however long. Short pieces recur, so their ids are kept in a bounded
cache per Python worker. Decoding concatenates the vocabulary's byte strings.

The vocabulary file's path is a parameter; the file is read on each worker and is not part of this repository.

Defined results. A null, empty or whitespace-free-empty text has an empty list. No special tokens are added, and their
strings in a text are ordinary text. Every other text comes back whole from its ids. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the pattern that cuts text before the merges of the public byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED, CACHED_BYTES = 1 << 18, 48


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a rank file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    """A byte-level BPE over a rank file."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.strings = {v: k for k, v in self.ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        symbol = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, width = heapq.heappop(queue)
            left = symbol[i]
            j = after[i]
            if not left or j >= n or len(left) + len(symbol[j]) != width or ranks.get(left + symbol[j]) != rank:
                continue  # stale: one of its symbols has been merged
            merged = symbol[i] = left + symbol[j]
            symbol[j] = b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(merged + symbol[k])) is not None:
                    heapq.heappush(queue, (r, i, len(merged) + len(symbol[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(symbol[h] + merged)) is not None:
                heapq.heappush(queue, (r, h, len(symbol[h]) + len(merged)))
        return [ranks[s] for s in symbol if s]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.cut(text):
            ids = cache.get(piece)
            if ids is None:
                ids = tuple(self.piece(piece.encode("utf-8", "replace")))
                if len(piece) <= CACHED_BYTES:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The encoder of a rank file, once per process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            lists = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def counted(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``tokens``, the number of ids of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n = pa.array([len(bpe.encode(t)) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, "tokens"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{kinds}, tokens long")


def decoded(rows: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of (key, ids) rows; a null list gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = pa.array([None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[key, "text"])

    return rows.select(key, "ids").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")
