"""Byte-level BPE encoding of a whole text column with a public vocabulary.

A text is cut into pieces by the vocabulary's public pattern.  Each piece is a
doubly linked list of byte symbols; a priority queue holds the merge rank of
every adjacent pair, popped entries whose symbols have changed since they were
pushed are stale and skipped.  Decoding concatenates the vocabulary strings.
Pieces repeat far more often than texts do, so each worker keeps the ids of
the pieces it has met; the memory of that cache is bounded by a parameter and
the result never depends on it.

Defined results: an empty and a NULL text give an empty list; blank text is
text; every text is encoded whole, whatever its length.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.runtime import workers_can_import

#: where the public vocabulary files are; a parameter of every function here
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: fixed value: the public split pattern of byte_bpe_50k
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: pieces that a worker remembers, and the longest piece (characters) it keeps
CACHE_PIECES, CACHE_LENGTH = 200_000, 40


class ByteBpe:
    """Encoder and decoder over one rank file (base64 token, rank per line)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.strings = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.bytes = [bytes([i]) for i in range(256)]
        self._cache: dict[str, tuple[int, ...]] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        sym: list[bytes | None] = [self.bytes[b] for b in data]
        n = len(sym)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            r = ranks.get(sym[i] + sym[i + 1])
            if r is not None:
                queue.append((r, i, sym[i], sym[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if sym[i] is not left or j >= n or sym[j] is not right:
                continue  # stale
            merged = left + right
            sym[i], sym[j] = merged, None
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                r = ranks.get(merged + sym[k])
                if r is not None:
                    heapq.heappush(queue, (r, i, merged, sym[k]))
            h = before[i]
            if h >= 0:
                r = ranks.get(sym[h] + merged)
                if r is not None:
                    heapq.heappush(queue, (r, h, sym[h], merged))
        return [ranks[s] for s in sym if s is not None]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, out = self._cache, []
        for p in self.split(text):
            ids = cache.get(p)
            if ids is None:
                ids = tuple(self.piece(p.encode("utf-8", "surrogatepass")))
                if len(p) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[p] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "surrogatepass")


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_column(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), into: str = "ids",
    vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS,
) -> DataFrame:
    """The kept columns and the ids of ``text``; no shuffle, one Arrow pass."""
    workers_can_import(df.sparkSession)
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    # named by position inside, so that clashing names cannot meet
    plain = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    names = [*keep, into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            flat, ends = [], [0]
            for t in texts.to_pylist():
                flat += bpe.encode(t)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], ids], names=names)

    schema = df.select(*keep).withColumn(into, F.lit(None).cast("array<int>")).schema
    return plain.mapInArrow(run, schema)
