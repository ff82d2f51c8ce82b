"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are a
vocabulary entry as a whole; every other pre-token is merged by a heap of adjacent byte
pairs over a doubly linked list. A bounded memo per worker keeps resolved pre-tokens.

Defined results: a null or empty text gives an empty array; every doc_id keeps its row,
repeated rows included; texts are encoded whole, whatever their length; strings that look
like special tokens are ordinary text; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 400_000
FLUSH_IDS = 2_000_000

_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: The same pattern over the characters that UNUSUAL leaves, for the faster engine.
_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_UNUSUAL = re.compile("[^\t-\r\x20-\x7e\x80-ʯ‐-‧‰-⁞₠-₿]")


_ALL, _STEP, _M1, _M2 = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class PerfectHash:
    """Hash-and-displace minimal perfect hash: n keys onto n slots.

    Each displacement mixes a key's hash anew (a bijection of 64 bits), so that no key
    is confined to a cycle of slots, in which the search for a free place could not end.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        assert len(np.unique(h)) == n, "keys must be different"
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        start = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        free, self.slot = np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64)
        late = []
        for b in np.argsort(-(start[1:] - start[:-1]), kind="stable"):
            own = order[start[b] : start[b + 1]]
            if len(own) < 2:
                late += [(b, own[0])] if len(own) else []
                continue
            for base in itertools.count(0, 256):
                d = np.arange(base, base + 256, dtype=np.uint64)
                x = h[own][:, None] + d[None, :] * np.uint64(_STEP)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
                at = ((x ^ (x >> np.uint64(31))) % np.uint64(n)).astype(np.int64)
                s = np.sort(at, axis=0)
                good = free[at].all(axis=0) & (s[1:] != s[:-1]).all(axis=0)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b] = base + k
                    self.slot[own] = at[:, k]
                    free[at[:, k]] = False
                    break
        for (b, i), at in zip(late, np.flatnonzero(free)):
            self.shift[b], self.slot[i] = -1 - at, at
        self.shift = self.shift.tolist()

    def find(self, key: bytes) -> int:
        """The slot of a key; for a string that is no key, some slot."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        if d < 0:
            return -1 - d
        x = (h + d * _STEP) & _ALL
        x = ((x ^ (x >> 30)) * _M1) & _ALL
        x = ((x ^ (x >> 27)) * _M2) & _ALL
        return (x ^ (x >> 31)) % self.n


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked adjacent pair is merged first, leftmost on ties."""
    n = len(piece)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or not alive[j] or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            left[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := left[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Whole-text encoder; picklable, so that one broadcast serves all executors."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.hash = PerfectHash(list(self.ranks))
        self.key, self.id = [b""] * self.hash.n, [0] * self.hash.n
        for k, at in zip(self.ranks, self.hash.slot.tolist()):
            self.key[at], self.id[at] = k, self.ranks[k]
        self.hash.slot = None

    def piece(self, text: str) -> list[int]:
        raw = text.encode()
        at = self.hash.find(raw)
        return [self.id[at]] if self.key[at] == raw else merge(raw, self.ranks)

    def encode(self, text: str) -> list[int]:
        memo = self.__dict__.setdefault("_memo", _Memo(self))
        return list(itertools.chain.from_iterable(map(memo.__getitem__, split(text))))


class _Memo(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, text: str) -> list[int]:
        if len(self) >= MEMO:
            self.clear()
        ids = self[text] = self.encoder.piece(text)
        return ids


def split(text: str) -> list[str]:
    """Pre-tokens of a text."""
    if not _UNUSUAL.search(text):
        return _PLAIN.findall(text)
    import regex

    return regex.findall(PATTERN, text)


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` of every row; no shuffle, one pass over two columns.

    The broadcast is the vocabulary, whose size the vocabulary file fixes.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Encoder(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _Memo(shared.value).__getitem__
        flat = itertools.chain.from_iterable

        def out(keys, parts):
            sizes = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids], names=[id_col, "ids"])

        for batch in batches:
            keys, parts, held = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids = np.fromiter(flat(map(get, split(text))), dtype=np.int32) if text else np.zeros(0, np.int32)
                keys.append(key)
                parts.append(ids)
                held += len(ids)
                if held >= FLUSH_IDS:
                    yield out(keys, parts)
                    keys, parts, held = [], [], 0
            if keys:
                yield out(keys, parts)

    source = documents.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, f"{id_col} bigint, ids array<int>")
