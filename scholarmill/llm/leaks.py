"""Documents that hold a passage of an evaluation item (problem 9).

SimHash of every window of words in documents and items; windows whose hashes share one of
four blocks of bits and differ in three bits at most are seeds. Round each seed the words are
compared along its diagonal, and the passage counts if it is long, dense and heavy enough in
shingles; shingles that several items share (stock instructions) weigh nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

WINDOW, BITS, BLOCKS = 5, 3, 4
#: Words compared equal, and their share of the passage; weight in bigrams; items from which a bigram is stock.
MATCHED, DENSITY, WEIGHT, STOCK, GAP = 12, 0.7, 8, 5, 3
_WORD, _SOFT = re.compile(r"\w+"), re.compile("[­​-‏⁠﻿]")


def words(text: str) -> list[str]:
    return _WORD.findall(_SOFT.sub("", unicodedata.normalize("NFKC", text)).casefold())


def _hash(ws: list[str], known: dict[str, int]) -> np.ndarray:
    for w in ws:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter((known[w] for w in ws), np.uint64, len(ws))


def simhash(h: np.ndarray) -> np.ndarray:
    """The SimHash of each window of WINDOW words."""
    n = len(h) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    ones = sum(bits[k : k + n] for k in range(WINDOW))
    return np.packbits(ones * 2 > WINDOW, axis=1).view(np.uint64).ravel()


class Index:
    """The items' words and, by block of bits, their windows; its size is that of the items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.id = [i for i, _ in items]
        self.h = [_hash(words(t), {}) for _, t in items]
        df = Counter(g for h in self.h for g in set(zip(h[:-1].tolist(), h[1:].tolist())))
        self.weight = [np.array([df[g] < STOCK for g in zip(h[:-1].tolist(), h[1:].tolist())], bool) for h in self.h]
        sigs = [simhash(h) for h in self.h]
        self.sig = np.concatenate(sigs)
        self.item = np.repeat(np.arange(len(sigs)), [len(s) for s in sigs])
        self.at = np.concatenate([np.arange(len(s)) for s in sigs])
        self.pad = np.zeros(max(map(len, self.h), default=0) + 2, np.uint64)
        self.order, self.key = [], []
        for b in range(BLOCKS):
            key = (self.sig >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            self.order.append(np.argsort(key, kind="stable"))
            self.key.append(np.searchsorted(key[self.order[-1]], np.arange((1 << 16) + 1)))

    def seeds(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a document and the item windows alike."""
        sig, out = simhash(h), []
        for b in range(BLOCKS):
            key = (sig >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            lo = self.key[b][key]
            n = self.key[b][key + np.uint64(1)] - lo
            pos = np.repeat(np.arange(len(sig)), n)
            win = self.order[b][np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(sig) else pos
            near = np.bitwise_count(sig[pos] ^ self.sig[win]) <= BITS
            out.append(pos[near] * len(self.sig) + win[near])
        return np.divmod(np.unique(np.concatenate(out)), max(1, len(self.sig)))

    def leaked(self, h: np.ndarray) -> list[int]:
        by, wide = defaultdict(set), np.concatenate([self.pad, h, self.pad])
        for pos, win in zip(*(x.tolist() for x in self.seeds(h))):
            by[int(self.item[win])].add(pos - int(self.at[win]))
        return [self.id[k] for k, diagonals in by.items() if any(self._passage(wide, k, d) for d in diagonals)]

    def _passage(self, wide: np.ndarray, k: int, d: int) -> bool:
        """Whether an item's words, laid d further on, hold a passage; GAP words on, the text may have lost or won some."""
        item = self.h[k]
        at = len(self.pad) + d
        ok = np.zeros(len(item), bool)
        for s in (0, -1, 1, -2, 2):
            same = wide[at + s : at + s + len(item)] == item
            if s:
                same[1:-1] &= same[:-2] & same[2:]
            ok |= same
        hit = np.flatnonzero(ok)
        if len(hit) < MATCHED:
            return False
        for part in np.split(hit, np.flatnonzero(np.diff(hit) > GAP + 1) + 1):
            if len(part) >= MATCHED and len(part) / (part[-1] - part[0] + 1) >= DENSITY:
                pair = part[:-1][np.diff(part) == 1]
                if self.weight[k][pair].sum() >= WEIGHT:
                    return True
        return False


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of every leak; one pass over the documents, the fixed items as a broadcast."""
    rows = [(r.item_id, r.text) for r in items.select("item_id", "text").where("text is not null").collect()]
    shared = documents.sparkSession.sparkContext.broadcast(Index(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if len(known) > 500_000:
                    known.clear()
                if text := text.as_py():
                    out += [(key, i) for i in sorted(shared.value.leaked(_hash(words(text), known)))]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["doc_id", "item_id"])

    return documents.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint")
