"""Documents of keywords, links or product tags instead of prose (problem 10).

A text is cut into lines, and long lines at list marks and sentence ends. Each line becomes one
of nine symbols (sentence, entry of an honest list, bare link, annotated link, product tag, tag
list, short phrase, repetition, other). A hidden Markov model labels the lines prose, link list,
tag list or menu; its transitions and emissions start from PRIOR, STAY and EMIT and are fitted by
a step of hard expectation-maximisation on the symbols of the whole corpus, of which only counts
of fixed size reach the driver. A document is found if the words of its lines that are not prose make up
SPAM of all.

Defined results: null, empty and blank texts are not found; repeated rows are each found; texts
are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmill.llm import lines
from scholarmill.session import cut

STATES = ("prose", "links", "tags", "menu")
SYMBOLS = ("sentence", "entry", "link", "note", "product", "tags", "phrase", "repeat", "other")
#: Share of words outside prose from which a document is found.
SPAM = 0.5
#: A line repeats itself if so large a share of its words stands in pairs of uncommon words that a block of BLOCK words has REPEATS times.
BLOCK, REPEATS, REPEATED = 60, 2, 0.4
WITHIN = 0.33
#: Repetition is counted where so large a share of the words stands outside sentences and entries.
LOOSE = 0.1
LONG, ENTRY = 100, 300

PSEUDO = 1000.0
PRIOR = np.array([0.9, 0.03, 0.04, 0.03])
STAY = 0.9
EMIT = np.array(
    [
        # sentence entry link  note  product tags  phrase repeat other
        [0.62, 0.20, 0.005, 0.03, 0.002, 0.01, 0.06, 0.003, 0.07],
        [0.01, 0.01, 0.85, 0.05, 0.01, 0.01, 0.02, 0.02, 0.02],
        [0.01, 0.01, 0.01, 0.01, 0.40, 0.26, 0.10, 0.18, 0.02],
        [0.12, 0.01, 0.02, 0.01, 0.02, 0.04, 0.43, 0.32, 0.03],
    ]
)

_CUT = re.compile(r"(?<=\s)[-/|·•»*]\s|;\s|(?<=[\w)%\]][\w)%\]][.!?])\s+(?=[^\sa-z.])|(?<=\))\s(?=\[)|\s(?=#\w)")
_STOP = re.compile(r"(?<=[\w)%\]][\w)%\]][.!?])\s+(?=[^\sa-z.])")
_LINK = re.compile(r"\]\([^)]*\)|(?:https?://|www\.)\S+|\b[\w-]+\.(?:test|example|invalid|com|net|org|info|biz|shop|ru|cn)/\S*", re.I)
_YEAR, _ISSUE, _DOTS = re.compile(r"\((?:1[5-9]|20)\d\d[a-z]?\)"), re.compile(r"\d\(\d+\):\d"), re.compile(r"\.{4,}\s*\d+$")
_LINK_CUES = ("](", "http", "www.", *(f".{x}/" for x in "test example invalid com net org info biz shop ru cn".split()))
_GLOSS = re.compile(r"^[^\W\d][\w -]{1,30}: ")
_PRODUCT = re.compile(r"\b\d+[.,]\d\d\b(?!%)|\bSKU\b|★|\b(?:in stock|add to (?:basket|cart)|sale|reviews?|EUR|USD|GBP|-\d+%)(?!\w)|[€$£]\s?\d", re.I)
_ENDS = frozenset(".!?…'\"”’»)]")


def _entry(line: str) -> bool:
    """Whether a line is a reference or a line of contents."""
    return bool(("(" in line and _YEAR.search(line)) or ("):" in line and _ISSUE.search(line)) or "doi.org/" in line or ("...." in line and _DOTS.search(line)))


def _repeats(words: list[str], known: dict[str, int]) -> list[int]:
    """How many words before each place stand in a repeated pair of their block."""
    n = len(words)
    marks = np.zeros(n, bool)
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    rare = np.array([w not in lines.COMMON for w in words], bool)
    at = np.flatnonzero(rare[:-1] & rare[1:])
    pair = (at // BLOCK << 46) ^ (ids[at] * 8_388_593 + ids[at + 1])
    _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
    hit = at[count[back] >= REPEATS]
    marks[hit] = marks[hit + 1] = True
    return [0, *np.cumsum(marks).tolist()]


def _within(words: list[str]) -> bool:
    """Whether WITHIN of a sentence's words stand in pairs of uncommon words that it repeats, or repeat one word twice more."""
    if len(set(words)) > (1 - WITHIN / 2) * len(words):
        return False
    pairs, single, last = {}, {}, ""
    for w in words:
        if w in lines.COMMON or len(w) < 3:
            last = ""
            continue
        single[w] = single.get(w, 0) + 1
        if last:
            pairs[last, w] = pairs.get((last, w), 0) + 1
        last = w
    covered = max(2 * sum(n for n in pairs.values() if n > 1), sum(n for n in single.values() if n > 2))
    return covered >= WITHIN * len(words)


def units(text: str) -> list[str]:
    """The lines of a text, long ones cut at list marks, tags and sentence ends."""
    out = []
    for line in text.split("\n"):
        if len(line) <= ENTRY and _entry(line):
            out.append(line)
        elif len(line) <= LONG and "#" not in line:
            out += _STOP.split(line)
        else:
            out += _CUT.split(line)
    return [u for u in map(str.strip, out) if u]


def symbols(text: str, known: dict[str, int]) -> tuple[list[int], list[int]]:
    """The symbol and the number of words of each line."""
    parts = units(text)
    words = [lines.words(u) for u in parts]
    low = text.lower()
    links = any(x in low for x in _LINK_CUES)
    rows = []
    for u, w in zip(parts, words):
        n = len(w)
        common = len([x for x in w if x in lines.COMMON])
        entry = _entry(u)
        ended = n >= 4 and common >= max(1, 0.08 * n) and u.count(",") < 0.25 * n and u[-1] in _ENDS and not (links and _LINK.search(u))
        rows.append((u, w, n, common, entry, ended))
    total, loose = sum(map(len, words)), sum(r[2] for r in rows if not r[4] and not r[5])
    repeat = _repeats([x for w in words for x in w], known) if loose >= max(2, LOOSE * total) else None
    at, sym, size = 0, [], []
    for u, w, n, common, entry, ended in rows:
        rep = (repeat[at + n] - repeat[at]) / n if repeat and n else 0.0
        at += n
        times = 1
        if entry and rep < 2 * REPEATED:
            k = 1
        elif ended:
            k = 7 if _within(w) else 1 if _GLOSS.match(u) else 0
        elif links and _LINK.search(u):
            rest = lines.words(_LINK.sub(" ", u))
            k = 3 if sum(x in lines.COMMON for x in rest) >= 2 and len(rest) >= 6 else 2
        elif rep >= REPEATED:
            k = 7
        elif u[0] == "#" or u.count("#") > 1:
            k = 5
        elif _PRODUCT.search(u) and common <= max(1, 0.15 * n):
            k = 4
        elif u.count(",") >= 2 and common <= 0.12 * n:
            k, times = 5, u.count(",") + 1
        elif n <= 7 and common <= 1:
            k = 6
        elif n >= 8 and common >= 0.08 * n:
            k = 0
        else:
            k = 8
        if sym and k == 0 and sym[-1] == 2:
            sym[-1] = 3
        sym += [k] * times
        size += [max(1, n // times)] * times
    return sym, size


class Labels:
    """Viterbi labels for sequences of symbols, by one set of counts (start, moves, emissions)."""

    def __init__(self, prior: np.ndarray, move: np.ndarray, emit: np.ndarray):
        p, m, e = (np.log(x / x.sum(-1, keepdims=True)) for x in (prior, move, emit))
        self.prior, self.into, self.emit = p.tolist(), m.T.tolist(), e.T.tolist()
        # a text of such symbols alone is prose throughout: no other path beats it at any step
        calm = p[0] == p.max() and m[0, 0] >= m.max() - 1e-9
        self.prose = frozenset(k for k in range(len(SYMBOLS)) if calm and e[0, k] == e[:, k].max())
        self.known: dict[bytes, bytes] = {}

    def __call__(self, sym: bytes) -> bytes:
        if self.prose.issuperset(sym):
            return bytes(len(sym))
        if sym not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[sym] = self._path(sym)
        return self.known[sym]

    def _path(self, sym: bytes) -> bytes:
        best, back = [a + b for a, b in zip(self.prior, self.emit[sym[0]])], []
        for s in sym[1:]:
            emit, new, via = self.emit[s], [], []
            for j, into in enumerate(self.into):
                x = [a + b for a, b in zip(best, into)]
                top = max(x)
                new.append(top + emit[j])
                via.append(x.index(top))
            back.append(via)
            best = new
        at = best.index(max(best))
        path = [at]
        for via in reversed(back):
            at = via[at]
            path.append(at)
        return bytes(reversed(path))


def start() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PRIOR, STAY and EMIT as PSEUDO counts for each state."""
    move = np.full((4, 4), (1 - STAY) / 3)
    np.fill_diagonal(move, STAY)
    return PRIOR * PSEUDO, move * PSEUDO, EMIT * PSEUDO


def fit(sequences: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of start, moves and emissions after one labelling of all sequences by the start model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labels(*start())
        total = np.zeros(4 + 16 + 4 * len(SYMBOLS))
        for batch in batches:
            for sym in batch.column(0).to_pylist():
                if sym:
                    y = np.frombuffer(label(sym), np.uint8).astype(np.int64)
                    x = np.frombuffer(sym, np.uint8)
                    total[y[0]] += 1
                    total[4:20] += np.bincount(y[:-1] * 4 + y[1:], minlength=16)
                    total[20:] += np.bincount(y * len(SYMBOLS) + x, minlength=4 * len(SYMBOLS))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["c"])

    size = 20 + 4 * len(SYMBOLS)
    row = sequences.select("sym").mapInArrow(run, "c array<double>").agg(*(F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(size))).first()
    c = np.array([x or 0.0 for x in row])
    own = c[:4], c[4:20].reshape(4, 4), c[20:].reshape(4, -1)
    # each state's counts weigh half as much as its start counts at most, so that a state keeps its meaning
    return tuple(a + x * np.minimum(1, PSEUDO / 2 / np.maximum(x.sum(-1, keepdims=True), 1)) for a, x in zip(start(), own))


def found(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` of the documents of keywords, links or tags."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                if len(known) > 500_000:
                    known.clear()
                out.append(symbols(text.as_py() or "", known))
            sizes = pa.array([size for _, size in out], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bytes(sym) for sym, _ in out], pa.binary()), sizes], names=["id", "sym", "size"])

    seq = cut(documents.select(F.col(id_col).cast("long"), F.col("text").cast("string")).mapInArrow(read, "id bigint, sym binary, size array<int>"))
    model = fit(seq)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labels(*model)
        for batch in batches:
            ids = []
            for i, sym, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if sym and not label.prose.issuperset(sym):
                    size = size.as_py()
                    if sum(n for y, n in zip(label(sym), size) if y) >= SPAM * sum(size):
                        ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=[id_col])

    return seq.mapInArrow(judge, f"{id_col} bigint")
