"""Search hits and catalogue records of the same work, without a common key (problem 3).

Titles, people, years and identifiers of both sides are brought into one form. Several blocking
passes make candidates: pairs of a title's rarest words, the tail of the identifier, and a
surname with the year and an early title word. A block of more than LARGE pairs is split by keys
of which every pair that the exact check below allows has one in common, so it loses no link:
first and third title word, or the letters of the title, with room for slips; people and year
of short titles; the end of the identifier. Each candidate pair gets an agreement level per attribute; expectation-maximisation over the counts of level patterns gives
the match and non-match probabilities, and the posterior of a pattern is the confidence of its
pairs. An exact check follows: part, reply and follow-up marks of the two titles must be equal,
and titles of one or two words need an author and a year, or an identifier, in common.

Defined results: null, empty and blank attributes are a level of their own, never agreement;
repeated rows each link; an empty table gives no link; further columns are not read.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmill.llm import lines
from scholarmill.session import cut

#: Hashed word counts: so many counters reach the driver and the workers, however many words there are.
COUNTERS = 1 << 18
RAREST, LARGE = 3, 20_000
CONFIDENCE, ROUNDS = 0.5, 50
#: The start probabilities count as so many pairs, which keeps tables of a few rows in hand.
PRIOR = 20
#: Agreement levels of title, people, year and identifier; the first is a missing value.
LEVELS = (6, 5, 4, 3)

_TAG = re.compile(r"<[^>]{1,20}>")
_LEAD = re.compile(r"^\s*(?:\[[^\]]{1,24}\]|(?:article|paper|preprint|pdf|book chapter|conference paper|thesis|dataset)\s*:)\s*", re.I)
_TAIL = re.compile(r"\s*(?:\[[^\]]{1,24}\]|\((?:offprint|preprint|reprint|online|electronic resource|e-?book)\)|:\s*(?:preprint|offprint|reprint)|[.…]+)\s*$", re.I)
_MARK = re.compile(r"\s*[:,.(–-]*\s*\b(part|teil|partie|parte|vol\.?|volume)\s+(\d+|[ivx]+)\)?$|\s*[:,.(–-]*\s*\b(an? (?:second |third |final |short )?(?:reply|report|rejoinder|response|comment|follow-?up|correction|erratum)|a (?:second|third|final|further) \w+)\)?$|\s+(revisited with .+)$")
_FIRST = re.compile(r"^(correction to|erratum|corrigendum|letter|reply to|review|comment on|response to|addendum)\s*:?\s+")
#: Every title with a mark or a first word of its kind has one of these.
_MARKED = re.compile(r"part|teil|vol|reply|report|rejoinder|response|comment|follow|correction|erratum|second|third|final|further|revisited")
_BY = re.compile(r"\s/\s(.+)$")
_WORD = re.compile(r"[^\W_]+")
_YEAR = re.compile(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)")
_SPLIT = re.compile(r"\s*(?:;|/|\||\band\b|&)\s*")
_NOBODY = frozenset("unknown anonymous anon none null na et al others various authors author".split())
_PARTICLE = frozenset("van von der den de la le di da del al el bin ibn dr prof mr mrs ms jr sr ed eds of the for and at".split())
_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6"}


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def title_of(raw: str | None) -> tuple[list[str], str, str]:
    """Words, the mark of a part or reply, and the statement of people behind a slash."""
    t = _TAG.sub("", raw or "").replace("&", " and ").strip()
    by = ""
    if m := _BY.search(t):
        t, by = t[: m.start()], m[1]
    t = _LEAD.sub("", t)
    cut_off = t.endswith(("…", "..."))
    for _ in range(3):
        if t[-1:].isalnum() and t[-1] not in "tT":
            break
        t = _TAIL.sub("", t)
    t = " ".join(fold(t).split())
    mark = ""
    if m := _FIRST.match(t):
        mark, t = m[1], t[m.end() :]
    if not cut_off and _MARKED.search(t):
        for _ in range(2):
            if m := _MARK.search(t):
                kind = "part" + _ROMAN.get(m[2], m[2]) if m[1] else m[3] or m[4]
                mark, t = f"{kind}|{mark}", t[: m.start()]
    return _WORD.findall(t), mark + ("…" if cut_off else ""), by


@functools.lru_cache(1 << 16)
def person(raw: str) -> str:
    """Words of three letters or more of a name, and its initials behind a bar."""
    words = [w for w in _WORD.findall(fold(raw)) if not w.isdigit()]
    if not words or all(w in _NOBODY for w in words):
        return ""
    long = [w for w in words if len(w) >= 3 and w not in _PARTICLE] or [w for w in words if len(w) == 2 and w not in _PARTICLE]
    return " ".join(long) + "|" + "".join(sorted({w[0] for w in words if w not in _PARTICLE}))


def people_of(names: list[str]) -> list[str]:
    return list(dict.fromkeys(p for p in map(person, names) if p[:1] not in ("", "|")))


def year_of(raw: str | None) -> int:
    m = _YEAR.search(raw or "")
    return int(m[0]) if m else 0


def tail_of(raw: str | None) -> str:
    """The last piece of an identifier, with letters and digits both."""
    found = re.findall(r"[a-z0-9]{4,}", (raw or "").lower())
    return found[-1] if found and re.search(r"\d", found[-1]) and re.search(r"[a-z]", found[-1]) else ""


def _near(a: str, b: str, most: int) -> bool:
    """Whether ``most`` edits, swaps of neighbours included, turn one word into the other (most is 1 or 2)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b) <= most
    if len(a) == len(b) == 1 or (len(a) == len(b) == 2 and a == b[::-1]):
        return True
    return most > 1 and any(_near(x, y, most - 1) for x, y in ((a[1:], b), (a, b[1:]), (a[1:], b[1:])))


def same_word(a: str, b: str) -> bool:
    return a == b or (len(a) > 3 and len(b) > 3 and _near(a, b, 2 if min(len(a), len(b)) > 8 else 1))


def title_level(a: list[str], b: list[str], cut_off: bool) -> int:
    """0 missing, 1 different, 2 short and equal, 3 one begins the other, 4 equal but for misspellings, 5 equal."""
    if not a or not b:
        return 0
    if a == b:
        return 5 if len(a) > 2 else 2
    if len(a) == len(b) and all(map(same_word, a, b)):
        return 4 if len(a) > 2 else 2
    s, t = (a, b) if len(a) < len(b) else (b, a)
    if len(s) >= 4 and all(map(same_word, s[:-1], t)) and (same_word(s[-1], t[len(s) - 1]) or (cut_off and t[len(s) - 1].startswith(s[-1]))):
        return 3
    x, y = "".join(a), "".join(b)
    if len(x) > 12 and (x == y or (abs(len(a) - len(b)) <= 1 and abs(len(x) - len(y)) <= 2 and _near(x, y, 2))):
        return 4
    return 1


@functools.lru_cache(1 << 16)
def same_person(p: str, q: str) -> bool:
    (a, i), (b, j) = p.split("|"), q.split("|")
    hit = [x for x in a.split() if any(same_word(x, y) for y in b.split())]
    return bool(hit) and (set(i) <= set(j) or set(j) <= set(i) or len(hit) > 1 or len(set(i) & set(j)) >= 2)


def people_level(a: list[str], b: list[str]) -> int:
    """0 missing, 1 nobody in common, 2 fewer than half, 3 half or more, 4 all of the shorter list."""
    if not a or not b:
        return 0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    n = sum(any(same_person(p, q) for q in b) for p in a)
    return 1 if not n else 4 if n == len(a) else 3 if 2 * n >= len(a) else 2


def levels(h: tuple, r: tuple) -> tuple[int, bool]:
    """The pattern of levels of (words, mark, people, year, tail) of two rows, and whether the exact check allows a link."""
    (a, m, p, y, d), (b, n, q, z, e) = h, r
    off = m.endswith("…") or n.endswith("…")
    title = title_level(a, b, off)
    people = people_level(p, q)
    year = 0 if not y or not z else 3 if y == z else 2 if abs(y - z) == 1 else 1
    tail = 0 if not d or not e else 2 if d == e or (len(min(d, e, key=len)) >= 5 and (d.endswith(e) or e.endswith(d))) else 1
    strip = lambda x: x.rstrip("…")
    marks = strip(m) == strip(n) or (off and title == 3) or same_word(strip(m).replace(" ", ""), strip(n).replace(" ", ""))
    known = title > 2 or (title == 2 and (tail == 2 or (people > 2 and year > 1))) or (title == 1 and tail == 2 and (people > 2 or year == 3)) or (not title and tail == 2)
    return ((title * LEVELS[1] + people) * LEVELS[2] + year) * LEVELS[3] + tail, marks and known


def fit(counts: np.ndarray) -> np.ndarray:
    """The posterior of every pattern, by expectation-maximisation with independent attributes."""
    shape = LEVELS
    n = counts.reshape(shape).astype(float)
    m = [np.array(x) for x in ([0.01, 0.02, 0.03, 0.14, 0.25, 0.55], [0.15, 0.02, 0.05, 0.13, 0.65], [0.1, 0.05, 0.1, 0.75], [0.8, 0.05, 0.15])]
    u = [np.array(x) for x in ([0.01, 0.94, 0.01, 0.02, 0.01, 0.01], [0.15, 0.6, 0.1, 0.1, 0.05], [0.1, 0.75, 0.05, 0.1], [0.8, 0.195, 0.005])]
    start_m, start_u = [x.copy() for x in m], [x.copy() for x in u]
    share, total = 0.1, max(n.sum(), 1.0)
    grid = lambda x: x[0][:, None, None, None] * x[1][None, :, None, None] * x[2][None, None, :, None] * x[3]
    for k in range(ROUNDS + 1):
        a, b = share * grid(m), (1 - share) * grid(u)
        post = a / (a + b)
        if k == ROUNDS:
            return post.ravel()
        own, rest = n * post, n * (1 - post)
        share = float((own.sum() + 0.1 * PRIOR) / (total + PRIOR))
        for axis in range(4):
            other = tuple(x for x in range(4) if x != axis)
            for prob, weight, first in ((m, own, start_m), (u, rest, start_u)):
                x = weight.sum(other) + PRIOR * first[axis]
                prob[axis] = x / x.sum()
        # a level of agreement never speaks against a match
        for p, q in zip(m, u):
            q[1] = max(q[1], p[1])
    return post.ravel()


_FORM = "id bigint, words string, mark string, people string, year int, tail string"


def _forms(rows: DataFrame, catalogue: bool) -> DataFrame:
    """Rows of (id, title, names, year, identifier) in one form; words are joined by blanks, people by semicolons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, title, names, year, ident in zip(*(c.to_pylist() for c in batch.columns)):
                words, mark, by = title_of(title)
                if catalogue:
                    names = [x for x in _SPLIT.split(names or by) if x.strip()]
                out.append((i, " ".join(words), mark, ";".join(people_of([x for x in names or () if x])), year_of(year), tail_of(ident)))
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "words", "mark", "people", "year", "tail"])

    return cut(rows.mapInArrow(run, _FORM))


def _word_counts(*forms: DataFrame) -> np.ndarray:
    out = np.zeros(COUNTERS, np.int64)
    for f in forms:
        by = f.select(F.explode(F.array_distinct(F.split("words", " "))).alias("w")).where("w != ''").groupBy(F.expr(f"pmod(xxhash64(w), {COUNTERS})").cast("int").alias("k")).agg(F.count("*").alias("n"))
        rows = by.toArrow()
        np.add.at(out, rows.column(0).to_numpy(), rows.column(1).to_numpy())
    return out


def _keys(form: DataFrame, shared) -> DataFrame:
    """Blocking keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            out = []
            for i, words, slots, people, year, tail in zip(*(c.to_pylist() for c in batch.columns)):
                words, people = words.split(), people.split(";") if people else []
                own = {w: counts[s] for w, s in zip(words, slots) if len(w) > 2 and w not in lines.COMMON}
                rare = sorted(own, key=lambda w: (own[w], w))[:RAREST]
                own_name = [[w[:5] for w in p.split("|")[0].split()] for p in people[:2]]
                names = list(dict.fromkeys(w for ws in own_name for w in ws))
                keys = [f"t{a} {b}" for k, a in enumerate(sorted(rare)) for b in sorted(rare)[k + 1 :]]
                first = [w for w in words if w in own][:2]
                keys += [f"n{s} {year} {w}" for k, ws in enumerate(own_name) for s in ws for w in first[: 2 - k] if year]
                if len(own) < 3:
                    keys += [f"s{' '.join(words)} {s}" for s in names]
                if tail:
                    keys.append("d" + tail)
                out += [(lines.digest(k), i) for k in dict.fromkeys(keys)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([i for _, i in out], pa.int64())], names=["key", "id"])

    slots = F.transform(F.split("words", " "), lambda w: F.pmod(F.xxhash64(w), F.lit(COUNTERS)).cast("int"))
    return form.select("id", "words", slots, "people", "year", "tail").mapInArrow(run, "key bigint, id bigint")


def _deletions(word: str) -> set[str]:
    """What is left of a word without as many letters as ``same_word`` allows slips."""
    out = last = {word}
    for _ in range(0 if len(word) < 4 else 1 if len(word) < 9 else 2):
        last = {w[:k] + w[k + 1 :] for w in last for k in range(len(w))}
        out = out | last
    return out


def _near_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """``w, v``: every two words (columns w) of both sides that ``same_word`` may call the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(lines.digest(d), w) for w in batch.column(0).to_pylist() for d in _deletions(w)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([w for _, w in out], pa.string())], names=["k", "w"])

    of = lambda x: x.where("w is not null").distinct().mapInArrow(run, "k bigint, w string")
    return cut(of(a).join(of(b).withColumnRenamed("w", "v"), "k").select("w", "v").distinct())


def _finer(hits: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, sub`` of both sides: every pair that ``levels`` allows has a sub in common.

    Identifiers that agree have one end. Equal titles but for slips in words, and titles of which
    one begins the other, have first and third words a slip apart; if they have one or two words,
    people and years must agree besides. Titles two letters apart when written without blanks
    have at most one slip in the first twelve letters, or none behind the thirteenth.
    """

    def parts(form: DataFrame) -> DataFrame:
        w = F.split("words", " ")
        names = F.expr("filter(array_distinct(split(people, '[ ;]')), x -> instr(x, '|') = 0 and x != '')")
        words = form.select("id", "year", "tail", w.alias("all"), F.regexp_replace("people", r"\|[^;]*", "").alias("people"), F.replace("words", F.lit(" "), F.lit("")).alias("x"), F.when(F.col("words") == "", 0).otherwise(F.size(w)).alias("n"))
        return cut(words.select("id", "year", "tail", "x", "n", F.col("all")[0].alias("w0"), F.coalesce(F.get("all", F.lit(2)), F.lit("")).alias("w2"), names.alias("names")))

    h, r = parts(hits), parts(records)
    short = lambda x: x.where("n in (1, 2) and year > 0").select("id", "year", F.explode("names").alias("w"))
    long = lambda x: x.where("n > 2").select("id", "w0", "w2")
    all_words = lambda x: long(x).select(F.explode(F.array("w0", "w2")).alias("w")).unionByName(short(x).select("w"))
    near = _near_words(all_words(h), all_words(r))
    first, third = near.toDF("w0", "v0"), near.toDF("w2", "v2")
    sub = lambda kind, *c: F.xxhash64(F.lit(kind), *c).alias("sub")

    def common(x: DataFrame, ends: str) -> DataFrame:
        ends_of = x.where("tail != ''").select("id", sub("tail", F.expr("right(tail, 5)")))
        begins = "transform(sequence(1, 13), k -> left(concat(left(x, k - 1), substring(x, k + 1, greatest(12 - k, 0))), 11))"
        letters = x.where("length(x) > 10").select("id", F.explode(F.expr(f"array_distinct(concat(transform({begins}, y -> xxhash64('begin', y)), transform({ends}, k -> xxhash64('end', substring(x, k)))))")).alias("sub"))
        return ends_of.unionByName(letters)

    a = common(h, "array(14)").unionByName(long(h).join(first, "w0").join(third, "w2").select("id", sub("words", "v0", "v2")))
    a = a.unionByName(short(h).join(near, "w").select("id", sub("people", "v", "year")))
    b = common(r, "sequence(12, 16)").unionByName(long(r).select("id", sub("words", "w0", "w2")))
    b = b.unionByName(short(r).select("id", "w", F.explode(F.expr("sequence(year - 1, year + 1)")).alias("year")).select("id", sub("people", "w", "year")))
    return a.distinct(), b.distinct()


def candidates(hits: DataFrame, records: DataFrame) -> DataFrame:
    """``hit, rec`` of every pair that shares a block, and in a large one a finer key."""
    shared = hits.sparkSession.sparkContext.broadcast(_word_counts(hits, records))
    h, r = cut(_keys(hits, shared)), cut(_keys(records, shared))
    both = h.groupBy("key").agg(F.count("*").alias("a")).join(r.groupBy("key").agg(F.count("*").alias("b")), "key")
    both = cut(both.select("key", (F.col("a") * F.col("b") > LARGE).alias("large")))
    small, large = both.where("not large").select("key"), both.where("large").select("key")
    a, b = h.join(small, "key", "left_semi"), r.join(small, "key", "left_semi")
    if large.limit(1).count():
        x, y = cut(h.join(large, "key", "left_semi")), cut(r.join(large, "key", "left_semi"))
        finer = _finer(hits.join(x.select("id").distinct(), "id", "left_semi"), records.join(y.select("id").distinct(), "id", "left_semi"))
        more = [k.join(s, "id").select(F.xxhash64("key", "sub").alias("key"), "id") for k, s in zip((x, y), finer)]
        a, b = a.unionByName(more[0]), b.unionByName(more[1])
    return a.withColumnRenamed("id", "hit").join(b.withColumnRenamed("id", "rec"), "key").select("hit", "rec").distinct()


def compared(hits: DataFrame, records: DataFrame, pairs: DataFrame) -> DataFrame:
    """``hit, rec, pattern, allowed`` of each candidate pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for k in (2, 7):
                cols[k] = [x.split() for x in cols[k]]
                cols[k + 2] = [x.split(";") if x else [] for x in cols[k + 2]]
            got = [levels(row[:5], row[5:]) for row in zip(*cols[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p for p, _ in got], pa.int32()), pa.array([ok for _, ok in got], pa.bool_())], names=["hit", "rec", "pattern", "allowed"])

    def side(form: DataFrame, name: str) -> DataFrame:
        return form.select(F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("words", "mark", "people", "year", "tail")))

    joined = pairs.join(side(records, "rec"), "rec").join(side(hits, "hit"), "hit")
    parts = [f"{n}_{c}" for n in ("hit", "rec") for c in ("words", "mark", "people", "year", "tail")]
    return joined.select("hit", "rec", *parts).mapInArrow(run, "hit bigint, rec bigint, pattern int, allowed boolean")


def matches(hits: DataFrame, records: DataFrame) -> DataFrame:
    """``hit_id, rec_id, confidence`` of every hit and catalogue record of the same work."""
    h = _forms(hits.select(F.col("hit_id").cast("long"), F.col("title").cast("string"), F.col("authors").cast("array<string>"), F.col("year").cast("string"), F.col("doi").cast("string")), False)
    r = _forms(records.select(F.col("rec_id").cast("long"), F.col("title_display").cast("string"), F.coalesce("contributor", F.lit("")), F.col("pub_year").cast("string"), F.col("note").cast("string")), True)
    pairs = cut(compared(h, r, candidates(h, r)))
    counts = np.zeros(int(np.prod(LEVELS)))
    for row in pairs.groupBy("pattern").agg(F.count("*").alias("n")).collect():
        counts[row.pattern] = row.n
    post = fit(counts)
    spark = pairs.sparkSession
    confidence = spark.createDataFrame([(k, float(p)) for k, p in enumerate(post) if p >= CONFIDENCE and counts[k]], "pattern int, confidence double")
    found = pairs.where("allowed").join(F.broadcast(confidence), "pattern")
    return found.select(F.col("hit").alias("hit_id"), F.col("rec").alias("rec_id"), "confidence")
