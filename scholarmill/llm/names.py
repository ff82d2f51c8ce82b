"""Spellings of one person or organisation (problem 1).

Merge-and-rematch resolution. Distinct spellings become forms: given name, initials and surname
of a person, or the words of an organisation; which word of a name is the surname comes from
commas, capitals, initials and, failing those, from how often each word stands first and last.
Every form starts as a profile. Profiles merge

* when their forms are a slip apart (all pairs in blocks of one-letter deletions or, of
  organisations, of the beginnings and ends of words), unless both readings are names of their own;
* when given name and surname agree and the middle initials of the two profiles do not clash;
* when a short form (initials, a clipped or a pet name) fits one profile of its surname only;
* when a short form stands where another record of the same work has one profile's name.

A merged profile has the union of spellings and initials and enters the blocks again, until a
round merges nothing. Two forms that one list names side by side are never merged directly: they
are two people.

Defined results: null, empty and blank names and those that name nobody are no spellings; each
pair is given once, the smaller spelling first; repeated rows change nothing; empty tables give
no pair; null titles, authors and creators are allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmill.llm import lines
from scholarmill.llm.linkage import _near, fold, title_of
from scholarmill.session import cut

#: Hashed counts of fixed size: words by place, given names and surnames by their partners.
COUNTERS = 1 << 18
#: From so many partners on, a word is a name of its own and not a slip of another.
OWN = 3
#: So many links are put together by one task; more go through joins.
LINKS = 1_000_000

_NOBODY = re.compile(r"^\W*(?:et al|and others|others|unknown(?: author)?|anon(?:ymous)?|n/?a|none|null|nil|no author|various(?: authors)?|s\.?n|tba|author|editors?|-+|\?+)?\W*$", re.I)
_EXTRA = re.compile(r"\((?:eds?|hrsg|author|dir|coord|trans)\.?\)|[*†‡§¶\d]+|\b(?:dr|prof|professor|mrs?|ms|phd|md|jr|sr)\b\.?", re.I)
_KIND = re.compile(r"^(?:institut|inst$|acad|depart|dept|dep$|assoc|assn|universi|univ|uni$|laborator|lab$|cent(?:re|er|ro)|ctr|cent$|foundation|found$|fdn|societ|soc$|college|coll$|school|council|committee|bureau|agency|ministry|museum|faculty|group|office)")
_SMALL = frozenset("of for the and at in on de la le der die das und et del von van da di al el des du dos".split())
_SAME = {"fdn": "foundation", "ctr": "centre", "center": "centre", "assn": "association", "dept": "department", "dep": "department"}
#: Pet names and the names they stand for (fixed values).
PET = {
    "alex": ("alexander", "alexandra"), "andy": ("andrew",), "tony": ("anthony",), "babs": ("barbara",), "barb": ("barbara",), "beth": ("elizabeth",), "betty": ("elizabeth",), "bill": ("william",), "billy": ("william",), "bob": ("robert",), "bobby": ("robert",), "cathy": ("catherine",), "charlie": ("charles",), "chuck": ("charles",),
    "chris": ("christopher", "christine", "christina"), "dan": ("daniel",), "danny": ("daniel",), "debbie": ("deborah",), "dick": ("richard",), "dima": ("dmitri",), "ed": ("edward",), "eddie": ("edward",), "ted": ("edward", "theodore"), "ellie": ("eleanor",), "nell": ("eleanor",), "fred": ("frederick",), "freddie": ("frederick",), "gabi": ("gabriela",),
    "gerry": ("gerald",), "greg": ("gregory",), "hal": ("henry",), "harry": ("henry", "harold"), "hank": ("henry",), "jack": ("john",), "jackie": ("jacqueline",), "jake": ("jakub", "jacob"), "jenny": ("jennifer",), "jen": ("jennifer",), "jim": ("james",), "jimmy": ("james",), "joe": ("joseph",), "joey": ("joseph",), "jon": ("jonathan",),
    "kasia": ("katarzyna",), "kate": ("catherine", "katherine"), "katie": ("catherine", "katherine"), "kathy": ("catherine", "katherine"), "kit": ("christopher",), "larry": ("lawrence",), "lars": ("lawrence",), "leo": ("leonardo",), "liz": ("elizabeth",), "lizzie": ("elizabeth",), "maggie": ("margaret",), "meg": ("margaret",), "peggy": ("margaret",),
    "matt": ("matthew",), "mike": ("michael",), "mick": ("michael",), "misha": ("mikhail",), "mimi": ("miriam",), "nick": ("nicholas", "nikolai"), "nik": ("nikolai", "nicholas"), "kolya": ("nikolai",), "pat": ("patricia", "patrick"), "patty": ("patricia",), "tricia": ("patricia",), "pippa": ("philippa",), "pip": ("philippa",), "becky": ("rebecca",),
    "rick": ("richard",), "rich": ("richard",), "rob": ("robert",), "robbie": ("robert",), "ron": ("ronald",), "ronnie": ("ronald",), "rosie": ("rosemary",), "rose": ("rosemary",), "sam": ("samuel",), "sasha": ("alexander", "alexandra"), "sandy": ("alexander", "alexandra"), "seryozha": ("sergei",), "sid": ("siddharth",),
    "steph": ("stephanie",), "steffi": ("stephanie",), "sue": ("susannah", "susan"), "susie": ("susannah", "susan"), "tanya": ("tatiana",), "theo": ("theodore",), "tim": ("timothy",), "tom": ("thomas",), "tommy": ("thomas",), "val": ("valentina",), "vicky": ("victoria",), "vic": ("victoria",), "vik": ("viktor",), "vitya": ("viktor",), "vova": ("vladimir",),
    "ronnie_": ("veronica",), "will": ("william",), "zach": ("zachary",), "zac": ("zachary",), "zack": ("zachary",), "ben": ("benjamin",), "benny": ("benjamin",), "cam": ("camille",), "deb": ("deborah",), "jess": ("jessica",), "lena": ("olena", "elena"), "nat": ("nathaniel", "natalia"), "toni": ("antonia",), "lucy": ("lucia",), "bea": ("beatriz", "beatrice"),
}


def _repair(text: str) -> str:
    """Undo letters that were decoded twice."""
    for code in ("latin-1", "cp1252"):
        if "Ã" in text or "Å" in text or "Ä" in text:
            try:
                return text.encode(code).decode("utf-8")
            except UnicodeError:
                continue
    return text


def parse(spelling: str) -> tuple[str, list[str], list[str], str, bool] | None:
    """(kind, words, initials, hint, clipped) of a spelling; None if it names nobody.

    kind is 'o' or 'p'. words of a person in the order given, surname hint: 'f' first, 'l' last,
    'c' last by a comma, '' unknown. clipped: the given name ends in a full stop.
    """
    text = _repair(" ".join(spelling.split()))
    if _NOBODY.match(text):
        return None
    acronym = re.compile(r"\(([^\W\d_]+)\)")
    text = acronym.sub(lambda m: " " if m[1].isupper() and len(m[1]) > 1 else f" {m[1]} ", text) if "(" in text else text
    text = _EXTRA.sub(" ", text)
    low = [w for w in re.findall(r"[^\W\d_]+", fold(text)) if w not in _SMALL]
    if len(low) >= 3 and any(_KIND.match(w) for w in low):
        return "o", sorted(_SAME.get(w, w) for w in low), [], "", False
    left, comma, right = text.partition(",")
    order = [*right.split(), "|", *left.split()] if comma and left.strip() and right.strip() else text.replace(",", " ").split()
    words, places, initials, after, upper, clipped, shout = [], [], [], [], [], False, text.upper() == text
    for t in order:
        if t == "|":
            places.append(len(words))
            continue
        if re.fullmatch(r"(?:[^\W\d_]\.?-?){1,4}", t) and (len(t.replace(".", "").replace("-", "")) == 1 or t.count(".") > 1 or (t.isupper() and not shout and len(t) <= 3)):
            initials += [fold(c) for c in t if c.isalpha()]
            after.append(len(words))
            continue
        w = "-".join(x for x in re.findall(r"[^\W\d_]+", fold(t)))
        if not w or w in _SMALL:
            continue
        if t.endswith(".") and not words:
            clipped = True
        if t.isupper() and not shout and len(w) > 2:
            upper.append(len(words))
        words.append(w)
    if not words:
        return None
    hint = ""
    if places:
        hint = "c"
    elif len(words) > 1 and upper == [0]:
        hint = "f"
    elif len(words) > 1 and upper == [len(words) - 1]:
        hint = "l"
    elif len(words) == 1:
        hint = "l"
    elif after and after[0] == 0:
        hint = "l"
    return "p", words, initials, hint, clipped


def form(words: list[str], initials: list[str], swap: bool) -> tuple[str, str, str]:
    """Given name ('' if only its initial is known, which then comes first), initials, surname."""
    if len(words) == 1:
        return "", "".join(initials), words[0]
    if swap:
        words = [*words[1:], words[0]]
    return words[0], "".join([*(w[0] for w in words[1:-1]), *initials]), words[-1]


def _deletions(text: str) -> set[str]:
    return {text, *(text[:k] + text[k + 1 :] for k in range(len(text)))}


def org_keys(words: list[str]) -> set[int]:
    """Two organisations that ``slip`` takes for one have a key in common.

    Words in short have the first two letters of the whole word, and a slip leaves the first two
    or the last two letters of a word; so with two slips at most, the words but two are known by
    their beginnings and these two by beginnings or ends.
    """
    size = 1 << 64
    starts = [lines.digest(w[:2]) for w in words]
    moves = [lines.digest("~" + w[-2:]) - s for w, s in zip(words, starts)]
    total = sum(starts) + lines.digest(f"#{len(words)}")
    return {total % size, *((total + x) % size for x in moves), *((total + x + y) % size for x, y in combinations(moves, 2))}


def slip(a: dict, b: dict) -> bool:
    """Whether two full forms may be one name with a slip (or, of organisations, with abbreviations)."""
    if a["kind"] != b["kind"]:
        return False
    if a["kind"] == "o":
        x, y = a["surname"].split(), b["surname"].split()
        rest = list(y)
        edits = 0
        for w in x:
            k = next((v for v in rest if v == w), None) or next((v for v in rest if len(min(v, w, key=len)) >= 2 and (v.startswith(w) or w.startswith(v))), None) or next((v for v in rest if len(w) > 4 and _near(v, w, 1)), None)
            if k is None:
                return False
            edits += not (k.startswith(w) or w.startswith(k))
            rest.remove(k)
        return not rest and edits <= 2
    if a["middle"] and b["middle"] and not (set(a["middle"]) <= set(b["middle"]) or set(b["middle"]) <= set(a["middle"])):
        return False
    if a["given"] != b["given"]:
        if a["surname"] != b["surname"]:
            return a["given"] == b["surname"] and a["surname"] == b["given"]
        return _near(a["given"], b["given"], 1) and min(a["own_given"], b["own_given"]) < OWN
    return a["surname"] == b["surname"] or (_near(a["surname"], b["surname"], 1) and min(a["own_surname"], b["own_surname"]) < OWN)


def _spellings(hits: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct spellings with their number, and the lists that hold them (title, names)."""
    creators = F.transform("creators", lambda c: F.concat_ws(" ", F.coalesce(c.firstname, F.lit("")), F.coalesce(c.lastname, F.lit(""))))
    lists = hits.select(F.col("title").cast("string").alias("title"), F.col("authors").cast("array<string>").alias("names")).unionByName(items.select(F.col("title").cast("string").alias("title"), creators.alias("names")))
    lists = lists.where("size(names) > 0").select("title", F.expr("filter(transform(names, n -> regexp_replace(n, '^\\\\s+|\\\\s+$', '')), n -> n != '')").alias("names"))
    return lists.select(F.explode("names").alias("s")).groupBy("s").agg(F.count("*").alias("n")), lists


def _count(rows: DataFrame, *cols: str) -> list[np.ndarray]:
    """Rows by the hash of each column, modulo COUNTERS; null counts nowhere."""
    out = []
    for c in cols:
        by = rows.where(F.col(c).isNotNull()).groupBy(F.expr(f"cast(pmod({c}, {COUNTERS}) as int)").alias("k")).agg(F.count("*").alias("n")).toArrow()
        x = np.zeros(COUNTERS, np.int64)
        x[by.column(0).to_numpy()] = by.column(1).to_numpy()
        out.append(x)
    return out


_at = lambda w: lines.digest(w) % COUNTERS
_FORM = "s string, n bigint, form bigint, kind string, given string, middle string, surname string, clipped boolean, sid bigint"


def _forms(spellings: DataFrame) -> DataFrame:
    """The form of each spelling."""
    spark = spellings.sparkSession

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = [], []
            for s in batch.column(0).to_pylist():
                p = parse(s)
                if p and p[0] == "p" and len(p[1]) > 1:
                    w = [*p[1][1:], p[1][0]] if p[3] == "f" else p[1]
                    first.append(lines.digest(w[0]))
                    last.append(lines.digest(w[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["first", "last"])

    shared = spark.sparkContext.broadcast(_count(spellings.select("s").mapInArrow(places, "first bigint, last bigint"), "first", "last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = shared.value
        for batch in batches:
            out = []
            for s, n in zip(*(c.to_pylist() for c in batch.columns)):
                p = parse(s)
                if p is None:
                    continue
                kind, words, initials, hint, clipped = p
                if kind == "o":
                    given, middle, surname = "", "", " ".join(words)
                else:
                    x, y = _at(words[0]), _at(words[-1])
                    swap = hint == "f" or (not hint and first[x] < last[x] and last[y] < first[y])
                    given, middle, surname = form(words, initials, swap)
                out.append((s, n, lines.digest(f"{kind}|{given}|{middle}|{surname}|{clipped}"), kind, given, middle, surname, clipped, lines.digest(s)))
            cols = list(zip(*out)) or [()] * 9
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["s", "n", "form", "kind", "given", "middle", "surname", "clipped", "sid"])

    return cut(spellings.mapInArrow(run, _FORM))


def _apart(lists: DataFrame) -> DataFrame:
    """Pairs of spellings (as hashes, both ways round) with a long word in common that one list names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, known = set(), {}
            for names in batch.column(0).to_pylist():
                by: dict[str, list[str]] = {}
                for n in names:
                    if n not in known:
                        known[n] = [w for w in re.findall(r"[^\W\d_]+", fold(_repair(n))) if len(w) > 3]
                    for w in known[n]:
                        by.setdefault(w, []).append(n)
                for same in by.values():
                    if len(same) > 1:
                        out.update((lines.digest(a), lines.digest(b)) for a, b in combinations(sorted(set(same)), 2))
            out |= {(b, a) for a, b in out}
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return lists.where("size(names) > 1").select("names").distinct().mapInArrow(run, "a bigint, b bigint").distinct()


def _works(lists: DataFrame) -> DataFrame:
    """(work, spelling hash): the spellings that lists with one title, or with the same other names, hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work, sid = [], []
            for title, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, mark, _ = title_of(title)
                keys = [lines.digest("t" + " ".join(words) + mark)] if len(words) > 3 and not mark.endswith("…") else []
                surnames = [max(re.findall(r"[^\W\d_]+", fold(_repair(n))) or [""], key=len) for n in names]
                if len(set(surnames)) > 2:
                    keys.append(lines.digest("n" + " ".join(sorted(set(surnames)))))
                for k in keys:
                    work += [k] * len(names)
                    sid += [lines.digest(n) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(work, pa.int64()), pa.array(sid, pa.int64())], names=["work", "sid"])

    return lists.distinct().mapInArrow(run, "work bigint, sid bigint").distinct()


def _slips(forms: DataFrame, apart: DataFrame) -> DataFrame:
    """``a, b``: all full forms a slip apart; every two of them share a block."""
    full = forms.where("given != '' or kind = 'o'")
    pairs = full.where("kind = 'p'").select(F.xxhash64("given").alias("g"), F.xxhash64("surname").alias("s")).distinct()
    shared = forms.sparkSession.sparkContext.broadcast(_count(pairs, "g", "s"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, kind, given, surname in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == "o":
                    out += [(k - (1 << 63), f) for k in org_keys(surname.split())]
                else:
                    ks = {f"{given} {d}" for d in _deletions(surname)} | {f"{d} {surname}" for d in _deletions(given)} | {" ".join(sorted((given, surname)))}
                    out += [(lines.digest(k), f) for k in ks]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([f for _, f in out], pa.int64())], names=["key", "form"])

    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(COUNTERS)).cast("int")
    source = full.groupBy("form").agg(*(F.first(c).alias(c) for c in ("kind", "given", "middle", "surname")))
    source = cut(source.select("form", "kind", "given", "middle", "surname", slot("given").alias("hg"), slot("surname").alias("hs")))
    by = cut(source.select("form", "kind", "given", "surname").mapInArrow(keys, "key bigint, form bigint"))
    met = by.withColumnRenamed("form", "a").join(by.withColumnRenamed("form", "b"), "key").where("a < b").select("a", "b").distinct()
    body = ("kind", "given", "middle", "surname", "hg", "hs")
    side = lambda c: source.select(F.col("form").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in body))
    met = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{c}_{x}" for c in "ab" for x in body))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_n, surname_n = shared.value
        whole = lambda kind, given, middle, surname, hg, hs: {"kind": kind, "given": given, "middle": middle, "surname": surname, "own_given": given_n[hg], "own_surname": surname_n[hs]}
        for batch in batches:
            out = []
            for a, b, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = whole(*rest[:6]), whole(*rest[6:])
                if slip(x, y) or slip(y, x):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return met.mapInArrow(verify, "a bigint, b bigint").join(apart, ["a", "b"], "left_anti")


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node that each node of all the links is connected with."""
    parts = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
    if parts:
        nodes, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        label = np.arange(len(nodes))
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], names=["a", "c"])


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``old, new``: the smallest node that each node of ``edges`` is connected with; nodes without edges keep themselves."""
    links = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    if links.count() <= LINKS:
        new = cut(links.coalesce(1).mapInArrow(_labels, "a bigint, c bigint"))
        return nodes.join(new.withColumnRenamed("a", "node"), "node", "left").select(F.col("node").alias("old"), F.coalesce("c", "node").alias("new"))
    at = cut(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select("a", "c"))
    while True:
        # the smallest label among the neighbours, then the label of the label
        near = links.join(at.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        new = at.join(near, "a").select("a", F.least("c", "m").alias("c"))
        jump = new.select(F.col("a").alias("c"), F.col("c").alias("d"))
        new = cut(new.join(jump, "c", "left").select("a", F.coalesce(F.least("c", "d"), "c").alias("c")))
        if not new.join(at.withColumnRenamed("c", "o"), "a").where("c != o").limit(1).count():
            return nodes.join(new.withColumnRenamed("a", "node"), "node", "left").select(F.col("node").alias("old"), F.coalesce("c", "node").alias("new"))
        at = new


#: What a row of a key is, in the order in which the rows of a key are read.
KNOWN, ASK, THERE, HERE, NAMED = range(5)
_KEYED = "k bigint, role int, m string, form bigint"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [()] * 4
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["k", "role", "m", "form"])


def _keyed(forms: DataFrame, people: DataFrame, works: DataFrame) -> DataFrame:
    """``k, role, m, form``: what does not change as profiles merge.

    ASK and KNOWN: short forms and the full forms that they may fit, by initial (and middle
    initial), by a clipped name, by a pet name. HERE and THERE: short and full forms in the lists
    of one work, with their middle initials.
    """
    full = people.where("given != ''")
    owned = full.groupBy("given").agg(F.countDistinct("surname").alias("own"))
    met = full.select("surname", F.substring("given", 1, 1).alias("i")).distinct().withColumn("met", F.lit(True))
    facts = people.withColumn("i", F.when(F.col("given") == "", F.substring("middle", 1, 1)).otherwise(F.substring("given", 1, 1)))
    facts = facts.join(owned, "given", "left").join(met, ["surname", "i"], "left").select("form", "given", "middle", "surname", "clipped", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("met", F.lit(False)).alias("met"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, given, middle, surname, clipped, own, met in zip(*(c.to_pylist() for c in batch.columns)):
                put = lambda role, *key: out.append((lines.digest("|".join(key)), role, "", f))  # noqa: B023, E731
                if not given:
                    if middle:
                        put(ASK, "#m", surname, middle[0], middle[1]) if len(middle) > 1 else put(ASK, "#i", surname, middle[0])
                        if not met:  # an initial whose surname no profile has: surnames a letter away
                            for d in _deletions(surname):
                                put(ASK, "#d", middle[0], d)
                    continue
                put(KNOWN, "#i", surname, given[0])
                put(KNOWN, "#p", surname, given)
                if len(given) > 3:
                    put(KNOWN, "#c", surname, given[:3])
                for d in _deletions(surname):
                    put(KNOWN, "#d", given[0], d)
                for whole in PET.get(given, ()):
                    put(ASK, "#p", surname, whole)
                if (len(given) == 3 or (clipped and len(given) > 2)) and (clipped or own < OWN * 4):
                    put(ASK, "#c", surname, given[:3])
            yield _rows(out)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for work, f, given, middle, surname in zip(*(c.to_pylist() for c in batch.columns)):
                if given or middle:
                    out.append((lines.digest(f"#w|{work}|{surname}|{(given or middle)[0]}"), THERE if given else HERE, middle[:1] if given else middle[1:2], f))
            yield _rows(out)

    keyed = cut(facts.mapInArrow(keys, _KEYED))
    asked = keyed.where(f"role = {KNOWN}").join(keyed.where(f"role = {ASK}").select("k").distinct(), "k", "left_semi")
    at = works.join(forms.where("kind = 'p'").select("sid", "form", "given", "middle", "surname"), "sid").select("work", "form", "given", "middle", "surname")
    return cut(keyed.where(f"role = {ASK}").unionByName(asked).unionByName(at.mapInArrow(seen, _KEYED).distinct()))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of profiles that hang on all their forms: names with middle initials, initials of two names."""
    for batch in batches:
        out = []
        for comp, names, middles in zip(*(c.to_pylist() for c in batch.columns)):
            for x in names:
                given, surname = x["given"], x["surname"]
                k = lines.digest(f"#n|{given}|{surname}")
                out += [(k, NAMED, m, comp) for m in middles or ("",)]
                out += [(lines.digest(f"#m|{surname}|{given[0]}|{m}"), KNOWN, "", comp) for m in middles]
        yield _rows(out)


def _merge(k: list[tuple[int, str, int]]) -> list[tuple[int, int, int]]:
    """``a, b, level`` of the rows of one key: 0 a fit, 1 a vote, 2 a merge."""
    out = []
    known = sorted({c for role, _, c in k if role == KNOWN})
    for a in {c for role, _, c in k if role == ASK} if known else ():
        # a pet or clipped name is itself among the profiles that its key may meet, so it is left out of the count
        x, y = known[known[0] == a :][:1], known[: -1 if known[-1] == a else None][-1:]
        out += [(a, b, 0) for b in {*x, *y}]
    there = {(c, m) for role, m, c in k if role == THERE}
    for a, m in {(c, m) for role, m, c in k if role == HERE} if there else ():
        fit = [c for c, n in there if not m or not n or m == n]
        out += [(a, b, 1) for b in {min(fit), max(fit)}] if fit else []
    named = {(c, m) for role, m, c in k if role == NAMED}
    # the same given name and surname: all of them if one middle initial is known at most, else those with the same
    kinds = {m for _, m in named if m}
    for m in kinds if len(kinds) > 1 else ("",):
        same = {c for c, n in named if len(kinds) < 2 or n == m}
        out += [(c, min(same), 2) for c in same if c != min(same)]
    return out


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, level`` of rows sorted by key."""
    last, rows = None, []
    for batch in batches:
        out = []
        for k, role, m, c in zip(*(c.to_pylist() for c in batch.columns)):
            if k != last:
                out += _merge(rows) if len(rows) > 1 else []
                last, rows = k, []
            rows.append((role, m, c))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], names=["a", "b", "level"])
    out = _merge(rows) if len(rows) > 1 else []
    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], names=["a", "b", "level"])


def _round(people: DataFrame, keyed: DataFrame, comps: DataFrame, apart: DataFrame) -> DataFrame:
    """``a, b``: profiles that the present profiles' names and initials merge."""
    middles = F.collect_set(F.when(F.col("middle") != "", F.substring("middle", 1, 1)))
    profiles = people.where("given != ''").join(comps, "form").groupBy("comp").agg(F.collect_set(F.struct("given", "surname")).alias("names"), middles.alias("middles"))
    of = keyed.join(comps, "form").select("k", "role", "m", F.col("comp").alias("form"))
    rows = of.unionByName(profiles.mapInArrow(_profiles, _KEYED))
    met = rows.repartition("k").sortWithinPartitions("k").mapInArrow(_by_key, "a bigint, b bigint, level bigint")
    # a short form that fits one profile only goes there, else where the lists of its works have one profile only
    one = lambda level: F.when(F.min(F.when(F.col("level") == level, F.col("b"))) == F.max(F.when(F.col("level") == level, F.col("b"))), F.min(F.when(F.col("level") == level, F.col("b"))))
    met = met.withColumn("c", F.when(F.col("level") == 2, F.col("b"))).groupBy("a", "c").agg(F.coalesce("c", one(0), one(1)).alias("b")).where("b is not null and a != b").select("a", "b")

    ids = comps.select(F.col("form").alias("a"), F.col("comp").alias("ca"))
    split = apart.join(ids, "a").join(comps.select(F.col("form").alias("b"), F.col("comp").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    return met.join(split, ["a", "b"], "left_anti")


def entities(hits: DataFrame, items: DataFrame) -> DataFrame:
    """``name, entity``: the entity of each spelling."""
    spellings, lists = _spellings(hits, items)
    forms = _forms(spellings)
    lists = cut(lists)
    of = forms.select("sid", "form").distinct()
    apart = _apart(lists)
    apart = cut(apart.join(of.select(F.col("sid").alias("a"), F.col("form").alias("fa")), "a").join(of.select(F.col("sid").alias("b"), F.col("form").alias("fb")), "b").where("fa != fb").select(F.col("fa").alias("a"), F.col("fb").alias("b")).distinct())
    works = cut(_works(lists))
    edges = cut(_slips(forms, apart))
    nodes = forms.select(F.col("form").alias("node")).distinct()
    comps = cut(_components(nodes, edges).select(F.col("old").alias("form"), F.col("new").alias("comp")))
    people = cut(forms.where("kind = 'p'").select("form", "given", "middle", "surname", "clipped").distinct())
    keyed = _keyed(forms, people, works)
    while True:  # a round that merges leaves fewer profiles
        merge = cut(_round(people, keyed, comps, apart))
        if not merge.limit(1).count():
            break
        moved = _components(comps.select(F.col("comp").alias("node")).distinct(), merge)
        comps = cut(comps.join(moved.withColumnRenamed("old", "comp"), "comp").select("form", F.col("new").alias("comp")))
    return forms.join(comps, "form").select(F.col("s").alias("name"), F.col("comp").alias("entity"))


def found(hits: DataFrame, items: DataFrame) -> DataFrame:
    """``name_a, name_b``: every pair of spellings of one entity."""
    e = cut(entities(hits, items))
    a, b = e.select("entity", F.col("name").alias("name_a")), e.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
