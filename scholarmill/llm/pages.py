"""The article's own lines of a page text (problem 4).

Every line goes through the standard library's HTML parser, whose events give its text and its
tags. The texts at hand are stripped, so that most tags are gone; what stands in for them is
what the tags left behind: separators of a menu, list marks of a menu, and the missing sentence
end of a line that was a link or a button of its own. The text-to-tag ratio of the lines is
smoothed by a Gaussian, and a threshold from clustering into two splits lines into content and
the rest; runs of content are regions. An exact check follows: in and next to a region a line
stays if it is a paragraph, a heading, a caption, a list item, a reference or keywords; the
title stays. Headings are those that the sections of the corpus name, and lines that recur on
many pages are no titles.

Defined results: a null or blank text and a text of one line have no line to leave out; blank
lines are never given; repeated rows give their lines again; null sections, metadata and titles
are allowed; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmill.llm import lines, residue

#: A heading, or a line that recurs, is one of so large a share of the pages and of so many at
#: least; no more than lines-per-page / SHARE can be, which bounds what goes to the executors.
SHARE, LEAST_HEADING, LEAST_LINE = 0.001, 2, 5
SIGMA, NEAR = 1.0, 4
PARAGRAPH_WORDS, NOTICE_WORDS = 5, 20

_SEPARATOR = re.compile(r"\s[|·›>/—»]\s|\S {2,}\S|^\s*[*☰»]\s?")
_NUMBER = re.compile(r"^(?:\d+(?:\.\d+)*|[IVX]+)[.)]?\s+")
_CAPTION = re.compile(r"^(?:Table|Fig\.?|Figure|Tab\.?|Abb\.?|Abbildung|Tabelle|Tableau|Figura|Tabla|Cuadro|Box|Scheme|Appendix|Anhang|Annexe|Apéndice)\s*(?:\d+|[A-Z]\b)", re.I)
_REFERENCE = re.compile(r"\((?:1[5-9]|20)\d\d[a-z]?\)|\d+\(\d+\):\d+|doi\.org/|^\[\d+\]\s")
_ITEM = re.compile(r"^\s*(?:[•–‣▪◦-]\s|\(?[a-z\d]{1,2}\)\s)")
_KEYWORDS = re.compile(r"^(?:keywords|mots[- ]clés|schlagwörter|palabras clave|received|abstract|acknowledge?ments?)\b", re.I)
_SENTENCE = re.compile(r"[.!…:;]['\"”’»)\]]*$")
_TEASER = re.compile(r"\(\d[\d,.]* (?:views|Aufrufe|vues|visitas|lecturas)\)$|, (?:19|20)\d\d$|\D [A-ZÀ-Þ]\w+, \d{4}$")
_LABEL = re.compile(r"^[^\W\d][\w' -]{3,30}: (?=[A-ZÀ-Þ])")
_ENTITY = re.compile(r"[<&]")


class _Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.text = 0, []

    def handle_starttag(self, tag, attrs):
        self.tags += 1

    def handle_endtag(self, tag):
        self.tags += 1

    def handle_data(self, data):
        self.text.append(data)


def _events(line: str) -> tuple[str, int]:
    """Text and tags of a line; lines without markup need no parser."""
    if not _ENTITY.search(line):
        return line, 0
    p = _Events()
    p.feed(line)
    p.close()
    return "".join(p.text), p.tags


def key(line: str) -> int:
    """The hash of a line but for its number, names and figures."""
    return lines.digest(lines.mask(_NUMBER.sub("", line.strip())))


def content_lines(ratio: np.ndarray) -> np.ndarray:
    """Which lines are content: smoothed log ratios above the threshold of two clusters."""
    x = np.log1p(ratio)
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    smooth = np.convolve(np.pad(x, 3, mode="edge"), kernel / kernel.sum(), mode="valid")
    low, high = smooth.min(), smooth.max()
    for _ in range(20):
        cut = (low + high) / 2
        up = smooth > cut
        if up.all() or not up.any():
            break
        new = smooth[~up].mean(), smooth[up].mean()
        if np.allclose(new, (low, high)):
            break
        low, high = new
    return smooth > (low + high) / 2 if high > low else np.ones(len(x), bool)


def _title(at: list[tuple[int, str]], kinds: list[str], first: int, recurring: set[int]) -> int:
    """Which line before the first paragraph or heading is the title; ``first`` if there is none."""
    if "title" in kinds[: first + 1]:
        return kinds.index("title")
    plain = [at[n][1].strip() for n in range(first)]
    bar = [bool(_SEPARATOR.search(x) or residue.FURNITURE.search(x.lower())) for x in plain]
    after = max((n + 1 for n in range(first) if bar[n]), default=0)
    for n in [*range(after, first), *range(after)]:
        if " " in plain[n] and not (bar[n] or _TEASER.search(plain[n]) or key(plain[n]) in recurring):
            return n
    return after if 0 < after < first else max(0, first - 1)


def left_out(text: str, title: str | None, own: set[str], headings: set[int], recurring: set[int]) -> list[int]:
    """Numbers of the non-blank lines of ``text`` that are not the article's own."""
    at = [(k, line) for k, line in enumerate(text.split("\n")) if line.strip()]
    if len(at) < 2:
        return []
    kinds, ratio = [], np.zeros(len(at))
    title = " ".join((title or "").split()).lower()
    for n, (_, line) in enumerate(at):
        plain, tags = _events(line)
        plain = plain.strip()
        w = plain.count(" ") + 1
        menu = len(_SEPARATOR.findall(plain))
        ended = bool(_SENTENCE.search(plain))
        low = plain.lower()
        if low == title and title and "title" not in kinds:
            kind = "title"
        elif plain in own or key(plain) in headings:
            kind = "heading"
        elif ended and w >= PARAGRAPH_WORDS and not (w <= NOTICE_WORDS and (residue.FURNITURE.search(low) or residue.is_message(plain))):
            kind = "paragraph"
        elif _CAPTION.match(plain) or _KEYWORDS.match(low):
            kind = "caption"
        elif _REFERENCE.search(plain) and w > 5:
            kind = "reference"
        elif _ITEM.match(line):
            kind = "item"
        elif w > 40:
            kind = "paragraph"
        else:
            kind = ""
        tags += menu + (not ended and kind not in ("paragraph", "reference", "title"))
        kinds.append(kind)
        ratio[n] = w / (1 + tags)
    dense = content_lines(ratio)
    core = [n for n in range(len(at)) if dense[n] and kinds[n] in ("paragraph", "reference")] or [n for n in range(len(at)) if kinds[n] == "paragraph"]
    keep = np.zeros(len(at), bool)
    if core:
        last, ahead = -NEAR - 1, iter([*core, len(at) + NEAR + 1])
        then = next(ahead)
        for n, kind in enumerate(kinds):
            if then < n:
                then = next(ahead)
            if kind and (n - last <= NEAR or then - n <= NEAR or kind in ("paragraph", "heading")):
                keep[n], last = True, n
        first = next(n for n, k in enumerate(kinds) if k in ("paragraph", "heading"))
        keep[_title(at, kinds, first, recurring)] = True
    return [k for (k, _), ok in zip(at, keep.tolist()) if not ok]


def _vocabulary(pages: DataFrame) -> tuple[set[int], set[int]]:
    """Hashes of the headings and of the recurring lines of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, head = [], []
            for text, titles in zip(batch.column(0), batch.column(1)):
                titles = {key(t) for t in titles.as_py() or () if t and t.strip()}
                own = {key(x) for x in (text.as_py() or "").split("\n") if x.strip() and x.count(" ") < 14} - titles
                h += [*titles, *own]
                head += [True] * len(titles) + [False] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(head, pa.bool_())], names=["h", "head"])

    source = pages.select("text", "titles")
    n = F.broadcast(pages.agg(F.count("*").alias("pages")))
    by = source.mapInArrow(run, "h bigint, head boolean").groupBy("h", "head").agg(F.count("*").alias("n")).crossJoin(n)
    least = F.greatest(F.col("pages") * SHARE, F.when(F.col("head"), LEAST_HEADING).otherwise(LEAST_LINE))
    rows = by.where(F.col("n") >= least).select("h", "head").collect()
    return {r.h for r in rows if r.head}, {r.h for r in rows if not r.head}


def found(articles: DataFrame, without: DataFrame | None = None, id_col: str = "article_id") -> DataFrame:
    """``id_col, line_no`` of the lines around the articles, in rows with html_path; rows of ``without`` are left out."""
    pages = articles.where("html_path is not null").select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("sections.title").cast("array<string>").alias("titles"), F.col("metadata.title").cast("string").alias("title"))
    shared = pages.sparkSession.sparkContext.broadcast(_vocabulary(pages))
    if without is not None:
        pages = pages.join(without.select(F.col(id_col).cast("long").alias("id")), "id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headings, recurring = shared.value
        for batch in batches:
            ids, nos = [], []
            for i, text, titles, title in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                out = left_out(text.as_py() or "", title, {t.strip() for t in titles or () if t and t.strip()}, headings, recurring)
                ids += [i] * len(out)
                nos += out
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], names=[id_col, "line_no"])

    return pages.select("id", "text", "titles", "title").mapInArrow(run, f"{id_col} bigint, line_no int")


def main_text(articles: DataFrame, lines_out: DataFrame, id_col: str = "article_id") -> DataFrame:
    """``id_col`` and ``main``: each page's text without the lines that ``found`` gave."""
    out = lines_out.groupBy(id_col).agg(F.collect_set("line_no").alias("_out"))
    split = articles.where("html_path is not null").select(F.col(id_col).cast("long").alias(id_col), F.split("text", "\n").alias("_l")).join(out, id_col, "left")
    kept = F.filter("_l", lambda x, k: ~F.coalesce(F.array_contains("_out", k), F.lit(False)))
    return split.select(id_col, F.array_join(kept, "\n").alias("main"))
