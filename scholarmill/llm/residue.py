"""Records that hold template residue, filler, errors or barriers, and no article (problem 7).

Each text falls into sentences. Numbers, addresses, dates and inner names are masked and the
masked sentences hashed; hashes are counted over all records and sources. A sentence counts as
a message if phrase or placeholder rules say so, or if its hash recurs in MIN_RECORDS records of
MIN_SOURCES sources and most of them have next to nothing else (an article's own phrases recur
too, but in records that are full of other sentences). A record without a single sentence of
content is found.

Defined results: a null, empty or blank text holds nothing and is not found; repeated rows are
each found; texts are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmill.llm import lines
from scholarmill.session import cut

#: A record with so few sentences of content is poor; a message has so many words at most.
POOR, MESSAGE_WORDS = 3, 16
MIN_RECORDS, MIN_SOURCES, POOR_SHARE = 4, 2, 0.6
MIN_WORDS, COMMON_SHARE, FILLER_SHARE = 4, 0.06, 0.3

PLACEHOLDER = re.compile(
    r"\{\{|\}\}|\{%|%\}|\$\{|<%|%>|%\(\w+\)s|%%\w+%%|@@\w+@@|\[\[\w+\]\]|#\{\w+\}|\{\d+\}|__\w+__|\[object \w+\]|\w+_PLACEHOLDER|(?:<|&lt;)!--|\b(?:undefined|NaN|null)\b|\b(\w{1,4})(?: \1){2,}\b"
    r"|\[(?:[Ii]nsert|[Yy]our|[Ii]nsérer|[Ii]nsert[ae]r?|[Ee]scriba|[Hh]ier|[Tt]ext|[Ee]nter|[Tt]ype)\b[^\]]*\]|\b(?:TODO|TBD|FIXME)\b|(?i:\b(?:sample|dummy|placeholder) text|(?:type|enter|insert|replace) (?:your|with|section|text|here)\b|author name|lorem ipsum)"
)
MESSAGE = re.compile(
    r"\b(?:error|http) ?[1-5]\d\d\b|^\W*[45]\d\d\b(?!\s+(?:[a-zà-ÿ]+ ){2})|bad gateway|internal (?:server )?error|erreur interne|interner fehler|error interno|unexpected error"
    r"|not (?:be )?found|(?:nicht|wurde nicht) gefunden|introuvable|no (?:se ha )?encontrad"
    r"|(?:do|does) not have (?:permission|access)|nicht gestattet|access (?:\w+ ){0,4}denied|accès (?:refusé|interdit)|acceso denegado|forbidden|unauthori[sz]ed|purchase access|subscribers only|to (?:read|view|see) (?:the full|this)|log(?:ged)? (?:in again|out)|session (?:has )?expired"
    r"|unable to service|unavailable|nicht erreichbar|indisponible|no disponible|maintenance|wartungsarbeiten|mantenimiento|outage|be back shortly"
    r"|javascript|noscript|scripting|and scripts must|enable cookies|does not support|newer viewer|loaded dynamically|rendering page"
    r"|verify that you|you are a human|captcha|security check|unusual traffic|is being checked|one moment|select every|process is automatic|too many (?:requests|connections)"
    r"|moved or withdrawn|may be out of date|try again|wait and retry|problem persists|help desk|please wait|failed to load|being (?:prepared|loaded)|go back|return to the home|zurück zur startseite|retour à l.accueil|volver al inicio|redirecting|incident number|^\W*reference: \w|^\W*ray [0-9a-f]+|forgot password|remember me"
    r"|traceback|exception\b|\w+error:|^warning:|^fatal error|undefined function|\bora-\d|^\s*at [\w.$]+\(|^\s*file \"/|this page is blank|page intentionally"
)
FURNITURE = re.compile(
    r"cookies?\b|privacy matters|rights reserved|rechte vorbehalten|droits réservés|derechos reservados|@email|institutional access|zugang über|accès fourni|acceso ofrecido|is registered in|on behalf of the|newsletter|last updated|powered by|issn \d|all rights"
)
#: Words of the usual filler text (fixed values).
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed eiusmod tempor incididunt ut labore dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "vero iusto autem facere vitae porro harum fugit eaque minus quos sequi optio ratione velum dicta animi modi soluta ullam illum natus quasi rerum cumque".split()
)
_END = re.compile(r"[.!…][\"'”»)\]]*\s*$")
_MARK = re.compile(r"[{}\[\]$@#_<&]|%[%>}(]")


#: Each alternative of MESSAGE and FURNITURE has one of these words; the rules run only where one occurs.
_CUES = frozenset(
    "error erreur fehler http gateway found gefunden introuvable encontrado encontrada permission access accès acceso gestattet forbidden unauthorized unauthorised subscribers read view see log logged session unable unavailable erreichbar indisponible disponible maintenance wartungsarbeiten mantenimiento outage shortly "
    "javascript noscript scripting scripts viewer dynamically rendering verify human captcha security traffic checked moment select automatic requests connections moved date try retry wait failed prepared loaded persists help back home startseite accueil inicio redirecting incident reference ray password remember traceback exception warning undefined ora file page blank support "
    "cookie cookies privacy reserved vorbehalten réservés reservados email institutional zugang fourni ofrecido registered behalf newsletter updated powered issn rights nullpointerexception".split()
)
_PLACE_CUES = frozenset("todo tbd fixme nan null type enter insert replace sample dummy placeholder lorem author undefined".split())


def is_message(s: str) -> bool:
    """Whether phrase or placeholder rules take a line or sentence for residue."""
    return bool(PLACEHOLDER.search(s) or MESSAGE.search(s.lower()))


def content(s: str) -> bool:
    """Whether a sentence may be an article's own: a sentence of a language that no rule takes for something else."""
    if not _END.search(s):
        return False
    w = lines.words(s)
    if len(w) < MIN_WORDS:
        return False
    common = sum(x in lines.COMMON for x in w)
    if common < max(1, COMMON_SHARE * len(w)) or sum(x in FILLER for x in w) > FILLER_SHARE * len(w):
        return False
    if (_MARK.search(s) or not _PLACE_CUES.isdisjoint(w)) and PLACEHOLDER.search(s):
        return False
    low = s.lower() if not _CUES.isdisjoint(w) or s.lstrip()[:1] in "45" else ""
    return not (low and (MESSAGE.search(low) or FURNITURE.search(low)))


def _parts(articles: DataFrame, id_col: str) -> DataFrame:
    """Per record: its sentences of content as counted locally, and the hashes of the short ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hashes, blank = [], [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                own = [s for s in lines.sentences(text) if content(s)]
                n.append(len(own))
                hashes.append(sorted({lines.digest(lines.mask(s)) for s in own if s.count(" ") < MESSAGE_WORDS}))
                blank.append(not text.strip())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(hashes, pa.list_(pa.int64())), pa.array(blank)], names=["id", "source", "n", "hashes", "blank"])

    source = articles.select(F.col(id_col).cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("text").cast("string"))
    return source.mapInArrow(run, "id bigint, source string, n int, hashes array<bigint>, blank boolean")


def messages(parts: DataFrame) -> DataFrame:
    """Hashes of the recurring sentences that most records hold instead of an article.

    Only hashes of poor records are looked up in the rest. Two steps count the sources: by
    hash and source, then by hash, so that a message in a third of all records is summed up
    before it moves.
    """
    poor = F.col("n") <= POOR
    few = parts.where(poor).select(F.explode("hashes").alias("h"), "source").groupBy("h", "source").agg(F.count("*").alias("k"))
    few = few.groupBy("h").agg(F.sum("k").alias("poor"), F.count("*").alias("sources")).where((F.col("poor") >= MIN_RECORDS) & (F.col("sources") >= MIN_SOURCES))
    rest = parts.where(~poor).select(F.explode("hashes").alias("h")).join(few.select("h"), "h", "left_semi").groupBy("h").agg(F.count("*").alias("rich"))
    return few.join(rest, "h", "left").where(F.col("poor") >= POOR_SHARE * (F.col("poor") + F.coalesce("rich", F.lit(0)))).select("h")


def found(articles: DataFrame, id_col: str = "article_id") -> DataFrame:
    """``id_col`` of every record whose text has no article content."""
    parts = cut(_parts(articles, id_col))
    poor = parts.where((F.col("n") <= POOR) & ~F.col("blank")).withColumn("row", F.monotonically_increasing_id())
    hit = poor.select("row", F.explode("hashes").alias("h")).join(messages(parts), "h").groupBy("row").agg(F.count("*").alias("hits"))
    rows = poor.join(hit, "row", "left").where(F.col("n") <= F.coalesce("hits", F.lit(0)))
    return rows.select(F.col("id").alias(id_col))
