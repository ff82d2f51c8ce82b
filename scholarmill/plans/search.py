"""Keyword search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmill.operators import bm25
from scholarmill.session import table

TERMS = ["threshold", "sampling", "glacier"]


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for three terms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    best = bm25.scores(docs, TERMS).select("doc_id", F.round("score", 4).alias("score"), "lang", "source")
    return best.orderBy(F.desc("score"), "doc_id").limit(10)


QUERIES = {"bm25_top": bm25_top}

ORACLE = {
    "bm25_top": r"""
WITH d AS (SELECT doc_id, lang, source, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[^\pL\pN_]+'), lambda w: w <> ''), lambda w: lower(w)) AS w FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM d),
t AS (SELECT t, count(*)::DOUBLE AS df FROM (SELECT unnest(list_distinct(w)) AS t FROM d) GROUP BY t),
i AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM t, s),
q AS (SELECT t, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i) ELSE idf END AS idf FROM i WHERE t IN ('threshold', 'sampling', 'glacier')),
f AS (SELECT doc_id, lang, source, len(w) AS dl, q.idf, len(list_filter(w, lambda x: x = q.t)) AS tf FROM d, q)
SELECT doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score, lang, source
FROM f, s WHERE tf > 0 GROUP BY doc_id, lang, source ORDER BY score DESC, doc_id LIMIT 10""",
}
