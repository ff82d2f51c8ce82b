"""The training-data queries of TESTDATA.md that are built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholarmill.llm import best, ends, leaks, linkage, names, pages, residue, scans, spam, tokens
from scholarmill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one person or organisation."""
    return names.found(table(spark, sf_dir, "search_hits"), table(spark, sf_dir, "zotero_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text has lost its end."""
    return ends.found(table(spark, sf_dir, "paper_contents"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each source have lost their end."""
    return ends.shares(table(spark, sf_dir, "paper_contents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and catalogue records of the same work."""
    return p3_matches(spark, sf_dir).select("hit_id", "rec_id")


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and catalogue records of the same work, each pair with its confidence."""
    return linkage.matches(table(spark, sf_dir, "search_hits"), table(spark, sf_dir, "catalog_records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of web pages that are not their article's own."""
    articles = table(spark, sf_dir, "cached_articles")
    return pages.found(articles, residue.found(articles))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit that gives each field of each group its best value."""
    return best.found(table(spark, sf_dir, "search_hits"), table(spark, sf_dir, "hit_groups"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of scans with the marks of the page and of misreading."""
    return scans.found(table(spark, sf_dir, "cached_articles"), table(spark, sf_dir, "paper_contents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached articles without an article."""
    return residue.found(table(spark, sf_dir, "cached_articles"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every row of documents."""
    return tokens.encode(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of an evaluation item."""
    return leaks.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of keywords, links or product tags."""
    return spam.found(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_shares": p2_shares, "p3_found": p3_found, "p3_matches": p3_matches, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All training-data queries."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """None of them has a counterpart in SQL."""
    return {}
