"""Okapi BM25 over whole documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B, EPSILON = 1.5, 0.75, 0.25
#: What Python's \\W+ splits at.
NO_WORD = r"[^\pL\pN_]+"


def words(text):
    """The lower-case words of a text, in order and without stop words; none for a null text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), NO_WORD), F.lower), lambda w: w != "")


def scores(documents: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` that hold a term, with their ``score``; every document counts for the statistics.

    A negative idf becomes a quarter of the mean idf over the whole vocabulary.
    """
    docs = documents.withColumn("_w", words(F.col(text_col)))
    size = docs.agg(F.count("*").cast("double").alias("_n"), F.avg(F.size("_w")).alias("_avg"))
    df = docs.select(F.explode(F.array_distinct("_w")).alias("_t")).groupBy("_t").agg(F.count("*").cast("double").alias("_df"))
    idf = df.crossJoin(F.broadcast(size)).withColumn("_idf", F.log(F.col("_n") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5))
    stats = idf.agg(F.first("_avg").alias("_avg"), F.avg("_idf").alias("_mean"), *(F.max(F.when(F.col("_t") == t, F.col("_idf"))).alias(f"_i{k}") for k, t in enumerate(terms)))

    def part(k: int, term: str):
        f = F.size(F.filter("_w", lambda w: w == term))
        weight = F.when(F.col(f"_i{k}") < 0, EPSILON * F.col("_mean")).otherwise(F.coalesce(F.col(f"_i{k}"), F.lit(0.0)))
        return weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.size("_w") / F.col("_avg")))

    holds = reduce(lambda a, b: a | b, (F.array_contains("_w", t) for t in terms))
    found = docs.where(holds).crossJoin(F.broadcast(stats))
    return found.select(*documents.columns, reduce(lambda a, b: a + b, (part(k, t) for k, t in enumerate(terms))).alias("score"))
