"""The best record of each group of hits (problem 5).

A hit is a candidate for a field if its value passes the field's conditions. Of a group's
candidates those stay that no other one dominates (the first skyline layer, where every
lexicographic winner lies); the field's policy, then the smallest hit_id, picks one. Each
field is filled from its own hit, and is null where the group has no candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that name a periodical or a series; publishers and preprint servers have none.
SERIES = r"(?iU)\b(journal|annals|review|bulletin|archives?|transactions|proceedings|quarterly|letters|studies|magazine|zeitschrift|revue|revista|annales)\b"
ABBREVIATED = r"\.|\d|…|\b(?i:of|on|the|and|for|in)$"
FOREIGN = r"(?iU)^\[[^\]]*preview|^(keywords|mots[- ]clés|schlagwörter|palabras clave)\b"
ENTIRE = r"""(?<!\.\.)[.!?]["'”’»)\]]*$"""
CUT = r"(\.\.\.|…|\[…\]|\[\.\.\.\]|\(more\))$"
MIN_WORDS = 6


def _full_venues(hits: DataFrame) -> DataFrame:
    """Full names in ordinary spelling; none that is the beginning of another or ends in a piece of a commoner word."""
    v = F.col("venue")
    full = v.rlike(SERIES) & ~v.rlike(ABBREVIATED) & (v != F.upper(v)) & (v != F.lower(v))
    names = hits.select(F.trim("venue").alias("venue")).where(full).distinct()
    starts = names.select(F.explode(F.expr("transform(sequence(1, length(venue)), n -> rtrim(left(venue, n)))")).alias("start"), "venue")
    words = names.select(F.explode(F.split("venue", " ")).alias("last")).groupBy("last").agg(F.count("*").alias("n"))
    pieces = words.where(F.length("last") > 1).select(F.explode(F.expr("transform(sequence(1, length(last) - 1), k -> left(last, k))")).alias("last"), "n")
    pieces = pieces.groupBy("last").agg(F.max("n").alias("whole")).join(words, "last").where("whole > n").select("last")
    names = names.withColumn("last", F.substring_index("venue", " ", -1)).join(pieces, "last", "left_anti").drop("last")
    return names.join(starts.where(F.col("start") != F.col("venue")).select(F.col("start").alias("venue")).distinct(), "venue", "left_anti")


def _best(layer: str, dims: list[str]) -> Column:
    """hit_id of the candidate in array ``layer`` that the policy ``dims`` (falling), then hit_id, picks."""
    no_less, more = " and ".join(f"y.{d} >= x.{d}" for d in dims), " or ".join(f"y.{d} > x.{d}" for d in dims)
    skyline = f"filter({layer}, x -> not exists({layer}, y -> {no_less} and ({more})))"
    order = " ".join(f"when a.{d} > b.{d} then -1 when a.{d} < b.{d} then 1" for d in dims)
    return F.expr(f"array_sort({skyline}, (a, b) -> case {order} when a.hit_id < b.hit_id then -1 when a.hit_id > b.hit_id then 1 else 0 end)[0].hit_id")


def records(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group: abstract, citations, venue, the hit each comes from, and all of found_in."""
    text = F.regexp_replace(F.coalesce("abstract", F.lit("")), r"^(?U)\s+|(?U)\s+$", "")
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\pL\pN]+", " "))
    own = ~text.rlike(FOREIGN) & (F.size(F.split(words, " ")) >= MIN_WORDS)
    h = groups.select("group_id", "hit_id").join(hits.select("hit_id", "abstract", "citations", "venue", "found_in", "retrieved_at"), "hit_id")
    h = h.withColumn("venue", F.trim("venue")).join(_full_venues(hits).withColumn("full", F.lit(True)), "venue", "left")
    # the words of a cut text but for its last, which may be a piece
    cut = F.regexp_replace(text, CUT, "")
    kept = F.when(text.rlike(ENTIRE) & ~text.rlike(CUT), words).otherwise(F.regexp_replace(F.trim(F.regexp_replace(F.lower(cut), r"[^\pL\pN]+", " ")), r" ?\S+$", ""))
    h = h.withColumn("words", F.when(own, words)).withColumn("kept", F.when(own, kept)).withColumn("entire", own & text.rlike(ENTIRE) & ~text.rlike(CUT))
    row = F.struct("hit_id", "abstract", "citations", "venue", "found_in", "full", "words", "kept", "entire", F.coalesce("retrieved_at", F.timestamp_micros(F.lit(0))).alias("at"))
    g = h.groupBy("group_id").agg(F.sort_array(F.collect_list(row)).alias("m"))
    # an entire text is not the beginning of another; it is borne out by the hits that hold it or its beginning
    g = g.withColumn("_a", F.expr("""transform(filter(m, x -> x.entire and not exists(m, y -> y.words is not null and startswith(y.words, x.words || ' '))),
        x -> struct(x.hit_id as hit_id, size(filter(m, y -> coalesce(startswith(x.words, y.kept), false))) as support, length(x.words) as size))"""))
    g = g.withColumn("_v", F.expr("transform(filter(m, x -> x.full), x -> struct(x.hit_id as hit_id, size(filter(m, y -> coalesce(lower(y.venue) = lower(x.venue), false))) as support, length(x.venue) as size))"))
    g = g.withColumn("_c", F.expr("transform(filter(m, x -> x.citations > 0), x -> struct(x.hit_id as hit_id, x.at as at))"))
    for field, layer, dims in (("abstract", "_a", ["support", "size"]), ("venue", "_v", ["support", "size"]), ("citations", "_c", ["at"])):
        g = g.withColumn(f"{field}_hit", F.when(F.size(layer) > 0, _best(layer, dims)))
        g = g.withColumn(field, F.expr(f"case when {field}_hit is not null then filter(m, x -> x.hit_id = {field}_hit)[0].{field} end"))
    g = g.withColumn("found_in", F.expr("array_sort(array_distinct(filter(flatten(transform(m, x -> coalesce(x.found_in, cast(array() as array<string>)))), f -> f is not null)))"))
    return g.select("group_id", "abstract", "citations", "venue", "found_in", "abstract_hit", "citations_hit", "venue_hit")


def found(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """``group_id, field, hit_id`` of every field that its group has."""
    r = records(hits, groups).select("group_id", F.expr("stack(3, 'abstract', abstract_hit, 'citations', citations_hit, 'venue', venue_hit) as (field, hit_id)"))
    return r.where(F.col("hit_id").isNotNull())
