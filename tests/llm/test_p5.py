from datetime import datetime

import __spark_entry__ as entry
from scholarmill.llm import best

A = "We show that the tide shapes the reef in every case. A second look reveals the same pattern again."
HITS = "hit_id bigint, abstract string, citations int, venue string, found_in array<string>, retrieved_at timestamp"


def hit(i, abstract=None, citations=None, venue=None, found_in=None, day=1):
    return (i, abstract, citations, venue, found_in, datetime(2024, 1, day))


def test_best_of_each_field(spark):
    rows = [
        hit(1, A[:53], 9, "MARINE ECOLOGY QUARTERLY", ["b"], 1),
        hit(2, A[:80] + " ...", -1, "Marine Ecology Quarterly", None, 5),
        hit(3, A, 12, "Mari. Ecol. Q., 3(1)", ["a", "b"], 4),
        hit(4, A, 12, "Marine Ecology Quarterly", [], 4),
        hit(5, "[Preview from PDF page 1]: " + A + " More text of the page follows here.", 0, "Oldmoor Press", None, 6),
        hit(6, "N/A", None, "Marine Ecology", None, 7),
        hit(7, "Keywords: tides; reefs; tides; shoals; reefs; kelps.", 0, "DraftHaven"),
        hit(8, A[:70], None, "Annals of"),
        hit(9, None, None, "Jathal Review of Mar"),
        hit(10, None, None, "Annals of Marine Ecology"),
    ]
    hits = spark.createDataFrame(rows, HITS)
    groups = spark.createDataFrame([(1, i) for i in range(1, 7)] + [(2, 7), (2, 8), (2, 9)], "group_id bigint, hit_id bigint")
    got = {(r.group_id, r.field, r.hit_id) for r in best.found(hits, groups).collect()}
    assert got == {(1, "abstract", 3), (1, "citations", 3), (1, "venue", 2)}
    r = {r.group_id: r for r in best.records(hits, groups).collect()}
    assert (r[1].abstract, r[1].citations, r[1].venue, r[1].found_in) == (A, 12, "Marine Ecology Quarterly", ["a", "b"])
    assert r[2].abstract is None and r[2].found_in == []


def test_every_group_counts(spark):
    d = "/root/testdata/sf0.01"
    rows = entry.queries()["p5_found"](spark, d).collect()
    assert len({(r.group_id, r.field) for r in rows}) == len(rows) > 0
