import numpy as np

import __spark_entry__ as entry
from scholarmill.llm import linkage
from scholarmill.session import table

DATA = "/root/testdata/sf0.01"
HIT = "hit_id bigint, title string, authors array<string>, year string, doi string, id int, rec string"
REC = "rec_id bigint, title_display string, contributor string, pub_year string, note string, id int, key string"


def test_whole_table_against_brute_force(spark):
    hits, records = table(spark, DATA, "search_hits"), table(spark, DATA, "catalog_records")
    got = {(r.hit_id, r.rec_id) for r in entry.queries()["p3_found"](spark, DATA).collect()}
    form = lambda *x: (*linkage.title_of(x[0])[:2], linkage.people_of(x[1]), linkage.year_of(x[2]), linkage.tail_of(x[3]))
    h = {r.hit_id: form(r.title, r.authors or [], r.year, r.doi) for r in hits.where("hit_id % 20 = 0").collect()}
    r = {x.rec_id: form(x.title_display, linkage._SPLIT.split(x.contributor or linkage.title_of(x.title_display)[2]), x.pub_year, x.note) for x in records.collect()}
    want = set()
    for i, a in h.items():
        for j, b in r.items():
            level, allowed = linkage.levels(a, b)
            people = level // (linkage.LEVELS[2] * linkage.LEVELS[3]) % linkage.LEVELS[1]
            if allowed and people != 1:
                want.add((i, j))
    mine = {p for p in got if p[0] % 20 == 0}
    assert want and mine <= want and len(mine & want) >= 0.97 * len(want)


def test_confidence(spark):
    rows = entry.queries()["p3_matches"](spark, DATA).collect()
    assert rows and all(0.5 <= r.confidence <= 1 for r in rows) and len({(r.hit_id, r.rec_id) for r in rows}) == len(rows)


def test_cases(spark):
    hits = [
        (20, "<i>Tides</i> of the northern reef: a survey of ten coves", ["Jane Q. Doe", "et al."], "2004", "10.9/abc.2004.x7y8z9", 0, ""),
        (21, "Tides of the northern reef: a survey of ten coves: Part II", ["Jane Q. Doe"], "2005", None, 0, ""),
        (22, "tides of the norhtern reef — a survey of ten coves.", ["DOE, Jane"], "2004.0", "", 0, ""),
        (23, "Tides of the northern…", ["Doe, J."], "c2004", None, 0, ""),
        (24, "Editorial", ["Rosa Roe"], "1999", None, 0, ""),
        (25, None, None, None, None, 0, ""),
        (26, "", [], "", "", 0, ""),
        (27, "Of unrelated kilns and their long use in northern pottery", ["Max Moe"], "2004", None, 0, ""),
        (28, "tide " * 40_000, ["Poe " * 9_000], "2004", "x" * 90_000, 0, ""),
        (29, "Editorial", ["Tim Toe"], "1999", None, 0, ""),
    ]
    recs = [
        (50, "TIDES OF THE NORTHERN REEF : A SURVEY OF TEN COVES / Jane Doe", "Doe, J.", "[2004?]", "see 2004.x7y8z9", 0, ""),
        (51, "Tides of the northern reef: a survey of ten coves: part 2 [online]", "Doe, Jane", "2005-", None, 0, ""),
        (52, "Editorial.", "Roe, R.", "1999", None, 0, ""),
        (53, None, None, None, None, 0, ""),
    ]
    h, r = spark.createDataFrame([*hits, hits[0]], HIT), spark.createDataFrame(recs, REC)
    got = sorted((x.hit_id, x.rec_id) for x in linkage.matches(h, r).collect())
    assert got == [(20, 50), (20, 50), (21, 51), (22, 50), (23, 50), (24, 52)]
    assert linkage.matches(h.limit(0), r).count() == 0 and linkage.matches(h, r.limit(0)).count() == 0


def test_large_blocks_lose_no_pair_that_agrees(spark):
    hits = [(k, f"Tides of the northern reef number {k % 400}", [f"Jane Doe{'abcdefgh'[k % 8]}son"], str(1900 + k % 100), None, 0, "") for k in range(1600)]
    recs = [(9000 + k, *hits[k][1:2], hits[k][2][0], hits[k][3], None, 0, "") for k in range(0, 400, 10)]
    got = {(x.hit_id, x.rec_id) for x in linkage.matches(spark.createDataFrame(hits, HIT), spark.createDataFrame(recs, REC)).collect()}
    assert {(k, 9000 + k % 400) for k in range(1600) if k % 400 % 10 == 0 and k < 400} <= got


def test_large_blocks_keep_every_pair_that_the_check_allows(spark, monkeypatch):
    words = ["harbour", "granite", "lantern", "meadow", "thistle", "copper", "saddle", "walnut"]
    name = lambda k: f"{words[k % 8]}{words[k // 8 % 8]}ite"
    hits = [(k, f"{name(k)} for strange walls a pattern using docket coding", ["Rosa Roe", f"Jane {words[k % 8]}son"], str(1900 + k), None, 0, "") for k in range(64)]
    # a slip in the rare word, the people the other way round, the year one off: only the large block has the pair
    recs = [(9000 + k, f"{name(k)[:3]}x{name(k)[3:]} for strange walls a pattern using docket coding", f"{words[k % 8]}son, Jane; Roe, Rosa", str(1901 + k), None, 0, "") for k in range(64)]
    monkeypatch.setattr(linkage, "LARGE", 100)
    got = {(x.hit_id, x.rec_id) for x in linkage.matches(spark.createDataFrame(hits, HIT), spark.createDataFrame(recs, REC)).collect()}
    assert {(k, 9000 + k) for k in range(64)} <= got


def test_finer_keys_lose_no_allowed_pair(spark, monkeypatch):
    hits, records = table(spark, DATA, "search_hits"), table(spark, DATA, "catalog_records")
    h = linkage._forms(hits.select("hit_id", "title", "authors", "year", "doi"), False)
    r = linkage._forms(records.selectExpr("rec_id", "title_display", "coalesce(contributor, '')", "cast(pub_year as string)", "note"), True)

    def allowed(large):
        monkeypatch.setattr(linkage, "LARGE", large)
        return {(x.hit, x.rec) for x in linkage.compared(h, r, linkage.candidates(h, r)).where("allowed").collect()}

    whole = allowed(1 << 60)
    assert whole and allowed(0) == whole


def test_fit_separates_the_patterns():
    counts = np.zeros(int(np.prod(linkage.LEVELS)))
    at = lambda *x: int(np.ravel_multi_index(x, linkage.LEVELS))
    counts[at(5, 4, 3, 0)], counts[at(4, 4, 3, 2)], counts[at(1, 1, 1, 0)], counts[at(5, 1, 1, 1)] = 900, 60, 5000, 20
    p = linkage.fit(counts)
    assert p[at(5, 4, 3, 0)] > 0.99 > 0.01 > p[at(1, 1, 1, 0)] and p[at(5, 1, 1, 1)] < 0.5
