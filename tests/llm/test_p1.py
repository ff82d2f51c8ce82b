from string import ascii_uppercase

import __spark_entry__ as entry
from scholarmill.llm import names

HIT = "title string, authors array<string>"
ITEM = "title string, creators array<struct<firstname string, lastname string, creatortype string>>"


def pairs(spark, hits, items=()):
    h, i = spark.createDataFrame(list(hits), HIT), spark.createDataFrame(list(items), ITEM)
    return {(r.name_a, r.name_b) for r in names.found(h, i).collect()}


def test_cases(spark):
    hits = [
        ("Tides of a northern reef", ["Richard L. Mbuskiru", "et al."]), (None, ["MBUSKIRU Richard"]), ("", [None, "", "  ", "Unknown"]), (None, None),
        ("Kilns", ["Acad. Soc. Inq. Traijain"]), ("Kilns", ["Paula Jojieck"]), ("Kilns", ["Paula Jojieck"]),
    ]
    items = [("Ovens", [("Richard", "Mbuskiru", "author"), ("", "Traijain Academy of Social Inquiry", "author")]), (None, None)]
    got = pairs(spark, hits, items)
    assert got == {
        ("MBUSKIRU Richard", "Richard L. Mbuskiru"), ("MBUSKIRU Richard", "Richard Mbuskiru"), ("Richard L. Mbuskiru", "Richard Mbuskiru"),
        ("Acad. Soc. Inq. Traijain", "Traijain Academy of Social Inquiry"),
    }
    assert pairs(spark, []) == set() and "p1_found" in entry.queries()


def test_every_pair_of_a_block_is_compared(spark):
    hits = [(None, [f"Maria {c}. {s}"]) for c in ascii_uppercase[:12] for s in ("Kalos", "Kallos")]
    want = {(f"Maria {c}. Kallos", f"Maria {c}. Kalos") for c in ascii_uppercase[:12]}
    assert pairs(spark, hits) == want


def test_many_links_go_through_joins_to_the_same_end(spark, monkeypatch):
    nodes = spark.range(40).select("id").toDF("node")
    edges = spark.createDataFrame([(k, k + 3) for k in range(30)] + [(38, 39)], "a bigint, b bigint")
    want = {k: k % 3 if k < 33 else 38 if k > 37 else k for k in range(40)}
    for most in (0, 100):
        monkeypatch.setattr(names, "LINKS", most)
        assert {r.old: r.new for r in names._components(nodes, edges).collect()} == want


def test_org_keys_meet_where_slip_says_so():
    whole = ["academy", "inquiry", "marine", "social", "zoology"]
    for other in (["acad", "inq", "mar", "soc", "zool"], ["caademy", "inquiry", "marien", "social", "zoology"], ["acadmy", "niquiry", "marine", "soc", "zoology"], ["academy", "inquiry", "marine", "scoial", "zoolgy"]):
        a, b = ({"kind": "o", "surname": " ".join(sorted(w))} for w in (whole, other))
        assert names.slip(a, b) or names.slip(b, a)
        assert names.org_keys(sorted(whole)) & names.org_keys(sorted(other))
    assert not names.org_keys(whole) & names.org_keys([*whole[:4], "history"])


def test_plans_are_few_for_the_driver(spark):
    """The driver keeps every plan: all those of a small run together have so many nodes at most."""
    store = spark._jsparkSession.sharedState().statusStore()
    count = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty() or store.executionsCount()
    before = count()
    hits = [("Tides of a northern reef", ["Maria Kalos", "Ina Ruud"]), ("Tides of a northern reef", ["M. Kalos", "Ina Ruud"]), (None, ["Kallos, Maria"])]
    assert len(pairs(spark, hits)) == 3
    ids = [store.executionsList().apply(k).executionId() for k in range(before, count())]
    assert sum(store.planGraph(k).allNodes().size() for k in ids) < 640
