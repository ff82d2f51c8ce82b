import __spark_entry__ as entry
from scholarmill.llm import pages
from scholarmill.session import table

COLUMNS = "article_id bigint, text string, html_path string, sections array<struct<title string>>, metadata struct<title string>, line_no int, id int"
BODY = "The reef was surveyed again after nine winters. Every coral in the lagoon was counted twice, and no trend was found in the older records."
PAGE = [
    ("Skip to main content", 0),
    ("Home | Browse | Search | Cart (0)", 0),
    ("We use cookies to improve your experience. Accept all", 0),
    ("", 1),
    ("Tides of the northern reef", 1),
    ("1. Background", 1),
    (BODY, 1),
    ("Share this article", 0),
    (BODY, 1),
    ("Table 2. Counts of the winter", 1),
    ("• early corals", 1),
    ("Related articles", 0),
    ("Do coral reefs shape tides? (402 views)", 0),
    ("References", 1),
    ("Doe, J. (1994). Tides for beginners: a survey of ten reefs. Reef Studies, 12, 364-368", 1),
    ("Advertisement", 0),
    ("Roe, P. Tides in the north and what they carry. Reef Review 20(3):88-121 (2002)", 1),
    ("© 2021 Somepapers. All rights reserved.", 0),
    ("Follow us", 0),
]
WANT = {k for k, (line, own) in enumerate(PAGE) if not own}


def row(i, text, title=None, html="a.html"):
    return (i, text, html, [("1. Background",), ("References",)] if i < 20 else None, (title,) if title else None, 0, 0)


def test_lines(spark):
    text = "\n".join(line for line, _ in PAGE)
    data = [row(1, text), row(2, text, "Tides of the northern reef"), row(2, text), row(3, text, html=None), row(4, None), row(5, ""), row(6, BODY), row(7, "Home\n" * 3 + (BODY + "\n") * 20_000), row(21, text)]
    df = spark.createDataFrame(data, COLUMNS)
    got = {}
    for r in pages.found(df).collect():
        got.setdefault(r.article_id, []).append(r.line_no)
    assert set(got[1]) == WANT and sorted(got[2]) == sorted([*WANT, *WANT]) and set(got[21]) == WANT
    assert got.keys() == {1, 2, 7, 21} and set(got[7]) <= {0, 1, 2}
    assert {r.article_id for r in pages.found(df, df.where("article_id = 1")).collect()} == {2, 7, 21}
    assert pages.found(df.limit(0)).count() == 0
    main = {r.article_id: r.main for r in pages.main_text(df.where("article_id = 1"), pages.found(df)).collect()}
    assert main == {1: "\n".join(line for line, own in PAGE if own)}


def test_markup_is_read_by_the_parser(spark):
    text = "<a href='/'>Home</a> <a>Browse</a>\n<h1>Tides</h1>\n" + f"<p>{BODY}</p>\n" * 3 + "<footer><a>Contact</a></footer>"
    assert {r.line_no for r in pages.found(spark.createDataFrame([row(30, text, "Tides")], COLUMNS)).collect()} == {0, 5}


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = [tuple(r) for r in entry.queries()["p4_found"](spark, d).collect()]
    text = {r.article_id: r.text.split("\n") for r in table(spark, d, "cached_articles").where("html_path is not null").collect()}
    assert len(got) == len(set(got)) > 500 and all(text[a][n].strip() for a, n in got)
