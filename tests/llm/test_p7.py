import __spark_entry__ as entry
from scholarmill.llm import residue

COLUMNS = "article_id bigint, source string, text string, id int, n int, hashes string"
BODY = "The reef was surveyed again after nine winters. Every coral in the lagoon was counted twice. No trend was found in the older records. The share of fish fell from 9% to 4%. "


def rows(texts):
    return [(k, f"s{k % 3}", t, 0, 0, "x") for k, t in texts.items()]


def test_rules(spark):
    texts = {
        1: "Error 404\nThe page you requested could not be found.\nGo back",
        2: "Tides of the northern reef\n\n{{article.abstract}}\n[Insert abstract here]",
        3: "Home\nAbout\nPlease enable JavaScript to view this page.\n© 2021 Somepapers. All rights reserved.",
        4: "Background\n" + "Dolor iusto vero autem vero facere vitae porro dolor nulla facere. " * 40,
        5: "Letter: Tides of the reef\n\nThe tide was measured by hand in one winter.",
        6: BODY + "Templates such as {{ article.title }} were rendered on the server.",
        7: BODY * 3 + "Please enable JavaScript to view this page.",
        8: None,
        9: "",
        10: " \n ",
        11: "{0} of {1} pages " * 50_000,
        12: BODY * 20_000,
    }
    df = spark.createDataFrame(rows(texts) + rows({1: texts[1]}), COLUMNS)
    assert sorted(r[0] for r in residue.found(df).collect()) == [1, 1, 2, 3, 4, 11]
    assert residue.found(df.limit(0)).count() == 0
    assert residue.found(df.withColumn("source", residue.F.lit(None).cast("string"))).count() == 6


def test_a_message_that_no_rule_knows_is_found_by_its_recurrence(spark):
    odd = "The kettle of this page is on the stove and not ready yet."
    own = "The coefficient on reef is {}."
    texts = {k: f"Title {k}\n{odd}" for k in range(6)} | {10 + k: BODY.replace("nine", f"{k} cold") + own.format(k) for k in range(30)} | {50 + k: f"Note\n{own.format(k)}" for k in range(6)}
    assert sorted(r[0] for r in residue.found(spark.createDataFrame(rows(texts), COLUMNS)).collect()) == list(range(6))


def test_whole_table(spark):
    got = [r[0] for r in entry.queries()["p7_found"](spark, "/root/testdata/sf0.01").collect()]
    assert len(got) == len(set(got)) > 10
