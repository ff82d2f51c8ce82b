import __spark_entry__ as entry
from scholarmill.llm import leaks
from scholarmill.session import table

DATA = "/root/testdata/sf0.01"
ITEM = "The glacier between two valleys was surveyed again after nine winters because the old stakes had moved far downstream. Choose the best answer."
STOCK = "Read the passage and answer the question with one short sentence only, then choose the best answer from the list below and explain it."


def test_passages(spark):
    docs = {
        1: "Before it. " + ITEM[:110] + " After it.",
        2: ITEM.upper().replace(" ", "\n").replace(".", " -- "),
        3: "Some words. " + ITEM.replace("surveyed", "measured").replace("old", "new") + " More.",
        4: "The glacier between two valleys was a common phrase. Choose the best answer.",
        5: STOCK,
        6: None,
        7: "",
        8: "word " * 100_000 + ITEM,
    }
    items = [(1, ITEM)] + [(k, f"Item{k} asks{k} about{k} thing{k}. " + STOCK) for k in range(2, 9)]
    got = leaks.found(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (8, 1)}


def test_every_verbatim_run_of_sixteen_words_is_found(spark):
    items = {r.item_id: leaks.words(r.text) for r in table(spark, DATA, "eval_items").collect()}
    grams = {}
    for i, w in items.items():
        for k in range(len(w) - 15):
            grams.setdefault(tuple(w[k : k + 16]), set()).add(i)
    want = set()
    for r in table(spark, DATA, "documents").select("doc_id", "text").collect():
        w = leaks.words(r.text or "")
        want |= {(r.doc_id, i) for k in range(len(w) - 15) for i in grams.get(tuple(w[k : k + 16]), ())}
    got = [tuple(r) for r in entry.queries()["p9_found"](spark, DATA).collect()]
    assert len(got) == len(set(got)) and want and want <= set(got)
