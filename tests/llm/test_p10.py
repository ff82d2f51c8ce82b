import itertools

import numpy as np

import __spark_entry__ as entry
from scholarmill.llm import spam

COLUMNS = "doc_id bigint, text string, sym string, id int, size int"
BODY = "The reef was surveyed again after nine winters. Every coral in the lagoon was counted twice, and no trend was found in the older records."
REFERENCE = "Doe, J. ({}). Tides for beginners: a survey of {} reefs. Reef Studies, 12, 364-368"
LINK = "[cheap essay {0}](https://www.essay{0}.test/buy-essay-{0}/)"


def test_kinds(spark):
    texts = {
        1: "\n".join(LINK.format(k) for k in range(20)),
        2: BODY + "\n\n" + " ".join(LINK.format(k) for k in range(20)),
        3: "\n".join(f"Uni {w} flask | SKU {k}77 | {k}.99 | in stock" for k, w in enumerate("alpha beta gamma delta omega kappa sigma theta".split())),
        4: "Tags: " + ", ".join(f"{a} {b}" for a, b in itertools.product(("cheap", "urgent", "custom"), ("thesis help", "essay experts", "homework list"))),
        5: "best essay help: why best essay help? Because best essay help is not essay help. " * 6,
        6: "#essayhelp #cheapthesis #essayhelp #homeworklist " * 10,
        7: ("best essay help " * 5).upper() * 20_000,
        10: BODY * 3,
        11: "References\n" + "\n".join(REFERENCE.format(1980 + k, w) for k, w in enumerate("ten nine six two four".split())),
        12: "Contents\n" + "\n".join(f"{k}  Tides of the northern reef in {w} ..... {k * 14}" for k, w in enumerate("Nubial Sibial Ciklon Gakal Zuzur".split(), 1)),
        13: "\n".join(f"{w}: The tide of the reef was measured by hand in winter." for w in ("ebb", "flow", "swell", "neap")),
        14: "\n".join(f"https://somepapers.example/{w}\nThe tide of the {w} was measured by hand and the reef was counted." for w in ("ebb", "flow", "swell")),
        15: BODY + "\n\nKeywords: tides, reefs, shoals, kelps",
        16: (BODY + "\n") * 5_000,
        17: None,
        18: "",
        19: " \n\t",
        20: "Reef",
    }
    df = spark.createDataFrame([(k, t, "x", 0, 0) for k, t in texts.items()] + [(1, texts[1], "", 1, 1)], COLUMNS)
    assert sorted(r[0] for r in spam.found(df).collect()) == [1, 1, 2, 3, 4, 5, 6, 7]
    assert spam.found(df.limit(0)).count() == 0


def test_labels_are_the_likeliest_path():
    label = spam.Labels(*spam.start())
    p, m, e = (np.log(x / x.sum(-1, keepdims=True)) for x in spam.start())
    rng = np.random.default_rng(1)
    for _ in range(40):
        sym = bytes(rng.integers(0, 9, 6).tolist())
        score = lambda y: p[y[0]] + sum(m[a, b] for a, b in zip(y, y[1:])) + sum(e[a, s] for a, s in zip(y, sym))
        best = max(itertools.product(range(4), repeat=6), key=score)
        assert abs(score(best) - score(label(sym))) < 1e-9


def test_whole_table(spark):
    got = [r[0] for r in entry.queries()["p10_found"](spark, "/root/testdata/sf0.01").collect()]
    assert len(got) == len(set(got)) > 10
