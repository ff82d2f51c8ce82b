import base64

import tiktoken

import __spark_entry__ as entry
from scholarmill.llm import tokens
from scholarmill.session import table

DATA = "/root/testdata/sf0.01"


def test_ids_are_those_of_the_public_tokenizer(spark):
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in table(spark, DATA, "documents").select("doc_id", "text").collect()}
    rows = entry.queries()["p8_ids"](spark, DATA).collect()
    assert len(rows) == len(texts) and None in texts.values()
    assert {r.doc_id: list(r.ids) for r in rows} == {k: own.encode_ordinary(t or "") for k, t in texts.items()}
