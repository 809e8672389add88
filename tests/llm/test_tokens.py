import os
import random

import pytest

from glyphmill.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no vocabulary file")


def test_edits_equal_full_encoding(monkeypatch):
    monkeypatch.setattr(tokens, "LEAF", 12)
    encode = tokens.encoding(tokens.TOKENIZER).encode_ordinary
    rng = random.Random(2)
    parts = ["the", " and", " of", "  ", "\n", "é", " ñandú", "'s", "'", "123", " 4", "!!", " x", "tion", "日本", " a b c", "\t"]
    text_of = lambda n: "".join(rng.choice(parts) for _ in range(n))
    for _ in range(300):
        text = text_of(rng.randint(0, 60))
        tree = tokens.CountTree(text, lambda s: len(encode(s)))
        assert tree.total == len(encode(text)) and tree.text() == text
        for _ in range(8):
            a = rng.randint(0, len(text) + 2)
            b = rng.randint(a, min(len(text), a + rng.choice([0, 1, 5, 80])) + 2)
            new = text_of(rng.choice([0, 0, 1, 3, 20]))
            tree.edit(a, b, new)
            text = text[: min(a, len(text))] + new + text[b:]
            assert tree.text() == text
            assert tree.total == len(encode(text))


def test_small_edits_encode_little():
    encode = tokens.encoding(tokens.TOKENIZER).encode_ordinary
    tree = tokens.CountTree("some words here " * 5000, lambda s: len(encode(s)))
    tree.edit(40_000, 40_004, "other")
    assert tree.encoded < 4 * tokens.LEAF


def test_rows(spark):
    rows = [(1, "hello world", [(0, 5, "bye"), (3, 3, "!")], "q"), (2, None, None, "q"), (3, "abc", [(None, 1, "x"), (9, None, None)], "q"), (4, "", [(0, 0, "new text")], "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,replacement:string>>, n_tokens string")
    got = {r.doc_id: r for r in tokens.counted(docs, with_text=True).collect()}
    assert {k: (r.text_after, r.n_edits) for k, r in got.items()} == {1: ("bye! world", 2), 2: ("", 0), 3: ("abc", 1), 4: ("new text", 1)}
    assert (got[1].n_tokens, got[1].n_tokens_after) == (2, 3) and got[2].n_tokens == 0
    assert tokens.counted(docs.limit(0)).count() == 0


def test_the_query_against_full_encodings(spark, sf):
    from glyphmill.llm import registry

    encode = tokens.encoding(tokens.TOKENIZER).encode_ordinary
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op9_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        after = text = texts[r.doc_id]
        n = len(text)
        for a, b, new in ((n // 3, n // 3, " an edit"), (n // 2, n // 2 + 20, ""), (n - 5, n + 8, "the end.")):
            a = max(0, min(a, len(after)))
            after = after[:a] + new + after[max(a, min(b, len(after))) :]
        assert (r.n_tokens, r.n_tokens_after, r.n_edits) == (len(encode(text)), len(encode(after)), 3)
