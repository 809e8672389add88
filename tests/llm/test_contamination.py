import random
import re

import pytest

from glyphmill.llm import contamination as C


def words_of(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items, window=10):
    w = words_of(text)
    hit, found = set(), set()
    for name, item in items:
        v = words_of(item)
        if name is None or not v:
            continue
        n = min(window, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(name))
    return len(w), sorted(hit), sorted(found)


def fixture():
    rng = random.Random(9)
    vocabulary = ["a", "b", "é", "Zz", "7"] + [f"v{i}" for i in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 11, 14, 30])))) for k in range(2, 26)]
    items += [(3, "q r"), (40, None), (41, " ,;"), (None, "v1 v2 v3"), (42, items[7][1] + " w"), (43, items[7][1])]
    texts = []
    for _ in range(150):
        t = [rng.choice(vocabulary + ["out", "x-y"]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            v = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(v) - 3))
            t[rng.randint(0, len(t)) : 0] = v[a : a + rng.randint(5, 20)]
        texts.append(", ".join(t).upper() if rng.random() < 0.2 else " ".join(t))
    return items, texts + [None, "", "...", "q r"]


@pytest.mark.parametrize("least,shard", [(1, 100_000), (1, 40), (11, 100_000)])
def test_against_brute_force(spark, monkeypatch, least, shard):
    monkeypatch.setattr(C, "SHARD_WORDS", shard)
    items, texts = fixture()
    items = [(i, t) for i, t in items if least == 1 or len(words_of(t)) >= least]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in C.contaminated(docs.selectExpr("*", "'x' as n_words"), bench).collect():
        spans = r.hit_words
        hit = [x for a, b in zip(spans[0::2], spans[1::2]) for x in range(a, b)]
        assert (r.n_words, hit, r.hit_items) == brute(texts[r.doc_id], items), texts[r.doc_id]


def test_spans_go_and_others_stay(spark):
    item = " ".join(f"t{i}" for i in range(12))
    rest = " ".join(f"o{i}" for i in range(20))
    rows = [(1, f"{rest}. {item.upper()}! {rest}"), (2, item), (3, rest), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in C.decontaminated(docs, bench).collect()}
    assert got == {1: f"{rest}. ! {rest}", 3: rest, 4: None, 5: ""}
    assert C.decontaminated(docs.limit(0), bench).count() == 0
    assert C.decontaminated(docs, bench.limit(0)).count() == 5


def test_long_texts_repeated_rows_and_several_plans(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARD_WORDS", 20)
    monkeypatch.setattr(C, "PLAN_SHARDS", 2)
    rng = random.Random(2)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(12)]
    words = [f"f{rng.randint(0, 999)}" for _ in range(130_000)]  # more than one piece of 512 KB
    for k, at in enumerate((0, 70_000, 95_321, 129_988)):
        words[at : at + 12] = items[k][1].split()
    rows = [(1, " ".join(words)), (2, items[5][1]), (2, items[5][1]), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = C.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == 4
    texts = dict(rows)
    for r in got:
        hit = [x for a, b in zip(r.hit_words[0::2], r.hit_words[1::2]) for x in range(a, b)]
        assert (r.n_words, hit, r.hit_items) == brute(texts[r.doc_id], items)


def test_own_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "h", "n", "w")], "doc_id long, text string, _hit string, n_words string, hit_words string")
    bench = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert list(map(tuple, C.decontaminated(docs, bench).collect())) == [(1, "a b c", "h", "n", "w")]
