import random
import re

import numpy as np
import pytest

from glyphmill.llm import minhash, words
from glyphmill.llm.graph import components


def word_list(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingle_set(text):
    w = word_list(text)
    return set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[y] = x
    return sorted((d, len(s), None if d is None else root(d), d is None or root(d) == d) for (d, _), s in zip(rows, sets))


def fixture_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        rows.append((10 * k, " ".join(base)))
        for c in range(1, 6):
            near = list(base)
            for _ in range(rng.randint(0, 2)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((10 * k + c, "\n ".join(near).upper() if c == 3 else " ".join(near)))
    chain = [f"c{i}" for i in range(140)]
    rows += [(1000 - k, " ".join(chain[k * 5 : k * 5 + 100])) for k in range(8)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "é É ÜBER"), (2004, "é É über"), (2005, "one two"), (2006, "ONE  two")]
    return rows


@pytest.mark.parametrize("percent,tile,rounds", [(85, 512, (4, 32, 256, 0)), (80, 2, (1, 0))])
def test_against_brute_force(spark, monkeypatch, percent, tile, rounds):
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, minhash.near_duplicates(docs, percent).collect()))
    assert got == brute(rows, percent)


def test_rows_that_share_ids_nulls_and_clashing_columns(spark):
    long = " ".join(f"a{i}" for i in range(30))
    rows = [(1, long, "x"), (1, long, "x"), (1, "b " * 3, "y"), (5, "B B b", None), (6, long + " z", "q"), (None, long, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").selectExpr("*", "doc_id as component_id", "text as bits")
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 26, 1, True), (1, 26, 1, True), (1, 1, 1, True), (5, 1, 1, False), (6, 27, 1, False), (None, 26, None, True)], key=repr)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (7, 7), (None, 3)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40}


def test_words_in_pieces(monkeypatch):
    text = ("Ab cdé " * 400 + "x" * 900 + " end").encode()
    whole = words.words(np.frombuffer(text, np.uint8), words.NON_SPACE)
    monkeypatch.setattr(words, "PIECE", 100)
    cut = words.words(np.frombuffer(text, np.uint8), words.NON_SPACE)
    assert all((a == b).all() for a, b in zip(whole, cut)) and len(whole.hashes) == 802


def test_estimate_is_corrected():
    assert minhash.estimated(np.array([minhash.PERMUTATIONS]))[0] == 1
    assert abs(minhash.estimated(np.array([minhash.PERMUTATIONS / 16]))[0]) < 1e-9


def test_both_sides_of_every_size_switch(spark, monkeypatch):
    """Nothing is broadcast, and every key counts as hot."""
    from glyphmill.llm import session

    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(minhash, "PIVOT_ROWS", 1)
    monkeypatch.setattr(session, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(session, "HOT_ROWS", 2)
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == brute(rows)
