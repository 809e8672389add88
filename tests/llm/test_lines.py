import random

import pytest

from glyphmill.llm import lines
from tests.llm.test_minhash import word_list


def brute(rows, percent=85):
    every = sorted({(d, i, line) for d, t in rows if d is not None and t is not None for i, line in enumerate(t.split("\n"))})
    sets = [set(word_list(line)) for _, _, line in every]
    gone = set()
    for k, (d, i, _) in enumerate(every):
        b = sets[k]
        if len(b) >= lines.MIN_WORDS and any(len(a) >= lines.MIN_WORDS and every[j][:2] != (d, i) and 100 * len(a & b) >= percent * len(a | b) for j, a in enumerate(sets[:k])):
            gone.add((d, i))
    return gone


def fixture_rows():
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 160))] for _ in range(60)]
    rows = []
    for d in range(120):
        text = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            text.append(" ".join(line).upper() if rng.random() < 0.1 else " ".join(line))
        rows.append((d, "\n".join(text)))
    return rows + [(500, None), (501, ""), (502, "\n\n \n"), (None, rows[0][1])]


@pytest.mark.parametrize("percent,tile,first", [(85, 2048, 8), (80, 8, 1), (90, 16, 2)])
def test_against_brute_force(spark, monkeypatch, percent, tile, first):
    monkeypatch.setattr(lines, "TILE", tile)
    monkeypatch.setattr(lines, "FIRST", first)
    monkeypatch.setattr(lines, "TILE_SAMPLE", 1 if tile < 100 else 64)
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, lines.removed_lines(docs, percent).collect()))
    assert got == sorted(brute(rows, percent))


def test_texts_keep_the_other_lines(spark):
    a, b = "one two three four five six", "uno dos tres cuatro cinco seis"
    rows = [(2, f"{a}\nx\n{b}\n", 7), (1, f"{a}\r\nx", 8), (3, None, 9), (4, b, 1), (4, b, 1), (9, "c d e f g h", 1), (9, "c d e f g h", 1)]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id int, text string, n_lines int"))
    got = sorted((r.doc_id, r.text, r.n_lines, r.removed_lines) for r in out.collect() if r.text is not None)
    assert got == [(1, f"{a}\r\nx", 2, []), (2, f"x\n{b}\n", 4, [0]), (4, "", 1, [0]), (4, "", 1, [0]), (9, "c d e f g h", 1, []), (9, "c d e f g h", 1, [])]
    assert [(r.text, r.n_lines) for r in out.collect() if r.doc_id == 3] == [(None, 0)]
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def every_line(rows, percent=85):
    """As ``brute``, without a least number of words."""
    sets = [(d, i, set(word_list(line))) for d, t in sorted((r for r in rows if None not in r)) for i, line in enumerate(t.split("\n"))]
    return sorted((d, i) for k, (d, i, b) in enumerate(sets) if b and any(100 * len(a & b) >= percent * len(a | b) for *_, a in sets[:k]))


@pytest.mark.parametrize("percent", [80, 85, 90, 100])
def test_short_lines(spark, percent):
    rng = random.Random(6)
    pool = ["Les.", "les. LES.", "All rights reserved.", "reserved. all rights", "a b c d", "a b c d e", "a b c d e f", " \t", ""]
    rows = [(d, "\n".join(rng.choice([*pool, f"own {d}"]) for _ in range(4))) for d in range(30)] + fixture_rows()
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, lines.removed_lines(docs, percent, least=1).collect())) == every_line(rows, percent)


def test_the_query_and_the_stage_take_short_lines(spark, sf):
    import corpus_pipeline
    from glyphmill.llm import registry

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {}
    for d, i in every_line([(r.doc_id, r.text) for r in docs.collect()]):
        want.setdefault(d, []).append(i)
    got = registry.op3_line_dedup(spark, sf).where("n_removed > 0").collect()
    assert {r.doc_id: [int(i) for i in r.removed.split(",")] for r in got} == want
    texts = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, sf).collect()}
    for r in docs.collect():
        left = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in want.get(r.doc_id, []))
        assert texts.get(r.doc_id) == (left if left.split() or left == r.text else None)


def test_both_sides_of_every_size_switch(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    monkeypatch.setattr(lines, "FIRST", 2)
    long = "\n".join([*(f"line {k} of a very long document with words {k % 700}" for k in range(12_000)), "w " * 300_000])
    rows = [*fixture_rows()[:60], (700, long), (701, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = every_line([r for r in rows if r[0] != 700], 85)
    got = sorted((d, i) for d, i in map(tuple, lines.removed_lines(docs).collect()) if d != 700)
    # The long document's lines differ in their number and match no line of another; its last line is a set of one word.
    assert got == sorted([*want, (701, 0)])
    out = {r.doc_id: r for r in lines.dedup_lines(docs, least=1).collect()}
    gone = {x for x in want}
    for d, text in rows[:60]:
        if d is not None and text is not None:
            assert out[d].text == "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in gone)
