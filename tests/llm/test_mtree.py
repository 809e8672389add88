import math
import random

import numpy as np
import pytest

from glyphmill.llm import mtree


def brute(rows, k=5):
    whole = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in {x for x in whole if x[0] % 50 == 0}:
        all_ = {(-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b)}
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(all_)[:k])]
    return sorted(out)


@pytest.mark.parametrize("page,tree,queries", [(96, 8192, 2048), (4, 60, 5)])
def test_against_brute_force(spark, monkeypatch, page, tree, queries):
    monkeypatch.setattr(mtree, "TREE", tree)
    monkeypatch.setattr(mtree, "QUERIES", queries)
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 0.5, (5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.1, 6)).round(2).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(120)] + [(2000 + i, [0.0] * 6) for i in range(9)]
    rows += [(3000, None), (3050, [1.0, None] * 3), (3100, [math.nan] * 6), (3150, [math.inf] * 6), (3200, [1.0, 2.0]), (None, [1.0] * 6), (3250, []), (3300, []), (0, rows[0][1]), (3350, [0.5])]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score").repartition(4)
    vectors = mtree.scaled(table)
    got = sorted(map(tuple, mtree.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()))
    assert got == brute(rows)


def test_few_and_none(spark):
    two = spark.createDataFrame([(0, [0.5, 0.5]), (7, [1.0, 0.0])], "vec_id long, embedding array<float>")
    v = mtree.scaled(two)
    assert list(map(tuple, mtree.top_k(v, v.where("vec_id = 0")).collect())) == [(0, 1, 7, 128 * 256)]
    assert mtree.top_k(v.limit(0), v.limit(0)).count() == 0
    assert mtree.top_k(v, v.where("vec_id = 3")).count() == 0


def test_bounds_spare_distances():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-300, 300, (1, 8)) + rng.integers(-12, 13, (200, 8)) for _ in range(20)]).astype(float)
    forest = mtree.Forest(float((x * x).sum(1).max()))
    root = np.append(x[0], forest.extra(x[:1]))
    pages = mtree.build(x, root, forest, 32)
    ids = [np.array([p]) for page in pages if page.leaf for p in page.children]
    for page in pages:
        if page.leaf:
            page.children = np.array([next(i for i, y in enumerate(ids) if y[0] == c) for c in page.children])
    queries = x[::200]
    to_root = forest.query((queries * queries).sum(1), queries @ x[0])
    best, computed = mtree.search(pages, ids, queries, to_root, forest, 5, np.full(len(queries), math.inf))
    for i, q in enumerate(queries):
        own = best.query == i
        want = sorted(((int(s), -i) for i, s in enumerate(x @ q)), reverse=True)[:5]
        assert list(zip(best.score[own].tolist(), (-best.id[own]).tolist())) == want
    assert computed < 0.35 * len(queries) * len(x)


def test_clustered_vectors_spare_trees(spark, monkeypatch):
    """The forest's bounds: most distances are never computed where vectors lie in clusters; shells and repeated ids."""
    monkeypatch.setattr(mtree, "TREE", 100)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 2, (12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.02, 6)).round(3).tolist()) for i in range(2400)]
    rows += [(100, rows[7][1]), (100, rows[31][1]), (50, [0.25] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = mtree.scaled(table)
    computed = spark.sparkContext.accumulator(0)
    got = sorted(map(tuple, mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, computed).collect()))
    whole = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows}
    want = []
    for q in {i for i, _ in whole if i % 50 == 0}:
        scores = [(-sum(x * y for x, y in zip(a, b)), i) for j, a in whole if j == q for i, b in whole if i != q]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:5])]
    assert got == sorted(want)
    assert computed.value < 0.35 * len({i for i, _ in whole if i % 50 == 0}) * len(whole)


def test_large_components():
    """Products beyond 2**53 are exact."""
    forest = mtree.Forest(float(2**62))
    x = np.array([[2.0**30 + 1, 3.0], [2.0**30, 5.0]])
    assert forest.products(x, x).tolist() == [[(2**30 + 1) ** 2 + 9, (2**30 + 1) * 2**30 + 15], [(2**30 + 1) * 2**30 + 15, 2**60 + 25]]
