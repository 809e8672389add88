import pytest

import corpus_pipeline as P
from glyphmill.llm import mixing, quality
from tests.llm import test_contamination, test_lines, test_minhash, test_mixing


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        rows = {r.doc_id: r for r in after.collect()}
        assert rows and set(rows) <= set(before)
        given = [(i, r.text) for i, r in sorted(before.items())]
        if k == 1:
            gone = test_lines.brute(given)
            for i, text in given:
                left = "\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in gone)
                assert (i in rows) == bool(left.split() or left == text) and (i not in rows or (rows[i].text, rows[i].n_chars) == (left, len(left)))
        if k == 2:
            assert set(rows) == {i for i, _, _, kept in test_minhash.brute(given) if kept}
        if k == 3:
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            for i, text in given:
                n, hit, _ = test_contamination.brute(text, items)
                assert (i in rows) == (2 * len(hit) <= n and len(hit) <= 1000)
                assert hit or rows[i].text == text
        docs, before = spark.createDataFrame(list(rows.values()), docs.schema), rows
    mixed = P.mixing_stage(spark, docs, sf).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in before.values()]
    want, _, _ = test_mixing.brute(rows, mixing.SHARE, mixing.EPOCHS, mixing.SEED, (mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS))
    assert sorted(((r.doc_id, r.epoch) for r in mixed), key=repr) == want
    assert all(r.text == before[r.doc_id].text for r in mixed)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out("doc_id")))
    got = quality.scored(docs, model).join(labels.where(quality.held_out("doc_id")), "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert sum(a > b for a in good for b in bad) > 0.97 * len(good) * len(bad)


def test_scores_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "word " * 5000), (4, "\x00"), (5, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as score")
    labels = spark.createDataFrame([(1, 0, 0), (5, 1, 0), (5, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.scored(docs, quality.train(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out) and out[0].score == out[1].score
    assert quality.scored(docs, quality.train(docs, labels.limit(0))).collect()[0].score == 0.5
    assert quality.scored(docs.limit(0), None).count() == 0


def test_repeated_rows_are_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in P.near_stage(spark, docs, "").collect()) == [0, 1]


def test_scores_against_loops(spark):
    """The model's score of every document by plain loops over its passages."""
    import math

    import numpy as np
    import pyarrow as pa

    from glyphmill.llm import words as W

    rng = np.random.default_rng(4)
    texts = ["", "one two three", "Word! " * 200, "\n".join(f"line {i} é$" for i in range(90)), None]
    model = quality.Model(np.full(quality.FEATURES, 0.1), np.ones(quality.FEATURES))
    model.w = {k: rng.normal(0, 0.5, v.shape) for k, v in model.w.items()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for i, text in enumerate(texts):
        (chunk,) = W.chunks(pa.array([text], pa.string()))
        bag, _ = quality.passages(chunk)
        hidden, energy = [], []
        for x in bag.astype(np.float64):
            h = np.tanh(np.clip((x - model.mean) / model.scale, -6, 6) @ model.w["encode"] + model.w["encode_0"])
            t, s = np.tanh(h @ model.w["tanh"]), np.array([sigmoid(v) for v in h @ model.w["gate"]])
            hidden.append(h)
            energy.append(float((t * s) @ model.w["attend"]))
        weights = np.exp(np.array(energy) - max(energy))
        weights /= weights.sum()
        z = sum(a * h for a, h in zip(weights, hidden))
        assert got[i] == pytest.approx(sigmoid(float(z @ model.w["score"] + model.w["score_0"][0])), abs=1e-9)


def test_gradient():
    import numpy as np

    rng = np.random.default_rng(0)
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    x, bag, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 0, 0, 1, 1, 2, 3, 3, 3]), np.array([1.0, 0, 1, 0])
    loss = lambda: -np.mean(y * np.log(model.forward(x, bag)["p"]) + (1 - y) * np.log(1 - model.forward(x, bag)["p"]))
    got = model.gradient(model.forward(x, bag), y)
    for name, w in model.w.items():
        at = tuple(0 for _ in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert got[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def test_near_stage_links_from_80_percent(spark):
    rows = []
    for k in range(1, 30):  # pairs of 100 shingles, the last k of which differ
        words = [f"d{k}w{i}" for i in range(104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-k], *[f"d{k}x{i}" for i in range(k)]]))]
    want = {d for d, _, _, kept in test_minhash.brute(rows, 80) if kept}
    assert want != {d for d, _, _, kept in test_minhash.brute(rows) if kept}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in P.near_stage(spark, docs, "").collect()} == want


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rows = [(1, "a b c d e f"), (1, "totally other words in this one here"), (2, "TOTALLY other words in this one here"), (None, "a b c d e f"), (1, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as _number", "1 as kept").repartition(3)
    got = P.near_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, "a b c d e f"), (1, rows[1][1]), (None, "a b c d e f"), (1, None), (3, "")], key=repr)


def test_stages_keep_clashing_columns_and_odd_rows(spark, sf):
    import pyspark.sql.functions as F

    names = ["n_lines", "removed_lines", "_hit", "n_words", "hit_words", "hit_items", "score", "kept", "component_id", "_row", "_line_doc", "n_shingles", "_n", "_key", "_tie"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    odd = spark.createDataFrame([(None, "null id"), (900, None), (901, ""), (902, "one line\n" * 3), (902, "one line\n" * 3), (903, "word " * 90_000)], "doc_id long, text string")
    docs = docs.unionByName(odd.selectExpr("doc_id", "text", "'en' as lang", "'src0' as source", "cast(length(text) as int) as n_chars"), True).select(*docs.columns, *[F.lit(f"own {x}").alias(x) for x in names])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert all(r[x] == f"own {x}" for r in out.collect() for x in names), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    mixed = P.mixing_stage(spark, docs, sf)
    assert all(r[x] == f"own {x}" for r in mixed.collect() for x in names)
    assert P.mixing_stage(spark, docs.limit(0), sf).count() == 0


def test_long_labelled_texts_take_part(spark):
    rows = [(i, "good words all over " * 30 if i % 2 else "BUY!! $$$ NOW " * 12_000) for i in range(8)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.scored(docs, quality.train(docs, labels)).collect()}
    assert min(s for i, s in scores.items() if i % 2) > 0.5 > max(s for i, s in scores.items() if not i % 2)
