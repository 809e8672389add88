import hashlib
import random
import re
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from glyphmill.llm import mixing


def fill(budget, children):
    """children: (name, weight, capacity) -> whole tokens each, by raising the level step by step."""
    got, open_ = {}, sorted(children, key=lambda c: (Fraction(c[2], c[1]), c[0]))
    left, heavy = budget, sum(w for _, w, _ in children)
    while open_:
        name, w, cap = open_[0]
        if left * w < cap * heavy:
            break
        got[name] = cap
        left, heavy = left - cap, heavy - w
        open_.pop(0)
    for name, w, _ in open_:
        got[name] = left * w // heavy
    return got


def brute(rows, share, epochs, seed, weights):
    domain = lambda s: f"domain{zlib.crc32(s.encode()) % 4}"
    leaves = {}
    for d, text, lang, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        leaves.setdefault((domain(source or ""), lang or "", source or ""), []).append((d, n))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    cap = lambda keep: sum(epochs * t for k, t in tokens.items() if keep(k))
    total = int(share * sum(tokens.values()))
    budget = {}
    top = fill(total, [(x, weights[0].get(x, 1), cap(lambda k: k[0] == x)) for x in {k[0] for k in leaves}])
    for d, b in top.items():
        for la, c in fill(b, [(x, weights[1].get(x, 1), cap(lambda k: k[:2] == (d, x))) for x in {k[1] for k in leaves if k[0] == d}]).items():
            for s, e in fill(c, [(k[2], 1, epochs * tokens[k]) for k in leaves if k[:2] == (d, la)]).items():
                budget[d, la, s] = e
    out = []
    for k, docs in leaves.items():
        if not tokens[k]:
            continue
        whole, part = divmod(budget[k], tokens[k])
        for epoch in range(1, whole + 1):
            out += [(d, epoch) for d, _ in docs]
        if part:
            at = 0
            for d, n in sorted(docs, key=lambda x: hashlib.md5(f"{seed}|{whole + 1}|{'' if x[0] is None else x[0]}".encode()).hexdigest()):
                at += n
                if at <= part:
                    out.append((d, whole + 1))
    return sorted(out, key=repr), budget, total


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_DOCS", 7)
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)) if i % 17 else rng.choice([None, "", " \n"]), rng.choice(["en", "en", "de", "fr", None]), rng.choice(["hot"] * 5 + [f"s{k}" for k in range(7)] + [None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as epoch").repartition(4)
    for share, epochs in ((0.5, 2), (0.05, 1), (1.4, 3), (9.0, 2)):
        got = sorted(((r.doc_id, r.epoch) for r in mixing.mixed(docs, share, epochs).select("doc_id", "epoch").collect()), key=repr)
        want, budget, total = brute(rows, share, epochs, mixing.SEED, (mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS))
        assert got == want
        assert sum(budget.values()) <= total
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.where("text is null")).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 10, 1), ("a", "de", "y", 1000, 1), ("b", "en", "z", 1000, 1)], "domain string, lang string, source string, tokens long, docs long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, F.lit(400), epochs=1).collect()}
    assert got == {"x": 10, "y": 190, "z": 200}
    got = {r.source: r.budget for r in mixing.budgets(leaves, F.lit(2005), epochs=1).collect()}
    assert got == {"x": 10, "y": 995, "z": 1000}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    assert "Python" not in mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()


def test_ties_and_shuffled_leaves(spark, monkeypatch):
    """Rows that share a doc_id are read in an order that doesn't hang on their place; leaves may be too many to broadcast."""
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    rows = [(i // 4, "w " * (i % 4 + 1) + f"t{i}", "en", "s") for i in range(80)] + [(500, "long " * 120_000, "en", "t"), (501, "x", "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    some = [sorted(map(tuple, mixing.mixed(docs.repartition(n, F.rand(n)), 0.3, 1).select("doc_id", "text", "epoch").collect())) for n in (1, 3, 7)]
    assert some[0] and some[0] == some[1] == some[2]
