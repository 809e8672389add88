import hashlib
import random
import re

from glyphmill.llm import secrets as S

A = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in A.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_base_spans(spark):
    rng = random.Random(4)
    parts = ["password", "PASSWD", "Secret", "api_key", "APIKEY", "token", "=", ":", " ", "  ", '"', "'", "\n", "é", "𝒳", "ſecret", "toKen", "AKIA" + "Q7" * 8, "AKIA12", "deadbeef" * 3, "deadbeef" * 2, "abc", "abcdef", "x.y_z-1=", "token=token:abcdefgh"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(800)] + [None, "", "a" * 50_000 + " token=abcdef"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in S.scan(docs.selectExpr("*", "1 as spans")).select("doc_id", "base_spans", "spans", S.joined("base_spans").alias("j")).collect():
        assert [tuple(s) for s in r.base_spans] == brute(texts[r.doc_id])
        assert {tuple(s) for s in r.base_spans} <= {tuple(s) for s in r.spans}
        assert r.j == ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in brute(texts[r.doc_id]))


def test_random_strings_are_added_and_words_are_not(spark):
    rng = random.Random(8)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    syllables = ["tion", "ing", "er", "the", "an", "re", "ou", "ver"]
    words = ["".join(rng.choice(syllables) for _ in range(9)) for _ in range(600)]
    keys = ["".join(rng.choice(b64) for _ in range(44)) for _ in range(60)]
    names = [f"my_long_function_name_of_the_table_{i}" for i in range(60)]
    rows = [(i, f"{words[2 * i % 600]} {words[(2 * i + 1) % 600]} {k}") for i, k in enumerate(keys + names)] + [(1000 + i, w) for i, w in enumerate(words)]
    got = {r.doc_id: len(r.spans) for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] > 0 for i in range(60)) >= 40
    assert sum(got[i] for i in range(60, 120)) <= 4 and sum(got[i] for i in got if i >= 1000) == 0


def test_battery():
    name, *p = S.battery(hashlib.sha256(b"x").hexdigest())
    assert name == "hex" and min(p) > 0.01
    assert S.battery("abababababababababababab")[4] < 1e-4 and S.battery("thetionthetion" * 4)[4] < 1e-3
    assert S.thresholds([], 0.05)[0] == -1


def test_a_small_table_of_ordinary_prose(spark):
    rng = random.Random(9)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    prose = "It was a bright cold day in spring, and the clocks on the old tower were all striking one after the other."
    keys = ["".join(rng.choice(b64) for _ in range(44)) for _ in range(12)]
    rows = [(i, f"{prose} {k} {prose}") for i, k in enumerate(keys)] + [(100 + i, prose) for i in range(20)]
    rows += [(200 + i, f"{prose} my_long_function_name_of_the_table_{i}") for i in range(12)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = len(prose) + 1
    assert sum((at, 3, at + 44) in got[i] for i in range(12)) >= 9
    told = S.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("size(random) > 0").select("random").collect()
    assert {x.encoding for r in told for x in r.random} <= {"base62", "base64"} and all(x.step <= 60 for r in told for x in r.random)
    assert not any(got[i] for i in got if i >= 100)


def test_runs_of_one_kind_and_beside_base_spans():
    letters, digits, rest = "QwErTyUiOpAsDfGhJkLz", "83920174650918273645", "ZxCvBnMqWeRtYuIoPaSd7"
    text = f"{letters} {digits} {'deadbeef' * 3}{rest} {rest}-AKIA{'Q7' * 8}_{letters} AKIA{'Q7' * 8}short wordwordwordwordword"
    got = [(text[a:b], null) for a, b, *_, null in S.candidates(text, S.base_spans(text))]
    assert got == [(letters, False), (digits, False), (rest, False), (rest + "-", False), ("_" + letters, False), ("wordwordwordwordword", True)]
    assert S.battery(digits)[0] == "decimal" and S.battery(digits)[4] > 0.01


def test_thresholds_are_benjamini_hochbergs():
    rng = random.Random(3)
    for _ in range(20):
        null = [(0, rng.randint(0, 60), True, rng.randint(1, 50)) for _ in range(8)]
        seen = [(0, rng.randint(0, 120), False, rng.randint(1, 9)) for _ in range(rng.randint(1, 12))]
        fixed = S.fixed_null()[0]
        strings = [step for step, n in enumerate(fixed) for _ in range(int(n))] + [s for _, s, _, n in null for _ in range(n)]
        p_of = lambda step: (1 + sum(x <= step for x in strings)) / (1 + len(strings))
        tests = sorted((p_of(s), s) for _, s, _, n in seen for _ in range(n))
        passing = [s for i, (p, s) in enumerate(tests, 1) if p <= 0.1 * i / len(tests)]
        got = S.thresholds([*null, *seen], 0.1)[0]
        assert {s for _, s in tests if s <= got} == {s for p, s in tests if passing and p <= p_of(max(passing))}


def test_empty_tables_and_repeated_rows(spark):
    one = spark.createDataFrame([(1, "token=abcdefgh"), (1, "token=abcdefgh")], "doc_id long, text string")
    assert [len(r.base_spans) for r in S.scan(one).collect()] == [1, 1]
    assert S.scan(one.limit(0)).count() == 0
