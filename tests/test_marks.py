import random

from glyphmill.operators import masks as M
from glyphmill.operators import quotes as Q
from glyphmill.operators import spans as P


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def slices(df, texts):
    return sorted((r.doc_id, texts[r.doc_id][r.start : r.end]) for r in df.collect())


def test_addresses_paths_and_named_terms(spark):
    texts = ["看 https://a.org/x/y 和 ./b/c", "《/etc/hosts》", "「軟件」一詞", "「軟件」。這個詞", "『信息』是大陸的用語", None, ""]
    docs = docs_of(spark, *texts)
    assert slices(M.urls(docs), texts) == [(0, "https://a.org/x/y")]
    assert slices(M.paths(docs), texts) == [(0, "./b/c"), (1, "/etc/hosts")]
    assert slices(M.named_terms(docs), texts) == [(2, "軟件"), (4, "信息")]


def test_suppression(spark):
    texts = ["a\n<!-- glyphmill:disable-next -->\nb\nc", "// glyphmill:disable-block\na\n// glyphmill:disable-next\n// glyphmill:enable\nb", "x // glyphmill:ignore-block\ny", "http://glyphmill:ignore", "x # glyphmill:ignore", "a // glyphmill:ignored"]
    got = {}
    for r in M.suppressed_lines(docs_of(spark, *texts)).collect():
        got.setdefault(r.doc_id, set()).add(r.line_no)
    assert got == {0: {2}, 1: {0, 1, 2, 3}, 2: {0, 1}}
    assert [r.line_no for r in M.suppressed_lines(docs_of(spark, texts[4]), True).collect()] == [0]


def test_lines_of_markup(spark):
    docs = docs_of(spark, "---\na: b\n---\n# 題 #\n```\n# c\n~~~\n```\n::: x\n## d", "```\nopen", "---\nno end", None)
    pairs = lambda df: sorted((r.doc_id, r.line_no) for r in df.collect())
    assert pairs(M.fenced_lines(docs)) == [(0, 4), (0, 5), (0, 6), (0, 7), (1, 0), (1, 1)]
    assert pairs(M.front_matter_lines(docs)) == [(0, 0), (0, 2)]
    assert pairs(M.container_lines(docs)) == [(0, 8)]
    assert pairs(M.line_spans(docs, M.container_numbers).withColumnRenamed("start", "line_no")) == [(0, docs.first().text.index(":::"))]
    assert sorted((r.level, r.title) for r in M.headings(docs).collect()) == [(1, "題"), (2, "d")]
    texts = ["看 `code` 和 [字](x/y)\n```\nz\n```"]
    assert slices(M.mask(docs_of(spark, *texts)), texts) == sorted([(0, "```"), (0, "```"), (0, "`code`"), (0, "](x/y)"), (0, "z")])


def test_foreign_scopes(spark):
    rows = [(1, '<html lang="zh-TW"><p>中<span lang="en">abc<br>d</span>文<i lang=ja>x'), (2, "<p lang='en'>a<b lang=''>b</b></p></p>c"), (3, None), (4, "a > b < c"), (None, "<p lang=en>x</p>")]
    out = M.foreign_scopes(spark.createDataFrame(rows, "page_id long, html string")).collect()
    html = dict(rows)
    assert sorted((r.page_id, html[r.page_id][r.start : r.end]) for r in out) == [(1, "abc<br>d"), (1, "x"), (2, "a<b lang=''>b</b>")]


def brackets(text):
    out, stack = [], []
    for i, c in enumerate(text):
        if text.startswith("\n\n", i):
            out += [(p, b, "unclosed") for p, b in stack]
            stack = []
        elif c in "「『《":
            stack.append((i, c))
        elif c in "」』》":
            if not stack:
                out.append((i, c, "unmatched"))
            elif stack[-1][1] != "「『《"["」』》".index(c)]:
                out.append((i, c, "interleaved"))
            else:
                stack.pop()
                if c == "』" and "「" not in [b for _, b in stack]:
                    out.append((i, c, "outermost"))
    return sorted(out + [(p, b, "unclosed") for p, b in stack])


def test_brackets(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(["「", "」", "『", "』", "《", "》", "字", "\n\n"]) for _ in range(draw.randrange(14))) for _ in range(80)]
    got = {}
    for r in P.bracket_problems(docs_of(spark, *texts)).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.found, r.problem))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == brackets(text), text


def test_overlaps(spark):
    draw, grave = random.Random(5), ["error", "warning", "info"]
    rows = list({(d, draw.randrange(12), "字" * draw.randrange(5), draw.choice(grave)) for d in range(20) for _ in range(8)})
    got = {tuple(r) for r in P.resolved(spark.createDataFrame(rows, "doc_id long, pos int, found string, severity string")).collect()}
    wanted = set()
    for d in range(20):
        kept = []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (-len(r[2]), grave.index(r[3]), r[1])):
            if not any(k[1] < r[1] + len(r[2]) and r[1] < k[1] + len(k[2]) for k in kept):
                kept.append(r)
        wanted |= set(kept)
    assert got == wanted


def test_spaces_stops_case_and_composition(spark):
    docs = docs_of(spark, "字 ，a。 b", "好.", "好.b 好..", "GITHUB github5 xgithub GitHub", "é", None, "")
    assert sorted((r.doc_id, r.pos, r.size) for r in P.unwanted_spaces(docs).collect()) == [(0, 1, 1), (0, 5, 1)]
    assert [(r.doc_id, r.pos) for r in Q.marks(docs, Q.stops).collect()] == [(1, 1)]
    assert sorted((r.found, r.suggestion) for r in P.case_issues(docs, {"GitHub": []}).collect()) == [("GITHUB", "GitHub"), ("github", "GitHub")]
    assert {r[0] for r in docs.where("doc_id >= 4").select(P.nfc("text")).collect()} == {"é", None, ""}


def test_reports(spark):
    rows = [(1, 0, 1, 1, "軟件", ["軟體"], "cross_strait", "warning", "software"), (1, 9, 2, 3, "軟件", ["軟體"], "cross_strait", "warning", "software"), (1, 5, 1, 6, "a\tb", [""], "case", "info", None), (1, 7, 1, 8, "c", [], "case", "info", "sea")]
    found = spark.createDataFrame(rows, "doc_id long, pos int, line int, col int, found string, suggestions array<string>, rule_type string, severity string, english string")
    assert sorted(r.report for r in P.compact_lines(found).collect()) == ["1:1:W:cross_strait:軟件→軟體 (×2 also at 2:3)", "1:6:I:case:a\tb→(delete)", "1:8:I:case:c→sea"]
    assert "1\t6\tinfo\tcase\ta\\tb\t" in {r.row for r in P.tabular(found).collect()}
    assert P.digests(found).first() == P.digests(found.orderBy("found")).first()
