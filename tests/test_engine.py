import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill import api
from glyphmill.operators import convert as CV
from glyphmill.operators import fixes as FX
from glyphmill.operators import judgement as J
from glyphmill.operators import lexical as L
from glyphmill.operators import masks as M
from glyphmill.operators import quotes as Q
from glyphmill.operators import scores as SC
from glyphmill.operators import segment as G
from glyphmill.operators import style as ST
from glyphmill.plans import seed
from glyphmill.sources import files, sinks, stores


def rule(term, to, kind="cross_strait", english=None, clues=(), negative=(), exceptions=(), positional=(), groups=(), confidence=None):
    return L.Rule(term, list(to), kind, english, "warning", list(clues), list(negative), list(exceptions), [p for c in positional if (p := L._positional(c))], [(list(a), list(b)) for a, b in groups], confidence)


def hits(text, *rules, words=(), mask=()):
    return [(r[0], r[5], r[6]) for r in L.Scanner(list(rules), set(words)).scan(text, list(mask))]


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# ---- matching


def test_leftmost_longest_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        terms = list({"".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 4))) for _ in range(5)})
        text = "".join(rng.choice("甲乙丙丁") for _ in range(30))
        s = L.Scanner([L.Rule(t, [], "phrase", None, "info", [], [], [], [], [], None) for t in terms])
        want, at = [], 0
        while at < len(text):
            best = max((t for t in terms if text.startswith(t, at)), key=len, default=None)
            if best:
                want.append((at, at + len(best), terms.index(best)))
            at += len(best) if best else 1
        assert list(s.hits(text)) == want


def test_absorbers_and_covering_forms():
    assert hits("程序員寫程序", rule("程序", ["程式"], exceptions=["程序員"])) == [(4, "程序", ["程式"])]
    assert hits("數據集和數據", rule("數據", ["數據集"])) == [(4, "數據", ["數據集"])]
    # An exception that would hide another rule's term is no absorber, but still covers its own.
    two = [rule("程序", ["程式"], exceptions=["程序庫房"]), rule("庫房", ["倉庫"])]
    assert L.absorbers(two) == [] and hits("程序庫房", *two) == [(2, "庫房", ["倉庫"])]


def test_words_across_the_edges():
    r = rule("積分", ["點數"])
    assert hits("累積分佈", r, words=["累積", "分佈"]) == [] and hits("積分很多", r, words=["累積", "分佈"]) == [(0, "積分", ["點數"])]
    # A word that begins inside the match is another way to cut the text, not a clash.
    assert hits("積分佈", r, words=["分佈"]) == [(0, "積分", ["點數"])]
    assert hits("積分佈局", r, words=["積分佈"]) == []


def test_clues():
    r = rule("文件", ["檔案"], clues=["打開"], negative=["公文"])
    assert hits("打開" + "字" * 38 + "文件", r) and not hits("打開" + "字" * 41 + "文件", r)
    assert hits("文件" + "字" * 39 + "打開", r)  # it begins in the window
    assert not hits("打開\n\n文件", r) and not hits("打開\n\r\n文件", r) and not hits("打開公文文件", r)
    assert not hits("打開`x`文件", r, mask=[(2, 5)]) and not hits("打開文件", r, mask=[(3, 4)])


@pytest.mark.parametrize(
    ("clue", "good", "bad"),
    [("before:乙", "文件甲乙", "乙文件"), ("after:乙", "乙甲文件", "文件乙"), ("adjacent:乙", "乙文件", "乙甲文件甲乙"), ("not_before:乙", "乙文件", "文件乙"), ("not_after:乙", "文件乙", "乙文件"), ("before:乙", "文件" + "甲" * 19 + "乙", "文件" + "甲" * 20 + "乙"), ("before:乙", "文件乙", "文件\n\n乙")],
)
def test_positional_clues(clue, good, bad):
    r = rule("文件", ["檔案"], positional=[clue])
    assert hits(good, r) and not hits(bad, r)


def test_groups_deletions_and_fallbacks():
    r = rule("視頻", ["影片", "短片"], groups=[(["會議"], ["視訊"]), (["會"], ["視"])])
    assert hits("視頻會議", r)[0][2] == ["視訊"] and hits("會視頻", r)[0][2] == ["視"] and hits("視頻\n\n會議", r)[0][2] == ["影片", "短片"]
    filler = rule("總而言之", [""], "ai_filler")
    got = L.Scanner([filler]).scan("總而言之，好。總而言之好")
    assert [(i[0], i[1], i[5], i[6]) for i in got] == [(0, 5, "總而言之", [""]), (7, 4, "總而言之", [""])]
    assert L.Scanner([filler]).scan("總而言之，", [(4, 5)])[0][1] == 4
    assert rule("甲", ["", ""], english="a").suggestions == ["a"] and rule("甲", []).suggestions == []


def test_profiles_guards_and_groups_that_go(spark):
    rules = seed.features(spark)
    every = {r.term: r for r in L.collected(rules)}
    assert "研究顯示" not in every and every["視頻"].groups == [(["會議"], ["視訊"])]
    assert [r.term for r in L.collected(rules, guard="attribution")] == ["研究顯示"]
    assert {"總而言之", "裏"} & {r.term for r in L.collected(rules, L.BASE)} == set() and "裏" in {r.term for r in L.collected(rules, L.STRICT)}
    neutral = {r.term for r in L.collected(rules, L.Profile(stance="neutral"))}
    assert "內地" not in neutral and "內地" in every
    assert {tuple(r) for r in L.problems(rules).collect()} == {("視頻", "malformed group"), ("文件", "replaced by itself")}


# ---- fixes


def issue(pos, found, suggestions, kind="cross_strait", size=None, **more):
    return {"pos": pos, "size": len(found) if size is None else size, "found": found, "suggestions": suggestions, "rule_type": kind, "severity": "warning", "clues": [], "confidence": None, **more}


def test_verdicts():
    v = lambda i, tier, seg=None, text="打開文件": FX.verdict(i, text, tier, [], seg)[0]
    word = issue(2, "文件", ["檔案"])
    assert [v(word, t) for t in FX.TIERS[1:]] == ["skip", "apply", "apply"]
    assert v(issue(0, "x", ["y"], "case"), "orthographic") == "apply" and v(issue(0, "x", ["y", "z"], "case"), "orthographic") == "decline"
    clued = issue(2, "文件", ["檔案"], clues=["打開"])
    assert v(clued, "lexical_safe") == "skip" and v(clued, "lexical_contextual") == "decline"
    assert v(clued, "lexical_contextual", G.Segmenter({"打開": 1, "文件": 1})) == "apply"
    assert v({**clued, "rule_type": "confusable"}, "lexical_contextual", G.Segmenter({"打開": 1})) == "decline"
    assert v({**word, "confidence": "low"}, "lexical_safe") == "decline" and v({**word, "confidence": "low"}, "lexical_contextual") == "apply"
    assert v({**word, "outcome": "suppressed"}, "lexical_safe") == "decline" and v({**word, "anchor": False}, "lexical_contextual") == "decline"
    assert v(issue(0, "文", []), "lexical_safe") == "skip" and v({**word, "advisory": True}, "lexical_safe") == "skip"
    hidden = issue(1, "​", [""], "ai_style")
    assert v(hidden, "orthographic") == "apply" and v({**hidden, "found": "‍"}, "lexical_contextual") == "decline"


def test_writing_masks_and_barriers():
    text = "對資料進行分析，軟件AB"
    issues = [issue(0, "對資料進行分析", ["分析資料"], "grammar"), issue(3, "進行分析", ["分析"], "grammar"), issue(8, "軟件", ["軟體"]), issue(10, "", [" "], "punctuation")]
    assert FX.applied(text, issues, "lexical_safe", [])[0] == "分析資料，軟體 AB"
    # The outer span touches the mask: what lies inside it stays too.  An insertion at a mask's edge is outside it.
    assert FX.applied(text, issues, "lexical_safe", [(1, 2), (10, 12)])[0] == "對資料進行分析，軟體 AB"
    assert FX.applied(text, issues, "lexical_safe", [(9, 11)])[0] == "分析資料，軟件AB"
    assert FX.applied(text, issues, "none", [])[0] == text


def test_places_after_fixes():
    rng = random.Random(3)
    for _ in range(100):
        text = "".join(rng.choice("甲乙丙") for _ in range(20))
        starts = sorted(rng.sample(range(0, 18, 3), 3))
        issues = [issue(s, text[s : s + 2], ["丁" * rng.randint(0, 4)]) for s in starts]
        new, fixes, _ = FX.applied(text, issues, "lexical_safe", [])
        for pos in range(20):
            if not any(f["pos"] <= pos < f["pos"] + f["size"] for f in fixes):
                assert new[FX.moved(pos, fixes)] == text[pos]
        assert all(set(new[a:b]) <= {"丁"} for a, b in FX.written(fixes))
        for a, b in [(p, p + 1) for p in range(20) if not any(f["pos"] <= p < f["pos"] + f["size"] for f in fixes)]:
            (x, y), *_ = FX.moved_mask([(a, b)], fixes)
            assert new[x:y] == text[a:b]


def test_rescans(spark):
    rules = [rule("甲", ["乙"]), rule("乙", ["丙"]), rule("丁", ["戊", "己"])]
    got = FX.rescanned(docs_of(spark, "甲和丁和乙"), L.Scanner(rules)).collect()
    assert [(r.text, r.pos, r.found, r.old_pos) for r in got] == [("乙和丁和丙", 2, "丁", 2)]
    state = FX.restored([issue(2, "丁", [])], [issue(2, "丁", [], severity="info")], [])
    assert state[0]["severity"] == "info"


# ---- conversion


def test_conversion_and_its_fixed_point(spark):
    c = CV.Converter.of(CV.dictionary(CV.sample(spark)))
    assert c("头发和皇后以后的发现") == "頭髮和皇后以後的發現" and c("这是裏面的羣") == "這是裡面的群"
    rounds = CV.fixpoint(docs_of(spark, "这个甲", None), c, L.Scanner([rule("甲", ["乙"]), rule("乙", ["丙"])])).collect()
    assert sorted(((r.text, r.rounds, r.n_applied) for r in rounds), key=repr) == sorted([("這個丙", 3, 2), (None, 0, 0)], key=repr)


def test_dictionaries_from_files(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("# a comment\n甲乙\t丙丁 x\n甲乙\tzz\n甲\t甲\n台风\t台風\n\nno tab\n")
    entries = CV.read(spark, str(tmp_path / "p.tsv"), "phrase")
    extra = spark.createDataFrame([("phrase", "台风", "颱風", 0)], "kind string, key string, value string, ord long")
    got = {r.key: r.value for r in CV.dictionary(entries, extra).collect()}
    assert got == {"甲乙": "丙丁", "台风": "颱風"}


def test_composed_places():
    import unicodedata

    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", "é", "中", "가", "Å", "ố", "軟件", " "]) for _ in range(8))
        new, places = CV.composed(text)
        assert new == unicodedata.normalize("NFC", text) and len(places) == len(new) + 1 and places == sorted(places)
        for m in re.finditer("軟件", new):
            assert text[places[m.start()] : places[m.end()]] == "軟件"


# ---- marks


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("他說“你好”。", "他說「你好」。"),
        ("他說“你好‘嗎’”。", "他說「你好『嗎』」。"),
        ("他說“外“裡”外”。", "他說「外『裡』外」。"),
        ("他引用了：“Do one thing.”", None),
        ("He said “你好” then left.", None),
        ("請按“Enter”鍵", "請按「Enter」鍵"),
        ('他說"你好"。', "他說「你好」。"),
        ("it‘s 他’s 好", None),
        ("“敏捷開發”", "「敏捷開發」"),
        ("他說“再見“好", "他說「再見」好"),
        ("他說你好”", "他說你好」"),
    ],
)
def test_quotation_marks(text, want):
    out = list(text)
    for pos, found, new in Q.quotes(text):
        assert text[pos] == found
        out[pos] = new
    assert "".join(out) == (want or text)


def test_masked_quotes():
    assert [x[0] for x in Q.quotes("他說“`中`”", [(3, 6)])] == [2, 6]  # a term without white space, beside Chinese
    assert list(Q.quotes('他說"https://a', [(3, 12)])) == [(2, '"', "「")]
    assert list(Q.quotes('他說"a"', [(4, 5)])) == []  # its partner was passed over


@pytest.mark.parametrize(
    ("kernel", "text", "places"),
    [
        (Q.half_width, "你好, 世界!", [2, 6]),
        (Q.half_width, "他說 I agree, 好", []),
        (Q.half_width, "使用 Google Chrome, 好", [16]),
        (Q.half_width, "用 Node.js, 好", [9]),
        (Q.half_width, "數 1,000 好", []),
        (Q.half_width, "好![圖](x)", []),
        (Q.half_width, "（好）,x", [3]),
        (Q.ranges, "三~五 京-滬 1~2 約~3 好 ~ 壞", [1, 5, 18]),
        (Q.ranges, "- 好\n好--好", []),
        (Q.ellipses, "好... a... 。。。 x = ...好 好…… 好… 第一章.....1", [1, 6, 10, 28]),
        (Q.ellipses, "// 好...", []),
        (Q.enumerations, "有，甲，乙，丙丁，好的很長啊", [1, 3, 5, 8]),
        (Q.enumerations, "有，甲，很長的一段話，乙", []),
        (Q.stops, "好 .\n好..x.好.a", [2]),
        (Q.colons, "他說:好", [2]),
        (Q.colons, "12:30 好", []),
        (Q.colons, "[好]: x", []),
        (Q.colons, "好\n: 定義", []),
        (Q.brackets, "中文(註解)好", [2, 5]),
        (Q.brackets, "上海(1957 成立)。", []),
        (Q.brackets, "甲(乙(丙)丁)戊", [1, 3, 5, 7]),
        (Q.brackets, "甲(乙\n丙)丁", []),
        (Q.brackets, "甲(" + "乙" * 200 + ")丁", []),
    ],
)
def test_half_width(kernel, text, places):
    assert [x[0] for x in kernel(text)] == places


# ---- rhetoric


def families(text, *detectors, mask=()):
    return [(f[0], f[1]) for f in ST.found_in(text, list(mask), detectors or None)]


def test_rhetoric():
    contrast = "雖然快，但貴。不僅好，更妙。即使雨，也好，不過冷。" * 3
    assert families(contrast + "字" * 430, ST.binary_contrast) == [("binary_contrast", 0)] and not families(contrast, ST.binary_contrast)
    assert families("研究顯示好。氣象署專家認為冷。根據研究顯示好。研究顯示好[1]。研究顯示器的價格。", ST.uncited_attributions) == [("uncited_attribution", 0)]
    assert families("研究顯示\n成果[1]。", ST.uncited_attributions) == [] and families("研究顯示好\n\n見[1]。", ST.uncited_attributions) == [("uncited_attribution", 0)]
    assert families("前面。展望未來，好。\n\n# 節\n展望未來的中段。後面。", ST.section_endings) == [("formulaic_closing", 3)]
    assert families("展望未來，好。後面。", ST.section_endings) == [] and families("前面。未來可期！（註）", ST.section_endings) == [("formulaic_closing", 3)]
    assert families("這奠定了理論基礎。隨著科技不斷發展。", ST.section_endings) == [("significance_stamp", 1), ("era_opener", 9)]
    assert families("**甲**和**乙**好。", ST.excessive_bold) == [("bold_in_sentence", 0)]
    assert families("這條線是一條線，這條路會延伸。", ST.line_metaphor) == [("line_metaphor", 4)] and not families("這條線是一條線。\n\n這條線會延伸。", ST.line_metaphor)
    slogan = "越來越好，越走越遠的人生。"
    assert families(f"{slogan}\n\n{slogan}\n\n{slogan}", ST.repeated_slogans) == [("repeated_slogan", 0)] and not families(slogan + slogan, ST.repeated_slogans)
    asked = "你以為快嗎？錯了。那為什麼慢？主要是因為沒想。"
    assert families(asked, ST.self_questions) == [("self_question", 0)] and not families("FAQ：" + asked, ST.self_questions) and not families("為什麼慢？因為沒想。為什麼好？因為想嗎。", ST.self_questions)
    assert [f[3] for f in ST.found_in("可以說是好。" * 3 + "字" * 40, [], [ST.hedges])] == ["warning"] * 3 and [f[3] for f in ST.found_in("可以說是好。", [], [ST.hedges])] == ["info"]


def test_mentions_are_no_use():
    assert families("他寫「研究顯示」這四個字。", ST.uncited_attributions) == [] and families("- [ ] 研究顯示\n> - ❌ 研究顯示", ST.uncited_attributions) == []
    assert families("「沒關，研究顯示好", ST.uncited_attributions) == [("uncited_attribution", 4)]
    assert families('他說"研究顯示"好', ST.uncited_attributions) == []


@pytest.mark.parametrize(
    ("text", "places"),
    [("a​b", [1]), ("﻿a﻿", [2]), ("👩‍🚀", []), ("👩🏻‍🚀 👩‍🏻", [6]), ("x‍y", [1]), ("می‌خواهم", []), ("a‌b", [1]), ("क्‍ष", []), ("क‍ष", [1]), ("字\U000e0100", []), ("a\U000e0100", [1]), ("‎‏", []), ("a­b⁠", [1, 3]), ("\U0001f3f4" + "".join(chr(0xE0000 + ord(c)) for c in "gbeng") + "\U000e007f", []), ("\U0001f3f4\U000e0067\U000e007f", [1, 2]), ("﷐", [0]), ("👩❤️‍👩", [])],
)
def test_invisible_characters(text, places):
    assert [f[1] for f in ST.invisible(text, [])] == places


def test_long_premodifiers():
    long = "一個在昨天下午的會議中由大家共同提出的非常重要的建議"
    assert [(f[0], f[1]) for f in ST.long_premodifiers(f"這是{long}。", [])] == [("long_premodifier", 0)]
    for other in (f"他{long}。", "重要的建議。", f"昨天看到{long}。", "在昨天下午的會議中大家才提出的非常重要的建議。", "在昨天下午的，會議中由大家的，共同提出的建議。"):
        assert not list(ST.long_premodifiers(other, [])), other
    one = "在昨天下午由大家共同討論以後提出的非常重要建議"
    assert not list(ST.long_premodifiers(one, [])) and [f[0] for f in ST.long_premodifiers(one, [], rhythm=True)] == ["rhythm_premodifier"]


# ---- words, sentences, chunks


def test_segmenter_against_all_chunks():
    words = {"研究": 1, "研究生": 1, "生命": 5, "命": 10, "起源": 5, "生": 10}
    seg = G.Segmenter(words)
    assert [t for _, t, _ in seg.tokens("研究生命起源")] == ["研究", "生命", "起源"]
    assert seg.clues("研究生命", ["研究", "生", "源", "生"]) == 2
    rng = random.Random(2)
    vocabulary = {"".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 3))): rng.randint(1, 9) for _ in range(9)}
    seg = G.Segmenter(vocabulary)
    for _ in range(100):
        text = "".join(rng.choice("甲乙丙丁") for _ in range(9))
        options = lambda at: [1] + [n for n in (2, 3) if text[at : at + n] in vocabulary and at + n <= len(text)]  # noqa: B023, E731
        at, want = 0, []
        while at < len(text):
            chunks = []
            for a in options(at):
                for b in options(at + a) if at + a < len(text) else [None]:
                    for c in options(at + a + b) if b and at + a + b < len(text) else [None]:
                        sizes = [n for n in (a, b, c) if n]
                        cuts = [at + sum(sizes[:i]) for i in range(len(sizes))]
                        mean = sum(sizes) / len(sizes)
                        single = sum(vocabulary.get(text[x], 0) for x, n in zip(cuts, sizes) if n == 1)
                        chunks.append((sum(sizes), mean, -round(sum((n - mean) ** 2 for n in sizes), 9), single, a))
            n = max(chunks)[-1]
            want.append(text[at : at + n])
            at += n
        assert [t for _, t, _ in seg.tokens(text)] == want


def test_sentences_and_chunks(spark):
    text = "你好。Dr. Smith went. Then 他 3.5 好！ok?\n\n最後"
    assert [text[a:b] for a, b in G.sentence_spans(text)] == ["你好。", "Dr. Smith went.", "Then 他 3.5 好！", "ok?", "最後"]
    assert [("甲`x`乙")[a:b] for a, b in G.sentence_spans("甲`x`乙", [(1, 4)])] == ["甲", "乙"]
    assert G.sentence_of([(0, 3), (4, 9)], 3) is None and G.sentence_of([(0, 3), (4, 9)], 4) == 1
    body = "# 節\n甲乙丙\n- 項目一\n- 項目二\n\n別的"
    at = body.index("項目二")
    a, b = G.chunk_span(body, at, at + 3)
    assert body[a:b] == "- 項目二"
    long = "甲。" * 1000
    a, b = G.chunk_span(long, 1000, 1002)
    assert a <= 1000 and b >= 1002 and 400 <= b - a <= 500
    got = G.placed(spark.createDataFrame([(1, "甲。乙。", 2), (2, "甲", None)], "doc_id long, text string, pos int")).collect()
    assert sorted(((r.doc_id, r.n, r.sentence) for r in got)) == [(1, 1, "乙。"), (2, None, None)]


# ---- masks


def test_masks_by_content_type():
    text = "---\ntitle: \"軟件\"\n---\nkey: 值\n> 引\n\n    code\n[標](a.md \"題\") [x][y]\n[y]: http://z/w\n::: n\n<p lang=en>信息</p>"
    cut = lambda t, **k: [text[a:b] for a, b in M.mask_of(text, t, **k)]
    md = cut("markdown")
    assert "title:" in "".join(md) and not any("軟件" in x for x in md) and any("code" in x for x in md) and any("信息" in x for x in md) and not any("引" in x for x in md)
    assert any("引" in x for x in cut("markdown", blockquotes=True)) and any('](a.md "題")' in x for x in md)
    assert any(x.startswith("key:") for x in cut("yaml")) and not any("值" in x for x in cut("yaml"))
    assert not any("code" in x for x in cut("markdown-scan-code")) and not any("key" in x for x in cut("plain"))
    with pytest.raises(ValueError):
        M._typed("html")


def test_foreign_scopes_of_html():
    cut = lambda h: [h[a:b] for a, b in M.foreign_spans(h)]
    assert cut("<ul><li lang=en>a<li>中</ul>") == ["a"] and cut("<p lang=en>a<div>中</div>") == ["a"]
    assert cut("<script lang=en>if (a<b) </p></script>中") == ["if (a<b) </p>"]
    deep = "<div>" * 600 + "<p lang=en>x</p>"
    assert cut(deep) == []  # beyond the depth nothing is opened


# ---- judgement, scores


def test_disambiguation(spark):
    j = lambda text, found, sugg, clues=(), profile="base", anchor=None: J.judged(text, text.index(found), len(found), found, list(sugg), list(clues), profile, anchor)
    assert j("進程排程", "進程", ["處理程序", "行程"]) == (1.0, "collocation", "行程")
    assert j("學習的進程", "進程", ["行程"]) == (0.0, "suppressed", None)
    assert j("進程", "進程", ["行程", "處理程序"], anchor=True)[1] == "gray_zone" and j("甲", "甲", ["乙"], anchor=True) == (1.0, "hard_anchor", "乙")
    assert j("內存條", "內存", ["記憶體"], ["條"])[:2] == (1.0, "context_clue") and j("內存", "內存", ["記憶體"], ["條"], "strict")[1] == "gray_zone"
    assert j("甲", "甲", ["乙", "丙"])[1] == "suppressed"
    rows = [rule("進程", ["處理程序", "行程"]), rule("甲", ["乙", "丙"]), rule("丁", ["戊"])]
    got = {r.found: r for r in J.disambiguated(docs_of(spark, "進程排程，甲丁"), L.Scanner(rows)).collect()}
    assert got["進程"].suggestions == ["行程", "處理程序"] and got["進程"].tier == "heuristic" and got["甲"].severity == "info" and got["丁"].tier == "deterministic"
    counts = J.tiers(J.disambiguated(docs_of(spark, "進程排程，甲丁"), L.Scanner(rows))).first()
    assert (counts.deterministic, counts.heuristic, counts.unresolved, counts.high, counts.low) == (1, 1, 1, 2, 1)


def test_tables_and_sections(spark):
    text = "x\n| 甲 | 乙\\|c |\n|---|:-:|\n| 軟件 | b |\n\n題\n---\n\n- a\n***\n> # q\n    # no\n##x\n# y"
    assert [(text[a:b], r, c) for a, b, r, c in J.cell_spans(text)] == [("甲", 0, 0), ("乙\\|c", 0, 1), ("軟件", 1, 0), ("b", 1, 1)]
    got = J.section_starts(docs_of(spark, text)).collect()
    assert sorted((r.pos, r.kind) for r in got) == [(text.index("題"), "heading"), (text.index("***"), "rule"), (text.index("# y"), "heading")]


def test_scores():
    plain = "字" * 600
    assert SC.machine_score("字" * 499, [], []) is None and SC.machine_score(plain, [], [])["score"] == 0
    heavy = "不容忽視" * 5 + plain
    one = SC.machine_score(heavy, [], [])
    assert one["score"] == pytest.approx(0.7) and one["top_signals"] == ["不容忽視"]
    assert SC.machine_score(heavy, [], [], mentions=[(0, 20)])["score"] == 0
    found = [("binary_contrast", 0, "", "info", ""), ("bold_in_sentence", 0, "", "info", ""), ("invisible_character", 0, "", "warning", "")]
    assert SC.machine_score(plain, [], found)["score"] == pytest.approx(0.1 + 0.05 + 0.2 / 3)
    even = "，".join(["字" * 9] * 60)
    assert SC.machine_score(even, [], [])["score"] == pytest.approx(0.1)
    assert SC.translated_score("被" * 199, [], 0) is None
    two = SC.translated_score("被" * 2 + "字" * 398, [], 0)
    assert two["score"] == pytest.approx((5 - 3) / 3 * 1.0 / 3.6) and two["top_signals"] == ["被動語態"]
    assert SC.weak_verbs("進行了討論，加以分析，進行中") == 2 and SC.longest_chain("的的，的的的") == 3
    assert SC.oral_density("就是說" + "字" * 27, ["就是", "就是說"]) == pytest.approx(0.1) and SC.oral_density("啊", ["啊"]) is None


# ---- sources, sinks, front


def test_globs_changes_and_broken_files(spark, tmp_path):
    fits = lambda g, p: re.search("^" + files.glob_pattern(g), p) is not None
    assert fits("*.md", "a/b.md") and not fits("*.md", "a/b.mdx") and fits("docs/", "docs/x/y.md") and fits("a/**/z.md", "a/b/c/z.md") and fits("a/**/z.md", "a/z.md") and fits("?[!b].txt", "ac.txt") and not fits("?[!b].txt", "ab.txt")
    root = tmp_path / ".hidden" / "in"
    (root / "skip").mkdir(parents=True)
    (root / ".git").mkdir()
    for name, data in {"a.md": "軟件".encode(), "bad.txt": b"\xff\xfe", "skip/b.md": b"x", ".git/c.md": b"x"}.items():
        (root / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.unreadable) for r in files.scan_files(spark, str(root), ["skip/"]).collect()}
    assert got == {"a.md": ("軟件", False), "bad.txt": (None, True)}
    assert [r.path.rsplit("/", 1)[1] for r in files.changed(files.scan_files(spark, str(root)), ["./skip/b.md", "none.md"]).collect()] == ["b.md"]
    assert [(r.text, r.unreadable) for r in files.from_stream(spark, io.BytesIO("字".encode())).collect()] == [("字", False)]
    assert files.from_stream(spark, io.BytesIO(b"\xff")).first().unreadable and files.from_stream(spark, io.BytesIO(b"xx"), most=1).first().too_large


def test_stores(spark, tmp_path):
    (tmp_path / "s.json").write_text(stores.as_json([{"found": "軟件"}, {"found": None}]) + "{broken\n")
    assert {r.found for r in stores.read(spark, str(tmp_path / "s.json"), "suppressions").collect()} >= {"軟件"}
    with pytest.raises(ValueError):
        stores.read(spark, "x", "nothing")
    assert stores.project('exclude = ["a"]\nmax_errors = 1') == {"exclude": ["a"], "max_errors": 1}
    for bad in ("nothing = 1", 'max_errors = "x"'):
        with pytest.raises(ValueError):
            stores.project(bad)
    rules = seed.rules(spark)
    assert stores.ruleset_digest(rules).first() == stores.ruleset_digest(rules.orderBy("from")).first() != stores.ruleset_digest(rules.where("`from` <> '軟件'")).first()
    pack = spark.createDataFrame([(9, 1, "甲", ["乙"], "cross_strait", None, None, False, [], [], [], [], [], [], None, None)], L.RULES)
    stores.export(pack, str(tmp_path / "pack"))
    back = stores.imported(rules, stores.read(spark, str(tmp_path / "pack"), "pack"), 5)
    assert back.where("`from` = '甲'").first()["layer"] == 5
    with pytest.raises(ValueError, match="replaced by itself"):
        stores.imported(rules, pack.withColumn("to", F.array(F.lit("甲"))), 6)
    now = F.current_timestamp()
    docs = docs_of(spark, "軟件", "信息", "軟件")
    entries = stores.cache_entries(docs, L.issues(docs, rules), "k", now)
    assert entries.count() == 2 and stores.uncached(docs, entries, "k", now).count() == 0 and stores.uncached(docs, entries, "other", now).count() == 3
    assert sorted((r.doc_id, r.issues[0]["found"]) for r in stores.cached(docs, entries, "k", now).collect()) == [(0, "軟件"), (1, "信息"), (2, "軟件")] and stores.pruned(entries, 1).count() == 1


def test_reports_of_a_scan(spark, tmp_path):
    docs = docs_of(spark, "這個軟件\n軟件", "沒有")
    issues = L.issues(docs, seed.rules(spark))
    report = {r.doc_id: json.loads(r.json) for r in sinks.json_report(issues, docs).collect()}
    assert report[0]["total"] == 2 and report[0]["issues"][0]["offset"] == 6 and report[1]["issues"] == []
    whole = "".join(r.content if r.part != 1 else "" for r in sinks.sarif_report(issues).orderBy("part", "n").collect())
    results = [json.loads(r.result) for r in sinks.sarif_results(issues).collect()]
    assert json.loads(whole)["runs"][0]["tool"]["driver"]["rules"][0]["id"] == "glyphmill/cross_strait" and {r["level"] for r in results} == {"warning"}
    fixed = FX.fixed(docs, L.scanner(seed.rules(spark)))
    diff = sinks.search_replace(fixed, docs).first()["diff"]
    text = docs.first().text
    for a, b in re.findall("<<<<<<< SEARCH\n(.*)\n======= REPLACE\n(.*)\n>>>>>>> END\n", diff):
        text = text.replace(a, b, 1)
    assert text == "這個軟體\n軟體"
    raw = docs.first().text.encode()
    for line in sinks.patches(fixed, docs).first().patch.splitlines()[2:]:
        at, n, _, new = line.split("\t")
        raw = raw[: int(at)] + new.encode() + raw[int(at) + int(n) :]
    assert raw.decode() == "這個軟體\n軟體"
    sinks.write_fixed(fixed, str(tmp_path / "out"))
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"這個軟體\n軟體", "沒有"}
    with pytest.raises(ValueError):
        sinks.output(issues, docs, "nothing")


def test_checked_calls(spark, tmp_path):
    docs, rules = docs_of(spark, "看 `軟件` 和軟件", "# 信息\n軟件"), seed.rules(spark)
    out = api.check(docs, rules, content_type="markdown", fix="lexical_safe", fix_output="patch", max_errors=0, ignore_terms=("信息",), include_stats=True, consistency=True, detect_style=True, explain=True)
    assert {r.doc_id: r.text for r in out["fixed"].collect()} == {0: "看 `軟件` 和軟體", 1: "# 資訊\n軟體"}
    assert {(r.doc_id, r.found, r.severity) for r in out["issues"].collect()} == {(0, "軟件", "warning"), (1, "信息", "info"), (1, "軟件", "warning")}
    assert out["gate"].first().passed and out["stats"].first().issues == 3 and out["diff"].count() == 2 and out["scores"].count() == 2 and out["consistency"].count() == 0
    for bad in ({"nothing": 1}, {"profile": "x"}, {"fix": "all"}):
        with pytest.raises(ValueError):
            api.check(docs, rules, **bad)
    api.register(spark, rules)
    assert spark.sql("SELECT detect_script('这个'), s2t('这个'), ai_score('x')").first()[:] == ("simplified", "這個", None)
    assert [r.found for r in spark.sql("SELECT * FROM lint_issues('軟件')").collect()] == ["軟件"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("網络 网络 軟件")
    stores.export(rules.withColumn("x", F.lit(1)).drop("x"), str(tmp_path / "rules"))
    spark.read.json(str(tmp_path / "rules"))
    rules.write.mode("overwrite").json(str(tmp_path / "rules"))
    run = lambda *more: api.main(["lint", str(tmp_path / "in"), "--rules", str(tmp_path / "rules"), "--out", str(tmp_path / "out"), *more])
    assert run() == 0 and run("--max-errors", "0") == 1
    (tmp_path / "in" / "b.txt").write_bytes(b"\xff")
    assert run("--format", "sarif") == 2


def test_whole_scans(spark):
    from glyphmill.operators import scan as SN

    text = "# 軟件,好\n這個軟件AB, 他說“你好”。研究研究。`軟件`\n「進行測試」是詞。進行測試。"
    docs, scanner = docs_of(spark, text, None, ""), L.scanner(seed.rules(spark))
    rows = SN.scanned(docs, scanner, "markdown", raise_headings=True).collect()
    got = [(r.found, r.severity, r.phase) for r in rows]
    assert got[0] == ("軟件", "error", "lexical") and ("“", "warning", "syntactic") in got and ("研究研究", "info", "syntactic") in got and ("", "info", "syntactic") in got
    assert [r.pos for r in rows] == sorted(r.pos for r in rows) and sum(r.found == "軟件" for r in rows) == 2
    assert all(text[r.pos : r.pos + len(r.found)] == r.found and text.encode()[: r.byte_offset].decode() == text[: r.pos] for r in rows)
    off = SN.scanned(docs, scanner, "markdown", [f for f in SN.FAMILIES if f != "quotes"]).collect()
    assert {r.family for r in off} == {"quotes"}
    with pytest.raises(ValueError):
        SN.scanned(docs, scanner, off=["nothing"])
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.randrange(12), rng.randrange(4), "x", [], "case", rng.choice(J.SEVERITY), "f", "lexical") for _ in range(8)]
        kept = SN.survivors(rows)
        want = []
        for r in sorted(rows, key=lambda r: (-r[1], J.SEVERITY.index(r[5]), r[0])):
            if not any(k[0] < r[0] + r[1] and r[0] < k[0] + k[1] for k in want):
                want.append(r)
        assert kept == want
