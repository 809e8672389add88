import pytest

from glyphmill.operators import patterns as P
from glyphmill.operators import rhetoric as R


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


#: detector, a text that has it, its suggestion, and texts that don't have it.
PAIRS = [
    ("redundant_question_particle", "你是不是要去嗎？", "是不是", ["你是不是要去？", "是不是要去。你去嗎？"]),
    ("and_between_clauses", "我來了和他說話", "，", ["我和他說話", "我來了和他們一樣"]),
    ("bare_copula_adjective", "她是漂亮。", "她很漂亮", ["她是很漂亮。", "她是大人。"]),
    ("redundant_preposition", "討論了關於價格", "討論了", ["討論價格", "討論這個那個關於價格"]),
    ("nominalized_verb", "加以分析", "分析", ["分析資料", "進行著一個大分析"]),
    ("verbose_action", "做出了決定", "決定", ["決定了", "做出大的決定"]),
    ("fronted_object", "對資料進行分析", "分析資料", ["針對資料進行分析", "對於資料進行分析", "對資料，進行分析"]),
    ("double_attribution", "根據研究顯示，", "根據研究", ["根據研究，", "根據使用的顯示器的", "根據[報告]顯示"]),
    ("inflated_copula", "系統作為核心", "是", ["系統有所作為", "花園作為家"]),
    ("passive_adverb", "被廣泛使用", "廣泛使用", ["廣泛使用"]),
    ("didactic_closing", "他的故事告訴我們", None, ["故事告訴我們", "他的故事。告訴我們"]),
    ("vague_exaggeration", "領先時代10年", None, ["領先時代很多", "領先時代100年"]),
    ("negative_parallel", "不只是快，而是好", None, ["不只是快。而是好"]),
    ("formulaic_despite", "儘管有挑戰，仍然努力。", None, ["儘管有挑戰。仍然努力"]),
    ("false_range", "從遙遠的北邊到南邊再到東邊", None, ["從北到南再到東", "從遙遠的北邊到南邊的地方"]),
    ("copula_classifier", "他是一位很好的人", None, ["他是一位老師。很好的"]),
    ("adverb_particle", "仔細的看", "仔細地看", ["仔細地看"]),
    ("redundant_particle", "慢慢地走", "慢慢", ["慢慢走"]),
    ("superlative_one_of", "最好的方法之一", None, ["最好的作家之一", "最好。其中之一", "最美之處之一"]),
    ("connective_pair", "因為下雨所以停", None, ["因為下雨。所以停", "敬啟者：因為下雨所以停"]),
    ("connective_in_sentence", "如果你來那麼我走", "如果你來", ["當時他說的時候"]),
    ("nominal_heads", "方案的實施對環境的改善", None, ["方案的實施和環境的改善"]),
    ("head_chain", "分析的理解的發現", None, ["分析的理解"]),
    ("false_friend_gloss", "誠實地說（honestly）", None, ["誠實地說（真的）"]),
]


def test_every_detector_has_a_pair():
    assert {p.detector for p in P.PATTERNS} == {p[0] for p in PAIRS}


def test_pairs(spark):
    texts, wanted = [], []
    for name, bad, new, good in PAIRS:
        texts += [bad, *good]
        wanted += [(name, new), *[(name, False)] * len(good)]
    got = {}
    for r in P.findings(docs_of(spark, *texts)).collect():
        assert texts[r.doc_id][r.pos : r.pos + len(r.found)] == r.found
        got.setdefault((r.doc_id, r.detector), []).append(r.suggestion)
    for i, (name, new) in enumerate(wanted):
        here = got.get((i, name), [])
        assert (not here) if new is False else new in here, (texts[i], name, here)


def test_empty_texts(spark):
    docs = docs_of(spark, None, "", "\n\n")
    assert P.findings(docs).count() == 0 and P.false_friends(docs).count() == 0
    for f in [R.tracked_density, R.paragraph_endings, R.formulaic_headings, R.list_density, R.stacked_politeness, R.mechanical_bullets, R.double_dashes, R.one_of_density, R.tricolons, R.meaning_verbs, R.translated_sentences, R.long_sentences, R.monotone_endings, R.sentence_variability]:
        assert f(docs).count() == 0, f
    assert [r.density for r in R.oral_density(docs).collect()] == [None] * 3


@pytest.mark.parametrize(
    ("detector", "bad", "good"),
    [
        (R.formulaic_headings, "# 結論與展望\n\n## 挑戰與機遇", "# 結論與展望\n\n挑戰與機遇"),
        (R.list_density, "- a\n\n- b\n\n- c\n\nd\n\ne", "- a\n\n- b\n\nc\n\nd\n\ne"),
        (R.stacked_politeness, "- 請看\n- 請聽\n- 請說", "- 請看\n- 聽\n- 請說\n- 請來"),
        (R.mechanical_bullets, "1. **a**\n2. **b**\n3. **c**", "1. **a**\n2. b\n3. **c**"),
        (R.stacked_politeness, "- 請看\n  下一行\n- 請聽\n- 請說", "- 請看\n下一行\n- 請聽\n- 請說"),
        (R.double_dashes, "一——二——三", "一——二\n\n三——四"),
        (R.tricolons, "紅色、白色、黑色。", "紅、白色、黑色。"),
        (R.paragraph_endings, "由此可見\n\n這反映了\n\n不難發現\n\na\n\nb", "由此可見\n\n這反映了\n\na\n\nb\n\nc"),
        (R.long_sentences, "字" * 31, "字" * 14 + "，" + "字" * 14 + "，" + "字" * 14),
        (R.monotone_endings, "他走了。她哭了。我笑了。", "他走了。她哭了。\n\n我笑了。"),
        (R.translated_sentences, "我明天會來，如果沒事的話。", "如果沒事，我明天會來。"),
        (R.one_of_density, "之一" * 60, "之一" + "字" * 120),
        (R.tracked_density, "不容忽視" + "字" * 600, "字" * 600 + "這個"),
    ],
)
def test_rhetoric(spark, detector, bad, good):
    assert {r.doc_id for r in detector(docs_of(spark, bad, good)).collect()} == {0}


def test_meaning_verbs(spark):
    rows = R.meaning_verbs(docs_of(spark, "所謂快意味著好。", "意味著因此改。", "換言之意味著好。", "意味著好。", "好。")).collect()
    assert sorted((r.doc_id, r.suggestion) for r in rows) == [(0, "表示"), (1, "代表"), (2, "也就是說"), (3, None)]
