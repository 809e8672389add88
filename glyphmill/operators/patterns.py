"""Detectors that are a pattern and guards on its neighbourhood: grammar, stock style and translated syntax.

A detector reports the leftmost non-overlapping matches of its pattern whose surroundings fit.  Patterns use only what
both Java's expressions and RE2 know, so that they can be checked by SQL.  Positions are code points.  Texts that are
null or empty have no findings.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import kernels as K
from glyphmill.functions import text as X
from glyphmill.operators import lexical as L

#: Characters of a sentence and of a clause, and ideographs.
S = r"[^。？！?!\n]"
CLAUSE = r"[^，,。；;：:？！?!\n]"
CJK = rf"[{X.IDEOGRAPH}]"

#: Word lists.
A_NOT_A = ["是不是", "有沒有", "能不能", "會不會", "要不要", "好不好", "對不對", "行不行", "可不可以", "願不願意", "想不想", "知不知道", "喜不喜歡", "認不認識", "做不做", "吃不吃", "去不去", "來不來", "看不看", "走不走"]
PRONOUNS = ["我們", "你們", "他們", "她們", "這個", "那個", "我", "你", "他", "她", "它", "這", "那"]
ADJECTIVES = ["漂亮", "高興", "開心", "難過", "傷心", "生氣", "快樂", "緊張", "害怕", "著急", "無聊", "好看", "難看", "厲害", "聰明", "容易", "笨", "冷", "熱", "忙", "累", "餓", "渴", "胖", "瘦", "大", "小", "多", "少", "長", "短", "高", "矮", "好", "壞", "新", "舊", "快", "慢", "早", "晚", "遠", "近", "深", "淺", "重", "輕", "難"]
NOMINALIZED = ["討論", "分析", "研究", "調查", "測試", "開發", "設計", "評估", "檢查", "審查", "修改", "更新", "比較", "溝通", "合作", "訓練", "處理", "管理", "規劃", "改善", "調整", "整合", "驗證", "觀察", "監控", "維護"]
OBJECTS = ["決定", "回應", "貢獻", "改變", "調整", "承諾", "解釋", "判斷", "選擇", "反應", "讓步", "保證", "回答", "犧牲", "努力"]
TECHNICAL = ["系統", "程式", "函式", "API", "介面", "模組", "元件", "架構", "伺服器", "資料庫"]
PERSONS = ["畫家", "學者", "作家", "工程師", "程式設計師", "設計師", "研究員", "運動員", "球員", "演員", "歌手", "作者", "記者", "教授", "醫師", "醫生"]
NOMINAL_HEADS = ["的實施", "的分析", "的講解", "的理解", "的認識", "的發現", "的提升", "的下降", "的改善"]
ABSTRACT_HEADS = ["實施", "分析", "講解", "理解", "認識", "發現", "提升", "下降", "改善", "評估", "探索", "建構", "推動", "落實", "形成", "確立", "發展", "建立", "促進", "強化", "深化", "整合", "統合", "落地", "規劃", "執行"]
PARTICLE_MIXUPS = ["仔細的看", "認真的聽", "慢慢的走", "靜靜的坐", "快速的跑", "努力的工作", "安靜的離開", "輕輕的放", "默默的承受", "悄悄的走"]
REDUNDANT_PARTICLES = ["慢慢地", "靜靜地", "認真地", "安靜地", "輕輕地", "默默地", "悄悄地", "漸漸地", "緩緩地", "偷偷地"]
FALSE_FRIENDS = ["實際上", "字面上", "基本上", "絕對地", "肯定地", "明顯地", "嚴肅地表示", "誠實地說"]
SKIPPED_AFTER_WHEN = "下時作初今年日前地局事中然面選權代"


def any_of(words: list[str]) -> str:
    return "(" + "|".join(words) + ")"


@dataclass(frozen=True)
class Pattern:
    """``before``, ``after``: what the ``reach`` characters on that side need; ``no_*``: what they must not have.

    ``near`` is needed within 26 characters of either side; ``no_found`` must not be in the match itself.  A suggestion
    is a template of groups (``replaced``), or the match with one string for another (``swap_from``, ``swap_to``).
    """

    detector: str
    kind: str
    severity: str
    pattern: str
    replaced: str = ""
    swap_from: str = ""
    swap_to: str = ""
    before: str = ""
    no_before: str = ""
    after: str = ""
    no_after: str = ""
    no_found: str = ""
    near: str = ""
    reach: int = 10
    casual_only: bool = False
    least: int = 0


def _g(name: str, severity: str, pattern: str, **more) -> Pattern:
    return Pattern(name, "grammar", severity, pattern, **more)


def _a(name: str, pattern: str, **more) -> Pattern:
    return Pattern(name, "ai_style", "warning", pattern, **more)


def _t(name: str, pattern: str, **more) -> Pattern:
    return Pattern(name, "translationese", "info", pattern, **more)


_NEAR = any_of(TECHNICAL)
_VERBS = any_of(NOMINALIZED)
_HEADS = any_of(ABSTRACT_HEADS)
_PAIRS = [("因為", "所以", 40, True), ("雖然", "但是", 40, True), (f"當[^{SKIPPED_AFTER_WHEN}。？！?!\\n]", "的時候", 29, False), ("如果", "那麼", 40, False)]

PATTERNS = [
    _g("redundant_question_particle", "warning", any_of(A_NOT_A) + S + "*嗎", replaced="$1", after=r"^[ \t]*([。？！?!\n]|$)"),
    _g("and_between_clauses", "info", "和", replaced="，", before="[了過著來去完好到]$", after="^" + any_of(PRONOUNS), no_after="一樣|一般|相同|類似|相似"),
    _g("bare_copula_adjective", "info", any_of(PRONOUNS) + "是" + any_of(ADJECTIVES), replaced="$1很$2", after=rf"^([的了啊呀呢吧嗎又且並但而]|[^{X.IDEOGRAPH}]|$)"),
    _g("redundant_preposition", "info", r"(強調)([^\n]{0,2}?)在", replaced="$1$2"),
    _g("redundant_preposition", "info", r"(討論|研究|分析)([^\n]{0,2}?)關於", replaced="$1$2"),
    _g("redundant_preposition", "info", r"(影響|考慮|處理)([^\n]{0,2}?)到", replaced="$1$2"),
    _g("nominalized_verb", "info", r"(進行|加以)([^\n]{0,2}?)" + _VERBS, replaced="$3"),
    _g("nominalized_verb", "info", r"(予以)([^\n]{0,2}?)" + _VERBS, replaced="$3", casual_only=True),
    _g("verbose_action", "info", r"(做出|作出)([^\n]{0,1}?)" + any_of(OBJECTS), replaced="$3"),
    _g("fronted_object", "info", r"對([^於，,。；;：:？！?!\n]" + CLAUSE + r"{0,5}?)進行([^\n]{0,2}?)" + _VERBS, replaced="$3$1", no_before="[針面絕相反比核校應配]$"),
    _g("double_attribution", "info", r"根據([^\[\]，,。；;：:？！?!\n]+?)(顯示|指出|表明|表示)", replaced="根據$1", no_after=rf"^[器屏卡幕式法]([^{X.IDEOGRAPH}]|$|[的上中與和是會有可能等這那就也都])"),
    _g("double_attribution", "info", r"根據([^\[\]，,。；;：:？！?!\n顯指表]+?)(說明)", replaced="根據$1", no_after=rf"^[書文]([^{X.IDEOGRAPH}]|$|[的上中與和是會有可能等這那就也都])"),
    _a("inflated_copula", "(作為)", replaced="是", no_before="[所大]$", near=_NEAR),
    _a("inflated_copula", "(標誌著|充當)", replaced="是", near=_NEAR),
    _a("inflated_copula", "(擁有)", replaced="有", no_after="^[權者感量]", near=_NEAR),
    _a("inflated_copula", "(設有)", replaced="有", near=_NEAR),
    _a("passive_adverb", "被(廣泛使用|廣泛採用|廣泛應用)", replaced="$1"),
    _a("didactic_closing", "的(故事|案例|經驗|教訓|歷史)" + S + "{0,7}?(告訴|提醒|啟示)(我們|後人|世人)"),
    _a("vague_exaggeration", "(領先|超前|超越)" + S + r"{0,17}?(時代|業界|同期)[^0-9年。？！?!\n]{0,5}[0-9]{1,2}年"),
    _a("negative_parallel", "(不只是|不僅是|不僅僅是)" + S + "{0,28}?(而是|更是)"),
    _a("formulaic_despite", "儘管" + S + "{0,40}?挑戰" + S + "*?(仍然|持續|蓬勃發展|繼續)" + S + "*[。？！?!]?"),
    _a("false_range", "從" + S + "*?到" + S + "*?再到", least=10),
    _t("copula_classifier", "是一[個名位]", after="^" + S + "*的", reach=400),
    _t("adverb_particle", any_of(PARTICLE_MIXUPS), swap_from="的", swap_to="地"),
    _t("redundant_particle", any_of(REDUNDANT_PARTICLES), swap_from="地", swap_to=""),
    _t("superlative_one_of", r"(最|極為)[^之。？！?!\n]{1,18}之一", no_found=any_of(PERSONS) + "之一$"),
    *[_t("connective_pair", f"{a}{S}{{0,{n}}}?{b}", casual_only=True) for a, b, n, _ in _PAIRS],
    *[_t("connective_in_sentence", f"{a}({S}{{0,{n}}}?{b})" if first else f"({a}{S}{{0,{n}}}?){b}", replaced="$1", casual_only=True) for a, b, n, first in _PAIRS],
    _t("nominal_heads", r"(的實施|的改善|的提升|的下降)[^，,。；\n和與及並且或]*?(的提升|的改善|的下降)"),
    _t("nominal_heads", r"(的分析|的講解|的理解|的認識)[^，,。；\n和與及並且或]*?(的發現|的理解|的認識)"),
    _t("head_chain", _HEADS + "(的" + _HEADS + "){2,}"),
    _t("false_friend_gloss", any_of(FALSE_FRIENDS), after=r"^[ \t]{0,2}[（(][^）)]*[A-Za-z]", reach=40),
]

#: Openings and closings of formal letters, those that have to end a phrase, and contract words in the first 100 characters.
FORMAL = ["敬啟者", "謹啟", "謹此", "茲就", "鈞鑒", "台端", "惠請", "特此函達", "相應函復"]
FORMAL_ENDING = ["此致"]
CONTRACTS = ["本合約", "本契約"]


def formal(text: Column, anchors: list[str] | None = None, ending: list[str] | None = None) -> Column:
    """Whether a text is in the formal register: an anchor that begins a phrase, or a contract word near its head."""
    left = rf"(^|[^A-Za-z0-9{X.IDEOGRAPH}])"
    anywhere = f"{left}({'|'.join(anchors or FORMAL)}|({'|'.join(ending or FORMAL_ENDING)})([^{X.IDEOGRAPH}]|$))"
    return F.coalesce(text.rlike(anywhere) | F.substring(text, 1, 100).rlike(f"{left}{any_of(CONTRACTS)}"), F.lit(False))


class Compiled:
    """A pattern and its guards, ready for texts."""

    def __init__(self, p: Pattern):
        self.p, self.pattern = p, K.compiled(p.pattern)
        self.guards = [(K.compiled(x), side, wanted) for x, side, wanted in ((p.before, -1, True), (p.no_before, -1, False), (p.after, 1, True), (p.no_after, 1, False), (p.no_found, 0, False)) if x]
        self.near = K.compiled(p.near) if p.near else None
        self.template = p.replaced.replace("$", "\\")

    def findings(self, text: str, mask: list[L.Span]) -> Iterator[tuple]:
        p = self.p
        for m in self.pattern.finditer(text):
            start, end = m.span()
            if end - start < p.least or L.overlaps(mask, start, end):
                continue
            sides = {-1: text[max(0, start - p.reach) : start], 0: m[0], 1: text[end : end + p.reach]}
            if any((guard.search(sides[side]) is not None) != wanted for guard, side, wanted in self.guards):
                continue
            if self.near and not self.near.search(text, max(0, start - 26), end + 26):
                continue
            new = m.expand(self.template) if p.replaced else m[0].replace(p.swap_from, p.swap_to) if p.swap_from else None
            yield p.detector, p.kind, p.severity, start, m[0], new


FINDING = "detector string, rule_type string, severity string, pos int, found string, suggestion string"


def findings(docs: DataFrame, patterns: list[Pattern] | None = None, mask: str | None = None) -> DataFrame:
    """``doc_id`` and the columns of FINDING of all patterns, in one pass and within the row.

    ``mask`` names a column of spans that no finding may touch.  Formal texts are spared the casual patterns.
    """
    compiled = [Compiled(p) for p in (PATTERNS if patterns is None else patterns)]

    def of(text: str, spans: list[dict] | None = None) -> list[tuple]:
        held, formal_text = L.pairs(spans), None
        out = []
        for c in compiled:
            found = list(c.findings(text, held))
            if found and c.p.casual_only:
                formal_text = is_formal(blanked(text, held)) if formal_text is None else formal_text
                found = [] if formal_text else found
            out += found
        return out

    return K.found(docs, of, FINDING, inputs=("text", mask) if mask else ("text",), where=f"[{X.IDEOGRAPH}]")


def blanked(text: str, mask: list[L.Span]) -> str:
    """The text with masked stretches as spaces."""
    out, at = [], 0
    for a, b in mask:
        out += [text[at:a], " " * (b - a)]
        at = b
    return "".join([*out, text[at:]])


_FORMAL_LEFT = rf"(?:^|[^A-Za-z0-9{X.IDEOGRAPH}])"


def is_formal(text: str) -> bool:
    """``formal`` of one text, in a kernel."""
    anywhere = K.compiled(f"{_FORMAL_LEFT}(?:{'|'.join(FORMAL)}|(?:{'|'.join(FORMAL_ENDING)})(?:[^{X.IDEOGRAPH}]|$))")
    return anywhere.search(text) is not None or K.compiled(f"{_FORMAL_LEFT}{any_of(CONTRACTS)}").search(text[:100]) is not None


def false_friends(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, found``: translated adverbs that share a clause with another of their kind."""
    terms, breaks = K.compiled(any_of(FALSE_FRIENDS)), K.compiled(r"[，,。；\n]")

    def of(text: str) -> list[tuple[int, str]]:
        hits, cuts = [m for m in terms.finditer(text)], [m.start() for m in breaks.finditer(text)]
        clause = [bisect_left(cuts, m.start()) for m in hits]
        return [(m.start(), m[0]) for m, c in zip(hits, clause) if clause.count(c) >= 2]

    return K.found(docs, of, "pos int, found string", where=any_of(FALSE_FRIENDS))


def pattern_rows() -> list[tuple]:
    """The patterns as rows, for other engines."""
    return [tuple(getattr(p, f.name) for f in fields(Pattern)) for p in PATTERNS]
