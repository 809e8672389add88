"""Detectors of stock rhetoric that need a text's sentences, paragraphs or sections, invisible characters, and mentions.

Each detector is a function of a text and its mask that gives findings; ``findings`` runs any of them over documents.
A finding has a family, the name of its device: gates and scores count families, so none goes without.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame

from glyphmill.functions import kernels as K
from glyphmill.functions import text as X
from glyphmill.operators import lexical as L
from glyphmill.operators import segment as G

#: Thresholds and word lists.
LEAST_CHARS, PER_1000, LEAST_PAIRS = 500, 5.0, 3
CONTRASTS = [(["雖然", "儘管", "即便", "即使"], ["但", "卻", "然而", "不過"]), (["不僅", "不只", "不單"], ["更", "還", "也", "亦"])]
CLOSINGS = ["展望未來", "拭目以待", "值得期待", "我們有理由相信", "具有重要意義", "具有重要戰略意義", "攜手共進", "值得深思", "任重道遠", "值得持續觀察", "值得持續關注", "機會與風險並存", "未來可期", "前景可期", "添磚加瓦", "開啟新篇章", "讓我們共同期待", "讓我們一起見證", "讓我們並肩前行", "感謝您的閱讀", "希望這篇文章對您有所幫助", "希望這些資訊對你有幫助", "如有不足之處", "歡迎在留言區", "歡迎在評論區"]
STAMPS = [("奠定", "理論基礎"), ("提供", "重要框架"), ("發揮", "關鍵作用"), ("印證", "重要性")]
ROADS, ABSTRACT, GROWTH = ["這條線", "這條路"], ["一條線", "路線", "軸線", "脈絡", "橋"], ["走出來", "長出來", "鋪出來", "延伸", "串起來", "拓寬"]
LEAD_INS = ["那麼", "那", "但是", "但", "然而", "可是", "而", "所以", "究竟", "到底", "其實", "主要", "真正", "說穿了", "說白了"]
QUESTION_LABELS = ["faq", "常見問題", "q：", "q:", "問：", "問:"]
HEDGES = ["在某種程度上", "從某個角度來看", "可以說是", "相對而言"]
ATTRIBUTIONS = ["研究顯示", "研究表明", "專家認為", "專家指出", "有研究指出", "數據顯示", "業內人士認為"]
PREPOSITIONS = ["根據", "依據", "按照", "援引", "引述"]
ORGANISATIONS = ["署", "院", "部", "處", "局", "會", "所", "中心", "大學", "公司", "團隊", "實驗室"]
GENRES = {"casual": "an unnamed authority: say who it is, or say it without one", "technical": "an authority without a citation: give the source that there is"}
DOMAINS = {
    "general": {"passive": 3.0, "weak_verb": 2.0, "pronoun": 8.0, "chain": 4, "issues": 5.0, "one_of": 2.0, "heads": 3, "span": 15, "particles": 2},
    "technical": {"passive": 6.0, "weak_verb": 4.0, "pronoun": 6.0, "chain": 5, "issues": 7.0, "one_of": 3.0, "heads": 4, "span": 18, "particles": 2},
    "literary": {"passive": 1.5, "weak_verb": 1.0, "pronoun": 10.0, "chain": 3, "issues": 3.0, "one_of": 1.0, "heads": 3, "span": 12, "particles": 2},
    "news": {"passive": 2.5, "weak_verb": 2.0, "pronoun": 7.0, "chain": 4, "issues": 4.0, "one_of": 2.5, "heads": 3, "span": 15, "particles": 2},
}
PREDICATE_VERBS = ["看到", "看見", "遇到", "聽到", "找到", "收到", "發現", "認識", "帶著", "帶到", "帶來", "告訴", "看著", "碰到", "經過"]
PREDICATE_MARKS = ["也", "就", "才", "卻", "便", "可以", "應該", "必須", "已經", "正在"]
MARK_WORDS = ["成就", "造就", "遷就", "將就", "俯就", "屈就", "就業", "就讀", "就職", "就緒", "就醫", "就學", "就寢", "就任", "就座", "就位", "就診", "人才", "天才", "剛才", "奴才", "庸才", "英才", "秀才", "方才", "幹才", "口才", "求才", "成才", "怪才", "奇才", "專才", "才華", "才幹", "才智", "才氣", "才藝", "方便", "順便", "簡便", "隨便", "即便", "輕便", "大便", "小便", "糞便", "不便", "以便", "便利", "便當", "便宜", "便條", "便捷", "便民", "便箋", "忘卻", "退卻", "冷卻", "推卻", "了卻", "拋卻", "卻步", "也許"]

FINDING = "family string, pos int, found string, severity string, note string"
Finding = tuple[str, int, str, str, str]
_STOPS = re.compile("[。！？；;!?]")


def _places(text: str, phrase: str, mask: list[L.Span], base: int = 0) -> list[int]:
    n = len(phrase)
    return [base + m.start() for m in re.finditer(re.escape(phrase), text) if not L.overlaps(mask, base + m.start(), base + m.start() + n)]


def _found(text: str, start: int, words: list[str], stop: int) -> L.Span | None:
    """The first of ``words``, in their order, that occurs between two places."""
    for w in words:
        at = text.find(w, start, stop)
        if at >= 0:
            return at, at + len(w)
    return None


def binary_contrast(text: str, mask: list[L.Span], multiplier: float = 1.0) -> Iterator[Finding]:
    """Concessive and progressive pairs within a sentence, beyond 5 in 1000 characters and 3 in all, in texts of 500."""
    n = len(text)
    if n < LEAST_CHARS:
        return
    first, count = None, 0
    for a, b in G.paragraph_spans(text):
        for begin, end in _split(text, a, b, _STOPS):
            for starts, turns in CONTRASTS:
                head = _found(text, begin, starts, end)
                turn = head and _found(text, head[1], turns, end)
                if turn and not L.overlaps(mask, *head) and not L.overlaps(mask, *turn):
                    count += 1
                    first = head[0] if first is None else first
    if count >= LEAST_PAIRS and 1000 * count / n > PER_1000 * multiplier:
        yield "binary_contrast", first, "", "info", str(count)


def _split(text: str, a: int, b: int, at: re.Pattern) -> Iterator[L.Span]:
    for m in at.finditer(text, a, b):
        yield a, m.start()
        a = m.end()
    yield a, b


_HEADING = re.compile(r" {0,3}#{1,6}(?=[ \t]|$)")
_TAIL = re.compile(r"(?:\s|（註）|[。！？!?…、，)）】」』])*")


def section_endings(text: str, mask: list[L.Span]) -> Iterator[Finding]:
    """Closing formulas in the last sentence before a heading or the end; stamps of significance and 隨著…不斷發展 anywhere."""
    if any(p in text for p in CLOSINGS):
        spans = [s for s in G.sentence_spans(text, mask) if not ("\n" not in text[s[0] : s[1]] and _HEADING.match(text[s[0] : s[1]]))]
        for a, b in spans:
            line_end = text.find("\n", b)
            line_end = len(text) if line_end < 0 else line_end
            if not _TAIL.fullmatch(text, b, line_end):
                continue
            following = text[line_end:].lstrip("\r\n \t") if line_end < len(text) else ""
            if following and not _HEADING.match(text, _line_start(text, len(text) - len(following))):
                continue
            for phrase in CLOSINGS:
                at = [p for p in _places(text[a:b], phrase, mask, a) if not _HEADING.match(text, _line_start(text, p))]
                if at:
                    yield "formulaic_closing", at[0], phrase, "info", ""
    if any(x in text for x, _ in STAMPS) or "隨著" in text:
        for a, b in G.sentence_spans(text, mask):
            for x, y in STAMPS:
                p = text.find(x, a, b)
                q = text.find(y, p + len(x), b) if p >= 0 else -1
                if q >= 0 and not L.overlaps(mask, p, q + len(y)):
                    yield "significance_stamp", p, text[p : q + len(y)], "info", ""
            p, q = text.find("隨著", a, b), text.find("不斷發展", a, b)
            if 0 <= p and p + 2 <= q <= p + 42 and not L.overlaps(mask, p, q + 4):
                yield "era_opener", p, text[p : q + 4], "info", ""


def _line_start(text: str, pos: int) -> int:
    return max(text.rfind("\n", 0, pos), text.rfind("\r", 0, pos)) + 1


_BOLD = re.compile(r"\*\*(?=\S)[^*\n]+?\*\*")


def excessive_bold(text: str, mask: list[L.Span]) -> Iterator[Finding]:
    """Two to four bold runs in a sentence; three and more, at least 3 in 200 characters, in a paragraph of 30."""
    if "**" not in text:
        return
    count = lambda a, b: sum(not L.overlaps(mask, m.start(), m.end()) for m in _BOLD.finditer(text, a, b))
    for a, b in G.sentence_spans(text, mask):
        if 2 <= count(a, b) <= 4:
            yield "bold_in_sentence", a, text[a : a + 2], "info", str(count(a, b))
    for a, b in G.paragraph_spans(text):
        n = count(a, b)
        if b - a >= 30 and n >= 3 and n >= math.ceil((b - a) / 200 * 3):
            yield "bold_in_paragraph", a, text[a : a + 2], "info", str(n)


def line_metaphor(text: str, mask: list[L.Span]) -> Iterator[Finding]:
    """An abstract line that a paragraph refers back to twice and lets grow."""
    for a, b in G.paragraph_spans(text):
        part = text[a:b]
        if sum(len(_places(part, r, mask, a)) for r in ROADS) < 2 or not any(_places(part, g, mask, a) for g in GROWTH):
            continue
        terms = sorted((p[0], t) for t in ABSTRACT if (p := _places(part, t, mask, a)))
        if terms:
            yield "line_metaphor", terms[0][0], terms[0][1], "info", ""


def is_slogan(sentence: str) -> bool:
    s = sentence.rstrip("。！？!?").strip()
    if not 8 <= len(s) <= 80:
        return False
    if ("不是" in s and "而是" in s) or ("不只" in s and ("更是" in s or "也是" in s)) or s.count("越") >= 2:
        return True
    halves = next((s.split(c, 1) for c in "；，," if c in s), None)
    return halves is not None and min(map(len, halves)) >= 3 and abs(len(halves[0]) - len(halves[1])) <= 8


def repeated_slogans(text: str, mask: list[L.Span]) -> Iterator[Finding]:
    """Balanced sentences that come again, word for word, in another paragraph: once each, at their first place."""
    seen: dict[str, tuple[int, int]] = {}
    told = set()
    for k, (a, b) in enumerate(G.paragraph_spans(text)):
        for x, y in G.sentence_spans(text[a:b]):
            s = text[a + x : a + y]
            if L.overlaps(mask, a + x, a + y) or not is_slogan(s):
                continue
            at, paragraph = seen.setdefault(s, (a + x, k))
            if paragraph != k and s not in told:
                told.add(s)
                yield "repeated_slogan", at, text[at : at + 8], "info", ""


def _without_lead(sentence: str) -> str:
    rest = sentence.strip()
    while lead := next((w for w in LEAD_INS if rest.startswith(w)), None):
        rest = rest[len(lead) :].lstrip("，,、 ")
    return rest


def self_questions(text: str, mask: list[L.Span]) -> Iterator[Finding]:
    """Two or more questions that a paragraph answers itself, one of them staged (你以為…嗎？錯了); not under an FAQ label."""
    if "嗎" not in text:
        return
    for a, b in G.paragraph_spans(text):
        spans = [(a + x, a + y) for x, y in G.sentence_spans(text[a:b])]
        pairs, staged = [], False
        for one, two in zip(spans, spans[1:]):
            if L.overlaps(mask, *one) or L.overlaps(mask, *two):
                continue
            question, answer = _without_lead(text[slice(*one)]), _without_lead(text[slice(*two)])
            reveal = question.startswith(("你以為", "大家都以為")) and "嗎" in question and answer.startswith(("錯了", "錯，"))
            plain = (question.startswith("為什麼") and answer.startswith(("因為", "是因為", "原因"))) or (question.startswith("問題出在哪") and answer.startswith("出在"))
            staged |= reveal
            if reveal or plain:
                pairs.append(one)
        if len(pairs) >= 2 and staged and not any(label in text[a:b].lower() for label in QUESTION_LABELS):
            yield "self_question", pairs[0][0], text[slice(*pairs[0])], "info", str(len(pairs))


def hedging_paragraphs(text: str, mask: list[L.Span]) -> list[L.Span]:
    """Paragraphs of 50 characters or more with three hedges and 3 in 200 characters: their hedges count as warnings."""
    out = []
    for a, b in G.paragraph_spans(text):
        n = sum(len(_places(text[a:b], h, mask, a)) for h in HEDGES)
        if b - a >= 50 and n >= 3 and n >= math.ceil((b - a) / 200 * 3):
            out.append((a, b))
    return out


def hedges(text: str, mask: list[L.Span]) -> Iterator[Finding]:
    """Hedging phrases: info, and warnings where a paragraph is full of them."""
    if not any(h in text for h in HEDGES):
        return
    dense = L.joined(hedging_paragraphs(text, mask))
    for pos, h in sorted((p, h) for h in HEDGES for p in _places(text, h, mask)):
        yield "hedge", pos, h, "warning" if L.overlaps(dense, pos, pos + 1) else "info", ""


_CITED = re.compile(r"https?://|www\.|\[\^[^\]]*\]|［\^[^］]*］|\[[0-9]+\]|［[0-9]+］|\[[^\]]*\]\(|［[^］]*］\(")
_SENTENCE_END = re.compile(r"[。！？!?]|\n(?=[ \t]*(?:\r?\n|$)|[ \t]{0,3}(?:#{1,6}[ \t]|>|```|~~~|[-*+][ \t]|[0-9]+[.)][ \t])|[ \t]*(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})(?:\n|$))")
_DEVICES = re.compile(r"[器屏卡幕式法書文](?:[^" + "一-鿿" + r"]|$|[的上中與和是會有可能等這那就也都])")


def uncited_attributions(text: str, mask: list[L.Span], phrases: list[str] | None = None, genre: str = "casual") -> Iterator[Finding]:
    """Appeals to unnamed authority, with no citation up to the sentence's end and no source named before: advice only."""
    phrases = ATTRIBUTIONS if phrases is None else phrases
    if not any(p in text for p in phrases):
        return
    ends = [m.start() for m in _SENTENCE_END.finditer(text)]
    cited = [m.start() for m in _CITED.finditer(text) if not any(a < m.start() < b for a, b in mask)]
    for m in re.finditer("|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True)), text):
        pos, end = m.start(), m.end()
        begin = max((e + 1 for e in ends if e < pos), default=0)
        stop = min((e for e in ends if e >= pos), default=len(text))
        before = text[max(begin, pos - L.AROUND) : pos]
        run = re.search("[一-鿿]*$", before)[0].rstrip("的")
        named = any(p in before for p in PREPOSITIONS) or run.endswith(tuple(ORGANISATIONS))
        device = m[0].endswith(("顯示", "說明")) and _DEVICES.match(text, end)
        if not (L.overlaps(mask, pos, end) or any(pos <= c < stop for c in cited) or named or device):
            yield "uncited_attribution", pos, m[0], "info", GENRES.get(genre, GENRES["technical"])


def _predicate_between(span: str, low: int, high: int) -> bool:
    """Whether an adverb or auxiliary that opens a predicate, and is no part of a listed word, lies between two places."""
    for m in re.finditer("|".join(PREDICATE_MARKS), span[low:high]):
        p = low + m.start()
        if span[p : p + 2] not in MARK_WORDS and (p == low or span[p - 1 : p + 1] not in MARK_WORDS):
            return True
    return False


def long_premodifiers(text: str, mask: list[L.Span], domain: str = "general", rhythm: bool = False) -> Iterator[Finding]:
    """Comma-free spans that pile modifiers before a noun: as long, and with as many 的, as the domain allows at most.

    With ``rhythm`` one 的 is enough, if the span has 15 ideographs without a pause; such findings are advice.
    """
    t = DOMAINS[domain]
    noun = K.compiled(f"[{X.IDEOGRAPH}]+")
    for begin, end in G.sentence_spans(text, mask):
        for a, b in _split(text, begin, end, re.compile("[，、。；：,;:]")):
            span = text[a:b]
            particles = [m.start() for m in re.finditer("的", span) if not L.overlaps(mask, a + m.start(), a + m.start() + 1)]
            if not particles or span[0] in "我你他她它咱您":
                continue
            best = None
            for p in particles:
                m = noun.match(span, p + 1)
                if not m or m.end() < t["span"]:
                    continue
                if any(v in span[:p] for v in PREDICATE_VERBS):
                    break
                inside = [q for q in particles if q < m.end()]
                if len(inside) < (1 if rhythm else t["particles"]):
                    continue
                if _predicate_between(span, inside[0] + 1, inside[-1]):
                    break
                if not L.overlaps(mask, a, a + m.end()) and (best is None or m.end() > best[0]):
                    best = (m.end(), len(inside))
            if best:
                relaxed = best[1] < t["particles"]
                longest = max((len(noun.findall(run) and "".join(noun.findall(run))) for run in re.split("[，、；：。！？,;:!?…—（）()「」『』《》]", span[: best[0]])), default=0)
                if not relaxed or longest >= 15:
                    yield "rhythm_premodifier" if relaxed else "long_premodifier", a, span[: best[0]], "info" if relaxed else "warning", str(best[1])


# ---- invisible characters

#: Ranges of characters that show nothing, and of those that use joiners.
INVISIBLE = r"\x{00AD}\x{034F}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FDD0}-\x{FDEF}\x{FEFF}\x{FFF9}-\x{FFFB}\x{E0020}-\x{E007F}\x{E0100}-\x{E01EF}"
EMOJI = r"\x{1F000}-\x{1F0FF}\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{00A9}\x{00AE}\x{2122}\x{2139}\x{24C2}"
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFE}"
FLAGS = ["gbeng", "gbsct", "gbwls"]
_LAST = r"\x{FFFE}\x{FFFF}" + "".join(rf"\x{{{p:X}FFFE}}\x{{{p:X}FFFF}}" for p in range(1, 17))
_INVISIBLE = K.compiled(f"[{INVISIBLE}{_LAST}]")
_EMOJI, _ARABIC, _IDEOGRAPH = K.compiled(f"[{EMOJI}]"), K.compiled(f"[{ARABIC}]"), K.compiled(f"[{X.IDEOGRAPH}]")
_FLAG = re.compile("\U0001f3f4(" + "|".join("".join(chr(0xE0000 + ord(c)) for c in f) for f in FLAGS) + ")\U000e007f")


def is_invisible(c: str) -> bool:
    return _INVISIBLE.match(c) is not None


def _indic(before: str, after: str) -> bool:
    """A dead consonant and a letter of the same script."""
    block = lambda c: (ord(c) - 0x900) // 0x80 if c and 0x900 <= ord(c) <= 0xDFF else None
    return block(before) is not None and block(before) == block(after) and unicodedata.combining(before) == 9 and after.isalpha()


def suspicious(text: str, i: int, flags: list[L.Span]) -> bool:
    """Whether an invisible character has no place in its surroundings."""
    c, before, after = text[i], text[i - 1 : i], text[i + 1 : i + 2]
    if c == "​":
        return True
    if c in "‎‏":
        return False
    if c == "﻿":
        return i > 0
    if c == "‌":
        arabic = before and after and _ARABIC.match(before) and _ARABIC.match(after) and before.isalpha() and after.isalpha()
        return not (arabic or (before and after and _indic(before, after)))
    if c == "‍":
        base = text[i - 2 : i - 1] if before in ("︎", "️") else before
        emoji = base and after and _EMOJI.match(base) and _EMOJI.match(after) and not "\U0001f3fb" <= after <= "\U0001f3ff"
        return not (emoji or (before and after and _indic(before, after)))
    if "\U000e0020" <= c <= "\U000e007f":
        return not L.overlaps(flags, i, i + 1)
    if "\U000e0100" <= c <= "\U000e01ef":
        return not (before and _IDEOGRAPH.match(before))
    return True


def invisible(text: str, mask: list[L.Span]) -> Iterator[Finding]:
    """Characters that show nothing and are no part of an emoji, a flag or a spelling; to be deleted."""
    if not _INVISIBLE.search(text):
        return
    flags = [m.span() for m in _FLAG.finditer(text)]
    for m in _INVISIBLE.finditer(text):
        if suspicious(text, m.start(), flags) and not L.overlaps(mask, m.start(), m.end()):
            yield "invisible_character", m.start(), m[0], "warning", f"U+{ord(m[0]):04X}"


# ---- mentions

_SPECIMEN = re.compile(r"\s*(?:(?:>|[-*+][ \t]|[0-9]+[.)][ \t])\s*)*(?:\[[ xX]\]|[❌✅✓✗])")


def mentioned(text: str, spans: list[L.Span]) -> list[bool]:
    """For each span whether it is named and not used: on a line that shows a specimen, or inside quotation marks that close on its line."""
    out = []
    lines: dict[int, tuple] = {}
    for a, b in spans:
        begin = text.rfind("\n", 0, a) + 1
        if begin not in lines:
            end = text.find("\n", begin)
            line = text[begin : len(text) if end < 0 else end]
            depth, straight, at = 0, False, []
            for c in line:
                at.append((depth, straight))
                depth += (c in "「『") - (c in "」』")
                straight ^= c == '"'
            lines[begin] = (_SPECIMEN.match(line) is not None, at, max(line.rfind("」"), line.rfind("』")), line.rfind('"'))
        specimen, at, closer, straight_closer = lines[begin]
        depth, straight = at[a - begin] if a - begin < len(at) else (0, False)
        out.append(specimen or (closer >= b - begin if depth > 0 else straight and straight_closer >= b - begin))
    return out


DETECTORS = [binary_contrast, section_endings, excessive_bold, line_metaphor, repeated_slogans, self_questions, hedges, uncited_attributions, invisible]
#: Families that describe markup and not prose, and those that say nothing about who wrote a text.
FORMATTING = ["bold_in_sentence", "bold_in_paragraph", "list_density", "formulaic_headings", "mechanical_bullets"]
NO_EVIDENCE = ["mixed_address", "stacked_politeness"]
#: Findings that name a phrase of the text, and so may only mention it.
LEXICAL_FAMILIES = ["hedge", "uncited_attribution"]


def found_in(text: str, mask: list[L.Span], detectors=None) -> list[Finding]:
    """Findings of all detectors by position, without those that are only mentioned."""
    every = sorted((f for d in (DETECTORS if detectors is None else detectors) for f in d(text, mask)), key=lambda f: (f[1], f[0]))
    if any(not f[0] for f in every):
        raise ValueError("a finding without a family")
    spans = [(f[1], f[1] + len(f[2])) for f in every]
    return [f for f, quoted in zip(every, mentioned(text, spans)) if not (quoted and f[0] in LEXICAL_FAMILIES)]


def findings(docs: DataFrame, detectors=None, mask: str | None = None) -> DataFrame:
    """``doc_id, family, pos, found, severity, note``; ``mask`` names a column of spans."""
    if mask:
        return K.found(docs, lambda text, spans: found_in(text, L.pairs(spans), detectors), FINDING, inputs=("text", mask))
    return K.found(docs, lambda text: found_in(text, [], detectors), FINDING)
