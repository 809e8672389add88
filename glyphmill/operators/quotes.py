"""Half-width marks, brackets and quotation marks in Chinese prose: which of them the Chinese around them owns.

Each detector reads a text once.  A masked mark is passed over.  Null and empty texts have no findings.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame

from glyphmill.functions import kernels as K
from glyphmill.functions import text as X
from glyphmill.operators import lexical as L

#: Characters that count as Chinese beside a mark; full-width forms; how far a partner or the start of an
#: English run is looked for; words that make a run a clause; characters that may lie between a mark and its neighbour.
BESIDE = rf"{X.IDEOGRAPH}\x{{3001}}-\x{{303F}}\x{{FF01}}-\x{{FF65}}\x{{FE30}}-\x{{FE4F}}"
FULL = {",": "，", ".": "。", "!": "！", "?": "？", ";": "；", ":": "：", "(": "（", ")": "）"}
REACH, CLAUSE_WORDS, GAP = 512, 2, 3
_BESIDE = K.compiled(f"[{BESIDE}]")
#: What an English run can't hold: marks, line ends, anything beyond ASCII, and full stops but those inside a word.
_CLOSES = re.compile(r"[,;:!?\x00-\x08\x0a-\x1f\x7f-\U0010ffff]|(?<![A-Za-z0-9])\.|\.(?![A-Za-z0-9])")

MARK = "pos int, found string, suggestion string"


def chinese(text: str, pos: int, step: int, blanks: int | None = None) -> bool:
    """Whether the nearest character before (-1) or from (1) a place is Chinese, white space apart (at most ``blanks``)."""
    i = pos - 1 if step < 0 else pos
    while 0 <= i < len(text) and text[i].isspace():
        if blanks is not None:
            blanks -= 1
            if blanks < 0:
                return False
        i += step
    return 0 <= i < len(text) and _BESIDE.match(text[i]) is not None


def in_clause(text: str, pos: int, mask: list[L.Span]) -> bool:
    """Whether the English before a mark is a clause of its own: two words or more, one of which begins in lower case."""
    floor = max(0, pos - REACH)
    k = bisect_left(mask, (pos, pos))
    if k:
        floor = max(floor, min(mask[k - 1][1], pos))
    # Dots are judged with their neighbours, so the search sees one character more on the left.
    stops = [m.end() for m in _CLOSES.finditer(text, floor, pos)]
    words = [w for w in (re.search("[A-Za-z]", t) for t in text[max([floor, *stops]) : pos].split()) if w]
    return len(words) >= CLAUSE_WORDS and any(w[0].islower() for w in words)


def owned(text: str, pos: int, mask: list[L.Span]) -> bool:
    return (chinese(text, pos, -1) or chinese(text, pos + 1, 1)) and not in_clause(text, pos, mask)


def _digits(text: str, pos: int) -> bool:
    is_digit = lambda i: 0 <= i < len(text) and text[i] in "0123456789"
    return is_digit(pos - 1) and is_digit(pos + 1)


def half_width(text: str, mask: list[L.Span] | None = None) -> Iterator[tuple[int, str, str]]:
    """Commas, exclamation and question marks and semicolons that should be full-width."""
    mask = mask or []
    for m in re.finditer("[,!?;]", text):
        pos, mark = m.start(), m[0]
        if L.overlaps(mask, pos, pos + 1) or (mark == "," and _digits(text, pos)) or text.startswith("![", pos) or not owned(text, pos, mask):
            continue
        yield pos, mark, FULL[mark]


def colons(text: str, mask: list[L.Span] | None = None) -> Iterator[tuple[int, str, str]]:
    """Colons, but for times, ``[id]:`` and definition markers at the start of a line."""
    mask = mask or []
    for m in re.finditer(":", text):
        pos = m.start()
        opens_line = text.startswith(": ", pos) and text[max(text.rfind("\n", 0, pos), text.rfind("\r", 0, pos)) + 1 : pos].strip(" \t") == ""
        if not (L.overlaps(mask, pos, pos + 1) or _digits(text, pos) or text.startswith("]", pos - 1 if pos else len(text)) or opens_line) and owned(text, pos, mask):
            yield pos, ":", "："


def stops(text: str, mask: list[L.Span] | None = None) -> Iterator[tuple[int, str, str]]:
    """Single full stops behind Chinese, white space apart, and not before a letter or digit."""
    for m in re.finditer(r"(?<!\.)\.(?![.A-Za-z0-9])", text):
        if not L.overlaps(mask or [], m.start(), m.end()) and chinese(text, m.start(), -1):
            yield m.start(), ".", "。"


def enumerations(text: str, mask: list[L.Span] | None = None) -> Iterator[tuple[int, str, str]]:
    """Every full-width comma of a run that has two or more segments of one to four characters between its commas."""
    commas = [m.start() for m in re.finditer("，", text) if not L.overlaps(mask or [], m.start(), m.end())]
    short = [1 <= len(text[a + 1 : b].strip()) <= 4 for a, b in zip(commas, commas[1:])]
    for m in re.finditer("1{2,}", "".join("01"[x] for x in short)):
        for pos in commas[m.start() : m.end() + 1]:
            yield pos, "，", "、"


def ranges(text: str, mask: list[L.Span] | None = None, en_dash: bool = False) -> Iterator[tuple[int, str, str]]:
    """Signs that stand for *to*: ~ between digits or Chinese, one side at least Chinese, but not before a number alone;
    a hyphen between Chinese, but no bullet and none of several."""
    for m in re.finditer(r"~|(?<!-)-(?!-)", text):
        pos = m.start()
        if L.overlaps(mask or [], pos, pos + 1):
            continue
        left, right = chinese(text, pos, -1), chinese(text, pos + 1, 1)
        if m[0] == "~":
            digits = text[pos - 1 : pos].isdigit() and text[pos - 1].isascii() if pos else False, text[pos + 1 : pos + 2].isdigit() and text[pos + 1].isascii()
            fits = (left or digits[0]) and (right or digits[1]) and (left or right) and not (digits[1] and not digits[0])
        else:
            line = max(text.rfind("\n", 0, pos), text.rfind("\r", 0, pos)) + 1
            fits = left and right and text[line:pos].strip(" \t") != ""
        if fits:
            yield pos, m[0], "–" if en_dash else "～"


def ellipses(text: str, mask: list[L.Span] | None = None) -> Iterator[tuple[int, str, str]]:
    """Three or more full stops (ASCII ones beside Chinese, and not in formulas, comments or tables of contents), and a
    single … beside Chinese: …… is right."""
    for m in re.finditer(r"\.{3,}|。{3,}|…+", text):
        a, b = m.span()
        if L.overlaps(mask or [], a, b) or (m[0][0] == "…" and b - a != 1):
            continue
        if m[0][0] == ".":
            prefix = text[max(text.rfind("\n", 0, a), text.rfind("\r", 0, a)) + 1 : a]
            leader = b - a >= 5 and re.match(" *[0-9]", text[b:]) is not None
            if leader or prefix.rstrip().endswith("=") or prefix.lstrip().startswith(("//", "/*")):
                continue
        if m[0][0] == "。" or chinese(text, a, -1) or chinese(text, b, 1):
            yield a, m[0], "……"


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def brackets(text: str, mask: list[L.Span] | None = None) -> Iterator[tuple[int, str, str]]:
    """Pairs of brackets on one line, no farther apart than REACH bytes, both of whose halves stand between Chinese."""
    mask = mask or []
    fits = lambda i: chinese(text, i, -1, 0) and chinese(text, i + 1, 1, 0) and not L.overlaps(mask, i, i + 1)
    stack: list[int] = []
    out = []
    for m in re.finditer(r"[()\n]", text):
        if m[0] == "\n":
            stack = []
        elif m[0] == "(":
            stack.append(m.start())
        elif stack:
            a, b = stack.pop(), m.start()
            if fits(a) and fits(b) and _bytes(text[a:b]) < REACH:
                out += [(a, "(", "（"), (b, ")", "）")]
    return iter(sorted(out))


def _paragraphs(text: str) -> Iterator[L.Span]:
    at = 0
    for m in re.finditer(r"\r?\n[ \t]*\r?\n", text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def directed(openings: list[bool]) -> bool:
    """Whether marks carry a direction: both halves occur and none closes what wasn't opened."""
    depth = 0
    for opening in openings:
        depth += 1 if opening else -1
        if depth < 0:
            return False
    return len(set(openings)) == 2


def _pairs(openings: list[bool], mode: str) -> list[tuple[int, int]]:
    if mode == "turns":
        return [(i, i + 1) for i in range(0, len(openings) - 1, 2)]
    out, stack = [], []
    if mode == "stack":
        for i, opening in enumerate(openings):
            if opening:
                stack.append(i)
            elif stack:
                out.append((stack.pop(), i))
    return out


def _converted(text: str, begin: int, end: int, kind: str, mask: list[L.Span]) -> list[tuple[int, bool]]:
    """(position, opens) of the marks of one kind in a paragraph that become Chinese ones.

    Both halves of a pair do, or neither: the pair has to enclose Chinese, or a term without white space that stands
    beside Chinese, and Chinese prose, or at least no Latin one, has to stand outside it.  A mark without a partner does
    if Chinese is near and no mark of the paragraph was passed over.
    """
    places = [i for i in (m.start() for m in re.finditer(f"[{kind}]", text[begin:end]))]
    marks, passed = [], False
    for i in (begin + p for p in places):
        letter = kind == "‘’" and any(0 <= j < len(text) and text[j].isascii() and text[j].isalpha() for j in (i - 1, i + 1))
        if letter or L.overlaps(mask, i, i + 1):
            passed = True
        else:
            marks.append(i)
    if not marks:
        return []
    opens = [text[i] == kind[0] for i in marks]
    mode = "stack" if len(kind) == 2 and directed(opens) else "none" if kind == "‘’" else "turns"
    pairs = _pairs(opens, mode)
    # Gaps between marks, with what they hold outside the mask, counted from the left.
    edges = [begin, *marks, end]
    cjk, latin = [0], [0]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        part = _unmasked(text, a + (k > 0), b, mask)
        cjk.append(cjk[-1] + (_BESIDE.search(part) is not None))
        latin.append(latin[-1] + (re.search("[A-Za-z]", part) is not None))
    near = lambda i: chinese(text, i, -1, GAP) or chinese(text, i + 1, 1, GAP)
    good: dict[int, bool] = {}
    paired = set()
    for a, b in pairs:
        paired |= {a, b}
        outside = lambda counts: counts[a + 1] > 0 or counts[-1] > counts[b + 1]  # noqa: B023, E731
        term = not re.search(r"\s", text[marks[a] + 1 : marks[b]]) and (near(marks[a]) or near(marks[b]))
        if (outside(cjk) or not outside(latin)) and (cjk[b + 1] > cjk[a + 1] or term):
            good |= {a: True, b: False}
    for k, i in enumerate(marks):
        if k not in paired and not passed and near(i):
            good[k] = opens[k]
    return [(marks[k], good[k]) for k in sorted(good)]


def _unmasked(text: str, a: int, b: int, mask: list[L.Span]) -> str:
    parts, at = [], a
    for k in range(max(0, bisect_left(mask, (a, a)) - 1), len(mask)):
        x, y = mask[k]
        if x >= b:
            break
        if y > at:
            parts.append(text[at : max(at, x)])
            at = max(at, y)
    return "\n".join([*parts, text[at:b]]) if at < b else "\n".join(parts)


def quotes(text: str, mask: list[L.Span] | None = None) -> Iterator[tuple[int, str, str]]:
    """Quotation marks that become corner brackets, by depth: 「」 outside, 『』 inside, by turns, paragraph by paragraph.

    Curly double marks nest; curly single ones are always 『』, straight ones 「」.
    """
    mask, out = mask or [], []
    if not re.search("[“”‘’\"]", text):
        return iter(out)
    for begin, end in _paragraphs(text):
        double = _converted(text, begin, end, "“”", mask)
        if len(double) >= 2:
            by_sign = directed([text[i] == "“" for i, _ in double])
            even, depth = len(double) // 2 * 2, 0
            for k, (i, _) in enumerate(double):
                opening = text[i] == "“" if by_sign or k >= even else k % 2 == 0
                if not opening:
                    depth = max(0, depth - 1)
                out.append((i, text[i], ("「" if opening else "」") if depth % 2 == 0 else ("『" if opening else "』")))
                depth += opening
        else:
            out += [(i, text[i], "「" if opening else "」") for i, opening in double]
        out += [(i, text[i], "『" if opening else "』") for i, opening in _converted(text, begin, end, "‘’", mask)]
        out += [(i, '"', "「" if opening else "」") for i, opening in _converted(text, begin, end, '"', mask)]
    return iter(sorted(out))


def marks(docs: DataFrame, kernel, mask: str | None = None) -> DataFrame:
    """``doc_id, pos, found, suggestion`` of one of the functions above; ``mask`` names a column of spans."""
    if mask:
        return K.found(docs, lambda text, spans: kernel(text, L.pairs(spans)), MARK, inputs=("text", mask))
    return K.found(docs, kernel, MARK)
