"""The whole scan of a text in its row: mask, rules, marks, grammar, rhetoric, in the order of their phases.

Phases: *lexical* (rules and patterns of words), *syntactic* (marks, spaces, repetitions), *indexed* (what needs sentences,
paragraphs or sections).  Lexical findings that overlap are resolved first (longer, then graver, then earlier ones win); a
lexical finding goes where an indexed one of its family lies over it; phrases that are only mentioned go; headings raise
what lies in them by a degree, if asked; the report is ordered by position, severity and type.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from glyphmill.functions import kernels as K
from glyphmill.operators import characters as C
from glyphmill.operators import judgement as J
from glyphmill.operators import lexical as L
from glyphmill.operators import masks as M
from glyphmill.operators import patterns as P
from glyphmill.operators import quotes as Q
from glyphmill.operators import style as ST

ISSUE = "pos int, size int, byte_offset int, line int, col int, found string, suggestions array<string>, rule_type string, severity string, family string, phase string"
#: Marks with the family that a caller turns off.
MARKS: list[tuple[str, Callable]] = [("punctuation", Q.half_width), ("punctuation", Q.stops), ("punctuation", Q.brackets), ("colon", Q.colons), ("quotes", Q.quotes), ("ranges", Q.ranges), ("ellipsis", Q.ellipses), ("enumeration", Q.enumerations)]
ADVICE = ("ranges", "enumeration")
FAMILIES = ["spelling", *dict.fromkeys(f for f, _ in MARKS), "spacing", "repetition", "grammar", "ai_style", "translationese", "style"]

Row = tuple[int, int, str, list[str], str, str, str, str]  # pos, size, found, suggestions, type, severity, family, phase


def survivors(rows: list[Row]) -> list[Row]:
    """Disjoint ones: longer rows win, then graver, then earlier ones; empty rows go only strictly inside others."""
    taken: list[L.Span] = []
    out = []
    for r in sorted(rows, key=lambda r: (-r[1], J.SEVERITY.index(r[5]), r[0])):
        a, b = r[0], r[0] + r[1]
        k = bisect_left(taken, (a, a))
        if (k and a < taken[k - 1][1]) or (k < len(taken) and taken[k][0] < b and a < taken[k][1]):
            continue
        if a < b:
            taken.insert(k, (a, b))
        out.append(r)
    return out


def _lexical(text: str, mask: list[L.Span], scanner: L.Scanner, patterns: list[P.Compiled], off: set[str]) -> Iterable[Row]:
    if "spelling" not in off:
        yield from survivors([(i[0], i[1], i[5], i[6], i[7], i[8], i[7], "lexical") for i in scanner.scan(text, mask)])
    formal = None
    for p in patterns:
        if p.p.kind in off:
            continue
        for name, kind, severity, pos, found, new in p.findings(text, mask):
            if p.p.casual_only:
                formal = P.is_formal(P.blanked(text, mask)) if formal is None else formal
                if formal:
                    break
            yield pos, len(found), found, [] if new is None else [new], kind, severity, name, "lexical"


def _syntactic(text: str, mask: list[L.Span], off: set[str]) -> Iterable[Row]:
    for family, kernel in MARKS:
        if family not in off:
            for pos, found, new in kernel(text, mask):
                yield pos, len(found), found, [new], "punctuation", "info" if family in ADVICE else "warning", family, "syntactic"
    if "spacing" not in off:
        for m in C._GAP.finditer(text):
            if not any(a < m.start() < b for a, b in mask):
                yield m.start(), 0, "", [" "], "punctuation", "info", "spacing", "syntactic"
    if "repetition" not in off:
        for m in C._UNIT.finditer(text):
            unit = m[1] or m[2]
            if (len(unit) == 3 or unit[0] != unit[1]) and not L.overlaps(mask, m.start(), m.start() + 2 * len(unit)):
                yield m.start(), 2 * len(unit), unit * 2, [unit] if len(unit) == 3 else [], "repetition", "info", "repetition", "syntactic"


def _indexed(text: str, mask: list[L.Span], off: set[str]) -> Iterable[Row]:
    if "style" not in off:
        for family, pos, found, severity, _ in ST.found_in(text, mask):
            yield pos, len(found), found, [""] if family == "invisible_character" else [], "ai_style", severity, family, "indexed"
        for family, pos, found, severity, _ in ST.long_premodifiers(text, mask):
            yield pos, len(found), found, [], "translationese", severity, family, "indexed"


def whole(text: str, scanner: L.Scanner, patterns: list[P.Compiled], content_type: str = "plain", off: set[str] = frozenset(), raise_headings: bool = False, extra: list[L.Span] | None = None) -> list[tuple]:
    """All issues of one text as tuples of ISSUE."""
    mask = L.joined([*M.mask_of(text, content_type), *(extra or [])])
    rows = [*_lexical(text, mask, scanner, patterns, off), *_syntactic(text, mask, off), *_indexed(text, mask, off)]
    over: dict[str, list[L.Span]] = {}
    for r in rows:
        if r[7] == "indexed":
            over.setdefault(r[6], []).append((r[0], r[0] + r[1]))
    held = {f: L.joined(s) for f, s in over.items()}
    rows = [r for r in rows if not (r[7] == "lexical" and L.overlaps(held.get(r[6], []), r[0], r[0] + r[1]))]
    named = [r[4] in ("ai_style", "ai_filler") and r[7] == "lexical" and r[1] > 0 for r in rows]
    quoted = iter(ST.mentioned(text, [(r[0], r[0] + r[1]) for r, n in zip(rows, named) if n]))
    rows = [r for r, n in zip(rows, named) if not (n and next(quoted))]
    if raise_headings:
        heads = L.joined([(a, b) for *_, a, b in M.heading_rows(text) if a < b])
        rows = [(*r[:5], {"info": "warning"}.get(r[5], "error"), *r[6:]) if L.overlaps(heads, r[0], r[0] + 1) else r for r in rows]
    kinds = {t: i for i, t in enumerate(J.TYPES)}
    rows.sort(key=lambda r: (r[0], J.SEVERITY.index(r[5]), kinds.get(r[4], len(kinds)), r[2]))
    places = K.Places(text)
    out = []
    for pos, size, found, suggestions, kind, severity, family, phase in rows:
        line, col, byte = places.of(pos)
        out.append((pos, size, byte, line, col, found, suggestions, kind, severity, family, phase))
    return out


def scanned(docs: DataFrame, scanner: L.Scanner, content_type: str = "plain", off: Iterable[str] = (), raise_headings: bool = False, mask: str | None = None) -> DataFrame:
    """``doc_id`` and the columns of ISSUE of everything that is found; ``off`` names families that are left out, ``mask`` a
    column of further spans.  Null texts have no issues; nothing is shuffled."""
    unknown = set(off) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown families: {', '.join(sorted(unknown))}")
    M._typed(content_type)
    compiled, left_out = [P.Compiled(p) for p in P.PATTERNS], frozenset(off)
    if mask:
        return K.found(docs, lambda t, spans: whole(t, scanner, compiled, content_type, left_out, raise_headings, L.pairs(spans)), ISSUE, inputs=("text", mask))
    return K.found(docs, lambda t: whole(t, scanner, compiled, content_type, left_out, raise_headings), ISSUE)
