"""Fixes: what may be written, writing it, and carrying places over from the old text to the new one.

Everything about one document happens in its row: its issues are found, judged and written in one kernel, in one pass
from left to right.  Null texts stay null, with nothing applied; rows that share a doc_id are fixed one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import kernels as K
from glyphmill.operators import lexical as L
from glyphmill.operators.segment import Segmenter

#: Tiers, from the most careful; types that can be fixed without knowing words; clues that confirm a term.
TIERS = ["none", "orthographic", "lexical_safe", "lexical_contextual"]
ORTHOGRAPHIC = ["punctuation", "case", "variant", "grammar"]
CONFIRMING = {"confusable": 2}


#: An applied fix: its place and size in the old text, and what stands there now.
FIXES = "array<struct<pos:int,size:int,replacement:string>>"
_NAMES = [part.split()[0] for part in L.ISSUE.split(", ")]


def as_issue(row: tuple) -> dict:
    return dict(zip(_NAMES, row))


def verdict(issue: dict, text: str, tier: str, mask: list[L.Span], segmenter: Segmenter | None) -> tuple[str, str | None]:
    """("apply", replacement), ("skip", None) if the issue is out of the tier's scope, ("decline", None) if judged unfit."""
    level, suggestions, found = TIERS.index(tier), issue["suggestions"] or [], issue["found"] or ""
    from glyphmill.operators.style import is_invisible  # the style detectors build on this module's neighbours

    deletes_invisible = issue["rule_type"] == "ai_style" and suggestions == [""] and found and all(map(is_invisible, found))
    removable = deletes_invisible and all(c == "​" or (c == "﻿" and issue["pos"] > 0) for c in found)
    mechanical = issue["rule_type"] in ORTHOGRAPHIC or removable
    if deletes_invisible and not removable:
        return "decline", None
    if issue.get("advisory"):
        return "skip", None
    if not mechanical:
        clues = issue.get("clues") or []
        if level < 2:
            return "skip", None
        if issue.get("outcome") == "suppressed":
            return "decline", None
        if level < 3 and clues:
            return "skip", None
        if level < 3 and issue.get("confidence") == "low":
            return "decline", None
        if issue.get("anchor") is False and not clues:
            return "decline", None
        if clues:
            low, high = L.window(text, issue["pos"], issue["pos"] + issue["size"], mask)
            if segmenter is None or segmenter.clues(text[low:high], clues) < CONFIRMING.get(issue["rule_type"], 1):
                return "decline", None
    if len(suggestions) == 1:
        return "apply", suggestions[0]
    return ("decline" if suggestions else "skip"), None


def applied(text: str, issues: list[dict], tier: str, mask: list[L.Span], segmenter: Segmenter | None = None) -> tuple[str, list[dict], int]:
    """The new text, the fixes in it, and how many issues were declined.

    Issues that begin before the end of the last fix go, and so do grammar issues within a span that touched the mask;
    what would write into the mask goes, but an insertion at its edge is outside it.
    """
    out, fixes, at, barred, declined = [], [], 0, 0, 0
    if tier == "none":
        return text, [], 0
    for issue in sorted(issues, key=lambda i: i["pos"]):
        start, end = issue["pos"], issue["pos"] + issue["size"]
        if end > len(text) or start < at or (issue["rule_type"] == "grammar" and start < barred):
            continue
        if any(a < start < b for a, b in mask) if start == end else L.overlaps(mask, start, end):
            barred = max(barred, end)
            continue
        what, new = verdict(issue, text, tier, mask, segmenter)
        declined += what == "decline"
        if what == "apply":
            out += [text[at:start], new]
            at = end
            fixes.append({"pos": start, "size": end - start, "replacement": new})
    return "".join([*out, text[at:]]), fixes, declined


def moved(pos: int, fixes: list[dict]) -> int:
    """A place of the old text in the new one: shifted by all fixes that begin strictly before it."""
    return max(0, pos + sum(len(f["replacement"]) - f["size"] for f in fixes if f["pos"] < pos))


def moved_mask(mask: list[L.Span], fixes: list[dict]) -> list[L.Span]:
    """Masked spans in the new text; fixes never write into them, those that end at a span's start shift it."""
    out, k, shift = [], 0, 0
    for a, b in mask:
        while k < len(fixes) and fixes[k]["pos"] + fixes[k]["size"] <= a:
            shift += len(fixes[k]["replacement"]) - fixes[k]["size"]
            k += 1
        out.append((max(0, a + shift), max(0, b + shift)))
    return out


def written(fixes: list[dict]) -> list[L.Span]:
    """What the fixes have written, as spans of the new text (empty ones where they deleted)."""
    out, shift = [], 0
    for f in fixes:
        at = f["pos"] + shift
        out.append((at, at + len(f["replacement"])))
        shift += len(f["replacement"]) - f["size"]
    return out


def beyond(issues: list[dict], fixes: list[dict]) -> list[dict]:
    """Issues of the new text that touch nothing that a fix has written."""
    spans = written(fixes)
    touches = lambda i, a, b: (i["pos"] <= a < i["pos"] + i["size"]) if a == b else (i["pos"] < b and a < i["pos"] + i["size"])
    return [i for i in issues if not any(touches(i, a, b) for a, b in spans)]


def restored(issues: list[dict], before: list[dict], fixes: list[dict], states: tuple[str, ...] = ("severity", "outcome", "anchor")) -> list[dict]:
    """Issues of the new text with the state that decisions gave the same finding at the same place of the old one."""
    old = {(moved(i["pos"], fixes), i["found"]): i for i in before}
    return [{**i, **{s: o[s] for s in states if s in o}} if (o := old.get((i["pos"], i["found"]))) else i for i in issues]


RESULT = f"text string, n_applied int, n_skipped int, n_declined int, fixes {FIXES}"


def fixed(docs: DataFrame, scanner: L.Scanner, tier: str = "lexical_safe", mask: str | None = None, segmenter: Segmenter | None = None) -> DataFrame:
    """``doc_id, text, n_applied, n_skipped, n_declined, fixes``: every document with what the tier allows written.

    ``mask`` names a column of spans that stay as they are.
    """
    if tier not in TIERS:
        raise ValueError(f"tiers are {', '.join(TIERS)}")

    def of(text: str, spans: list[dict] | None = None) -> list[tuple]:
        held = L.pairs(spans)
        issues = [as_issue(r) for r in scanner.scan(text, held)]
        new, fixes, declined = applied(text, issues, tier, held, segmenter)
        return [(new, len(fixes), len(issues) - len(fixes), declined, fixes)]

    done = K.found(docs, of, RESULT, inputs=("text", mask) if mask else ("text",))
    none = docs.where(F.col("text").isNull()).select("doc_id", F.lit(None).cast("string").alias("text"), *[F.lit(0).alias(c) for c in ("n_applied", "n_skipped", "n_declined")], F.array().cast(FIXES).alias("fixes"))
    return done.union(none)


def verdicts(docs: DataFrame, scanner: L.Scanner, tier: str, segmenter: Segmenter | None = None) -> DataFrame:
    """``doc_id, pos, found, verdict``: apply, skip or decline for every issue, each by itself."""

    def of(text: str) -> list[tuple]:
        issues = [as_issue(r) for r in scanner.scan(text)]
        return [(i["pos"], i["found"], verdict(i, text, tier, [], segmenter)[0]) for i in issues]

    return K.found(docs, of, "pos int, found string, verdict string")


def rescanned(docs: DataFrame, scanner: L.Scanner, tier: str = "lexical_safe") -> DataFrame:
    """``doc_id, text, pos, found, severity, old_pos``: issues that are left in the fixed text, beside what was written.

    ``old_pos`` is the place of the same finding in the old text (null: it is new).
    """

    def of(text: str) -> list[tuple]:
        before = [as_issue(r) for r in scanner.scan(text)]
        new, fixes, _ = applied(text, before, tier, [])
        places = {(moved(i["pos"], fixes), i["found"]): i["pos"] for i in before}
        left = restored(beyond([as_issue(r) for r in scanner.scan(new)], fixes), before, fixes)
        return [(new, i["pos"], i["found"], i["severity"], places.get((i["pos"], i["found"]))) for i in left]

    return K.found(docs, of, "text string, pos int, found string, severity string, old_pos int")


def masks_after(docs: DataFrame, scanner: L.Scanner, mask: str, tier: str = "lexical_safe") -> DataFrame:
    """``doc_id, start, end, new_start, new_end``: masked spans of the old text and where they lie in the fixed one."""

    def of(text: str, spans: list[dict] | None) -> list[tuple]:
        held = L.pairs(spans)
        _, fixes, _ = applied(text, [as_issue(r) for r in scanner.scan(text, held)], tier, held)
        return [(a, b, *to) for (a, b), to in zip(held, moved_mask(held, fixes))]

    return K.found(docs, of, "start int, end int, new_start int, new_end int", inputs=("text", mask))
