"""Rules as a table, compiled into one matcher that reads each text once.

Rules are layered and prepared as DataFrames.  What is left of them (at most MOST_RULES, which is checked) is compiled on
the driver and travels with the tasks; each text meets it within its row, so nothing is shuffled and rows that share a
doc_id, or have none, stay apart.  Of overlapping matches the leftmost, then longest, counts; then a chain of conditions
on the match's surroundings decides.  Null and empty texts have no findings; time is linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import kernels as K
from glyphmill.functions import text as X

#: Rules that a scan takes.
MOST_RULES = 200_000
RULES = (
    "layer int, ord long, `from` string, `to` array<string>, type string, english string, severity string, disabled boolean, clues array<string>, negative_clues array<string>, tags array<string>, "
    "exceptions array<string>, positional array<string>, groups array<struct<clues:array<string>,to:array<string>>>, guard string, confidence string"
)
#: Characters around a match in which clues, and clues with a direction, are looked for; rule types of the
#: spelling family; terms that only the first stance reports; severities by rule type; the largest number of clues.
AROUND, DIRECTED = 40, 20
SPELLING = ["cross_strait", "confusable", "typo", "political_coloring"]
IDENTITY_TERMS = ["內地", "大陸同胞", "祖國"]
SEVERITIES = {"political_coloring": "error", "typo": "error", "cross_strait": "warning", "confusable": "warning", "variant": "warning", "ai_filler": "info", "translationese": "info"}
MOST_CLUES = 32
_IDEOGRAPHS = K.compiled(f"[{X.IDEOGRAPH}]")
_BREAK = re.compile("\n\r?\n")

Span = tuple[int, int]


@dataclass(frozen=True)
class Profile:
    """Families of rules that a scan reports.  ``stance``: roc_centric (all political terms), international, neutral (none)."""

    spelling: bool = True
    variant: bool = True
    ai_filler: bool = True
    translationese: bool = True
    stance: str = "roc_centric"

    def takes(self, kind: str, term: str) -> bool:
        if kind == "political_coloring" and (self.stance == "neutral" or (self.stance == "international" and term in IDENTITY_TERMS)):
            return False
        return self.spelling if kind in SPELLING else getattr(self, kind, True)


EVERYTHING = Profile()
BASE = Profile(variant=False, ai_filler=False, translationese=False)
STRICT = Profile(variant=True, ai_filler=False, translationese=False)


def merged(rules: DataFrame, disabled_tags: list[str] | None = None) -> DataFrame:
    """Later layers, and later rules of a layer, replace earlier ones with the same ``from``; then disabled ones go."""
    latest = F.row_number().over(Window.partitionBy("from").orderBy(F.desc("layer"), F.desc("ord")))
    kept = rules.withColumn("_n", latest).where("_n = 1 and not coalesce(disabled, false)").drop("_n")
    if disabled_tags:
        kept = kept.where(~F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in disabled_tags])), F.lit(False)))
    return kept


def conflicts(rules: DataFrame) -> DataFrame:
    """``from, layer_a, ord_a, layer_b, ord_b``: the same term with different targets, in two layers or in one."""
    a = rules.select("from", F.col("layer").alias("layer_a"), F.col("ord").alias("ord_a"), "to")
    b = rules.select("from", F.col("layer").alias("layer_b"), F.col("ord").alias("ord_b"), F.col("to").alias("to_b"))
    earlier = (F.col("layer_a") < F.col("layer_b")) | ((F.col("layer_a") == F.col("layer_b")) & (F.col("ord_a") < F.col("ord_b")))
    return a.join(b, "from").where(earlier & (F.col("to") != F.col("to_b"))).drop("to", "to_b").distinct()


def problems(rules: DataFrame) -> DataFrame:
    """``from, problem`` of rules that can't work as written: what a pack is checked for before it is imported."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    usable = lambda g: (size(g["clues"]) > 0) & (size(g["to"]) > 0) & F.forall(g["clues"], lambda x: x != "") & F.forall(g["to"], lambda x: x != "")
    deletes = (size("to") == 1) & (F.get("to", F.lit(0)) == "")
    # Group conditions see plain arrays only where there are groups.
    bad_group = F.exists(F.coalesce("groups", F.array().cast("array<struct<clues:array<string>,to:array<string>>>")), lambda g: ~F.coalesce(usable(g), F.lit(False)))
    known = list(SEVERITIES)
    kinds = F.array(
        F.when(F.coalesce(F.col("from"), F.lit("")) == "", "empty term"),
        F.when(~F.coalesce(F.col("type").isin(known), F.lit(False)), "unknown type"),
        F.when(F.exists("to", lambda t: t == F.col("from")), "replaced by itself"),
        F.when(deletes & (F.col("type") != "ai_filler"), "deletes, but is no filler"),
        F.when(size("clues") > MOST_CLUES, "too many clues"),
        F.when(bad_group, "malformed group"),
        F.when(deletes & (size("groups") > 0), "groups on a deletion"),
        F.when(F.exists(F.coalesce("exceptions", F.array().cast("array<string>")), lambda e: ~e.contains(F.col("from"))), "exception without the term"),
    )
    return rules.select("from", F.explode(F.array_compact(kinds)).alias("problem"))


class Rule(NamedTuple):
    term: str
    to: list[str]
    kind: str
    english: str | None
    severity: str
    clues: list[str]
    negative_clues: list[str]
    exceptions: list[str]
    positional: list[tuple[str, str]]
    groups: list[tuple[list[str], list[str]]]
    confidence: str | None

    @property
    def deletes(self) -> bool:
        return self.kind == "ai_filler" and self.to == [""]

    @property
    def suggestions(self) -> list[str]:
        if self.deletes:
            return [""]
        return [t for t in self.to if t] or ([self.english] if self.english else [])


def _positional(clue: str) -> tuple[str, str] | None:
    kind, _, term = clue.partition(":")
    return (kind, term) if term and kind in ("before", "after", "adjacent", "not_before", "not_after") else None


def collected(rules: DataFrame, profile: Profile = EVERYTHING, guard: str | None = None) -> list[Rule]:
    """The prepared rules on the driver: disabled ones gone, the last of a term kept, guarded ones left to their detectors
    (or only those of ``guard``), families chosen, clues without repeats, malformed groups dropped whole."""
    rows = merged(rules).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a scan takes at most {MOST_RULES} rules")
    out = []
    for r in sorted(rows, key=lambda r: (r["layer"], r["ord"])):
        r = r.asDict(recursive=True)
        if not r["from"] or r.get("guard") != guard or not (guard or profile.takes(r["type"], r["from"])):
            continue
        of = lambda name: list(dict.fromkeys(r.get(name) or []))  # noqa: B023, E731
        groups = [(g["clues"], g["to"]) for g in r.get("groups") or [] if g["clues"] and g["to"] and all(g["clues"]) and all(g["to"])]
        rule = Rule(r["from"], list(r["to"] or []), r["type"], r["english"], r["severity"] or SEVERITIES.get(r["type"], "info"), of("clues")[:MOST_CLUES], of("negative_clues")[:MOST_CLUES], of("exceptions"), [p for c in of("positional") if (p := _positional(c))], groups, r.get("confidence"))
        out.append(rule._replace(groups=[]) if rule.deletes else rule)
    return out


def absorbers(rules: list[Rule]) -> list[str]:
    """Longer forms that swallow a term inside them: exceptions, and targets that hold their own term.

    A form that would hide another rule's term goes without: one that holds that term, or whose end begins it.
    """
    terms = {r.term for r in rules}
    begins: dict[str, list[str]] = {}
    for t in terms:
        begins.setdefault(t[0], []).append(t)
    out: dict[str, None] = {}
    for r in rules:
        for form in [*r.exceptions, *r.to]:
            if r.term not in form or form in terms:
                continue
            others = [t for c in set(form) for t in begins.get(c, ()) if t != r.term]
            if not any(t in form or any(t.startswith(form[k:]) for k in range(1, len(form))) for t in others):
                out[form] = None
    return list(out)


def overlaps(spans: list[Span], start: int, end: int) -> bool:
    """Whether a span of some length meets one of the sorted, disjoint ``spans``."""
    if start >= end or not spans:
        return False
    k = bisect_right(spans, (start, end))
    return (k > 0 and spans[k - 1][1] > start) or (k < len(spans) and spans[k][0] < end)


def joined(spans: list[Span]) -> list[Span]:
    """Sorted and disjoint: overlapping and adjacent spans as one."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def window(text: str, start: int, end: int, mask: list[Span], around: int = AROUND) -> Span:
    """``around`` characters on both sides of a match, but not beyond a blank line or into masked text."""
    low, high = max(0, start - around), min(len(text), end + around)
    for m in _BREAK.finditer(text, max(0, low - 2), start):
        low = max(low, m.end())
    # A break of the two kinds may begin with the same line end, so the search may overlap what it has just found.
    m = _BREAK.search(text, end, min(len(text), high + 2))
    if m:
        high = min(high, m.start())
    if mask:
        k = bisect_left(mask, (start, start))
        if k and low < mask[k - 1][1] <= start:
            low = mask[k - 1][1]
        k = bisect_left(mask, (end, end))
        if k < len(mask):
            high = min(high, mask[k][0])
    return min(low, start), max(high, end)


class Words:
    """A set of words, and whether one of them lies across a place."""

    def __init__(self, words: set[str]):
        self.words = {w for w in words if len(w) > 1}
        self.sizes = sorted({len(w) for w in self.words})

    def cross(self, text: str, place: int, from_before: int | None = None) -> bool:
        """Whether a word begins before ``place`` (and not after ``from_before``) and ends behind it, both sides ideographs."""
        if not self.sizes or not 0 < place < len(text) or not _IDEOGRAPHS.match(text[place]):
            return False
        for begin in range(place - 1, max(-1, place - self.sizes[-1]), -1):
            if not _IDEOGRAPHS.match(text[begin]):
                return False
            if from_before is not None and begin > from_before:
                continue
            if any(size > place - begin and text[begin : begin + size] in self.words for size in self.sizes):
                return True
        return False


#: The columns of an issue, behind the document's id.
ISSUE = "pos int, size int, byte_offset int, line int, col int, found string, suggestions array<string>, rule_type string, severity string, english string, clues array<string>, confidence string"


class Scanner:
    """Rules compiled for texts: terms and absorbers in one automaton, conditions by rule."""

    def __init__(self, rules: list[Rule], words: set[str] | None = None):
        self.rules = rules
        terms = {r.term for r in rules}
        vocabulary = {w for r in rules for w in (*r.to, *r.clues, *r.negative_clues)} | (words or set())
        self.words = Words(vocabulary - terms)
        self.forms = [[(f, [m.start() for m in re.finditer(f"(?={re.escape(r.term)})", f)]) for f in (*r.exceptions, *r.to) if r.term in f and f != r.term] for r in rules]
        self.strings = [*(r.term for r in rules), *absorbers(rules)]
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for i, s in enumerate(self.strings):
                self._automaton.add_word(s, (i, len(s)))
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, rule) of the leftmost-longest disjoint matches; absorbers have no rule and are left out."""
        if not self.strings or not text:
            return
        every = sorted((end - size + 1, -size, i) for end, (i, size) in self.automaton.iter(text))
        free = 0
        for start, size, i in every:
            if start >= free:
                free = start - size
                if i < len(self.rules):
                    yield start, free, i

    def _fits(self, text: str, start: int, end: int, i: int, mask: list[Span]) -> bool:
        r = self.rules[i]
        if overlaps(mask, start, end):
            return False
        if any(start >= at and text.startswith(form, start - at) for form, places in self.forms[i] for at in places):
            return False
        if self.words.cross(text, start) or self.words.cross(text, end, start):
            return False
        if r.clues or r.negative_clues:
            low, high = window(text, start, end, mask)
            # A clue counts if it begins in the window.
            near = lambda clue: text.find(clue, low, high - 1 + len(clue)) >= 0
            if (r.clues and not any(map(near, r.clues))) or any(map(near, r.negative_clues)):
                return False
        if r.positional:
            low, high = window(text, start, end, mask, DIRECTED)
            for kind, term in r.positional:
                if kind == "adjacent":
                    n = len(term)
                    before = start >= n and text.startswith(term, start - n) and not overlaps(mask, start - n, start)
                    if not before and not (text.startswith(term, end) and not overlaps(mask, end, end + n)):
                        return False
                else:
                    there = term in (text[end:high] if kind.endswith("before") else text[low:start])
                    if there == kind.startswith("not_"):
                        return False
        return True

    def scan(self, text: str, mask: list[Span] | None = None) -> list[tuple]:
        """Issues as tuples of ISSUE, in order of position."""
        mask = mask or []
        places, out, simplified = K.Places(text), [], None
        for start, end, i in self.hits(text):
            r = self.rules[i]
            if not self._fits(text, start, end, i, mask):
                continue
            if r.kind == "variant":
                simplified = X.is_simplified(text) if simplified is None else simplified
                if simplified:
                    continue
            size, suggestions = end - start, r.suggestions
            if r.deletes and text[end : end + 1] in ("，", "：") and not overlaps(mask, end, end + 1):
                size += 1
            if r.groups:
                low, high = window(text, start, end, mask)
                around = text[low:high]
                suggestions = next((to for clues, to in r.groups if any(c in around for c in clues)), suggestions)
            line, col, byte = places.of(start)
            out.append((start, size, byte, line, col, r.term, suggestions, r.kind, r.severity, r.english, r.clues, r.confidence))
        return out


def scanner(rules: DataFrame, profile: Profile = EVERYTHING, words: set[str] | None = None) -> Scanner:
    return Scanner(collected(rules, profile), words)


def pairs(mask: list[dict] | None) -> list[Span]:
    """A mask column's value as sorted, disjoint spans."""
    return joined([(m["start"], m["end"]) for m in mask or [] if m])


def issues(docs: DataFrame, rules: DataFrame | Scanner, profile: Profile = EVERYTHING, mask: str | None = None, words: set[str] | None = None) -> DataFrame:
    """``doc_id`` and the columns of ISSUE: every match whose surroundings fit its rule.

    ``mask`` names a column of spans (array of start, end) that no match may touch, nor any window look into; ``words``
    are dictionary words, beside the rules' own targets and clues, across whose edges no match may lie.
    """
    s = rules if isinstance(rules, Scanner) else scanner(rules, profile, words)
    if mask:
        return K.found(docs, lambda text, spans: s.scan(text, pairs(spans)), ISSUE, inputs=("text", mask))
    return K.found(docs, s.scan, ISSUE)


def hits(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id, pos, byte_offset, line, col, found``: leftmost-longest places of plain terms."""
    s = Scanner([Rule(t, [], "cross_strait", None, "warning", [], [], [], [], [], None) for t in dict.fromkeys(terms) if t])

    def of(text: str) -> Iterator[tuple]:
        places = K.Places(text)
        for start, _, i in s.hits(text):
            line, col, byte = places.of(start)
            yield start, byte, line, col, s.rules[i].term

    return K.found(docs, of, "pos int, byte_offset int, line int, col int, found string")


def clue_index(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """``doc_id, pos, clue``: every place of every clue of the rules, overlapping ones too, by position."""
    clues = sorted({c for r in collected(rules) for c in (*r.clues, *r.negative_clues)})
    s = Scanner([Rule(c, [], "cross_strait", None, "info", [], [], [], [], [], None) for c in clues])

    def of(text: str) -> list[tuple]:
        return sorted((end - size + 1, clues[i]) for end, (i, size) in s.automaton.iter(text)) if clues else []

    return K.found(docs, of, "pos int, clue string")


def without_mask(found: DataFrame, mask: DataFrame) -> DataFrame:
    """Issues that overlap no ``(doc_id, start, end)`` of the mask."""
    size = F.length("found")
    return found.join(mask.withColumnRenamed("doc_id", "_doc"), (F.col("doc_id") == F.col("_doc")) & (F.col("pos") < F.col("end")) & (F.col("pos") + size > F.col("start")), "left_anti")


def union_of(spans: DataFrame) -> DataFrame:
    """Overlapping and adjacent spans of a document as one."""
    by = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(by))
    return islands.groupBy("doc_id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def clipped(mask: Column, text: Column) -> Column:
    """A caller's mask held to the text and merged: sorted, disjoint ``array<struct<start,end>>``."""

    def of(spans: list[dict], text: str | None) -> list[dict]:
        n = len(text or "")
        inside = [(max(0, s["start"]), min(n, s["end"])) for s in spans if s and s["start"] is not None and s["end"] is not None]
        return [{"start": a, "end": b} for a, b in joined([(a, b) for a, b in inside if a < b])]

    return K.column(of, "array<struct<start:int,end:int>>", mask, text)
