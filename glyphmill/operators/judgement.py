"""Tiers of judgement over issues: order and duplicates, what needs a reader, local disambiguation, stores of decisions.

Issues are rows ``(doc_id, pos, found, suggestions, rule_type, severity, ...)``.  Stores are tables that are joined by
their keys; a side is broadcast only up to MOST_ROWS counted rows.  Null keys match nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import kernels as K
from glyphmill.operators import lexical as L

MOST_ROWS = 200_000
#: Order of severities and of rule types among equal findings; thresholds, clue weights and anchors of the
#: local score; a sample of collocations (term, word nearby, target) and of each profile's preferred terms.
SEVERITY = ["error", "warning", "info"]
TYPES = ["political_coloring", "cross_strait", "typo", "confusable", "variant", "case", "punctuation", "grammar", "ai_style", "ai_filler", "translationese", "repetition"]
DECIDED, AMBIGUOUS = 0.6, 0.3
COLLOCATIONS = [("進程", "排程", "行程"), ("進程", "PID", "行程"), ("進程", "殺掉", "行程"), ("進程", "背景", "行程"), ("進程", "fork", "行程"), ("程序", "編譯", "程式"), ("文件", "打開", "檔案"), ("文件", "下載", "檔案")]
VETOES = {"進程": ["學習", "成長", "改革", "歷史", "發展", "進展", "過程", "耐心", "毅力"]}
PREFERRED = {
    "base": {"進程": ("行程", 0.3), "線程": ("執行緒", 0.3), "內存": ("記憶體", 0.3), "軟件": ("軟體", 0.3), "硬件": ("硬體", 0.3), "接口": ("介面", 0.3), "服務器": ("伺服器", 0.3), "程序": ("程式", 0.2)},
    "strict": {"進程": ("行程", 0.5), "線程": ("執行緒", 0.5), "內存": ("記憶體", 0.5), "軟件": ("軟體", 0.5), "硬件": ("硬體", 0.5), "接口": ("介面", 0.5), "服務器": ("伺服器", 0.5), "程序": ("程式", 0.4), "令牌": ("權杖", 0.3), "中間件": ("中介層", 0.4)},
}


def _rank(column: str, order: list[str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)]), F.col(column)), F.lit(len(order)))


def scan_order(issues: DataFrame) -> DataFrame:
    """``order``: the place of each issue of a document by position, longer ones first."""
    return issues.withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", F.desc(F.length("found")), "rule_type", "found")))


def report_order(issues: DataFrame) -> DataFrame:
    """``order``: the place of each issue of a document by position, then severity, then type: the order of every report."""
    return issues.withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", _rank("severity", SEVERITY), _rank("rule_type", TYPES), "found")))


def without_duplicates(issues: DataFrame) -> DataFrame:
    """``issues(..., phase_family, phase_pass)``: what the lexical pass found goes where the indexed pass found the same family over it."""
    end = F.col("pos") + F.length("found")
    indexed = issues.where("phase_pass = 'indexed'").select(F.col("doc_id").alias("_doc"), F.col("phase_family").alias("_family"), F.col("pos").alias("_start"), end.alias("_end"))
    clash = (F.col("doc_id") == F.col("_doc")) & (F.col("phase_family") == F.col("_family")) & (F.col("_start") < end) & (F.col("pos") < F.col("_end")) & (F.col("phase_pass") == "lexical")
    return issues.join(indexed, clash, "left_anti")


def raised_in(issues: DataFrame, spans: DataFrame) -> DataFrame:
    """One degree graver inside ``spans(doc_id, start, end)``, such as headings."""
    inside = issues.join(spans.select(F.col("doc_id").alias("_doc"), "start", "end"), (F.col("doc_id") == F.col("_doc")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")), "left_semi")
    higher = F.when(F.col("severity") == "info", "warning").otherwise("error")
    marked = inside.withColumn("severity", higher)
    rest = issues.join(spans.select(F.col("doc_id").alias("_doc"), "start", "end"), (F.col("doc_id") == F.col("_doc")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")), "left_anti")
    return marked.unionByName(rest)


def in_cells(issues: DataFrame, cells: DataFrame) -> DataFrame:
    """With ``row, cell`` of the table cell ``cells(doc_id, start, end, row, cell)`` that holds an issue; null outside tables."""
    held = (F.col("doc_id") == F.col("_doc")) & (F.col("pos") >= F.col("start")) & (F.col("pos") + F.length("found") <= F.col("end"))
    return issues.join(cells.withColumnRenamed("doc_id", "_doc"), held, "left").drop("_doc", "start", "end")


def limited(issues: DataFrame, most: int = 3) -> DataFrame:
    """``doc_id, shown, more``: the first issues of each document, and how many are not shown."""
    ordered = report_order(issues)
    line = F.format_string("%d:%d %s", "line", "col", "found")
    return ordered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("order") <= most, F.struct("order", line.alias("line"))))).alias("s"), F.greatest(F.count("*") - most, F.lit(0)).alias("more")).select("doc_id", F.array_join(F.transform("s", lambda x: x["line"]), "; ").alias("shown"), "more")


def needs_judgement(issues: DataFrame, anchor: Column | None = None) -> Column:
    """Whether no tier can settle an issue alone: several suggestions, or a word with clues, of low confidence, or whose anchor was rejected."""
    lexical = ~F.col("rule_type").isin("punctuation", "case", "variant", "grammar")
    rejected = F.coalesce(anchor, F.lit(True)) == F.lit(False) if anchor is not None else F.lit(False)
    return (F.size("suggestions") > 1) | (lexical & ((F.coalesce(F.size("clues"), F.lit(0)) > 0) | (F.coalesce("confidence", F.lit("")) == "low") | rejected))


def allowed(issues: DataFrame, stance: str) -> DataFrame:
    """Without the political findings that a stance doesn't report."""
    political = F.col("rule_type") == "political_coloring"
    if stance == "neutral":
        return issues.where(~political)
    return issues.where(~(political & F.col("found").isin(L.IDENTITY_TERMS))) if stance == "international" else issues


def suppressed(issues: DataFrame, store: DataFrame) -> DataFrame:
    """Findings whose exact text is in ``store(found)`` become info."""
    known = store.select("found").where("found is not null").distinct().withColumn("_known", F.lit(True))
    joined = issues.join(F.broadcast(known) if known.count() <= MOST_ROWS else known, "found", "left")
    return joined.withColumn("severity", F.when(F.col("_known"), "info").otherwise(F.col("severity"))).drop("_known")


def eligible(kind: str, suggestions: list[str], clues: list[str], found: str, anchor: bool | None) -> bool:
    return kind in ("cross_strait", "confusable") and (anchor is True or len(suggestions) > 1 or bool(clues) or found in VETOES)


def _near(text: str, start: int, end: int) -> str:
    """40 characters on both sides, up to blank lines."""
    low = text.rfind("\n\n", max(0, start - 42), start)
    low = max(0, start - 40, low + 2 if low >= 0 else 0)
    high = text.find("\n\n", end, end + 42)
    return text[low : min(len(text), end + 40, high if high >= 0 else len(text))]


def judged(text: str, start: int, size: int, found: str, suggestions: list[str], clues: list[str], profile: str, anchor: bool | None = None) -> tuple[float, str, str | None]:
    """(score, resolution, target): an anchor or a collocation decides, a veto suppresses; else clues, the profile's
    preference and the anchor add up, and the score decides, suppresses, or leaves a gray zone."""
    near = _near(text, start, start + size)
    if anchor is True and len(suggestions) == 1:
        return 1.0, "hard_anchor", suggestions[0]
    target = next((to for term, word, to in COLLOCATIONS if term == found and word in near), None)
    if target in suggestions:
        return 1.0, "collocation", target
    if any(w in near for w in VETOES.get(found, [])):
        return 0.0, "suppressed", None
    hits = sum(c in near for c in clues)
    clue = min(0.7, 0.3 + 0.4 * hits / len(clues)) if hits else 0.0
    term, prior = PREFERRED[profile].get(found, (None, 0.0))
    bonus = 0.2 if anchor is True else -0.2 if anchor is False else 0.0
    score = round(min(1.0, max(0.0, clue + prior + bonus)), 9)
    if score >= DECIDED:
        best = term if prior > clue and term in suggestions else suggestions[0] if suggestions else None
        return score, "context_clue" if clue >= prior and clue > 0 else "profile_prior" if prior > 0 else "combined", best
    return (score, "suppressed", None) if score < AMBIGUOUS else (score, "gray_zone", None)


def disambiguated(docs: DataFrame, scanner: L.Scanner, profile: str = "base", anchors: str | None = None) -> DataFrame:
    """``doc_id, pos, found, suggestions, severity, outcome, resolution, score, tier``: every issue after the local tier.

    A resolved issue has its target first, a suppressed one is info, others are as they were.  ``anchors`` names a column
    ``map<string,boolean>`` of terms that a translation of the text confirmed or rejected.  ``tier`` tells who settled
    it: deterministic, heuristic, or unresolved.
    """

    def of(text: str, known: list | dict | None = None) -> list[tuple]:
        confirmed = dict(known or {})
        out = []
        for pos, size, _, _, _, found, suggestions, kind, severity, _, clues, _ in scanner.scan(text):
            anchor = confirmed.get(found)
            if not eligible(kind, suggestions, clues, found, anchor):
                out.append((pos, found, suggestions, severity, "not_eligible", None, None, "deterministic"))
                continue
            score, resolution, target = judged(text, pos, size, found, suggestions, clues, profile, anchor)
            if resolution == "suppressed":
                out.append((pos, found, suggestions, "info", "suppressed", resolution, score, "unresolved"))
            elif resolution == "gray_zone":
                out.append((pos, found, suggestions, severity, "gray_zone", resolution, score, "unresolved"))
            else:
                if target in suggestions:
                    k = suggestions.index(target)
                    suggestions = [target, *suggestions[1:k], *([suggestions[0]] if k else []), *suggestions[k + 1 :]]
                out.append((pos, found, suggestions, severity, "resolved", resolution, score, "heuristic"))
        return out

    schema = "pos int, found string, suggestions array<string>, severity string, outcome string, resolution string, score double, tier string"
    return K.found(docs, of, schema, inputs=("text", anchors) if anchors else ("text",))


def anchors(docs: DataFrame, translations: DataFrame, rules: DataFrame) -> DataFrame:
    """``doc_id, found, anchor``: whether the English of a rule's term stands among the content words of the text's translation.

    ``translations(doc_id, english)`` is made elsewhere; texts without one have no anchors.
    """
    terms = L.merged(rules).where("english is not null and english <> ''").select(F.col("from").alias("found"), F.lower("english").alias("_english"))
    words = translations.select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("english"), F.lit("[a-z]+"), F.lit(0))).alias("_words"))
    hits = L.hits(docs, [r.found for r in terms.select("found").distinct().limit(L.MOST_RULES).collect()]).select("doc_id", "found").distinct()
    stem = lambda w: F.regexp_replace(w, "(ing|ed|es|e|s)$", "")
    met = F.arrays_overlap(F.transform(F.regexp_extract_all("_english", F.lit("[a-z]+"), F.lit(0)), stem), F.transform("_words", stem))
    return hits.join(words, "doc_id").join(F.broadcast(terms), "found").select("doc_id", "found", met.alias("anchor"))


JUDGEMENT_KEY = ["found", "rule_type", "suggestions_key", "context_hash", "profile", "ruleset"]


def judgement_keys(issues: DataFrame, docs: DataFrame, profile: str, ruleset: str) -> DataFrame:
    """Issues with the key that a judgement is kept under: the finding, its suggestions, its surroundings, profile and rules."""
    chunked = issues.select("doc_id", "pos", "found", "rule_type", "suggestions").join(docs.select("doc_id", "text"), "doc_id")
    around = F.substring(F.col("text"), F.greatest(F.col("pos") - 40, F.lit(0)) + 1, F.length("found") + 80)
    return chunked.select("doc_id", "pos", "found", "rule_type", F.array_join("suggestions", "|").alias("suggestions_key"), F.sha2(around.cast("binary"), 256).alias("context_hash"), F.lit(profile).alias("profile"), F.lit(ruleset).alias("ruleset"))


def remembered(keyed: DataFrame, cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """``keyed`` with ``judgement`` from ``cache(JUDGEMENT_KEY..., judgement, judged_at)``: the latest one not older than ``days``."""
    fresh = cache.where(F.col("judged_at") >= now - F.expr(f"interval {int(days)} days"))
    last = F.row_number().over(Window.partitionBy(*JUDGEMENT_KEY).orderBy(F.desc("judged_at"), "judgement"))
    latest = fresh.withColumn("_n", last).where("_n = 1").select(*JUDGEMENT_KEY, "judgement")
    return keyed.join(latest, JUDGEMENT_KEY, "left")


def asked(keyed: DataFrame, judge: DataFrame, budget: int = 5) -> DataFrame:
    """Gray cases with the verdicts of ``judge(JUDGEMENT_KEY..., judgement)``, made elsewhere: ``budget`` at most of each document, the first ones."""
    some = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "found"))).where(F.col("_n") <= budget).drop("_n")
    return some.join(judge.select(*JUDGEMENT_KEY, "judgement").dropDuplicates(JUDGEMENT_KEY), JUDGEMENT_KEY, "left")


def tiers(issues: DataFrame) -> DataFrame:
    """One row: issues by the tier that settled them, and the confidence that follows (high: settled by rules)."""
    n = lambda t: F.count_if(F.col("tier") == t)
    out = issues.agg(n("deterministic").alias("deterministic"), n("heuristic").alias("heuristic"), n("llm_judged").alias("llm_judged"), n("unresolved").alias("unresolved"))
    return out.withColumns({"high": F.col("deterministic") + F.col("heuristic"), "medium": F.col("llm_judged"), "low": F.col("unresolved")})


def _list(column: str) -> Column:
    return F.array_join(column, " / ")


def explained(issues: DataFrame) -> DataFrame:
    """``confidence_level, false_friend, auto_fix_safe, needs_review, domain, rationale`` of every issue."""
    kind, english = F.col("rule_type"), F.coalesce("english", F.lit(""))
    soft = kind.isin("translationese", "ai_style", "grammar")
    guessed = F.when(soft | (F.col("severity") == "info"), "low").when(F.size("clues") > 0, "medium").otherwise("high")
    level = F.coalesce("confidence", guessed)
    quoted, targets = F.concat(F.lit("'"), F.col("found"), F.lit("'")), _list("suggestions")
    text = (
        F.when((kind == "cross_strait") & (english != ""), F.concat(quoted, F.lit(" stands for "), english, F.lit(" elsewhere; in Taiwan: "), targets))
        .when(kind == "cross_strait", F.concat(quoted, F.lit(" is said elsewhere; in Taiwan: "), targets))
        .when(kind == "confusable", F.concat(quoted, F.lit(" means different things on either side; for "), english, F.lit(" in Taiwan: "), targets))
        .when(kind == "political_coloring", F.concat(quoted, F.lit(" takes a side; neutral: "), targets))
        .when(kind == "variant", F.concat(quoted, F.lit(" is another form of "), targets))
        .when(kind == "typo", F.concat(quoted, F.lit(" should read "), targets))
        .when(F.size("suggestions") == 0, F.concat(quoted, F.lit(": advice, nothing to write")))
        .when(targets == "", F.concat(quoted, F.lit(": can go")))
        .otherwise(F.concat(quoted, F.lit(": "), targets))
    )
    return issues.withColumns(
        {
            "confidence_level": level,
            "false_friend": (kind == "confusable") | F.coalesce(F.col("confidence") == "low", F.lit(False)),
            "auto_fix_safe": (level != "low") & (F.size("suggestions") == 1) & kind.isin("punctuation", "case", "variant", "typo"),
            "needs_review": (level == "low") | (F.size("suggestions") > 1) | soft,
            "domain": F.nullif(F.regexp_extract(english, r"@domain ([^\s，。]+)", 1), F.lit("")),
            "rationale": text,
        }
    )


def cell_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, row, cell) of the trimmed cells of Markdown tables; the header is row 0, the rule under it has no cells."""
    out, at, row, previous = [], 0, None, ""
    for line in text.split("\n"):
        if row is None and "|" in previous and re.fullmatch(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\r?", line) and len(_cells(line, 0, 0)) == len(_cells(previous, 0, 0)):
            out += _cells(previous, at - len(previous) - 1, 0)
            row = 0
        elif row is not None:
            if "|" in line and line.strip():
                row += 1
                out += _cells(line, at, row)
            else:
                row = None
        previous = line
        at += len(line) + 1
    return out


def _cells(line: str, at: int, row: int) -> list[tuple[int, int, int, int]]:
    begin, end = len(line) - len(line.lstrip()), len(line.rstrip())
    begin += line.startswith("|", begin)
    end -= end > begin and line[end - 1] == "|"
    out, cell = [], 0
    edges = [begin, *(m.start() + 1 for m in re.finditer(r"(?<!\\)\|", line[:end]) if m.start() >= begin), end + 1]
    for a, b in zip(edges, edges[1:]):
        part = line[a : b - 1]
        stripped = part.strip()
        start = at + a + (len(part) - len(part.lstrip()) if stripped else 0)
        out.append((start, start + len(stripped), row, cell))
        cell += 1
    return out


def cells(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, row, cell`` of every table cell."""
    return K.found(docs, cell_spans, "start int, end int, row int, cell int", where=r"\|")


def section_starts(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, kind``: where a heading (also one that is underlined) or a rule begins, outside fences, quotes and lists."""
    fence, heading = re.compile(r" {0,3}(```|~~~)"), re.compile(r" {0,3}#{1,6}([ \t]|$)")
    rule = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")

    def of(text: str) -> list[tuple]:
        out, at, open_, previous = [], 0, None, None
        for line in text.split("\n"):
            line_ = line.rstrip("\r")
            m = fence.match(line_)
            if m:
                open_ = None if open_ == m[1] else open_ or m[1]
                previous = None
            elif not open_:
                plain = line_.strip() != "" and not re.match(r" {0,3}(>|[-*+][ \t]|[0-9]+[.)][ \t]| {4}|\t)", line_)
                if heading.match(line_):
                    out.append((at, "heading"))
                    previous = None
                elif previous is not None and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line_):
                    out.append((previous, "heading"))
                    previous = None
                elif rule.match(line_):
                    out.append((at, "rule"))
                    previous = None
                else:
                    previous = at if plain else None
            at += len(line) + 1
        return sorted(out)

    return K.found(docs, of, "pos int, kind string", where=r"(^|\n) {0,3}[#=\-*_]")
