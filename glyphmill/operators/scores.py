"""Scores of whole texts: machine style, translated style, regional vocabulary, spoken style, consistency.

Scores are diagnoses of what the prose does; each comes with the signals behind it.  A text that is too short has none.
Everything about a text is computed in its row.  Null texts have no scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import kernels as K
from glyphmill.operators import lexical as L
from glyphmill.operators import style as S

#: Phrase, threshold per 1000 characters, weight; least characters; weights of the translated style's signals.
PHRASES = [("更重要的是", 0.5, 1.0), ("值得注意的是", 0.3, 1.0), ("這意味著", 0.5, 0.8), ("不容忽視", 0.2, 0.7), ("深刻影響", 0.3, 0.8), ("從某種意義上", 0.2, 0.6), ("從某種程度上", 0.2, 0.6), ("需要注意的是", 0.3, 0.8), ("在某種程度上", 0.2, 0.6), ("在這個過程中", 0.3, 0.7)]
MACHINE_CHARS, TRANSLATED_CHARS = 500, 200
SIGNALS = [("passive", "被動語態", 1.0), ("chain", "的字鏈", 0.7), ("weak_verb", "弱動詞分解", 0.8), ("pronoun", "代詞密度", 0.6), ("issues", "翻譯腔偵測", 0.5)]
WEAK_VERBS = ["進行", "加以", "予以", "展開", "作出", "給予", "提供"]
WEAK_OBJECTS = ["討論", "分析", "研究", "調查", "測試", "開發", "設計", "評估", "檢查", "審查", "修改", "更新", "比較", "溝通", "合作", "訓練", "處理", "管理", "規劃", "改善", "調整", "整合", "驗證", "觀察", "監控", "維護", "決定", "回應", "貢獻", "改變", "承諾", "解釋", "判斷", "選擇", "反應", "讓步", "保證", "回答", "犧牲", "努力", "支援", "協助", "檢討", "投票", "改革", "發表", "發展"]
PERSONS = ["他們", "她們", "他", "她", "它"]
MARKS = "，。；、"
HIGH_ORAL = 0.05


def visible(text: str, mask: list[L.Span]) -> str:
    """The text outside the mask, with masked stretches as one sign that no word holds."""
    out, at = [], 0
    for a, b in mask:
        out += [text[at:a], "\0"]
        at = b
    return "".join([*out, text[at:]])


def variation(places: list[int]) -> float | None:
    """Deviation of the gaps between ten places or more, as a share of their mean."""
    gaps = [b - a for a, b in zip(places, places[1:])]
    if len(gaps) < 9:
        return None
    mean = sum(gaps) / len(gaps)
    return math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) / mean if mean >= 1 else None


def rhythm(text: str, mask: list[L.Span]) -> dict[str, tuple[int, float | None]]:
    """Count and variation of each full-width mark, and of double dashes, over visible characters."""
    seen = visible(text, mask).replace("\0", "")
    out = {c: [m.start() for m in re.finditer(c, seen)] for c in MARKS}
    out["——"] = [m.start() for m in re.finditer("(?=——)", seen)]
    return {k: (len(v), variation(v)) for k, v in out.items()}


def mark_rhythm(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, n, density, cv``: count, density per 1000 characters and variation of gaps of each mark that occurs."""

    def of(text: str) -> list[tuple]:
        return [(mark, n, 1000 * n / len(text), cv) for mark, (n, cv) in rhythm(text, []).items() if n]

    return K.found(docs, of, "mark string, n int, density double, cv double", where="[，。；、—]")


def machine_score(text: str, mask: list[L.Span], found: list[S.Finding], multiplier: float = 1.0, mentions: list[L.Span] | None = None) -> dict | None:
    """Phrases beyond their density (0.7 at most), families of devices (0.3 for prose, 0.15 for layout), other findings
    (0.3), invisible characters (0.2) and even punctuation (0.1); 1 at most.  None under 500 visible characters."""
    multiplier = multiplier if multiplier > 0 else 1.0
    n = len(visible(text, mask).replace("\0", ""))
    if n < MACHINE_CHARS:
        return None
    thousands, total, weights, signals = n / 1000, 0.0, 0.0, []
    for phrase, limit, weight in PHRASES:
        limit *= multiplier
        count = sum(1 for p in S._places(text, phrase, mask) if not L.overlaps(mentions or [], p, p + len(phrase)))
        if count:
            density = count / thousands
            weights += weight
            if density > limit:
                total += min(2.0, (density - limit) / limit) * weight
                signals.append((density / limit, phrase))
    families = {f[0] for f in found if f[0] not in (*S.NO_EVIDENCE, "invisible_character", *S.LEXICAL_FAMILIES)}
    layout = len(families & set(S.FORMATTING))
    devices = min(0.3, 0.1 * (len(families) - layout)) + min(0.15, 0.05 * layout)
    other = sum(f[0] in S.LEXICAL_FAMILIES for f in found) / thousands
    others = min(0.3, (other - 2) / 5) if other > 2 else 0.0
    hidden = sum(f[0] == "invisible_character" for f in found)
    hiding = min(0.2, hidden / (3.0 * multiplier) * 0.2)
    known = [(c, v) for c, v in rhythm(text, mask).values() if v is not None]
    even = 0.0
    if known:
        level = 0.5 * multiplier
        even = min(0.1, max(0.0, level - sum(c * v for c, v in known) / sum(c for c, _ in known)) / level * 0.1)
    phrases = min(1.0, total / weights) * 0.7 if weights else 0.0
    top = [p for _, p in sorted(signals, key=lambda s: -s[0])[:3]]
    top += [f"{len(families)} families"] * bool(families) + [f"{hidden} invisible"] * bool(hidden) + ["even punctuation"] * (even > 0)
    return {"score": min(1.0, phrases + devices + others + hiding + even), "top_signals": top[:3], "n_invisible": hidden, "n_families": len(families)}


def longest_chain(text: str) -> int:
    return max((clause.count("的") for clause in re.split("[，,。！？；\n\0]", text)), default=0)


def weak_verbs(text: str) -> int:
    """Empty verbs with a nominalized one in the four characters behind them."""
    objects = "|".join(WEAK_OBJECTS)
    return sum(re.search(objects, text[m.end() : m.end() + 4]) is not None for m in re.finditer("|".join(WEAK_VERBS), text))


def translated_score(text: str, mask: list[L.Span], n_issues: int, domain: str = "general") -> dict | None:
    """The weighted mean of five signals' excess over the domain's thresholds, from 0 to 1.  None under 200 characters."""
    seen = visible(text, mask)
    n = len(seen.replace("\0", ""))
    if n < TRANSLATED_CHARS:
        return None
    limits, thousands = S.DOMAINS[domain], n / 1000
    counts = {"passive": seen.count("被"), "chain": longest_chain(seen), "weak_verb": weak_verbs(seen), "pronoun": len(re.findall("|".join(PERSONS), seen)), "issues": n_issues}
    total, top = 0.0, []
    for key, name, weight in SIGNALS:
        density = counts[key] if key == "chain" else counts[key] / thousands
        excess = min(2.0, max(0.1, (density - limits[key]) / limits[key]))
        if density >= limits[key]:
            top.append((-excess, name))
        if density > limits[key] or (key == "chain" and density >= limits[key]):
            total += excess * weight
    return {"score": min(1.0, max(0.0, total / sum(w for *_, w in SIGNALS))), "top_signals": [name for _, name in sorted(top, key=lambda t: t[0])[:3]], "max_chain": counts["chain"], "n_weak_verbs": counts["weak_verb"], "n_pronouns": counts["pronoun"]}


def oral_density(text: str, markers: list[str]) -> float | None:
    """Ideographs of spoken markers, overlaps once, per ideograph; None under 20."""
    ideograph = re.compile("[一-鿿]")
    n = len(ideograph.findall(text))
    if n < 20:
        return None
    spans = L.joined([m.span() for w in markers for m in re.finditer(re.escape(w), text)])
    return sum(len(ideograph.findall(text[a:b])) for a, b in spans) / n


def _scored(docs: DataFrame, kernel: Callable[[str], tuple | None], schema: str) -> DataFrame:
    return K.found(docs, lambda text: [r] if (r := kernel(text)) else [], schema)


def machine_scores(docs: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """``doc_id, score, top_signals, n_invisible, n_families`` of texts with 500 characters or more."""

    def of(text: str) -> tuple | None:
        r = machine_score(text, [], S.found_in(text, []), multiplier)
        return r and (r["score"], r["top_signals"], r["n_invisible"], r["n_families"])

    return _scored(docs, of, "score double, top_signals array<string>, n_invisible int, n_families int")


def translated_scores(docs: DataFrame, issues: Callable[[str], int] | None = None, domain: str = "general") -> DataFrame:
    """``doc_id, score, top_signals, max_chain, n_weak_verbs, n_pronouns`` of texts with 200 characters or more."""
    if domain not in S.DOMAINS:
        raise ValueError(f"domains are {', '.join(S.DOMAINS)}")

    def of(text: str) -> tuple | None:
        r = translated_score(text, [], issues(text) if issues else 0, domain)
        return r and (r["score"], r["top_signals"], r["max_chain"], r["n_weak_verbs"], r["n_pronouns"])

    return _scored(docs, of, "score double, top_signals array<string>, max_chain int, n_weak_verbs int, n_pronouns int")


def thresholds(spark) -> DataFrame:
    """The domains' thresholds as a table: ``domain, signal, threshold``."""
    return spark.createDataFrame([(d, k, float(v)) for d, t in S.DOMAINS.items() for k, v in t.items()], "domain string, signal string, threshold double")


def scorecard(docs: DataFrame, scanner: L.Scanner, domain: str = "general") -> DataFrame:
    """``doc_id, machine, translated, regional``: three axes side by side, never combined; null where a text is too short."""

    def of(text: str) -> list[tuple]:
        one, two = machine_score(text, [], S.found_in(text, [])), translated_score(text, [], 0, domain)
        regional = sum(r[7] in ("cross_strait", "confusable") for r in scanner.scan(text))
        return [(one and one["score"], two and two["score"], min(1.0, 1000 * regional / len(text)) if text else 0.0)]

    return K.found(docs, of, "machine double, translated double, regional double")


def consistency(docs: DataFrame, scanner: L.Scanner, preferred: list[str] | None = None) -> DataFrame:
    """``doc_id, english, preferred, found, n``: regional terms beside which the preferred form stands in the same text too.

    Findings are grouped by their English; a group counts if its preferred form (a house term among its suggestions, else
    its first suggestion) also occurs outside the flagged terms.
    """

    def of(text: str) -> list[tuple]:
        groups: dict[str, list[tuple]] = {}
        for r in scanner.scan(text):
            if r[7] in ("cross_strait", "confusable") and r[8] != "info" and r[9]:
                groups.setdefault(r[9], []).append(r)
        out = []
        for english, rows in sorted(groups.items()):
            flagged = L.joined([(r[0], r[0] + r[1]) for r in rows if r[1]])
            alone = lambda term: any(not L.overlaps(flagged, m.start(), m.start() + len(term)) for m in re.finditer(f"(?={re.escape(term)})", text))  # noqa: B023, E731
            house = next((p for p in preferred or [] if p and any(p in r[6] for r in rows) and alone(p)), None)
            best = house or next((r[6][0] for r in rows if r[6]), "")
            if best and alone(best):
                terms: dict[str, int] = {}
                for r in rows:
                    terms[r[5]] = terms.get(r[5], 0) + 1
                out += [(english, best, term, n) for term, n in sorted(terms.items())]
        return out

    return K.found(docs, of, "english string, preferred string, found string, n int")


def quality_flags(docs: DataFrame, markers: list[str], scanner: L.Scanner | None = None) -> DataFrame:
    """``doc_id, flags``: what hints at a transcript; documents without a flag are left out.

    asr_artifacts (a rule for recognition errors), stutter_detected, spaced_acronyms, high_oral_density.
    """
    repeated = re.compile("([一-鿿]{2,3})\\1|(?<![A-Za-z0-9])([A-Za-z0-9]{3,})[ \t]*\n?[ \t]*\\2(?![A-Za-z0-9])", re.I)
    spaced = re.compile(r"(?<![A-Za-z0-9])[A-Z](?: [A-Z]){2,}(?![A-Za-z0-9])")

    def of(text: str) -> list[tuple]:
        density = oral_density(text, markers)
        asr = scanner is not None and any(r[7] == "confusable" and "ASR" in (r[9] or "") for r in scanner.scan(text))
        flags = [name for name, on in (("asr_artifacts", asr), ("stutter_detected", repeated.search(text)), ("spaced_acronyms", spaced.search(text)), ("high_oral_density", (density or 0) > HIGH_ORAL)) if on]
        return [(flags,)] if flags else []

    return K.found(docs, of, "flags array<string>")


def totals(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """One row over a batch: documents, characters, issues by severity, and ratios (null where nothing was read)."""
    count = lambda s: F.count_if(F.col("severity") == s)
    read = docs.select(F.lit(1).alias("document"), F.length("text").alias("chars"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("doc"))
    found = issues.select(F.lit(0), F.lit(None).cast("int"), "severity", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    both = read.union(found).agg(F.sum("document").alias("documents"), F.sum("chars").alias("chars"), F.count("doc").alias("issues"), count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"), F.countDistinct("doc").alias("with_issues"))
    return both.withColumns({"per_1000_chars": F.try_divide(F.lit(1000.0) * F.col("issues"), F.col("chars")), "share_with_issues": F.try_divide(F.col("with_issues").cast("double"), F.col("documents"))})
