"""Detectors over sentences, lines and paragraphs: stock rhetoric, translated sentences, rhythm and spoken style.

Null and empty texts have no findings.  Everything about a text is found in its row; nothing is shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import kernels as K
from glyphmill.functions import text as X
from glyphmill.operators import structure as S

#: Phrases with their threshold per 1000 characters.
TRACKED = [("更重要的是", 0.5), ("值得注意的是", 0.3), ("這意味著", 0.5), ("不容忽視", 0.2), ("深刻影響", 0.3), ("從某種意義上", 0.2), ("從某種程度上", 0.2), ("需要注意的是", 0.3), ("在某種程度上", 0.2), ("在這個過程中", 0.3)]
#: Headings, paragraph endings, clues and markers.
HEADINGS = ["挑戰與未來展望", "結論與展望", "挑戰與機遇", "問題與挑戰", "優勢與劣勢", "現狀與未來", "回顧與展望", "總結與展望", "影響與意義", "發展與演變"]
ENDINGS = ["的基礎", "的基石", "的起點", "的關鍵", "的核心", "證明了", "揭示了", "展示了", "體現了", "由此可見", "這說明了", "不難發現", "這提示我們", "這也印證了", "這反映了"]
DEFINITION = ["定義", "是指", "就是", "亦即", "所謂", "稱為", "指的是"]
CONSEQUENCE = ["因此", "所以", "結果", "導致", "造成", "如果", "一旦", "將會", "可能"]
EXPLANATION = ["換言之", "換句話說", "簡單來說", "簡言之", "具體來說"]
ABSTRACT_NOUNS = ["的減少", "的增加", "的提高", "的下降", "的通過", "的實施"]
ABSTRACT_VERBS = ["導致", "標誌著", "意味著"]
ORAL = ["所以說", "基本上", "對不對", "就是說", "怎麼說", "就是", "其實", "然後", "那個", "這個", "嗯", "啊", "呢", "吧", "哦", "喔", "欸", "哎", "唉", "嘛", "齁", "蛤", "咧", "啦", "耶", "哇", "呀", "喂"]
PAUSES = "，、；：。！？,;:!?…—"
#: A list item anywhere in a paragraph.
ANY_ITEM = r"(^|\n)[ \t]*([-*] |[0-9][^\n]{0,2}\. )"
LIST_ITEM = r"^[ \t]*([-*]|[0-9]+[.)])[ \t]+"


def _any(words: list[str]) -> str:
    return "(" + "|".join(words) + ")"


def tracked_density(docs: DataFrame, multiplier: float = 1.0, least: int = 500) -> DataFrame:
    """``doc_id, phrase, n, pos``: phrases beyond their density in texts of ``least`` characters, at their first place."""
    table = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(t).alias("limit")) for p, t in TRACKED])
    each = docs.where(F.length("text") >= least).select("doc_id", "text", F.explode(table).alias("t"))
    n = ((F.length("text") - F.length(F.replace(F.col("text"), F.col("t.phrase"), F.lit("")))) / F.length("t.phrase")).cast("long")
    many = each.withColumn("n", n).where((F.col("n") > 0) & (1000.0 * F.col("n") / F.length("text") > F.col("t.limit") * multiplier))
    return many.select("doc_id", F.col("t.phrase").alias("phrase"), "n", (F.expr("locate(t.phrase, text)") - 1).alias("pos"))


def _bodies():
    """Trimmed paragraphs that aren't blank, as an array."""
    return F.filter(F.transform(F.split("text", S.PARAGRAPH, -1), F.trim), lambda b: b != "")


def paragraph_endings(docs: DataFrame) -> DataFrame:
    """``doc_id, n_endings``: at least three of five or more paragraphs end (last 30 characters) by a formula."""
    tail = lambda b: F.substring(b, F.greatest(F.length(b) - 29, F.lit(1)), F.lit(30))
    ends = F.size(F.filter("_b", lambda b: tail(b).rlike(_any(ENDINGS)))).cast("long")
    return docs.select("doc_id", _bodies().alias("_b")).where(F.size("_b") >= 5).select("doc_id", ends.alias("n_endings")).where("n_endings >= 3")


def formulaic_headings(docs: DataFrame) -> DataFrame:
    """``doc_id, n_headings``: two or more headings with stock phrases."""
    heads = F.filter(F.split("text", "\n", -1), lambda line: line.rlike("^#{1,6}[ \t]") & line.rlike(_any(HEADINGS)))
    return docs.select("doc_id", F.size(heads).cast("long").alias("n_headings")).where("n_headings >= 2")


def list_density(docs: DataFrame, share: float = 0.4) -> DataFrame:
    """``doc_id, n_lists, n_paragraphs``: of five or more paragraphs, three or more and over ``share`` hold lists."""
    bodies = F.filter(F.split("text", S.PARAGRAPH, -1), lambda b: F.trim(b) != "")
    counts = docs.select("doc_id", bodies.alias("_b")).select("doc_id", F.size(F.filter("_b", lambda b: b.rlike(ANY_ITEM))).cast("long").alias("n_lists"), F.size("_b").cast("long").alias("n_paragraphs"))
    return counts.where((F.col("n_paragraphs") >= 5) & (F.col("n_lists") >= 3) & (F.col("n_lists") > share * F.col("n_paragraphs")))


_ITEM = re.compile(r"[ \t]*(?:[-*+][ \t]|[0-9]+[.)][ \t])[ \t]*")
_BULLET = re.compile(r"[ \t]*(?:[-*] |[0-9]+[.)][ \t])[ \t]*")


def stacked_politeness(docs: DataFrame) -> DataFrame:
    """``doc_id, first, n_lines``: three or more list items in a row that begin with 請; indented lines belong to the item above."""

    def of(text: str) -> list[tuple[int, int]]:
        out, first, n = [], None, 0
        for k, line in enumerate([*text.split("\n"), ""]):
            m = _ITEM.match(line)
            if m and line.startswith("請", m.end()):
                first, n = (k if n == 0 else first), n + 1
            elif m or not line.strip() or line[0] not in " \t":
                if n >= 3:
                    out.append((first, n))
                n = 0
        return out

    return K.found(docs, of, "first int, n_lines int", where="請")


def mechanical_bullets(docs: DataFrame) -> DataFrame:
    """``doc_id, first, n_lines, kind``: lists of three or more items that all begin in bold (bold_items), or with a bold
    label of four characters and a colon (four_character_labels)."""
    label = re.compile(r"\*\*([^*]*)\*\*\s*[：:]")

    def of(text: str) -> list[tuple[int, int, str]]:
        out, items, first = [], [], 0
        for k, line in enumerate([*text.split("\n"), ""]):
            m = _BULLET.match(line)
            if m:
                first = first if items else k
                items.append(line[m.end() :])
                continue
            if len(items) >= 3 and all(i.startswith("**") for i in items):
                four = all((f := label.match(i)) and len(f[1]) == 4 for i in items)
                out.append((first, len(items), "four_character_labels" if four else "bold_items"))
            items = []
        return out

    return K.found(docs, of, "first int, n_lines int, kind string", where=r"\*\*")


def double_dashes(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, n``: paragraphs with two or more double dashes."""
    n = (F.length("body") - F.length(F.replace(F.col("body"), F.lit("——"), F.lit("")))) / 2
    return S.paragraphs(docs).select("doc_id", "paragraph", n.cast("long").alias("n")).where("n >= 2")


def one_of_density(docs: DataFrame, per_200: float = 2.0, least: int = 100) -> DataFrame:
    """``doc_id, paragraph, n``: paragraphs of ``least`` characters with two or more 之一 and ``per_200`` in 200 characters."""
    n = (F.length("body") - F.length(F.replace(F.col("body"), F.lit("之一"), F.lit("")))) / 2
    dense = S.paragraphs(docs).withColumn("n", n.cast("long")).where((F.length("body") >= least) & (F.col("n") >= 2))
    return dense.where(200.0 * F.col("n") / F.length("body") >= per_200).select("doc_id", "paragraph", "n")


def tricolons(docs: DataFrame) -> DataFrame:
    """``doc_id, n, size``: sentences with three spans of one length (1 to 8) in a row between enumeration marks."""
    sizes = F.transform(F.split(F.regexp_replace("sentence", "[。！？；]$", ""), "、", -1), F.length)
    three = F.filter(F.sequence(F.lit(1), F.greatest(F.size("sizes") - 2, F.lit(1))), lambda i: (F.get(F.col("sizes"), i + 1) == F.get(F.col("sizes"), i)) & (F.get(F.col("sizes"), i) == F.get(F.col("sizes"), i - 1)) & F.get(F.col("sizes"), i).between(1, 8))
    return S.sentences(docs).withColumn("sizes", sizes).withColumn("at", F.get(three, F.lit(0))).where("at is not null").select("doc_id", "n", F.get(F.col("sizes"), F.col("at")).alias("size"))


def meaning_verbs(docs: DataFrame) -> DataFrame:
    """``doc_id, n, suggestion``: sentences with 意味著, and the verb that their clues call for (null: only advice)."""
    s = F.col("sentence")
    better = F.when(s.rlike(_any(DEFINITION)), "表示").when(s.rlike(_any(CONSEQUENCE)), "代表").when(s.rlike(_any(EXPLANATION)), "也就是說")
    return S.sentences(docs).where(s.contains("意味著")).select("doc_id", "n", better.alias("suggestion"))


def translated_sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, n, detector``: abstract subjects, conditions behind the middle, and doubled marks of tense."""
    s = F.col("sentence")
    size = F.length("sentence")
    abstract = F.substring(s, 1, 20).rlike(_any(ABSTRACT_NOUNS)) & s.rlike(_any(ABSTRACT_VERBS))
    late = (size >= 6) & F.substring(s, F.floor(size / 2).cast("int") + 1, size).rlike("如果|假如|若")
    tense = s.rlike("[0-9][年月日]") & (X.count_of(s, "曾已過了") >= 3)
    kinds = F.array(F.when(abstract, "abstract_subject"), F.when(late, "displaced_condition"), F.when(tense, "tense_marks"))
    return S.sentences(docs).select("doc_id", "n", F.explode(F.array_compact(kinds)).alias("detector"))


def long_sentences(docs: DataFrame, most: int = 30, run: int = 15) -> DataFrame:
    """``doc_id, n, ideographs, longest``: sentences of more than ``most`` ideographs with ``run`` in a row without pause."""
    count = lambda c: F.length(F.regexp_replace(c, f"[^{X.IDEOGRAPH}]", ""))
    longest = F.array_max(F.transform(F.split("sentence", f"[{PAUSES}]", -1), count))
    return S.sentences(docs).select("doc_id", "n", count(F.col("sentence")).alias("ideographs"), longest.alias("longest")).where((F.col("ideographs") > most) & (F.col("longest") >= run))


_PARTICLE = re.compile(r"([的了呢])[\s。！？；」』）]*$", re.ASCII)


def monotone_endings(docs: DataFrame, least: int = 3) -> DataFrame:
    """``doc_id, paragraph, particle, first, n_sentences``: runs of sentences of a paragraph that close on one particle."""

    def of(text: str) -> list[tuple[int, str, int, int]]:
        out = []
        for paragraph, body in enumerate(re.split(S.PARAGRAPH, text)):
            run: tuple[str, int, int] = ("", 0, 0)
            for k, s in [*S.sentence_list(body), (-1, "")]:
                m = _PARTICLE.search(s)
                particle = m[1] if m else ""
                if particle and particle == run[0]:
                    run = (particle, run[1], run[2] + 1)
                    continue
                if run[0] and run[2] >= least:
                    out.append((paragraph, *run))
                run = (particle, k, 1)
        return out

    return K.found(docs, of, "paragraph int, particle string, first int, n_sentences long", where="[的了呢]")


def oral_density(docs: DataFrame, least: int = 20) -> DataFrame:
    """``doc_id, density``: characters of spoken fillers (longest first) per ideograph; null under ``least`` ideographs."""
    ideographs = F.length(F.regexp_replace("text", r"[^\x{4E00}-\x{9FFF}]", ""))
    spoken = F.length("text") - F.length(F.regexp_replace("text", _any(ORAL), ""))
    return docs.select("doc_id", F.when(ideographs >= least, spoken / ideographs).alias("density"))


def sentence_variability(docs: DataFrame, shortest: int = 4, least: int = 10) -> DataFrame:
    """``doc_id, n_sentences, sigma``: the population deviation of sentence lengths, of ``least`` or more sentences."""

    def of(text: str) -> list[tuple[int, float]]:
        sizes = [len(s) for _, s in S.sentence_list(text) if len(s) >= shortest]
        if len(sizes) < least:
            return []
        mean = sum(sizes) / len(sizes)
        return [(len(sizes), math.sqrt(sum((n - mean) ** 2 for n in sizes) / len(sizes)))]

    return K.found(docs, of, "n_sentences long, sigma double")
