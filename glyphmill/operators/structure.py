"""Lines, paragraphs, sentences, and detectors that count over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import kernels as K
from glyphmill.functions import text as X

#: Phrases of stock prose, marks that end sentences, and subjects.
STOCK_PHRASES = ["值得注意的是", "總而言之", "綜上所述", "不可否認", "眾所周知", "與此同時", "在這個過程中", "毋庸置疑", "由此可見", "換句話說"]
#: Passive words that are usual in technical prose.
PASSIVES = ["被定義為", "被廣泛採用", "被置於", "被稱作", "被觀察到", "被記錄為"]
PRONOUNS = ["我們", "他們", "她們", "它們", "你們", "我", "你", "您", "他", "她", "它"]


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


#: What stands between paragraphs.
PARAGRAPH = r"\n[ \t\r]*\n"
_SENTENCE = re.compile("[^。！？；\n]+[。！？；]?")


def sentence_list(text: str) -> list[tuple[int, str]]:
    """(number, sentence without blanks around it) in a kernel, as ``sentences`` has them."""
    return [(k, s) for k, m in enumerate(_SENTENCE.finditer(text)) if (s := m[0].strip(" "))]


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, body``: parts between blank lines."""
    return docs.select("doc_id", F.posexplode(F.split("text", PARAGRAPH, -1)).alias("paragraph", "body"))


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, n, sentence``: up to and with a full-width end mark; blank ones are left out."""
    parts = F.regexp_extract_all("text", F.lit("[^。！？；\n]+[。！？；]?"), F.lit(0))
    return docs.select("doc_id", F.posexplode(parts).alias("n", "sentence")).where("trim(sentence) <> ''")


_WORD, _BETWEEN = re.compile(r"[^\W_]+"), re.compile(r"[ \t]+|[ \t]*\r?\n[ \t]*")


def _repeats(text: str):
    """(position, both words) of ASCII words of three letters or digits that follow themselves, blanks or one line end between."""
    before = None
    for m in _WORD.finditer(text):
        word = m[0]
        if before and len(word) >= 3 and word.isascii() and word.lower() == before[0].lower() and _BETWEEN.fullmatch(text, before.end(), m.start()):
            yield before.start(), text[before.start() : m.end()]
        before = m


def repeated_words(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, found``: a word that follows itself, case apart; each repeat from the first of its pair on."""
    return K.found(docs, _repeats, "pos int, found string")


def latin_repetitions(docs: DataFrame) -> DataFrame:
    """``doc_id, n_repeats``: how many words follow themselves (``repeated_words``)."""
    return K.found(docs, lambda t: [(n,)] if (n := sum(1 for _ in _repeats(t))) else [], "n_repeats int")


def dashes(docs: DataFrame, per_paragraph: int = 3, least: int = 3) -> DataFrame:
    """``doc_id, n_paragraphs``: documents with ``least`` paragraphs that have ``per_paragraph`` dashes or more."""
    many = F.size(F.filter(F.split("text", PARAGRAPH, -1), lambda b: X.count_of(b, "—") >= per_paragraph))
    return docs.select("doc_id", many.cast("long").alias("n_paragraphs")).where(F.col("n_paragraphs") >= least)


def mixed_address(docs: DataFrame) -> DataFrame:
    """Documents with both forms of *you*: the rarer one and its first place."""
    a, b = X.count_of(F.col("text"), "你"), X.count_of(F.col("text"), "您")
    rarer = F.when(a < b, "你").otherwise("您")
    return docs.where((a > 0) & (b > 0)).select("doc_id", rarer.alias("found"), (F.when(a < b, F.instr("text", "你")).otherwise(F.instr("text", "您")) - 1).alias("pos"))


def passive_density(docs: DataFrame) -> DataFrame:
    """Paragraphs of 20 characters or more with more passives than max(2, 2 per 100 characters, rounded up)."""
    n = F.regexp_count("body", F.lit("被(?!" + "|".join(w[1:] for w in PASSIVES) + ")"))
    chars = F.length("body")
    return paragraphs(docs).where((chars >= 20) & (n > F.greatest(F.ceil(chars / 100 * 2), F.lit(2)))).select("doc_id", "paragraph", n.alias("n_passives"))


def particle_chains(docs: DataFrame, least: int = 4) -> DataFrame:
    """Documents whose longest chain of 的 in a clause reaches ``least``."""
    return docs.select("doc_id", X.longest_chain(F.col("text"), "的").alias("chain")).where(F.col("chain") >= least)


def pronoun_runs(docs: DataFrame, least: int = 3) -> DataFrame:
    """``doc_id, n_sentences, first``: runs of ``least`` or more sentences in a row that begin with a pronoun."""

    def of(text: str) -> list[tuple[int, int]]:
        out, first, n = [], 0, 0
        for k, s in [*sentence_list(text), (-1, "")]:
            if s.startswith(tuple(PRONOUNS)):
                first, n = (k if n == 0 else first), n + 1
            else:
                if n >= least:
                    out.append((n, first))
                n = 0
        return out

    return K.found(docs, of, "n_sentences long, first int", where="|".join(PRONOUNS))


def phrase_density(docs: DataFrame) -> DataFrame:
    """``doc_id, phrase, n, density``: stock phrases per 1000 characters."""
    each = docs.select("doc_id", "text", F.explode(F.array(*[F.lit(p) for p in STOCK_PHRASES])).alias("phrase"))
    n = ((F.length("text") - F.length(F.replace(F.col("text"), F.col("phrase"), F.lit("")))) / F.length("phrase")).cast("int")
    return each.select("doc_id", "phrase", n.alias("n"), (1000.0 * n / F.length("text")).alias("density")).where("n > 0")


def comma_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_segments, first``: runs of two or more short segments between full-width commas."""

    def of(text: str) -> list[tuple[int, int]]:
        parts = text.split("，")
        short = "".join("01"[1 <= len(p.strip(" ")) <= 4] for p in parts[1:-1])
        return [(len(m[0]), m.start() + 1) for m in re.finditer("1{2,}", short)]

    return K.found(docs, of, "n_segments long, first int", where="，")


def punctuation_profile(docs: DataFrame, mark: str = ",") -> DataFrame:
    """``doc_id, n, density, cv``: a mark's count, its density per 1000 characters and the variation of its gaps (10 marks or more)."""
    places = docs.select("doc_id", F.length("text").alias("chars"), F.transform(F.split("text", "\\" + mark, -1), lambda p: F.length(p) + 1).alias("gaps"))
    inner = F.slice("gaps", 2, F.greatest(F.size("gaps") - 2, F.lit(0)))
    n = F.size("gaps") - 1
    total = places.select("doc_id", n.alias("n"), (1000.0 * n / F.greatest("chars", F.lit(1))).alias("density"), inner.alias("g")).where("n > 0")
    mean = F.aggregate("g", F.lit(0.0), lambda a, x: a + x) / F.size("g")
    spread = F.sqrt(F.aggregate("g", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / F.size("g"))
    return total.withColumn("m", F.when(F.col("n") >= 10, mean)).select("doc_id", "n", "density", F.when(F.col("n") >= 10, spread / F.col("m")).alias("cv"))


def html_languages(pages: DataFrame) -> DataFrame:
    """``page_id, lang, is_chinese`` of the root element."""
    lang = F.lower(F.regexp_extract("html", r"<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1))
    return pages.select("page_id", lang.alias("lang"), lang.rlike("^(zh|yue|cmn|nan|hak|wuu|lzh)(-|$)").alias("is_chinese"))


#: Pairs of letters that are acronyms when they stand apart; all others of two letters are left alone.
TWO_LETTERS = ["AI", "IO", "OS", "IP", "UI", "VM", "GC", "PC", "DB", "PR", "RD", "QA", "ML", "FE", "BE"]


def spaced_acronyms(docs: DataFrame) -> DataFrame:
    """``doc_id, found, suggestion``: three or more single capitals with spaces between, or two that are listed."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])[A-Z]( [A-Z])+(?![A-Za-z0-9])"), F.lit(0)))
    joined = docs.select("doc_id", found.alias("found")).withColumn("suggestion", F.replace(F.col("found"), F.lit(" "), F.lit("")))
    return joined.where((F.length("suggestion") > 2) | F.col("suggestion").isin(TWO_LETTERS))


def mentions(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, found`` of @names outside addresses and paths."""
    from glyphmill.operators import masks

    return K.found(docs, lambda t: ((a, b, t[a:b]) for a, b in masks.mention_spans(t)), "start int, end int, found string", where="@[A-Za-z0-9_]")
