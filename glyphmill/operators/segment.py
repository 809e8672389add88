"""Words by maximum matching over a dictionary, sentences with their places, and chunks of running text.

A segmenter holds words with weights: 1 for words of rules, 5 for general ones, 10 for function words.  At each place
all chunks of up to three words are compared: the most characters, then the fewest words, then the most even sizes,
then the heaviest single characters, then the longest first word.  Null and empty texts have no words.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import kernels as K
from glyphmill.functions import text as X
from glyphmill.operators import lexical as L

#: The longest word; weights by kind; a few function words and general words, which callers may replace.
LONGEST = 32
WEIGHTS = {"rule": 1, "general": 5, "function": 10}
FUNCTION_WORDS = ["的", "了", "是", "在", "和", "有", "不", "這", "那", "我", "你", "他", "她", "它", "也", "就", "都", "而", "及", "與", "或", "但", "很", "會", "要", "能", "可以", "因為", "所以", "如果", "我們", "他們", "一個", "沒有", "什麼"]
GENERAL_WORDS = ["累積", "分佈", "目的", "文件", "內容", "資料", "系統", "問題", "使用", "時候", "研究", "今天", "大家", "地方", "公司", "工作", "學習", "時間", "生活", "結果"]


def dictionary(rules: DataFrame, general: DataFrame | None = None, function: DataFrame | None = None) -> DataFrame:
    """``word, weight, from_rule``: rule terms, targets and clues, general and function words; each with its largest weight.

    General words that a rule knows keep the rule's weight.  ``general`` and ``function`` are tables ``(word)``.
    """
    spark = rules.sparkSession
    table = lambda words: spark.createDataFrame([(w,) for w in words], "word string")
    live = L.merged(rules)
    lists = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("to", "clues", "negative_clues")]))
    known = live.select(F.col("from").alias("word"), F.lit(True).alias("from_rule")).union(live.select(F.explode(lists), F.lit(False)))
    known = known.groupBy("word").agg(F.max("from_rule").alias("from_rule")).withColumn("weight", F.lit(WEIGHTS["rule"]))
    some = (general if general is not None else table(GENERAL_WORDS)).select("word").distinct()
    more = some.join(known.select("word"), "word", "left_anti").select("word", F.lit(False).alias("from_rule"), F.lit(WEIGHTS["general"]).alias("weight"))
    little = (function if function is not None else table(FUNCTION_WORDS)).select("word", F.lit(False).alias("from_rule"), F.lit(WEIGHTS["function"]).alias("weight"))
    every = known.select("word", "from_rule", "weight").union(more).union(little).where(F.length("word").between(1, LONGEST))
    return every.groupBy("word").agg(F.max("weight").alias("weight"), F.max("from_rule").alias("from_rule"))


class Segmenter:
    def __init__(self, weights: dict[str, int]):
        self.weights = weights
        self.sizes: dict[str, list[int]] = {}
        for word in weights:
            self.sizes.setdefault(word[0], []).append(len(word))
        self.sizes = {c: sorted(set(n)) for c, n in self.sizes.items()}

    @classmethod
    def of(cls, words: DataFrame) -> Segmenter:
        rows = words.select("word", "weight").limit(L.MOST_RULES + 1).collect()
        if len(rows) > L.MOST_RULES:
            raise ValueError(f"a segmenter takes at most {L.MOST_RULES} words")
        return cls({r.word: r.weight for r in rows})

    def _words(self, text: str, at: int) -> list[int]:
        """Sizes of the words that may begin here: one character in any case."""
        return sorted({1, *(n for n in self.sizes.get(text[at], ()) if text[at : at + n] in self.weights and at + n <= len(text))})

    def _first(self, text: str, at: int) -> int:
        options = self._words(text, at)
        if len(options) == 1:
            return 1
        best, size = None, 1
        for a in options:
            for b in self._words(text, at + a) if at + a < len(text) else [0]:
                for c in self._words(text, at + a + b) if b and at + a + b < len(text) else [0]:
                    chunk = [n for n in (a, b, c) if n]
                    total, count = sum(chunk), len(chunk)
                    ends = list(itertools.accumulate(chunk, initial=at))
                    singles = sum(self.weights.get(text[e], 0) for e, n in zip(ends, chunk) if n == 1)
                    key = (total, -count, -sum((n * count - total) ** 2 for n in chunk), singles, a)
                    if best is None or key > best:
                        best, size = key, a
        return size

    def tokens(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """(position, token, whether the dictionary has it)."""
        at = 0
        while at < len(text):
            sizes = self.sizes.get(text[at])
            # Most characters begin no longer word; these need no chunks.
            n = self._first(text, at) if sizes and sizes[-1] > 1 else 1
            yield at, text[at : at + n], text[at : at + n] in self.weights
            at += n

    def clues(self, text: str, clues: list[str]) -> int:
        """How many different clues are a known token or lie inside one."""
        known = {t for _, t, there in self.tokens(text) if there}
        return sum(any(c in t for t in known) for c in dict.fromkeys(clues) if c)


def tokens(docs: DataFrame, segmenter: Segmenter) -> DataFrame:
    """``doc_id, pos, token, known``."""
    return K.found(docs, segmenter.tokens, "pos int, token string, known boolean")


def clue_counts(text: Column, clues: Column, segmenter: Segmenter) -> Column:
    return K.column(lambda t, c: segmenter.clues(t, c or []), "int", text, clues)


def crossings(docs: DataFrame, words: set[str]) -> DataFrame:
    """``doc_id, pos, from_pos``: places that lie inside a word between two ideographs, and where the first such word begins."""
    ordered = sorted({w for w in words if len(w) > 1}, key=len, reverse=True)
    ideograph = K.compiled(f"[{X.IDEOGRAPH}]")
    pattern = re.compile("(?=(" + "|".join(map(re.escape, ordered)) + "))") if ordered else None

    def of(text: str) -> list[tuple[int, int]]:
        first: dict[int, int] = {}
        for m in pattern.finditer(text) if pattern else ():
            for pos in range(m.start() + 1, m.start() + len(m[1])):
                if ideograph.match(text[pos - 1]) and ideograph.match(text[pos]):
                    first.setdefault(pos, m.start())
        return sorted(first.items())

    return K.found(docs, of, "pos int, from_pos int")


#: Words before a full stop that end no sentence.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "vs", "etc", "e.g", "i.e", "Inc", "Ltd", "Co", "Corp", "No", "Fig", "Vol", "al"]
_END = re.compile(r"[。！？；]+|[.?!](?=\s+\S)|\n\s*\n")
_STARTS = K.compiled(rf"\s+[A-Z{X.IDEOGRAPH}]")


def sentence_spans(text: str, mask: list[L.Span] | None = None) -> list[L.Span]:
    """Trimmed sentences: full-width marks end one, an ASCII mark does before white space and a capital or an ideograph,
    unless an abbreviation stands before it; blank lines and edges of the mask end one too."""
    cuts = {0, len(text)}
    for m in _END.finditer(text):
        if m[0] in ".?!":
            word = re.search(r"[A-Za-z.]*$", text[max(0, m.start() - 12) : m.start()])[0].strip(".")
            if not _STARTS.match(text, m.end()) or (m[0] == "." and (word in ABBREVIATIONS or re.fullmatch("[A-Z]", word))):
                continue
        cuts.add(m.end())
    for a, b in mask or ():
        cuts |= {a, b}
    ordered = sorted(cuts)
    out = []
    for a, b in zip(ordered, ordered[1:]):
        part = text[a:b]
        if part.strip() and not L.overlaps(mask or [], a, b):
            out.append((a + len(part) - len(part.lstrip()), a + len(part.rstrip())))
    return out


def paragraph_spans(text: str) -> list[L.Span]:
    """Parts between blank lines (any mix of line ends), blank ones left out, untrimmed."""
    out, at = [], 0
    for m in re.finditer(r"\r?\n[ \t]*\r?\n(?:[ \t]*\r?\n)*", text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, n, start, end`` of the sentences."""
    return K.found(docs, lambda t: ((n, a, b) for n, (a, b) in enumerate(sentence_spans(t))), "n int, start int, end int")


def sentence_of(spans: list[L.Span], pos: int) -> int | None:
    """The number of the sentence that holds a position, by binary search."""
    k = bisect_right(spans, (pos, float("inf"))) - 1
    return k if k >= 0 and spans[k][0] <= pos < spans[k][1] else None


def placed(docs: DataFrame, column: str = "pos") -> DataFrame:
    """``docs(doc_id, text, pos)``: with the sentence that holds each place (null: none) and its text."""
    kind = "struct<n:int,sentence:string>"

    def of(text: str, pos: int | None) -> dict:
        spans = sentence_spans(text)
        n = None if pos is None else sentence_of(spans, pos)
        return {"n": n, "sentence": None if n is None else text[spans[n][0] : spans[n][1]]}

    return docs.withColumn("_s", K.column(of, kind, "text", column)).withColumns({"n": F.col("_s.n"), "sentence": F.col("_s.sentence")}).drop("_s")


#: Characters of a chunk at most, and how far its ends are looked for.
CHUNK, SEARCH = 500, 2000
_BLOCK = re.compile(r"\n(?=\n)|\n(?=#{1,6} |[-*+] |[0-9]+\. )")
_STOP = re.compile("[。！？；\n]")


def chunk_span(text: str, start: int, end: int) -> L.Span:
    """The running text around a place: up to a blank line, a heading or a list item on both sides, or, where that is
    more than CHUNK characters, about 230 on each side, up to the end of a sentence if one is near."""
    low, high = max(0, start - SEARCH), min(len(text), end + SEARCH)
    for m in _BLOCK.finditer(text, low, start):
        after = m.end() + (text.startswith("\n", m.end()))
        if after <= start:
            low = after
    m = _BLOCK.search(text, end, high)
    high = m.start() if m else high
    if high - low <= CHUNK:
        return low, high
    half = (CHUNK - 40) // 2
    left = max(low, start - half)
    if left > low:
        stops = [m.end() for m in _STOP.finditer(text, max(low, left - 20), left + 1)]
        left = stops[-1] if stops else max(low, left - 20)
    right = min(high, end + half)
    if right < high:
        m = _STOP.search(text, right - 1, min(high, right + 20))
        right = m.end() if m else min(high, right + 20)
    return left, max(min(right, left + CHUNK), end)


def chunks(docs: DataFrame, size: str = "size") -> DataFrame:
    """``docs(doc_id, text, pos, size)`` with ``chunk``: the text that a place is judged in."""

    def of(text: str, pos: int | None, n: int | None) -> str | None:
        if pos is None:
            return None
        a, b = chunk_span(text, pos, pos + (n or 0))
        return text[a:b]

    return docs.withColumn("chunk", K.column(of, "string", "text", "pos", size))
