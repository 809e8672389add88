"""Simplified to Traditional: phrases first, single characters in the gaps, Taiwan's variants last, until nothing changes.

A dictionary is three tables ``(kind, key, value)``: phrases, characters, variants.  Phrases' outputs are protected: no
later step touches them, so their variants are settled when the dictionary is built.  Its size is checked before it
travels with the tasks.  Null texts stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import kernels as K
from glyphmill.functions import text as X
from glyphmill.operators import fixes as FX
from glyphmill.operators import lexical as L

MOST_ENTRIES = 500_000
#: A sample of phrases whose characters have several traditional forms, and of Taiwan's variants; full
#: tables are read from files (``read``).
PHRASES = {"头发": "頭髮", "发现": "發現", "皇后": "皇后", "以后": "以後", "干净": "乾淨", "干部": "幹部", "里面": "裡面", "公里": "公里", "系统": "系統", "关系": "關係", "面条": "麵條", "表面": "表面", "几乎": "幾乎", "茶几": "茶几", "准备": "準備", "批准": "批准", "复杂": "複雜", "恢复": "恢復", "一只": "一隻", "只是": "只是", "理发": "理髮", "台湾": "臺灣"}
VARIANTS = {"裏": "裡", "衆": "眾", "爲": "為", "麽": "麼", "鷄": "雞", "綫": "線", "牀": "床", "喫": "吃", "羣": "群", "峯": "峰", "着": "著", "僞": "偽", "啓": "啟", "産": "產", "温": "溫"}
#: Characters with several traditional forms, which stay as they are outside phrases.
AMBIGUOUS = "后里干发面几只准复系台"
ROUNDS = 3


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Entries of a tab-separated file ``key <tab> value value ...``: the first value counts, lines with # are comments."""
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(~F.col("value").startswith("#") & F.col("value").contains("\t"))
    key, values = F.split_part("value", F.lit("\t"), F.lit(1)), F.split_part("value", F.lit("\t"), F.lit(2))
    return rows.select(F.lit(kind).alias("kind"), F.trim(key).alias("key"), F.split_part(F.trim(values), F.lit(" "), F.lit(1)).alias("value"), "ord")


def sample(spark: SparkSession) -> DataFrame:
    """The entries that come with the library."""
    characters = dict(zip(X.SIMPLIFIED_ONLY, X.TRADITIONAL_ONLY))
    rows = [(kind, k, v) for kind, table in (("phrase", PHRASES), ("character", characters), ("variant", VARIANTS)) for k, v in table.items()]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "kind string, key string, value string, ord long")


def dictionary(entries: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``kind, key, value``: the first entry of a key, after ``extra`` ones; entries that change nothing go, but phrases
    that protect a character with several forms; characters with several forms have no entry of their own; variants are
    already applied to phrases' outputs."""
    every = entries.withColumn("_late", F.lit(1))
    if extra is not None:
        every = extra.withColumn("_late", F.lit(0)).unionByName(every)
    first = F.row_number().over(Window.partitionBy("kind", "key").orderBy("_late", "ord"))
    kept = every.where((F.col("key") != "") & (F.col("value") != "")).withColumn("_n", first).where("_n = 1")
    several = F.col("key").rlike(f"[{AMBIGUOUS}]")
    idle = (F.col("key") == F.col("value")) & ~((F.col("kind") == "phrase") & several)
    alone = (F.col("kind") == "character") & several
    of = {r.key: r.value for r in kept.where("kind = 'variant' and length(key) = 1 and length(value) = 1").limit(MOST_ENTRIES).collect()}
    settled = F.translate("value", "".join(of), "".join(of.values()))
    return kept.where(~idle & ~alone).select("kind", "key", F.when(F.col("kind") == "variant", F.col("value")).otherwise(settled).alias("value"))


class Converter:
    def __init__(self, entries: list[tuple[str, str, str]]):
        of = lambda kind: {k: v for x, k, v in entries if x == kind}
        self.phrases = of("phrase")
        self.characters = str.maketrans({k: v for k, v in of("character").items() if len(k) == 1})
        self.variants = str.maketrans({k: v for k, v in of("variant").items() if len(k) == 1})
        self.scanner = L.Scanner([L.Rule(k, [], "phrase", None, "info", [], [], [], [], [], None) for k in self.phrases])

    @classmethod
    def of(cls, entries: DataFrame) -> Converter:
        rows = entries.limit(MOST_ENTRIES + 1).collect()
        if len(rows) > MOST_ENTRIES:
            raise ValueError(f"a dictionary takes at most {MOST_ENTRIES} entries")
        return cls([(r.kind, r.key, r.value) for r in rows])

    def gap(self, text: str) -> str:
        return text.translate(self.characters).translate(self.variants)

    def __call__(self, text: str) -> str:
        out, at = [], 0
        for start, end, _ in self.scanner.hits(text):
            out += [self.gap(text[at:start]), self.phrases[text[start:end]]]
            at = end
        return "".join([*out, self.gap(text[at:])])


def converted(text: Column | str, converter: Converter) -> Column:
    return K.column(converter, "string", text)


def fixpoint(docs: DataFrame, converter: Converter, scanner: L.Scanner, tier: str = "lexical_contextual", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, text, rounds, n_applied``: texts converted, then scanned and fixed until a round writes nothing."""

    def of(text: str) -> list[tuple]:
        new, total, n = converter(text), 0, 0
        while n < rounds:
            changed, fixes, _ = FX.applied(new, [FX.as_issue(r) for r in scanner.scan(new)], tier, [])
            n += 1
            if not fixes:
                break
            new, total = changed, total + len(fixes)
        return [(new, n, total)]

    done = K.found(docs, of, "text string, rounds int, n_applied int")
    return done.union(docs.where("text is null").select("doc_id", "text", F.lit(0), F.lit(0)))


def composed(text: str) -> tuple[str, list[int]]:
    """A text in canonical composition, and for each of its places (its end included) the place in ``text``.

    Composition never crosses a character that begins a sequence, so each such sequence is composed by itself, and all
    that comes of it stands for its start.
    """
    import unicodedata

    if unicodedata.is_normalized("NFC", text):
        return text, list(range(len(text) + 1))
    nfc = lambda t: unicodedata.normalize("NFC", t)
    starts = [0]
    for i in range(1, len(text)):
        c = text[i]
        if c.isascii() or (unicodedata.combining(c) == 0 and nfc(text[starts[-1] : i] + c) == nfc(text[starts[-1] : i]) + nfc(c)):
            starts.append(i)
    out, places = [], []
    for a, b in zip(starts, [*starts[1:], len(text)]):
        part = unicodedata.normalize("NFC", text[a:b])
        out.append(part)
        places += [a] * len(part)
    return "".join(out), [*places, len(text)]


def composed_issues(docs: DataFrame, scanner: L.Scanner) -> DataFrame:
    """``doc_id, pos, size, found, own``: issues of the composed text at their places in the text as it is; ``own`` is what stands there."""

    def of(text: str) -> list[tuple]:
        new, places = composed(text)
        out = []
        for row in scanner.scan(new):
            i = FX.as_issue(row)
            a, b = places[i["pos"]], places[i["pos"] + i["size"]]
            out.append((a, b - a, i["found"], text[a:b]))
        return out

    return K.found(docs, of, "pos int, size int, found string, own string")
