"""Secrets in texts: base patterns, and random strings found by a battery of randomness tests.

Candidates are long runs of encoding characters, without what base patterns cover.  For each the encoding is inferred, and its
symbols are tested for uniformity (chi-squared over groups of the alphabet), for runs about the median, and for serial
correlation.  Fisher's method combines the three into one p-value under randomness, which is small for text made of
words.  How such values come out for words is known from a null sample: windows of fixed prose in every length class,
and the table's own runs of lower-case letters of that class.  A candidate's p-value against that null goes into the Benjamini-Hochberg procedure of its
length class, so the share of false discoveries is controlled class by class.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.licenses import KNOWN
from glyphmill.llm.session import checkpointed, extended

# Kinds in the order that breaks ties, their patterns and least lengths.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
HINTS = ("password", "passwd", "secret", "token", "api")

LEAST = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
WORD = re.compile(r"[a-z]+")
#: Upper ends of the length classes.
LENGTHS = [24, 32, 40, 64, 128]
#: Classes of the combined p-value, on a logarithmic scale from 1 down to 10 ** -(STEPS / 10).
STEPS = 120
#: Lengths of the windows of fixed prose that are the null sample of each length class.
WINDOWS = [(20, 22, 24), (28, 32), (36, 40), (52, 64), (96, 128), (160, 256)]

_ALPHABETS = [
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
_INDEX = [(name, set(a), {c: i for i, c in enumerate(a)}, len(a)) for name, a in _ALPHABETS]


def _upper_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _upper_chi2(x: float, k: int) -> float:
    """P(chi-squared of k degrees > x), by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def inferred(string: str) -> tuple[str, np.ndarray, int]:
    """The smallest alphabet that holds ``string`` (padding apart), the symbols' places in it, and its size.

    Strings that mix alphabets take base64, with signs outside it in the place of their last symbol.
    """
    core = string.rstrip("=") or string
    letters = set(core)
    for name, have, index, size in _INDEX:
        if letters <= have:
            return name, np.array([index[c] for c in core]), size
    index = _INDEX[7][2]
    return "mixed", np.array([index.get(c, 63) for c in core]), 64


def battery(string: str) -> tuple[str, float, float, float, float]:
    """Encoding, and p-values under randomness: uniformity, runs, serial correlation, all three combined."""
    name, x, size = inferred(string)
    n = len(x)
    groups = int(min(size, max(2, n // 3)))
    got = np.bincount(x * groups // size, minlength=groups)
    share = np.bincount(np.arange(size) * groups // size, minlength=groups) / size
    uniform = _upper_chi2(float(((got - n * share) ** 2 / (n * share)).sum()), groups - 1)
    high = x >= size / 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b and n > 1:
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-12))
        runs = _upper_normal((1 + int((high[1:] != high[:-1]).sum()) - mean) / spread)
    else:
        runs = 2.0 ** (1 - n)
    d = x - x.mean()
    power = float((d * d).sum())
    serial = _upper_normal((float((d[1:] * d[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    statistic = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    half = statistic / 2
    together = math.exp(-half) * (1 + half + half * half / 2) if half < 700 else 0.0
    return name, uniform, runs, serial, min(1.0, together)


def step_of(p: float) -> int:
    """0 for 1, STEPS for the smallest."""
    return min(STEPS, int(-10 * math.log10(max(p, 1e-300))))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in code points, by start and then kind."""
    out = []
    lowered = text.lower()
    if any(hint in lowered for hint in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, str, bool]]:
    """(start, end, length class, step of the combined p-value, encoding, is null) of long runs, base spans cut out of them.

    Only whole runs are null: what is left beside a base span is part of a longer string.
    """
    out = []
    for m in RUN.finditer(text):
        at, pieces = m.start(), []
        for a, _, b in base:
            if a < m.end() and at < b:
                pieces.append((at, a))
                at = b
        for a, b in [*pieces, (at, m.end())]:
            if b - a >= LEAST:
                s = text[a:b]
                encoding, *_, together = battery(s)
                out.append((a, b, sum(len(s) > top for top in LENGTHS), step_of(together), encoding, not pieces and WORD.fullmatch(s) is not None))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_CANDIDATE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("length_class", T.IntegerType()), T.StructField("step", T.IntegerType()), T.StructField("encoding", T.StringType()), T.StructField("null_word", T.BooleanType())]))
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_ARROW_CANDIDATE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("length_class", pa.int32()), ("step", pa.int32()), ("encoding", pa.string()), ("null_word", pa.bool_())]))


def _kernel(columns: list[pa.Array]) -> list[pa.Array]:
    spans, found = [], []
    for text in columns[0]:
        text = text.as_py() or ""
        base = base_spans(text)
        spans.append([dict(zip(("start", "kind", "end"), x)) for x in base])
        found.append([dict(zip(("start", "end", "length_class", "step", "encoding", "null_word"), x)) for x in candidates(text, base)])
    return [pa.array(spans, _ARROW_SPAN), pa.array(found, _ARROW_CANDIDATE)]


@functools.cache
def fixed_null() -> np.ndarray:
    """Strings of the null sample by length class and step, from the letters of the licences' prose run together.

    It doesn't hang on the table, so small tables and tables without long words have p-values as fine as any.
    """
    letters = re.sub("[^a-z]+", "", " ".join(KNOWN.values()).lower())
    out = np.zeros((len(LENGTHS) + 1, STEPS + 1))
    for c, lengths in enumerate(WINDOWS):
        for n in lengths:
            for at in range(len(letters) - n + 1):
                out[c, step_of(battery(letters[at : at + n])[4])] += 1
    return out


def thresholds(counts: list[tuple[int, int, bool, int]], rate: float) -> dict[int, int]:
    """For each length class the largest step that is still a discovery (-1: none), by Benjamini-Hochberg.

    ``counts``: (length class, step, is null, strings).  A step's p-value is the share of null strings that look at
    least as random, (1 + count) / (1 + total); to those of the table come those of ``fixed_null``.
    """
    classes = range(len(LENGTHS) + 1)
    null = fixed_null().copy()
    seen = np.zeros_like(null)
    for length_class, step, is_null, n in counts:
        (null if is_null else seen)[length_class, step] += n
    out = {}
    for c in classes:
        p = (1 + np.cumsum(null[c])) / (1 + null[c].sum())
        passed = np.cumsum(seen[c])
        fits = np.flatnonzero((passed > 0) & (p <= rate * passed / max(1, seen[c].sum())))
        out[c] = int(fits[-1]) if len(fits) else -1
    return out


def scan(docs: DataFrame, rate: float = 0.1) -> DataFrame:
    """The columns of ``docs`` but ``text``, ``base_spans, spans`` (sorted arrays of ``(start, kind, end)``), and ``random``.

    Offsets are code points, ends exclusive; ``kind`` indexes KINDS.  ``spans`` has the base spans and those of random
    strings, found with a false discovery rate of ``rate`` in each length class over the whole table.  ``random`` tells
    of each of these strings the encoding and the step of its combined p-value (10 ** -(step / 10) at most).

    - Null texts are empty and have no spans; an empty table gives no rows; repeated rows each get their spans.
    - Texts are read whole, however long; base spans are cut out of random strings, and pieces of LEAST characters stay.
    - Columns named ``base_spans``, ``spans``, ``random`` or ``found`` are replaced.

    The text's findings are checkpointed, so texts are read once; what reaches the driver is a table of at most
    2 * (STEPS + 1) * (len(LENGTHS) + 1) counts.
    """
    seen = checkpointed(extended(docs, ["text"], [T.StructField("base_spans", _SPAN), T.StructField("found", _CANDIDATE)], _kernel, drop=("text",)))
    counts = seen.select(F.explode("found").alias("f")).groupBy("f.length_class", "f.step", "f.null_word").count().collect()
    last = thresholds([tuple(r) for r in counts], rate)
    table = F.array(*[F.lit(last[c]) for c in range(len(LENGTHS) + 1)])
    random = F.filter("found", lambda f: ~f["null_word"] & (f["step"] <= F.element_at(table, f["length_class"] + 1)))
    added = F.transform(random, lambda f: F.struct(f["start"].alias("start"), F.lit(3).alias("kind"), f["end"].alias("end")))
    told = F.transform(random, lambda f: F.struct(*[f[c].alias(c) for c in ("start", "end", "encoding", "step")]))
    return seen.withColumns({"spans": F.array_sort(F.concat("base_spans", added)), "random": told}).drop("found")


def joined(spans: str):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
