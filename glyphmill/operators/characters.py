"""Detectors of single characters and their neighbours, in one pass over each text and within its row.

``pos`` counts code points.  Null and empty texts have no findings; rows that share a doc_id are separate texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from glyphmill.functions import kernels as K
from glyphmill.functions import text as X
from glyphmill.operators import quotes as Q

_FULL = "，。！？；：、（）「」『』《》…—"
_GAP = K.compiled(f"(?<=[{X.IDEOGRAPH}])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?=[{X.IDEOGRAPH}])")
_RUN = re.compile(f"([{_FULL}])\\1+")
_UNIT = K.compiled(f"(?=([{X.IDEOGRAPH}]{{3}})\\1)|(?=([{X.IDEOGRAPH}]{{2}})\\2)")
_SINGLE = K.compiled(f"([{X.IDEOGRAPH}])\\1")
#: Doubled characters that are words; a few, which callers may replace.
DOUBLED = ["謝謝", "爸爸", "媽媽", "哥哥", "姐姐", "弟弟", "妹妹", "爺爺", "奶奶", "常常", "剛剛", "慢慢", "漸漸", "人人", "天天", "年年", "看看", "想想", "試試", "哈哈", "呵呵", "星星", "寶寶", "漂漂", "僅僅", "偏偏", "往往", "處處", "默默", "深深"]


def missing_spaces(docs: DataFrame) -> DataFrame:
    """``doc_id, pos``: zero-length places between an ideograph and an ASCII letter or digit."""
    return K.found(docs, lambda t: ((m.start(),) for m in _GAP.finditer(t)), "pos int", where=f"[{X.IDEOGRAPH}]")


def half_width_marks(docs: DataFrame, mask: str | None = None) -> DataFrame:
    """``doc_id, pos, found, suggestion``: ASCII marks that the Chinese around them owns (``quotes.half_width``)."""
    return Q.marks(docs, Q.half_width, mask)


def repeated_marks(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, found``: runs of one full-width mark; the ellipsis and the dash may come twice."""

    def of(text: str) -> Iterator[tuple[int, str]]:
        for m in _RUN.finditer(text):
            if not (m[1] in "…—" and len(m[0]) == 2):
                yield m.start(), m[0]

    return K.found(docs, of, "pos int, found string", where=f"[{_FULL}]")


def repeated_units(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, unit``: two or three ideographs that follow themselves at once, three before two."""

    def of(text: str) -> Iterator[tuple[int, str]]:
        for m in _UNIT.finditer(text):
            unit = m[1] or m[2]
            if len(unit) == 3 or unit[0] != unit[1]:
                yield m.start(), unit

    return K.found(docs, of, "pos int, unit string", where=f"[{X.IDEOGRAPH}]{{4}}")


def doubled_characters(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """``doc_id, pos, found``: an ideograph written twice, not within a longer run of it, and no word of its own."""
    known = set(DOUBLED if words is None else words)

    def of(text: str) -> Iterator[tuple[int, str]]:
        for m in _SINGLE.finditer(text):
            a, b = m.span()
            if m[0] not in known and text[a - 1 : a] != m[1] and text[b : b + 1] != m[1]:
                yield a, m[0]

    return K.found(docs, of, "pos int, found string", where=f"[{X.IDEOGRAPH}]{{2}}")
