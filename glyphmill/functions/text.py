"""Column functions over texts.  Positions are code points from 0 unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions import kernels as K

#: Ideographs (Bopomofo, extensions, compatibility), without the iteration mark and the zero sign.
IDEOGRAPH = r"\x{3100}-\x{312F}\x{31A0}-\x{31BF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
#: Characters that only one of the two scripts uses.
SIMPLIFIED_ONLY = "们个这来时国说还对会过么为发开关现经动东车长门问见贝马鱼鸟龙语读请让谁该认识计设许论证词试话详误调课谈"
TRADITIONAL_ONLY = "們個這來時國說還對會過麼為發開關現經動東車長門問見貝馬魚鳥龍語讀請讓誰該認識計設許論證詞試話詳誤調課談"


def spans(text: Column, pattern: str) -> Column:
    """Array of ``(start, end, found)`` of the leftmost non-overlapping matches, in one pass over the text."""
    kind = "array<struct<start:int,end:int,found:string>>"
    return K.column(lambda t: [{"start": m.start(), "end": m.end(), "found": m[0]} for m in K.compiled(pattern).finditer(t)], kind, text)


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are in ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def script(text: Column) -> Column:
    """simplified, traditional or unknown, by characters that only one script uses; a tie or a blank text is unknown."""
    simple, full = count_of(text, SIMPLIFIED_ONLY), count_of(text, TRADITIONAL_ONLY)
    return F.when(F.trim(text) == "", "unknown").when(simple > full, "simplified").when(full > simple, "traditional").otherwise("unknown")


def is_simplified(text: str) -> bool:
    """``script`` of one text, in a kernel."""
    simple, full = (sum(text.count(c) for c in chars) for chars in (SIMPLIFIED_ONLY, TRADITIONAL_ONLY))
    return simple > full


def to_traditional(text: Column) -> Column:
    """Character-wise conversion; characters with more than one traditional form stay."""
    return F.translate(text, SIMPLIFIED_ONLY, TRADITIONAL_ONLY)


def auto_traditional(text: Column) -> Column:
    """Converts texts that are detected as simplified, and no others."""
    return F.when(script(text) == "simplified", to_traditional(text)).otherwise(text)


def half_width_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def line_of(text: Column, at: Column) -> Column:
    """1-based line of a position."""
    before = F.substring(text, F.lit(1), at)
    return 1 + F.length(before) - F.length(F.translate(before, "\n", ""))


def column_of(text: Column, at: Column) -> Column:
    """1-based column of a position, in UTF-16 units."""
    tail = F.substring_index(F.substring(text, F.lit(1), at), "\n", -1)
    return 1 + (F.octet_length(F.encode(tail, "UTF-16BE")) / 2).cast("int")


def byte_offset(text: Column, at: Column) -> Column:
    """UTF-8 byte offset of a position."""
    return F.octet_length(F.substring(text, F.lit(1), at))


def content_type(path: Column) -> Column:
    lowered = F.lower(path)
    return F.when(lowered.rlike(r"\.(md|markdown)$"), "markdown").when(lowered.rlike(r"\.ya?ml$"), "yaml").otherwise("plain")


def longest_chain(clause: Column, sign: str) -> Column:
    """The most occurrences of ``sign`` in a stretch without clause breaks."""
    counts = F.transform(F.split(clause, "[，、。；：！？,;:!?\n]", -1), lambda c: F.length(c) - F.length(F.translate(c, sign, "")))
    return F.array_max(counts)
