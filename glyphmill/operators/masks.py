"""Places that no detector should look at: addresses, paths, quoted terms, suppressed lines and markup.

Each kind of place is a function of a text, that gives spans or numbers of lines; the tables ``doc_id, start, end`` and
``doc_id, line_no`` come of them, and so does ``with_mask``, which composes what a content type needs within the row.
Null and empty texts have no masks; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import kernels as K
from glyphmill.operators import lexical as L

#: Patterns of addresses, paths and named terms; words of suppression comments.
URL = r"[a-zA-Z0-9+.\-]*://[^\s「」『』《》]+"
PATH = r"(?:\.\.?/|/)[^\s「」『』《》]+"
TERM = r"[^「」『』。！？；，、：\r\n]{1,12}"
NAMED = rf"(?:「{TERM}」|『{TERM}』)(?:是(?:中國(?:大陸)?|大陸|當地|地方|舊)?的?(?:說法|用語)|一詞|這個詞)"
NEXT, START, LINE, END = ["disable-next-line", "ignore-next-line", "disable-next", "ignore-next"], ["disable-block", "ignore-block"], ["disable-line", "ignore-line", "disable", "ignore"], ["end-disable", "end-ignore", "enable"]
CHINESE = ["zh", "cdo", "cjy", "cmn", "cnp", "cpx", "csp", "czh", "czo", "gan", "hak", "hsn", "lzh", "mnp", "nan", "wuu", "yue"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
RAW = ["script", "style", "textarea", "title"]
#: Elements that end when another begins or their parent ends, and the deepest nesting that is followed.
CLOSES = {"li": ["li"], "p": ["p"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "option": ["option"]}
BLOCKS = ["div", "p", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "section", "article", "header", "footer", "form", "hr", "main", "nav"]
DEEPEST = 512
#: The word before a suppression comment's keyword.
PREFIX = "glyphmill"


def _spans(docs: DataFrame, kernel: Callable[[str], Iterable[L.Span]], where: str | None = None) -> DataFrame:
    return K.found(docs, kernel, "start int, end int", where=where)


def _matches(pattern: str) -> Callable[[str], list[L.Span]]:
    return lambda text: [m.span() for m in K.compiled(pattern).finditer(text)]


url_spans = _matches(URL)


def urls(docs: DataFrame) -> DataFrame:
    return _spans(docs, url_spans, "://")


def path_spans(text: str) -> list[L.Span]:
    """Paths, but for those that overlap an address without containing it."""
    addresses = url_spans(text)
    out = []
    for m in K.compiled(PATH).finditer(text):
        a, b = m.span()
        if any(a < y and x < b and not (a <= x and b >= y) for x, y in addresses):
            continue
        out.append((a, b))
    return out


def paths(docs: DataFrame) -> DataFrame:
    return _spans(docs, path_spans, PATH)


def mention_spans(text: str) -> list[L.Span]:
    """@names outside addresses and paths."""
    held = L.joined(url_spans(text) + path_spans(text))
    return [m.span() for m in re.finditer("@[A-Za-z0-9_]+", text) if not L.overlaps(held, *m.span())]


def named_spans(text: str) -> list[L.Span]:
    """Short quoted terms that the words right behind them name as terms; the quotation marks stay outside."""
    inner = K.compiled(f"[「『]({TERM})[」』]")
    return [(m.start() + 1, m.start() + 1 + len(inner.match(m[0])[1])) for m in K.compiled(NAMED).finditer(text)]


def named_terms(docs: DataFrame) -> DataFrame:
    return _spans(docs, named_spans, "[」』](是|一詞|這個詞)")


def suppressed_numbers(text: str, hash_comments: bool = False, prefix: str = PREFIX) -> list[int]:
    """Lines that comments suppress: their own, the next one, or a block (which doesn't nest; unclosed: to the end)."""
    if prefix + ":" not in text:
        return []
    opener = r"(?:<!--|(?:^|[^A-Za-z0-9:/])//" + (r"|(?:^|\s)#+" if hash_comments else "") + r")\s*" + re.escape(prefix) + ":"
    kinds = [(k, K.compiled(opener + "(?:" + "|".join(words) + r")(?:$|[^A-Za-z0-9_\-])")) for k, words in (("next", NEXT), ("start", START), ("line", LINE), ("end", END))]
    out, open_, after = [], False, False
    for n, line in enumerate(text.split("\n")):
        line = line.strip(" ")
        kind = next((k for k, p in kinds if p.search(line)), None)
        if open_ or after or kind in ("start", "line"):
            out.append(n)
        after = kind == "next" and not open_
        open_ = kind == "start" or (open_ and kind != "end")
    return out


def suppressed_lines(docs: DataFrame, hash_comments: bool = False, prefix: str = PREFIX) -> DataFrame:
    return _lines(docs, lambda t: suppressed_numbers(t, hash_comments, prefix), re.escape(prefix) + ":")


def _lines(docs: DataFrame, kernel: Callable[[str], Iterable[int]], where: str | None = None) -> DataFrame:
    return K.found(docs, lambda t: ((n,) for n in kernel(t)), "line_no int", where=where)


_FENCE = re.compile(r" {0,3}(```|~~~)")


def fenced_numbers(text: str) -> list[int]:
    """Lines of fenced code, fences included; a fence closes only by its own sign."""
    out, open_ = [], ""
    for n, line in enumerate(text.split("\n")):
        m = _FENCE.match(line)
        if open_ or m:
            out.append(n)
        if m and open_ in ("", m[1]):
            open_ = "" if open_ else m[1]
    return out


def fenced_lines(docs: DataFrame) -> DataFrame:
    return _lines(docs, fenced_numbers, "(^|\n) {0,3}(```|~~~)")


_RULE = re.compile(r"---[ \t\r]*")


def front_matter_numbers(text: str) -> list[int]:
    """The two fences of a leading ``---`` block; its values are still looked at."""
    lines = text.split("\n")
    if len(lines) < 2 or not _RULE.fullmatch(lines[0]):
        return []
    end = next((n for n, line in enumerate(lines[1:], 1) if _RULE.fullmatch(line)), None)
    return [] if end is None else [0, end]


def front_matter_lines(docs: DataFrame) -> DataFrame:
    return _lines(docs, front_matter_numbers, "^---[ \t\r]*\n")


def container_numbers(text: str) -> list[int]:
    return [n for n, line in enumerate(text.split("\n")) if re.match(r"[ \t]*:::", line)]


def container_lines(docs: DataFrame) -> DataFrame:
    return _lines(docs, container_numbers, ":::")


_KEY = re.compile(r"[ \t]*(?:- )?[A-Za-z0-9_.\-]+:")


def key_sizes(text: str) -> list[tuple[int, int]]:
    """(line, characters) from the start of a line through the colon of its key."""
    return [(n, m.end()) for n, line in enumerate(text.split("\n")) if (m := _KEY.match(line))]


def yaml_keys(docs: DataFrame) -> DataFrame:
    return K.found(docs, key_sizes, "line_no int, size int", where=":")


_HEAD = re.compile(r" {0,3}(#{1,6})[ \t]")


def heading_rows(text: str) -> Iterator[tuple[int, int, str, int, int]]:
    """(line, level, title, start, end) of headings outside fenced code."""
    fenced, at = set(fenced_numbers(text)), 0
    for n, line in enumerate(text.split("\n")):
        m = _HEAD.match(line)
        if m and n not in fenced:
            body = re.sub(r"[ \t]+#+[ \t]*$", "", line[m.end() :].rstrip("\r"))
            title = body.strip(" ")
            start = at + m.end() + len(body) - len(body.lstrip())
            yield n, len(m[1]), title, start, start + len(body.strip())
        at += len(line) + 1


def headings(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, level, title, start, end``: headings outside fenced code, and where their text lies."""
    return K.found(docs, heading_rows, "line_no int, level int, title string, start int, end int", where="(^|\n) {0,3}#")


_INLINE = re.compile(r"`[^`\n]+`|<[A-Za-z/!][^>\n]*>|\]\([^)\s]*(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?[ \t]*\)|\]\[[^\]\n]*\]|(?m:^ {0,3}\[[^\]\n]+\]:[^\n]*)")


def inline_spans(text: str) -> list[L.Span]:
    """Inline code, tags, link destinations with their titles, labels and definitions of Markdown."""
    return [m.span() for m in _INLINE.finditer(text)]


def quoted_numbers(text: str) -> list[int]:
    """Lines of block quotes."""
    return [n for n, line in enumerate(text.split("\n")) if re.match(r" {0,3}>", line)]


def indented_numbers(text: str) -> list[int]:
    """Lines of indented code: four spaces or a tab, behind a blank line or such code, and not within a list."""
    out, before_blank, listed = [], True, False
    for n, line in enumerate(text.split("\n")):
        blank = not line.strip()
        deep = re.match(r"(?: {4}|\t)", line) is not None
        if not blank and not deep:
            listed = re.match(r" {0,3}(?:[-*+]|[0-9]+[.)])[ \t]", line) is not None
        if not blank and deep and not listed and (before_blank or (out and out[-1] == n - 1)):
            out.append(n)
        before_blank = blank
    return out


def _whole(text: str, numbers: Iterable[int]) -> list[L.Span]:
    wanted, out, at = set(numbers), [], 0
    for n, line in enumerate(text.split("\n") if wanted else ()):
        if n in wanted:
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def line_spans(docs: DataFrame, kernel: Callable[[str], Iterable[int]]) -> DataFrame:
    """Whole lines, whose numbers ``kernel`` gives, as spans."""
    return _spans(docs, lambda t: _whole(t, kernel(t)))


def _key_spans(text: str, last: int | None = None) -> list[L.Span]:
    """Keys of YAML lines, and the quotation marks around their values; up to line ``last``."""
    out, sizes, at = [], dict(key_sizes(text)), 0
    for n, line in enumerate(text.split("\n")):
        if last is not None and n >= last:
            break
        if n in sizes:
            out.append((at, at + sizes[n]))
            value = line[sizes[n] :].rstrip("\r")
            m = re.fullmatch(r"[ \t]*([\"'])(.*)\1[ \t]*", value)
            if m:
                first = at + sizes[n] + m.start(1)
                end = at + sizes[n] + m.end(2)
                out += [(first, first + 1), (end, end + 1)]
        at += len(line) + 1
    return out


TYPES = ["plain", "markdown", "markdown-scan-code", "yaml"]


def mask_of(text: str, content_type: str = "markdown", blockquotes: bool = False) -> list[L.Span]:
    """The merged mask of one text: addresses, paths, names and named terms in any; suppressed lines; for Markdown code
    (unless it is to be scanned), inline markup, front matter, container fences, foreign HTML and, if asked, block quotes;
    for YAML the keys."""
    spans = [*url_spans(text), *path_spans(text), *named_spans(text), *mention_spans(text), *_whole(text, suppressed_numbers(text, content_type == "yaml"))]
    if content_type.startswith("markdown"):
        front = front_matter_numbers(text)
        spans += _whole(text, [*front, *container_numbers(text)])
        if front:
            spans += _key_spans(text, front[1])
        if content_type == "markdown":
            spans += [*inline_spans(text), *_whole(text, fenced_numbers(text)), *_whole(text, indented_numbers(text))]
        if blockquotes:
            spans += _whole(text, quoted_numbers(text))
        if "lang" in text:
            spans += foreign_spans(text)
    elif content_type == "yaml":
        spans += _key_spans(text)
    return L.joined([s for s in spans if s[0] < s[1]])


def _typed(content_type: str) -> str:
    if content_type not in TYPES:
        raise ValueError(f"content types are {', '.join(TYPES)}")
    return content_type


def with_mask(docs: DataFrame, content_type: str = "markdown", blockquotes: bool = False, extra: str | None = None, name: str = "mask") -> DataFrame:
    """``docs`` with a column of merged spans; ``extra`` names a column of spans that the caller adds, held to the text."""
    _typed(content_type)
    kind = "array<struct<start:int,end:int>>"

    def of(text: str, more: list[dict] | None = None) -> list[dict]:
        own = [(max(0, s["start"]), min(len(text), s["end"])) for s in more or [] if s and s["start"] is not None and s["end"] is not None]
        return [{"start": a, "end": b} for a, b in L.joined([*mask_of(text, content_type, blockquotes), *((a, b) for a, b in own if a < b)])]

    return docs.withColumn(name, K.column(of, kind, "text", extra) if extra else K.column(of, kind, "text"))


def mask(docs: DataFrame, content_type: str = "markdown", blockquotes: bool = False) -> DataFrame:
    """The merged mask of plain text, ``markdown``, ``markdown-scan-code`` or ``yaml``: ``doc_id, start, end``."""
    _typed(content_type)
    return _spans(docs, lambda t: mask_of(t, content_type, blockquotes))


_TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_LANG = re.compile(r"""(?:^|\s)lang\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def foreign_spans(html: str) -> list[L.Span]:
    """Stretches whose nearest ``lang`` is not Chinese.

    Elements are kept on a stack.  Void elements hold no text, raw ones (scripts, styles) no tags; an empty ``lang``
    inherits; elements whose end tag may be left out end where the next one begins; a closing tag without its opening
    one is ignored; unclosed elements run to the end; beyond DEEPEST open elements no more are opened.
    """
    stack: list[tuple[str, bool]] = []
    out, begun, raw_until = [], None, 0
    for m in _TAG.finditer(html):
        name = (m[2] or "").lower()
        if not name or name in VOID or m.start() < raw_until:
            continue
        if not m[1]:
            for other in CLOSES.get(name, ["p"] if name in BLOCKS else []):
                if stack and stack[-1][0] == other:
                    stack.pop()
            value = _LANG.search(m[3])
            value = (value[1] or value[2] or value[3] or "").strip().lower() if value else ""
            foreign = re.split("[-_]", value)[0] not in CHINESE if value else bool(stack) and stack[-1][1]
            if not m[3].endswith("/") and len(stack) < DEEPEST:
                stack.append((name, foreign))
                if name in RAW:
                    end = re.compile(f"</{name}", re.I).search(html, m.end())
                    raw_until = end.start() if end else len(html)
        else:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                del stack[at:]
        now = bool(stack) and stack[-1][1]
        if now and begun is None:
            begun = m.end()
        elif not now and begun is not None:
            out.append((begun, m.start()))
            begun = None
    if begun is not None:
        out.append((begun, len(html)))
    return out


def foreign_scopes(pages: DataFrame) -> DataFrame:
    """``page_id, start, end`` of HTML whose nearest ``lang`` is not Chinese (``foreign_spans``)."""
    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where("page_id is not null")
    return K.found(some, foreign_spans, "start long, end long", key="page_id", inputs=("html",), where="(?i)lang")
