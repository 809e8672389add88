"""Conflicts between findings, marks in pairs, spaces and the case of Latin terms."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import kernels as K
from glyphmill.functions import text as X
from glyphmill.sources import sinks

_FULL = "，。！？；：、（）「」『』《》"


def resolved(issues: DataFrame) -> DataFrame:
    """Issues that are left when longer ones win over those they overlap, then graver, then earlier ones."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    row = F.struct((-F.length("found")).alias("_size"), rank.alias("_rank"), "pos", *[F.col(c) for c in issues.columns if c not in ("doc_id", "pos")])
    grouped = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("all"))

    def kept(sizes: list[int], places: list[int]) -> list[int]:
        """Numbers of the rows that stay, of rows in the order of precedence."""
        taken: list[tuple[int, int]] = []  # disjoint, by start
        out = []
        for i, (size, pos) in enumerate(zip(sizes, places)):
            a, b = pos, pos - size
            k = bisect_left(taken, (a, a))
            # Empty spans clash only with what they lie strictly inside of.
            clash = k > 0 and a < taken[k - 1][1]
            j = k
            while not clash and j < len(taken) and taken[j][0] < b:
                clash = a < taken[j][1]
                j += 1
            if not clash:
                taken.insert(k, (a, b))
                out.append(i)
        return out

    stay = K.column(kept, "array<int>", F.transform("all", lambda x: x["_size"]), F.transform("all", lambda x: x["pos"]))
    left = grouped.withColumn("_stay", stay).select("doc_id", F.explode(F.transform("_stay", lambda i: F.get(F.col("all"), i))).alias("x"))
    return left.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"x.{c}") for c in issues.columns])


def _bracket_problems(text: str) -> list[tuple[int, str, str]]:
    out, stack = [], []
    for m in _BRACKETS.finditer(text):
        sign, pos = m[0], m.start()
        if sign.startswith("\n"):
            out += [(p, s, "unclosed") for p, s in stack]
            stack = []
        elif sign in "「『《":
            stack.append((pos, sign))
        elif not stack:
            out.append((pos, sign, "unmatched"))
        elif stack[-1][1] != "「『《"["」』》".index(sign)]:
            out.append((pos, sign, "interleaved"))
        else:
            stack.pop()
            if sign == "』" and all(s != "「" for _, s in stack):
                out.append((pos, sign, "outermost"))
    return out + [(p, s, "unclosed") for p, s in stack]


_BRACKETS = re.compile(r"[「」『』《》]|\n[ \t\r]*\n")


def bracket_problems(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, found, problem`` (unclosed, unmatched, interleaved, outermost) of brackets, paragraph by paragraph."""
    return K.found(docs, _bracket_problems, "pos int, found string, problem string", where="[「」『』《》]")


def unwanted_spaces(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, size`` of spaces between a full-width mark and an ideograph, ASCII letter or digit."""
    word = f"A-Za-z0-9{X.IDEOGRAPH}"
    pattern = f"(?<=[{word}]) +(?=[{_FULL}])|(?<=[{_FULL}]) +(?=[{word}])"
    return docs.where(F.col("text").rlike(pattern)).select("doc_id", F.explode(X.spans(F.col("text"), pattern)).alias("s")).select("doc_id", F.col("s.start").alias("pos"), F.length("s.found").alias("size"))


def case_issues(docs: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """``doc_id, pos, found, suggestion``: ``terms`` (term: other right forms) in other case, not inside Latin words."""
    import re

    ordered = sorted(terms, key=len, reverse=True)
    pattern = "(?i)(" + "|".join(re.escape(t) for t in ordered) + ")"
    hits = docs.where(F.col("text").rlike(pattern)).select("doc_id", "text", F.explode(X.spans(F.col("text"), pattern)).alias("s"))
    beside = F.concat(F.when(F.col("s.start") > 0, F.expr("substring(text, s.start, 1)")).otherwise(""), F.lit(" "), F.expr("substring(text, s.end + 1, 1)"))
    canon = F.element_at(F.create_map(*[F.lit(x) for t in ordered for x in (t.lower(), t)]), F.lower("s.found"))
    right = [f for t, more in terms.items() for f in (t, *more)]
    return hits.where(~beside.rlike("[A-Za-z]") & ~F.col("s.found").isin(right)).select("doc_id", F.col("s.start").alias("pos"), F.col("s.found").alias("found"), canon.alias("suggestion"))


def nfc(text: Column | str) -> Column:
    """Canonical composition; texts of ASCII alone, which are composed, never leave the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(r"[^\x00-\x7F]"), K.column(lambda t: unicodedata.normalize("NFC", t), "string", text)).otherwise(text)


def compact_lines(issues: DataFrame) -> DataFrame:
    """``doc_id, report``: one line for each group of equal findings of a document, with all its places."""
    groups = issues.groupBy("doc_id", "found", "rule_type", "severity", sinks.shown().alias("shown")).agg(F.array_sort(F.collect_list(F.struct("line", "col"))).alias("at"))
    place = lambda p: F.concat(p["line"].cast("string"), F.lit(":"), p["col"].cast("string"))
    first = F.concat_ws(":", place(F.get("at", F.lit(0))), F.upper(F.substring("severity", 1, 1)), "rule_type", F.concat("found", F.lit("→"), "shown"))
    more = F.when(F.size("at") > 1, F.concat(F.lit(" (×"), F.size("at").cast("string"), F.lit(" also at "), F.array_join(F.transform(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(1))), place), ","), F.lit(")"))).otherwise("")
    return groups.select("doc_id", F.concat(first, more).alias("report"))


def tabular(issues: DataFrame) -> DataFrame:
    """``doc_id, row``: tab-separated findings, with tabs, line ends and backslashes escaped."""
    cells = [F.col("line").cast("string"), F.col("col").cast("string"), "severity", "rule_type", sinks.escaped(F.col("found")), sinks.escaped(F.array_join("suggestions", "/"))]
    return issues.select("doc_id", F.concat_ws("\t", *cells).alias("row"))


def unreported(issues: DataFrame, before: DataFrame) -> DataFrame:
    """``doc_id, digest`` of documents whose findings differ from what ``before(doc_id, digest)`` tells was reported last."""
    now = digests(issues)
    return now.join(before.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")


def digests(issues: DataFrame) -> DataFrame:
    """``doc_id, digest`` of a document's findings, whatever their order: equal digests need no second report."""
    keys = F.array_sort(F.collect_list(F.concat_ws("|", F.col("pos").cast("string"), "rule_type", "found")))
    return issues.groupBy("doc_id").agg(F.sha2(F.array_join(keys, ",").cast("binary"), 256).alias("digest"))
