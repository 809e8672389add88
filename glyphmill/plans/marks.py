"""Queries of masks, paired marks, spaces, Latin case and reports, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import masks as M
from glyphmill.operators import quotes as Q
from glyphmill.operators import spans as P
from glyphmill.plans import overlay
from glyphmill.plans.detectors import _LINES
from glyphmill.plans.registry import _CHARS, _HITS, _QUERIES, _issues, _query, beside_sql


def _unchecked(f):
    """A query that SQL can't express; tests hold it against brute force."""
    _QUERIES[f.__name__] = f
    return f


def _spans_sql(name: str, pattern: str) -> str:
    return f"""{name}_m AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS f, string_split_regex(text, '{pattern}') AS g FROM d), {name}_u AS (SELECT *, generate_subscripts(f, 1) AS i, unnest(f) AS found FROM {name}_m),
{name} AS (SELECT doc_id, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::INTEGER AS a, found FROM {name}_u)"""


def _docs(spark, sf_dir):
    return overlay.documents(spark, sf_dir)


@_query(f"WITH {overlay.SQL}, {_spans_sql('u', M.URL)} SELECT doc_id, a AS start_at, a + length(found) AS end_at FROM u")
def url_mask(spark, sf_dir):
    return M.urls(_docs(spark, sf_dir)).toDF("doc_id", "start_at", "end_at")


@_query(f"WITH {overlay.SQL}, {_spans_sql('u', M.URL)}, {_spans_sql('p', M.PATH)} SELECT doc_id, a AS start_at, a + length(found) AS end_at FROM p WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = p.doc_id AND p.a < u.a + length(u.found) AND p.a + length(p.found) > u.a AND NOT (p.a <= u.a AND p.a + length(p.found) >= u.a + length(u.found)))")
def path_mask(spark, sf_dir):
    return M.paths(_docs(spark, sf_dir)).toDF("doc_id", "start_at", "end_at")


@_query(f"WITH {overlay.SQL}, {_spans_sql('u', M.NAMED)} SELECT doc_id, a + 1 AS start_at, a + 1 + length(regexp_extract(found, '^[「『]({M.TERM})[」』]', 1)) AS end_at FROM u")
def named_term_mask(spark, sf_dir):
    return M.named_terms(_docs(spark, sf_dir)).toDF("doc_id", "start_at", "end_at")


def _comment(words: list[str]) -> str:
    return rf"regexp_matches(trim(line), '(<!--|(^|[^A-Za-z0-9:/])//)\s*{M.PREFIX}:({'|'.join(words)})($|[^A-Za-z0-9_\-])')"


@_query(
    f"""WITH {_LINES}, k AS (SELECT doc_id, line_no, CASE WHEN {_comment(M.NEXT)} THEN 'next' WHEN {_comment(M.START)} THEN 'start' WHEN {_comment(M.LINE)} THEN 'line' WHEN {_comment(M.END)} THEN 'end' END AS kind FROM l),
o AS (SELECT *, coalesce((SELECT arg_max(b.kind, b.line_no) FROM k b WHERE b.doc_id = k.doc_id AND b.line_no < k.line_no AND b.kind IN ('start', 'end')) = 'start', false) AS open FROM k)
SELECT doc_id, line_no FROM o WHERE open OR kind IN ('start', 'line') OR EXISTS (SELECT 1 FROM o p WHERE p.doc_id = o.doc_id AND p.line_no = o.line_no - 1 AND p.kind = 'next' AND NOT p.open)"""
)
def suppressed_lines(spark, sf_dir):
    return M.suppressed_lines(_docs(spark, sf_dir))


@_query(rf"WITH {_LINES}, f AS (SELECT l.doc_id, line_no, row_number() OVER (PARTITION BY l.doc_id ORDER BY line_no) AS k, count(*) OVER (PARTITION BY l.doc_id) AS n FROM l JOIN d ON d.doc_id = l.doc_id WHERE regexp_matches(d.text, '^---[ \t\r]*\n') AND regexp_matches(line, '^---[ \t\r]*$')) SELECT doc_id, line_no FROM f WHERE k <= 2 AND n >= 2")
def front_matter_lines(spark, sf_dir):
    return M.front_matter_lines(_docs(spark, sf_dir))


@_query(f"WITH {_LINES} SELECT doc_id, line_no FROM l WHERE starts_with(ltrim(line), ':::')")
def container_lines(spark, sf_dir):
    return M.container_lines(_docs(spark, sf_dir))


@_query(rf"WITH {_LINES}, k AS (SELECT doc_id, line_no, length(regexp_extract(line, '^[ \t]*(- )?[A-Za-z0-9_.\-]+:')) AS size FROM l) SELECT doc_id, line_no, size FROM k WHERE size > 0")
def yaml_key_mask(spark, sf_dir):
    return M.yaml_keys(_docs(spark, sf_dir))


# Fences: a state that goes from line to line.
_FENCES = f"""{_LINES}, t AS (SELECT doc_id, line_no, line, CASE WHEN regexp_matches(line, '^ {{0,3}}```') THEN 'tick' WHEN regexp_matches(line, '^ {{0,3}}~~~') THEN 'wave' END AS sign FROM l),
g AS (SELECT doc_id, line_no, sign, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM t WHERE sign IS NOT NULL),
f AS (SELECT doc_id, k, line_no, sign AS open_after, true AS opens FROM g WHERE k = 1 UNION ALL
  SELECT g.doc_id, g.k, g.line_no, CASE WHEN f.open_after IS NULL THEN g.sign WHEN f.open_after = g.sign THEN NULL ELSE f.open_after END, f.open_after IS NULL FROM f JOIN g ON g.doc_id = f.doc_id AND g.k = f.k + 1),
inside AS (SELECT t.doc_id, t.line_no FROM t LEFT JOIN (SELECT doc_id, line_no, open_after, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY k), 1000000000) AS next_no FROM f) s ON s.doc_id = t.doc_id AND s.line_no <= t.line_no AND t.line_no < s.next_no WHERE t.sign IS NOT NULL OR s.open_after IS NOT NULL)"""


@_query(f"WITH RECURSIVE {_FENCES} SELECT doc_id, line_no FROM inside")
def fenced_lines(spark, sf_dir):
    return M.fenced_lines(_docs(spark, sf_dir))


@_query(
    rf"""WITH RECURSIVE {_FENCES} SELECT t.doc_id, t.line_no, length(regexp_extract(t.line, '^ {{0,3}}(#{{1,6}})[ \t]', 1)) AS level, trim(regexp_replace(regexp_replace(t.line, '^ {{0,3}}#{{1,6}}[ \t]', ''), '[ \t]+#+[ \t]*\r?$|\r$', '')) AS title
FROM t WHERE regexp_matches(t.line, '^ {{0,3}}#{{1,6}}[ \t]') AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.doc_id = t.doc_id AND i.line_no = t.line_no)"""
)
def heading_table(spark, sf_dir):
    return M.headings(_docs(spark, sf_dir)).select("doc_id", "line_no", "level", "title")


@_unchecked
def markdown_mask(spark, sf_dir):
    return M.mask(_docs(spark, sf_dir)).select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@_unchecked
def foreign_scopes(spark, sf_dir):
    return M.foreign_scopes(spark.read.parquet(f"{sf_dir}/pages.parquet")).toDF("page_id", "start_at", "end_at")


# Brackets: a stack that goes from sign to sign, as a list.
_SIGNS = rf"""{_spans_sql('u', r'[「」『』《》]|' + chr(92) + 'n[ ' + chr(92) + 't' + chr(92) + 'r]*' + chr(92) + 'n')}, e AS (SELECT doc_id, a AS pos, CASE WHEN starts_with(found, chr(10)) THEN 'P' ELSE found END AS sign FROM u UNION ALL SELECT doc_id, length(text), 'P' FROM d),
k AS (SELECT doc_id, pos, sign, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sign = 'P') AS k FROM e WHERE doc_id IN (SELECT doc_id FROM u WHERE NOT starts_with(found, chr(10))))"""
_STACK = r"""s AS (SELECT doc_id, 0::BIGINT AS k, []::STRUCT(p BIGINT, c VARCHAR)[] AS st, []::STRUCT(p BIGINT, c VARCHAR, x VARCHAR)[] AS told FROM k WHERE k = 1 UNION ALL
  SELECT k.doc_id, k.k,
    CASE WHEN k.sign = 'P' THEN [] WHEN k.sign IN ('「', '『', '《') THEN list_append(st, {'p': k.pos, 'c': k.sign}) WHEN len(st) > 0 AND st[-1].c = translate(k.sign, '」』》', '「『《') THEN st[1:len(st) - 1] ELSE st END,
    CASE WHEN k.sign = 'P' THEN list_transform(st, lambda q: {'p': q.p, 'c': q.c, 'x': 'unclosed'}) WHEN k.sign IN ('「', '『', '《') THEN [] WHEN len(st) = 0 THEN [{'p': k.pos, 'c': k.sign, 'x': 'unmatched'}] WHEN st[-1].c <> translate(k.sign, '」』》', '「『《') THEN [{'p': k.pos, 'c': k.sign, 'x': 'interleaved'}]
      WHEN k.sign = '』' AND len(list_filter(st[1:len(st) - 1], lambda q: q.c = '「')) = 0 THEN [{'p': k.pos, 'c': k.sign, 'x': 'outermost'}] ELSE [] END
  FROM s JOIN k ON k.doc_id = s.doc_id AND k.k = s.k + 1)"""


@_query(f"WITH RECURSIVE {overlay.SQL}, {_SIGNS}, {_STACK}, o AS (SELECT doc_id, unnest(told) AS t FROM s) SELECT doc_id, t.p AS pos, t.c AS found, t.x AS problem FROM o")
def bracket_problems(spark, sf_dir):
    return P.bracket_problems(_docs(spark, sf_dir))


# Findings and wider ones around them, in the order of precedence; each is held against those that were kept.
_KEPT = f"""{_HITS}, w AS (SELECT doc_id, pos, found, severity FROM issues UNION ALL SELECT doc_id, greatest(pos - 1, 0), found || '？', 'info' FROM issues),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(found) DESC, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, pos, found, severity) AS k FROM w),
s AS (SELECT doc_id, 0::BIGINT AS k, []::STRUCT(a BIGINT, b BIGINT)[] AS taken, false AS kept FROM k WHERE k = 1 UNION ALL
  SELECT k.doc_id, k.k, CASE WHEN len(list_filter(taken, lambda t: t.a < k.pos + length(k.found) AND k.pos < t.b)) = 0 THEN list_append(taken, {{'a': k.pos, 'b': k.pos + length(k.found)}}) ELSE taken END, len(list_filter(taken, lambda t: t.a < k.pos + length(k.found) AND k.pos < t.b)) = 0
  FROM s JOIN k ON k.doc_id = s.doc_id AND k.k = s.k + 1)"""


@_query(f"WITH RECURSIVE {_KEPT} SELECT k.doc_id, k.pos, k.found, k.severity FROM s JOIN k ON k.doc_id = s.doc_id AND k.k = s.k WHERE s.kept")
def resolved_overlaps(spark, sf_dir):
    found = _issues(spark, sf_dir).select("doc_id", "pos", "found", "severity")
    wider = found.select("doc_id", F.greatest(F.col("pos") - 1, F.lit(0)).alias("pos"), F.concat("found", F.lit("？")).alias("found"), F.lit("info").alias("severity"))
    return P.resolved(found.union(wider))


@_query(
    f"""WITH {_CHARS}, s AS (SELECT *, lag(ch) OVER w AS l, min(CASE WHEN ch <> ' ' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT s.doc_id, s.pos, s.stop - s.pos AS size FROM s JOIN c r ON r.doc_id = s.doc_id AND r.pos = s.stop WHERE s.ch = ' ' AND l <> ' ' AND ((regexp_matches(l, '^[A-Za-z0-9{X.IDEOGRAPH}]$') AND regexp_matches(r.ch, '^[{P._FULL}]$')) OR (regexp_matches(l, '^[{P._FULL}]$') AND regexp_matches(r.ch, '^[A-Za-z0-9{X.IDEOGRAPH}]$')))"""
)
def unwanted_spaces(spark, sf_dir):
    return P.unwanted_spaces(_docs(spark, sf_dir))


@_query(f"WITH {_CHARS}, {beside_sql(chr(39) + '.' + chr(39))} SELECT doc_id, pos, ch AS found, '。' AS suggestion FROM w WHERE l1 <> '.' AND NOT regexp_matches(r1, '^[.A-Za-z0-9]$') AND cl")
def half_width_stops(spark, sf_dir):
    return Q.marks(_docs(spark, sf_dir), Q.stops)


@_query(
    rf"""WITH {_CHARS}, k AS (SELECT c.doc_id, c.pos, row_number() OVER o AS j, lead(c.pos) OVER o AS next_pos FROM c WHERE ch = '，' WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT k.doc_id, j, length(regexp_replace(substr(text, pos + 2, next_pos - pos - 1), '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g')) BETWEEN 1 AND 4 AS short FROM k JOIN d ON d.doc_id = k.doc_id WHERE next_pos IS NOT NULL),
i AS (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS island FROM s WHERE short), r AS (SELECT doc_id, min(j) AS a, max(j) + 1 AS b FROM i GROUP BY doc_id, island HAVING count(*) >= 2)
SELECT k.doc_id, k.pos, '，' AS found, '、' AS suggestion FROM k JOIN r ON r.doc_id = k.doc_id AND k.j BETWEEN r.a AND r.b"""
)
def enumeration_marks(spark, sf_dir):
    return Q.marks(_docs(spark, sf_dir), Q.enumerations)


#: Terms with their other right forms.
TERMS = {"GitHub": [], "JavaScript": ["JAVASCRIPT"], "API": ["api"], "GPU": []}


@_query(
    f"""WITH {overlay.SQL}, {_spans_sql('u', '(?i)(' + '|'.join(sorted(TERMS, key=len, reverse=True)) + ')')}, t(term, right_forms) AS (VALUES {', '.join(f"('{t}', {[t, *m]})" for t, m in TERMS.items())})
SELECT u.doc_id, a AS pos, found, term AS suggestion FROM u JOIN t ON lower(found) = lower(term) JOIN d ON d.doc_id = u.doc_id WHERE NOT list_contains(right_forms, found)
AND (a = 0 OR NOT regexp_matches(substr(text, a, 1), '^[A-Za-z]$')) AND NOT regexp_matches(substr(text, a + length(found) + 1, 1), '^[A-Za-z]$')"""
)
def case_issues(spark, sf_dir):
    return P.case_issues(_docs(spark, sf_dir), TERMS)


@_query(f"WITH {overlay.SQL} SELECT doc_id, nfc_normalize(text) AS text FROM d")
def composed_texts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", P.nfc("text").alias("text"))


@_query(
    f"""WITH {_HITS}, s AS (SELECT *, CASE WHEN len(suggestions) = 0 THEN coalesce(english, '?') WHEN suggestions = [''] THEN '(delete)' WHEN len(suggestions) = 1 THEN suggestions[1] ELSE suggestions[1] || '+' || (len(suggestions) - 1)::VARCHAR END AS shown FROM issues),
g AS (SELECT doc_id, found, rule_type, severity, shown, list(line || ':' || col ORDER BY line, col) AS places FROM s GROUP BY 1, 2, 3, 4, 5)
SELECT doc_id, places[1] || ':' || upper(substr(severity, 1, 1)) || ':' || rule_type || ':' || found || '→' || shown || CASE WHEN len(places) > 1 THEN ' (×' || len(places) || ' also at ' || array_to_string(places[2:], ',') || ')' ELSE '' END AS report FROM g"""
)
def compact_report(spark, sf_dir):
    return P.compact_lines(_issues(spark, sf_dir))


@_query(f"WITH {_HITS} SELECT doc_id, concat_ws(chr(9), line, col, severity, rule_type, found, array_to_string(suggestions, '/')) AS row FROM issues")
def tabular_report(spark, sf_dir):
    return P.tabular(_issues(spark, sf_dir))


@_query(f"WITH {_HITS}, k AS (SELECT doc_id, pos || '|' || rule_type || '|' || found AS k FROM issues) SELECT doc_id, sha256(string_agg(k, ',' ORDER BY k)) AS digest FROM k GROUP BY doc_id")
def report_digests(spark, sf_dir):
    return P.digests(_issues(spark, sf_dir))
