"""Queries of the pattern and rhetoric detectors, with SQL for an independent check."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import patterns as P
from glyphmill.operators import rhetoric as R
from glyphmill.plans import overlay
from glyphmill.plans.registry import _query


def _q(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _rows() -> str:
    rows = []
    for p in P.PATTERNS:
        new = p.replaced.replace("$", "\\")
        values = [p.detector, p.kind, p.severity, p.pattern, new, p.swap_from, p.swap_to, p.before, p.no_before, p.after, p.no_after, p.no_found, p.near]
        rows.append("(" + ", ".join(map(_q, values)) + f", {p.reach}, {p.casual_only}, {p.least})")
    return ", ".join(rows)


_LEFT = rf"(^|[^A-Za-z0-9{X.IDEOGRAPH}])"
_FORMAL = rf"(regexp_matches(text, '{_LEFT}({'|'.join(P.FORMAL)}|({'|'.join(P.FORMAL_ENDING)})([^{X.IDEOGRAPH}]|$))') OR regexp_matches(substr(text, 1, 100), '{_LEFT}{P.any_of(P.CONTRACTS)}'))"
_PATTERN_SQL = rf"""WITH {overlay.SQL}, f AS (SELECT *, {_FORMAL} AS formal FROM d),
p(detector, rule_type, severity, pattern, new, swap_from, swap_to, before, no_before, after, no_after, no_found, near, reach, casual_only, least) AS (VALUES {_rows()}),
m AS (SELECT f.doc_id, f.text, p.*, regexp_extract_all(f.text, p.pattern) AS found_all, string_split_regex(f.text, p.pattern) AS gaps FROM f JOIN p ON NOT (f.formal AND p.casual_only) WHERE regexp_matches(f.text, p.pattern)),
u AS (SELECT *, generate_subscripts(found_all, 1) AS i, unnest(found_all) AS found FROM m),
s AS (SELECT *, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found_all[1:i - 1], lambda g: length(g))), 0))::INTEGER AS pos FROM u),
w AS (SELECT *, substr(text, greatest(pos - reach, 0) + 1, least(pos, reach)) AS l, substr(text, pos + length(found) + 1, reach) AS r, substr(text, greatest(pos - 26, 0) + 1, pos + length(found) + 26 - greatest(pos - 26, 0)) AS around FROM s)
SELECT doc_id, detector, rule_type, severity, pos, found, CASE WHEN new <> '' THEN regexp_replace(found, pattern, new) WHEN swap_from <> '' THEN replace(found, swap_from, swap_to) END AS suggestion FROM w
WHERE length(found) >= least AND (before = '' OR regexp_matches(l, before)) AND (no_before = '' OR NOT regexp_matches(l, no_before)) AND (after = '' OR regexp_matches(r, after)) AND (no_after = '' OR NOT regexp_matches(r, no_after)) AND (no_found = '' OR NOT regexp_matches(found, no_found)) AND (near = '' OR regexp_matches(around, near))"""

_PARAGRAPHS = overlay.SQL + r", q AS (SELECT doc_id, string_split_regex(text, '\n[ \t\r]*\n') AS p FROM d), g AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS paragraph, unnest(p) AS body FROM q)"
_LINES = overlay.SQL + ", q AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM d), l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line_no, unnest(p) AS line FROM q)"
_SENTENCES = overlay.SQL + r", q AS (SELECT doc_id, regexp_extract_all(text, '[^。！？；\n]+[。！？；]?') AS p FROM d), s AS (SELECT * FROM (SELECT doc_id, generate_subscripts(p, 1) - 1 AS n, unnest(p) AS sentence FROM q) WHERE trim(sentence) <> '')"


def _docs(spark, sf_dir):
    return overlay.documents(spark, sf_dir)


@_query(_PATTERN_SQL)
def pattern_findings(spark, sf_dir):
    return P.findings(_docs(spark, sf_dir))


@_query(f"WITH {overlay.SQL} SELECT doc_id, {_FORMAL} AS formal FROM d")
def formal_register(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", P.formal(F.col("text")).alias("formal"))


@_query(
    f"""WITH {overlay.SQL}, m AS (SELECT doc_id, regexp_extract_all(text, '{P.any_of(P.FALSE_FRIENDS)}') AS f, string_split_regex(text, '{P.any_of(P.FALSE_FRIENDS)}') AS g FROM d WHERE regexp_matches(text, '{P.any_of(P.FALSE_FRIENDS)}')), u AS (SELECT *, generate_subscripts(f, 1) AS i, unnest(f) AS found FROM m),
h AS (SELECT doc_id, found, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS pos, length(regexp_replace(array_to_string(g[1:i], ''), '[^，,。；\\n]', '', 'g')) AS clause FROM u),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, clause) AS n FROM h) SELECT doc_id, pos, found FROM c WHERE n >= 2"""
)
def false_friends(spark, sf_dir):
    return P.false_friends(_docs(spark, sf_dir))


@_query(
    f"WITH {overlay.SQL}, t(phrase, threshold) AS (VALUES {', '.join(f'({_q(p)}, {t})' for p, t in R.TRACKED)}), n AS (SELECT doc_id, phrase, text, threshold, (length(text) - length(replace(text, phrase, ''))) // length(phrase) AS n FROM d, t) SELECT doc_id, phrase, n, instr(text, phrase) - 1 AS pos FROM n WHERE n > 0 AND length(text) >= 500 AND 1000.0::DOUBLE * n / length(text) > threshold"
)
def tracked_density(spark, sf_dir):
    return R.tracked_density(_docs(spark, sf_dir))


@_query(rf"WITH {_PARAGRAPHS}, b AS (SELECT doc_id, trim(body) AS body FROM g WHERE trim(body) <> '') SELECT doc_id, count(*) FILTER (regexp_matches(right(body, 30), '{R._any(R.ENDINGS)}')) AS n_endings FROM b GROUP BY doc_id HAVING count(*) >= 5 AND count(*) FILTER (regexp_matches(right(body, 30), '{R._any(R.ENDINGS)}')) >= 3")
def paragraph_endings(spark, sf_dir):
    return R.paragraph_endings(_docs(spark, sf_dir))


@_query(rf"WITH {_LINES} SELECT doc_id, count(*) AS n_headings FROM l WHERE regexp_matches(line, '^#{{1,6}}[ \t]') AND regexp_matches(line, '{R._any(R.HEADINGS)}') GROUP BY doc_id HAVING count(*) >= 2")
def formulaic_headings(spark, sf_dir):
    return R.formulaic_headings(_docs(spark, sf_dir))


@_query(f"WITH {_PARAGRAPHS}, c AS (SELECT doc_id, count(*) AS n_paragraphs, count(*) FILTER (regexp_matches(body, '{R.ANY_ITEM}')) AS n_lists FROM g WHERE trim(body) <> '' GROUP BY doc_id) SELECT doc_id, n_lists, n_paragraphs FROM c WHERE n_paragraphs >= 5 AND n_lists >= 3 AND n_lists > 0.4 * n_paragraphs")
def list_density(spark, sf_dir):
    return R.list_density(_docs(spark, sf_dir))


# Continuation lines are taken out first; then a run is broken by any line that isn't polite.
@_query(
    rf"""WITH {_LINES}, k AS (SELECT doc_id, line_no, regexp_matches(line, '^[ \t]*([-*+][ \t]|[0-9]+[.)][ \t])') AS item, regexp_matches(line, '^[ \t]*([-*+][ \t]|[0-9]+[.)][ \t])[ \t]*請') AS polite, regexp_matches(line, '^[ \t]') AND trim(line, ' ' || chr(9) || chr(13)) <> '' AS deep FROM l),
m AS (SELECT doc_id, line_no, polite, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM k WHERE item OR NOT deep), i AS (SELECT doc_id, line_no, r - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM m WHERE polite)
SELECT doc_id, min(line_no) AS first, count(*) AS n_lines FROM i GROUP BY doc_id, island HAVING count(*) >= 3"""
)
def stacked_politeness(spark, sf_dir):
    return R.stacked_politeness(_docs(spark, sf_dir))


@_query(
    rf"""WITH {_LINES}, m AS (SELECT doc_id, line_no, regexp_extract(line, '^[ \t]*(?:[-*] |[0-9]+[.)][ \t])[ \t]*(.*)$', 1) AS body FROM l WHERE regexp_matches(line, '^[ \t]*([-*] |[0-9]+[.)][ \t])')), i AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM m)
SELECT doc_id, min(line_no) AS first, count(*) AS n_lines, CASE WHEN bool_and(regexp_matches(body, '^\*\*[^*]{{4}}\*\*\s*[：:]')) THEN 'four_character_labels' ELSE 'bold_items' END AS kind FROM i GROUP BY doc_id, island HAVING count(*) >= 3 AND bool_and(starts_with(body, '**'))"""
)
def mechanical_bullets(spark, sf_dir):
    return R.mechanical_bullets(_docs(spark, sf_dir))


@_query(f"WITH {_PARAGRAPHS} SELECT doc_id, paragraph, (length(body) - length(replace(body, '——', ''))) // 2 AS n FROM g WHERE length(body) - length(replace(body, '——', '')) >= 4")
def double_dashes(spark, sf_dir):
    return R.double_dashes(_docs(spark, sf_dir))


@_query(f"WITH {_PARAGRAPHS}, n AS (SELECT *, (length(body) - length(replace(body, '之一', ''))) // 2 AS n FROM g) SELECT doc_id, paragraph, n FROM n WHERE length(body) >= 100 AND n >= 2 AND 200.0 * n / length(body) >= 2")
def one_of_density(spark, sf_dir):
    return R.one_of_density(_docs(spark, sf_dir))


@_query(
    f"""WITH {_SENTENCES}, z AS (SELECT doc_id, n, list_transform(string_split(regexp_replace(sentence, '[。！？；]$', ''), '、'), lambda x: length(x)) AS z FROM s), e AS (SELECT doc_id, n, generate_subscripts(z, 1) AS i, z FROM z),
h AS (SELECT doc_id, n, i, z[i] AS size FROM e WHERE i + 2 <= len(z) AND z[i] = z[i + 1] AND z[i] = z[i + 2] AND z[i] BETWEEN 1 AND 8) SELECT doc_id, n, arg_min(size, i) AS size FROM h GROUP BY doc_id, n"""
)
def tricolons(spark, sf_dir):
    return R.tricolons(_docs(spark, sf_dir))


@_query(f"WITH {_SENTENCES} SELECT doc_id, n, CASE WHEN regexp_matches(sentence, '{R._any(R.DEFINITION)}') THEN '表示' WHEN regexp_matches(sentence, '{R._any(R.CONSEQUENCE)}') THEN '代表' WHEN regexp_matches(sentence, '{R._any(R.EXPLANATION)}') THEN '也就是說' END AS suggestion FROM s WHERE contains(sentence, '意味著')")
def meaning_verbs(spark, sf_dir):
    return R.meaning_verbs(_docs(spark, sf_dir))


@_query(
    f"""WITH {_SENTENCES} SELECT doc_id, n, 'abstract_subject' AS detector FROM s WHERE regexp_matches(substr(sentence, 1, 20), '{R._any(R.ABSTRACT_NOUNS)}') AND regexp_matches(sentence, '{R._any(R.ABSTRACT_VERBS)}')
UNION ALL SELECT doc_id, n, 'displaced_condition' FROM s WHERE length(sentence) >= 6 AND regexp_matches(substr(sentence, length(sentence) // 2 + 1), '如果|假如|若')
UNION ALL SELECT doc_id, n, 'tense_marks' FROM s WHERE regexp_matches(sentence, '[0-9][年月日]') AND length(sentence) - length(translate(sentence, '曾已過了', '')) >= 3"""
)
def translated_sentences(spark, sf_dir):
    return R.translated_sentences(_docs(spark, sf_dir))


@_query(
    rf"""WITH {_SENTENCES}, c AS (SELECT doc_id, n, length(regexp_replace(sentence, '[^{X.IDEOGRAPH}]', '', 'g')) AS ideographs, list_max(list_transform(string_split_regex(sentence, '[{R.PAUSES}]'), lambda x: length(regexp_replace(x, '[^{X.IDEOGRAPH}]', '', 'g')))) AS longest FROM s)
SELECT doc_id, n, ideographs, longest FROM c WHERE ideographs > 30 AND longest >= 15"""
)
def long_sentences(spark, sf_dir):
    return R.long_sentences(_docs(spark, sf_dir))


@_query(
    rf"""WITH {_PARAGRAPHS}, r AS (SELECT doc_id, paragraph, regexp_extract_all(body, '[^。！？；\n]+[。！？；]?') AS p FROM g), s AS (SELECT * FROM (SELECT doc_id, paragraph, generate_subscripts(p, 1) - 1 AS n, unnest(p) AS sentence FROM r) WHERE trim(sentence) <> ''),
e AS (SELECT doc_id, paragraph, n, regexp_extract(sentence, '([的了呢])[\s。！？；」』）]*$', 1) AS particle FROM s), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, paragraph ORDER BY n) - row_number() OVER (PARTITION BY doc_id, paragraph, particle ORDER BY n) AS island FROM e)
SELECT doc_id, paragraph, particle, min(n) AS first, count(*) AS n_sentences FROM i WHERE particle <> '' GROUP BY doc_id, paragraph, particle, island HAVING count(*) >= 3"""
)
def monotone_endings(spark, sf_dir):
    return R.monotone_endings(_docs(spark, sf_dir))


@_query(rf"WITH {overlay.SQL}, c AS (SELECT doc_id, length(regexp_replace(text, '[^\x{{4E00}}-\x{{9FFF}}]', '', 'g')) AS n, length(text) - length(regexp_replace(text, '{R._any(R.ORAL)}', '', 'g')) AS spoken FROM d) SELECT doc_id, CASE WHEN n >= 20 THEN spoken::DOUBLE / n END AS density FROM c")
def oral_density(spark, sf_dir):
    return R.oral_density(_docs(spark, sf_dir))


@_query(f"WITH {_SENTENCES}, c AS (SELECT doc_id, length(trim(sentence)) AS size FROM s WHERE length(trim(sentence)) >= 4) SELECT doc_id, count(*) AS n_sentences, round(stddev_pop(size), 9) AS sigma FROM c GROUP BY doc_id HAVING count(*) >= 10")
def sentence_variability(spark, sf_dir):
    return R.sentence_variability(_docs(spark, sf_dir)).withColumn("sigma", F.round("sigma", 9))
