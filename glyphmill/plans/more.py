"""Queries of the rules' conditions, fixes, conversion, marks, rhetoric, scores, decisions and reports, with SQL.

The SQL is written from what an operator is to find, with other means than the operator's own.  Queries whose SQL would
need a state machine of its own have none; the tests hold them against brute force or worked examples.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill import api
from glyphmill.functions import kernels as K
from glyphmill.functions import text as X
from glyphmill.operators import characters as C
from glyphmill.operators import convert as CV
from glyphmill.operators import fixes as FX
from glyphmill.operators import judgement as J
from glyphmill.operators import lexical as L
from glyphmill.operators import masks as M
from glyphmill.operators import quotes as Q
from glyphmill.operators import rhetoric as R
from glyphmill.operators import scan as SN
from glyphmill.operators import scores as SC
from glyphmill.operators import segment as G
from glyphmill.operators import structure as S
from glyphmill.operators import style as ST
from glyphmill.plans import overlay, seed
from glyphmill.plans.detectors import _LINES, _PARAGRAPHS, _q
from glyphmill.plans.marks import _spans_sql, _unchecked
from glyphmill.plans.registry import _CHARS, _CLUE, _DELETES, _HITS, _ISSUES, _MARKS, _issues, _query, _raw, hits_sql
from glyphmill.sources import sinks, stores

WORDS = ["累積", "分佈"]


def _docs(spark, sf_dir):
    return overlay.documents(spark, sf_dir)


def _scanner(spark):
    return L.scanner(L.merged(seed.rules(spark)))


def _features(spark, sf_dir, **more):
    return L.issues(_docs(spark, sf_dir), seed.features(spark), words=set(WORDS), **more)


# ---- what a rule asks of a match's surroundings

_NULL = lambda v: "NULL" if v is None else _q(v)
_FEATURES = ", ".join(
    f"({r[1]}, {_q(r[2])}, {seed._list(r[3])}, {_q(r[4])}, {_NULL(r[5])}, {_q(r[6])}, {seed._list(r[8])}, {seed._list(r[9])}, {seed._list([x for x in [*r[11], *r[3]] if r[2] in x and x != r[2]])}, {seed._list(r[12])}, {_NULL(r[14])}, {_NULL(r[15])})" for r in seed.FEATURES
)
_FEATURE_RULES = f"rules AS (SELECT * FROM (VALUES {_FEATURES}) t(ord, term, target, type, english, severity, clues, negative_clues, forms, directed, guard, confidence) WHERE guard IS NULL)"
# A word that begins k characters before the match's start, or before its end and not behind its start.
_CROSSING = " AND ".join(
    [f"NOT (pos >= {k} AND substr(text, (pos - {k} + 1)::BIGINT, {len(w)}) = '{w}')" for w in WORDS for k in range(1, len(w))]
    + [f"NOT ({k} >= length(term) AND substr(text, (pos + length(term) - {k} + 1)::BIGINT, {len(w)}) = '{w}')" for w in WORDS for k in range(1, len(w))]
)
_AFTER, _BEFORE = "list_extract(string_split(substr(text, (pos + length(term) + 1)::BIGINT, 20), chr(10) || chr(10)), 1)", "list_extract(string_split(substr(text, greatest(pos - 20, 0)::BIGINT + 1, (pos - greatest(pos - 20, 0))::BIGINT), chr(10) || chr(10)), -1)"
_POSITIONAL = f"""len(list_filter(directed, lambda c: CASE split_part(c, ':', 1) WHEN 'before' THEN contains({_AFTER}, split_part(c, ':', 2)) WHEN 'after' THEN contains({_BEFORE}, split_part(c, ':', 2)) WHEN 'not_before' THEN NOT contains({_AFTER}, split_part(c, ':', 2))
  WHEN 'not_after' THEN NOT contains({_BEFORE}, split_part(c, ':', 2)) WHEN 'adjacent' THEN substr(text, (pos + length(term) + 1)::BIGINT, length(split_part(c, ':', 2))) = split_part(c, ':', 2) OR (pos >= length(split_part(c, ':', 2)) AND substr(text, (pos - length(split_part(c, ':', 2)) + 1)::BIGINT, length(split_part(c, ':', 2))) = split_part(c, ':', 2)) END)) = len(directed)"""
_COVERED = "len(list_filter(forms, lambda f: pos >= instr(f, term) - 1 AND substr(text, (pos - instr(f, term) + 2)::BIGINT, length(f)) = f)) > 0"
_SIMPLE = f"(type = 'variant' AND length(text) - length(translate(text, '{X.SIMPLIFIED_ONLY}', '')) > length(text) - length(translate(text, '{X.TRADITIONAL_ONLY}', '')))"
_FOUND = f"{overlay.SQL}, {hits_sql(_FEATURE_RULES)}, kept AS (SELECT * REPLACE (CASE WHEN term = '視頻' AND contains(l || term || r, '會議') THEN ['視訊'] ELSE target END AS target) FROM near WHERE NOT {_COVERED} AND {_CROSSING} AND {_POSITIONAL} AND NOT {_SIMPLE}), " + _ISSUES.replace("FROM near", "FROM kept").replace("english, clues,", "english, clues, confidence,")


def _feature_query(name: str, where: str, doc: str):
    @_query(f"WITH {_FOUND} SELECT doc_id, pos, found, array_to_string(suggestions, '/') AS suggestion FROM issues WHERE {where}")
    def query(spark, sf_dir):
        return _features(spark, sf_dir).where(where).select("doc_id", "pos", "found", F.array_join("suggestions", "/").alias("suggestion"))

    query.__doc__ = doc
    return query


def _named(name, query):
    """Registers a query under its own name (it was made in a loop)."""
    from glyphmill.plans import registry

    registry._QUERIES[name], registry._SQL[name] = query, registry._SQL["query"]
    del registry._QUERIES["query"], registry._SQL["query"]


for _name, _where, _doc in [
    ("absorbed_hits", "found IN ('程序', '數據')", "Exceptions and longer targets swallow a term inside them."),
    ("straddled_hits", "found = '積分'", "A match that a dictionary word crosses is none."),
    ("positional_hits", "found IN ('文件', '數據')", "Clues that have to stand before, behind or beside a match."),
    ("variant_hits", "rule_type = 'variant'", "Variants are none of a simplified text's."),
    ("tied_terms", "found IN ('文件夾', '文件')", "The longer of two terms at a place."),
]:
    _named(_name, _feature_query(_name, _where, _doc))


@_query(f"WITH {_FOUND} SELECT doc_id, pos, array_to_string(suggestions, '/') AS suggestion FROM issues WHERE found = '視頻'")
def chosen_suggestions(spark, sf_dir):
    return _features(spark, sf_dir).where("found = '視頻'").select("doc_id", "pos", F.array_join("suggestions", "/").alias("suggestion"))


@_query(f"WITH {_FOUND} SELECT doc_id, pos, size FROM issues WHERE found = '總而言之'")
def deletion_spans(spark, sf_dir):
    return _features(spark, sf_dir).where("found = '總而言之'").select("doc_id", "pos", "size")


@_query(f"WITH {_FOUND} SELECT doc_id, pos, found FROM issues WHERE rule_type NOT IN ('variant', 'ai_filler', 'translationese')")
def profile_issues(spark, sf_dir):
    return _features(spark, sf_dir, profile=L.BASE).select("doc_id", "pos", "found")


@_query("SELECT '研究顯示' AS term")
def guarded_phrases(spark, sf_dir):
    return spark.createDataFrame([(r.term,) for r in L.collected(seed.features(spark), guard="attribution")], "term string")


_CLUES = sorted({c for r in seed.ROWS for c in (*r[8], *r[9])})


@_query(f"WITH {overlay.SQL}, k(clue) AS (VALUES {', '.join(f'({_q(c)})' for c in _CLUES)}), p AS (SELECT d.doc_id, clue, string_split(d.text, clue) AS p FROM d JOIN k ON contains(d.text, clue)), u AS (SELECT doc_id, clue, generate_subscripts(p, 1) AS i, unnest(p) AS part, len(p) AS n FROM p), o AS (SELECT doc_id, clue, i, n, (sum(length(part)) OVER (PARTITION BY doc_id, clue ORDER BY i))::BIGINT + (i - 1) * length(clue) AS pos FROM u) SELECT doc_id, pos, clue FROM o WHERE i < n")
def clue_places(spark, sf_dir):
    return L.clue_index(_docs(spark, sf_dir), seed.rules(spark))


# Groups as text: clues and targets by commas, groups by semicolons.
_GROUPED = ", ".join(f"({_q(r[2])}, {seed._list(r[3])}, {_q(';'.join(','.join(a) + '>' + ','.join(b) for a, b in r[13]))})" for r in seed.FEATURES)


@_query(f"WITH r(term, target, grouped) AS (VALUES {_GROUPED}) SELECT term, 'replaced by itself' AS problem FROM r WHERE list_contains(target, term) UNION ALL SELECT term, 'malformed group' FROM r WHERE regexp_matches(grouped, '(^|;)>|>(;|$)|,,')")
def rule_problems(spark, sf_dir):
    return L.problems(seed.features(spark)).withColumnRenamed("from", "term")


# ---- order, duplicates, headings, limits

_RANK = "CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"


@_query(f"WITH {_HITS} SELECT doc_id, pos, found, row_number() OVER (PARTITION BY doc_id ORDER BY pos, length(found) DESC) AS place FROM issues")
def scan_order(spark, sf_dir):
    return J.scan_order(_issues(spark, sf_dir)).select("doc_id", "pos", "found", F.col("order").alias("place"))


@_query(f"WITH {_HITS} SELECT doc_id, pos, found, row_number() OVER (PARTITION BY doc_id ORDER BY pos, {_RANK}) AS place FROM issues")
def report_order(spark, sf_dir):
    return J.report_order(_issues(spark, sf_dir)).select("doc_id", "pos", "found", F.col("order").alias("place"))


@_query(f"WITH {_HITS}, p AS (SELECT doc_id, pos, found, rule_type, 'lexical' AS phase FROM issues UNION ALL SELECT doc_id, pos + 1, found, rule_type, 'indexed' FROM issues WHERE doc_id % 2 = 0) SELECT doc_id, pos, found, phase FROM p a WHERE NOT (phase = 'lexical' AND EXISTS (SELECT 1 FROM p b WHERE b.phase = 'indexed' AND b.doc_id = a.doc_id AND b.rule_type = a.rule_type AND b.pos < a.pos + length(a.found) AND a.pos < b.pos + length(b.found)))")
def phase_duplicates(spark, sf_dir):
    found = _issues(spark, sf_dir).select("doc_id", "pos", "found", F.col("rule_type").alias("phase_family"), F.lit("lexical").alias("phase_pass"))
    indexed = found.where("doc_id % 2 = 0").withColumns({"pos": F.col("pos") + 1, "phase_pass": F.lit("indexed")})
    return J.without_duplicates(found.union(indexed)).select("doc_id", "pos", "found", F.col("phase_pass").alias("phase"))


@_query(f"WITH {_HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, {_RANK}) AS k FROM issues) SELECT doc_id, string_agg(line || ':' || col || ' ' || found, '; ' ORDER BY k) FILTER (k <= 3) AS shown, greatest(count(*) - 3, 0) AS more FROM n GROUP BY doc_id")
def limited_reports(spark, sf_dir):
    return J.limited(_issues(spark, sf_dir))


_ONLY_LINES = _LINES[len(overlay.SQL) + 2 :]
_HEADS = r"h0 AS (SELECT doc_id, line_no, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS off FROM l), h AS (SELECT doc_id, off + length(regexp_extract(line, '^ {0,3}#{1,6}[ \t]+')) AS a, off + length(regexp_replace(regexp_replace(line, '\r$', ''), '[ \t]+#+[ \t]*$', '')) AS b FROM h0 WHERE regexp_matches(line, '^ {0,3}#{1,6}[ \t]'))"


@_query(f"WITH {_HITS}, {_ONLY_LINES}, {_HEADS} SELECT doc_id, pos, found, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.doc_id = i.doc_id AND i.pos >= h.a AND i.pos < h.b) THEN CASE WHEN severity = 'info' THEN 'warning' ELSE 'error' END ELSE severity END AS severity FROM issues i")
def heading_issues(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return J.raised_in(_issues(spark, sf_dir), M.headings(docs).select("doc_id", "start", "end")).select("doc_id", "pos", "found", "severity")


@_unchecked
def table_cells(spark, sf_dir):
    return J.cells(_docs(spark, sf_dir)).toDF("doc_id", "start_at", "end_at", "row_no", "cell")


@_unchecked
def cell_issues(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return J.in_cells(_issues(spark, sf_dir), J.cells(docs)).select("doc_id", "pos", "found", F.col("row").alias("row_no"), "cell")


@_unchecked
def section_starts(spark, sf_dir):
    return J.section_starts(_docs(spark, sf_dir))


# ---- masks

@_unchecked
def masked_scan(spark, sf_dir):
    return L.issues(M.with_mask(_docs(spark, sf_dir), "markdown"), _scanner(spark), mask="mask").select("doc_id", "pos", "found")


@_query(f"WITH {overlay.SQL} SELECT doc_id, 0 AS start_at, least(8, length(text)) AS end_at FROM d UNION ALL SELECT doc_id, 10, length(text) FROM d WHERE length(text) > 10")
def caller_mask(spark, sf_dir):
    given = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((-5, 3), (2, 8), (10, 2_000_000_000), (9, 9))])
    docs = _docs(spark, sf_dir).withColumn("given", given)
    return docs.select("doc_id", F.explode(L.clipped(F.col("given"), F.col("text"))).alias("s")).select("doc_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


_ELIGIBLE = "len(suggestions) = 1 AND len(clues) = 0"


@_query(f"WITH {_HITS}, f AS (SELECT doc_id, sum(length(suggestions[1]) - size) AS shift FROM issues WHERE {_ELIGIBLE} AND pos + size <= 6 GROUP BY doc_id) SELECT d.doc_id, 6 + coalesce(shift, 0) AS new_start, 12 + coalesce(shift, 0) AS new_end FROM d LEFT JOIN f ON f.doc_id = d.doc_id")
def moved_masks(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("given", F.array(F.struct(F.lit(6).alias("start"), F.lit(12).alias("end"))))
    return FX.masks_after(docs, _scanner(spark), "given").select("doc_id", "new_start", "new_end")


@_query(f"WITH {_HITS} SELECT doc_id, pos, length(found) AS size, found FROM issues")
def composed_issues(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return CV.composed_issues(docs, L.Scanner([r._replace(to=[t or "x" for t in r.to]) for r in L.collected(L.merged(seed.rules(spark)))])).select("doc_id", "pos", "size", F.col("own").alias("found"))


# ---- fixes and conversion

@_query(f"WITH {_FOUND} SELECT doc_id, pos, found, CASE WHEN rule_type <> 'variant' AND len(clues) > 0 THEN 'skip' WHEN rule_type <> 'variant' AND confidence = 'low' THEN 'decline' WHEN len(suggestions) = 1 THEN 'apply' WHEN len(suggestions) > 1 THEN 'decline' ELSE 'skip' END AS verdict FROM issues")
def fix_verdicts(spark, sf_dir):
    return FX.verdicts(_docs(spark, sf_dir), L.scanner(seed.features(spark), words=set(WORDS)), "lexical_safe")


@_query(f"WITH {_HITS} SELECT DISTINCT doc_id FROM issues WHERE doc_id % 2 = 1 OR found = '信息'")
def unreported_documents(spark, sf_dir):
    """Reported before: the even documents, without one of the terms."""
    from glyphmill.operators import spans

    found = _issues(spark, sf_dir)
    return spans.unreported(found, spans.digests(found.where("doc_id % 2 = 0 and found <> '信息'"))).select("doc_id")


@_query(f"WITH {_HITS} SELECT doc_id, pos, CASE WHEN found = '軟件' THEN 'info' ELSE severity END AS severity FROM issues")
def memory_and_glossary(spark, sf_dir):
    """Kept terms are info, but not one that the glossary bans."""
    from glyphmill.operators import decisions as D

    memory = spark.createDataFrame([("軟件", "軟件", "2024-01-01"), ("視頻", "視頻", "2024-01-01")], "found string, user_chose string, timestamp string")
    banned = spark.createDataFrame([("視頻",)], "term string")
    return D.with_memory(_issues(spark, sf_dir), memory, banned).select("doc_id", "pos", "severity")


_NEW = f"""{_HITS}, e AS (SELECT doc_id, pos, size, suggestions[1] AS new FROM issues WHERE {_ELIGIBLE}),
w AS (SELECT doc_id, pos + coalesce(sum(length(new) - size) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, new FROM e),
ends AS (SELECT d.doc_id, d.text, e.pos, e.size, e.new, coalesce(lag(e.pos + e.size) OVER (PARTITION BY d.doc_id ORDER BY e.pos), 0) AS begin_at FROM d LEFT JOIN e ON d.doc_id = e.doc_id),
fixed AS (SELECT doc_id, coalesce(string_agg(substr(text, begin_at + 1, pos - begin_at) || new, '' ORDER BY pos), '') || substr(any_value(text), coalesce(max(pos + size), 0) + 1) AS text FROM ends GROUP BY doc_id),
old AS (SELECT i.doc_id, i.found, i.pos AS old_pos, i.pos + coalesce((SELECT sum(length(e.new) - e.size) FROM e WHERE e.doc_id = i.doc_id AND e.pos < i.pos), 0) AS moved FROM issues i),
again AS (SELECT * FROM (WITH d AS (SELECT doc_id, text FROM fixed), {hits_sql(seed.SQL)}, {_ISSUES} SELECT doc_id, pos, size, found, severity FROM issues) q)"""


@_query(f"WITH {_NEW} SELECT n.doc_id, n.pos, n.found, n.severity, old.old_pos FROM again n LEFT JOIN old ON old.doc_id = n.doc_id AND old.found = n.found AND old.moved = n.pos WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = n.doc_id AND CASE WHEN length(w.new) = 0 THEN n.pos <= w.a AND n.pos + n.size > w.a ELSE n.pos < w.a + length(w.new) AND n.pos + n.size > w.a END)")
def rescanned_issues(spark, sf_dir):
    return FX.rescanned(_docs(spark, sf_dir), _scanner(spark)).select("doc_id", "pos", "found", "severity", "old_pos")


@_query(f"WITH {_HITS}, e AS (SELECT doc_id, pos, byte_offset, substr(text, pos + 1, size) AS old, suggestions[1] AS new FROM issues WHERE {_ELIGIBLE}) SELECT doc_id, '#patches=' || count(*) || chr(10) || 'offset' || chr(9) || 'length' || chr(9) || 'found' || chr(9) || 'replacement' || chr(10) || string_agg(byte_offset || chr(9) || strlen(old) || chr(9) || old || chr(9) || new, chr(10) ORDER BY pos DESC) || chr(10) AS patch FROM e GROUP BY doc_id")
def fix_patches(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return sinks.patches(FX.fixed(docs, _scanner(spark)), docs)


@_query(f"WITH {_HITS}, e AS (SELECT doc_id, pos, substr(text, pos + 1, size) AS old, suggestions[1] AS new FROM issues WHERE {_ELIGIBLE}) SELECT doc_id, string_agg('<<<<<<< SEARCH' || chr(10) || old || chr(10) || '======= REPLACE' || chr(10) || new || chr(10) || '>>>>>>> END' || chr(10), '' ORDER BY pos) AS diff FROM e GROUP BY doc_id")
def fix_blocks(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return sinks.search_replace(FX.fixed(docs, _scanner(spark)), docs)


_PLACEHOLD, _RESTORE, _PHRASED = "text", None, None
for _i, (_k, _v) in enumerate(sorted(CV.PHRASES.items(), key=lambda kv: -len(kv[0]))):
    _PLACEHOLD = f"replace({_PLACEHOLD}, '{_k}', chr({0xE000 + _i}))"
_ONE = {k: v for k, v in zip(X.SIMPLIFIED_ONLY, X.TRADITIONAL_ONLY) if k not in CV.AMBIGUOUS}
_RESTORE = f"translate(translate({_PLACEHOLD}, '{''.join(_ONE)}', '{''.join(_ONE.values())}'), '{''.join(CV.VARIANTS)}', '{''.join(CV.VARIANTS.values())}')"
_PHRASED = _PLACEHOLD
for _i, (_k, _v) in enumerate(sorted(CV.PHRASES.items(), key=lambda kv: -len(kv[0]))):
    _out = "".join(CV.VARIANTS.get(c, c) for c in _v)
    _RESTORE, _PHRASED = f"replace({_RESTORE}, chr({0xE000 + _i}), '{_out}')", f"replace({_PHRASED}, chr({0xE000 + _i}), '{_out}')"


@_query(f"WITH {overlay.SQL} SELECT doc_id, {_PHRASED} AS text FROM d")
def convert_phrases(spark, sf_dir):
    entries = CV.dictionary(CV.sample(spark)).where("kind = 'phrase'")
    return _docs(spark, sf_dir).select("doc_id", CV.converted("text", CV.Converter.of(entries)).alias("text"))


@_query(f"WITH {overlay.SQL} SELECT doc_id, {_RESTORE} AS text FROM d")
def convert_variants(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", CV.converted("text", CV.Converter.of(CV.dictionary(CV.sample(spark)))).alias("text"))


_ENTRIES = [("phrase", k, v) for k, v in CV.PHRASES.items()] + [("character", k, v) for k, v in zip(X.SIMPLIFIED_ONLY, X.TRADITIONAL_ONLY)] + [("variant", k, v) for k, v in CV.VARIANTS.items()]


@_query(
    f"WITH e(kind, key, value, ord) AS (VALUES {', '.join(f'({_q(a)}, {_q(b)}, {_q(c)}, {i})' for i, (a, b, c) in enumerate(_ENTRIES))}), f AS (SELECT kind, key, arg_min(value, ord) AS value FROM e GROUP BY 1, 2) SELECT kind, key, CASE WHEN kind = 'variant' THEN value ELSE translate(value, '{''.join(CV.VARIANTS)}', '{''.join(CV.VARIANTS.values())}') END AS value FROM f WHERE NOT (key = value AND NOT (kind = 'phrase' AND regexp_matches(key, '[{CV.AMBIGUOUS}]'))) AND NOT (kind = 'character' AND regexp_matches(key, '[{CV.AMBIGUOUS}]'))"
)
def conversion_dictionary(spark, sf_dir):
    return CV.dictionary(CV.sample(spark))


@_unchecked
def convert_fixpoint(spark, sf_dir):
    return CV.fixpoint(_docs(spark, sf_dir), CV.Converter.of(CV.dictionary(CV.sample(spark))), _scanner(spark))


# ---- marks

@_query(
    rf"""WITH {_CHARS}, p AS (SELECT doc_id, pos, ch, lag(ch) OVER w AS l, lead(ch) OVER w AS r, sum(CASE WHEN ch = chr(10) THEN 1 ELSE 0 END) OVER w AS line FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
b AS (SELECT *, sum(CASE ch WHEN '(' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id, line ORDER BY pos) + CASE ch WHEN '(' THEN 0 ELSE 1 END AS level, regexp_matches(l, '^[{Q.BESIDE}]$') AND regexp_matches(r, '^[{Q.BESIDE}]$') AS fits FROM p WHERE ch IN ('(', ')')),
n AS (SELECT *, lead(ch) OVER w AS next_ch, lead(pos) OVER w AS next_pos, lead(fits) OVER w AS next_fits FROM b WINDOW w AS (PARTITION BY doc_id, line, level ORDER BY pos)),
q AS (SELECT doc_id, pos AS a, next_pos AS b FROM n WHERE ch = '(' AND next_ch = ')' AND fits AND next_fits)
SELECT doc_id, a AS pos, '(' AS found, '（' AS suggestion FROM q UNION ALL SELECT doc_id, b, ')', '）' FROM q"""
)
def half_width_brackets(spark, sf_dir):
    return Q.marks(_docs(spark, sf_dir), Q.brackets)


@_query(rf"""WITH {_CHARS}, {_MARKS} SELECT doc_id, pos, ':' AS found, '：' AS suggestion FROM owned WHERE ch = ':' AND NOT (regexp_matches(l, '[0-9]$') AND regexp_matches(r, '^[0-9]')) AND NOT regexp_matches(l, '\]$') AND NOT (starts_with(r, ' ') AND regexp_matches(l, '(^|[\r\n])[ \t]*$'))""")
def half_width_colons(spark, sf_dir):
    return Q.marks(_docs(spark, sf_dir), Q.colons)


@_unchecked
def quotation_marks(spark, sf_dir):
    return Q.marks(_docs(spark, sf_dir), Q.quotes)


@_query(f"WITH {_CHARS}, n AS (SELECT *, coalesce(lag(ch) OVER w, '') AS l, lead(ch, 1) OVER w AS r, coalesce(lead(ch, 2) OVER w, '') AS rr FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos, ch || r AS found FROM n WHERE ch = r AND regexp_matches(ch, '^[{X.IDEOGRAPH}]$') AND l <> ch AND rr <> ch AND ch || r NOT IN ({', '.join(map(_q, C.DOUBLED))})")
def doubled_characters(spark, sf_dir):
    return C.doubled_characters(_docs(spark, sf_dir))


@_query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS w FROM documents), p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM w),
n AS (SELECT doc_id, a, lead(a, 1) OVER o AS s, lead(a, 2) OVER o AS b, sum(length(a)) OVER o - length(a) AS pos FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, pos::BIGINT AS pos, a || s || b AS found FROM n WHERE regexp_matches(a, '^[A-Za-z0-9]{3,}$') AND regexp_matches(b, '^[A-Za-z0-9]{3,}$') AND lower(a) = lower(b) AND regexp_matches(s, '^([ \t]+|[ \t]*\r?\n[ \t]*)$')"""
)
def repeated_words(spark, sf_dir):
    return S.repeated_words(_raw(spark, sf_dir))


# ---- rhetoric

def _style(detector):
    def of(spark, sf_dir):
        return ST.findings(_docs(spark, sf_dir), [detector])

    return of


for _f in (ST.section_endings, ST.excessive_bold, ST.repeated_slogans, ST.self_questions, ST.uncited_attributions, ST.long_premodifiers):
    _g = _style(_f)
    _g.__name__ = _f.__name__
    _unchecked(_g)


# The texts hold no flags and no joiners of Indic scripts; those are in the tests.
@_query(
    rf"""WITH {_CHARS}, n AS (SELECT *, coalesce(lag(ch) OVER w, '') AS l, coalesce(lead(ch) OVER w, '') AS r FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), i AS (SELECT * FROM n WHERE regexp_matches(ch, '[{ST.INVISIBLE}]') AND NOT regexp_matches(ch, '[\x{{200E}}\x{{200F}}]'))
SELECT doc_id, pos, ch AS found FROM i WHERE CASE WHEN ch = chr(65279) THEN pos > 0 WHEN ch = chr(8204) THEN NOT (regexp_matches(l, '[{ST.ARABIC}]') AND regexp_matches(r, '[{ST.ARABIC}]')) WHEN ch = chr(8205) THEN NOT (regexp_matches(l, '[{ST.EMOJI}]') AND regexp_matches(r, '[{ST.EMOJI}]')) WHEN regexp_matches(ch, '[\x{{E0100}}-\x{{E01EF}}]') THEN NOT regexp_matches(l, '[{X.IDEOGRAPH}]') ELSE true END"""
)
def invisible_characters(spark, sf_dir):
    return ST.findings(_docs(spark, sf_dir), [ST.invisible]).select("doc_id", "pos", "found")


def _first(words: list[str], column: str) -> str:
    """(word) the first of ``words``, in their order, that occurs in a column."""
    return "CASE " + " ".join(f"WHEN contains({column}, '{w}') THEN '{w}'" for w in words) + " END"


_PAIRS = " UNION ALL ".join(f"SELECT doc_id, p0, k, x, {_first(starts, 'x')} AS w, {i} AS kind FROM s" for i, (starts, _) in enumerate(ST.CONTRASTS))
_TURNS = " WHEN ".join(f"{i} THEN regexp_matches(substr(x, instr(x, w) + length(w)), '{'|'.join(turns)}')" for i, (_, turns) in enumerate(ST.CONTRASTS))


@_query(
    f"""WITH {_PARAGRAPHS}, s0 AS (SELECT doc_id, paragraph AS p0, string_split_regex(body, '[。！？；;!?]') AS x FROM g WHERE trim(body) <> ''), s AS (SELECT doc_id, p0, generate_subscripts(x, 1) AS k, unnest(x) AS x FROM s0), c AS ({_PAIRS}),
n AS (SELECT doc_id, count(*) AS n FROM c WHERE w IS NOT NULL AND CASE kind WHEN {_TURNS} END GROUP BY doc_id) SELECT n.doc_id, n.n FROM n JOIN d ON d.doc_id = n.doc_id WHERE length(d.text) >= 500 AND n.n >= 3 AND 1000.0::DOUBLE * n.n / length(d.text) > 5"""
)
def binary_contrasts(spark, sf_dir):
    return ST.findings(_docs(spark, sf_dir), [ST.binary_contrast]).select("doc_id", F.col("note").cast("long").alias("n"))


_COUNT = lambda w, c="body": f"(length({c}) - length(replace({c}, '{w}', ''))) // {len(w)}"


@_query(f"WITH {_PARAGRAPHS} SELECT doc_id, count(*) AS n FROM g WHERE trim(body) <> '' AND {' + '.join(_COUNT(r) for r in ST.ROADS)} >= 2 AND regexp_matches(body, '{'|'.join(ST.GROWTH)}') AND regexp_matches(body, '{'|'.join(ST.ABSTRACT)}') GROUP BY doc_id")
def line_metaphors(spark, sf_dir):
    return ST.findings(_docs(spark, sf_dir), [ST.line_metaphor]).groupBy("doc_id").agg(F.count("*").alias("n"))


_HEDGES = " + ".join(_COUNT(h) for h in ST.HEDGES)


@_query(f"WITH {_PARAGRAPHS}, h AS (SELECT doc_id, {_HEDGES} AS n, length(body) AS chars FROM g), m AS (SELECT doc_id, {_HEDGES.replace('body', 'quoted')} AS q FROM (SELECT doc_id, array_to_string(regexp_extract_all(text, '「[^「」\\n]*」'), ' ') AS quoted FROM d)) SELECT h.doc_id, sum(n)::BIGINT - any_value(m.q) AS n, sum(CASE WHEN chars >= 50 AND n >= 3 AND n >= ceil(chars / 200.0 * 3) THEN n ELSE 0 END)::BIGINT - any_value(CASE WHEN m.q > 0 THEN m.q ELSE 0 END) AS n_warnings FROM h JOIN m ON m.doc_id = h.doc_id GROUP BY h.doc_id HAVING sum(n) - any_value(m.q) > 0")
def hedges(spark, sf_dir):
    return ST.findings(_docs(spark, sf_dir), [ST.hedges]).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))


@_unchecked
def style_findings(spark, sf_dir):
    return ST.findings(M.with_mask(_docs(spark, sf_dir), "markdown"), mask="mask")


# ---- words, sentences, chunks

@_query(
    f"""WITH {seed.SQL}, w AS (SELECT term AS word, true AS from_rule, 1 AS weight FROM rules UNION ALL SELECT unnest(list_concat(list_concat(target, clues), negative_clues)), false, 1 FROM rules),
k AS (SELECT word, bool_or(from_rule) AS from_rule, 1 AS weight FROM w GROUP BY 1), g(word) AS (VALUES {', '.join(f'({_q(x)})' for x in G.GENERAL_WORDS)}), f(word) AS (VALUES {', '.join(f'({_q(x)})' for x in G.FUNCTION_WORDS)}),
u AS (SELECT * FROM k UNION ALL SELECT word, false, 5 FROM g WHERE word NOT IN (SELECT word FROM k) UNION ALL SELECT word, false, 10 FROM f) SELECT word, max(weight) AS weight, bool_or(from_rule) AS from_rule FROM u WHERE length(word) BETWEEN 1 AND 32 GROUP BY word"""
)
def segment_dictionary(spark, sf_dir):
    return G.dictionary(seed.rules(spark))


def _segmenter(spark):
    return G.Segmenter.of(G.dictionary(seed.rules(spark)))


@_unchecked
def word_tokens(spark, sf_dir):
    return G.tokens(_docs(spark, sf_dir), _segmenter(spark)).where("known").groupBy("doc_id").agg(F.count("*").alias("n_known"), F.max(F.length("token")).alias("longest"))


@_unchecked
def confirmed_clues(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", G.clue_counts(F.col("text"), F.array(*[F.lit(c) for c in _CLUES]), _segmenter(spark)).alias("n"))


_CROSS = " UNION ALL ".join(f"SELECT doc_id, pos + {k} AS pos, pos AS from_pos FROM o WHERE word = '{w}'" for w in WORDS for k in range(1, len(w)))


@_query(f"WITH {overlay.SQL}, k(word) AS (VALUES {', '.join(f'({_q(c)})' for c in WORDS)}), p AS (SELECT d.doc_id, word, string_split(d.text, word) AS p FROM d JOIN k ON contains(d.text, word)), u AS (SELECT doc_id, word, generate_subscripts(p, 1) AS i, unnest(p) AS part, len(p) AS n FROM p), o AS (SELECT doc_id, word, i, n, (sum(length(part)) OVER (PARTITION BY doc_id, word ORDER BY i))::BIGINT + (i - 1) * length(word) AS pos FROM u QUALIFY i < n), x AS ({_CROSS}) SELECT doc_id, pos, min(from_pos) AS from_pos FROM x GROUP BY 1, 2")
def word_crossings(spark, sf_dir):
    return G.crossings(_docs(spark, sf_dir), set(WORDS))


@_unchecked
def placed_issues(spark, sf_dir):
    found = _with_texts(spark, sf_dir)
    return G.placed(found).select("doc_id", "pos", "n", "sentence")


def _with_texts(spark, sf_dir):
    """``doc_id, text, pos, size`` of issues, with the text of their document."""
    docs = _docs(spark, sf_dir)
    return _issues(spark, sf_dir).select("doc_id", "pos", "size").join(docs, "doc_id")


@_unchecked
def issue_chunks(spark, sf_dir):
    return G.chunks(_with_texts(spark, sf_dir)).select("doc_id", "pos", "chunk")


# ---- scores

@_unchecked
def machine_scores(spark, sf_dir):
    return SC.machine_scores(_docs(spark, sf_dir)).select("doc_id", F.round("score", 9).alias("score"), F.array_join("top_signals", "; ").alias("signals"), "n_invisible", "n_families")


_T = ST.DOMAINS["general"]
_EXCESS = lambda v, key, w, over: f"CASE WHEN {v} {over} {_T[key]} THEN least(2.0, greatest(0.1, ({v} - {_T[key]}::DOUBLE) / {_T[key]})) * {w} ELSE 0 END"


@_query(
    f"""WITH {overlay.SQL}, n AS (SELECT doc_id, length(text) / 1000.0::DOUBLE AS k, {_COUNT('被', 'text')} AS passives, list_max(list_transform(string_split_regex(text, '[，,。！？；\\n]'), lambda x: {_COUNT('的', 'x')})) AS max_chain, len(regexp_extract_all(text, '{'|'.join(SC.PERSONS)}')) AS n_pronouns, text FROM d WHERE length(text) >= 200),
v0 AS (SELECT doc_id, string_split_regex(text, '{'|'.join(SC.WEAK_VERBS)}') AS p FROM n), v1 AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM v0), v AS (SELECT doc_id, count(*) FILTER (i > 1 AND regexp_matches(substr(part, 1, 4), '{'|'.join(SC.WEAK_OBJECTS)}')) AS n_weak_verbs FROM v1 GROUP BY doc_id)
SELECT n.doc_id, max_chain, n_weak_verbs, n_pronouns, round(least(1.0, ({_EXCESS('passives / k', 'passive', 1.0, '>')} + {_EXCESS('max_chain', 'chain', 0.7, '>=')} + {_EXCESS('n_weak_verbs / k', 'weak_verb', 0.8, '>')} + {_EXCESS('n_pronouns / k', 'pronoun', 0.6, '>')}) / 3.6), 6) AS score FROM n JOIN v ON v.doc_id = n.doc_id"""
)
def translated_scores(spark, sf_dir):
    return SC.translated_scores(_docs(spark, sf_dir)).select("doc_id", "max_chain", "n_weak_verbs", "n_pronouns", F.round("score", 6).alias("score"))


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{k}', {float(v)}::DOUBLE)" for d, t in ST.DOMAINS.items() for k, v in t.items()) + ") t(domain, signal, threshold)")
def domain_thresholds(spark, sf_dir):
    return SC.thresholds(spark)


@_unchecked
def style_scorecard(spark, sf_dir):
    return SC.scorecard(_docs(spark, sf_dir), _scanner(spark)).select("doc_id", *[F.round(c, 9).alias(c) for c in ("machine", "translated", "regional")])


@_query(f"WITH {_HITS}, g AS (SELECT doc_id, english, found, count(*) AS n, min(pos) AS first, any_value(suggestions) AS s, any_value(text) AS text FROM issues WHERE rule_type IN ('cross_strait', 'confusable') AND severity <> 'info' AND english IS NOT NULL GROUP BY 1, 2, 3), b AS (SELECT *, first_value(s[1]) OVER (PARTITION BY doc_id, english ORDER BY first) AS best, string_agg(found, '|') OVER (PARTITION BY doc_id, english) AS terms FROM g) SELECT doc_id, english, best AS preferred, found, n FROM b WHERE contains(regexp_replace(text, terms, chr(1), 'g'), best)")
def consistency_report(spark, sf_dir):
    return SC.consistency(_docs(spark, sf_dir), _scanner(spark))


@_unchecked
def quality_flags(spark, sf_dir):
    return SC.quality_flags(_docs(spark, sf_dir), R.ORAL).select("doc_id", F.array_join("flags", ",").alias("flags"))


@_query(f"WITH {_HITS}, t AS (SELECT count(*) AS issues, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(DISTINCT doc_id) AS with_issues FROM issues), r AS (SELECT count(*) AS documents, sum(length(text))::BIGINT AS chars FROM d) SELECT documents, chars, issues, errors, warnings, infos, with_issues, 1000.0::DOUBLE * issues / chars AS per_1000_chars, with_issues::DOUBLE / documents AS share_with_issues FROM t, r")
def batch_totals(spark, sf_dir):
    return SC.totals(_issues(spark, sf_dir), _docs(spark, sf_dir))


_RHYTHM = " UNION ALL ".join(f"SELECT doc_id, '{m}' AS mark, pos FROM c WHERE ch = '{m}'" for m in SC.MARKS)


@_query(
    f"""WITH {_CHARS}, n AS (SELECT *, lead(ch) OVER (PARTITION BY doc_id ORDER BY pos) AS r1 FROM c), m AS ({_RHYTHM} UNION ALL SELECT doc_id, '——', pos FROM n WHERE ch = '—' AND r1 = '—'),
g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY doc_id, mark ORDER BY pos) AS gap FROM m), t AS (SELECT doc_id, mark, count(*) AS n, CASE WHEN count(*) >= 10 AND avg(gap) >= 1 THEN round(stddev_pop(gap) / avg(gap), 9) END AS cv FROM g GROUP BY 1, 2) SELECT t.doc_id, mark, n, 1000.0::DOUBLE * n / length(text) AS density, cv FROM t JOIN d ON d.doc_id = t.doc_id"""
)
def mark_rhythm(spark, sf_dir):
    return SC.mark_rhythm(_docs(spark, sf_dir)).withColumn("cv", F.round("cv", 9))


_SEPARATOR = r"\r?\n[ \t]*\r?\n(?:[ \t]*\r?\n)*"


@_query(f"WITH {overlay.SQL}, {_spans_sql('u', _SEPARATOR)}, b AS (SELECT doc_id, a, a + length(found) AS b FROM u UNION ALL SELECT doc_id, NULL, 0 FROM d), p AS (SELECT b.doc_id, b.b AS start_at, coalesce(lead(b.a) OVER (PARTITION BY b.doc_id ORDER BY b.b), length(d.text)) AS end_at, d.text FROM b JOIN d ON d.doc_id = b.doc_id) SELECT doc_id, start_at, end_at FROM p WHERE regexp_matches(substr(text, start_at + 1, end_at - start_at), '[^\\s\\x{{3000}}\\x{{00A0}}\\x{{0085}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{001C}}-\\x{{001F}}]')")
def paragraph_places(spark, sf_dir):
    return K.found(_docs(spark, sf_dir), G.paragraph_spans, "start_at int, end_at int")


@_unchecked
def sentence_places(spark, sf_dir):
    return G.sentences(_docs(spark, sf_dir)).toDF("doc_id", "n", "start_at", "end_at")


# ---- judgement and stores

_COLLOCATED = "CASE " + " ".join(f"WHEN term = '{t}' AND contains(near_text, '{w}') THEN '{to}'" for t, w, to in J.COLLOCATIONS) + " END"
_VETOED = " OR ".join(f"(term = '{t}' AND regexp_matches(near_text, '{'|'.join(words)}'))" for t, words in J.VETOES.items())
_PRIOR = lambda k: "CASE term " + " ".join(f"WHEN '{t}' THEN {_q(v[0]) if k == 0 else v[1]}" for t, v in J.PREFERRED["strict"].items()) + f" ELSE {'NULL' if k == 0 else 0} END"
_JUDGED = f"""{_FOUND}, e AS (SELECT *, CASE WHEN {_DELETES} THEN target ELSE list_filter(target, lambda t: t <> '') END AS sugg, l || term || r AS near_text FROM kept
  WHERE (len(clues) = 0 OR len(list_filter(clues, lambda x: {_CLUE})) > 0) AND len(list_filter(negative_clues, lambda x: {_CLUE})) = 0),
p AS (SELECT *, type IN ('cross_strait', 'confusable') AND (len(sugg) > 1 OR len(clues) > 0 OR term IN ({', '.join(map(_q, J.VETOES))})) AS able, {_COLLOCATED} AS coll, {_VETOED} AS veto, {_PRIOR(0)} AS liked, {_PRIOR(1)}::DOUBLE AS prior, len(list_filter(clues, lambda x: contains(near_text, x))) AS n FROM e),
w AS (SELECT *, CASE WHEN n > 0 THEN least(0.7, 0.3 + 0.4 * n / len(clues)::DOUBLE) ELSE 0 END AS clue FROM p), s AS (SELECT *, round(least(1.0, clue + prior), 9) AS raw FROM w),
v AS (SELECT *, CASE WHEN NOT able THEN NULL WHEN coalesce(list_contains(sugg, coll), false) THEN 'collocation' WHEN veto THEN 'suppressed' WHEN raw >= {J.DECIDED} THEN CASE WHEN clue >= prior AND clue > 0 THEN 'context_clue' WHEN prior > 0 THEN 'profile_prior' ELSE 'combined' END WHEN raw < {J.AMBIGUOUS} THEN 'suppressed' ELSE 'gray_zone' END AS resolution FROM s),
judged AS (SELECT doc_id, pos, term AS found, resolution, CASE WHEN NOT able THEN NULL WHEN resolution = 'collocation' THEN 1.0 WHEN veto THEN 0.0 ELSE raw END AS score, CASE WHEN NOT able THEN 'not_eligible' WHEN resolution IN ('suppressed', 'gray_zone') THEN resolution ELSE 'resolved' END AS outcome, CASE WHEN resolution = 'suppressed' THEN 'info' ELSE severity END AS severity,
  CASE WHEN NOT able THEN 'deterministic' WHEN resolution IN ('suppressed', 'gray_zone') THEN 'unresolved' ELSE 'heuristic' END AS tier,
  CASE WHEN len(sugg) = 2 AND resolution NOT IN ('suppressed', 'gray_zone') AND sugg[2] = CASE WHEN resolution = 'collocation' THEN coll WHEN prior > clue AND list_contains(sugg, liked) THEN liked ELSE sugg[1] END THEN sugg[2] || '/' || sugg[1] ELSE array_to_string(sugg, '/') END AS suggestions FROM v)"""


@_query(f"WITH {_JUDGED} SELECT * FROM judged")
def judged_issues(spark, sf_dir):
    out = J.disambiguated(_docs(spark, sf_dir), L.scanner(seed.features(spark), words=set(WORDS)), "strict")
    return out.withColumn("suggestions", F.array_join("suggestions", "/"))


@_query(f"WITH {_JUDGED}, n AS (SELECT count(*) FILTER (tier = 'deterministic') AS deterministic, count(*) FILTER (tier = 'heuristic') AS heuristic, 0 AS llm_judged, count(*) FILTER (tier = 'unresolved') AS unresolved FROM judged) SELECT *, deterministic + heuristic AS high, llm_judged AS medium, unresolved AS low FROM n")
def tier_counts(spark, sf_dir):
    return J.tiers(J.disambiguated(_docs(spark, sf_dir), L.scanner(seed.features(spark), words=set(WORDS)), "strict"))


@_query(f"WITH {_FOUND} SELECT doc_id, pos, found, CASE WHEN found IN ('硬件', '線程') THEN 'info' ELSE severity END AS severity FROM issues")
def suppressed_findings(spark, sf_dir):
    store = spark.createDataFrame([("硬件", "kept"), ("線程", "kept"), (None, "none")], stores.STORES["suppressions"])
    return J.suppressed(_features(spark, sf_dir), store).select("doc_id", "pos", "found", "severity")


@_query(f"WITH {_FOUND} SELECT doc_id, pos, found FROM issues WHERE NOT (rule_type = 'political_coloring' AND found IN ('內地', '大陸同胞', '祖國'))")
def allowed_findings(spark, sf_dir):
    return J.allowed(_features(spark, sf_dir), "international").select("doc_id", "pos", "found")


@_query(f"WITH {_FOUND} SELECT doc_id, pos, found, len(suggestions) > 1 OR (rule_type <> 'variant' AND (len(clues) > 0 OR coalesce(confidence, '') = 'low')) AS judge FROM issues")
def open_questions(spark, sf_dir):
    found = _features(spark, sf_dir)
    return found.select("doc_id", "pos", "found", J.needs_judgement(found).alias("judge"))


@_query(f"WITH {_FOUND}, x AS (SELECT *, coalesce(confidence, CASE WHEN severity = 'info' THEN 'low' WHEN len(clues) > 0 THEN 'medium' ELSE 'high' END) AS level FROM issues) SELECT doc_id, pos, found, level AS confidence_level, rule_type = 'confusable' OR coalesce(confidence = 'low', false) AS false_friend, level <> 'low' AND len(suggestions) = 1 AND rule_type IN ('variant', 'typo') AS auto_fix_safe, level = 'low' OR len(suggestions) > 1 AS needs_review FROM x")
def explained_findings(spark, sf_dir):
    return J.explained(_features(spark, sf_dir)).select("doc_id", "pos", "found", "confidence_level", "false_friend", "auto_fix_safe", "needs_review")


_AROUND_HASH = "sha256(substr(text, greatest(pos - 40, 0)::BIGINT + 1, length(found) + 80))"


@_query(f"WITH {_FOUND} SELECT doc_id, pos, found, CASE WHEN doc_id % 2 = 0 OR {_AROUND_HASH} IN (SELECT {_AROUND_HASH} FROM issues b WHERE b.doc_id % 2 = 0 AND b.found = issues.found) THEN 'kept' END AS judgement FROM issues")
def remembered_judgements(spark, sf_dir):
    keyed = J.judgement_keys(_features(spark, sf_dir), _docs(spark, sf_dir), "base", "r1")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    old = keyed.where("doc_id % 2 = 0").select(*J.JUDGEMENT_KEY, F.lit("kept").alias("judgement"), (now - F.expr("interval 3 days")).alias("judged_at"))
    stale = keyed.select(*J.JUDGEMENT_KEY, F.lit("stale").alias("judgement"), (now - F.expr("interval 31 days")).alias("judged_at"))
    return J.remembered(keyed, old.union(stale), now).select("doc_id", "pos", "found", "judgement")


@_query(f"WITH {_FOUND}, n AS (SELECT doc_id, pos, found, row_number() OVER (PARTITION BY doc_id ORDER BY pos, found) AS k FROM issues WHERE len(suggestions) > 1) SELECT doc_id, pos, found FROM n WHERE k <= 2")
def asked_judgements(spark, sf_dir):
    keyed = J.judgement_keys(_features(spark, sf_dir).where(F.size("suggestions") > 1), _docs(spark, sf_dir), "base", "r1")
    none = keyed.limit(0).withColumn("judgement", F.lit("x"))
    return J.asked(keyed, none, 2).select("doc_id", "pos", "found")


@_query(f"WITH {overlay.SQL} SELECT d.doc_id, t AS found, t = '硬件' AS anchor FROM d JOIN (VALUES ('硬件'), ('視頻'), ('積分')) k(t) ON contains(d.text, t)")
def term_anchors(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    english = docs.select("doc_id", F.lit("The hardwares of this computer").alias("english"))
    rules = seed.features(spark).where(F.col("from").isin("硬件", "視頻", "積分")).withColumn("clues", F.array().cast("array<string>"))
    return J.anchors(docs, english, rules)


@_query(f"WITH {overlay.SQL} SELECT doc_id FROM d WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM d WHERE doc_id % 2 = 0)")
def uncached_documents(spark, sf_dir):
    docs, now = _docs(spark, sf_dir), F.timestamp_seconds(F.lit(1_700_000_000))
    entries = stores.cache_entries(docs.where("doc_id % 2 = 0"), _issues(spark, sf_dir).where("doc_id % 2 = 0"), "r1", now - F.expr("interval 2 hours"))
    stale = stores.cache_entries(docs, _issues(spark, sf_dir), "r1", now - F.expr("interval 25 hours"))
    return stores.uncached(docs, entries.union(stale), "r1", now).select("doc_id")


@_query(f"WITH {_HITS}, e AS (SELECT * FROM issues WHERE {_ELIGIBLE}), n AS (SELECT d.doc_id, count(e.pos) AS n FROM d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY 1) SELECT d.doc_id, 'r1' AS ruleset, sha256(d.text) AS input_hash, n.n AS n_applied FROM d JOIN n ON n.doc_id = d.doc_id")
def audit_records(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return stores.trace(docs, FX.fixed(docs, _scanner(spark)), "r1", F.current_timestamp()).select("doc_id", "ruleset", "input_hash", F.col("n_applied").cast("long").alias("n_applied"))


_ROW = "concat_ws('|', term, array_to_string(target, '/'), type, coalesce(english, ''), severity, array_to_string(clues, '/'), array_to_string(negative_clues, '/'), array_to_string(tags, '/'), '', '', '', '', '')"


@_query(f"WITH {seed.SQL}, h AS (SELECT sha256({_ROW}) AS h FROM rules) SELECT sha256(string_agg(h, '' ORDER BY h)) AS digest, count(*) AS n_rules FROM h")
def ruleset_digest(spark, sf_dir):
    return stores.ruleset_digest(seed.rules(spark))


@_query(f"WITH {seed.SQL} SELECT layer, count(*) AS n_rules, count(*) FILTER (disabled) AS n_disabled FROM seeds GROUP BY layer")
def rule_packs(spark, sf_dir):
    return stores.packs(seed.rules(spark))


# ---- reports

_SHOWN = "CASE WHEN len(suggestions) = 0 THEN coalesce(english, '?') WHEN suggestions = [''] THEN '(delete)' ELSE array_to_string(suggestions, '{0}') END"


@_query(f"WITH {_HITS} SELECT doc_id, line || ':' || col || ': ' || severity || ' [' || rule_type || '] ''' || found || ''' -> ' || {_SHOWN.format(', ')} AS line_text FROM issues")
def human_report(spark, sf_dir):
    return sinks.human_report(_issues(spark, sf_dir))


_GROUPS = "g AS (SELECT doc_id, found, rule_type, severity, shown, {0} count(*) AS n, string_agg(line || ':' || col, ',' ORDER BY line, col) AS places, string_agg(line::VARCHAR, ',' ORDER BY line, col) AS lines, count(DISTINCT col) AS n_cols, min(col) AS col FROM s GROUP BY ALL)"


@_query(f"WITH {_HITS}, s AS (SELECT *, len(suggestions) > 1 OR len(clues) > 0 AS judge, {_SHOWN.format('|')} AS shown FROM issues), {_GROUPS.format('judge,')} SELECT doc_id, places || ' ' || CASE WHEN judge THEN 'AMBIG' ELSE upper(substr(severity, 1, 1)) END || ' ' || found || CASE WHEN judge THEN ' ? ' ELSE ' -> ' END || shown AS line_text FROM g UNION ALL SELECT doc_id, 'PASS' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM issues)")
def agent_report(spark, sf_dir):
    return sinks.agent_report(_issues(spark, sf_dir), _docs(spark, sf_dir))


@_query(f"WITH {_HITS}, s AS (SELECT *, {_SHOWN.format(',')} AS shown FROM issues), {_GROUPS.format('')} SELECT doc_id, concat_ws(chr(9), found, shown, rule_type, upper(substr(severity, 1, 1)), n, CASE WHEN n_cols = 1 THEN lines || ':' || col ELSE places END) AS row FROM g")
def grouped_table(spark, sf_dir):
    return sinks.tabular_report(_issues(spark, sf_dir))


@_query(f"WITH {_HITS}, n AS (SELECT doc_id, count(*) AS total, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues GROUP BY 1) SELECT d.doc_id, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM d LEFT JOIN n ON n.doc_id = d.doc_id")
def summary_output(spark, sf_dir):
    return sinks.output(_issues(spark, sf_dir), _docs(spark, sf_dir), "summary")


_ITEM = "'{\"offset\":' || byte_offset || ',\"length\":' || strlen(found) || ',\"line\":' || line || ',\"col\":' || col || ',\"found\":' || to_json(found) || ',\"suggestions\":' || to_json(suggestions) || ',\"rule_type\":\"' || rule_type || '\",\"severity\":\"' || severity || '\"' || CASE WHEN english IS NULL THEN '' ELSE ',\"english\":' || to_json(english) END || '}'"


@_query(f"WITH {_HITS}, n AS (SELECT doc_id, count(*) AS total, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, string_agg({_ITEM}, ',' ORDER BY pos, {_RANK}) AS items FROM issues GROUP BY 1) SELECT d.doc_id, '{{\"file\":' || d.doc_id || ',\"total\":' || coalesce(total, 0) || ',\"errors\":' || coalesce(errors, 0) || ',\"warnings\":' || coalesce(warnings, 0) || ',\"issues\":[' || coalesce(items, '') || ']}}' AS json FROM d LEFT JOIN n ON n.doc_id = d.doc_id")
def json_report(spark, sf_dir):
    return sinks.json_report(_issues(spark, sf_dir), _docs(spark, sf_dir))


@_query(f"WITH {_HITS} SELECT doc_id, '{{\"ruleId\":\"{sinks.TOOL}/' || rule_type || '\",\"level\":\"' || CASE severity WHEN 'info' THEN 'note' ELSE severity END || '\",\"message\":{{\"text\":' || to_json('''' || found || ''' -> ' || {_SHOWN.format(', ')}) || '}},\"locations\":[{{\"physicalLocation\":{{\"artifactLocation\":{{\"uri\":\"' || doc_id || '\"}},\"region\":{{\"startLine\":' || line || ',\"startColumn\":' || col || ',\"byteOffset\":' || byte_offset || ',\"byteLength\":' || strlen(found) || '}}}}}}]}}' AS result FROM issues")
def sarif_results(spark, sf_dir):
    return sinks.sarif_results(_issues(spark, sf_dir))


@_query(f"WITH {seed.SQL} SELECT term, english, array_to_string(target, '/') AS targets FROM rules WHERE english IS NOT NULL AND english <> ''")
def ambiguous_terms(spark, sf_dir):
    return sinks.ambiguous_terms(seed.rules(spark))


@_query(f"WITH {_HITS} SELECT doc_id, pos, found, array_to_string(suggestions, '/') AS suggestion FROM issues")
def sql_functions(spark, sf_dir):
    """The registered table function over the documents."""
    api.register(spark, L.merged(seed.rules(spark)))
    _docs(spark, sf_dir).createOrReplaceTempView("glyphmill_docs")
    return spark.sql("SELECT d.doc_id, i.pos, i.found, i.suggestion FROM glyphmill_docs d, LATERAL lint_issues(d.text) i")


@_unchecked
def whole_scan(spark, sf_dir):
    """Everything that a scan finds, phase by phase."""
    out = SN.scanned(_docs(spark, sf_dir), _scanner(spark), "markdown", raise_headings=True)
    return out.select("doc_id", "pos", "found", F.array_join("suggestions", "/").alias("suggestion"), "rule_type", "severity", "family", "phase")


@_query(f"WITH {_HITS} SELECT doc_id, pos, found, severity FROM issues")
def spelling_alone(spark, sf_dir):
    """The whole scan with all families off but the rules, nothing masked but addresses and names: plain passages only."""
    off = [f for f in SN.FAMILIES if f != "spelling"]
    docs = _docs(spark, sf_dir)
    # Places that the plain mask covers hold terms in a few passages; these are scanned without it.
    found = SN.scanned(docs, _scanner(spark), "plain", off)
    masked = M.mask(docs, "plain")
    hidden = _issues(spark, sf_dir).join(masked.withColumnRenamed("doc_id", "_doc"), (F.col("doc_id") == F.col("_doc")) & (F.col("pos") < F.col("end")) & (F.col("pos") + F.length("found") > F.col("start")), "left_semi")
    return found.select("doc_id", "pos", "found", "severity").union(hidden.select("doc_id", "pos", "found", "severity"))


@_unchecked
def checked_call(spark, sf_dir):
    """The checked call with named settings: its report."""
    return api.check(_docs(spark, sf_dir), seed.rules(spark), content_type="markdown", ignore_terms=("信息",), output="summary")["report"]
