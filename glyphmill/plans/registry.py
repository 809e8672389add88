"""The queries of the library's own operators, each with SQL for an independent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import characters as C
from glyphmill.operators import decisions as D
from glyphmill.operators import fixes as FX
from glyphmill.operators import lexical as L
from glyphmill.operators import quotes as Q
from glyphmill.operators import structure as S
from glyphmill.plans import overlay, seed

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_CHARS = overlay.SQL + ", c AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS ch FROM (SELECT doc_id, string_split(text, '') AS s FROM d))"
_CJK = rf"'^[{X.IDEOGRAPH}]$'"


def hits_sql(rules: str) -> str:
    """``near``: hits of ``rules`` in ``d``, with the surroundings of each: ``l`` and ``r`` up to blank lines.

    A term's places come of splitting a text at it, so no position is looked at by itself.
    """
    return f"""{rules},
parts AS (SELECT d.doc_id, r.term, string_split(d.text, r.term) AS p FROM d JOIN rules r ON contains(d.text, r.term)),
pieces AS (SELECT doc_id, term, generate_subscripts(p, 1) AS i, unnest(p) AS part, len(p) AS n FROM parts),
occ AS (SELECT doc_id, term, i, n, (sum(length(part)) OVER (PARTITION BY doc_id, term ORDER BY i))::BIGINT + (i - 1) * length(term) AS pos FROM pieces),
found AS (SELECT o.doc_id, d.text, o.pos, r.* FROM occ o JOIN d ON d.doc_id = o.doc_id JOIN rules r ON r.term = o.term WHERE o.i < o.n),
hits AS (SELECT * FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.doc_id = a.doc_id AND b.term <> a.term AND b.pos <= a.pos AND b.pos + length(b.term) > a.pos AND (b.pos < a.pos OR length(b.term) > length(a.term)))),
near AS (SELECT *, list_extract(string_split(substr(text, greatest(pos - 40, 0) + 1, pos - greatest(pos - 40, 0)), chr(10) || chr(10)), -1) AS l, list_extract(string_split(substr(text, pos + length(term) + 1, 40), chr(10) || chr(10)), 1) AS r FROM hits)"""


# A clue counts if it begins in the window, wherever it ends.
_CLUE = "contains(substr(text, (pos - length(l) + 1)::BIGINT, (length(l) + length(term) + length(r) + length(x) - 1)::BIGINT), x)"
_DELETES = "type = 'ai_filler' AND target = ['']"
_ISSUES = f"""issues AS (SELECT doc_id, pos, text, strlen(substr(text, 1, pos)) AS byte_offset, 1 + length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')) AS line,
  1 + length(list_extract(string_split(substr(text, 1, pos), chr(10)), -1)) AS col, term AS found, CASE WHEN {_DELETES} THEN target ELSE list_filter(target, lambda t: t <> '') END AS suggestions, type AS rule_type, severity, english, clues,
  length(term) + CASE WHEN {_DELETES} AND substr(text, pos + length(term) + 1, 1) IN ('，', '：') THEN 1 ELSE 0 END AS size FROM near
  WHERE (len(clues) = 0 OR len(list_filter(clues, lambda x: {_CLUE})) > 0) AND len(list_filter(negative_clues, lambda x: {_CLUE})) = 0)"""
_HITS = overlay.SQL + ", " + hits_sql(seed.SQL) + ", " + _ISSUES


def _query(sql: str):
    def of(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return of


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.issues(overlay.documents(spark, sf_dir), L.merged(seed.rules(spark)))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@_query(f"WITH {_HITS} SELECT doc_id, pos, byte_offset, line, col, found, array_to_string(suggestions, '/') AS suggestion, rule_type, severity, english FROM issues")
def lexical_issues(spark, sf_dir):
    return _issues(spark, sf_dir).withColumn("suggestion", F.array_join("suggestions", "/")).drop("suggestions", "clues", "confidence", "size")


@_query(f"WITH {seed.SQL} SELECT term, layer, ord, array_to_string(target, '/') AS target FROM rules")
def layered_rules(spark, sf_dir):
    return L.merged(seed.rules(spark)).select(F.col("from").alias("term"), "layer", "ord", F.array_join("to", "/").alias("target"))


@_query(f"WITH {seed.SQL} SELECT DISTINCT a.term, a.layer AS layer_a, b.layer AS layer_b FROM seeds a JOIN seeds b ON a.term = b.term AND a.layer < b.layer AND a.target <> b.target")
def pack_conflicts(spark, sf_dir):
    return L.conflicts(seed.rules(spark)).withColumnRenamed("from", "term").select("term", "layer_a", "layer_b")


@_query(f"WITH {seed.SQL} SELECT term FROM rules WHERE NOT list_contains(tags, 'style')")
def disabled_tags(spark, sf_dir):
    return L.merged(seed.rules(spark), ["style"]).select(F.col("from").alias("term"))


@_query(f"WITH {_HITS} SELECT (SELECT count(DISTINCT found) FROM issues) AS rules_matched, (SELECT count(DISTINCT term) FROM rules) AS rules_checked")
def rule_coverage(spark, sf_dir):
    return D.coverage(_issues(spark, sf_dir), L.merged(seed.rules(spark)))


@_query(
    f"""WITH {_HITS}, e AS (SELECT * FROM issues WHERE len(suggestions) = 1 AND len(clues) = 0), last AS (SELECT d.doc_id, d.text, e.pos, e.size, e.suggestions FROM d LEFT JOIN e ON d.doc_id = e.doc_id),
parts_of AS (SELECT doc_id, text, pos, size, suggestions, coalesce(lag(pos + size) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS begin_at FROM last)
SELECT doc_id, coalesce(string_agg(substr(text, begin_at + 1, pos - begin_at) || suggestions[1], '' ORDER BY pos), '') || substr(any_value(text), coalesce(max(pos + size), 0) + 1) AS text, count(pos) AS n_applied FROM parts_of GROUP BY doc_id"""
)
def fixed_texts(spark, sf_dir):
    out = FX.fixed(overlay.documents(spark, sf_dir), L.scanner(L.merged(seed.rules(spark))), "lexical_safe")
    return out.select("doc_id", "text", F.col("n_applied").cast("long").alias("n_applied"))


@_query(f"WITH {_HITS} SELECT doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM issues GROUP BY doc_id")
def severity_summary(spark, sf_dir):
    return D.summary(_issues(spark, sf_dir))


@_query(f"WITH {_HITS} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') <= 0 AND count(*) FILTER (severity = 'warning') <= 100000 AS passed, CASE WHEN count(*) FILTER (severity = 'error') <= 0 AND count(*) FILTER (severity = 'warning') <= 100000 THEN 0 ELSE 1 END AS exit_code FROM issues")
def gate_result(spark, sf_dir):
    return D.gate(_issues(spark, sf_dir), 0, 100_000)


@_query(f"WITH {_HITS} SELECT found, rule_type, severity, array_to_string(suggestions, '/') AS suggestion, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(line) AS first_line, count(DISTINCT col) AS n_cols FROM issues GROUP BY 1, 2, 3, 4")
def grouped_issues(spark, sf_dir):
    return D.grouped(_issues(spark, sf_dir))


@_query(
    f"WITH {_HITS} SELECT doc_id, rank, found FROM (SELECT doc_id, found, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, pos) AS rank FROM issues) WHERE rank <= 5"
)
def top_five_issues(spark, sf_dir):
    return D.top_issues(_issues(spark, sf_dir)).select("doc_id", "rank", "found")


@_query(f"WITH {_HITS}, n AS (SELECT doc_id, count(*) AS n FROM issues WHERE rule_type IN ('cross_strait', 'confusable') GROUP BY 1) SELECT d.doc_id, least(1.0, 1000.0::DOUBLE * coalesce(n.n, 0) / length(d.text)) AS density FROM d LEFT JOIN n ON d.doc_id = n.doc_id")
def regional_density(spark, sf_dir):
    return D.regional_density(overlay.documents(spark, sf_dir), _issues(spark, sf_dir))


@_query(f"WITH {_HITS} SELECT doc_id, pos, CASE WHEN found IN ('軟件', '信息') THEN 'info' ELSE severity END AS severity FROM issues")
def ignored_terms(spark, sf_dir):
    terms = spark.createDataFrame([("軟件",), ("信息",), ("軟件",)], "term string")
    return D.demoted(_issues(spark, sf_dir), terms).select("doc_id", "pos", "severity")


@_query(f"WITH {_HITS} SELECT doc_id, pos, CASE WHEN found = '內存' THEN 'info' ELSE severity END AS severity FROM issues")
def translation_memory(spark, sf_dir):
    memory = spark.createDataFrame([("內存", "記憶體", "2024-01-01"), ("內存", "內存", "2024-02-01"), ("默認", "默認", "2024-01-01"), ("默認", "預設", "2024-03-01"), ("進行測試", "進行測試", "2024-01-01")], "found string, user_chose string, timestamp string")
    return D.with_memory(_issues(spark, sf_dir), memory).select("doc_id", "pos", "severity")


@_query(f"WITH {_HITS} SELECT doc_id, pos, CASE WHEN found = '視頻' THEN 'error' ELSE severity END AS severity FROM issues WHERE found <> '數據庫'")
def glossary(spark, sf_dir):
    terms = spark.createDataFrame([("視頻", "banned"), ("數據庫", "proper_noun")], "term string, kind string")
    return D.with_glossary(_issues(spark, sf_dir), terms, overlay.documents(spark, sf_dir)).select("doc_id", "pos", "severity")


@_query(f"WITH {_HITS} SELECT doc_id, pos, found FROM issues WHERE doc_id % 2 = 1")
def beyond_baseline(spark, sf_dir):
    found = _issues(spark, sf_dir)
    return D.beyond_baseline(found, found.where("doc_id % 2 = 0").select(D.fingerprint().alias("fp"))).select("doc_id", "pos", "found")


@_query(f"WITH {_CHARS}, n AS (SELECT doc_id, pos, ch, lead(ch) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM c) SELECT doc_id, pos + 1 AS pos FROM n WHERE (regexp_matches(ch, {_CJK}) AND regexp_matches(nx, '^[A-Za-z0-9]$')) OR (regexp_matches(ch, '^[A-Za-z0-9]$') AND regexp_matches(nx, {_CJK}))")
def missing_spaces(spark, sf_dir):
    return C.missing_spaces(overlay.documents(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


# Marks with what stands before and after them, and the English that ends at them.
_MARKS = rf"""m AS (SELECT doc_id, pos, ch FROM c WHERE ch IN (',', '!', '?', ';', ':')), w AS (SELECT m.*, substr(d.text, greatest(m.pos - 512, 0) + 1, least(m.pos, 512)) AS l, substr(d.text, m.pos + 2, 200) AS r FROM m JOIN d ON d.doc_id = m.doc_id),
e AS (SELECT *, regexp_matches(l, '[{Q.BESIDE}]\s*$') OR regexp_matches(r, '^\s*[{Q.BESIDE}]') AS beside, regexp_extract(regexp_replace(regexp_replace(l, '([A-Za-z0-9])\.([A-Za-z0-9])', '\1_\2', 'g'), '([A-Za-z0-9])\.([A-Za-z0-9])', '\1_\2', 'g'), '[\t\x20\x22-\x2B\x2D\x2F-\x39\x3C-\x3E\x40-\x7E]*$') AS run FROM w),
owned AS (SELECT * FROM e WHERE beside AND NOT (len(regexp_extract_all(run, '[^ \t]*[A-Za-z][^ \t]*')) >= 2 AND regexp_matches(run, '(^|[ \t])[^A-Za-z \t]*[a-z]')))"""


@_query(
    rf"""WITH {_CHARS}, {_MARKS}
SELECT doc_id, pos, ch AS found, translate(ch, ',!?;', '，！？；') AS suggestion FROM owned WHERE ch <> ':' AND NOT (ch = ',' AND regexp_matches(l, '[0-9]$') AND regexp_matches(r, '^[0-9]')) AND NOT (ch = '!' AND starts_with(r, '['))"""
)
def half_width_marks(spark, sf_dir):
    return C.half_width_marks(overlay.documents(spark, sf_dir))


@_query(
    rf"""WITH {_CHARS}, m AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, ch ORDER BY pos) AS island FROM c)
SELECT doc_id, min(pos) AS pos, repeat(ch, count(*)::INTEGER) AS found FROM m WHERE regexp_matches(ch, '^[，。！？；：、（）「」『』《》…—]$') GROUP BY doc_id, ch, island HAVING count(*) > CASE WHEN ch IN ('…', '—') THEN 2 ELSE 1 END"""
)
def repeated_marks(spark, sf_dir):
    return C.repeated_marks(overlay.documents(spark, sf_dir))


def beside_sql(signs: str, where: str = "true") -> str:
    """``w``: places of signs with what stands before and behind, and whether that is Chinese, white space apart."""
    return rf"""n AS (SELECT *, coalesce(lag(ch) OVER o, '') AS l1, coalesce(lead(ch) OVER o, '') AS r1 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
v AS (SELECT n.*, substr(d.text, greatest(n.pos - 200, 0) + 1, least(n.pos, 200)) AS l, substr(d.text, n.pos + 2, 200) AS r FROM n JOIN d ON d.doc_id = n.doc_id WHERE ch IN ({signs}) AND ({where})),
w AS (SELECT *, regexp_matches(l, '[{Q.BESIDE}][\s\x{{3000}}]*$') AS cl, regexp_matches(r, '^[\s\x{{3000}}]*[{Q.BESIDE}]') AS cr FROM v)"""


@_query(
    rf"""WITH {_CHARS}, {beside_sql("'~', '-'")} SELECT doc_id, pos, ch AS found, '～' AS suggestion FROM w WHERE (ch = '~' AND (cl OR regexp_matches(l1, '[0-9]')) AND (cr OR regexp_matches(r1, '[0-9]')) AND (cl OR cr) AND NOT (regexp_matches(r1, '[0-9]') AND NOT regexp_matches(l1, '[0-9]')))
OR (ch = '-' AND l1 <> '-' AND r1 <> '-' AND cl AND cr AND NOT regexp_matches(l, '(^|[\r\n])[ \t]*$'))"""
)
def range_marks(spark, sf_dir):
    return Q.marks(overlay.documents(spark, sf_dir), Q.ranges)


@_query(
    rf"""WITH {_CHARS}, u AS (SELECT doc_id, pos, ch, lead(ch, 1) OVER w AS c1, lead(ch, 2) OVER w AS c2, lead(ch, 3) OVER w AS c3, lead(ch, 4) OVER w AS c4, lead(ch, 5) OVER w AS c5 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
v AS (SELECT doc_id, pos, ch <> c1 AS differ, ch || c1 || c2 AS u3, c3 || c4 || c5 AS v3, ch || c1 AS u2, c2 || c3 AS v2 FROM u)
SELECT doc_id, pos, CASE WHEN u3 = v3 AND regexp_matches(u3, '^[{X.IDEOGRAPH}]{{3}}$') THEN u3 ELSE u2 END AS unit FROM v
WHERE (u3 = v3 AND regexp_matches(u3, '^[{X.IDEOGRAPH}]{{3}}$')) OR (u2 = v2 AND regexp_matches(u2, '^[{X.IDEOGRAPH}]{{2}}$') AND differ)"""
)
def repeated_units(spark, sf_dir):
    return C.repeated_units(overlay.documents(spark, sf_dir))


@_query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS w FROM documents), p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM w),
n AS (SELECT doc_id, a, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY i) AS s, lead(a, 2) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM p)
SELECT doc_id, count(*) AS n_repeats FROM n WHERE regexp_matches(a, '^[A-Za-z0-9]{3,}$') AND regexp_matches(b, '^[A-Za-z0-9]{3,}$') AND lower(a) = lower(b) AND regexp_matches(s, '^([ \t]+|[ \t]*\r?\n[ \t]*)$') GROUP BY doc_id"""
)
def latin_repetitions(spark, sf_dir):
    return S.latin_repetitions(_raw(spark, sf_dir)).withColumn("n_repeats", F.col("n_repeats").cast("long"))


@_query(
    f"WITH {overlay.SQL}, n AS (SELECT doc_id, text, length(text) - length(translate(text, '{X.SIMPLIFIED_ONLY}', '')) AS s, length(text) - length(translate(text, '{X.TRADITIONAL_ONLY}', '')) AS t FROM d) SELECT doc_id, CASE WHEN s > t THEN 'simplified' WHEN t > s THEN 'traditional' ELSE 'unknown' END AS script, CASE WHEN s > t THEN translate(text, '{X.SIMPLIFIED_ONLY}', '{X.TRADITIONAL_ONLY}') ELSE text END AS converted FROM n"
)
def script_and_conversion(spark, sf_dir):
    return overlay.documents(spark, sf_dir).select("doc_id", X.script(F.col("text")).alias("script"), X.auto_traditional(F.col("text")).alias("converted"))


@_query(f"WITH {overlay.SQL} SELECT doc_id, translate(text, '０１２３４５６７８９', '0123456789') AS text FROM d WHERE text <> translate(text, '０１２３４５６７８９', '0123456789')")
def full_width_digits(spark, sf_dir):
    docs = overlay.documents(spark, sf_dir)
    return docs.where(F.col("text") != X.half_width_digits(F.col("text"))).select("doc_id", X.half_width_digits(F.col("text")).alias("text"))


@_query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest, count(*) FILTER (trim(line) = '') AS n_blank FROM l GROUP BY doc_id")
def line_table(spark, sf_dir):
    lines = _raw(spark, sf_dir).where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.array_max(F.transform("l", F.length)).alias("longest"), F.size(F.filter("l", lambda x: F.trim(x) == "")).cast("long").alias("n_blank"))


@_query(rf"WITH {overlay.SQL} SELECT doc_id, generate_subscripts(p, 1) - 1 AS paragraph, unnest(p) AS body FROM (SELECT doc_id, string_split_regex(text, '\n[ \t\r]*\n') AS p FROM d)")
def paragraph_table(spark, sf_dir):
    return S.paragraphs(overlay.documents(spark, sf_dir))


@_query(rf"WITH {overlay.SQL}, s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^。！？；\n]+[。！？；]?')) AS sentence FROM d) SELECT doc_id, count(*) AS n_sentences, sum(length(sentence))::BIGINT AS chars FROM s WHERE trim(sentence) <> '' GROUP BY doc_id")
def sentence_table(spark, sf_dir):
    found = overlay.documents(spark, sf_dir).select("doc_id", F.filter(F.regexp_extract_all("text", F.lit("[^。！？；\n]+[。！？；]?"), F.lit(0)), lambda x: F.trim(x) != "").alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.length(F.array_join("s", "")).cast("long").alias("chars"))


@_query(rf"WITH {overlay.SQL}, p AS (SELECT doc_id, unnest(string_split_regex(text, '\n[ \t\r]*\n')) AS body FROM d) SELECT doc_id, count(*) AS n_paragraphs FROM p WHERE length(body) - length(replace(body, '—', '')) >= 3 GROUP BY doc_id HAVING count(*) >= 3")
def dash_overuse(spark, sf_dir):
    return S.dashes(overlay.documents(spark, sf_dir))


@_query(f"WITH {overlay.SQL}, n AS (SELECT doc_id, text, length(text) - length(replace(text, '你', '')) AS a, length(text) - length(replace(text, '您', '')) AS b FROM d) SELECT doc_id, CASE WHEN a < b THEN '你' ELSE '您' END AS found, CASE WHEN a < b THEN instr(text, '你') ELSE instr(text, '您') END - 1 AS pos FROM n WHERE a > 0 AND b > 0")
def mixed_address(spark, sf_dir):
    return S.mixed_address(overlay.documents(spark, sf_dir))


@_query(rf"WITH {overlay.SQL}, q AS (SELECT doc_id, string_split_regex(text, '\n[ \t\r]*\n') AS p FROM d), p AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS paragraph, unnest(p) AS body FROM q), n AS (SELECT *, length(body) - length(replace(body, '被', '')) - len(regexp_extract_all(body, '{"|".join(S.PASSIVES)}')) AS n FROM p) SELECT doc_id, paragraph, n AS n_passives FROM n WHERE length(body) >= 20 AND n > greatest(ceil(length(body) / 100.0 * 2), 2)")
def passive_density(spark, sf_dir):
    return S.passive_density(overlay.documents(spark, sf_dir))


@_query(rf"WITH {overlay.SQL}, p AS (SELECT doc_id, unnest(string_split_regex(text, '[，、。；：！？,;:!?\n]')) AS clause FROM d) SELECT doc_id, max(length(clause) - length(replace(clause, '的', ''))) AS chain FROM p GROUP BY doc_id HAVING max(length(clause) - length(replace(clause, '的', ''))) >= 4")
def particle_chains(spark, sf_dir):
    return S.particle_chains(overlay.documents(spark, sf_dir))


@_query(
    rf"""WITH {overlay.SQL}, q AS (SELECT doc_id, regexp_extract_all(text, '[^。！？；\n]+[。！？；]?') AS p FROM d), s AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS n, unnest(p) AS sentence FROM q),
m AS (SELECT doc_id, n, regexp_matches(trim(sentence), '^({"|".join(S.PRONOUNS)})') AS hit FROM s WHERE trim(sentence) <> ''), i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM m)
SELECT doc_id, count(*) AS n_sentences, min(n) AS first FROM i WHERE hit GROUP BY doc_id, island HAVING count(*) >= 3"""
)
def pronoun_runs(spark, sf_dir):
    return S.pronoun_runs(overlay.documents(spark, sf_dir))


@_query(f"WITH {overlay.SQL}, p(phrase) AS (VALUES {', '.join(chr(40) + chr(39) + x + chr(39) + chr(41) for x in S.STOCK_PHRASES)}), n AS (SELECT doc_id, phrase, (length(text) - length(replace(text, phrase, ''))) // length(phrase) AS n, length(text) AS chars FROM d, p) SELECT doc_id, phrase, n, 1000.0::DOUBLE * n / chars AS density FROM n WHERE n > 0")
def phrase_density(spark, sf_dir):
    return S.phrase_density(overlay.documents(spark, sf_dir))


@_query(
    f"""WITH {overlay.SQL}, q AS (SELECT doc_id, string_split(text, '，') AS p FROM d), s AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS i, len(p) AS n, unnest(p) AS part FROM q), f AS (SELECT doc_id, i, length(trim(part)) BETWEEN 1 AND 4 AS short FROM s WHERE i > 0 AND i < n - 1),
m AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM f) SELECT doc_id, count(*) AS n_segments, min(i) AS first FROM m WHERE short GROUP BY doc_id, island HAVING count(*) >= 2"""
)
def comma_runs(spark, sf_dir):
    return S.comma_runs(overlay.documents(spark, sf_dir))


@_query(
    """WITH g AS (SELECT doc_id, length(text) AS chars, list_transform(string_split(text, ','), lambda p: length(p) + 1) AS gaps FROM documents), n AS (SELECT doc_id, chars, len(gaps) - 1 AS n, gaps[2:len(gaps) - 1] AS g FROM g WHERE len(gaps) > 1),
m AS (SELECT *, list_sum(g)::DOUBLE / len(g) AS m FROM n) SELECT doc_id, n, 1000.0::DOUBLE * n / chars AS density, CASE WHEN n >= 10 THEN sqrt(list_sum(list_transform(g, lambda x: (x - m) * (x - m))) / len(g)) / m END AS cv FROM m"""
)
def punctuation_profile(spark, sf_dir):
    return S.punctuation_profile(_raw(spark, sf_dir))


@_query(r"""SELECT page_id, lower(regexp_extract(html, '<html[^>]*\slang=["'']?([A-Za-z-]+)', 1)) AS lang, regexp_matches(lower(regexp_extract(html, '<html[^>]*\slang=["'']?([A-Za-z-]+)', 1)), '^(zh|yue|cmn|nan|hak|wuu|lzh)(-|$)') AS is_chinese FROM pages""")
def html_languages(spark, sf_dir):
    return S.html_languages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query(rf"WITH {overlay.SQL}, f AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9])([A-Z](?: [A-Z])+)(?:$|[^A-Za-z0-9])', 1)) AS found FROM d) SELECT doc_id, found, replace(found, ' ', '') AS suggestion FROM f WHERE length(found) > 3 OR replace(found, ' ', '') IN ({', '.join(repr(x) for x in S.TWO_LETTERS)})")
def spaced_acronyms(spark, sf_dir):
    return S.spaced_acronyms(overlay.documents(spark, sf_dir))


@_query(
    rf"""WITH {_CHARS}, m AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, ch ORDER BY pos) AS island FROM c WHERE ch IN ('.', '。', '…')), g AS (SELECT doc_id, ch, min(pos) AS pos, count(*) AS n FROM m GROUP BY doc_id, ch, island HAVING (ch <> '…' AND count(*) >= 3) OR (ch = '…' AND count(*) = 1)),
x AS (SELECT g.*, substr(text, 1, pos) AS before, substr(text, pos + n + 1) AS after FROM g JOIN d ON d.doc_id = g.doc_id), y AS (SELECT *, list_extract(string_split_regex(before, '[\r\n]'), -1) AS prefix, regexp_matches(before, '[{Q.BESIDE}][\s\x{{3000}}]*$') OR regexp_matches(after, '^[\s\x{{3000}}]*[{Q.BESIDE}]') AS near FROM x)
SELECT doc_id, pos, repeat(ch, n::INTEGER) AS found, '……' AS suggestion FROM y WHERE ch = '。' OR (near AND (ch = '…' OR NOT (regexp_matches(prefix, '=\s*$') OR regexp_matches(prefix, '^\s*(//|/\*)') OR (n >= 5 AND regexp_matches(after, '^ *[0-9]')))))"""
)
def ellipses(spark, sf_dir):
    return Q.marks(overlay.documents(spark, sf_dir), Q.ellipses)


# Addresses go first, then paths, which hold no address here; what is left of a text has names outside both.
@_query(r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '[a-zA-Z0-9+.\-]*://[^\s「」『』《》]+', ' ', 'g'), '(?:\.\.?/|/)[^\s「」『』《》]+', ' ', 'g'), '@[A-Za-z0-9_]+')) AS found FROM documents) SELECT doc_id, count(*) AS n, sum(length(found))::BIGINT AS chars FROM f GROUP BY doc_id""")
def mentions(spark, sf_dir):
    return S.mentions(_raw(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@_query(
    f"""WITH {_HITS}, s AS (SELECT doc_id, greatest(pos - 3, 0) AS a, pos + length(found) + 3 AS b FROM issues), o AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT doc_id, min(a) AS start_at, max(b) AS end_at FROM i GROUP BY doc_id, island"""
)
def mask_union(spark, sf_dir):
    spans = _issues(spark, sf_dir).select("doc_id", F.greatest(F.col("pos") - 3, F.lit(0)).alias("start"), (F.col("pos") + F.length("found") + 3).alias("end"))
    return L.union_of(spans).select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@_query(f"WITH {_HITS} SELECT doc_id, pos, found FROM issues WHERE NOT (pos < 12 AND pos + length(found) > 6)")
def masked_issues(spark, sf_dir):
    found = _issues(spark, sf_dir)
    mask = overlay.documents(spark, sf_dir).select("doc_id", F.lit(6).alias("start"), F.lit(12).alias("end"))
    return L.without_mask(found, mask).select("doc_id", "pos", "found")


@_query(
    f"""WITH {_HITS}, e AS (SELECT doc_id, found FROM issues WHERE rule_type = 'cross_strait'), p AS (SELECT doc_id, found FROM issues WHERE severity <> 'info' AND doc_id % 3 <> 0), b AS (SELECT DISTINCT e.doc_id, e.found FROM e JOIN p ON e.doc_id = p.doc_id AND e.found = p.found),
n AS (SELECT (SELECT count(*) FROM b) AS tp, (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS np, (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS ne), clean AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM e))
SELECT tp::DOUBLE / np AS precision, tp::DOUBLE / ne AS recall, (SELECT count(*) FROM clean WHERE doc_id IN (SELECT doc_id FROM p))::DOUBLE / (SELECT count(*) FROM clean) AS false_positive_rate FROM n"""
)
def corpus_rates(spark, sf_dir):
    """Expected: the regional findings; predicted: warnings and errors of two thirds of the documents."""
    issues = _issues(spark, sf_dir).select("doc_id", F.col("found").alias("key"), "rule_type", "severity")
    expected = issues.where("rule_type = 'cross_strait'").select(F.col("doc_id").alias("id"), "key")
    predicted = issues.where("severity <> 'info' and doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), "key")
    dirty = expected.select("id").distinct().withColumn("dirty", F.lit(True))
    cases = _raw(spark, sf_dir).select(F.col("doc_id").alias("id")).join(dirty, "id", "left").select("id", F.col("dirty").isNull().alias("clean"), F.lit(1).alias("weight"))
    return D.rates(cases, expected, predicted).select("precision", "recall", "false_positive_rate")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_issues(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from glyphmill.plans import detectors, marks, more  # noqa: F401  (they add their queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from glyphmill.plans import detectors, marks, more  # noqa: F401  (they add their queries)

    return dict(_SQL)
