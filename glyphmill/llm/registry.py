"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import contamination, licenses, lines, minhash, mixing, mtree, quality, secrets, tokens, warc
from glyphmill.llm.session import checkpointed, table


def op1_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.scaled(table(spark, sf_dir, "embeddings"))
    return mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.joined("base_spans").cast("binary"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
        F.array_join(F.transform("random", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"), r["encoding"], r["step"].cast("string"))), ",").alias("random"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least=lines.MIN_WORDS)
    return out.select(
        "doc_id",
        "n_lines",
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matched(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "canonical_sha256", "license_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = contamination.n_hit().cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mixed(docs, columns=["doc_id", "lang", "source"]).select("doc_id", "domain", "lang", "source", F.col("epoch").cast("long").alias("epoch"), "n_tokens")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.scratch(spark)
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = checkpointed(warc.with_originals(warc.read_archives(spark, path)))
    warc.delete(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    third, half = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    edit = lambda a, b, new: F.struct(a.alias("start"), b.alias("end"), F.lit(new).alias("replacement"))
    # An insertion, a deletion and a change at the end, in this order.
    edits = F.array(edit(third, third, " an edit"), edit(half, half + 20, ""), edit(n - 5, n + 8, "the end."))
    return tokens.counted(docs.withColumn("edits", edits)).select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_encoded_again")


def op10_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out("doc_id")))
    out = quality.scored(docs, model)
    return out.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_mtree_top_k, op2_secret_scan, op3_line_dedup, op4_license_scan, op5_decontamination, op6_source_mixing, op7_minhash_near_dedup, op8_warc_revisits, op9_token_counts, op10_quality_mil]
    return {f.__name__: f for f in own}


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _mixing_sql() -> str:
    case = lambda column, table_: "CASE " + column + "".join(f" WHEN '{k}' THEN {w}" for k, w in table_.items()) + f" ELSE {mixing.DEFAULT_WEIGHT} END"

    def fill(name: str, source: str, parent: str, child: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}_1 AS (SELECT *, budget - coalesce(sum(capacity) OVER before, 0) AS room, sum(weight) OVER ({by}) - coalesce(sum(weight) OVER before, 0) AS heavy
  FROM {source} WINDOW before AS ({by} ORDER BY capacity::DOUBLE / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_2 AS (SELECT *, max(CASE WHEN room::HUGEINT * weight < capacity::HUGEINT * heavy THEN room END) OVER ({by}) AS top_room,
  max(CASE WHEN room::HUGEINT * weight < capacity::HUGEINT * heavy THEN heavy END) OVER ({by}) AS top_heavy FROM {name}_1),
{name} AS (SELECT * EXCLUDE (budget), CASE WHEN room::HUGEINT * weight < capacity::HUGEINT * heavy THEN (top_room::HUGEINT * weight // top_heavy)::BIGINT ELSE capacity::BIGINT END AS budget FROM {name}_2)"""

    # Domains of source names: crc32 has no SQL here, so the names' domains are listed.
    import zlib

    names = {f"src{i}": zlib.crc32(f"src{i}".encode()) % 4 for i in range(100)}
    domain = "CASE source " + " ".join(f"WHEN '{k}' THEN 'domain{d}'" for k, d in names.items()) + " END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {domain} AS domain, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, {mixing.EPOCHS} * sum(n)::BIGINT AS capacity FROM d GROUP BY ALL),
dom_0 AS (SELECT domain, sum(capacity)::BIGINT AS capacity, {case("domain", mixing.DOMAIN_WEIGHTS)} AS weight, (SELECT floor({mixing.SHARE} * sum(tokens))::BIGINT FROM leaves) AS budget FROM leaves GROUP BY domain),
{fill("dom", "dom_0", "", "domain")},
lan_0 AS (SELECT l.domain, l.lang, sum(l.capacity)::BIGINT AS capacity, {case("l.lang", mixing.LANGUAGE_WEIGHTS)} AS weight, any_value(dom.budget) AS budget FROM leaves l JOIN dom ON l.domain = dom.domain GROUP BY l.domain, l.lang),
{fill("lan", "lan_0", "domain", "lang")},
src_0 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.capacity, {mixing.DEFAULT_WEIGHT} AS weight, lan.budget FROM leaves l JOIN lan ON l.domain = lan.domain AND l.lang = lan.lang),
{fill("src", "src_0", "domain, lang", "source")},
reads AS (SELECT d.doc_id, d.domain, d.lang, d.source, d.n, e.epoch, s.budget // s.tokens AS whole, s.budget % s.tokens AS part
  FROM d JOIN src s ON d.domain = s.domain AND d.lang = s.lang AND d.source = s.source JOIN (SELECT unnest(range(1, {mixing.EPOCHS} + 2)) AS epoch) e ON e.epoch <= s.budget // s.tokens + 1 WHERE s.tokens > 0),
placed AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{mixing.SEED}|' || epoch || '|' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM reads)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n AS n_tokens FROM placed WHERE epoch <= whole OR (part > 0 AND upto <= part)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mtree_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
        "op4_license_scan": f"""
WITH known AS (SELECT sha256({licenses.sql("body")}) AS digest, min(license_id) AS license_id FROM (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in licenses.KNOWN.items())}) t(license_id, body) GROUP BY 1),
d AS (SELECT doc_id, sha256({licenses.sql("text")}) AS canonical_sha256 FROM documents)
SELECT d.doc_id, d.canonical_sha256, known.license_id FROM d LEFT JOIN known ON d.canonical_sha256 = known.digest
""",
        "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
grams AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n),
hits AS (SELECT places.doc_id, places.p, places.n, grams.item_id FROM places JOIN grams ON places.n = grams.n AND array_to_string(list_slice(places.w, places.p, places.p + places.n - 1), ' ') = grams.g),
counted AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted c ON d.doc_id = c.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id
""",
        "op6_source_mixing": _mixing_sql(),
        "op8_warc_revisits": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to FROM r
""",
    }
