"""Stores that a scan reads beside its texts (JSON or TOML), the rule set's digest, caches and traces.

Every store becomes a table with a fixed schema; a file that is missing, or lines that don't parse, give no rows.
"""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.operators import lexical as L

#: Schemas of the stores.
STORES = {
    "overrides": L.RULES,
    "pack": L.RULES,
    "suppressions": "found string, reason string",
    "memory": "found string, user_chose string, timestamp string",
    "glossary": "term string, kind string",
    "baseline": "fp string",
    "judgements": "found string, rule_type string, suggestions_key string, context_hash string, profile string, ruleset string, judgement string, judged_at timestamp",
}
#: Hours that a cached scan is good for, entries and issues of one that are kept.
CACHE_HOURS, CACHE_ENTRIES, CACHE_ISSUES = 24, 2000, 2000


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A store of JSON lines, or of one JSON array."""
    if kind not in STORES:
        raise ValueError(f"stores are {', '.join(STORES)}")
    return spark.read.schema(STORES[kind]).option("multiLine", False).option("mode", "DROPMALFORMED").json(path)


def project(text: str) -> dict:
    """A project's settings from TOML: ``exclude``, ``off``, ``glossary`` and others; what is unknown is an error."""
    known = {"profile": str, "stance": str, "exclude": list, "off": list, "glossary": dict, "packs": list, "max_errors": int, "max_warnings": int, "domain": str}
    given = tomllib.loads(text)
    for key, value in given.items():
        if key not in known:
            raise ValueError(f"unknown setting {key}")
        if not isinstance(value, known[key]):
            raise ValueError(f"{key} must be a {known[key].__name__}")
    return given


def ruleset_digest(rules: DataFrame) -> DataFrame:
    """One row ``digest, n_rules``: the same for the same merged rules, whatever their order or layers."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    words = lambda c: F.coalesce(F.array_join(c, "/"), F.lit(""))
    groups = F.coalesce(F.array_join(F.transform("groups", lambda g: F.concat(F.array_join(g["clues"], "/"), F.lit(">"), F.array_join(g["to"], "/"))), ";"), F.lit(""))
    one = F.concat_ws("|", text("from"), words("to"), text("type"), text("english"), text("severity"), words("clues"), words("negative_clues"), words("tags"), words("exceptions"), words("positional"), groups, text("guard"), text("confidence"))
    return L.merged(rules).select(F.sha2(one.cast("binary"), 256).alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("digest"), F.count("*").alias("n_rules"))


def export(rules: DataFrame, path: str) -> None:
    """A pack as JSON lines, which ``read`` takes back."""
    rules.select(*[c for c in rules.columns if c not in ("layer", "ord")]).coalesce(1).write.mode("overwrite").json(path)


def imported(base: DataFrame, pack: DataFrame, layer: int) -> DataFrame:
    """``base`` with a pack as a later layer; a pack with problems is an error that names them."""
    bad = L.problems(pack).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['from']}: {r['problem']}" for r in bad))
    own = pack.withColumn("layer", F.lit(layer)).withColumn("ord", F.monotonically_increasing_id())
    return base.unionByName(own, allowMissingColumns=True).select(*base.columns)


def packs(rules: DataFrame) -> DataFrame:
    """``layer, n_rules, n_disabled`` of every layer."""
    return rules.groupBy("layer").agg(F.count("*").alias("n_rules"), F.count_if(F.coalesce("disabled", F.lit(False))).alias("n_disabled"))


def content_key(text: Column | str, settings: str) -> Column:
    """What a cached scan hangs on: the text, the rule set and the profile."""
    return F.sha2(F.concat_ws("\x1f", F.lit(settings), text).cast("binary"), 256)


def uncached(docs: DataFrame, cache: DataFrame, settings: str, now: Column) -> DataFrame:
    """Documents whose scan is not in ``cache(key, scanned_at, ...)``, or is too old."""
    fresh = cache.where(F.col("scanned_at") >= now - F.expr(f"interval {CACHE_HOURS} hours")).select(F.col("key").alias("_key")).distinct()
    return docs.withColumn("_own", content_key("text", settings)).join(fresh, F.col("_own") == F.col("_key"), "left_anti").drop("_own")


def cached(docs: DataFrame, cache: DataFrame, settings: str, now: Column) -> DataFrame:
    """``doc_id, issues`` of documents whose scan is in the cache: the latest one of each text."""
    fresh = cache.where(F.col("scanned_at") >= now - F.expr(f"interval {CACHE_HOURS} hours"))
    latest = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("scanned_at")))).where("_n = 1").select(F.col("key").alias("_key"), "issues")
    return docs.withColumn("_own", content_key("text", settings)).join(latest, F.col("_own") == F.col("_key")).select("doc_id", "issues")


def cache_entries(docs: DataFrame, issues: DataFrame, settings: str, now: Column) -> DataFrame:
    """``key, issues, scanned_at`` of scanned documents, but of those with more than CACHE_ISSUES issues."""
    found = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "found", "severity"))).alias("issues"))
    empty = F.array().cast(found.schema["issues"].dataType)
    kept = docs.select("doc_id", content_key("text", settings).alias("key")).join(found, "doc_id", "left").withColumn("issues", F.coalesce("issues", empty))
    return kept.where(F.size("issues") <= CACHE_ISSUES).select("key", "issues", now.alias("scanned_at")).dropDuplicates(["key"])


def pruned(cache: DataFrame, most: int = CACHE_ENTRIES) -> DataFrame:
    """The ``most`` latest entries."""
    return cache.orderBy(F.desc("scanned_at"), "key").limit(most)


def trace(docs: DataFrame, fixed: DataFrame, ruleset: str, now: Column) -> DataFrame:
    """``trace_id, doc_id, ruleset, input_hash, output_hash, n_applied, at``: an audit record of every document."""
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    both = docs.select("doc_id", digest(F.col("text")).alias("input_hash")).join(fixed.select("doc_id", digest(F.col("text")).alias("output_hash"), "n_applied"), "doc_id")
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(ruleset), "input_hash", "output_hash")
    return both.select(F.sha2(key.cast("binary"), 256).alias("trace_id"), "doc_id", F.lit(ruleset).alias("ruleset"), "input_hash", "output_hash", "n_applied", now.alias("at"))


def as_json(rows: list[dict]) -> str:
    """Rows as JSON lines, in a form that ``read`` takes."""
    return "".join(json.dumps(r, ensure_ascii=False, sort_keys=True) + "\n" for r in rows)
