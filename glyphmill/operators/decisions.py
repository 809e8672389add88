"""Decisions over issues: stores of terms, baselines, gates, groups, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators import lexical as L


def demoted(issues: DataFrame, terms: DataFrame) -> DataFrame:
    """Issues whose ``found`` is among ``terms(term)`` become Info."""
    known = terms.select(F.col("term").alias("found")).distinct().withColumn("_known", F.lit(True))
    return issues.join(known, "found", "left").withColumn("severity", F.when(F.col("_known"), "info").otherwise(F.col("severity"))).drop("_known")


def latest_decisions(memory: DataFrame) -> DataFrame:
    """The last decision for each term of a translation memory ``(found, user_chose, timestamp)``."""
    last = F.row_number().over(Window.partitionBy("found").orderBy(F.desc("timestamp"), F.desc("user_chose")))
    return memory.withColumn("_n", last).where("_n = 1").drop("_n")


#: Types that a translation memory has no say in.
IMMUNE = ["punctuation", "case", "variant", "grammar", "ai_style"]


def with_memory(issues: DataFrame, memory: DataFrame, banned: DataFrame | None = None) -> DataFrame:
    """Terms that the user last chose to keep become Info; orthographic and machine-style issues are immune, and so are
    terms that a glossary ``banned(term)`` forbids."""
    kept = latest_decisions(memory).where("user_chose = found").select("found", F.lit(True).alias("_kept"))
    if banned is not None:
        kept = kept.join(banned.select(F.col("term").alias("found")), "found", "left_anti")
    immune = F.col("rule_type").isin(IMMUNE)
    return issues.join(kept, "found", "left").withColumn("severity", F.when(F.coalesce("_kept", F.lit(False)) & ~immune, "info").otherwise(F.col("severity"))).drop("_kept")


def with_glossary(issues: DataFrame, glossary: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """``glossary(term, kind)``: proper nouns are no issues, banned terms are errors.

    With ``docs``, each place of a banned term that lies in an issue makes that (its first) an error, and each other
    place is an error of its own; masks apply to these as to any findings (``lexical.without_mask``).
    """
    terms = glossary.select(F.col("term").alias("found"), "kind")
    left = issues.join(terms.where("kind = 'proper_noun'"), "found", "left_anti")
    if docs is not None:
        return _with_banned(left, docs, [r[0] for r in glossary.where("kind = 'banned' and term <> ''").select("term").distinct().collect()])
    banned = terms.where("kind = 'banned'").select("found", F.lit(True).alias("_banned")).distinct()
    return left.join(banned, "found", "left").withColumn("severity", F.when(F.col("_banned"), "error").otherwise(F.col("severity"))).drop("_banned")


def _with_banned(issues: DataFrame, docs: DataFrame, banned: list[str]) -> DataFrame:
    # Places of every banned term by itself: one may lie in another.
    spots = None
    for term in banned:
        own = L.hits(docs, [term])
        spots = own if spots is None else spots.union(own)
    if spots is None:
        return issues
    spots = spots.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("pos", "byte_offset", "line", "col", "found")])
    holds = (F.col("pos") <= F.col("_pos")) & (F.col("_pos") + F.length("_found") <= F.col("pos") + F.length("found"))
    over = spots.join(issues, "doc_id").where(holds).groupBy("doc_id", "_pos", "_found").agg(F.min(F.struct("pos", "found")).alias("_of"))
    raised = over.select("doc_id", "_of.pos", "_of.found").distinct().withColumn("_raised", F.lit(True))
    new = spots.join(over, ["doc_id", "_pos", "_found"], "left_anti")
    made = {**{c: F.col(f"_{c}") for c in ("pos", "byte_offset", "line", "col", "found")}, "size": F.length("_found"), "suggestions": F.array(), "clues": F.array(), "rule_type": F.lit("cross_strait"), "severity": F.lit("error")}
    added = new.select(*[(F.col(f.name) if f.name == "doc_id" else made.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in issues.schema])
    kept = issues.join(raised, ["doc_id", "pos", "found"], "left").withColumn("severity", F.when(F.col("_raised"), "error").otherwise(F.col("severity")))
    return kept.select(*issues.columns).union(added)


def fingerprint():
    """A finding's fingerprint, which does not hang on its position."""
    return F.sha2(F.concat_ws("|", "rule_type", "found", F.col("doc_id").cast("string")).cast("binary"), 256)


def beyond_baseline(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    return issues.withColumn("fp", fingerprint()).join(baseline.select("fp").distinct(), "fp", "left_anti").drop("fp")


def summary(issues: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("doc_id").agg(count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"))


def gate(issues: DataFrame, max_errors: int, max_warnings: int, unreadable: int = 0) -> DataFrame:
    """One row: totals, whether they pass, and what a command returns: 0, 1 if they don't, 2 if a file couldn't be read."""
    count = lambda s: F.count_if(F.col("severity") == s)
    totals = issues.agg(count("error").alias("errors"), count("warning").alias("warnings"))
    return totals.withColumn("passed", (F.col("errors") <= max_errors) & (F.col("warnings") <= max_warnings)).withColumn("exit_code", F.when(F.lit(unreadable) > 0, 2).when(F.col("passed"), 0).otherwise(1))


def grouped(issues: DataFrame) -> DataFrame:
    """Equal findings over all documents: their count, in how many documents, their first line, and how many columns."""
    key = ["found", "rule_type", "severity", F.array_join("suggestions", "/").alias("suggestion")]
    groups = issues.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min("line").alias("first_line"), F.countDistinct("col").alias("n_cols"))
    return groups


def top_issues(issues: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` gravest issues of each document, earlier ones first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "pos"))
    return issues.withColumn("rank", n).where(F.col("rank") <= k)


def coverage(issues: DataFrame, rules: DataFrame) -> DataFrame:
    both = issues.select(F.col("found").alias("matched"), F.lit(None).cast("string").alias("checked")).union(rules.select(F.lit(None).cast("string"), "from"))
    return both.agg(F.countDistinct("matched").alias("rules_matched"), F.countDistinct("checked").alias("rules_checked"))


def regional_density(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """min(1, 1000 * regional issues / characters)."""
    n = issues.where("rule_type in ('cross_strait', 'confusable')").groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = docs.select("doc_id", F.length("text").alias("chars")).join(n, "doc_id", "left")
    return joined.select("doc_id", F.least(F.lit(1.0), 1000.0 * F.coalesce("n", F.lit(0)) / F.greatest("chars", F.lit(1))).alias("density"))


def rates(cases: DataFrame, expected: DataFrame, predicted: DataFrame, fixes: DataFrame | None = None) -> DataFrame:
    """One row over a corpus: precision, recall, false-positive rate and safe-fix rate, by case and by weight.

    ``cases(id, clean, weight)``; ``expected, predicted (id, key)`` name findings; ``fixes(id, right)`` tells of each case
    that was fixed whether the result is right.  A case is a false positive if it is clean and something is predicted.
    """
    both = expected.select("id", "key", F.lit(1).alias("e")).distinct().join(predicted.select("id", "key", F.lit(1).alias("p")).distinct(), ["id", "key"], "full")
    by_case = both.groupBy("id").agg(F.count_if((F.col("e") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    rows = cases.select("id", "clean", F.col("weight").cast("double").alias("w")).join(by_case, "id", "left").na.fill(0, ["tp", "fp", "fn"])
    if fixes is not None:
        rows = rows.join(fixes.groupBy("id").agg(F.min(F.col("right").cast("int")).alias("right")), "id", "left")
    else:
        rows = rows.withColumn("right", F.lit(None).cast("int"))
    total = lambda c: F.sum(c)
    weigh = lambda c: F.sum(F.col("w") * c)
    wrong = (F.col("clean") & (F.col("fp") > 0)).cast("int")
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    clean = F.col("clean").cast("int")
    return rows.agg(
        share(total("tp"), total("tp") + total("fp")).alias("precision"),
        share(total("tp"), total("tp") + total("fn")).alias("recall"),
        share(weigh(F.col("tp")), weigh(F.col("tp")) + weigh(F.col("fp"))).alias("weighted_precision"),
        share(weigh(F.col("tp")), weigh(F.col("tp")) + weigh(F.col("fn"))).alias("weighted_recall"),
        share(total(wrong), total(clean)).alias("false_positive_rate"),
        share(weigh(wrong), weigh(clean)).alias("weighted_false_positive_rate"),
        share(total("right"), F.count("right")).alias("safe_fix_rate"),
    )


def precision_recall(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: true positives, precision and recall of ``(id)`` sets."""
    both = expected.select("id", F.lit(1).alias("e")).join(predicted.select("id", F.lit(1).alias("p")), "id", "full")
    sums = both.agg(F.sum(F.col("e") * F.col("p")).alias("tp"), F.sum("e").alias("n_expected"), F.sum("p").alias("n_predicted"))
    return sums.select("tp", F.try_divide(F.col("tp"), F.col("n_predicted")).alias("precision"), F.try_divide(F.col("tp"), F.col("n_expected")).alias("recall"))
