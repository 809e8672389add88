"""Reports of issues as text, one row for each document or group, ready for any writer.

Issues are rows ``(doc_id, pos, size, byte_offset, line, col, found, suggestions, rule_type, severity, english, ...)``;
``name`` is a column with the document's name.  Nothing but equal findings of one document is brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators import judgement as J

#: Levels of a SARIF report by severity; output modes.
LEVELS = {"error": "error", "warning": "warning", "info": "note"}
MODES = ["full", "compact", "tabular", "summary"]
TOOL = "glyphmill"
SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"


def escaped(c: Column) -> Column:
    """Without tabs, line ends and lone backslashes."""
    out = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for sign, name in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def shown(first_only: bool = True, joiner: str = "|") -> Column:
    """A suggestion list as text: ``(delete)``, the English where there is none, ``first+N`` or all of several."""
    s = F.col("suggestions")
    several = F.concat(F.get(s, F.lit(0)), F.lit("+"), (F.size(s) - 1).cast("string")) if first_only else F.array_join(s, joiner)
    return F.when(F.size(s) == 0, F.coalesce("english", F.lit("?"))).when((F.size(s) == 1) & (F.get(s, F.lit(0)) == ""), "(delete)").when(F.size(s) == 1, F.get(s, F.lit(0))).otherwise(several)


def compressed(places: str) -> Column:
    """Places ``(line, col)`` as ``L1,L4:C`` where all share a column, else as ``L:C,L:C``."""
    cols = F.array_distinct(F.transform(places, lambda p: p["col"]))
    lines = F.array_join(F.transform(places, lambda p: p["line"].cast("string")), ",")
    each = F.array_join(F.transform(places, lambda p: F.concat(p["line"].cast("string"), F.lit(":"), p["col"].cast("string"))), ",")
    return F.when(F.size(cols) == 1, F.concat(lines, F.lit(":"), F.get(cols, F.lit(0)).cast("string"))).otherwise(each)


def _grouped(issues: DataFrame, by: list) -> DataFrame:
    return issues.groupBy("doc_id", *by).agg(F.array_sort(F.collect_list(F.struct("line", "col"))).alias("places"))


def json_report(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, json``: one object for every document, with counts and all issues in report order."""
    item = F.struct(F.col("byte_offset").alias("offset"), F.octet_length("found").alias("length"), "line", "col", "found", "suggestions", "rule_type", "severity", "english")
    n = lambda s: F.count_if(F.col("severity") == s)
    ordered = J.report_order(issues).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("order", item.alias("issue")))).alias("i"), n("error").alias("errors"), n("warning").alias("warnings"))
    every = docs.select("doc_id").join(ordered, "doc_id", "left")
    listed = F.transform("i", lambda x: x["issue"])
    total = F.greatest(F.coalesce(F.size("i"), F.lit(0)), F.lit(0))
    # Documents without findings have an empty list.
    kind = ordered.schema["i"].dataType.elementType["issue"].dataType.simpleString()
    found = F.coalesce(listed, F.array().cast(f"array<{kind}>"))
    whole = F.struct(F.col("doc_id").alias("file"), total.alias("total"), F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), found.alias("issues"))
    return every.select("doc_id", F.to_json(whole).alias("json"))


def human_report(issues: DataFrame) -> DataFrame:
    """``doc_id, line_text``: one line for people of each issue."""
    text = F.format_string("%d:%d: %s [%s] '%s' -> %s", "line", "col", "severity", "rule_type", "found", shown(False, ", "))
    return issues.select("doc_id", text.alias("line_text"))


def tabular_report(issues: DataFrame) -> DataFrame:
    """``doc_id, row``: tab-separated groups of equal findings; ``TABLE_HEADER`` stands once above them."""
    groups = _grouped(issues, ["found", "rule_type", "severity", shown(False, ",").alias("shown")])
    cells = [escaped(F.col("found")), escaped(F.col("shown")), "rule_type", F.upper(F.substring("severity", 1, 1)), F.size("places").cast("string"), compressed("places")]
    return groups.select("doc_id", F.concat_ws("\t", *cells).alias("row"))


TABLE_HEADER = "found\tsug\ttype\tsev\tn\tloc"


def agent_report(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, line_text``: ``<places> <tag> <found> -> <target>``, AMBIG and ``?`` where a reader has to judge, PASS for a clean document."""
    one_line = F.regexp_replace("found", "[\r\n]", " ")
    groups = _grouped(issues.withColumn("judge", J.needs_judgement(issues)), ["found", "rule_type", "severity", "judge", shown(False).alias("shown")])
    places = F.array_join(F.transform("places", lambda p: F.concat(p["line"].cast("string"), F.lit(":"), p["col"].cast("string"))), ",")
    text = F.concat_ws(" ", places, F.when(F.col("judge"), "AMBIG").otherwise(F.upper(F.substring("severity", 1, 1))), one_line, F.when(F.col("judge"), "?").otherwise("->"), "shown")
    lines = groups.select("doc_id", text.alias("line_text"))
    clean = docs.select("doc_id").join(issues.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("PASS").alias("line_text"))
    return lines.union(clean)


def sarif_results(issues: DataFrame) -> DataFrame:
    """``doc_id, result``: each issue as a SARIF result object."""
    level = F.element_at(F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (k, v)]), F.col("severity"))
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"), F.col("byte_offset").alias("byteOffset"), F.octet_length("found").alias("byteLength"))
    place = F.struct(F.struct(F.struct(F.col("doc_id").cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    message = F.struct(F.concat(F.lit("'"), F.col("found"), F.lit("' -> "), shown(False, ", ")).alias("text"))
    result = F.struct(F.concat(F.lit(f"{TOOL}/"), F.col("rule_type")).alias("ruleId"), level.alias("level"), message.alias("message"), F.array(place).alias("locations"))
    return issues.select("doc_id", F.to_json(result).alias("result"))


def sarif_report(issues: DataFrame) -> DataFrame:
    """``part, n, content``: a SARIF 2.1.0 document in parts, whose contents in order of ``part, n`` make up the document.

    Results stay rows, so a report of any size is written without bringing it to one task.
    """
    spark = issues.sparkSession
    kinds = sorted(r[0] for r in issues.select("rule_type").distinct().collect())
    import json

    rules = [{"id": f"{TOOL}/{k}", "shortDescription": {"text": f"{k} check"}} for k in kinds]
    head = json.dumps({"$schema": SCHEMA, "version": "2.1.0"})[:-1] + ', "runs": [{"tool": {"driver": ' + json.dumps({"name": TOOL, "rules": rules}) + '}, "results": ['
    ends = spark.createDataFrame([(0, 0, head), (2, 0, "]}]}")], "part int, n long, content string")
    body = sarif_results(issues).select(F.lit(1).alias("part"), F.xxhash64("doc_id", "result").alias("n"), F.col("result").alias("content"))
    return ends.union(body)


def search_replace(fixed: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, diff``: applied fixes (``fixes.fixed``) as blocks of what to search and what to put there."""
    both = fixed.select("doc_id", "fixes").join(docs.select("doc_id", F.col("text").alias("_old")), "doc_id").where(F.size("fixes") > 0)
    block = lambda f: F.concat(F.lit("<<<<<<< SEARCH\n"), F.substring(F.col("_old"), f["pos"] + 1, f["size"]), F.lit("\n======= REPLACE\n"), f["replacement"], F.lit("\n>>>>>>> END\n"))
    return both.select("doc_id", F.array_join(F.transform("fixes", block), "").alias("diff"))


def patches(fixed: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, patch``: applied fixes as tab-separated rows of byte offset, length, old and new text, the last place first."""
    both = fixed.select("doc_id", "fixes").join(docs.select("doc_id", F.col("text").alias("_old")), "doc_id").where(F.size("fixes") > 0)
    old = lambda f: F.substring(F.col("_old"), f["pos"] + 1, f["size"])
    row = lambda f: F.concat_ws("\t", F.octet_length(F.substring(F.col("_old"), F.lit(1), f["pos"])).cast("string"), F.octet_length(old(f)).cast("string"), escaped(old(f)), escaped(f["replacement"]))
    head = F.concat(F.lit("#patches="), F.size("fixes").cast("string"), F.lit("\noffset\tlength\tfound\treplacement\n"))
    return both.select("doc_id", F.concat(head, F.array_join(F.transform(F.reverse("fixes"), row), "\n"), F.lit("\n")).alias("patch"))


def write_fixed(fixed: DataFrame, path: str) -> None:
    """The fixed texts as a new table; inputs are never changed, and a failed write leaves the old table as it was."""
    fixed.select("doc_id", "text").write.mode("overwrite").parquet(path)


def output(issues: DataFrame, docs: DataFrame, mode: str = "full") -> DataFrame:
    """The result of a scan in one of MODES."""
    if mode not in MODES:
        raise ValueError(f"modes are {', '.join(MODES)}")
    if mode == "full":
        return json_report(issues, docs)
    if mode == "tabular":
        return tabular_report(issues)
    if mode == "compact":
        groups = _grouped(issues, ["found", "rule_type", "severity", shown().alias("shown")])
        return groups.select("doc_id", "found", "rule_type", "severity", "shown", F.size("places").alias("n"), compressed("places").alias("places"))
    n = lambda s: F.count_if(F.col("severity") == s)
    return docs.select("doc_id").join(issues.groupBy("doc_id").agg(F.count("*").alias("total"), n("error").alias("errors"), n("warning").alias("warnings")), "doc_id", "left").na.fill(0, ["total", "errors", "warnings"])


def ambiguous_terms(rules: DataFrame) -> DataFrame:
    """``term, english, targets``: live rules with an English meaning, the dictionary that a reader is given."""
    from glyphmill.operators.lexical import merged

    live = merged(rules).where("english is not null and english <> ''")
    return live.select(F.col("from").alias("term"), "english", F.array_join("to", "/").alias("targets"))
