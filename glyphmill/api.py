"""The library's front: a linter over DataFrames, one checked call with named settings, SQL functions, a command line."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import convert as C
from glyphmill.operators import decisions as D
from glyphmill.operators import fixes as FX
from glyphmill.operators import judgement as J
from glyphmill.operators import lexical as L
from glyphmill.operators import scan as SN
from glyphmill.operators import scores as SC
from glyphmill.operators import style as S
from glyphmill.sources import files, sinks

PROFILES = {"base": L.BASE, "strict": L.STRICT, "everything": L.EVERYTHING}


class Linter:
    """Rules compiled once, for any number of tables: ``scan``, ``fix``, ``judge``, ``score``."""

    def __init__(self, rules: DataFrame, profile: str | L.Profile = "everything", stance: str = "roc_centric", words: set[str] | None = None):
        chosen = PROFILES[profile] if isinstance(profile, str) else profile
        self.profile = profile if isinstance(profile, str) and profile in J.PREFERRED else "base"
        self.scanner = L.Scanner(L.collected(rules, replace(chosen, stance=stance)), words)

    def scan(self, docs: DataFrame, mask: str | None = None) -> DataFrame:
        return L.issues(docs, self.scanner, mask=mask)

    def scan_as(self, docs: DataFrame, content_type: str = "plain") -> DataFrame:
        """With the mask of a content type: plain, markdown, markdown-scan-code or yaml."""
        from glyphmill.operators import masks

        return L.issues(masks.with_mask(docs, content_type), self.scanner, mask="mask")

    def whole(self, docs: DataFrame, content_type: str = "plain", off: tuple[str, ...] = ()) -> DataFrame:
        """Everything that is found, by rules and all detectors."""
        return SN.scanned(docs, self.scanner, content_type, off)

    def fix(self, docs: DataFrame, tier: str = "lexical_safe", mask: str | None = None) -> DataFrame:
        return FX.fixed(docs, self.scanner, tier, mask)

    def judge(self, docs: DataFrame) -> DataFrame:
        return J.disambiguated(docs, self.scanner, self.profile)

    def score(self, docs: DataFrame, domain: str = "general") -> DataFrame:
        return SC.scorecard(docs, self.scanner, domain)


#: Settings of ``check`` with what they may be (None: any value of the default's type).
SETTINGS: dict[str, tuple] = {
    "profile": ("everything", list(PROFILES)),
    "stance": ("roc_centric", ["roc_centric", "international", "neutral"]),
    "content_type": ("plain", ["plain", "markdown", "markdown-scan-code", "yaml"]),
    "fix": ("none", FX.TIERS),
    "output": ("full", sinks.MODES),
    "fix_output": ("full", ["full", "search_replace", "patch"]),
    "max_errors": (None, None),
    "max_warnings": (None, None),
    "ignore_terms": ((), None),
    "domain": ("general", list(S.DOMAINS)),
    "detect_style": (False, None),
    "consistency": (False, None),
    "include_stats": (False, None),
    "explain": (False, None),
}


def check(docs: DataFrame, rules: DataFrame, **settings) -> dict[str, DataFrame]:
    """All results of one call over a table: ``issues``, ``report`` and, as asked, ``fixed``, ``diff``, ``gate``, ``scores``,
    ``consistency``, ``stats``.  Unknown settings, and values that a setting doesn't take, are errors."""
    for name, value in settings.items():
        if name not in SETTINGS:
            raise ValueError(f"unknown setting {name}")
        if SETTINGS[name][1] is not None and value not in SETTINGS[name][1]:
            raise ValueError(f"{name} is one of {', '.join(SETTINGS[name][1])}")
    s = {name: settings.get(name, default) for name, (default, _) in SETTINGS.items()}
    linter = Linter(rules, s["profile"], s["stance"])
    issues = linter.scan_as(docs, s["content_type"])
    if s["ignore_terms"]:
        issues = D.demoted(issues, docs.sparkSession.createDataFrame([(t,) for t in s["ignore_terms"]], "term string"))
    out = {"issues": J.explained(issues) if s["explain"] else issues, "report": sinks.output(issues, docs, s["output"])}
    if s["fix"] != "none":
        from glyphmill.operators import masks

        out["fixed"] = linter.fix(masks.with_mask(docs, s["content_type"]), s["fix"], "mask")
        if s["fix_output"] != "full":
            out["diff"] = (sinks.search_replace if s["fix_output"] == "search_replace" else sinks.patches)(out["fixed"], docs)
    if s["max_errors"] is not None or s["max_warnings"] is not None:
        out["gate"] = D.gate(issues, 10**9 if s["max_errors"] is None else s["max_errors"], 10**9 if s["max_warnings"] is None else s["max_warnings"])
    if s["detect_style"]:
        out["scores"] = linter.score(docs, s["domain"])
    if s["consistency"]:
        out["consistency"] = SC.consistency(docs, linter.scanner)
    if s["include_stats"]:
        out["stats"] = SC.totals(issues, docs)
    return out


def register(spark: SparkSession, rules: DataFrame) -> None:
    """SQL functions ``detect_script(text)``, ``s2t(text)``, ``ai_score(text)`` and the table function ``lint_issues(text)``."""
    scanner, converter = L.scanner(rules), C.Converter.of(C.dictionary(C.sample(spark)))
    machine = lambda t: None if t is None else (r := SC.machine_score(t, [], S.found_in(t, []))) and r["score"]
    script = lambda t: None if t is None else "simplified" if X.is_simplified(t) else "traditional" if any(c in t for c in X.TRADITIONAL_ONLY) else "unknown"
    spark.udf.register("s2t", lambda t: None if t is None else converter(t), "string")
    spark.udf.register("ai_score", machine, "double")
    spark.udf.register("detect_script", script, "string")

    class Lint:
        def eval(self, text: str):
            for r in scanner.scan(text or ""):
                yield r[0], r[5], "/".join(r[6]), r[7], r[8]

    spark.udtf.register("lint_issues", F.udtf(Lint, returnType="pos int, found string, suggestion string, rule_type string, severity string"))


def main(args: list[str] | None = None) -> int:
    """``lint PATH``, ``convert PATH OUT``, ``packs RULES``: 0 if all is well, 1 if the gate fails, 2 if a file can't be read."""
    parser = argparse.ArgumentParser(prog="glyphmill")
    sub = parser.add_subparsers(dest="command", required=True)
    lint = sub.add_parser("lint")
    lint.add_argument("path")
    lint.add_argument("--rules", required=True)
    lint.add_argument("--format", choices=["json", "human", "tabular", "agent", "sarif"], default="human")
    lint.add_argument("--exclude", action="append")
    lint.add_argument("--changed", nargs="*")
    lint.add_argument("--max-errors", type=int)
    lint.add_argument("--max-warnings", type=int)
    lint.add_argument("--fix", choices=FX.TIERS, default="none")
    lint.add_argument("--out")
    conv = sub.add_parser("convert")
    conv.add_argument("path")
    conv.add_argument("out")
    conv.add_argument("--rules", required=True)
    listing = sub.add_parser("packs")
    listing.add_argument("rules")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    rules = files.rules(spark, a.rules)
    if a.command == "packs":
        from glyphmill.sources import stores

        stores.packs(rules).show()
        return 0
    read = files.from_stream(spark) if a.path == "-" else files.scan_files(spark, a.path, getattr(a, "exclude", None))
    if getattr(a, "changed", None):
        read = files.changed(read, a.changed)
    docs = read.where("text is not null").select(F.col("path").alias("doc_id"), "text")
    scanner = L.scanner(rules)
    if a.command == "convert":
        sinks.write_fixed(C.fixpoint(docs, C.Converter.of(C.dictionary(C.sample(spark))), scanner), a.out)
        return 0
    issues = L.issues(docs, scanner)
    report = {"json": lambda: sinks.json_report(issues, docs), "human": lambda: sinks.human_report(issues), "tabular": lambda: sinks.tabular_report(issues), "agent": lambda: sinks.agent_report(issues, docs), "sarif": lambda: sinks.sarif_report(issues)}[a.format]()
    if a.out:
        report.write.mode("overwrite").json(a.out)
    else:
        report.show(10_000, truncate=False)
    if a.fix != "none" and a.out:
        sinks.write_fixed(FX.fixed(docs, scanner, a.fix), f"{a.out}-fixed")
    broken = read.where("unreadable or too_large").limit(1).count()
    gate = D.gate(issues, 10**9 if a.max_errors is None else a.max_errors, 10**9 if a.max_warnings is None else a.max_warnings, broken)
    return gate.first().exit_code


if __name__ == "__main__":
    sys.exit(main())
