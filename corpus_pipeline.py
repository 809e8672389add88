"""A training corpus from raw documents: quality, line dedup, near-dedup, decontamination, mixing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import contamination, lines, minhash, mixing, quality
from glyphmill.llm.session import Scratch, checkpointed, semi_by_size, table

#: Percent of shingles from which documents are near duplicates here; op7's 85 is that query's own.
NEAR = 80


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and all else of a row as one column, so that other columns may have any names."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))


def _unpacked(out: DataFrame, docs: DataFrame, recount: bool = False) -> DataFrame:
    """The columns of ``docs`` again; with ``recount``, ``n_chars`` as the text now is."""
    of = {"text": F.col("text")}
    if recount and "n_chars" in docs.columns:
        of["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[(of[c] if c in of else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go.  Null and empty texts are scored as such; no rows give none."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out("doc_id")))
    return _unpacked(quality.scored(_packed(docs), model).where("score >= 0.5"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go, and documents that have lost all their words by that.

    Null texts and rows with a null doc_id stay as they are; for rows that share a doc_id see ``lines.removed_lines``.
    """
    out = lines.dedup_lines(_packed(docs), least=lines.MIN_WORDS)
    emptied = (F.size("removed_lines") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return _unpacked(out.where(~emptied), docs, True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (NEAR percent) stays: the one with the smallest doc_id.

    Rows that share a doc_id are documents of their own, and of those with equal texts one stays.  Rows with a null
    doc_id, and null, empty or blank texts, are near nothing: they stay.
    """
    named = docs.where("doc_id is not null")
    if not named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        gone = checkpointed(minhash.near_duplicates(docs, NEAR).where("not kept").select("doc_id").distinct())
        return semi_by_size(docs, gone, "doc_id", "left_anti", minhash.BROADCAST_ROWS)
    # Numbers in the order of doc_ids take their place; they are good within this checkpoint.
    once = _packed(named).withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "_hash", "text")
    rows = checkpointed(once.withColumn("_number", F.monotonically_increasing_id()))
    found = minhash.near_duplicates(rows.select(F.col("_number").alias("doc_id"), "text"), NEAR)
    gone = checkpointed(found.where("not kept").select(F.col("doc_id").alias("_number")).distinct())
    left = semi_by_size(rows, gone, "_number", "left_anti", minhash.BROADCAST_ROWS)
    left = _unpacked(left, docs)
    return left.union(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go.  Documents without words stay."""
    return _unpacked(contamination.decontaminated(_packed(docs), table(spark, sf_dir, "benchmark")), docs, True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the target weights choose: the documents' columns, ``domain, n_tokens, epoch``, which replace columns of these names."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: SQL can't express the learnt classifier; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next.

    A stage's table is deleted when the next one is written; the last one stays, for the result is read from it.
    """
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, str(k))
            if k:
                scratch.drop(str(k - 1))
    return docs
