"""Scans of arriving text: every micro-batch is scanned by itself, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from glyphmill.operators.lexical import issues


def stream_issues(spark: SparkSession, source: str, rules: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Scans Parquet files of ``doc_id, text`` as they arrive in ``source`` and appends their issues to ``sink``."""
    docs = spark.readStream.schema("doc_id long, text string").parquet(source)

    def scan(batch: DataFrame, number: int) -> None:
        issues(batch, rules).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
