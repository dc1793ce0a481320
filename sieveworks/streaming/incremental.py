"""Checks of single documents over a stream of arriving files or rows.

Checks that look at one document only are stateless maps, so the same transforms run on a stream; duplicates among
arriving documents are kept out by a watermarked state of digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveworks.functions import text as T
from sieveworks.operators import dedup
from sieveworks.plans import scan


def document_findings(batch: DataFrame, options: scan.Options) -> DataFrame:
    """Findings of the checks that need no other document."""
    return scan.findings(batch, options, only=["extraction", "chunking", "pii"])


def first_copies(stream: DataFrame, delay: str = "7 days", at: str = "loaded_at") -> DataFrame:
    """Documents whose normalised words did not arrive before, within ``delay``; short ones pass."""
    keyed = dedup.keyed(stream.withWatermark(at, delay))
    return keyed.withColumn("digest", F.coalesce("digest", F.concat(F.lit("path:"), "path"))).dropDuplicatesWithinWatermark(["digest"])


def volume(stream: DataFrame, width: str = "1 day", delay: str = "7 days", at: str = "loaded_at") -> DataFrame:
    """Documents and words that arrived in each window and format; late rows count until the watermark passes."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), "fmt").agg(F.count(F.lit(1)).alias("documents"), F.sum(T.word_count("text")).alias("words"))


def run(stream: DataFrame, out: str, checkpoint: str, options: scan.Options) -> StreamingQuery:
    """Appends each micro-batch's findings as a table, once per batch: a repeated batch replaces its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        document_findings(batch, options).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
