"""Views of the driver's tables in the shape the checks expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.storage import table


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores when a scan has fewer splits than there are cores, as one small file has.

    A scan of many splits, the case at scale, is left as it is and shuffles nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, key: str, by: str = "loaded_at") -> DataFrame:
    """One row per key, the one delivered last. Rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("_row")).select(key, *(F.col("_row")[c].alias(c) for c in rest))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one page each; ``mtime`` is the file's time in seconds."""
    return spread(table(spark, sf_dir, "documents")).withColumn("mtime", F.unix_micros(F.col("modified_at")) / 1_000_000)


def readable(df: DataFrame) -> DataFrame:
    return df.filter("read_error is null")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with path and format of their file; a page delivered again counts once."""
    files = table(spark, sf_dir, "kb_files").select("file_id", "path", "fmt", "metadata", "read_error")
    return latest(table(spark, sf_dir, "pages").select("page_id", "file_id", "number", "text", "image_count", "line_offset", "loaded_at"), "page_id").join(files, "file_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their pages: those of one page, and the files whose pages are apart, joined by an empty line."""
    page = lambda text, images, n, offset: F.struct(n.cast("int").alias("number"), text.alias("text"), images.cast("int").alias("image_count"), offset.cast("int").alias("line_offset"))
    cols = ["path", "fmt", "metadata", "read_error", (F.unix_micros(F.col("modified_at")) / 1_000_000).alias("mtime")]
    single = table(spark, sf_dir, "documents").select(*cols, F.array(page(F.col("text"), F.lit(0), F.lit(1), F.lit(0))).alias("pages"))
    p = latest(table(spark, sf_dir, "pages").select("page_id", "file_id", "number", "text", "image_count", "line_offset", "loaded_at"), "page_id")
    # a file's pages are one row, as in a document that was read from its file
    joined = p.groupBy("file_id").agg(F.array_sort(F.collect_list(page(F.col("text"), F.greatest(F.coalesce("image_count", F.lit(0)), F.lit(0)), F.col("number"), F.coalesce("line_offset", F.lit(0))))).alias("pages"))
    files = table(spark, sf_dir, "kb_files").join(joined, "file_id", "left").select(*cols, F.coalesce("pages", F.array().cast(single.schema["pages"].dataType)).alias("pages"))
    return single.unionByName(files).withColumn("text", F.array_join(F.transform("pages", lambda x: F.coalesce(x.text, F.lit(""))), "\n\n"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export once per chunk, with empty keys as missing."""
    c = latest(table(spark, sf_dir, "chunks").withColumnRenamed("order", "ord"), "chunk_id")
    return c.filter("text is not null").withColumn("source", F.nullif("source", F.lit(""))).withColumn("page", F.nullif("page", F.lit("")))


def finding(
    check: str, severity: Column | str, codes: list[str], title: Column | str, path: Column | str, location: Column | str = "",
    detail: Column | str = "", fix: str = "", related: Column | None = None,
) -> list[Column]:
    """Columns of a finding row."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [
        F.lit(check).alias("check"), lit(severity).alias("severity"), F.array(*map(F.lit, codes)).alias("f_codes"), lit(title).alias("title"), lit(path).alias("path"),
        lit(location).alias("location"), lit(detail).alias("detail"), F.lit(fix).alias("fix"),
        (related if related is not None else F.array().cast("array<string>")).alias("related"),
    ]
