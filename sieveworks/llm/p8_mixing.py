"""Mixing sources to target weights (problem 8).

Method: tokens are summed per source, repetition rates derived, and each document is emitted ``floor(rate)``
times plus once more if a hash of its id and the seed falls below the fraction. No document is moved: the only
shuffle is the partially aggregated sum per source.

Sizes are tokens of a public byte-level vocabulary whose path is a parameter.

Defined results: source names are matched without regard to case, outer blanks and the kind of separator;
documents without a listed source are taken 0 times; null and empty texts have 0 tokens and follow their source's
rate; a listed source without documents gets the share 0; a share that a source cannot fill within ``max_repeat``
goes to the others in proportion; a source listed twice counts with its summed share and least cap; a document
delivered twice under one id is taken alike each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveworks.storage import materialize, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the published pre-tokenising pattern of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEED = 20240229
#: listed sources that may be handled on the driver
MAX_SOURCES = 100_000


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, text) to (doc_id, source, tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b[2].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(
        count, "doc_id long, source string, tokens long"
    )


def source_key(c: Column) -> Column:
    """Clean spelling of a source name; null when nothing is left."""
    c = F.lower(F.regexp_replace(c, r"^[\s ​﻿]+|[\s ​﻿]+$", ""))
    return F.nullif(F.regexp_replace(c, r"[\s_ ‐-―-]+", "-"), F.lit(""))


def rates(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Repetition rate of each source.

    The mixture is as large as the listed sources together unless ``total`` says otherwise. Sources whose cap
    binds are fixed at it and the rest of the size is shared out again among the others, in proportion.
    """
    have = {s: n for s, n in sizes.items() if n > 0 and s in shares and shares[s] > 0}
    total = float(sum(have.values())) if total is None else total
    fixed: dict[str, float] = {}
    while True:
        free = {s: n for s, n in have.items() if s not in fixed}
        left = total - sum(fixed[s] * have[s] for s in fixed)
        weight = sum(shares[s] for s in free)
        want = {s: left * shares[s] / weight / n for s, n in free.items()} if weight else {}
        over = {s for s, r in want.items() if r > caps[s]}
        if not over:
            return {s: 0.0 for s in shares} | want | fixed
        fixed |= {s: float(caps[s]) for s in over}


def plan(tokens: DataFrame, mix: DataFrame, total: float | None = None) -> DataFrame:
    """Rates by source, as a small DataFrame."""
    spark = tokens.sparkSession
    wanted = (
        mix.select(source_key("source").alias("source"), "target_share", "max_repeat")
        .filter("source is not null")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeat").alias("max_repeat"))
    )
    rows = wanted.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources listed")
    sizes = {
        r["source"]: r["n"]
        for r in tokens.join(F.broadcast(wanted.select("source")), "source").groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    }
    shares = {r["source"]: float(r["target_share"] or 0) for r in rows}
    caps = {r["source"]: max(0, int(r["max_repeat"] or 0)) for r in rows}
    rate = rates(sizes, shares, caps, total)
    return spark.createDataFrame(
        [(s, shares[s], caps[s], rate[s]) for s in sorted(shares)],
        "source string, target_share double, max_repeat int, rate double",
    )


def takes(tokens: DataFrame, planned: DataFrame, seed: int = SEED, *more: str) -> DataFrame:
    """How often each document is taken; ``planned`` has at most MAX_SOURCES rows."""
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    rate = F.coalesce("rate", F.lit(0.0))
    return tokens.join(F.broadcast(planned), "source", "left").select(
        "doc_id", "source", "tokens", *more,
        (F.floor(rate) + F.when(uniform < rate - F.floor(rate), 1).otherwise(0)).cast("int").alias("times"),
    )


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = with_tokens(table(spark, sf_dir, "documents")).withColumn("source", source_key(F.col("source")))
    return materialize(counted, "tokens")


def p8_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(spark, sf_dir)
    return takes(tokens, plan(tokens, table(spark, sf_dir, "mix_sources")))


def mixed(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mixture itself: each document as many times as it is taken, with the number of the copy."""
    few = taken.filter("times > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    return docs.join(few, "doc_id")


def emitted(docs: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixture straight from the documents: the rate of the source decides where the text stands, so no text is moved."""
    keyed = docs.withColumn("source", source_key(F.col("source").cast("string"))).withColumn("tokens", F.lit(None).cast("long"))
    times = takes(keyed.select("doc_id", "source", "tokens", "text"), planned, seed, "text").filter("times > 0")
    return times.select("doc_id", "source", "text", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the mixture, its text as a digest."""
    planned = plan(_tokens(spark, sf_dir), table(spark, sf_dir, "mix_sources"))
    return emitted(table(spark, sf_dir, "documents"), planned).select("doc_id", "source", "copy", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(spark, sf_dir)
    planned = plan(tokens, table(spark, sf_dir, "mix_sources"))
    got = takes(tokens, planned).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("tokens") * F.col("times")).alias("taken_tokens"),
        F.max("times").alias("most_repeats"),
    )
    whole = F.sum(F.coalesce("taken_tokens", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # over at most MAX_SOURCES rows
    return planned.join(got, "source", "left").select(
        "source", "target_share", "max_repeat", "rate",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "taken_tokens", "most_repeats")),
        (F.coalesce("taken_tokens", F.lit(0)) / F.nullif(whole, F.lit(0))).alias("actual_share"),
    )


QUERIES = {"p8_takes": p8_takes, "p8_shares": p8_shares, "p8_mixture": p8_mixture}
ORACLE: dict[str, str] = {}
