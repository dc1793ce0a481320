"""Duplicates hidden by formatting differences (problem 1).

Method: recursive radix partitioning on canonical bytes. Buckets that hold more rows than fit are split by
further bytes of the key until each fits; every bucket is then counted in a path-compressed trie whose
terminal counters are the groups. A single key that alone exceeds a bucket (a hot group of copies) cannot be
split further: its minimum is taken by a partially aggregated group-by and its rows are labelled in place.

Defined results: null and empty texts and texts below ``min_words`` are never duplicates; a record delivered
several times under one id counts once; ties are resolved to the smallest id; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm.words import canonical
from sieveworks.storage import materialize, table

#: rows a bucket may hold, whatever the input: a trie never outgrows its task
BUCKET_ROWS = 20_000
#: buckets for each BUCKET_ROWS rows: prefixes differ in size, and many small buckets fill tasks more evenly
FINE = 4
#: oversized prefixes of one level that are broadcast; more are joined as a table
PREFIXES = 200_000
MIN_WORDS = 10


class RadixTrie:
    """Path-compressed byte trie; each terminal keeps the ids that ended there."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # edge, children by first byte, ids

    def add(self, key: bytes, ident: int) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, [ident]]
                return
            edge = child[0]
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            lo, hi = 1, min(len(edge), end - at)
            while lo < hi:  # longest common prefix by bisection
                mid = (lo + hi + 1) // 2
                if key.startswith(edge[:mid], at):
                    lo = mid
                else:
                    hi = mid - 1
            fork: list = [edge[:lo], {edge[lo]: child}, None] if lo < len(edge) else child
            child[0] = edge[lo:]
            node[1][key[at]] = fork
            node, at = fork, at + lo
        if node[2] is None:
            node[2] = [ident]
        else:
            node[2].append(ident)

    def terminals(self) -> Iterator[list[int]]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node[2] is not None:
                yield node[2]
            todo.extend(node[1].values())


def canonical_keys(records: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(record_kind, id, text) to (record_kind, id, key): the kind and the canonical bytes in one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, ids, keys = [], [], []
            for kind, ident, text in zip(b[0].to_pylist(), b[1].to_pylist(), b[2].to_pylist(), strict=True):
                key, n = canonical(text)
                if n >= min_words and ident is not None:
                    kinds.append(kind)
                    ids.append(ident)
                    keys.append(f"{kind}\x00{key}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(ids, pa.int64()), pa.array(keys, pa.binary())],
                ["record_kind", "id", "key"],
            )

    return records.select("record_kind", F.col("id").cast("long").alias("id"), "text").mapInArrow(
        run, "record_kind string, id long, key binary"
    )


@dataclass
class Level:
    """Prefixes of one depth that hold too many rows: a table (h, new_parts, ended) and its numbers of rows."""

    depth: int
    heavy: DataFrame
    n: int
    n_ended: int


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= PREFIXES else df


def _bucketed(keys: DataFrame, levels: list[Level], root_parts: int) -> DataFrame:
    """Adds ``bucket`` and ``hot``."""
    out = keys.withColumn("parent", F.lit(0).cast("long")).withColumn("parts", F.lit(root_parts).cast("long"))
    out = out.withColumn("bucket", F.lit(None).cast("long")).withColumn("hot", F.lit(False))
    for level in levels:
        h = F.xxhash64(F.lit(level.depth), F.substring("key", 1, level.depth))
        out = out.withColumn("h", F.when(F.col("bucket").isNull() & ~F.col("hot"), h))
        if level.n:
            out = out.join(_small(level.heavy, level.n), "h", "left")
        else:
            out = out.withColumn("new_parts", F.lit(None).cast("long")).withColumn("ended", F.lit(False))
        light = F.col("h").isNotNull() & F.col("new_parts").isNull()
        out = out.select(
            *keys.columns,
            F.when(light, F.xxhash64("parent", F.pmod("h", "parts"))).otherwise(F.col("bucket")).alias("bucket"),
            (F.col("hot") | F.coalesce("ended", F.lit(False))).alias("hot"),
            F.coalesce(F.when(F.col("new_parts").isNotNull(), F.col("h")), F.col("parent")).alias("parent"),
            F.coalesce("new_parts", "parts").alias("parts"),
        )
    return out


def radix_plan(keys: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[list[Level], int]:
    """Split levels: the prefixes that hold too many rows, found level by level at depths 4, 8, 16, ...

    Each round counts prefixes below the oversized parents only. The oversized ones stay a table; the driver gets two
    numbers a level.
    """
    total = keys.count()
    levels: list[Level] = []
    root_parts = max(1, -(-FINE * total // bucket_rows))
    depth, todo = 4, 1
    while todo:
        placed = _bucketed(keys, levels, root_parts).filter(F.col("bucket").isNull() & ~F.col("hot"))
        counts = (
            placed.withColumn("h", F.xxhash64(F.lit(depth), F.substring("key", 1, depth)))
            .groupBy("h", (F.octet_length("key") < depth).alias("ended"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        heavy = materialize(counts.filter(F.col("n") > bucket_rows).select("h", F.ceil(FINE * F.col("n") / bucket_rows).alias("new_parts"), "ended"), "prefixes")
        n, n_ended = heavy.agg(F.count(F.lit(1)), F.count_if("ended")).first()
        levels.append(Level(depth, heavy, n, n_ended))
        todo = n - n_ended
        depth *= 2
    return levels, root_parts


def _tries(one_row_per_group: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts each bucket (rows arrive sorted by bucket) in its own trie."""

    def flush(trie: RadixTrie, kinds: list[str]) -> pa.RecordBatch:
        kind_out: list[str] = []
        a_out: list[int] = []
        b_out: list[int] = []
        for tagged in trie.terminals():
            ids = sorted({x[1] for x in tagged})
            kind = tagged[0][0]
            if one_row_per_group:
                kind_out.append(kind)
                a_out.append(ids[0])
                b_out.append(len(ids))
            elif len(ids) > 1:
                kind_out.extend([kind] * (len(ids) - 1))
                a_out.extend([ids[0]] * (len(ids) - 1))
                b_out.extend(ids[1:])
        return pa.RecordBatch.from_arrays(
            [pa.array(kind_out, pa.string()), pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())],
            ["record_kind", "id_a", "v"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, current = RadixTrie(), None
        for b in batches:
            for bucket, kind, ident, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != current:
                    if current is not None:
                        yield flush(trie, [])
                    trie, current = RadixTrie(), bucket
                trie.add(key, (kind, ident))
        if current is not None:
            yield flush(trie, [])

    return run


def _groups(records: DataFrame, one_row_per_group: bool, min_words: int, bucket_rows: int) -> DataFrame:
    keys = materialize(canonical_keys(records, min_words), "canonical")
    levels, root_parts = radix_plan(keys, bucket_rows)
    placed = _bucketed(keys, levels, root_parts)
    spark = records.sparkSession
    # as many partitions as buckets ask for: without a number small buckets are put together into large tasks
    parts = max(2 * spark.sparkContext.defaultParallelism, root_parts // FINE)
    normal = (
        placed.filter(~F.col("hot"))
        .select("bucket", "record_kind", "id", "key")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_tries(one_row_per_group), "record_kind string, id_a long, v long")
    )
    hot_keys = sum(level.n_ended for level in levels)
    if not hot_keys:
        return normal
    hot = placed.filter("hot").select("record_kind", "id", F.sha2("key", 256).alias("digest"))
    # partial aggregation happens before the shuffle: one row per hot group and task
    least = hot.groupBy("record_kind", "digest").agg(F.min("id").alias("id_a"))
    if one_row_per_group:
        # distinct ids of a hot group, counted in salted parts first
        parts = hot.groupBy("record_kind", "digest", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(
            F.min("id").alias("id_a"), F.countDistinct("id").alias("v")
        )
        hot_rows = parts.groupBy("record_kind", "digest").agg(F.min("id_a").alias("id_a"), F.sum("v").alias("v"))
        return normal.unionByName(hot_rows.select("record_kind", "id_a", "v"))
    # more than a bucket's rows each: few, and joined as a table where they are not
    labelled = hot.join(_small(least, hot_keys), ["record_kind", "digest"]).filter("id <> id_a")
    return normal.unionByName(labelled.select("record_kind", "id_a", F.col("id").alias("v")).distinct())


def duplicate_members(records: DataFrame, min_words: int = MIN_WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(record_kind, id, text) to (record_kind, id_a, id_b): ``id_a`` the smallest id of a group of copies."""
    return _groups(records, False, min_words, bucket_rows).withColumnRenamed("v", "id_b")


def collapsed(records: DataFrame, min_words: int = MIN_WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per distinct record of at least ``min_words`` words: its smallest id and its number of copies."""
    return _groups(records, True, min_words, bucket_rows).select(
        "record_kind", F.col("id_a").alias("id"), F.col("v").alias("copies")
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("record_kind"), F.col("doc_id").alias("id"), "text")
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("record_kind"), F.col("chunk_id").alias("id"), "text")
    return docs.unionByName(chunks)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_members(records(spark, sf_dir))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(records(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed}
ORACLE: dict[str, str] = {}
