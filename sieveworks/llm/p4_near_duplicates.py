"""Near-duplicate records with small edits (problem 4).

Method: vantage-point trees over fingerprints. A record's fingerprint has one bit of each of its ROWS x BANDS
minimum hashes of five-word runs, so that Hamming distance estimates similarity. Shards of fingerprints are
searched in a vantage-point tree each: points lie within or beyond the median distance of a vantage point, and
the triangle bound prunes the side that cannot hold a match. A shard that outgrows a task is itself divided at a
vantage point, and the records near the boundary query the other side too. Records of a shard that no distance divides
meet on their rarest runs instead (two sets this similar share one of the first ``n - ceil(threshold n) + 1``), so no
shard is ever copied or gathered whole. Surviving pairs are checked exactly.

At a similarity of 0.5 unrelated fingerprints lie so near to the search radius that no triangle bound can separate
them (all distances concentrate around half of the bits); a single tree over the corpus would compare all pairs.
The shards are therefore seeded by equal bands of ROWS minimum hashes. A pair at the threshold shares no band with
probability ``(1 - 0.5**ROWS)**BANDS`` (0.16 %); at similarity 0.6 it is below 0.001 %.

Copies are one node until the end: nodes are distinct word sequences. No partner, candidate or shard is capped.

Defined results: null, empty and texts below ``min_words`` have no partner; copies in the sense of problem 1 are not
paired; a record delivered several times under one id counts once; a similarity equal to the threshold counts;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm.words import grams, hashes, mix, words, words_and_canonical
from sieveworks.operators.dedup import components
from sieveworks.storage import materialize, table

BANDS, ROWS, GRAM = 48, 3, 5
THRESHOLD = 0.5
MIN_WORDS = 20
SHARD_ROWS = 4096
LEAF = 16
#: a side of a join is broadcast up to this size, whatever the input; beyond it both sides are shuffled
BROADCAST_BYTES = 32 << 20

_N = BANDS * ROWS
_rng = np.random.default_rng(20240311)
_XOR = _rng.integers(0, 1 << 32, _N, dtype=np.uint32)[:, None]
_ODD = (_rng.integers(0, 1 << 31, _N, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def radius(threshold: float = THRESHOLD, sigmas: float = 4.2) -> int:
    """Bits in which two fingerprints of this similarity differ at most, but for ``sigmas`` deviations."""
    p = (1 - threshold) / 2
    return int(_N * p + sigmas * (_N * p * (1 - p)) ** 0.5)


_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def sketch(g: np.ndarray) -> np.ndarray:
    """Minimum hashes of a set of run hashes."""
    x = (g >> np.uint64(32)).astype(np.uint32)
    x = x[None, :] ^ _XOR
    x *= _ODD
    return x.min(axis=1)


def fingerprints(least: np.ndarray) -> np.ndarray:
    """One bit of each minimum hash, as 3 words of 64 bits a record. The lowest bits of a minimum are not biased by its being small."""
    bits = np.zeros((len(least), 192), np.uint8)
    bits[:, :_N] = least & np.uint32(1)
    return np.packbits(bits, axis=1).view(np.uint64)


def band_keys(least: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A 64-bit key for each record and band; ``seeds`` keep the kinds of records apart."""
    parts = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(_BAND ^ mix(seeds)[:, None], parts.shape[:2])
        for k in range(ROWS):
            key = mix(key + parts[:, :, k])
    return key


_SKETCH = "kind string, id long, pid long, canon long, f0 long, f1 long, f2 long, bands array<long>"


def sketches(records: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(record_kind, id, text) to node id, canonical digest, fingerprint and band keys of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, ids, pids, canons, least, seeds = [], [], [], [], [], []
            for kind, ident, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found, key = words_and_canonical(text)
                if len(found) < max(min_words, GRAM):
                    continue
                seed = xxhash.xxh32_intdigest(kind)
                plain = " ".join(found)
                pid = xxhash.xxh3_64_intdigest(plain, seed)
                kinds.append(kind)
                ids.append(ident)
                pids.append(pid)
                canons.append(pid if key == plain else xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"), seed))
                seeds.append(seed)
                least.append(sketch(grams(hashes(found), GRAM)))
            n = len(ids)
            mins = np.array(least, np.uint32).reshape(n, _N)
            f = fingerprints(mins).view(np.int64)
            flat = band_keys(mins, np.array(seeds, np.uint64)).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kinds, pa.string()), pa.array(ids, pa.int64()),
                    pa.array(np.array(pids, np.uint64).view(np.int64)), pa.array(np.array(canons, np.uint64).view(np.int64)),
                    *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(3)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(flat)),
                ],
                ["kind", "id", "pid", "canon", "f0", "f1", "f2", "bands"],
            )

    return records.filter("id is not null and text is not null").select("record_kind", F.col("id").cast("long").alias("id"), "text").mapInArrow(run, _SKETCH)


class VantageTree:
    """Vantage-point tree over 192-bit fingerprints under Hamming distance."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.leaf = points, leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return (at,)
        v, rest = at[0], at[1:]
        d = _far(self.points[rest], self.points[v])
        mid = int(np.median(d))
        near = d <= mid
        if near.all():
            near = d < mid
            mid -= 1
            if not near.any():  # all at one distance: nothing separates them
                return (at,)
        return v, mid, self._build(rest[near]), self._build(rest[~near])

    def pairs(self, queries: np.ndarray, r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, point number) of all that lie within ``r``."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, q = todo.pop()
            if not len(q):
                continue
            if len(node) == 1:
                for lo in range(0, len(q), 1024):
                    part = q[lo : lo + 1024]
                    i, j = np.nonzero(_far(queries[part][:, None, :], self.points[node[0]][None, :, :]) <= r)
                    yield part[i], node[0][j]
                continue
            v, mid, inner, outer = node
            d = _far(queries[q], self.points[v])
            hit = q[d <= r]
            yield hit, np.full(len(hit), v)
            todo.append((inner, q[d <= mid + r]))
            todo.append((outer, q[d > mid - r]))


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _leaf_pairs(at: np.ndarray, size: int, fp: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``r`` of many shards of one size, each a tree of one leaf; ``at`` are their first rows."""
    i, j = np.triu_indices(size, 1)
    x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
    near = _far(fp[x], fp[y]) <= r
    return x[near], y[near]


def _shard_pairs(r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in _then_none(batches):
            if b is not None:
                cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                cols = cols if carry is None else [np.concatenate([x, y]) for x, y in zip(carry, cols, strict=True)]
                end = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last shard may go on
            elif carry is not None:
                cols, end = carry, len(carry[0])
            else:
                return
            key, pid, f0, f1, f2, home = (c[:end] for c in cols)
            carry = [c[end:] for c in cols]
            out = [np.empty((0, 2), np.int64)]
            if end:
                cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
                start, size = cut[:-1], np.diff(cut)
                fp = np.stack([f0, f1, f2], axis=1).view(np.uint64)
                for n in range(2, LEAF + 1):
                    x, y = _leaf_pairs(start[size == n], n, fp, r)
                    own = home[x] | home[y]
                    out.append(np.stack([pid[x[own]], pid[y[own]]], axis=1))
                for s, n in zip(start[size > LEAF], size[size > LEAF], strict=True):
                    own = s + np.flatnonzero(home[s : s + n])
                    for q, p in VantageTree(fp[own]).pairs(fp[s : s + n], r):
                        out.append(np.stack([pid[s + q], pid[own[p]]], axis=1))
            both = np.sort(np.concatenate(out), axis=1)
            both = np.unique(both[both[:, 0] != both[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["pa", "pb"]
            )

    return run


def _then_none(it):
    yield from it
    yield None


def split_shards(rows: DataFrame, r: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Divides shards above ``shard_rows`` at vantage points until each fits; gives them and the nodes left over.

    A record lives on one side and also queries the other when it lies within ``r`` of the boundary. Where both
    sides would stay nearly as large, distance does not separate the shard: its nodes are left over.
    """
    done = left = None
    while True:
        stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("f0", "f1", "f2"), "pid").alias("v"))
        big = stats.filter(F.col("n") > shard_rows)
        if big.isEmpty():
            return (rows if done is None else done.unionByName(rows)), left
        d = sum(F.bit_count(F.col(f).bitwiseXOR(F.col(f"v.{f}"))) for f in ("f0", "f1", "f2"))
        joined = rows.join(big, "key", "left")
        fits = joined.filter("n is null").select(rows.columns)
        large = joined.filter("n is not null").withColumn("d", d.cast("int"))
        mids = large.groupBy("key").agg(F.percentile_approx("d", 0.5).alias("mid"))
        sided = large.join(mids, "key")
        sides = sided.groupBy("key").agg(
            F.greatest(F.count_if(F.col("d") <= F.col("mid") + r), F.count_if(F.col("d") > F.col("mid") - r)).alias("most")
        )
        sided = sided.join(sides, "key")
        inner = F.col("d") <= F.col("mid")
        here = F.struct(F.xxhash64("key", inner.cast("int")).alias("key"), F.col("home").alias("home"))
        there = F.struct(F.xxhash64("key", (~inner).cast("int")).alias("key"), F.lit(False).alias("home"))
        overlap = F.when(inner, F.col("d") > F.col("mid") - r).otherwise(F.col("d") <= F.col("mid") + r)
        divides = F.col("most") < 0.8 * F.col("n")
        vantage = sided.filter(divides).withColumn("to", F.when(overlap, F.array(here, there)).otherwise(F.array(here)))
        moved = vantage.select(F.explode("to").alias("to"), "pid", "f0", "f1", "f2").select("to.key", "pid", "f0", "f1", "f2", "to.home")
        rest = sided.filter(~divides).select("pid").distinct()
        done = fits if done is None else done.unionByName(fits)
        left = rest if left is None else left.unionByName(rest)
        rows = materialize(moved, "shards")


def _among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Left semi join; the key side is broadcast only below a checked size."""
    return rows.join(_small(keys), on, "left_semi")


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows of at most 64 bytes (numbers and a kind) stay below BROADCAST_BYTES."""
    most = BROADCAST_BYTES // 64
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def rare_run_pairs(nodes: DataFrame, records: DataFrame, sk: DataFrame, threshold: float) -> DataFrame:
    """Pairs (pa, pb) of ``nodes`` that share one of their rarest runs: all of at least ``threshold`` are among them.

    Runs are counted among these nodes. A run that many share is rarely among anyone's rarest; where it is, the pairs
    are similar for the most part, and a key that outgrows its partition is split by adaptive execution.
    """
    sets = node_sets(nodes, records, sk)
    flat = sets.select("pid", F.size("runs").alias("n"), F.explode("runs").alias("h"))
    often = flat.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = flat.join(often, "h").groupBy("pid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("x"))  # one text's runs
    # runs of one node come first in its order and meet nothing
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("x"))
    prefix = materialize(ranked.select("pid", "n", F.explode(F.slice("x", F.lit(1), F.greatest(keep, F.lit(0)).cast("int"))).alias("y")).select("pid", "n", "y.h"), "prefix")
    a, b = prefix.alias("a"), prefix.alias("b")
    sized = (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9)
    return a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.pid") < F.col("b.pid")) & sized).select(F.col("a.pid").alias("pa"), F.col("b.pid").alias("pb")).distinct()


def candidate_pairs(sk: DataFrame, records: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pairs of nodes (pa < pb) whose fingerprints lie within the radius in some shard."""
    r = radius(threshold)
    # partial aggregation collapses copies before the shuffle; a key of one node only is no shard
    shared = (
        sk.select(F.explode("bands").alias("key"), "pid")
        .groupBy("key")
        .agg(F.min("pid").alias("lo"), F.max("pid").alias("hi"))
        .filter("lo < hi")
        .select("key")
    )
    shared = materialize(shared, "bands")
    rows = _among(sk.select(F.explode("bands").alias("key"), "pid", "f0", "f1", "f2"), shared, ["key"])
    rows = rows.groupBy("key", "pid").agg(*(F.first(f).alias(f) for f in ("f0", "f1", "f2"))).withColumn("home", F.lit(True))
    rows, left = split_shards(materialize(rows, "shards"), r, shard_rows)
    found = (
        rows.select("key", "pid", "f0", "f1", "f2", "home")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_shard_pairs(r), "pa long, pb long")
    )
    if left is not None:
        found = found.unionByName(rare_run_pairs(materialize(left.distinct(), "left"), records, sk, threshold))
    return found.distinct()


def node_sets(nodes: DataFrame, records: DataFrame, sk: DataFrame) -> DataFrame:
    """(pid) to (pid, runs): the runs of each node, from the text of its first record."""
    members = _among(sk.select("kind", "id", "pid"), nodes, ["pid"])
    reps = materialize(members.groupBy("kind", "pid").agg(F.min("id").alias("id")), "reps")
    texts = records.select(F.col("record_kind").alias("kind"), F.col("id").cast("long").alias("id"), "text")
    chosen = texts.join(_small(reps), ["kind", "id"]).select("pid", "text")
    # a record delivered again gives its node twice
    return materialize(_gram_sets(chosen).groupBy("pid").agg(F.first("runs").alias("runs")), "runs")


def _gram_sets(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(grams(hashes(words(t)), GRAM)).view(np.int64) for t in b[1].to_pylist()]
            at = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b[0], pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["pid", "runs"])

    return df.select("pid", "text").mapInArrow(run, "pid long, runs array<bigint>")


def near_pairs(records: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes (pa, pb, similarity) at or above ``threshold``, and the members (kind, id, pid, canon)."""
    sk = materialize(sketches(records, min_words), "sketches")
    pairs = materialize(candidate_pairs(sk, records, threshold, shard_rows), "candidates")
    nodes = materialize(pairs.select(F.explode(F.array("pa", "pb")).alias("pid")).distinct(), "nodes")
    members = _among(sk.select("kind", "id", "pid", "canon"), nodes, ["pid"])
    sets = node_sets(nodes, records, sk)
    both = pairs.join(sets.select(F.col("pid").alias("pa"), F.col("runs").alias("ra")), "pa").join(
        sets.select(F.col("pid").alias("pb"), F.col("runs").alias("rb")), "pb"
    )
    common = F.size(F.array_intersect("ra", "rb"))
    both = both.select("pa", "pb", common.alias("common"), (F.size("ra") + F.size("rb") - common).alias("total"))
    close = both.filter(F.col("common") >= threshold * F.col("total"))
    return close.select("pa", "pb", (F.col("common") / F.col("total")).alias("similarity")), members


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("record_kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("record_kind"), F.col("page_id").alias("id"), "text")
    return docs.unionByName(pages)


def expand(close: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of records from pairs of nodes, without copies of one another."""
    m = members.select("kind", "id", "pid", "canon").distinct()
    a = m.select(F.col("kind").alias("record_kind"), F.col("id").alias("ia"), F.col("pid").alias("pa"), F.col("canon").alias("ca"))
    b = m.select(F.col("id").alias("ib"), F.col("pid").alias("pb"), F.col("canon").alias("cb"))
    return (
        close.join(a, "pa").join(b, "pb").filter("ca <> cb and ia <> ib")
        .select("record_kind", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "similarity")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    close, members = near_pairs(records(spark, sf_dir))
    return expand(close, members).select("record_kind", "id_a", "id_b").distinct()


def representatives(members: DataFrame) -> DataFrame:
    """(kind, pid, rep_id): the least id of each node, whose records have the same words in the same order."""
    return members.groupBy("kind", "pid").agg(F.min("id").alias("rep_id"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs between representatives of equal texts; ``p4_members`` says whom each stands for."""
    close, members = near_pairs(records(spark, sf_dir))
    reps = materialize(representatives(members), "representatives")
    a, b = reps.select("kind", F.col("pid").alias("pa"), F.col("rep_id").alias("ia")), reps.select(F.col("pid").alias("pb"), F.col("rep_id").alias("ib"))
    return close.join(a, "pa").join(b, "pb").select(F.col("kind").alias("record_kind"), F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "similarity")


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of a near pair with the representative of its text."""
    close, members = near_pairs(records(spark, sf_dir))
    paired = close.select(F.explode(F.array("pa", "pb")).alias("pid")).distinct()
    kept = materialize(members.join(paired, "pid", "left_semi"), "members")
    return kept.select("kind", "id", "pid").distinct().join(representatives(kept), ["kind", "pid"]).select(F.col("kind").alias("record_kind"), "id", "rep_id")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record that has a near duplicate: the least id of its connected group and its links to other texts."""
    close, members = near_pairs(records(spark, sf_dir))
    close = materialize(close.select("pa", "pb"), "close")
    links = close.select(F.col("pa").alias("pid")).unionByName(close.select(F.col("pb").alias("pid"))).groupBy("pid").agg(F.count(F.lit(1)).alias("links"))
    named = materialize(components(close, "pa", "pb").withColumnRenamed("node", "pid").join(links, "pid").join(members.select("kind", "id", "pid").distinct(), "pid"), "groups")
    least = named.groupBy("component").agg(F.min("id").alias("group_id"))
    return named.join(least, "component").select(F.col("kind").alias("record_kind"), "id", "group_id", "links")


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs, "p4_members": p4_members, "p4_groups": p4_groups}
ORACLE: dict[str, str] = {}
