"""Exact duplicates, exact and approximate similarity joins, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.functions import text as T
from sieveworks.operators import setjoin
from sieveworks.storage import materialize

#: fixed values of the checks
MIN_DUPLICATE_WORDS, MIN_FAMILY_WORDS, SHINGLE, TEXT_SIMILARITY = 10, 20, 5, 0.5
BINS, BAND_ROWS, MAX_BUCKET = 32, 2, 50


def keyed(docs: DataFrame) -> DataFrame:
    """Adds the normalised words' number and digest; the digest is null for short texts."""
    w = T.norm_words("text")
    return docs.withColumn("n_words", F.size(w).cast("long")).withColumn(
        "digest", F.when(F.size(w) >= MIN_DUPLICATE_WORDS, F.sha1(F.array_join(w, " ")))
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(path, text) to one row per document that repeats another: path, the first path of its group, its size.

    Copies are counted per task before the shuffle; the join back to the rows carries digests only, which are written
    once: both sides of the join would read the words again.
    """
    k = materialize(keyed(docs).select("path", "digest"), "digests").filter("digest is not null")
    groups = k.groupBy("digest").agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return k.join(groups, "digest").filter("path <> first_path").select("path", "first_path", "group_size")


def copies(docs: DataFrame) -> DataFrame:
    """(path, digest) of the documents of enough words that repeat one with a lesser path."""
    w = docs.select("path", T.norm_words("text").alias("w"))
    # short texts have no digest; a filter would read the words again
    k = materialize(w.select("path", F.when(F.size("w") >= MIN_FAMILY_WORDS, F.sha1(F.array_join("w", " "))).alias("digest")), "digests")
    first = k.filter("digest is not null").groupBy("digest").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return few(materialize(k.join(first, "digest").filter("path <> first").select("path", "digest").distinct(), "copies"))


def representatives(docs: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Documents of enough words, one per group of exact duplicates; ``gone`` are their copies, if they are known.

    Texts are not moved: rows that repeat another are few keys, left out by a join that is broadcast below a checked number.
    """
    own = keyed(docs).filter(F.col("n_words") >= MIN_FAMILY_WORDS)
    return own.join(gone if gone is not None else copies(docs), ["path", "digest"], "left_anti").select(*docs.columns)


def few(keys: DataFrame, most: int = 200_000) -> DataFrame:
    """Rows of a key or two each, broadcast if they are at most so many."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def with_shingles(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Adds ``shingles``, the distinct runs of words as strings.

    The words are a column of their own first: inside the lambda they would be extracted again for every run. The
    guard is inside the expression since filters do not protect it.
    """
    n = F.size("_w")
    many = F.greatest(n - size + 1, F.lit(0))
    # shifted copies are zipped: a slice per run would copy the whole array each time
    shifted = {f"_s{k}": F.slice("_w", k + 1, many) for k in range(size)}
    runs = F.transform(F.arrays_zip(*shifted), lambda z: F.concat_ws(" ", *[z[c] for c in shifted]))
    out = docs.withColumn("_w", T.norm_words("text")).withColumns(shifted)
    return out.withColumn("shingles", F.array_distinct(runs)).drop("_w", *shifted)


def hashed_shingles(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(path, s) of the representatives: the distinct runs of words as numbers, made of the words' hashes."""
    w = docs.select("path", T.norm_words("text").alias("w"))
    known = few(gone.groupBy("path").agg(F.collect_set("digest").alias("gone")))
    # digests are made again only where a row of this path is left out
    own = w.join(known, "path", "left").filter(F.col("gone").isNull() | ~F.array_contains("gone", F.sha1(F.array_join("w", " "))))
    return setjoin.runs(own.select("path", F.transform("w", lambda x: F.xxhash64(x)).alias("w")), SHINGLE, MIN_FAMILY_WORDS)


def near_pairs(docs: DataFrame, threshold: float = TEXT_SIMILARITY) -> DataFrame:
    """(path, text) to all pairs of representatives with Jaccard similarity of shingles >= ``threshold``.

    Exact prefix filtering: sorted by rarity, two sets this similar share one of their first
    ``n - ceil(threshold n) + 1`` shingles, so boilerplate that many documents share is never joined on.
    """
    gone = copies(docs)
    sets = lambda d: hashed_shingles(d, gone)  # noqa: E731 - made again by each reader: written, they are larger than the texts
    return jaccard(candidates(sets(docs), threshold, paths=docs), lambda p: sets(docs.join(p, "path", "left_semi"))).filter(F.col("jaccard") >= threshold)


def candidates(sets: DataFrame, threshold: float, *within: str, paths: DataFrame | None = None) -> DataFrame:
    """The prefix join of ``near_pairs`` over sets (path, s): a pair of at least ``threshold`` is always among its pairs.

    Only sets with equal ``within`` are compared. Paths are numbers on the way; a hash that two paths share is replaced.
    ``paths`` has the paths (and ``within``) of all sets, where they can be had without making the sets.
    """
    key = [*within, "path"]
    of = lambda seed: F.xxhash64(F.lit(seed), *key)
    keys = materialize((sets if paths is None else paths).select(*key), "paths")
    seed = 0
    while not keys.groupBy(of(seed).alias("id")).agg(F.count_distinct(*key).alias("n")).filter("n > 1").isEmpty():
        seed += 1
    s = F.transform("s", lambda h: F.xxhash64(h, *within)) if within else F.col("s")
    found = materialize(setjoin.candidates(sets.select(of(seed).alias("id"), s.alias("s")), threshold), "met")
    ends = few(found.select(F.col("a").alias("id")).union(found.select("b")).distinct())
    named = materialize(keys.select(of(seed).alias("id"), "path").join(ends, "id", "left_semi").distinct(), "named")
    side = lambda c: few(named.select(F.col("id").alias(c), F.col("path").alias(f"path_{c}")))
    both = found.join(side("a"), "a").join(side("b"), "b")
    return both.select(F.least("path_a", "path_b").alias("path_a"), F.greatest("path_a", "path_b").alias("path_b")).distinct()


def jaccard(pairs: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Exact similarity of candidate pairs; ``sets`` has (path, s), or makes it for a table of paths.

    Pairs of a neighbourhood are compared in one place, so a set is moved about once and not once per pair.
    """
    pairs = materialize(pairs, "candidates")
    links = pairs.select(F.col("path_a").alias("path"), F.col("path_b").alias("to")).union(pairs.select("path_b", "path_a"))
    label = materialize(links.groupBy("path").agg(F.least("path", F.min("to")).alias("label")), "neighbours")
    n = label.count()
    parts = max(pairs.sparkSession.sparkContext.defaultParallelism, n // 20_000 + 1)
    side = lambda c: few(label.select(F.col("path").alias(f"path_{c}"), F.col("label").alias(f"label_{c}")))
    home = F.pmod(F.xxhash64(F.least("label_a", "label_b")), F.lit(parts)).cast("int")
    placed = materialize(pairs.join(side("a"), "path_a").join(side("b"), "path_b").select(home.alias("home"), "path_a", "path_b"), "placed")
    needed = materialize(placed.select("home", F.col("path_a").alias("path")).union(placed.select("home", "path_b")).distinct(), "needed")
    own = sets(few(needed.select("path").distinct())) if callable(sets) else sets
    return setjoin.compare(placed, own.join(few(needed), "path"), parts)


def min_hash(docs: DataFrame) -> DataFrame:
    """One-permutation minimum hashes: (path, bin, least) from a digest both engines compute alike."""
    x = F.conv(F.substring(F.md5("shingle"), 1, 15), 16, 10).cast("long")
    return (
        with_shingles(representatives(docs)).select("path", F.explode("shingles").alias("shingle")).select("path", x.alias("x"))
        .groupBy("path", (F.col("x") % BINS).alias("bin")).agg(F.min(F.floor(F.col("x") / BINS)).alias("least"))
    )


def lsh_pairs(docs: DataFrame, most: int = MAX_BUCKET) -> DataFrame:
    """Candidate pairs that agree in a band; buckets above ``most`` are boilerplate and left to ``near_pairs``."""
    m = min_hash(docs).withColumn("band", F.floor(F.col("bin") / BAND_ROWS))
    bands = m.groupBy("path", "band").agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(F.struct("bin", "least"))).alias("v"))
    bands = bands.filter(F.col("k") == BAND_ROWS).select("path", "band", F.xxhash64("v").alias("h"))
    bands = materialize(bands, "lsh")
    fit = bands.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, most))
    kept = bands.join(fit, ["band", "h"]).select("band", "h", "path")
    a, b = kept.alias("a"), kept.alias("b")
    on = (F.col("a.band") == F.col("b.band")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.path") < F.col("b.path"))
    return a.join(b, on).select(F.col("a.path").alias("path_a"), F.col("b.path").alias("path_b")).distinct()


def components(pairs: DataFrame, a: str = "path_a", b: str = "path_b") -> DataFrame:
    """(node, component): the least node each node is connected to.

    Each round hooks a node and its label's node to the least label beyond a link, and lets labels jump to their own
    label's label, so whole regions merge and the rounds grow with about the logarithm of a chain's length. The loop ends
    when no label changes, which is only where linked nodes agree; each round is written to shared storage.
    """
    links = materialize(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(pairs.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "links")
    label = materialize(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")), "labels")
    while True:
        hop = label.select(F.col("u").alias("c"), F.col("c").alias("hc"))
        far = materialize(label.join(hop, "c").select("u", "c", "hc"), "hops")
        near = links.join(far.select(F.col("u").alias("v"), F.col("hc").alias("nc")), "v").groupBy("u").agg(F.min("nc").alias("nc"))
        seen = materialize(far.join(near, "u"), "near")
        hooks = seen.groupBy(F.col("c").alias("u")).agg(F.min("nc").alias("rc"))
        new = seen.join(hooks, "u", "left").select("u", F.col("c").alias("old"), F.least("c", "hc", "nc", "rc").alias("c"))
        new = materialize(new, "labels")
        label = new.select("u", "c")
        if new.filter("old <> c").isEmpty():
            break
    return label.select(F.col("u").alias("node"), F.col("c").alias("component"))
