"""Evaluation texts leaking into training text (problem 7).

Method: winnowing. Of every window of consecutive k-gram hashes the least is kept, for held-out items and for
documents alike; equal fingerprints are joined and every hit is extended word by word. With
``gram + window - 1 == run`` each shared run of at least ``RUN`` words shares a fingerprint, so none is missed.

The held-out set is stated apart from the corpus and small: below ``BROADCAST_BYTES`` its fingerprints go to
every task and documents are never shuffled. Above, fingerprints are joined by hash and only matching pairs
carry texts.

Defined results: null, empty and short texts share nothing; an item repeated under one id counts once; copies
of an item under several ids are all reported; the longest run decides ties, then the first position; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm.words import grams, hashes, words
from sieveworks.storage import table

RUN, GRAM = 12, 6
BROADCAST_BYTES = 32 << 20
#: parts that a fingerprint of the shuffled path is divided into
SALTS = 8

_SCHEMA = "doc_id long, item_id long, doc_word int, item_word int, n_words int"


def fingerprints(h: np.ndarray, gram: int = GRAM, window: int = RUN - GRAM + 1) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes kept by winnowing."""
    g = grams(h, gram)
    if len(g) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(g, window).argmin(axis=1) + np.arange(len(g) - window + 1)
    at = least[np.r_[True, least[1:] != least[:-1]]]
    return at, g[at]


def extend(a: list[str], b: list[str], i: int, j: int) -> tuple[int, int, int]:
    """Start in both and length of the maximal common run around a[i], b[j]."""
    lo = 0
    while i > lo and j > lo and a[i - lo - 1] == b[j - lo - 1]:
        lo += 1
    i, j, n = i - lo, j - lo, 0
    end = min(len(a) - i, len(b) - j)
    while n < end and a[i + n] == b[j + n]:
        n += 1
    return i, j, n


def _best(found: list[str], at: list[int], places: list[list[tuple[int, int]]], items: dict[int, list[str]]) -> dict:
    best: dict[int, tuple[int, int, int]] = {}
    for i, hits in zip(at, places, strict=True):
        for item, j in hits:
            old = best.get(item)
            # a hit inside the run that is already known extends to the same run
            if old and old[0] <= i < old[0] + old[2] and i - old[0] == j - old[1]:
                continue
            run = extend(found, items[item], i, j)
            if old is None or run[2] > old[2]:
                best[item] = run
    return best


def lengths(run: int) -> tuple[int, int]:
    """Words of a fingerprint and fingerprints of a window, so that every shared run of ``run`` words shares one."""
    gram = max(1, min(GRAM, run // 2))
    return gram, run - gram + 1


def _broadcast_leaks(docs: DataFrame, rows: list, run: int) -> DataFrame:
    gram, window = lengths(run)
    items = {r["item_id"]: words(r["text"]) for r in rows}
    index: dict[int, list[tuple[int, int]]] = {}
    for item, found in sorted(items.items()):
        for i, g in zip(*(x.tolist() for x in fingerprints(hashes(found), gram, window)), strict=True):
            index.setdefault(g, []).append((item, i))
    known = docs.sparkSession.sparkContext.broadcast((np.array(sorted(index), np.uint64), index, items))

    def leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_hashes, index, items = known.value
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                found = words(text)
                if len(found) < run or not len(sorted_hashes):
                    continue
                at, g = fingerprints(hashes(found), gram, window)
                k = np.searchsorted(sorted_hashes, g)
                k[k == len(sorted_hashes)] = 0
                hit = np.flatnonzero(sorted_hashes[k] == g)
                if not len(hit):
                    continue
                best = _best(found, at[hit].tolist(), [index[x] for x in g[hit].tolist()], items)
                out.extend((doc, item, *x) for item, x in best.items() if x[2] >= run)
            yield _batch(out)

    return docs.select("doc_id", "text").mapInArrow(leaks, _SCHEMA)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
        ["doc_id", "item_id", "doc_word", "item_word", "n_words"],
    )


def _shuffled_leaks(docs: DataFrame, items: DataFrame, run: int) -> DataFrame:
    """Fingerprints meet by hash. A boilerplate one is a hot key: documents are spread over salts and items repeated."""
    gram, window = lengths(run)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = [], []
            for ident, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                g = np.unique(fingerprints(hashes(words(text)), gram, window)[1].view(np.int64)).tolist()
                ids.extend([ident] * len(g))
                marks.extend(g)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64())], ["id", "mark"])

    d = docs.select("doc_id", "text").mapInArrow(marks, "doc_id long, mark long")
    i = items.select("item_id", "text").mapInArrow(marks, "item_id long, mark long")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    pairs = d.withColumn("salt", salt).join(i.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["mark", "salt"]).select("doc_id", "item_id").distinct()
    both = pairs.join(docs.select("doc_id", "text"), "doc_id").join(
        items.select("item_id", F.col("text").alias("item")), "item_id"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item_id, doc, text, item in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a, c = words(text), words(item)
                at, g = fingerprints(hashes(c), gram, window)
                index: dict[int, list[tuple[int, int]]] = {}
                for p, x in zip(at.tolist(), g.tolist(), strict=True):
                    index.setdefault(x, []).append((item_id, p))
                hits = [(p, index[x]) for p, x in zip(*(y.tolist() for y in fingerprints(hashes(a), gram, window)), strict=True) if x in index]
                best = _best(a, [p for p, _ in hits], [x for _, x in hits], {item_id: c})
                out.extend((doc, k, *x) for k, x in best.items() if x[2] >= run)
            yield _batch(out)

    return both.select("item_id", "doc_id", "text", "item").mapInArrow(check, _SCHEMA)


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text) against (item_id, text): the longest shared run of each document and item, from ``run`` words."""
    items = items.filter("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    docs = docs.filter("doc_id is not null and text is not null")
    if size <= broadcast_bytes:
        return _broadcast_leaks(docs, items.collect(), run)
    return _shuffled_leaks(docs, items, run)


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks}
ORACLE: dict[str, str] = {}
