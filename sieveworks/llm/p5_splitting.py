"""Splitting oversized items at natural boundaries (problem 5).

Method: agglomerative merging. An item is cut into atomic segments (a word with the white space after it; a
longer one in steps). Adjacent segments wait in a heap keyed by the strength of the boundary between them and
are merged weakest first, as long as the merged size plus the overlap fits. What remains is cut at the strongest
boundaries the limit allows.

Only items above the limit leave the scan, decided on the JVM side; each is split where it is read, without a
shuffle. Sizes are Unicode code points.

Defined results: null and empty texts and items within the limit give no pieces; bodies put one after another
reproduce the text exactly; a text without any boundary is cut in steps; an overlap is shorter than asked for
where a word begins later; copies delivered again under one id give the pieces of one; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.sources.tables import latest
from sieveworks.storage import table

LIMITS = {"documents": (4000, 200), "chunks": (2000, 100)}

_ATOM = re.compile(r"\S+\s*|\s+")
_SENTENCE = re.compile("[.!?…。！？][\"'”’»)\\]]*\\s*\\Z")
_CLAUSE = re.compile("[,;:–—][\"'”’»)\\]]*\\s*\\Z")
_LIST = re.compile(r"(?:[-*•+]|\d{1,3}[.)]|#{1,6})\s")


def strength(left: str, right: str) -> int:
    """Of the boundary between two atoms: 5 a paragraph, 4 a line that opens a list item or ends a sentence,
    3 a sentence, 2 a line or clause, 1 a word, 0 inside a word."""
    gap = left[len(left.rstrip()) :]
    breaks = gap.count("\n") or gap.count("\r")
    if breaks > 1 or "\x0c" in gap or "\u2029" in gap:
        return 5
    ended = bool(_SENTENCE.search(left))
    if breaks:
        return 4 if ended or _LIST.match(right) else 2
    if not gap:
        return 0
    if ended and not right[:1].islower():
        return 3
    return 2 if _CLAUSE.search(left) else 1


def _atoms(text: str, most: int) -> list[str]:
    out: list[str] = []
    step = max(1, most // 4)
    for m in _ATOM.finditer(text):
        atom = m.group()
        while len(atom) > step:
            cut = step
            while cut < len(atom) and cut < 2 * step and (unicodedata.combining(atom[cut]) or atom[cut] in "‍️" or atom[cut - 1] == "‍"):
                cut += 1  # keep a sign and its marks together
            out.append(atom[:cut])
            atom = atom[cut:]
        if atom:
            out.append(atom)
    return out


def bodies(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans that follow one another and cover the text, each at most ``limit - overlap`` long."""
    most = limit - overlap
    atoms = _atoms(text, most)
    n = len(atoms)
    size = [len(a) for a in atoms]
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    weight = [strength(atoms[i], atoms[i + 1]) for i in range(n - 1)]
    version = [0] * n
    heap = [(weight[i], size[i] + size[i + 1], i, i + 1, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    last = list(range(n))  # rightmost atom of the segment that starts at an atom
    while heap:
        w, total, i, j, vi, vj = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j]) or version[i] != vi or version[j] != vj or total > most:
            continue
        size[i] = total
        alive[j] = False
        version[i] += 1
        last[i] = last[j]
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
            k = nxt[i]
            heapq.heappush(heap, (weight[last[i]], total + size[k], i, k, version[i], version[k]))
        if prev[i] >= 0:
            k = prev[i]
            heapq.heappush(heap, (weight[last[k]], size[k] + total, k, i, version[k], version[i]))
    spans, at, i = [], 0, 0
    while i < n:
        spans.append((at, at + size[i]))
        at += size[i]
        i = nxt[i]
    return spans


def overlap_start(text: str, floor: int, end: int, overlap: int) -> int:
    """Where the repeated tail before ``end`` begins: ``overlap`` characters back, later if a word begins later."""
    start = max(floor, end - overlap)
    if start == 0 or start >= end or text[start - 1].isspace():
        return min(start, end)
    at = start
    while at < end and not text[at].isspace():
        at += 1
    while at < end and text[at].isspace():
        at += 1
    return at if at < end else start


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, start of the body, end) of each piece; a text within the limit is one piece."""
    if limit <= overlap or overlap < 0:
        raise ValueError("the limit must exceed the overlap")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    out: list[tuple[int, int, int]] = []
    for body, end in bodies(text, limit, overlap):
        floor = out[-1][0] if out else 0
        out.append((overlap_start(text, floor, body, overlap) if body else 0, body, end))
    return out


_SCHEMA = (
    "record_kind string, record_id long, piece int, start int, body_start int, end int, text string"
)


def pieces(records: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(record_kind, record_id, text) to the pieces of every item above ``limit`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for kind, ident, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.extend(
                    (kind, ident, k, s, body, e, text[s:e]) for k, (s, body, e) in enumerate(split(text, limit, overlap))
                )
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            names = ["record_kind", "record_id", "piece", "start", "body_start", "end", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    big = records.select("record_kind", F.col("record_id").cast("long").alias("record_id"), "text").filter(
        F.length("text") > limit
    )
    return big.mapInArrow(run, _SCHEMA)


def _all_pieces(spark: SparkSession, sf_dir: str, last: bool = False) -> DataFrame:
    """Pieces of all oversized items as delivered, or of chunks in their last delivery alone."""
    out = None
    for name, ident in (("documents", "doc_id"), ("chunks", "chunk_id")):
        rows = table(spark, sf_dir, name)
        if last and name == "chunks":
            # what never was too long in any delivery needs no shuffle
            ever = rows.filter(F.length("text") > LIMITS[name][0]).select(ident).distinct()
            rows = latest(rows.join(ever, ident, "left_semi").select(ident, "text", "loaded_at"), ident)
        rows = rows.select(F.lit(name).alias("record_kind"), F.col(ident).alias("record_id"), "text")
        part = pieces(rows, *LIMITS[name])
        out = part if out is None else out.unionByName(part)
    return out


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_pieces(spark, sf_dir, last=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_pieces(spark, sf_dir).filter("piece = 1").select("record_kind", "record_id").distinct()


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
ORACLE: dict[str, str] = {}
