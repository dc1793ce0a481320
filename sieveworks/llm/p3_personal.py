"""Personal information inside free text (problem 3).

Method: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans
(``p3_train``). It reads every character: a text is one window, or several even ones that overlap where it is longer than
``LENGTH``, and each character takes its tag from the window in which it lies most centrally. Windows of like width are
decoded together; padding resets the state and has no tags, so that neither neighbours nor the batch change a result. An exact check
follows: spans are fitted to whole addresses, numbers and words, role mailboxes and spans of impossible shape are dropped.

Texts are tagged where they are read; nothing is shuffled but the narrow results.

Defined results: null and empty texts hold nothing; equal values of a kind count once per record; a record delivered
again under one id counts once; overlapping findings are resolved to the first and longest; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm.p3_synthetic import MONTHS
from sieveworks.llm.p3_model import KINDS, PAD, Tagger, encode
from sieveworks.sources.tables import latest
from sieveworks.storage import table

WEIGHTS = os.path.join(os.path.dirname(__file__), "p3_weights.npz")
#: characters of a window, and those that it shares with the next
LENGTH, OVER = 1024, 64
BATCH = 576

#: mailboxes of a function, not of a person (fixed values)
ROLES = {"info", "support", "helpdesk", "office", "hr", "no-reply", "accounts", "webmaster"}

_CAP = "A-ZÀ-ÖØ-Þ"
_DIGITS = re.compile(r"\d[\dA-Z]*(?:[ ()./–-]{1,3}[\dA-Z]*\d[\dA-Z]*)*")
_DATE = re.compile(r"(?:\d{1,2}([./-])\d{1,2}\1(?:19|20)?\d\d|(?:19|20)\d\d([./-])\d{1,2}\2\d{1,2})\Z")
_TOKEN = re.compile(r"[^\W\d_]+")
_KIND_OF_STREET = re.compile(r" (?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Close|Drive|Terrace|Way|Place|Crescent|Row|Walk|Square)\b")
_STREET_LEAD = re.compile(rf"(?<!\w)(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Hinter der) (?:[{_CAP}]\w+ )?\Z")
#: names of months, which a number beside them does not make a street
_MONTH = re.compile("|".join(m for ms in MONTHS.values() for m in ms), re.I)


def windows(n: int) -> tuple[int, list[int]]:
    """Width and starts of even windows that cover ``n`` characters, each sharing ``OVER`` of them with the next."""
    k = max(1, -(-(n - OVER) // (LENGTH - OVER)))
    width = -(-(n + (k - 1) * OVER) // k)
    return width, [j * (width - OVER) for j in range(k)]


def tag(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) spans of each text, of which every character is read."""
    ids = [encode(t) for t in texts]
    base = np.cumsum([0, *(len(x) for x in ids)])
    flat = np.concatenate([*ids, np.full(LENGTH, PAD, np.uint8)])
    # width, start, end of the text, and the characters that lie most centrally in this window
    laid = []
    for k, x in enumerate(ids):
        if len(x):
            width, starts = windows(len(x))
            for s in starts:
                laid.append((width, base[k] + s, base[k + 1], base[k] + s + OVER // 2 * (s > 0), base[k + 1] if s == starts[-1] else base[k] + s + width - OVER // 2))
    best = np.zeros(len(flat), np.uint8)
    laid.sort()  # windows of like width are read together
    for lo in range(0, len(laid), BATCH):
        part = np.array(laid[lo : lo + BATCH])
        reach = np.arange(part[-1, 0])
        at = part[:, 1:2] + reach
        own = np.minimum(part[:, :1] + part[:, 1:2], part[:, 2:3])
        tags = model.decode(np.where(at < own, flat[np.minimum(at, len(flat) - 1)], PAD))
        hit = np.flatnonzero(tags.any(axis=1))
        mine = (at[hit] >= part[hit, 3:4]) & (at[hit] < part[hit, 4:5])
        best[at[hit][mine]] = tags[hit][mine]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    marked = np.flatnonzero(best)
    if not len(marked):
        return out
    kind = (best[marked].astype(int) - 1) // 2
    begins = (best[marked] % 2 == 1) | np.r_[True, (marked[1:] != marked[:-1] + 1) | (kind[1:] != kind[:-1])]
    which = np.searchsorted(base, marked, side="right") - 1
    begins |= np.r_[True, which[1:] != which[:-1]]
    cut = np.flatnonzero(np.r_[begins, True])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        t = int(which[a])
        out[t].append((int(kind[a]), int(marked[a] - base[t]), int(marked[b - 1] - base[t]) + 1))
    return out


_MAIL = re.compile(r"[^\W_][\w.+'’-]*\s?(?:@|[\[(]at[\])])\s?[^\W_][\w-]*(?:(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[^\W_][\w-]*)+")
_PHONE = re.compile(r"\+?\(?\d(?:[\d()./–‐-]|[  ](?=[\d(+]))*\d")
_NUMBER = re.compile(r"[A-Z]{0,3}\d[\dA-Z]*(?:[ ./–‐-](?=[\dA-Z]+(?!\w))[\dA-Z]*\d[\dA-Z]*)*(?: [A-Z](?!\w))?")
_TITLE = re.compile(r"(?:(?:Dr|Mr|Mrs|Ms|Prof|Herr|Herrn|Frau|Sra?|Señora?|Mme|Mlle|Monsieur|Madame|Doña|Don|Dear|Hello|Guten Tag|Tag)\b\.?\s+)+", re.I)
#: a number and then words of which one is capitalised or names a kind of street, or the other way round
_ADDRESS = re.compile(
    rf"\d{{1,4}} ?(?:[a-z]\b|bis\b|ter\b)?,?[ ](?:(?:rue|avenue|boulevard|impasse|allée|place|chemin|quai|cours|route|square)\b[^\n]*|[{_CAP}][^\n]*)\Z|(?=[^\n]*[{_CAP}])[^\W\d_/][^\d\n]+,?[ ]\d{{1,4}} ?[a-z]?\Z"
)
_NAME_WORD = r"[^\W\d_][\w'’‐-]*\.?"
_NAME = re.compile(rf"{_NAME_WORD}(?:,?\s{_NAME_WORD}){{1,4}}")


def _grow(pattern: re.Pattern, text: str, s: int, e: int, reach: int = 40) -> tuple[int, int] | None:
    """The longest match that overlaps the span."""
    lo = max(0, s - reach)
    best = None
    for m in pattern.finditer(text, lo, min(len(text), e + reach)):
        if m.start() < e and m.end() > s and (best is None or m.end() - m.start() > best[1] - best[0]):
            best = m.span()
    return best


def fit(text: str, kind: int, s: int, e: int) -> tuple[int, int, str] | None:
    """The exact check: span and value as reported, or nothing."""
    name = KINDS[kind]
    if name == "email":
        at = _grow(_MAIL, text, s, e)
        if not at:
            return None
        local = re.split(r"\s?(?:@|[\[(]at)", text[at[0] : at[1]])[0].lower()
        return None if local in ROLES else (*at, text[at[0] : at[1]])
    if name == "phone":
        at = _grow(_PHONE, text, s, e)
        digits = re.sub(r"\D", "", text[at[0] : at[1]]) if at and not _DATE.match(text[at[0] : at[1]]) else ""
        return (*at, digits) if at and 7 <= len(digits) <= 15 else None
    if name == "identity_number":
        at = _grow(_NUMBER, text, s, e, 12)
        value = re.sub(r"[\W_]", "", text[at[0] : at[1]]) if at else ""
        return (*at, value) if at and 6 <= len(value) <= 16 and sum(c.isdigit() for c in value) >= 5 else None
    while s > 0 and text[s - 1].isalnum() and text[s].isalnum():
        s -= 1
    while e < len(text) and text[e - 1].isalnum() and text[e].isalnum():
        e += 1
    if name == "street_address":
        while s < e and not text[s].isalnum():
            s += 1
        while e > s and not (text[e - 1].isalnum() or (text[e - 1] == "." and text[e - 2].isalpha() and len(re.split(r"\W", text[s : e - 1])[-1]) <= 4 and e < len(text) and text[e : e + 1] in ", |")):
            e -= 1
        if m := _KIND_OF_STREET.match(text, e):  # the kind of street belongs to its name
            e = m.end()
        value = text[s:e]
        if not value[:1].isdigit() and (m := _STREET_LEAD.search(text, max(0, s - 30), s)):
            s = m.start()
            value = text[s:e]
        words = [w for w in _TOKEN.findall(value) if len(w) > 1]
        if not _ADDRESS.match(value) or all(_MONTH.fullmatch(w) for w in words):
            return None
        return s, e, value
    m = _TITLE.match(text, s, e)
    if m:
        s = m.end()
    m = _NAME.search(text, s, min(len(text), e))
    if not m or m.start() > s + 3:
        return None
    value = m.group()
    parts = value.split()
    if len(parts[-1]) == 1 or not any(len(w.strip(".,")) > 1 for w in parts):
        return None
    if not all(w[0].isupper() or w.lower() in ("de", "da", "di", "la", "van", "von", "der", "del", "el", "y") for w in re.findall(r"[^\W_]+", value)):
        return None
    if not (value.endswith(".") and len(value.split()[-1]) <= 2):
        value = value.rstrip(".")
    return m.start(), m.start() + len(value), value


def find(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int, str]]]:
    """(kind, start, end, value) of each text, in order and without overlaps."""
    out = []
    for text, spans in zip(texts, tag(model, texts), strict=True):
        rows: list[tuple[str, int, int, str]] = []
        for kind, s, e in spans:
            got = fit(text, kind, s, e)
            if got and (not rows or got[0] >= rows[-1][2]):
                rows.append((KINDS[kind], *got))
        out.append(rows)
    return out


@lru_cache(maxsize=1)
def tagger(path: str = WEIGHTS) -> Tagger:
    return Tagger.load(path)


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 10_000, chars: int = 10_000_000) -> Iterator[tuple[list, list, list[str]]]:
    """Kinds, ids and texts, up to so many at once that windows of like width fill their batches."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(b[2]), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            most = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chars, side="right"))
            part = b.slice(lo, max(1, min(rows, most - lo)))
            lo += part.num_rows
            yield part[0].to_pylist(), part[1].to_pylist(), [t or "" for t in part[2].to_pylist()]


def found(records: DataFrame) -> DataFrame:
    """(record_kind, id, text) to one row per finding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tagger()
        for kinds, ids, texts in _texts(batches):
            rows = {(k, i, p, v) for k, i, hits in zip(kinds, ids, find(model, texts), strict=True) for p, _, _, v in hits}
            cols = list(zip(*sorted(rows), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.string(), pa.string()], strict=True)],
                ["record_kind", "record_id", "pii_kind", "found"],
            )

    rows = records.filter("id is not null and text is not null").select("record_kind", F.col("id").cast("long"), "text")
    return rows.mapInArrow(run, "record_kind string, record_id long, pii_kind string, found string")


def redact(text: str, hits: list[tuple[str, int, int, str]]) -> str:
    out, at = [], 0
    for kind, s, e, _ in hits:
        out.append(text[at:s] + f"[{kind.upper()}]")
        at = e
    return "".join(out) + text[at:]


def redacted(records: DataFrame) -> DataFrame:
    """(record_kind, id, text) with typed placeholders, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tagger()
        for kinds, ids, texts in _texts(batches):
            hits = find(model, texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kinds, pa.string()), pa.array(ids, pa.int64()),
                    pa.array([redact(t, h) for t, h in zip(texts, hits, strict=True)], pa.string()),
                    pa.array([len(h) for h in hits], pa.int32()),
                ],
                ["record_kind", "id", "text", "placeholders"],
            )

    rows = records.select("record_kind", F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(run, "record_kind string, id long, text string, placeholders int")


def records(spark: SparkSession, sf_dir: str, last: bool = False) -> DataFrame:
    """Pages and chunks as delivered, or each once, in its last delivery."""
    one = lambda df, key: latest(df.select(key, "text", "loaded_at"), key) if last else df
    pages = one(table(spark, sf_dir, "pages"), "page_id").select(F.lit("pages").alias("record_kind"), F.col("page_id").alias("id"), "text")
    chunks = one(table(spark, sf_dir, "chunks"), "chunk_id").select(F.lit("chunks").alias("record_kind"), F.col("chunk_id").alias("id"), "text")
    return pages.unionByName(chunks)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(records(spark, sf_dir)).distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(records(spark, sf_dir, last=True))


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted}
ORACLE: dict[str, str] = {}
