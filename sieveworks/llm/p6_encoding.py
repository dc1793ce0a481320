"""Garbled text from wrong character encoding (problem 6).

Method: a multinomial classifier over hashed byte bigrams, trained on synthetically garbled records, predicts the
encoding chain of every passage that holds signs outside ASCII. The chain is inverted with strict codecs; a passage
counts only if the inversion decodes and garbling the result again gives the passage. This repeats, so passages
decoded wrongly several times are peeled layer by layer. Passages with replacement characters are reported, not
restorable.

The model is fitted on at most ``SAMPLE`` pages, chosen by a hash of their id, plus a few lines of other scripts; it
is a table of 64 kB per class, sent to each task once. Pages are scored where they are read, without a shuffle.

Defined results: null and empty texts and pure ASCII pages are never affected; a page delivered twice counts once;
a corpus too small or empty falls back to the built-in lines for training; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.sources.tables import latest
from sieveworks.storage import table

SAMPLE = 2000
BUCKETS = 1 << 14
MARGIN = 2.0

#: (encoding the bytes were written in, encoding they were read with)
CHAINS = [
    *(("utf-8", x) for x in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8-r", "cp866")),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("shift_jis", "cp1252"),
]

#: training lines for scripts and signs that a corpus may lack; all proper
LINES = [
    "Ключи от склада лежат у входа, отдел закрыт до понедельника.", "В пятницу собрание начнётся в девять часов утра.",
    "倉庫の鍵は入口にあります。会議は金曜日の朝に始まります。",
    "Η αποθήκη μένει κλειστή μέχρι την Παρασκευή.", "Οι φύλακες κρατούν τα κλειδιά στην είσοδο.",
    "Zażółć gęślą jaźń, a klucze leżą w szafie przy wejściu.", "Świetlica w Łodzi będzie otwarta później niż zwykle.",
    "Příliš žluťoučký kůň úpěl ďábelské ódy.", "A reunião sobre a ligação não começa amanhã.", "A SESSÃO NÃO FOI ADIADA, A LIÇÃO CONTINUA.",
    "LE CHÂTEAU, LA PÂTE ET LA FORÊT.", "På fredag är lådan tom, och nyckeln ligger kvar.", "Smørrebrød og æbler står på bordet.",
    "Şişli'deki çağrı için görüşme günü değişti.", "├── src", "│   ├── main", "│   └── data", "└── notes", "┌────┬────┐", "╔════╗ ║ x ║ ╚════╝", "░▒▓█",
    "√16 = 4, 6 ÷ 2 ≤ π · Ω – ¢ ¥ § ¶ ¬", "a ≥ b ∞ ∑ x² ≠ µ ± ½ ≈ ∂f ∫", "The price is £20 ± 3 °C, or 25 €.", "“Quoted” – ‘single’ … • item ™ ® ©", "© 2020 «Œuvre» ÆON ¿Qué? ¡Sí! ª º ¼ ¾ ×",
    "Überprüfung der Größe: höhere Sätze – „üblich“ sind 12 €.", "L’été coûte cher à Noël, déjà payé où l’œuvre naît.", "El niño llegó según el día acordado; ¿cuánto añade?",
]

_SEGMENT = re.compile(r"[^\n.!?]*[.!?\n]*\s*")
_HIGH = re.compile(r"[^\x00-\x7f]")


#: encodings of several bytes a sign
MULTI = {"utf-8", "shift_jis", "gbk", "euc_kr", "big5"}


def _tables() -> dict[str, tuple[str, dict[str, int]]]:
    """Single-byte codecs with the bytes they leave undefined passed through as control characters."""
    out = {}
    for name in {c for pair in CHAINS for c in pair} - MULTI:
        signs = "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))
        out[name] = (signs, {s: b for b, s in enumerate(signs)})
    return out


_CODECS = _tables()


def _encode(text: str, name: str) -> bytes | None:
    try:
        if name in MULTI:
            return text.encode(name)
        known = _CODECS[name][1]
        return bytes([known[s] for s in text])
    except (KeyError, UnicodeEncodeError):
        return None


def _decode(raw: bytes, name: str) -> str | None:
    if name not in MULTI:
        signs = _CODECS[name][0]
        return "".join([signs[b] for b in raw])
    try:
        return raw.decode(name)
    except UnicodeDecodeError:
        return None


def garble(text: str, chain: tuple[str, str]) -> str | None:
    raw = _encode(text, chain[0])
    return None if raw is None else _decode(raw, chain[1])


_SPLIT_SIGN = re.compile(rb"([\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]) ")


def invert(text: str, chain: tuple[str, str]) -> str | None:
    """The text before ``chain``, if it decodes strictly and garbling it again gives ``text``.

    A no-break space that has since become a blank inside a multi-byte sign is put back first.
    """
    raw = _encode(text, chain[1])
    back = None if raw is None else _decode(raw, chain[0])
    if back is None and raw is not None:
        raw = _SPLIT_SIGN.sub(b"\\1\xa0", raw)
        back, text = _decode(raw, chain[0]), _decode(raw, chain[1])
    if back is None or back == text or garble(back, chain) != text:
        return None
    return back


def segments(text: str) -> list[str]:
    """Sentences and lines; joined they give the text."""
    return [m for m in _SEGMENT.findall(text) if m]


def features(text: str) -> np.ndarray:
    """Buckets of the byte bigrams that touch a byte outside ASCII."""
    raw = np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8).astype(np.int32)
    a, b = raw[:-1], raw[1:]
    touched = (a | b) >= 128
    return (a[touched] * 257 + b[touched] * 4099) % BUCKETS


class ChainModel:
    """Multinomial naive Bayes; class 0 is proper text, class k is CHAINS[k - 1]."""

    def __init__(self, texts: list[str], alpha: float = 0.1) -> None:
        own = [s for t in texts for s in segments(t) if _HIGH.search(s) and "\ufffd" not in s]
        own = [s for s in own if not any(invert(s, c) for c in CHAINS if c[0] == "utf-8")]
        self._count(own, alpha)
        # records garbled in the sample itself would blur the class of proper text: leave them out and count again
        self._count([s for s in own if not self.peel(s)[1]], alpha)

    def _count(self, own: list[str], alpha: float) -> None:
        seen: list[list[np.ndarray]] = [[] for _ in range(len(CHAINS) + 1)]
        for s in [*own, *LINES * 3, *map(str.upper, LINES)]:
            seen[0].append(features(s))
            for k, chain in enumerate(CHAINS, 1):
                bad = garble(s, chain)
                if bad is not None and bad != s:
                    seen[k].append(features(bad))
        counts = np.stack([np.bincount(np.concatenate(x), minlength=BUCKETS) for x in seen]) + alpha
        self.weights = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)

    def scores(self, text: str) -> np.ndarray:
        return self.weights[:, features(text)].sum(axis=1)

    def peel(self, s: str) -> tuple[str, list[tuple[str, str]]]:
        """The restored segment and the chains that were inverted, outermost first."""
        path: list[tuple[str, str]] = []
        seen = {s}
        while _HIGH.search(s):
            score = self.scores(s)
            for k in np.argsort(-score, kind="stable"):
                if score[k] < score[0] + MARGIN:
                    return s, path
                back = invert(s, CHAINS[k - 1])
                # the result must itself be no less plausible as proper text, or be garbled in turn
                if back is not None and back not in seen and (not _HIGH.search(back) or self._plausible(back)):
                    s = back
                    seen.add(s)  # so that the peeling ends: no form comes twice
                    path.append(CHAINS[k - 1])
                    break
            else:
                return s, path
        return s, path

    def _plausible(self, back: str) -> bool:
        score = self.scores(back)
        return bool(score[0] + MARGIN >= score.max()) or any(invert(back, c) for c in CHAINS[:6])


def restore(model: ChainModel, text: str | None) -> tuple[str | None, int, int]:
    """The text with restored passages, the number of affected passages and of those not restorable."""
    if not text or not _HIGH.search(text):
        return text, 0, 0
    out, bad, lost = [], 0, 0
    for s in segments(text):
        if _HIGH.search(s):
            if "�" in s:
                bad, lost = bad + 1, lost + 1
            else:
                s, path = model.peel(s)
                bad += bool(path)
        out.append(s)
    return "".join(out), bad, lost


def fit(pages: DataFrame, sample: int = SAMPLE) -> ChainModel:
    """Trains on at most ``sample`` pages, those with the least hash of their id."""
    rows = (
        pages.filter("text is not null").select("text", F.xxhash64("page_id", F.lit(6)).alias("h")).orderBy("h").limit(sample).collect()
    )
    return ChainModel([r["text"] for r in rows])


_SCHEMA = "page_id long, text string, passages int, lost int"


def affected(pages: DataFrame, model: ChainModel, keep_text: bool = True) -> DataFrame:
    """(page_id, text) to the affected pages, with the restored text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ident, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                back, bad, lost = restore(shared.value, text)
                if bad:
                    rows.append((ident, back if keep_text else None, bad, lost))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "text", "passages", "lost"]
            )

    # pages without a sign outside ASCII never leave the JVM
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "text").filter(F.col("text").rlike(r"[^\x00-\x7f]")).mapInArrow(run, _SCHEMA)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return affected(pages, fit(pages), keep_text=False).select("page_id").distinct()


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return affected(latest(pages.select("page_id", "text", "loaded_at"), "page_id"), fit(pages))


QUERIES = {"p6_found": p6_found, "p6_restored": p6_restored}
ORACLE: dict[str, str] = {}
