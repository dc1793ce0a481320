"""Trains the tagger of problem 3: ``python -m sieveworks.llm.p3_train [PAGES.parquet [STEPS [continue]]]``.

Labelled spans come from ``p3_synthetic``. With a table of pages, sentences of it that show no sign of personal data
(at most ``NEGATIVES``, in order of a hash) are mixed in as text without any.
"""

from __future__ import annotations

import multiprocessing
import random
import re
import sys
from contextlib import contextmanager

import numpy as np

from sieveworks.llm.p3_model import KINDS, PAD, Tagger, encode, train
from sieveworks.llm.p3_personal import _DATE, _DIGITS, WEIGHTS
from sieveworks.llm.p3_synthetic import GIVEN, Writer

NEGATIVES = 30_000
HIDDEN, WORKERS = 24, 4
#: characters of a window in training
LENGTH = 128
_DOUBT = re.compile(
    r"[@<>\\{}\[\]]|\(\d|\b[A-Z]\. |\b(?:" + "|".join(GIVEN) + "|" + "|".join(map(str.upper, GIVEN)) + r")\b"
    r"|(?i:\b(?:street|st|road|rd|lane|ln|avenue|ave|court|close|terrace|drive|rue|boulevard|impasse|chemin|allée|place|calle|c/|paseo|plaza|camino|avenida)\b.{0,30}\d|\d.{0,30}\b(?:street|st|road|rd|lane|ln|avenue|ave|court|close|terrace|drive|rue|boulevard|impasse|chemin|allée|place)\b|(?:straße|str\.|weg|platz|gasse|allee|wehr) \d)"
)


def _doubtful(s: str) -> bool:
    return bool(_DOUBT.search(s)) or any(sum(c.isdigit() for c in m.group()) > 5 and not _DATE.match(m.group()) for m in _DIGITS.finditer(s))


def negatives(path: str) -> list[str]:
    import pyarrow.parquet as pq
    import xxhash

    found: set[str] = set()
    for text in pq.read_table(path, columns=["text"])["text"].to_pylist():
        for s in re.split(r"(?<=[.!?])\s+|\n", text or ""):
            if 20 < len(s) < 160 and not _doubtful(s):
                found.add(s)
    return sorted(found, key=xxhash.xxh3_64_intdigest)[:NEGATIVES]


def batches(seed: int, size: int, plain: list[str]):
    """Windows over whole texts, wherever personal data may stand in them."""
    w = Writer(seed)
    ids, tags = [], []
    while True:
        text, spans = w.text(plain)
        codes = np.concatenate([encode(text), np.full(LENGTH, PAD, np.uint8)])
        gold = np.zeros(len(codes), np.uint8)
        for s, e, kind in spans:
            gold[s] = 1 + 2 * KINDS.index(kind)
            gold[s + 1 : e] = 2 + 2 * KINDS.index(kind)
        at = w.r.choice([0, w.r.randrange(LENGTH)])
        for s in range(at if len(text) > LENGTH else 0, len(text), LENGTH * 3 // 4):
            ids.append(codes[s : s + LENGTH])
            tags.append(gold[s : s + LENGTH])
            if len(ids) == size:
                yield np.stack(ids).astype(np.int64), np.stack(tags).astype(np.int64)
                ids, tags = [], []


def _work(pipe, hidden: int, seed: int, size: int, plain: list[str]) -> None:
    model, made = Tagger(hidden), batches(seed, size, plain)
    while (p := pipe.recv()) is not None:
        model.p = p
        pipe.send(model.gradients(*next(made)))


@contextmanager
def shared(model: Tagger, seed: int, size: int, plain: list[str], workers: int):
    """Mean loss and gradients over the batches of several processes."""
    pipes = []
    for k in range(workers):
        here, there = multiprocessing.Pipe()
        multiprocessing.Process(target=_work, args=(there, model.h, seed + 1000 * k, size, plain), daemon=True).start()
        pipes.append(here)

    def gradients() -> tuple[float, dict[str, np.ndarray]]:
        for x in pipes:
            x.send(model.p)
        got = [x.recv() for x in pipes]
        return sum(loss for loss, _ in got) / workers, {k: sum(g[k] for _, g in got) / workers for k in model.p}

    try:
        yield gradients
    finally:
        for x in pipes:
            x.send(None)


def accuracy(model: Tagger, seed: int, texts: int = 400) -> dict[str, tuple[float, float]]:
    """Precision and recall of exact spans on held-out texts."""
    from sieveworks.llm.p3_personal import tag

    w = Writer(seed)
    made = [w.text() for _ in range(texts)]
    hit, got, want = (dict.fromkeys(KINDS, 0) for _ in range(3))
    for (_, spans), found in zip(made, tag(model, [t for t, _ in made]), strict=True):
        truth = {(k, s, e) for s, e, k in spans}
        for k, s, e in found:
            got[KINDS[k]] += 1
            hit[KINDS[k]] += (KINDS[k], s, e) in truth
        for k, _, _ in truth:
            want[k] += 1
    return {k: (hit[k] / max(1, got[k]), hit[k] / max(1, want[k])) for k in KINDS}


def main(argv: list[str]) -> None:
    random.seed(0)
    plain = negatives(argv[0]) if argv else []
    steps = int(argv[1]) if len(argv) > 1 else 3000
    again = argv[2:] == ["continue"]
    model = Tagger.load(WEIGHTS) if again else Tagger(hidden=HIDDEN, seed=3)
    print(len(plain), "sentences without personal data")
    with shared(model, 12 if again else 11, 64, plain, WORKERS) as gradients:
        train(model, gradients, steps, 0.006 if again else 0.01)
    model.save(WEIGHTS)
    for kind, (p, r) in accuracy(model, 99).items():
        print(f"{kind}: precision {p:.3f}, recall {r:.3f}")


if __name__ == "__main__":
    main(sys.argv[1:])
