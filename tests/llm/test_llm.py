"""Operators for training data: brute force, round trips and held-out accuracy on small rows."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveworks.llm import p1_format_duplicates as p1
from sieveworks.llm import p2_markup as p2
from sieveworks.llm import p3_personal as p3
from sieveworks.llm import p3_synthetic, p3_train
from sieveworks.llm import p4_near_duplicates as p4
from sieveworks.llm import p5_splitting as p5
from sieveworks.llm import p6_encoding as p6
from sieveworks.llm import p7_leakage as p7
from sieveworks.llm import p8_mixing as p8
from sieveworks.llm import p9_subjects as p9
from sieveworks.llm.words import canonical, words

REC = "record_kind string, id long, text string, bucket int"
WORDS = "amber birch cedar delta ember flint grove hazel ivory jade kelp lilac maple nettle olive poppy quartz reed sage thyme umber violet willow yarrow".split()


def text_of(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


# ---------------------------------------------------------------- problem 1
def test_canonical_forms():
    a = "Owner: Ann\nState: Open\n\nThe Café is closed, until further notice!"
    assert canonical(a)[0] == canonical("STATE:  OPEN\r\nOWNER: ANN\r\n\r\nthe cafe\u0301 is closed until\u00a0further notice")[0]
    assert canonical(a)[0] != canonical("Owner: Ann\nState: Closed\n\nThe Café is open until further notice")[0]
    assert canonical(None) == ("", 0) and canonical("...") == ("", 0)


@pytest.mark.parametrize("limit", [3, 20_000])
def test_duplicates_as_brute_force(spark, limit):
    r = random.Random(1)
    base = [text_of(r, r.randrange(8, 40)) for _ in range(30)]
    rows = [("documents", k, r.choice([str.upper, str.lower, str.title, lambda s: s.replace(" ", "  ")])(r.choice(base)), 0) for k in range(120)]
    rows += [("chunks", k, base[0], 1) for k in range(40)] + [("chunks", 7, base[0], 2), ("chunks", 900, None, 0), ("chunks", 901, "", 0), ("documents", 902, "short text", 0), ("documents", 903, "short text", 0)]
    df = spark.createDataFrame(rows, REC)
    groups = {}
    for kind, i, t, _ in rows:
        key, n = canonical(t)
        if n >= 10:
            groups.setdefault((kind, key), set()).add(i)
    want = {(k, min(g), i) for (k, _), g in groups.items() for i in g if i != min(g)}
    assert {tuple(x) for x in p1.duplicate_members(df, bucket_rows=limit).collect()} == want
    assert {tuple(x) for x in p1.collapsed(df, bucket_rows=limit).collect()} == {(k, min(g), len(g)) for (k, _), g in groups.items()}


@given(st.lists(st.binary(max_size=6), max_size=60))
@settings(deadline=None)
def test_trie_counts(keys):
    trie = p1.RadixTrie()
    for k, key in enumerate(keys):
        trie.add(key, k)
    want = {}
    for k, key in enumerate(keys):
        want.setdefault(key, []).append(k)
    assert sorted(trie.terminals()) == sorted(want.values())


# ---------------------------------------------------------------- problem 2
@pytest.mark.parametrize("text,kinds", [
    ("<h1>A</h1><p>b</p>", ["html"]), ("a &amp; b", ["html"]), ("# T\n\ntext **b**", ["markdown"]), ("see [x](y)", ["markdown"]), ("== T ==\n\n[[a|b]]", ["wiki"]), ("\\section{A} b", ["latex"]), ("x $a_1 = b$ y", ["latex"]),
    ("# T\n\n$a_1 = b$", ["markdown"]), ("- a\n- b\n1. c", []), ("a | b | c", []), ("C:\\shared\\x and <a.b@c.example> at 3 * 4", []), ("Fees of $5 and $6 apply, a < 7 and b > 8", []), ("unit_count_4 [3] #13", []), (None, []), ("", []),
])
def test_markup_kinds(text, kinds):
    assert p2.convert(text)[1] == kinds


def test_markup_keeps_structure():
    clean, _ = p2.convert("<h1>T</h1><script>x</script><p>a <b>b</b></p><ul><li>c<li>d</ul><table><tr><td>e<td>f<tr><td>g<td>h</table><pre><code>if a &lt; b:\n  c</code></pre>")
    assert clean == "T\n\na b\n\n- c\n- d\n\ne | f\ng | h\n\n    if a < b:\n      c"
    assert p2.convert("T\n===\n\n```py\nx = 1\n```\n\n| a | b |\n|---|---|\n| c | d |\n\n> *q*")[0] == "T\n\n    x = 1\n\na | b\nc | d\n\nq"
    assert p2.convert("\\section{T}\n\\begin{itemize}\n\\item a\n\\item \\textbf{b}\n\\end{itemize}")[0] == "T\n\n- a\n- b"
    assert p2.convert("== T ==\n{| class=x\n! a !! b\n|-\n| c || d\n|}\n# e\n# f")[0] == "T\n\na | b\nc | d\n1. e\n2. f"


def test_regions_of_planted_pages():
    """Of pages with known content and known residue, all content stays and link bars go."""
    r = random.Random(4)
    kept = lost = gone = planted = 0
    for _ in range(60):
        content = [" ".join(r.choice(WORDS) for _ in range(r.randrange(12, 40))) + "." for _ in range(r.randrange(4, 9))]
        bars = [" ".join(f'<a href="/{r.randrange(99)}">{w}x</a>' for w in r.sample(WORDS, 6)) for _ in range(r.randrange(1, 4))]
        body = [f"<p>{x}</p>" for x in content] + ["<h2>Part</h2>", "<p>x = y<sup>2</sup> + 1</p>", "<ul><li>one<li>two</ul>"]
        clean, _, dropped = p2.cleaned_text("\n".join([f"<div>{b}</div>" for b in bars] + body))
        lines = {x.strip() for x in clean.split("\n")}
        kept += sum(x in lines for x in content)
        lost += sum(x not in lines for x in [*content, "Part", "x = y2 + 1", "- one", "- two"])
        planted += len(bars)
        gone += dropped
    assert lost == 0 and kept > 200 and gone > 0.9 * planted


# ---------------------------------------------------------------- problem 3
def test_personal_data_held_out():
    found = p3_train.accuracy(p3.tagger(), 4242, 150)
    for kind, (precision, recall) in found.items():
        assert precision > 0.9 and recall > 0.9, kind


def test_personal_data_values():
    text = "Write to anna.weber@north-post.example or call +44 20 7946 0123. General questions go to info@north-post.example. Part no. 123-45-67890 fits."
    hits = p3.find(p3.tagger(), [text, "", "nothing here"])
    assert {(k, v) for k, _, _, v in hits[0]} == {("email", "anna.weber@north-post.example"), ("phone", "442079460123")} and hits[1:] == [[], []]
    assert p3.redact(text, hits[0]).startswith("Write to [EMAIL] or call [PHONE]. General")


def test_personal_data_every_character_is_read():
    class Marks:
        known = frozenset()

        def decode(self, ids):
            return np.full(ids.shape, 2, np.uint8)

    plain = "nothing of any shape stands in words like these, " * 100
    for n in (1, 5, 64, 1000, 1024, 1025, 1984, 1985, 4900):
        assert p3.tag(Marks(), [plain[:n], "", plain[:n]]) == [[(0, 0, n)], [], [(0, 0, n)]], n


def test_personal_data_wherever_it_stands():
    m = p3.tagger()
    row = "Marta Talstrømme, 820-93-4653, Flat 34, 63 Station St, Ilmenau am Wehr"
    assert ("street_address", "63 Station St") in {(k, v) for k, _, _, v in p3.find(m, [row])[0]}
    plain = "The older versions are kept at the depot and closed after a year. " * 40
    texts = [plain[:n] + "\nWrite to anna.weber@north-post.example with the details.\n" + plain[: 2400 - n] for n in range(900, 1100, 8)]
    company = p3.find(m, [row, "short", *texts, plain])[2:-1]
    assert all(("email", "anna.weber@north-post.example") in {(k, v) for k, _, _, v in hits} for hits in company)
    assert company[::6] == [p3.find(m, [t])[0] for t in texts[::6]]


def test_personal_data_steps_and_padding():
    import pyarrow as pa

    r = random.Random(8)
    texts = ["x" * r.choice([0, r.randrange(1, 1000), r.randrange(1, 1000), r.randrange(200, 900), r.randrange(1000, 5000)]) for _ in range(10_000)]
    work = {"steps": 0, "cells": 0, "read": 0}

    class Counts:
        def decode(self, ids):
            work["steps"] += ids.shape[1]
            work["cells"] += ids.size
            work["read"] += np.count_nonzero(ids)
            return np.zeros(ids.shape, np.uint8)

    batch = pa.RecordBatch.from_arrays([pa.array(["pages"] * len(texts)), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["record_kind", "id", "text"])
    seen = 0
    for _, ids, part in p3._texts(iter([batch])):
        seen += len(ids)
        p3.tag(Counts(), part)
    chars = sum(map(len, texts))
    assert seen == len(texts) and work["read"] >= chars  # nothing is left out
    assert work["cells"] < 1.08 * chars and work["steps"] * 480 < chars


def test_personal_data_at_the_end_in_any_company():
    m = p3.tagger()
    longer = "The older versions are kept at the depot and closed after a year. " * 6
    for text in ("a second signature from Elmhurst Dale Branch. Tel 5205550180", "The branch asks for a list. Tel 9515550158"):
        alone = p3.find(m, [text])[0]
        assert alone and p3.find(m, [text, longer])[0] == alone == p3.find(m, [longer, text, "short"])[1]


def test_network_as_written_out():
    from sieveworks.llm.p3_model import PAD, VOCAB, Tagger

    m = Tagger(hidden=5, seed=4)
    h, p = m.h, {k: v.astype(float) for k, v in m.p.items()}
    r = np.random.default_rng(5)
    ids = r.integers(1, VOCAB, (6, 40)).astype(np.uint8)
    for k, n in enumerate((40, 40, 33, 12, 1, 0)):
        ids[k, n:] = PAD
    want = np.zeros((40, len(p["b"]), 6)) + p["b"][:, None]
    for k, row in enumerate(ids):
        for way, order in ((0, range(40)), (1, range(39, -1, -1))):
            state, cell = np.zeros(h), np.zeros(h)
            for t in order:
                z = p["x"][way, row[t]] + state @ p["u"][way]
                i, f, o = (z[: 3 * h] * 0.5 + 0.5).clip(0, 1).reshape(3, h) * (row[t] != PAD)
                cell = cell * f + i * z[3 * h :].clip(-1, 1)
                c = cell.clip(-3, 3)
                state = o * c * (27 + c * c) / (27 + 9 * c * c)
                want[t, :, k] += state @ p["w"][way * h : (way + 1) * h]
    assert abs(m.emissions(ids) - want).max() < 1e-4


def test_gradients_match_differences():
    from sieveworks.llm.p3_model import Tagger

    m = Tagger(hidden=3, seed=1)
    r = np.random.default_rng(0)
    ids, tags = r.integers(4, 90, (3, 7)), r.integers(0, 11, (3, 7))
    _, g = m.gradients(ids, tags)
    for name, at in (("u", (1, 0, 5)), ("w", (2, 3)), ("t", (1, 2)), ("x", (0, ids[0, 3], 4))):
        keep = m.p[name][at]
        m.p[name][at] = keep + 1e-2
        up = m.gradients(ids, tags)[0]
        m.p[name][at] = keep - 1e-2
        down = m.gradients(ids, tags)[0]
        m.p[name][at] = keep
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-3


def test_synthetic_spans():
    w = p3_synthetic.Writer(3)
    for _ in range(200):
        text, spans = w.text()
        assert all(0 <= s < e <= len(text) for s, e, _ in spans)


# ---------------------------------------------------------------- problem 4
def test_near_pairs_as_brute_force(spark):
    r = random.Random(2)
    rows = []
    for fam in range(12):
        base = text_of(r, 60).split()
        for _ in range(6):
            v = list(base)
            for _ in range(r.randrange(0, 5)):
                v[r.randrange(len(v))] = r.choice(WORDS)
            rows.append(("pages", len(rows), " ".join(v), fam))
    rows += [("pages", 500, rows[0][2].upper(), 0), ("pages", 0, rows[0][2], 1), ("pages", 501, None, 0), ("pages", 502, "", 0), ("pages", 503, "few words", 0), ("documents", 0, rows[0][2], 0)]
    df = spark.createDataFrame(rows, REC)
    sets = {}
    for kind, i, t, _ in rows:
        w = words(t)
        if len(w) >= 20:
            sets[kind, i] = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)}, canonical(t)[0])
    want = set()
    for (a, (x, ca)), (b, (y, cb)) in itertools.combinations(sorted(sets.items()), 2):
        if a[0] == b[0] and ca != cb and 2 * len(x & y) >= len(x | y):
            want.add((a[0], a[1], b[1]))
    for shard in (4096, 4):
        close, members = p4.near_pairs(df, shard_rows=shard)
        got = {(x["record_kind"], x["id_a"], x["id_b"]) for x in p4.expand(close, members).collect()}
        assert got == want


def test_vantage_tree_finds_all():
    r = np.random.default_rng(1)
    pts = r.integers(0, 1 << 63, (400, 3), dtype=np.uint64)
    pts[200:] = pts[:200] ^ (np.uint64(1) << r.integers(0, 60, (200, 3), dtype=np.uint64))
    tree = p4.VantageTree(pts, leaf=8)
    got = {(int(a), int(b)) for q, p in tree.pairs(pts, 20) for a, b in zip(q, p, strict=True)}
    d = np.bitwise_count(pts[:, None] ^ pts[None]).sum(axis=2)
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 20), strict=True)}


# ---------------------------------------------------------------- problem 5
@given(st.text(alphabet="ab. \n,é", max_size=900), st.integers(30, 120), st.integers(0, 20))
@settings(max_examples=150, deadline=None)
def test_pieces_round_trip(text, limit, overlap):
    cut = p5.split(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e in cut) == text
    for k, (s, b, e) in enumerate(cut):
        assert e - s <= limit and b - s <= overlap and (k == 0 or b == cut[k - 1][2])


def test_pieces_prefer_strong_boundaries(spark):
    para = "One two three four five. " * 6
    text = f"{para}\n\n{para}\n\n{para}"
    assert [text[b:e].strip() for _, b, e in p5.split(text, 170, 10)] == [para.strip()] * 3
    df = spark.createDataFrame([("documents", 1, text, 0), ("documents", 2, None, 0), ("documents", 3, "", 0), ("documents", 4, "x" * 500, 0)], "record_kind string, record_id long, text string, piece int")
    assert {r["record_id"] for r in p5.pieces(df, 170, 10).collect()} == {1, 4}


# ---------------------------------------------------------------- problem 6
def test_encoding_round_trips():
    model = p6.ChainModel([])
    for text in ("Für die Änderung gelten höhere Sätze, üblich sind größere.", "Le contrôle français a été achevé à l'équipe.", "El niño llegó después del día; ¿cuánto añade?"):
        for chain in [("utf-8", "cp1252"), ("utf-8", "cp437"), ("cp1252", "cp437"), ("cp1252", "cp1251"), ("utf-8", "cp1251")]:
            bad = p6.garble(text, chain)
            assert p6.restore(model, bad)[0] == text, chain
        twice = p6.garble(p6.garble(text, ("utf-8", "cp1252")), ("utf-8", "cp1252"))
        assert p6.restore(model, twice)[0] == text
        assert p6.restore(model, text) == (text, 0, 0)
        five = text
        for _ in range(5):
            five = p6.garble(five, ("utf-8", "cp1252"))
        assert p6.restore(model, five)[0] == text
    for line in p6.LINES:
        assert p6.restore(model, line)[1] == 0, line
    assert p6.restore(model, "d�t")[1:] == (1, 1) and p6.restore(model, None) == (None, 0, 0)


def test_encoding_on_tables(spark):
    rows = [(1, "Fachwörter für Übungen.", "x"), (2, p6.garble("Größere Änderungen für die Prüfung über höhere Sätze.", ("utf-8", "cp1252")), "x"), (3, None, "x"), (4, "", "x"), (2, "Grün", "again")]
    df = spark.createDataFrame(rows, "page_id long, text string, passages string")
    assert [r["page_id"] for r in p6.affected(df, p6.fit(df)).collect()] == [2]


# ---------------------------------------------------------------- problem 7
def test_leaks_as_brute_force(spark):
    r = random.Random(3)
    items = [(k, text_of(r, 40)) for k in range(8)] + [(8, None), (9, "short"), (10, "")]
    docs = []
    for k in range(60):
        w = text_of(r, 80).split()
        src = items[r.randrange(8)][1].split()
        n, at, to = r.randrange(8, 18), r.randrange(20), r.randrange(60)
        docs.append((k, " ".join([*w[:to], *src[at : at + n], *w[to:]]).upper(), k))
    docs += [(60, None, 0), (61, "", 0), (0, docs[0][1], 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    i = spark.createDataFrame(items, "item_id long, text string")
    for n, sizes in ((12, (1 << 20, 0)), (9, (1 << 20,)), (5, (0,))):
        want = set()
        for doc, t, _ in docs:
            w = words(t)
            runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            for item, u in items:
                v = words(u)
                if any(tuple(v[k : k + n]) in runs for k in range(len(v) - n + 1)):
                    want.add((doc, item))
        for size in sizes:
            assert {(x["doc_id"], x["item_id"]) for x in p7.leaks(d, i, run=n, broadcast_bytes=size).collect()} == want


# ---------------------------------------------------------------- problem 8
def test_rates():
    got = p8.rates({"a": 100, "b": 900, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 1, "c": 9})
    assert got["a"] == 2 and got["b"] == pytest.approx(800 / 900) and got["c"] == 0
    assert p8.rates({}, {"a": 1.0}, {"a": 1}) == {"a": 0.0}


def test_mixing(spark):
    docs = spark.createDataFrame([(k, "  A_b " if k % 2 else "C", "some words here", 1) for k in range(2000)] + [(5000, None, "x", 1), (5001, "a-b", None, 1)], "doc_id long, source string, text string, times int")
    mix = spark.createDataFrame([("a-b", 0.75, 3), ("c", 0.25, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeat int")
    tokens = p8.with_tokens(docs).withColumn("source", p8.source_key(F.col("source")))
    planned = p8.plan(tokens, mix)
    got = p8.takes(tokens, planned).groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("n"), F.max("times").alias("m")).collect()
    by = {r["source"]: r for r in got}
    share = by["a-b"]["n"] / (by["a-b"]["n"] + by["c"]["n"])
    assert abs(share - 0.75) < 0.03 and by["a-b"]["m"] <= 3 and by[None]["n"] == 0
    taken = p8.takes(tokens, planned)
    emitted = p8.mixed(docs.dropDuplicates(["doc_id"]), taken).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in emitted} == {r["doc_id"]: r["times"] for r in taken.collect() if r["times"]}


# ---------------------------------------------------------------- problem 9
def test_subjects(spark):
    r = random.Random(5)
    vocab = {"law": "court filings statutes appeals patents", "sport": "goalkeepers referees matches drills fixtures", "food": "recipes ovens menus kitchens spices"}
    rows, labels = [], []
    for k in range(240):
        s = list(vocab)[k % 3]
        rows.append((k, " ".join(f"The {r.choice(vocab[s].split())} of the office and the {r.choice(vocab[s].split())} are kept in list {j}." for j in range(6)), "x"))
        if k < 150:
            labels.append((k, s.title() if k % 7 else f" {s} ", "t"))
    rows += [(900, "The lists of the office are kept.", "x"), (901, None, "x"), (902, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, subject string")
    lab = spark.createDataFrame([*labels, (3, None, "t"), (4, "nonsense", "t")], "doc_id long, subject string, labelled_by string")
    got = {}
    for x in p9.assign(docs, p9.fit(docs, lab)).collect():
        got.setdefault(x["doc_id"], []).append(x["subject"])
    right = sum(got.get(k) == [list(vocab)[k % 3]] for k in range(150, 240))
    assert right >= 85 and not {900, 901, 902} & set(got)
    assert p9.assign(docs, p9.fit(docs, lab.limit(0))).count() == 0


def test_subjects_do_not_depend_on_size(spark):
    """Ten copies of labels and documents give the same rules and choices: every count is a share."""
    r = random.Random(6)
    vocab = {"law": "court filings statutes appeals patents", "sport": "goalkeepers referees matches drills fixtures"}
    rows = []
    for k in range(120):
        words_ = vocab[list(vocab)[k % 2]].split()
        rows.append((k, " ".join(f"The {r.choice(words_)} {r.choice(WORDS)} of the {r.choice(WORDS)} and the {r.choice(words_)} are kept here." for _ in range(8)), list(vocab)[k % 2]))
    got = []
    for times in (1, 10):
        docs = spark.createDataFrame([(k + 1000 * n, t, s) for n in range(times) for k, t, s in rows], "doc_id long, text string, subject string")
        p9_support, p9.MIN_SUPPORT = p9.MIN_SUPPORT, 0.02
        try:
            model = p9.fit(docs, docs.select("doc_id", "subject"))
        finally:
            p9.MIN_SUPPORT = p9_support
        got.append([model.subjects(t) for _, t, _ in rows])
    same = [sum([p9.SUBJECTS.index(s)] == x for (_, _, s), x in zip(rows, g, strict=True)) for g in got]
    assert min(same) >= 114


# ---------------------------------------------------------------- empty tables
def test_empty_tables(spark):
    e = spark.createDataFrame([], REC)
    assert p1.duplicate_members(e).count() == 0 and p3.found(e).count() == 0
    close, members = p4.near_pairs(e)
    assert p4.expand(close, members).count() == 0
    assert p5.pieces(e.withColumnRenamed("id", "record_id"), 100, 10).count() == 0
    pages = spark.createDataFrame([], "page_id long, text string")
    assert p2.cleaned(pages).count() == 0 and p6.affected(pages, p6.fit(pages)).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert p7.leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    tokens = p8.with_tokens(docs)
    assert p8.takes(tokens, p8.plan(tokens, spark.createDataFrame([], "source string, target_share double, max_repeat int"))).count() == 0


def test_very_long_text(spark):
    long = "Wort für Wort. " * 60_000
    df = spark.createDataFrame([("documents", 1, long, 0)], REC)
    assert p1.duplicate_members(df).count() == 0 and p3.found(df).count() == 0
    assert p5.pieces(df.withColumnRenamed("id", "record_id"), 4000, 200).count() > 200
    assert re.search("Wort", p2.convert("<p>" + long)[0])
