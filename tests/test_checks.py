"""Scenarios over small documents."""

import random

import pytest
from pyspark.sql import functions as F

from sieveworks import storage
from sieveworks.operators import dedup, export_lint, extraction, metadata, retrieval, scoring, setjoin, versions
from sieveworks.sources import files
from tests.test_text import found_conflicts

SCHEMA = "path string, fmt string, text string, metadata map<string,string>, read_error string, extra int"
FILLER = " ".join(f"The storage rule number {k} applies to every visitor of the hall." for k in range(12))


def docs(spark, *rows):
    return spark.createDataFrame([(p, f, t, m, None, 1) for p, f, t, m in rows], SCHEMA)


def checks(df):
    return [(r["check"], r["severity"], r["path"]) for r in df.collect()]


def test_stale_and_conflict(spark):
    old = f"Effective: March 1, 2022\n{FILLER} Customers must return items within 30 days of purchase."
    new = f"Effective: March 1, 2024\n{FILLER} Customers must return items within 14 days of purchase."
    d = docs(spark, ("refund-policy-2022.md", "md", old, {}), ("refund-policy-2024.md", "md", new, {}), ("other.md", "md", "Nothing to see here at all.", {}))
    got = set(checks(versions.findings(d)))
    assert ("version-stale", "error", "refund-policy-2022.md") in got
    assert ("version-conflict", "error", "refund-policy-2022.md") in got


def test_superseded_is_muted(spark):
    old = f"{FILLER} Customers must return items within 30 days of purchase."
    new = f"{FILLER} Customers must return items within 14 days of purchase."
    d = docs(spark, ("policy-v1.md", "md", old, {"status": "Superseded"}), ("policy-v2.md", "md", new, {}))
    assert checks(versions.findings(d)) == [("version-stale", "info", "policy-v1.md")]


def test_duplicates_only(spark):
    d = docs(spark, ("a.md", "md", FILLER, {}), ("b.md", "md", FILLER.upper(), {}), ("c.md", "md", None, {}), ("d.md", "md", "", {}))
    assert checks(versions.findings(d)) == [("duplicate", "warn", "b.md")]


def test_period_twins(spark):
    body = lambda y: f"{FILLER} " + " ".join(f"Figure {k} of year {y} is {k * y % 97}." for k in range(20))
    d = docs(spark, *[(f"acme-10k-{y}.pdf", "pdf", body(y), {}) for y in (2021, 2022, 2023)])
    got = checks(versions.findings(d))
    assert got == [("version-period-twins", "warn", "acme-10k-2023.pdf")]


def test_empty_tables(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert versions.findings(d).count() == 0
    assert dedup.near_pairs(d).count() == 0
    page = d.select("path", "fmt", F.lit(1).alias("number"), "text", F.lit(0).alias("image_count"))
    assert extraction.findings(page).count() == 0


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}") for k in range(30)] + [("x", "y")], "path_a string, path_b string")
    got = {r["node"]: r["component"] for r in dedup.components(pairs).collect()}
    assert set(got.values()) == {"n00", "x"} and len(got) == 33


def test_components_of_a_long_shuffled_chain(spark):
    names = [f"n{k:04d}" for k in range(1000)]
    random.Random(7).shuffle(names)
    pairs = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "path_a string, path_b string")
    got = {r["node"]: r["component"] for r in dedup.components(pairs).collect()}
    assert len(got) == 1000 and set(got.values()) == {"n0000"}


def test_extraction_signals(spark):
    rows = [("s.pdf", "pdf", 1, " ", 2), ("s.pdf", "pdf", 2, "word " * 50, 0), ("g.md", "md", 1, "�" * 6 + " word" * 40, 0), ("e.txt", "txt", 1, "few words", 0), ("n.txt", "txt", 1, None, 0), ("i.docx", "docx", 1, "word " * 40, 6)]
    p = spark.createDataFrame(rows, "path string, fmt string, number int, text string, image_count int")
    got = set(checks(extraction.findings(p)))
    assert ("extraction-scanned", "error", "s.pdf") in got and ("extraction-garbled", "warn", "g.md") in got
    assert ("extraction-empty", "error", "e.txt") in got and ("extraction-empty", "error", "n.txt") in got and ("extraction-images", "warn", "i.docx") in got


def test_metadata(spark):
    few = docs(spark, ("a.md", "md", "Effective date: March 2024", {"title": "Document1", "author": "user"}), ("b.md", "md", "x", {"date": "2001", "owner": "Ann"}))
    got = set(checks(metadata.findings(few, 2026)))
    assert got == {("metadata-no-owner", "info", "a.md"), ("metadata-placeholder", "info", "a.md"), ("metadata-old", "info", "b.md")}
    many = docs(spark, *[(f"{k}.md", "md", "text", {"owner": "Ann"}) for k in range(6)])
    assert checks(metadata.findings(many, 2026)) == [("metadata-no-date", "warn", "(corpus)")]


def test_export(spark):
    rows = [(1, 0, "Travel is paid for staff and their family members", "a.md", 1.0, "1"), (2, 1, "only if it was approved before. Done.", "a.md", 2.0, None), (3, 2, "tiny", None, None, None), (4, 3, "Travel is paid for staff and their family members", "b.md", None, None)]
    c = spark.createDataFrame(rows, "chunk_id long, i int, text string, source string, ord double, page string")
    got = {(r["check"], r["path"]) for r in export_lint.findings(c).collect()}
    assert {("chunk-split", "a.md"), ("chunk-tiny", "(no source)"), ("chunk-duplicate", "(index)"), ("chunk-no-source", "(index)")} <= got


def test_scores(spark):
    f = spark.createDataFrame([("pii", "error", "a", []), ("pii", "error", "a", []), ("pii", "error", "a", []), ("x", "warn", "a", []), ("version-conflict", "error", "a", ["b"]), ("m", "warn", "(corpus)", [])], "check string, severity string, path string, related array<string>")
    d = spark.createDataFrame([("a", None), ("b", None), ("c", "broken")], "path string, read_error string")
    got = {r["path"]: r["score"] for r in scoring.document_scores(d, f).collect()}
    assert got == {"a": 100 - 35 - 4 - 12, "b": 88, "c": 0}
    rep = scoring.corpus_report(d, f).first()
    assert (rep["score"], rep["verdict"]) == (round((49 + 88) / 3) - 2, "NOT READY")


def test_bm25_prefers_the_term(spark):
    c = spark.createDataFrame([(1, "cats and dogs"), (2, "dogs dogs birds"), (3, None), (4, "")], "chunk_id long, text string")
    q = spark.createDataFrame([(9, "what do cats eat"), (8, "the of")], "query_id long, question string")
    assert [(r["query_id"], r["chunk_id"]) for r in retrieval.bm25(c, q).collect()] == [(9, 1)]


def test_files(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.md").write_text("hidden")
    (tmp_path / "a.md").write_text("---\nupdated: 2024-01-02\nowner: 'Ann'\n---\nBody ![x](y.png)\n")
    (tmp_path / "b.html").write_text("<title>T</title><script>no</script><p>Hi<td>x</td> there</p><img src=1>")
    (tmp_path / "c.txt").write_bytes("cafés".encode("latin-1"))
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    (tmp_path / "e.txt").write_text("")
    got = {r["path"]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "b.html", "c.txt", "d.docx", "e.txt"}
    assert got["a.md"]["metadata"] == {"updated": "2024-01-02", "owner": "Ann", "date": "2024-01-02", "author": "Ann"} and got["a.md"]["pages"][0]["line_offset"] == 4 and got["a.md"]["pages"][0]["image_count"] == 1
    assert got["b.html"]["metadata"]["title"] == "T" and got["b.html"]["pages"][0]["text"] == "Hi | x there" and got["b.html"]["pages"][0]["image_count"] == 1
    assert got["c.txt"]["pages"][0]["text"] == "cafés" and got["d.docx"]["read_error"].startswith("could not read") and got["e.txt"]["read_error"] == "file is empty"


def test_export_files(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"text": "one", "metadata": {"source": "a.md", "page": 3}, "chunk_index": "7"}\n{"content": "two", "source": ""}\n{"n": 1}\n')
    got = [(r["text"], r["source"], r["ord"], r["page"]) for r in files.read_export(spark, str(p)).orderBy("i").collect()]
    assert got == [("one", "a.md", 7.0, "3"), ("two", None, None, None)]
    q = tmp_path / "q.json"
    q.write_text('["a?", {"question": "b?"}]')
    assert [r["question"] for r in files.read_questions(spark, str(q)).orderBy("query_id").collect()] == ["a?", "b?"]


def varied(k, shared, own):
    """A text of ``shared`` words that all have and ``own`` words of its own."""
    return " ".join([f"common{i}" for i in range(shared)] + [f"own{k}x{i}" for i in range(own)])


def test_large_name_blocks_are_compared(spark, monkeypatch):
    rows = [(f"north/d{k}/rota-{2001 + k % 20}-v{k}.md", "md", varied(k, 40, 60), {}) for k in range(60)]
    links, _ = versions.edges(docs(spark, *rows))
    got = {(r["path_a"], r["path_b"]): round(r["jaccard"], 6) for r in links.collect()}
    assert len(got) == 60 * 59 // 2 and set(got.values()) == {round(36 / 156, 6)}
    monkeypatch.setattr(versions.same_names, "__defaults__", (100,))
    whole, _ = versions.edges(docs(spark, *rows))
    assert got == {(r["path_a"], r["path_b"]): round(r["jaccard"], 6) for r in whole.collect()}


def test_pairs_at_the_threshold(spark):
    sets = spark.createDataFrame([("a", list(range(70))), ("b", list(range(63, 70))), ("c", [500])], "path string, s array<bigint>")
    assert [(r["path_a"], r["path_b"], r["jaccard"]) for r in dedup.jaccard(dedup.candidates(sets, 0.1), sets).collect()] == [("a", "b", 0.1)]


def test_large_families(spark):
    body = lambda k: f"{FILLER} Customers must return items within {14 if k == 24 else 30 + k} days of purchase."
    d = docs(spark, *[(f"refund-policy-{2000 + k}.md", "md", body(k), {}) for k in range(25)])
    got = versions.findings(d).collect()
    stale = {r["path"]: r for r in got if r["check"] == "version-stale"}
    assert set(stale) == {f"refund-policy-{2000 + k}.md" for k in range(24)} and {r["severity"] for r in stale.values()} == {"error"}
    assert stale["refund-policy-2021.md"]["related"] == ["refund-policy-2024.md", "refund-policy-2023.md", "refund-policy-2022.md"]
    assert len([r for r in got if r["check"] == "version-conflict"]) == versions.SHOWN


def test_orders_of_groups(spark):
    kinds = "path string, date array<int>, version array<int>, marks array<string>, mtime double, status string"
    groups = {
        "dates": [("a", [2024, 0, 0], None, [], None, ""), ("b", [2024, 3, 0], None, [], None, "archived"), ("c", [2023, 5, 1], None, [], None, ""), ("d", None, [1], [], None, "")],
        "versions": [("a", None, [1, 2], [], None, ""), ("b", None, [1, 10, 0, 1], [], None, ""), ("c", None, [2], [], None, "obsolete")],
        "words": [("a", None, [1], ["old"], None, ""), ("b", None, None, ["copy", "latest"], None, ""), ("c", None, None, [], None, "")],
        "times": [("a", None, None, [], 1.7e9, ""), ("b", None, None, [], 1.7e9 + 90_000, ""), ("c", None, None, [], 1.7e9 + 1, "")],
        "none": [("a", None, [1], [], None, ""), ("b", None, [1], [], 5.0, "retired")],
    }
    rows = [(g, *r, 0.5, []) for g, rs in groups.items() for r in rs]
    got = versions.pairing(spark.createDataFrame(rows, f"group string, {kinds}, max_sim double, years array<int>")).collect()
    pairs = {(r["group"], r["path"], r["newer"][0], r["ordered"], r["muted"]) for r in got if r["kind"] == "pair"}
    stale = {(r["group"], r["path"]): (r["newer"], r["src"], r["muted"]) for r in got if r["kind"] == "stale"}
    assert pairs == {
        ("dates", "c", "a", True, False), ("dates", "c", "b", True, True), ("versions", "a", "c", True, True), ("versions", "b", "c", True, True), ("words", "a", "b", True, False), ("words", "c", "b", True, False),
        ("times", "a", "b", True, False), ("times", "c", "b", True, False), ("none", "a", "b", False, True),
    }
    assert stale[("dates", "c")] == (["b", "a"], "date", False) and stale[("versions", "a")] == (["c", "b"], "version number", False)
    assert stale[("words", "a")] == (["b", "c"], "filename (old/new)", False) and stale[("times", "c")] == (["b"], "file modification time", False) and ("none", "a") not in stale


def test_conflicts_beyond_4000_statements(spark):
    word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    body = " ".join(f"Item q{word(k)} r{word(k)} s{word(k)} is kept here." for k in range(4100))
    got = found_conflicts(spark, f"{body} Customers must return items within 30 days.", f"{body} Customers must return items within 14 days.")
    assert [r for *_, r in got] == ["different values for 'day': 30 vs 14"]


def test_statements_of_common_words_alone(spark):
    body = [f"The visitor pays {k} dollars in hall number {k}." for k in range(400)]
    old, new = " ".join([*body, "The visitor pays 900 dollars in hall."]), " ".join([*body, "The visitor pays 950 dollars in hall."])
    assert ("The visitor pays 900 dollars in hall.", "The visitor pays 950 dollars in hall.") in {(a, b) for a, b, _ in found_conflicts(spark, old, new)}


def test_long_page_ranges(spark):
    f = spark.createDataFrame([("p.1–5000",), ("p.7, 9 - 10; p.12, line 5",), ("p.9–3",), ("",), (None,)], "location string")
    got = [(r["location"], r["page"]) for r in scoring.pages(f).collect()]
    assert sorted(got) == sorted([("p.1–5000", k) for k in range(1, 5001)] + [("p.7, 9 - 10; p.12, line 5", k) for k in (7, 9, 10, 12)])


def test_no_index_after_a_crashed_check(spark):
    d = docs(spark, ("a.md", "md", FILLER, {}))
    f = spark.createDataFrame([("versions-crashed", "info", "versions check failed: OSError", "", [])], "check string, severity string, title string, path string, related array<string>")
    with pytest.raises(ValueError, match="versions check failed"):
        retrieval.after_index(d, f)
    assert retrieval.after_index(d, f.limit(0)).count() == 1


def _family_texts(rng, families, members):
    """Texts of families whose members share from about a third to nearly all of their words, among common phrases."""
    phrases = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(20)]
    rows = []
    for f in range(families):
        body = [f"f{f}w{i}" for i in range(rng.choice([30, 150, 600]))]
        for m in range(members):
            w = list(body)
            for i in rng.sample(range(len(w)), int(len(w) * rng.random() * 0.16)):
                w[i] = f"x{f}m{m}i{i}"
            rows.append((f"d{f}/m{m}.md", " ".join([*rng.sample(phrases, 2), *w])))
    return rows


def test_near_pairs_of_families_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "PART", 3_000)
    monkeypatch.setattr(setjoin, "STEP", 50)
    rows = _family_texts(random.Random(3), 60, 5)
    rows.append(("copy.md", rows[0][1].upper()))
    sets = {p: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for p, t in rows[:-1]}
    sets["copy.md"] = sets.pop(rows[0][0])  # the lesser path stands for both
    want = {}
    for a in sets:
        for b in sets:
            if a < b and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.5:
                want[a, b] = round(j, 9)
    got = dedup.near_pairs(spark.createDataFrame(rows, "path string, text string")).collect()
    assert {(r["path_a"], r["path_b"]): round(r["jaccard"], 9) for r in got} == want and len(got) == len(want) > 30


def test_near_pairs_write_less_than_they_read(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(f"{k}.md", " ".join(rng.choice(["in", "on", "at", "to", "by", "up"]) for _ in range(200))) for k in range(2000)]
    spark.createDataFrame(rows, "path string, text string").write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(storage, "shared_dir", lambda s: f"file://{tmp_path}/shared")
    dedup.near_pairs(spark.read.parquet(str(tmp_path / "docs"))).collect()
    size = lambda p: sum(x.stat().st_size for x in p.rglob("*.parquet"))
    assert size(tmp_path / "shared") < size(tmp_path / "docs")
