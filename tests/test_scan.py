import json

import pytest

from sieveworks import cli
from sieveworks.plans import index_queries, report, scan
from sieveworks.sources import files
from sieveworks.streaming import incremental


def corpus(tmp_path):
    filler = " ".join(f"The storage rule number {k} applies to every visitor of the hall." for k in range(12))
    (tmp_path / "policy-2022.md").write_text(f"Effective: March 1, 2022\n\n{filler} Items must be returned within 30 days.")
    (tmp_path / "policy-2024.md").write_text(f"Effective: March 1, 2024\n\n{filler} Items must be returned within 14 days.")
    (tmp_path / "notes.txt").write_text("Call 415-555-0187 or write to jane@gmail.com about the password: hunter22. " * 3)
    (tmp_path / "bad.docx").write_bytes(b"x")


def test_scan_reports(spark, tmp_path):
    corpus(tmp_path)
    docs = files.with_text(files.read_documents(spark, str(tmp_path)))
    found, summary = scan.scan(docs, scan.Options(2026))
    checks = {(r["check"], r["path"]) for r in found.collect()}
    assert {("version-stale", "policy-2022.md"), ("version-conflict", "policy-2022.md"), ("secret", "notes.txt"), ("pii", "notes.txt"), ("unreadable", "bad.docx")} <= checks
    got = json.loads(report.to_json(summary, found, "x"))
    assert got["verdict"] == "NOT READY" and got["score"] <= 59 and len(got["findings"]) == found.count()
    assert report.exit_code(found, "error") == 1 and report.exit_code(found, "never") == 0
    assert "policy-2022.md" in report.to_markdown(summary, found, "x") and "Fix first" in report.to_text(summary, found, "x")
    assert "<table>" in report.to_html(docs, summary, found, "x")
    only = scan.findings(docs, scan.Options(2026), only=["pii"])
    assert {r["check"] for r in only.collect()} == {"pii", "secret", "unreadable"}


def test_a_crash_becomes_a_row(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("text")
    monkeypatch.setitem(scan.CHECKS, "pii", lambda d, o: 1 / 0)
    docs = files.with_text(files.read_documents(spark, str(tmp_path)))
    assert "pii-crashed" in {r["check"] for r in scan.findings(docs, scan.Options(2026), only=["pii"]).collect()}


def test_a_failed_check_ends_the_query(spark, monkeypatch):
    for name in list(scan.CHECKS):
        monkeypatch.delitem(scan.CHECKS, name)
    monkeypatch.setitem(scan.CHECKS, "pii", lambda d, o: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index_queries.q_scan_findings(spark, "/root/testdata/sf0.001")


def test_a_report_without_a_check_is_incomplete(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("plain words " * 40)
    monkeypatch.setitem(scan.CHECKS, "pii", lambda d, o: 1 / 0)
    found, summary = scan.scan(files.with_text(files.read_documents(spark, str(tmp_path))), scan.Options(2026), only=["pii"])
    r = summary.first()
    assert (r["score"], r["verdict"]) == (None, "INCOMPLETE") and report.exit_code(found) == 1
    assert "no score INCOMPLETE" in report.to_text(summary, found, "x")
    with pytest.raises(ZeroDivisionError):
        index_queries.q_scan_report(spark, "/root/testdata/sf0.001")


def test_static_commands(capsys):
    assert cli.main(["explain", "f1"]) == 0 and cli.main(["explain", "F99"]) == 2 and cli.main(["coverage"]) == 0
    assert cli.main(["scan", "/no/such/path"]) == 2
    assert "F33" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    rows = [("a.txt", "txt", "call 415-555-0187 now", None, "2024-01-01 00:00:00"), ("b.txt", "txt", "plain " * 40, None, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "path string, fmt string, text string, read_error string, t string").selectExpr("path", "fmt", "text", "read_error", "timestamp(t) as loaded_at")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incremental.run(stream, str(tmp_path / "out"), str(tmp_path / "cp"), scan.Options(2026))
    q.awaitTermination(120)
    assert {r["check"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"pii", "extraction-empty"}
    w = incremental.volume(stream).writeStream.format("memory").queryName("vol").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.sql("select sum(documents) n from vol").first()["n"] == 2
