"""From findings to scores, verdicts, report orders and graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: what a finding costs and how much one check may cost a document (fixed values)
WEIGHT = {"error": 12, "warn": 4, "info": 0}
CAP = {"error": 35, "warn": 12, "info": 0}
RANK = {"error": 0, "warn": 1, "info": 2}
#: checks by damage, within a severity (fixed values)
IMPACT = [
    "version-conflict", "secret", "version-stale", "pii", "unreadable", "extraction-scanned",
    "extraction-empty", "duplicate", "version-period-twins", "extraction-garbled", "chunk-split",
    "extraction-table", "extraction-images", "chunk-table-split",
]
#: owner categories (fixed values)
CATEGORIES = {
    "answers": ["version-conflict", "version-stale", "duplicate"],
    "exposure": ["secret", "pii"],
    "invisible": ["unreadable", "extraction-empty", "extraction-scanned", "extraction-garbled", "extraction-images", "extraction-table"],
    "chunking": ["chunk-split", "chunk-table-split", "chunk-orphan-heading"],
    "collection": ["version-period-twins", "metadata-no-date", "metadata-no-owner", "metadata-placeholder", "metadata-old"],
}
#: display tags (fixed values)
TAGS = {
    "version-conflict": "CONFLICT", "version-stale": "STALE", "version-period-twins": "TWINS",
    "duplicate": "DUPLICATE", "extraction-empty": "EMPTY", "extraction-scanned": "SCANNED",
    "extraction-images": "IMAGES", "extraction-garbled": "GARBLED", "extraction-table": "TABLE",
    "chunk-split": "SPLIT", "chunk-orphan-heading": "HEADING", "chunk-table-split": "TABLE SPLIT",
    "pii": "PII", "secret": "SECRET", "metadata-no-date": "NO DATE", "metadata-no-owner": "NO OWNER",
    "metadata-placeholder": "PLACEHOLDER", "metadata-old": "OLD", "unreadable": "UNREADABLE",
}
#: failure modes: stage, name, grade of evidence (fixed values)
MODES = {
    "F1": ("Ingestion", "Stale / outdated data", "Strong"),
    "F2": ("Ingestion", "Missing / incomplete documents", "Moderate"),
    "F3": ("Ingestion", "Layout parsing errors", "Strong"),
    "F4": ("Ingestion", "Multimodality conversion loss", "Moderate"),
    "F5": ("Representation", "Tokenization fragmentation", "Limited"),
    "F6": ("Representation", "Embedding drift / model mismatch", "Limited"),
    "F7": ("Retrieval", "Chunking boundary errors", "Strong"),
    "F8": ("Retrieval", "Domain embedding mismatch", "Strong"),
    "F9": ("Retrieval", "Multi-hop reasoning gaps", "Strong"),
    "F10": ("Retrieval", "Graph RAG trade-offs", "Moderate"),
    "F11": ("Retrieval", "Low recall / ranking failures", "Moderate"),
    "F12": ("Retrieval", "Position-of-gold bias", "Strong"),
    "F13": ("Generation", "Hallucination despite context", "Strong"),
    "F14": ("Generation", "Conflicting information unresolved", "Strong"),
    "F15": ("Generation", "Incomplete / partial answers", "Moderate"),
    "F16": ("Generation", "Incorrect specificity", "Moderate"),
    "F17": ("Generation", "Wrong output format", "Limited"),
    "F18": ("Evaluation", "Metric inadequacy", "Strong"),
    "F19": ("Evaluation", "Lack of continuous monitoring", "Limited"),
    "F20": ("Deployment", "Latency / cost bottlenecks", "Moderate"),
    "F21": ("Deployment", "Auditability gaps", "Moderate"),
    "F22": ("Deployment", "Domain portability degradation", "Moderate"),
    "F23": ("Deployment", "PII / compliance leaks", "Moderate"),
    "F24": ("Deployment", "Prompt sensitivity", "Moderate"),
    "F25": ("Deployment", "Authorization / policy failures", "Moderate"),
    "F26": ("Agentic", "Planning failures", "Limited"),
    "F27": ("Agentic", "Tool selection / execution errors", "Limited"),
    "F28": ("Agentic", "Context memory degradation", "Limited"),
    "F29": ("Agentic", "Multi-agent coordination failures", "Limited"),
    "F30": ("Agentic", "Recursive hallucination cascades", "Limited"),
    "F31": ("Agentic", "Unbounded cost / latency spirals", "Limited"),
    "F32": ("Agentic", "Unsafe reasoning chains", "Limited"),
    "F33": ("Agentic", "Attribution & governance gaps", "Limited"),
}
COVERED = ["F1", "F2", "F3", "F4", "F7", "F14", "F21", "F23"]


def lookup(c: str | Column, values: dict, default: object = None) -> Column:
    """A fixed table as a literal expression: no join, no broadcast."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(default)
    whens = None
    for k, v in values.items():
        whens = F.when(c == k, F.lit(v)) if whens is None else whens.when(c == k, F.lit(v))
    return whens.otherwise(out)


def penalties(findings: DataFrame) -> DataFrame:
    """(path, check, penalty): findings count against their path, conflicts against the related paths too."""
    own = F.when(F.coalesce("path", F.lit("")).isin("", "(corpus)"), F.array().cast("array<string>")).otherwise(F.array("path"))
    targets = F.when(F.col("check").startswith("version-conflict"), F.concat(own, F.coalesce("related", F.array().cast("array<string>")))).otherwise(own)
    f = findings.select("check", "severity", F.explode(targets).alias("path"))
    return f.groupBy("path", "check").agg(
        F.least(F.sum(lookup("severity", WEIGHT, 0)), F.max(lookup("severity", CAP, 0))).cast("long").alias("penalty")
    )


def document_scores(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """100 less the penalties, 0 for unreadable documents."""
    total = penalties(findings).groupBy("path").agg(F.sum("penalty").alias("penalty"))
    lost = F.coalesce("penalty", F.lit(0))
    return docs.select("path", "read_error").join(total, "path", "left").select(
        "path", F.when(F.col("read_error").isNotNull(), 0).otherwise(F.greatest(F.lit(0), 100 - lost)).cast("long").alias("score"), lost.cast("long").alias("penalty")
    )


def verdict(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, "NOT READY").when(warnings > 0, "REVIEW").otherwise("READY")


def clamp(score: Column, errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, F.least(score, F.lit(59))).when(warnings > 0, F.least(score, F.lit(89))).otherwise(score)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in RANK])


def corpus_report(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: score, verdict and counts. The mean is rounded half to even, as the reports do."""
    mean = document_scores(docs, findings).agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("documents"))
    bare = F.coalesce("path", F.lit("")).isin("", "(corpus)") & ~(F.col("check").startswith("version-conflict") & (F.size(F.coalesce("related", F.array().cast("array<string>"))) > 0))
    half = F.floor(F.least(lookup("severity", WEIGHT, 0), lookup("severity", CAP, 0)) / 2)
    f = findings.agg(F.coalesce(F.sum(F.when(bare, half)), F.lit(0)).alias("corpus"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in RANK])
    raw = F.greatest(F.lit(0), F.coalesce(F.bround("mean"), F.lit(0)).cast("long") - F.col("corpus"))
    e, w = F.col("n_error"), F.col("n_warn")
    return mean.crossJoin(f).select(clamp(raw, e, w).cast("long").alias("score"), verdict(e, w).alias("verdict"), "documents", "n_error", "n_warn", "n_info")  # one row each


#: checks of this name say that a check was not done
UNDONE = "-(?:crashed|unavailable)$"


def scan_report(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``corpus_report`` of a scan: where a check was not done the verdict is INCOMPLETE and there is no score."""
    undone = findings.agg(F.coalesce(F.bool_or(F.col("check").rlike(UNDONE)), F.lit(False)).alias("undone"))
    r = corpus_report(docs, findings).crossJoin(undone)  # one row each
    return r.select(F.when(~F.col("undone"), F.col("score")).alias("score"), F.when(F.col("undone"), "INCOMPLETE").otherwise(F.col("verdict")).alias("verdict"), "documents", "n_error", "n_warn", "n_info")


def export_report(findings: DataFrame) -> DataFrame:
    """Score of an export: 100 less 12 per error and 3 per warning."""
    c = severity_counts(findings)
    e, w = F.col("n_error"), F.col("n_warn")
    return c.select(clamp(F.greatest(F.lit(0), 100 - 12 * e - 3 * w), e, w).cast("long").alias("score"), verdict(e, w).alias("verdict"), "n_error", "n_warn", "n_info")


def report_key() -> list[Column]:
    return [lookup("severity", RANK, 3), lookup("check", {c: k for k, c in enumerate(IMPACT)}, len(IMPACT)), F.col("check"), F.col("path")]


def top_findings(findings: DataFrame, limit: int = 20) -> DataFrame:
    """The first rows of the report; a bounded top-k, not a global sort."""
    return findings.filter("severity <> 'info'").orderBy(*report_key(), "finding_id").limit(limit)


def category(c: str = "check") -> Column:
    return lookup(c, {check: name for name, checks in CATEGORIES.items() for check in checks}, "other")


def tag(c: str = "check") -> Column:
    return F.coalesce(lookup(c, TAGS), F.left(F.upper(F.col(c)), F.lit(12)))


#: pages of a range that are one array
PAGE_STEP = 2000


def ranges_of(location: str | Column) -> Column:
    """First and last page of each range named in a location such as 'p.4–7, 9; p.12, line 5'."""
    loc = F.col(location) if isinstance(location, str) else location
    groups = F.regexp_extract_all(F.coalesce(loc, F.lit("")), F.lit("p\\.[ ]?([0-9]+(?:[ ]?[–-][ ]?[0-9]+)?(?:, ?[0-9]+(?:[ ]?[–-][ ]?[0-9]+)?)*)"), 1)
    parts = F.filter(F.flatten(F.transform(groups, lambda g: F.split(g, ", ?"))), lambda x: x != "")

    def span(x: Column) -> Column:
        ends = F.split(x, "[ ]?[–-][ ]?")
        a = F.try_element_at(ends, F.lit(1)).cast("int")
        b = F.coalesce(F.try_element_at(ends, F.lit(2)).cast("int"), a)
        return F.struct(a.alias("a"), b.alias("b"))

    return F.filter(F.transform(parts, span), lambda x: x.b >= x.a)


def pages_of(location: str | Column) -> Column:
    """All page numbers of a location as one array, for short ranges; ``pages`` reads long ones."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ranges_of(location), lambda x: F.sequence(x.a, x.b)))))


def pages(findings: DataFrame, location: str = "location") -> DataFrame:
    """Adds ``page``, one row per page of each range; a long range is read in steps, so that no row holds all of it."""
    r = findings.withColumn("_r", F.explode(ranges_of(location)))
    r = r.withColumn("_p", F.explode(F.sequence(F.col("_r.a"), F.col("_r.b"), F.lit(PAGE_STEP))))
    return r.withColumn("page", F.explode(F.sequence("_p", F.least(F.col("_r.b"), F.col("_p") + (PAGE_STEP - 1))))).drop("_r", "_p")


def graph_edges(findings: DataFrame) -> DataFrame:
    """Undirected links between documents by kind; period twins form a chain in their given order."""
    kinds = lookup("check", {"version-conflict": "conflict", "version-stale": "stale", "duplicate": "dup"})
    direct = findings.select("path", kinds.alias("kind"), F.explode("related").alias("other")).filter("kind is not null")
    twins = findings.filter(F.col("check") == "version-period-twins").withColumn("chain", F.concat("related", F.array("path")))
    links = twins.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("chain") - 1, F.lit(1))), lambda i: F.struct(F.try_element_at("chain", i).alias("path"), F.try_element_at("chain", i + 1).alias("other")))).alias("e"))
    chain = links.select("e.path", F.lit("period").alias("kind"), "e.other").filter("other is not null")
    both = direct.select("path", "kind", "other").unionByName(chain).filter("path <> other")
    return both.select(F.least("path", "other").alias("a"), F.greatest("path", "other").alias("b"), "kind").distinct()


def graph_nodes(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts by severity and the worst status of each document."""
    targets = F.when(F.col("check").isin("version-conflict", "duplicate"), F.concat(F.array("path"), "related")).otherwise(F.array("path"))
    per = findings.select("severity", F.explode(targets).alias("path")).groupBy("path").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in RANK])
    n = {s: F.coalesce(f"n_{s}", F.lit(0)) for s in RANK}
    status = F.when(F.col("read_error").isNotNull(), "unreadable").when(n["error"] > 0, "error").when(n["warn"] > 0, "warn").when(n["info"] > 0, "info").otherwise("clean")
    return docs.select("path", "read_error").join(per, "path", "left").select("path", status.alias("status"), *[n[s].alias(f"n_{s}") for s in RANK])


def taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(k, *v, k in COVERED) for k, v in MODES.items()]
    return spark.createDataFrame(rows, "code string, stage string, name string, grade string, covered boolean")


def mode_counts(findings: DataFrame, spark: SparkSession) -> DataFrame:
    n = findings.select(F.explode("f_codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("findings"))
    return taxonomy(spark).join(n, "code", "left").select("code", "stage", "name", "grade", "covered", F.coalesce("findings", F.lit(0)).alias("findings"))

