"""Checks of an exported index: consecutive chunks of a source, sizes, duplicates, missing keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.functions import text as T
from sieveworks.operators import chunking, personal
from sieveworks.sources.tables import finding
from sieveworks.storage import materialize

MAX_TOKENS, TINY_WORDS = 8191, 5
NO_SOURCE = "(no source)"
GARBLED = r"�|\(cid:[0-9]+\)|[\x00-\x08\x0b\x0e-\x1f\x7f]"
#: a chunk that ends like this does not end inside a sentence
TERMINAL = f"[.!?:;)\\]\"'”’][{T.SPACE}]*$"


def tokens(c: str = "text"):
    """Estimate of tokens: a third more than the words."""
    return F.bround(T.word_count(c) * 1.33).cast("long")


STRETCH = 512


def ordered(chunks: DataFrame) -> DataFrame:
    """Chunks numbered within their source by the export's keyword, missing ones last, then by position.

    A source may hold a third of all rows, so no window spans a whole source: rows are ordered within stretches of
    the keyword, and a small table with one row per stretch carries the numbers and first texts across.
    """
    c = chunks.withColumn("src", F.coalesce("source", F.lit(NO_SOURCE)))
    late = F.col("ord").isNull()
    c = c.withColumn("stretch", F.struct(late.alias("late"), F.when(late, F.floor(F.col("i") / STRETCH)).otherwise(F.floor(F.col("ord") / STRETCH)).alias("k")))
    w = Window.partitionBy("src", "stretch").orderBy(F.col("ord").asc_nulls_last(), "i", "chunk_id")
    local = c.withColumn("n", F.row_number().over(w)).withColumn("here_next", F.lead(F.struct("text")).over(w))
    first = c.groupBy("src", "stretch").agg(F.count(F.lit(1)).alias("size"), F.min_by("text", F.struct(F.coalesce("ord", F.lit(0.0)), "i", "chunk_id")).alias("first_text"))
    across = Window.partitionBy("src").orderBy("stretch")
    first = first.select(
        "src", "stretch", (F.sum("size").over(across) - F.col("size")).alias("before"), F.lead(F.struct(F.col("first_text").alias("text"))).over(across).alias("there_next")
    )
    both = local.join(first, ["src", "stretch"]).withColumn("nx", F.coalesce("here_next", "there_next"))
    return both.withColumn("n", F.col("n") + F.col("before")).withColumn("next_text", F.col("nx.text")).withColumn("next_n", F.when(F.col("nx").isNotNull(), F.lit(1))).drop("here_next", "there_next", "before", "nx", "stretch")


def pairs(chunks: DataFrame) -> DataFrame:
    """Consecutive chunks with what goes on after a repeated tail, and the condition that opens it."""
    tail = lambda k: F.right(F.rtrim("text"), F.lit(k))
    def after(k: int):
        pos = F.expr(f"instr(next_text, right(rtrim(text), {k}))")
        return F.when((F.length(tail(k)) >= 20) & (pos > 0), F.substr("next_text", pos + F.length(tail(k))))

    c = ordered(chunks).filter("next_n is not null").withColumn("goes_on", F.coalesce(after(120), after(60), after(30), F.col("next_text")))
    head = F.array_join(F.slice(T.words("goes_on"), 1, 4), " ")
    open_end = (T.strip("text") != "") & ~F.col("text").rlike(TERMINAL)
    last = F.try_element_at(F.filter(T.lines("text"), lambda x: T.strip(x) != ""), F.lit(-1))
    return c.select(
        "src", "n", "chunk_id", "page", open_end.alias("open_end"), F.when(open_end, chunking.qualifier_of(head)).otherwise("").alias("qualifier"),
        F.coalesce(T.is_heading(last), F.lit(False)).alias("ends_in_heading"), _table_header().alias("table_header"),
    )


def _table_header():
    """Header of the table that the chunk ends in, if the next chunk opens with two of its rows and lacks the header."""
    rows = lambda c: F.filter(T.lines(c), lambda x: T.strip(x) != "")
    nxt = rows("next_text")
    digits_or_bars = F.col("next_text").rlike(r"[|0-9]")
    opens = (F.size(nxt) >= 2) & T.is_table_row(F.try_element_at(nxt, F.lit(1))) & T.is_table_row(F.try_element_at(nxt, F.lit(2)))
    none = F.array().cast("array<string>")
    # the rows at the end of the chunk: a line that is none starts the fold again
    run = F.aggregate(rows("text"), none, lambda acc, x: F.when(T.is_table_row(x), F.concat(acc, F.array(x))).otherwise(none))
    header = T.strip(F.try_element_at(run, F.lit(1)))
    return F.when(digits_or_bars, F.when(opens, F.when((F.size(run) >= 2) & ~F.col("next_text").contains(header), header)))


def table_goes_on(p: DataFrame) -> DataFrame:
    """Pairs whose next chunk continues a table without its header."""
    return p.filter("table_header is not null").select("src", "n", F.col("table_header").alias("header"))


def duplicates(chunks: DataFrame) -> DataFrame:
    """Chunks that repeat an earlier one of the export, with the first."""
    k = chunks.filter(T.word_count("text") >= TINY_WORDS).select("chunk_id", "i", F.sha1(F.lower(T.collapse("text"))).alias("digest"))
    first = k.groupBy("digest").agg(F.min(F.struct("i", "chunk_id")).alias("f"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return k.join(first, "digest").filter(F.struct("i", "chunk_id") != F.col("f")).select("chunk_id", F.col("f.chunk_id").alias("first_id"), "copies")


def findings(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """All findings of the export, one row per source and check and one per index-wide check."""
    # one pass over pairs and one over chunks leave narrow tables that the checks read
    p = materialize(pairs(chunks), "pairs")
    o = chunks.withColumn("src", F.coalesce("source", F.lit(NO_SOURCE)))
    w = T.word_count("text")
    flags = materialize(o.select(
        "src", (tokens() > max_tokens).alias("big"), (w < TINY_WORDS).alias("tiny"), (F.regexp_count("text", F.lit(GARBLED)) >= 3).alias("garbled"), F.col("source").isNull().alias("bare"),
        F.greatest(w, F.lit(1)).alias("w"), T.rule_density("text").alias("d"),
    ), "flags")
    density = flags.groupBy("src").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("density"))
    split = p.filter("qualifier <> ''").groupBy("src").agg(F.count(F.lit(1)).alias("k"), F.array_join(F.slice(F.array_sort(F.collect_set("qualifier")), 1, 3), ", ").alias("q"), F.min("n").alias("n")).join(density, "src")
    count = lambda df: df.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    src = F.col("src")
    parts = [
        split.select(*finding("chunk-split", F.when(F.col("density") >= 10, "warn").otherwise("info"), ["F7"], F.format_string("%d chunks end before their condition (%s)", "k", "q"), src, F.format_string("chunk %d", "n"))),
        count(p.filter("ends_in_heading")).select(*finding("chunk-orphan-heading", "info", ["F7"], F.format_string("%d chunks end with a heading", "k"), src)),
        count(table_goes_on(p)).select(*finding("chunk-table-split", "warn", ["F7"], F.format_string("%d chunks continue a table without its header", "k"), src)),
        count(flags.filter("big")).select(*finding("chunk-oversize", "warn", ["F7", "F20"], F.format_string("%d chunks exceed the token limit", "k"), src)),
        count(flags.filter("tiny")).select(*finding("chunk-tiny", "info", ["F11"], F.format_string("%d near-empty chunks", "k"), src)),
        count(flags.filter("garbled")).select(*finding("extraction-garbled", "warn", ["F3"], F.format_string("%d chunks with garbled characters", "k"), src)),
        personal.findings(personal.hits(o.select(src.alias("path"), F.lit("chunks").alias("fmt"), F.lit(1).alias("page"), F.lit(0).alias("line_offset"), "text")), is_export=True),
        duplicates(chunks).agg(F.count(F.lit(1)).alias("k")).filter("k > 0").select(*finding("chunk-duplicate", "warn", ["F1"], F.format_string("%d duplicate chunks in the index", "k"), "(index)")),
        flags.filter("bare").agg(F.count(F.lit(1)).alias("k")).filter("k > 0").select(*finding("chunk-no-source", "warn", ["F21", "F33"], F.format_string("%d chunks have no source", "k"), "(index)")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
