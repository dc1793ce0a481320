"""Text that extracted badly: empty, scanned and image-heavy documents, garbled text, flattened tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.functions import text as T
from sieveworks.sources.tables import finding
from sieveworks.storage import materialize

#: function words of seven languages (fixed values)
STOPWORDS = (
    "the of and to in is that for it as was with be by on are this or from at which have not"
    " an but they his her their were has will would can been we you all one there if more"
    " le la les des du et est une dans pour que qui pas sur au el los las del en por con para"
    " una es lo se da do em os um uma il di che non per della der die das und ist nicht mit"
    " ein eine den von zu het een van op dat"
).split()

#: patterns (fixed values)
CID = r"\(cid:\d+\)"
CONTROL = r"(?<![\n ])[\x00-\x08\x0b\x0e-\x1f\x7f]"
MOJIBAKE = "Ã[\\x{80}-¿]|â€[\\x{80}-¿‐-™Œ-ž]|Â[\\x{a0}-¿]"
SPACED = "(?<![A-Za-z])(?:[A-Za-z] {1,2}){7,}[A-Za-z](?![A-Za-z])"
ASCII_WORD = r"(?<![A-Za-z0-9_\\])[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9_(])"
JUNK = r"(?<![A-Za-z0-9_\\])(?:[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{4,}|[A-Za-z]+\d+[A-Za-z]+[A-Za-z0-9]*)(?![A-Za-z0-9_(])"


def _n(c: Column, pattern: str, gate: Column) -> Column:
    return F.when(gate, F.regexp_count(c, F.lit(pattern))).otherwise(0).cast("long")


def garbled_counts(pages: DataFrame) -> DataFrame:
    """Counters of each signal of garbled text, and the signals over their thresholds. A cheap sign gates each pattern."""
    t = F.col("text")
    junk = F.size(F.filter(F.regexp_extract_all(t, F.lit(JUNK), 0), lambda w: w != F.upper(w)))
    out = pages.withColumns({
        "n_chars": F.length(t).cast("long"), "n_replacement": T.count_of(t, "�"), "n_cid": _n(t, CID, t.contains("(cid:")),
        "n_control": _n(t, CONTROL, t.rlike(r"[\x00-\x08\x0b\x0e-\x1f\x7f]")), "n_mojibake": _n(t, MOJIBAKE, t.rlike("[ÃâÂ]")),
        "n_spaced": F.when(t.rlike(SPACED), F.length(F.regexp_replace(F.array_join(F.regexp_extract_all(t, F.lit(SPACED), 0), ""), " ", ""))).otherwise(0).cast("long"),
        "n_junk": F.when(t.rlike(JUNK), junk).otherwise(0).cast("long"),
    })
    doubtful = F.col("n_junk") >= 20
    stop = F.regexp_count(F.lower(t), F.lit(T.EDGE + "(?:" + "|".join(sorted(set(STOPWORDS), key=lambda w: (-len(w), w))) + ")" + T.EDGE))
    out = out.withColumn("n_ascii", _n(t, ASCII_WORD, doubtful)).withColumn("n_stop", F.when(doubtful, stop).otherwise(0).cast("long"))
    few = (F.col("n_ascii") >= 200) & (F.col("n_junk") >= 0.1 * F.col("n_ascii")) & (F.col("n_stop") < 0.03 * F.col("n_ascii"))
    signals = [
        (F.col("n_replacement") >= 5, "replacement characters"), (F.col("n_cid") >= 3, "glyph codes"), ((F.col("n_control") >= 8) & (F.col("n_control") >= 0.005 * F.col("n_chars")), "control characters"),
        (F.col("n_mojibake") >= 3, "mojibake sequences"), (F.col("n_spaced") >= 24, "letter-spaced runs"), (few, "few dictionary words"),
    ]
    return out.withColumn("signals", F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, s in signals])))


def page_ranges(numbers: Column, most: int = 8) -> Column:
    """'p.1–4, 6' from an array of page numbers, folded without leaving the row."""
    ordered = F.array_sort(F.array_distinct(numbers))
    start = F.array().cast("array<struct<a:int,b:int>>")
    last = lambda acc: F.element_at(acc, -1)
    runs = F.aggregate(
        ordered, start,
        lambda acc, n: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)).b == n - 1),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1)).a.alias("a"), n.cast("int").alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(n.cast("int").alias("a"), n.cast("int").alias("b"))))),
    )
    shown = F.transform(F.slice(runs, 1, most), lambda r: F.when(r.a == r.b, r.a.cast("string")).otherwise(F.concat(r.a.cast("string"), F.lit("–"), r.b.cast("string"))))
    more = F.size(runs) - most
    return F.when(F.size(ordered) == 0, "").otherwise(
        F.concat(F.lit("p."), F.array_join(shown, ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more ranges)"))).otherwise(""))
    )


def table_lines(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Non-blank lines with their number and whether they look like a table row."""
    pipes = (F.col("fmt") != "md") if "fmt" in docs.columns else F.lit(True)
    rows = docs.select(*keys, pipes.alias("pipes"), F.posexplode(T.lines("text")).alias("line", "s")).filter(F.col("s").rlike(f"[^{T.SPACE}]"))
    rows = rows.withColumn("_raw", T.strip("s"))
    rows = rows.withColumn("_s", F.when(F.col("_raw").rlike(r"[|0-9]"), F.regexp_replace("_raw", T.BULLET, "")))
    rows = rows.withColumn("_w", T.words("_s"))
    return rows.select(*keys, "line", "s", T.table_row_of(F.col("_raw"), F.col("_s"), F.col("_w"), F.col("pipes")).alias("is_row"))


def runs_of(lines: DataFrame, keys: list[str], min_rows: int = 4) -> DataFrame:
    """Maximal runs of table rows (gaps and islands over non-blank lines): first line, last line, rows."""
    w = Window.partitionBy(*keys).orderBy("line")
    numbered = lines.withColumn("island", F.sum((~F.col("is_row")).cast("long")).over(w))
    runs = numbered.filter("is_row").groupBy(*keys, "island").agg(
        F.min("line").cast("long").alias("first_line"), F.max("line").cast("long").alias("last_line"), F.count(F.lit(1)).alias("n_rows"), *([F.min_by("s", "line").alias("header")] if "s" in lines.columns else [])
    )
    return runs.filter(F.col("n_rows") >= min_rows).drop("island")


def table_runs(docs: DataFrame, keys: list[str], min_rows: int = 4) -> DataFrame:
    return runs_of(table_lines(docs, keys), keys, min_rows)


def page_stats(pages: DataFrame) -> DataFrame:
    """Words, characters and images of each page."""
    return pages.select(
        "path", "fmt", "number", T.word_count("text").alias("words"), F.coalesce(F.length(T.strip("text")), F.lit(0)).alias("chars"),
        F.greatest(F.coalesce("image_count", F.lit(0)), F.lit(0)).alias("images"),
    )


def findings(pages: DataFrame) -> DataFrame:
    """Scanned, empty, image-heavy, garbled and tabular documents, from one row per page."""
    pages = materialize(pages.select("path", "fmt", "number", "text", "image_count"), "pages")  # five passes read it
    st = page_stats(pages).withColumn("scanned", (F.col("fmt") == "pdf") & (F.col("images") >= 1) & (F.col("chars") < 25))
    heavy = (F.col("fmt") == "pdf") & ~F.col("scanned") & (F.col("images") >= 3) & (F.col("words") < 80)
    doc = st.groupBy("path", "fmt").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("words").alias("words"), F.sum("images").alias("images"), F.count_if("scanned").alias("n_scanned"),
        page_ranges(F.collect_list(F.when(F.col("scanned"), F.col("number")))).alias("scanned_at"), F.count_if(heavy).alias("n_heavy"), page_ranges(F.collect_list(F.when(heavy, F.col("number")))).alias("heavy_at"),
    )
    scanned = doc.filter("n_scanned > 0").select(*finding(
        "extraction-scanned", F.when(F.col("n_scanned") >= 0.5 * F.col("n_pages"), "error").otherwise("warn"), ["F3"],
        F.format_string("%d of %d pages scanned without a text layer (%s)", "n_scanned", "n_pages", "scanned_at"), F.col("path"), F.col("scanned_at"), fix="Run OCR before indexing.",
    ))
    empty = doc.filter("words < 20 and n_scanned < n_pages").select(*finding(
        "extraction-empty", "error", ["F2", "F3"], F.format_string("Only %d words of text extracted", "words"), F.col("path"), fix="Export the source again or leave it out.",
    ))
    full = doc.filter("words >= 20")
    sparse = (F.col("fmt") != "pdf") & (F.col("images") >= 3) & (F.col("words") < 30 * F.col("images"))
    images = full.filter((F.col("n_heavy") > 0) | sparse).select(*finding(
        "extraction-images", "warn", ["F4"], F.when(F.col("n_heavy") > 0, F.concat(F.lit("Image-heavy pages: "), "heavy_at")).otherwise(F.format_string("%d images and %d words", "images", "words")),
        F.col("path"), F.col("heavy_at"), fix="Describe key figures in text.",
    ))
    text = pages.join(full.select("path"), "path", "left_semi")
    garbled = (
        garbled_counts(text.filter("text is not null")).filter(F.size("signals") > 0).groupBy("path", "fmt")
        .agg(page_ranges(F.collect_list("number")).alias("at"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("signals")))), ", ").alias("what"))
        .select(*finding("extraction-garbled", "warn", ["F3"], F.concat(F.lit("Garbled text: "), "what"), F.col("path"), F.when(F.col("fmt") == "pdf", F.col("at")).otherwise(""), fix="Extract again with another parser."))
    )
    keys = ["path", "fmt", "number"]
    flagged = materialize(table_lines(text, keys).drop("s"), "lines")
    runs = runs_of(flagged, keys)
    per_page = runs.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"))
    dense = dense_pages(text.join(runs.select(*keys).distinct(), keys, "left_anti")).select(*keys, F.lit(0).cast("long").alias("n_rows"))
    lines = flagged.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))
    tables = (
        per_page.unionByName(dense).groupBy("path", "fmt").agg(F.sum("n_rows").alias("rows"), F.count(F.lit(1)).alias("table_pages"), page_ranges(F.collect_list("number")).alias("at"))
        .join(lines, "path").join(doc.select("path", "n_pages"), "path")
    )
    warn = (F.col("rows") >= 0.2 * F.col("lines")) | ((F.col("fmt") == "pdf") & (F.col("table_pages") >= 0.3 * F.col("n_pages")))
    tables = tables.select(*finding(
        "extraction-table", F.when(warn, "warn").otherwise("info"), ["F3"], F.format_string("Table content (%d rows) extracts as flat text", "rows"), F.col("path"),
        F.when(F.col("fmt") == "pdf", F.col("at")).otherwise(""), fix="Use a table-aware parser and repeat the header in every chunk.",
    ))
    return scanned.unionByName(empty).unionByName(images).unionByName(garbled).unionByName(tables)


def dense_pages(pages: DataFrame) -> DataFrame:
    """Pages of a PDF that are mostly numbers without forming rows."""
    toks = T.words("text")
    numbers = F.size(F.filter(toks, T.is_number_token))
    starts = F.regexp_count("text", F.lit(f"(?<![^{T.SPACE}])[(\\[]?[-+−]?[$€£¥]?\\d"))
    gated = pages.filter((F.col("fmt") == "pdf") & (starts >= 40))
    return gated.filter((numbers >= 40) & (numbers >= 0.4 * F.size(toks)))
